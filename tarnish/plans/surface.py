"""Risk surfaces: the loss of every defect combination, in one pass over the fact table.

Which rows a defect hits does not depend on the other defects, so a row that is
hit by the set H answers combination S as combination S & H. Writing an answer
as a sum over subsets,

    answer(S) = sum over T within S of  sum over U within T of (-1)**|T - U| * f(U & H),

a row adds something to the cell of T only where T lies within H. At 10 %
severity nearly all rows are hit by none or one defect, so the pass costs a few
contributions per row instead of one per combination, and repeats and
severities share the scan, the joins and the shuffle. Cells are tiny compared
with the fact table: groups x 2**(defects that matter to the query).

That takes 3**|H| contributions of a row. Where defects are few enough to list all pairs (H, U),
cells are the rows hit by exactly H, damaged by U within H, which takes 2**|H| of them; and

    answer(S) = clean answer + sum over H of cell(H, S & H) - cell(H, nothing).

Where combinations are named, only they are evaluated, with U = S & H for a named S.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.functions import dice
from tarnish.functions.coalitions import EXACT_LIMIT, mask_key, members
from tarnish.operators.defects import (
    KEYS,
    CopyDefect,
    CustomerDefect,
    Defect,
    OrderDefect,
    Scenario,
    checked,
    copy_draws,
    diagnostics,
    hit_seeds,
    in_order,
    plan_scenarios,
    stream_seeds,
    struck,
)
from tarnish.operators.loss import answer_loss, relative_error, weighted_risk
from tarnish.operators.sampling import NOTHING, below
from tarnish.plans.workload import (
    DIMENSION_KEYS,
    Query,
    SqlQuery,
    execute_workload,
    keys_of,
    query_weights,
    run,
    star_workload,
    values_of,
)
from tarnish.session import small_table, stored
from tarnish.sources.star import Star

PLAN_ROW_LIMIT = 200_000
#: Runs of the direct surface that are written together.
BATCH = 16
SCENARIOS_PER_WORD = 60


@dataclass(frozen=True)
class Surface:
    """``losses`` (severity, repeat, query, mask, loss) and the settings they belong to."""

    star: Star
    losses: DataFrame
    channels: tuple[str, ...]
    severities: tuple[float, ...]
    repeats: tuple[int, ...]
    master_seed: int
    weights: Mapping[str, float]
    defects: tuple[Defect, ...]
    scenarios: tuple[Scenario, ...]

    @property
    def workload(self) -> tuple[str, ...]:
        return tuple(self.weights)

    def risks(self) -> DataFrame:
        """(severity, repeat, mask, loss, query_losses)."""
        return weighted_risk(self.losses, self.weights, ["severity", "repeat", "mask"])

    def observations(self) -> DataFrame:
        """One row per severity, repeat and combination, with keys, losses and diagnostics."""
        mask = F.col("mask")
        done = diagnostics(self.star, self.defects, self.scenarios, self.master_seed)
        bit = F.lit(0).cast("long")
        for i, name in enumerate(self.channels):
            bit = F.when(F.col("channel") == name, F.lit(1 << i).cast("long")).otherwise(bit)
        cutters = sum(
            1 << i for i, d in enumerate(self.defects) if isinstance(d, OrderDefect) and d.unlinks == "customers"
        )

        def described(entry: Column, mask: Column) -> Column:
            reached = F.when(mask.bitwiseAND(F.lit(cutters)) != 0, entry["linked_orders"]).otherwise(
                entry["impacted_orders"]
            )
            facts = {
                "kind": entry["kind"],
                "affected": entry["affected"],
                "realized_rate": entry["realized_rate"],
                "setting": entry["setting"],
                "impacted_orders": reached,
                "fact_amplification": reached / F.greatest(entry["affected"], F.lit(1)),
            }
            pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in facts.items()])
            return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))

        entry = F.struct(
            bit.alias("bit"),
            "channel",
            "kind",
            "affected",
            "realized_rate",
            "setting",
            "impacted_orders",
            "linked_orders",
        )
        packed = done.groupBy("severity", "repeat").agg(F.array_sort(F.collect_list(entry)).alias("done"))
        taken = F.filter("done", lambda x: x["bit"].bitwiseAND(mask) != 0)
        return (
            self.risks()
            .join(packed, ["severity", "repeat"])
            .select(
                "severity",
                "repeat",
                "mask",
                members(mask, self.channels).alias("coalition"),
                mask_key(mask, self.channels).alias("coalition_key"),
                F.bit_count(mask).cast("int").alias("coalition_size"),
                "loss",
                F.lit(self.star.orders.count()).cast("long").alias("orders"),
                "query_losses",
                F.map_from_entries(
                    F.transform(taken, lambda x: F.struct(x["channel"].alias("k"), described(x, mask).alias("v")))
                ).alias("diagnostics"),
            )
        )


def needed_columns(defects: Sequence[Defect], query: Query) -> set[str]:
    """Columns the answer depends on, directly or through the rewrites of other defects."""
    return _closure(defects, query.reads() | {DIMENSION_KEYS[j] for j in query.joins})


def _closure(defects: Sequence[Defect], needed: set[str]) -> set[str]:
    while True:
        more = {c for d in defects if isinstance(d, OrderDefect) and set(d.writes) & needed for c in d.reads}
        if more <= needed:
            return needed
        needed |= more


def touches(defect: Defect, query: Query, needed: set[str]) -> bool:
    """Can the defect change this query's answer?"""
    if isinstance(defect, CopyDefect):
        return query.aggregate != "distinct"
    if isinstance(defect, CustomerDefect) and "customers" not in query.joins:
        return False
    return bool(set(defect.writes) & needed)


def relevant_mask(defects: Sequence[Defect], query: Query) -> int:
    needed = needed_columns(defects, query)
    return sum(1 << i for i, d in enumerate(defects) if touches(d, query, needed))


def _check_rewritable(defects: Sequence[Defect], workload: Sequence[Query]) -> None:
    moved = [c for d in defects if isinstance(d, CustomerDefect) for c in d.writes]
    if len(moved) != len(set(moved)):
        raise ValueError("two customer defects on one column need the direct surface")
    for q in workload:
        if isinstance(q, SqlQuery):
            raise ValueError(f"{q.name}: SQL text needs the direct surface")
        for i, d in enumerate(defects):
            if not isinstance(d, OrderDefect) or not relevant_mask(defects, q) >> i & 1:
                continue
            joined = {DIMENSION_KEYS[j] for j in q.joins}
            if set(d.writes) & joined and (d.unlinks not in q.joins or set(d.writes) & joined != {DIMENSION_KEYS[d.unlinks]}):
                raise ValueError(f"{q.name} under {d.name}: re-linked keys need the direct surface")
            if q.aggregate == "distinct" and d.unlinks not in q.joins:
                raise ValueError(f"{q.name} under {d.name}: this distinct count needs the direct surface")
        if q.aggregate == "distinct" and (q.joins != ("customers",) or q.measure != "customer_id" or q.where):
            raise ValueError(f"{q.name}: only distinct customers by a customer column are rewritable")
        if q.aggregate == "distinct" and q.reads(q.key) - {"region", "segment"}:
            raise ValueError(f"{q.name}: only distinct customers by a customer column are rewritable")


def _plan_rows(defects: Sequence[Defect], queries: Sequence[tuple[int, Query]], by_query: bool) -> int:
    m, rows = len(defects), 0
    for _, q in queries:
        k = relevant_mask(defects, q).bit_count()
        rows += 4**k if by_query else 2 ** (m - k) * 4**k
    return rows


def _deposited(number: str, mask: str, m: int) -> str:
    """SQL value: the low bits of a number, in order, at the places of the mask's bits."""
    bits = [f"if(({mask} & {1 << c}L) != 0, shiftleft(shiftright({number}, bit_count({mask} & {(1 << c) - 1}L)) & 1L, {c}), 0L)" for c in range(m)]
    return " + ".join(bits or ["0L"])


def _slots(spark: SparkSession, defects: Sequence[Defect], queries: Sequence[tuple[int, Query]], needs: Mapping[int, int]) -> DataFrame:
    """(q, rel, need): the defects that matter to each query and the conditions it needs."""
    return small_table(spark, [(i, relevant_mask(defects, q), needs[i]) for i, q in queries], "q int, rel long, need long")


def _contribution_plan(
    spark: SparkSession,
    defects: Sequence[Defect],
    queries: Sequence[tuple[int, Query]],
    needs: Mapping[int, int],
    by_query: bool,
) -> DataFrame:
    """(h, q, t, u, sign, need): what a row hit by exactly h adds; h = -1 is the clean pass.

    Its size depends on the number of defects and queries only. Each defect is
    in one of four states: not hit, hit but not in T, in T but not in U, in U.
    ``by_query`` lists only the defects that matter to the query in h.
    """
    m = len(defects)
    slots = _slots(spark, defects, queries, needs)
    span = "rel" if by_query else f"{(1 << m) - 1}L"
    numbered = slots.selectExpr("q", "need", "rel", f"{span} AS span", f"explode(sequence(0L, shiftleft(1L, 2 * cast(bit_count({span}) AS int)) - 1L)) AS id")
    # two binary digits for each defect of the span: hit, in T or in U
    digits = [f"shiftright(id, 2 * cast(bit_count(span & {(1 << c) - 1}L) AS int)) & 3" for c in range(m)]
    states = ", ".join([f"if((span & {1 << c}L) != 0, {d}, 0L)" for c, d in enumerate(digits)])
    staged = numbered.selectExpr("q", "need", "rel", f"array({states}) AS d" if m else "cast(array() AS array<bigint>) AS d")

    def packed(test: str) -> str:
        return " + ".join([f"if(d[{c}] {test}, {1 << c}L, 0L)" for c in range(m)] or ["0L"])

    grid = staged.selectExpr(
        f"{packed('> 0')} AS h",
        "q",
        f"{packed('> 1')} AS t",
        f"{packed('= 3')} AS u",
        "if(size(filter(d, x -> x = 2)) % 2 = 0, 1.0D, -1.0D) AS sign",
        "need",
        "rel",
    )
    delta = grid.filter(f"t != 0 AND ({'h' if by_query else 't'} & ~rel) = 0").drop("rel")
    return _clean_plan(slots).unionByName(delta)


def _pair_rows(defects: Sequence[Defect], queries: Sequence[tuple[int, Query]]) -> int:
    """Pairs of a set of hits and a combination, over all queries."""
    return sum(4 ** relevant_mask(defects, q).bit_count() for _, q in queries)


def _hit_plan(spark: SparkSession, defects: Sequence[Defect], queries: Sequence[tuple[int, Query]], needs: Mapping[int, int]) -> DataFrame:
    """As ``_contribution_plan``, but t is all that hits a row of a query's defects, and u any part of it."""
    m, slots = len(defects), _slots(spark, defects, queries, needs)
    hits = slots.selectExpr("*", f"explode(sequence(0L, {(1 << m) - 1}L)) AS h").where("(h & rel) != 0").selectExpr("h", "q", "h & rel AS t", "need")
    parts = hits.selectExpr("*", "explode(sequence(0L, shiftleft(1L, cast(bit_count(t) AS int)) - 1L)) AS i")
    return _clean_plan(slots).unionByName(parts.selectExpr("h", "q", "t", f"{_deposited('i', 't', m)} AS u", "1.0D AS sign", "need"))


def _clean_plan(slots: DataFrame) -> DataFrame:
    return slots.selectExpr("-1L AS h", "q", "0L AS t", "0L AS u", "1.0D AS sign", "need")


def _possible_hits(slots: DataFrame, seen: DataFrame, m: int) -> DataFrame:
    """(q, need, seen, h): every set of a query's defects that may hit a row, and what the query sees of the named combinations."""
    listed = seen.groupBy("q").agg(F.collect_set("s_mask").alias("seen"))
    numbered = listed.join(slots, "q").selectExpr("q", "need", "seen", "rel", "explode(sequence(0L, shiftleft(1L, cast(bit_count(rel) AS int)) - 1L)) AS i")
    return numbered.selectExpr("q", "need", "seen", f"{_deposited('i', 'rel', m)} AS h").where("h != 0")


def _named_plan(spark: SparkSession, defects: Sequence[Defect], queries: Sequence[tuple[int, Query]], needs: Mapping[int, int], seen: DataFrame) -> DataFrame:
    """As ``_contribution_plan``, for named combinations: t is h itself, u what one of them damages of it, or nothing."""
    slots = _slots(spark, defects, queries, needs)
    damaged = "explode(array_distinct(array_append(transform(seen, s -> s & h), 0L))) AS u"
    return _clean_plan(slots).unionByName(_possible_hits(slots, seen, len(defects)).selectExpr("h", "q", "h AS t", damaged, "1.0D AS sign", "need"))


def _named_spread(spark: SparkSession, defects: Sequence[Defect], queries: Sequence[tuple[int, Query]], seen: DataFrame) -> DataFrame:
    """(q, t, u, s_mask, sign): which cells (t, u) make up the answer of each named combination."""
    slots = _slots(spark, defects, queries, {i: 0 for i, _ in queries})
    met = _possible_hits(slots, seen, len(defects)).selectExpr("q", "h", "explode(seen) AS s_mask").where("(s_mask & h) != 0")
    both = "inline(array(named_struct('u', s_mask & h, 'sign', 1.0D), named_struct('u', 0L, 'sign', -1.0D)))"
    return met.selectExpr("q", "h AS t", "s_mask", both).unionByName(seen.selectExpr("q", "0L AS t", "s_mask", "0L AS u", "1.0D AS sign"))


def _lattice_spread(spark: SparkSession, defects: Sequence[Defect], queries: Sequence[tuple[int, Query]]) -> DataFrame:
    """(q, t, s_mask, sign): the cells t within each combination s of a query's defects, 3**defects for each query."""
    slots = _slots(spark, defects, queries, {i: 0 for i, _ in queries})
    numbered = slots.selectExpr("q", "rel", "explode(sequence(0L, cast(round(pow(3, bit_count(rel))) AS bigint) - 1L)) AS id")
    digits = {c: f"cast(floor(id / pow(3, bit_count(rel & {(1 << c) - 1}L))) AS bigint) % 3" for c in range(len(defects))}

    def packed(least: int) -> str:
        return " + ".join([f"if((rel & {1 << c}L) != 0 AND {d} >= {least}, {1 << c}L, 0L)" for c, d in digits.items()] or ["0L"])

    return numbered.selectExpr("q", f"{packed(2)} AS t", f"{packed(1)} AS s_mask", "1.0D AS sign")


def _scenario_table(defects: Sequence[Defect], scenarios: Sequence[Scenario], master_seed: int) -> str:
    """SQL text: the clean pass (n = -1) and all scenarios as one array of seeds."""

    def fields(n: int, s: Scenario | None) -> str:
        out = [f"'n', {n}"]
        for i, d in enumerate(defects):
            if isinstance(d, CopyDefect):
                seeds = copy_draws(master_seed, s.repeat, d.name, 1).row_seeds if s else (0, 0)
            else:
                seeds = hit_seeds(master_seed, s.repeat, d.name) if s else (0, 0)
                for stream in d.streams if isinstance(d, OrderDefect) else ():
                    a, b = stream_seeds(master_seed, s.repeat, d.name, stream) if s else (0, 0)
                    out.append(f"'{stream}{i}_a', {a}L, '{stream}{i}_b', {b}L")
            out.append(f"'a{i}', {seeds[0]}L, 'b{i}', {seeds[1]}L")
        return f"named_struct({', '.join(out)})"

    return f"array({', '.join([fields(-1, None), *[fields(n, s) for n, s in enumerate(scenarios)]])})"


def _cut_table(defects: Sequence[Defect], scenarios: Sequence[Scenario]) -> str:
    """SQL text: the cuts of the clean pass, which nothing is below, and of all scenarios."""

    def fields(s: Scenario | None) -> str:
        out = []
        for i, d in enumerate(defects):
            if isinstance(d, CopyDefect):
                first, *more = (s.copies[d.name] if s else ()) or (NOTHING,)
                listed = ", ".join(f"named_struct('h', {h}L, 'k', {k}L)" for h, k in (*more, NOTHING))
                out.append(f"'more{i}', array({listed})")
            else:
                first = s.cuts[d.name] if s else NOTHING
            out.append(f"'h{i}', {first[0]}L, 'k{i}', {first[1]}L")
        return f"named_struct({', '.join(out)})"

    return f"array({', '.join([fields(None), *map(fields, scenarios)])})"


def _prepared_customers(star: Star, defects: Sequence[Defect]) -> DataFrame:
    customers = star.customers
    for d in defects:
        if isinstance(d, CustomerDefect):
            customers = d.prepare(customers)
    return customers


def _sum_cells(
    star: Star,
    defects: Sequence[Defect],
    scenarios: Sequence[Scenario],
    master_seed: int,
    queries: Sequence[tuple[int, Query]],
    seen: DataFrame | None = None,
) -> DataFrame:
    """Cells (n, q, t, u, text, day, s, c): sums and counts by hits and damage; n = -1, t = 0 is the clean answer.

    ``seen`` (q, s_mask) are the parts of named combinations. Without it, and with too many pairs of hits and
    combinations, cells are signed sums (n, q, t, text, day, s, c).
    """
    spark = star.orders.sparkSession
    written = {c for d in defects if not isinstance(d, CopyDefect) for c in d.writes}
    early = sorted({q.where for _, q in queries if q.where and not (q.reads(q.where) & written)})
    needs = {i: (1 << early.index(q.where)) if q.where in early else 0 for i, q in queries}
    used = {c for _, q in queries for c in needed_columns(defects, q)} | written | {"order_id"}

    rows = star.orders.select(*[c for c in star.orders.columns if c in used or c == "customer_id"])
    if any("customers" in q.joins for _, q in queries):
        people = _prepared_customers(star, defects).withColumn("_customers", F.lit(True))
        keep = [c for c in people.columns if c in used or c.split("__")[0] in used or c in ("customer_id", "_customers")]
        rows = rows.join(people.select(*keep), "customer_id", "left")
    if any("products" in q.joins for _, q in queries):
        goods = star.products.withColumn("_products", F.lit(True))
        keep = [c for c in goods.columns if c in used or c in ("product_id", "_products")]
        rows = rows.join(goods.select(*keep), "product_id", "left")

    passed = F.lit(0).cast("long")
    for i, where in enumerate(early):
        passed = passed + F.when(F.expr(where), F.lit(1 << i)).otherwise(F.lit(0))
    rows = rows.withColumn("_passed", passed)

    table = _scenario_table(defects, scenarios, master_seed)
    rows = rows.selectExpr("*", f"explode({table}) AS z")
    keys = ["customer_id" if isinstance(d, CustomerDefect) else "order_id" for d in defects]
    rolls = {}
    for i, d in enumerate(defects):
        rolls[f"_r{i}"] = (keys[i], (f"z.a{i}", f"z.b{i}"))
        for stream in d.streams if isinstance(d, OrderDefect) else ():
            rolls[f"_{stream}{i}"] = (keys[i], (f"z.{stream}{i}_a", f"z.{stream}{i}_b"))
    rows = dice.add_rolls(rows, rolls)
    # between the rolls and the tests rows are written out: the scenarios' numbers stay behind, and their cuts are looked up
    copied = [f"_r{i}" for i in range(len(defects))]
    rows = rows.selectExpr(*[c for c in rows.columns if c != "z"], "z.n AS n")
    cuts, bits, extra = f"element_at({_cut_table(defects, scenarios)}, n + 2)", "0L", "0L"
    for i, d in enumerate(defects):
        first = below(f"_r{i}", keys[i], (f"{cuts}.h{i}", f"{cuts}.k{i}"))
        bits += f" + if({first}, {1 << i}L, 0L)"
        if isinstance(d, CopyDefect):
            # an interpreted array filter: it runs on hit rows only, and as it stays out of the
            # fused loop, the roll half and the aggregation half are compiled as separate methods
            again = f"filter({cuts}.more{i}, c -> {below(f'_r{i}', keys[i], ('c.h', 'c.k'))})"
            extra = f"if({first}, 1L + size({again}), 0L)"
    rows = rows.selectExpr(*[c for c in rows.columns if c not in copied], f"if(n < 0, -1L, {bits}) AS _h", f"{extra} AS _extra")
    # rows that nothing hits have no partner in the plan; the join drops them

    paired = seen is not None or _pair_rows(defects, queries) <= PLAN_ROW_LIMIT
    by_query = seen is not None or not paired and _plan_rows(defects, queries, False) > PLAN_ROW_LIMIT
    if seen is None and paired:
        plan = _hit_plan(spark, defects, queries, needs)
        plan_rows = sum(3 ** k << len(defects) - k for k in (relevant_mask(defects, q).bit_count() for _, q in queries))
    elif seen is None:
        plan = _contribution_plan(spark, defects, queries, needs, by_query)
        plan_rows = _plan_rows(defects, queries, by_query)
    else:
        plan = _named_plan(spark, defects, queries, needs, seen)
        plan_rows = sum(3 ** relevant_mask(defects, q).bit_count() for _, q in queries)
    meets = (F.col("_h") == F.col("h")) & (F.col("_passed").bitwiseAND(F.col("need")) == F.col("need"))
    if by_query:
        # many defects: look up only those that matter to each query
        slots = ", ".join(f"named_struct('_q', {i}, '_rel', {relevant_mask(defects, q)}L)" for i, q in queries)
        rows = rows.selectExpr("*", f"inline(array({slots}))").withColumn("_h", F.expr("if(n < 0, -1L, _h & _rel)"))
        meets = meets & (F.col("_q") == F.col("q"))
    if plan_rows <= PLAN_ROW_LIMIT:
        # sized by the number of defects and queries, whatever the size of the data
        plan = F.broadcast(plan)
    rows = rows.join(plan, meets)

    current = {c: F.col(c) for c in rows.columns}
    linked = {j: F.col(f"_{j}").isNotNull() for j in DIMENSION_KEYS if f"_{j}" in rows.columns}
    weight = F.lit(1.0)
    for d in in_order(defects):
        i = list(defects).index(d)
        on = F.col("u").bitwiseAND(F.lit(1 << i)) != 0
        if isinstance(d, CopyDefect):
            weight = F.when(on, F.lit(1.0) + F.col("_extra").cast("double")).otherwise(F.lit(1.0))
        elif isinstance(d, CustomerDefect):
            for c in d.writes:
                if d.damaged(c) in current:
                    current[c] = F.when(on, F.col(d.damaged(c))).otherwise(current[c])
        else:
            if d.unlinks in linked:
                linked[d.unlinks] = linked[d.unlinks] & ~on
            new = d.rewrite(current, {s: F.col(f"_{s}{i}") for s in d.streams})
            for c, value in new.items():
                if c in current and c != "customer_id":
                    current[c] = F.when(on, value).otherwise(current[c])
    plain = [c for c in rows.columns if not c.startswith("_") and "__" not in c]
    rows = rows.select(
        *[current[c].alias(c) for c in plain],
        (F.col("sign") * weight).alias("w"),
        *[ok.alias(f"linked_{j}") for j, ok in linked.items()],
    )

    def by_query(pick, default: Column | None = None) -> Column:
        chosen = None
        for i, q in queries:
            value = pick(q)
            if value is None:
                continue
            test = F.col("q") == i
            chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
        if chosen is None:
            return default
        return chosen if default is None else chosen.otherwise(default)

    ok = by_query(lambda q: _all_linked(q.joins), F.lit(True))
    late = by_query(lambda q: F.expr(q.where) if q.where and q.where not in early else None, F.lit(True))
    measures = {i: "1.0D" if q.aggregate == "count" else q.measure for i, q in queries}
    value = _by_text(measures, lambda text: F.expr(text).cast("double"))
    text_key = _by_text({i: q.key for i, q in queries if q.kind == "text"}, lambda k: F.expr(k).cast("string"))
    day_key = _by_text(
        {i: q.key for i, q in queries if q.kind == "date"}, lambda k: F.unix_date(F.expr(k).cast("date"))
    )
    cell = ["n", "q", "t", "u"] if paired else ["n", "q", "t"]
    kept = rows.filter(ok & late).select(
        *cell, text_key.cast("string").alias("text"), day_key.cast("int").alias("day"), "w", value.alias("v")
    )
    return (
        kept.filter("v IS NOT NULL")
        .groupBy(*cell, "text", "day")
        .agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("c"))
    )


def _by_text(texts: Mapping[int, str], build) -> Column:
    """One CASE over queries in which equal expressions share a branch."""
    owners: dict[str, list[int]] = {}
    for i, text in texts.items():
        owners.setdefault(text, []).append(i)
    chosen = None
    for text, group in owners.items():
        test = F.col("q").isin(group)
        chosen = F.when(test, build(text)) if chosen is None else chosen.when(test, build(text))
    return F.lit(None) if chosen is None else chosen


def _all_linked(joins: tuple[str, ...]) -> Column | None:
    ok = None
    for j in joins:
        ok = F.col(f"linked_{j}") if ok is None else ok & F.col(f"linked_{j}")
    return ok


def _subsets(mask: int) -> list[int]:
    out, sub = [], mask
    while True:
        out.append(sub)
        if sub == 0:
            return sorted(out)
        sub = (sub - 1) & mask


def _sum_losses(
    cells: DataFrame,
    defects: Sequence[Defect],
    queries: Sequence[tuple[int, Query]],
    n_scenarios: int,
    seen: DataFrame | None = None,
) -> DataFrame:
    """(n, q, s, loss) for s within the query's relevant defects, or for the named ones that it sees."""
    spark = cells.sparkSession
    if seen is None and _pair_rows(defects, queries) <= PLAN_ROW_LIMIT:
        # few combinations: all of them, as if they were named
        parts = [(i, s) for i, q in queries for s in _subsets(relevant_mask(defects, q))]
        every = small_table(spark, parts, "q int, s_mask long")
        spread, on = F.broadcast(_named_spread(spark, defects, queries, every)), ["q", "t", "u"]
    elif seen is None:
        spread, on = _lattice_spread(spark, defects, queries), ["q", "t"]
        rows = sum(3 ** relevant_mask(defects, q).bit_count() for _, q in queries)
        if rows <= PLAN_ROW_LIMIT:
            spread = F.broadcast(spread)
    else:
        spread, on = _named_spread(spark, defects, queries, seen), ["q", "t", "u"]
    # the clean cells join every scenario; one expression, so that the pass over the facts runs once
    numbers = f"explode(if(n < 0, sequence(0, {n_scenarios - 1}), array(n))) AS n"
    each = cells.selectExpr(*on, "text", "day", "s", "c", numbers).join(spread, on)
    is_clean = F.col("t") == 0
    sums = each.groupBy("n", "q", "s_mask", "text", "day").agg(
        F.sum(F.when(is_clean, F.col("s"))).alias("ref_s"),
        F.sum(F.when(is_clean, F.col("c"))).alias("ref_c"),
        F.sum(F.col("sign") * F.col("s")).alias("obs_s"),
        F.sum(F.col("sign") * F.col("c")).alias("obs_c"),
    )
    averages = [i for i, q in queries if q.aggregate == "avg"]

    def answer(side: str) -> Column:
        mean = F.when(F.col(f"{side}_c") > 0.5, F.col(f"{side}_s") / F.col(f"{side}_c"))
        return F.coalesce(F.when(F.col("q").isin(averages), mean).otherwise(F.col(f"{side}_s")), F.lit(0.0))

    return (
        sums.select("n", "q", "s_mask", answer("ref").alias("ref"), answer("obs").alias("obs"))
        .groupBy("n", "q", "s_mask")
        .agg(relative_error(F.col("ref"), F.col("obs")).alias("loss"))
    )


def _distinct_losses(
    star: Star,
    defects: Sequence[Defect],
    scenarios: Sequence[Scenario],
    master_seed: int,
    queries: Sequence[tuple[int, Query]],
    seen: Mapping[int, Sequence[int]],
) -> DataFrame:
    """(n, q, s, loss) of distinct customers per customer group, for the combinations ``seen`` of each query.

    A customer drops out of a combination when every one of their orders has
    lost its key. One bit per scenario and AND over a customer's orders decide
    that for all scenarios with the shuffle of a single distinct count. Answers
    are the clean counts and the changes: only a customer that drops out or moves
    in a scenario is listed for it, and only for combinations that this is true of.
    """
    spark = star.orders.sparkSession
    cutters = [(i, d) for i, d in enumerate(defects) if isinstance(d, OrderDefect) and d.unlinks == "customers"]
    movers = [(i, d) for i, d in enumerate(defects) if isinstance(d, CustomerDefect)]
    cutter_mask = sum(1 << i for i, _ in cutters)
    combos = sorted({x & cutter_mask for q_seen in seen.values() for x in q_seen} - {0})
    words = -(-len(scenarios) // SCENARIOS_PER_WORD)

    lost = {f"lost_{n}_{i}": (s, d) for n, s in enumerate(scenarios) for i, d in cutters}
    orders = struck(star.orders.select("customer_id", "order_id"), lost, master_seed, KEYS)

    def packed(word: int, flags: Mapping[int, str]) -> str:
        """SQL value: the flags of a word's scenarios, one bit each."""
        first = word * SCENARIOS_PER_WORD
        bits = [f"if({flags[n]}, {1 << (n - first)}L, 0L)" for n in range(first, min(len(scenarios), first + SCENARIOS_PER_WORD))]
        return " + ".join(bits)

    def any_lost(combo: int) -> dict[int, str]:
        chosen = [i for i, _ in cutters if combo >> i & 1]
        return {n: "(" + " OR ".join(f"lost_{n}_{i}" for i in chosen) + ")" for n in range(len(scenarios))}

    marks = {f"gone_{c}_{w}": packed(w, any_lost(c)) for c in combos for w in range(words)}
    orders = orders.selectExpr("customer_id", *[f"{text} AS {name}" for name, text in marks.items()])
    if marks:
        present = orders.groupBy("customer_id").agg(*[F.bit_and(name).alias(name) for name in marks])
    else:
        present = orders.distinct()
    people = present.join(_prepared_customers(star, defects), "customer_id")
    moved = {f"moved_{n}_{i}": (s, d) for n, s in enumerate(scenarios) for i, d in movers}
    kept = people.columns
    people = struck(people, moved, master_seed, KEYS).selectExpr(
        *kept,
        *[
            f"{packed(w, {n: f'moved_{n}_{i}' for n in range(len(scenarios))})} AS moved_{i}_{w}"
            for i, _ in movers
            for w in range(words)
        ],
    )
    # read for the clean counts and for the changes; tests on flags that are not written would roll the dice anew
    people = stored(people, "counted-customers")

    def bit(name: str) -> str:
        """SQL test: the bit of scenario n in a packed column."""
        listed = ", ".join(f"{name}_{w}" for w in range(words))
        return f"(shiftright(element_at(array({listed}), cast(n div {SCENARIOS_PER_WORD} AS int) + 1), n % {SCENARIOS_PER_WORD}) & 1L) = 1L"

    def some(names: Sequence[str]) -> str:
        """SQL test: any scenario's bit is set."""
        return " OR ".join([f"{name}_{w} != 0" for name in names for w in range(words)] or ["false"])

    struck_out, moved_bits = [f"gone_{c}" for c in combos], [f"moved_{i}" for i, _ in movers]
    # moves and losses of all scenarios, by the few customers that have any
    hit = people.where(some([*struck_out, *moved_bits])).selectExpr("*", f"explode(sequence(0, {len(scenarios) - 1})) AS n")
    hit = hit.where(" OR ".join([bit(name) for name in [*struck_out, *moved_bits]] or ["false"]))
    pieces = None
    for q_index, q in queries:
        rel = relevant_mask(defects, q)
        subsets = ", ".join(f"{x}L" for x in seen[q_index])
        here = "true"
        for combo in sorted({x & cutter_mask for x in seen[q_index]} - {0}):
            here = f"if((s_mask & {cutter_mask}L) = {combo}L, NOT ({bit(f'gone_{combo}')}), {here})"
        key = q.key
        for i, d in movers:
            if rel >> i & 1:
                key = f"if((s_mask & {1 << i}L) != 0 AND ({bit(f'moved_{i}')}), {d.damaged(q.key)}, {key})"
        each = hit.selectExpr("*", f"explode(array({subsets})) AS s_mask").selectExpr("n", "s_mask", f"{q.key} AS was", f"{key} AS now", f"{here} AS live")
        # one unit less where the customer was, one more where it is now
        sides = "inline(array(named_struct('k', was, 'obs', -1.0D, 'live', true), named_struct('k', now, 'obs', 1.0D, 'live', live)))"
        changes = each.where("NOT live OR NOT (was <=> now)").selectExpr("n", "s_mask", sides).filter("live").selectExpr("n", "s_mask", "k", "0.0D AS ref", "obs")
        clean = people.groupBy(F.expr(q.key).alias("k")).agg(F.count("*").cast("double").alias("ref"))
        clean = clean.selectExpr("k", "ref", f"explode(sequence(0, {len(scenarios) - 1})) AS n").selectExpr("n", f"explode(array({subsets})) AS s_mask", "k", "ref", "ref AS obs")
        counted = clean.unionByName(changes).groupBy("n", "s_mask", "k").agg(F.sum("ref").alias("ref"), F.sum("obs").alias("obs"))
        loss = counted.groupBy("n", F.lit(q_index).alias("q"), "s_mask").agg(relative_error(F.col("ref"), F.col("obs")).alias("loss"))
        pieces = loss if pieces is None else pieces.unionByName(loss)
    return pieces


def risk_surface(
    star: Star,
    defects: Sequence[Defect],
    *,
    severities: Sequence[float] = (0.10,),
    repeats: int | Sequence[int] = 10,
    master_seed: int = 2027,
    workload: Sequence[Query] | None = None,
    weights: Mapping[str, float] | None = None,
    masks: DataFrame | None = None,
) -> Surface:
    """Losses of all combinations (or of the given ``masks``), from one pass over the orders."""
    spark = star.orders.sparkSession
    defects = checked(defects)
    repeats = tuple(range(repeats)) if isinstance(repeats, int) else tuple(repeats)
    if not repeats:
        raise ValueError("at least one repeat is required")
    if masks is None and len(defects) > EXACT_LIMIT:
        raise ValueError(f"beyond {EXACT_LIMIT} defects name the combinations to evaluate")
    workload = tuple(workload or star_workload())
    resolved = query_weights([q.name for q in workload], weights)
    _check_rewritable(defects, workload)
    scenarios = plan_scenarios(star, defects, severities, repeats, master_seed)
    numbered = list(enumerate(workload))
    additive = [(i, q) for i, q in numbered if q.aggregate != "distinct"]
    distinct = [(i, q) for i, q in numbered if q.aggregate == "distinct"]
    named = masks is not None
    if not named:
        masks = spark.range(1 << len(defects)).withColumnRenamed("id", "mask")
    # a combination has the answer of its part that the query can see
    sights = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.lit(relevant_mask(defects, q)).cast("long").alias("seen")) for i, q in numbered]))
    spread = masks.select(F.col("mask").cast("long").alias("mask")).distinct().select("mask", sights.alias("s")).select("s.q", "mask", F.col("mask").bitwiseAND(F.col("s.seen")).alias("s_mask"))
    if named:  # read by several plans, and possibly the result of random orders
        spread = stored(spread, "named")
    seen = spread.select("q", "s_mask").distinct() if named else None
    parts = None
    if additive:
        cells = _sum_cells(star, defects, scenarios, master_seed, additive, seen)
        parts = _sum_losses(cells, defects, additive, len(scenarios), seen)
    if distinct:
        # as many combinations as are named
        shown = {i: _subsets(relevant_mask(defects, q)) for i, q in distinct}
        if named:
            shown = {i: sorted(row["s_mask"] for row in seen.where(F.col("q") == i).collect()) for i, _ in distinct}
        more = _distinct_losses(star, defects, scenarios, master_seed, [(i, q) for i, q in distinct if shown[i]], shown)
        parts = more if parts is None or more is None else parts.unionByName(more)
    names = small_table(spark, [(i, q.name) for i, q in numbered], "q int, query string")
    pairs = small_table(spark, [(n, s.severity, s.repeat) for n, s in enumerate(scenarios)], "n int, severity double, repeat int")
    losses = parts.join(spread, ["q", "s_mask"]).join(names, "q").join(pairs, "n")
    losses = losses.select("severity", "repeat", "query", "mask", "loss")
    return Surface(
        star,
        losses,
        tuple(d.name for d in defects),
        tuple(float(s) for s in severities),
        repeats,
        master_seed,
        resolved,
        defects,
        tuple(scenarios),
    )


def _flagged(star: Star, defects: Sequence[Defect], scenarios: Sequence[Scenario], master_seed: int) -> Star:
    """The star with what the dice of all scenarios say of each row, written once.

    ``_hit_<scenario>_<defect>`` is a test, or a number of copies; streams are kept where they are needed.
    """
    numbered = list(enumerate(defects))
    on_orders = {f"_hit_{n}_{i}": (s, d) for n, s in enumerate(scenarios) for i, d in numbered if not isinstance(d, CustomerDefect)}
    on_customers = {f"_hit_{n}_{i}": (s, d) for n, s in enumerate(scenarios) for i, d in numbered if isinstance(d, CustomerDefect)}
    orders, words = struck(star.orders, on_orders, master_seed, KEYS), {}
    for n, s in enumerate(scenarios):
        for i, d in numbered:
            for stream in d.streams if isinstance(d, OrderDefect) else ():
                words[f"_{stream}_{n}_{i}"] = ("order_id", stream_seeds(master_seed, s.repeat, d.name, stream))
    orders = dice.add_rolls(orders, words)
    orders = orders.withColumns({w: F.when(F.col("_hit_" + "_".join(w.rsplit("_", 2)[1:])), F.col(w)) for w in words})
    customers = struck(_prepared_customers(star, defects), on_customers, master_seed, KEYS)
    return star.with_tables(orders=stored(orders, "flagged-orders"), customers=stored(customers, "flagged-customers"))


def _assembled(star: Star, flagged: Star, defects: Sequence[Defect], n: int, mask: int) -> Star:
    """The star of one scenario and combination, row by row from the flags."""
    orders, customers, copies = flagged.orders, flagged.customers, None
    for d in in_order(defects):
        i = list(defects).index(d)
        hit = F.col(f"_hit_{n}_{i}")
        if not mask >> i & 1:
            continue
        if isinstance(d, OrderDefect):
            new = d.rewrite({c: F.col(c) for c in star.orders.columns}, {x: F.col(f"_{x}_{n}_{i}") for x in d.streams})
            orders = orders.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items() if c in star.orders.columns})
        elif isinstance(d, CustomerDefect):
            customers = customers.withColumns({c: F.when(hit, F.col(d.damaged(c))).otherwise(F.col(c)) for c in d.writes})
        else:  # a copy has its order's id, and so its hits
            copies = hit if copies is None else copies + hit
    if copies is not None:
        orders = orders.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
    return star.with_tables(orders=orders.select(*star.orders.columns), customers=customers.select(*star.customers.columns))


def _visible(defects: Sequence[Defect], query: Query | SqlQuery) -> int:
    """The defects that may change the query's answer."""
    if isinstance(query, Query):
        return relevant_mask(defects, query)
    if query.columns is None:
        return (1 << len(defects)) - 1
    needed = _closure(defects, set(query.columns))
    return sum(1 << i for i, d in enumerate(defects) if isinstance(d, CopyDefect) or set(d.writes) & needed)


def direct_surface(
    star: Star,
    defects: Sequence[Defect],
    *,
    severity: float = 0.10,
    repeats: int | Sequence[int] = 1,
    master_seed: int = 2027,
    workload: Sequence[Query | SqlQuery] | None = None,
    weights: Mapping[str, float] | None = None,
    masks: Sequence[int] | None = None,
) -> Surface:
    """The same losses by damaging the star and running the workload once per combination.

    For workloads or defects the one-pass form cannot express: raw SQL,
    re-linked keys, other distinct counts. The dice are rolled once, for all repeats, and their
    results written; a query runs once for all combinations whose damage looks alike to it; and
    the losses of BATCH runs are computed and written together.
    """
    defects = checked(defects)
    repeats = tuple(range(repeats)) if isinstance(repeats, int) else tuple(repeats)
    if not repeats:
        raise ValueError("at least one repeat is required")
    if masks is None and len(defects) > EXACT_LIMIT:
        raise ValueError(f"beyond {EXACT_LIMIT} defects name the combinations to evaluate")
    workload = tuple(workload or star_workload())
    resolved = query_weights([q.name for q in workload], weights)
    scenarios = plan_scenarios(star, defects, [severity], repeats, master_seed)
    spark = star.orders.sparkSession
    named = sorted(set(range(1 << len(defects)) if masks is None else masks))
    flagged = _flagged(star, defects, scenarios, master_seed)
    # every comparison reads the clean answers
    reference = {name: stored(answer, "answer") for name, answer in execute_workload(star, workload).items()}
    seen = {q.name: _visible(defects, q) for q in workload}
    runs = [(n, part, q) for q in workload for n in range(len(scenarios)) for part in sorted({m & seen[q.name] for m in named} - {0})]
    told = spark.sql("SELECT 0 AS n, '' AS query, 0L AS part, 0.0D AS loss WHERE false")
    for lo in range(0, len(runs), BATCH):
        batch = None
        for n, part, q in runs[lo : lo + BATCH]:
            observed = run(_assembled(star, flagged, defects, n, part), q)
            loss = answer_loss(reference[q.name], observed, keys_of(q), values_of(q))
            loss = loss.select(F.lit(n).alias("n"), F.lit(q.name).alias("query"), F.lit(part).cast("long").alias("part"), "loss")
            batch = loss if batch is None else batch.unionByName(loss)
        told = told.unionByName(stored(batch, "direct-losses"))
    clean = [(n, q.name, 0, 0.0) for q in workload for n in range(len(scenarios))]
    told = told.unionByName(small_table(spark, clean, "n int, query string, part long, loss double"))
    spread = small_table(spark, [(q.name, m & seen[q.name], m) for q in workload for m in named], "query string, part long, mask long")
    settings = small_table(spark, [(n, s.severity, s.repeat) for n, s in enumerate(scenarios)], "n int, severity double, repeat int")
    losses = told.join(spread, ["query", "part"]).join(settings, "n").select("severity", "repeat", "query", "mask", "loss")
    return Surface(
        star,
        losses,
        tuple(d.name for d in defects),
        (float(severity),),
        repeats,
        master_seed,
        resolved,
        defects,
        tuple(scenarios),
    )
