"""Defects on star schemas, as Column expressions guarded by exactly counted hits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.functions import dice
from tarnish.operators.sampling import (
    Cut,
    Draws,
    Stream,
    affected,
    below,
    dense_ids,
    find_all_cuts,
    find_cuts,
    multiplicity,
)
from tarnish.session import small_table, stored
from tarnish.sources.star import Star

Values = Mapping[str, Column]


@dataclass(frozen=True)
class OrderDefect:
    """Rewrites columns of exactly ``severity`` of the orders.

    ``streams`` names the extra dice a rewrite needs, ``reads`` the columns it
    looks at beyond those it writes. ``unlinks`` names the dimension whose key
    the rewrite destroys: a hit order joins no row of it.
    """

    name: str
    priority: int
    writes: tuple[str, ...]
    rewrite: Callable[[Values, Values], Mapping[str, Column]]
    streams: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    unlinks: str | None = None
    facts: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class CustomerDefect:
    """Rewrites columns of exactly ``severity`` of the customers.

    ``prepare`` adds one column ``<column>__<name>`` per written column that
    holds the damaged value every customer would get.
    """

    name: str
    priority: int
    writes: tuple[str, ...]
    prepare: Callable[[DataFrame], DataFrame]

    def damaged(self, column: str) -> str:
        return f"{column}__{self.name}"


@dataclass(frozen=True)
class CopyDefect:
    """Appends copies of orders drawn with replacement, after all other damage."""

    name: str
    priority: int = 100


Defect = OrderDefect | CustomerDefect | CopyDefect


def missing_measures() -> OrderDefect:
    """The unit price of a hit order is lost (null, so aggregates skip it)."""
    return OrderDefect(
        "missing_measures", 10, ("unit_price",), lambda row, dice_: {"unit_price": F.lit(None).cast("double")}
    )


def value_noise(sigma: float = 1.0) -> OrderDefect:
    """The unit price of a hit order is multiplied by a lognormal factor."""

    def rewrite(row: Values, rolls: Values) -> Mapping[str, Column]:
        factor = F.exp(F.lit(float(sigma)) * dice.normal(rolls["radius"], rolls["angle"]))
        return {"unit_price": row["unit_price"] * factor}

    return OrderDefect(
        "value_noise", 20, ("unit_price",), rewrite, ("radius", "angle"), facts={"log_sigma": float(sigma)}
    )


def orphan_foreign_keys() -> OrderDefect:
    """The customer key of a hit order becomes a unique negative number."""
    return OrderDefect(
        "orphan_foreign_keys",
        30,
        ("customer_id",),
        lambda row, rolls: {"customer_id": -(row["order_id"] + F.lit(1))},
        unlinks="customers",
    )


def stale_timestamps(days: int = 365) -> OrderDefect:
    """The date of a hit order moves back by a number of days."""
    return OrderDefect(
        "stale_timestamps",
        40,
        ("order_date",),
        lambda row, rolls: {"order_date": row["order_date"] - F.make_dt_interval(F.lit(int(days)))},
        facts={"days_shifted": float(days)},
    )


def next_regions(customers: DataFrame) -> DataFrame:
    """Every region with the next one in sorted order, the last with the first."""
    placed = dense_ids(customers.select("region").where("region IS NOT NULL").distinct(), ["region"], "_at")
    size = F.lit(max(1, placed.count()))
    following = placed.select(F.pmod(F.col("_at") - 1, size).alias("_at"), F.col("region").alias("next_region"))
    return placed.join(following, "_at").select("region", "next_region")


def dimension_drift() -> CustomerDefect:
    """A hit customer moves to the next region of the sorted cycle."""

    def prepare(customers: DataFrame) -> DataFrame:
        cycle = next_regions(customers).withColumnRenamed("next_region", "region__dimension_drift")
        # written, so that later joins know the dimension's size
        return stored(customers.join(cycle, "region", "left"), "drifting-customers")

    return CustomerDefect("dimension_drift", 50, ("region",), prepare)


def duplicate_facts() -> CopyDefect:
    return CopyDefect("duplicate_facts")


def default_defects() -> tuple[Defect, ...]:
    return (
        missing_measures(),
        value_noise(),
        orphan_foreign_keys(),
        stale_timestamps(),
        dimension_drift(),
        duplicate_facts(),
    )


def checked(defects: Sequence[Defect]) -> tuple[Defect, ...]:
    names = [d.name for d in defects]
    if len(names) != len(set(names)):
        raise ValueError("defect names must be unique")
    return tuple(defects)


def in_order(defects: Sequence[Defect]) -> list[Defect]:
    return sorted(defects, key=lambda d: (d.priority, d.name))


@dataclass(frozen=True)
class Scenario:
    """One (severity, repeat) with the cuts that make every defect's hits row-local."""

    severity: float
    repeat: int
    counts: Mapping[str, int]
    cuts: Mapping[str, Cut]
    copies: Mapping[str, tuple[Cut, ...]]


def hit_seeds(master_seed: int, repeat: int, name: str) -> tuple[int, int]:
    return dice.seed_words("defect", master_seed, repeat, name)


def stream_seeds(master_seed: int, repeat: int, name: str, stream: str) -> tuple[int, int]:
    return dice.seed_words("defect", master_seed, repeat, name, stream)


def copy_draws(master_seed: int, repeat: int, name: str, count: int) -> Draws:
    return Draws(("copies", master_seed, repeat, name), count)


def _together(spark, *jobs: Callable) -> list:
    with ThreadPool(len(jobs)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)


def plan_scenarios(
    star: Star,
    defects: Sequence[Defect],
    severities: Sequence[float],
    repeats: Sequence[int],
    master_seed: int,
) -> list[Scenario]:
    """Find all cuts of all severities and repeats: one pass over order ids, one over customer ids.

    A repeat uses the same dice at every severity, so milder hits are a subset of harsher ones.
    """
    defects = checked(defects)
    pairs = [(float(s), int(r)) for s in severities for r in repeats]
    rows = [d for d in defects if isinstance(d, OrderDefect)]
    people = [d for d in defects if isinstance(d, CustomerDefect)]
    copies = [d for d in defects if isinstance(d, CopyDefect)]
    n_orders, n_customers = _together(
        star.orders.sparkSession,
        lambda: star.orders.count() if rows or copies else 0,
        lambda: star.customers.count() if people else 0,
    )

    def streams(kinds: Sequence[Defect], population: int) -> dict[tuple, Stream]:
        return {
            (s, r, d.name): Stream(hit_seeds(master_seed, r, d.name), affected(s, population))
            for s, r in pairs
            for d in kinds
        }

    on_orders, on_customers = streams(rows, n_orders), streams(people, n_customers)
    draws = {
        (s, r, d.name): copy_draws(master_seed, r, d.name, affected(s, n_orders)) for s, r in pairs for d in copies
    }
    def of_orders() -> tuple[list, list]:
        if not (on_orders or draws):
            return [], []
        ids = star.orders.select("order_id")
        return find_all_cuts(ids, "order_id", list(on_orders.values()), list(draws.values()), n_orders)

    def of_customers() -> list:
        if not on_customers:
            return []
        return find_cuts(star.customers.select("customer_id"), "customer_id", list(on_customers.values()), n_customers)

    # two independent passes
    order_cuts, customer_cuts = _together(star.orders.sparkSession, of_orders, of_customers)
    found: dict[tuple, Cut] = dict(zip(on_orders, order_cuts[0], strict=True))
    found |= dict(zip(on_customers, customer_cuts, strict=True))
    copied = dict(zip(draws, order_cuts[1], strict=True))
    return [
        Scenario(
            s,
            r,
            {d.name: affected(s, n_customers if isinstance(d, CustomerDefect) else n_orders) for d in defects},
            {d.name: found[s, r, d.name] for d in (*rows, *people)},
            {d.name: tuple(copied[s, r, d.name]) for d in copies},
        )
        for s, r in pairs
    ]


def struck(df: DataFrame, marks: Mapping[str, tuple[Scenario, Defect]], master_seed: int, keys: Mapping[str, str]) -> DataFrame:
    """Add a column per mark: is the row hit, or, for copies, how many does it get?

    ``keys`` names the id column for orders and for customers.
    """
    rolls, tests = {}, {}
    for name, (scenario, defect) in marks.items():
        if isinstance(defect, CopyDefect):
            key = keys["orders"]
            seeds = copy_draws(master_seed, scenario.repeat, defect.name, scenario.counts[defect.name]).row_seeds
            test = multiplicity(name, key, list(scenario.copies[defect.name]))
        else:
            key = keys["customers" if isinstance(defect, CustomerDefect) else "orders"]
            seeds = hit_seeds(master_seed, scenario.repeat, defect.name)
            test = below(name, key, scenario.cuts[defect.name])
        rolls[name], tests[name] = (key, seeds), test
    rolled = dice.add_rolls(df, rolls)
    kept = [c for c in df.columns if c not in tests]
    return rolled.selectExpr(*kept, *[f"{test} AS `{name}`" for name, test in tests.items()])


KEYS = {"orders": "order_id", "customers": "customer_id"}


def damaged_star(star: Star, defects: Sequence[Defect], scenario: Scenario, master_seed: int) -> Star:
    """Materializable form: the star with all the defects applied, in order of priority and name."""
    orders, customers = star.orders, star.customers
    for defect in in_order(checked(defects)):
        if isinstance(defect, OrderDefect):
            columns = orders.columns
            ready = struck(orders, {"_hit": (scenario, defect)}, master_seed, KEYS)
            words = {
                f"_{s}": ("order_id", stream_seeds(master_seed, scenario.repeat, defect.name, s))
                for s in defect.streams
            }
            ready = dice.add_rolls(ready, words)
            new = defect.rewrite({c: F.col(c) for c in columns}, {s: F.col(f"_{s}") for s in defect.streams})
            orders = ready.select(
                *[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns]
            )
        elif isinstance(defect, CustomerDefect):
            columns = customers.columns
            ready = defect.prepare(struck(customers, {"_hit": (scenario, defect)}, master_seed, KEYS))
            customers = ready.select(
                *[
                    F.when(F.col("_hit"), F.col(defect.damaged(c))).otherwise(F.col(c)).alias(c)
                    if c in defect.writes
                    else F.col(c)
                    for c in columns
                ]
            )
        else:
            ready = struck(orders, {"_times": (scenario, defect)}, master_seed, KEYS)
            copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times")))
            orders = ready.withColumn("_copy", copies).drop("_copy", "_times")
    return star.with_tables(orders=orders, customers=customers)


def corrupt(
    star: Star, defects: Sequence[Defect], *, severity: float, master_seed: int, repeat: int = 0
) -> tuple[Star, DataFrame]:
    """Apply a set of defects; returns the damaged star and a table of what was done."""
    (scenario,) = plan_scenarios(star, defects, [severity], [repeat], master_seed)
    damaged = damaged_star(star, defects, scenario, master_seed)
    return damaged, diagnostics(star, defects, [scenario], master_seed)


def impacted(star: Star, defects: Sequence[Defect], scenarios: Sequence[Scenario], master_seed: int) -> DataFrame:
    """Orders of the customers that each customer defect hits, in one pass.

    ``linked`` leaves out the orders that an earlier defect has cut off from
    their customer; it is what a combination with that defect reports.
    """
    people = [d for d in defects if isinstance(d, CustomerDefect)]
    known = star.customers.select("customer_id").distinct()
    orders = star.orders.join(known, "customer_id", "left_semi").select("order_id", "customer_id")
    parts, marks = [], {}
    for i, s in enumerate(scenarios):
        for d in people:
            lost = F.lit(False)
            for x in defects:
                early = isinstance(x, OrderDefect) and (x.priority, x.name) < (d.priority, d.name)
                if early and x.unlinks == "customers":
                    marks[f"lost_{i}_{x.name}"] = (s, x)
                    lost = lost | F.col(f"lost_{i}_{x.name}")
            marks[f"hit_{i}_{d.name}"] = (s, d)
            reached = F.col(f"hit_{i}_{d.name}")
            parts.append((i, d.name, reached, reached & ~lost))
    orders = struck(orders, marks, master_seed, KEYS)
    sums = [F.sum(c.cast("long")).alias(f"c{n}_{k}") for n, (_, _, a, b) in enumerate(parts) for k, c in enumerate((a, b))]
    totals = orders.agg(*sums) if sums else None
    schema = "scenario int, channel string, impacted_orders long, linked_orders long"
    if totals is None:
        return star.orders.sparkSession.createDataFrame([], schema)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("scenario"),
                F.lit(name).alias("channel"),
                F.coalesce(F.col(f"c{n}_0"), F.lit(0)).alias("impacted_orders"),
                F.coalesce(F.col(f"c{n}_1"), F.lit(0)).alias("linked_orders"),
            )
            for n, (i, name, _, _) in enumerate(parts)
        ]
    )
    return totals.select(F.inline(rows))


def diagnostics(
    star: Star, defects: Sequence[Defect], scenarios: Sequence[Scenario], master_seed: int
) -> DataFrame:
    """Per scenario and channel: counts, realized rate, and the fan-out of customer defects."""
    spark = star.orders.sparkSession
    n_orders, n_customers = star.orders.count(), star.customers.count()
    rows = []
    for i, s in enumerate(scenarios):
        for d in in_order(defects):
            size = n_customers if isinstance(d, CustomerDefect) else n_orders
            kind = {OrderDefect: "orders", CustomerDefect: "customers", CopyDefect: "added"}[type(d)]
            setting = next(iter(d.facts.values()), None) if isinstance(d, OrderDefect) else None
            rows.append((i, s.severity, s.repeat, d.name, kind, s.counts[d.name], s.counts[d.name] / max(1, size), setting))
    base = small_table(
        spark,
        rows,
        "scenario int, severity double, repeat int, channel string, kind string, affected long,"
        " realized_rate double, setting double",
    )
    reach = impacted(star, defects, scenarios, master_seed)
    return base.join(reach, ["scenario", "channel"], "left").select(
        "severity",
        "repeat",
        "channel",
        "kind",
        "affected",
        "realized_rate",
        "setting",
        "impacted_orders",
        "linked_orders",
        (F.col("impacted_orders") / F.greatest(F.col("affected"), F.lit(1))).alias("fact_amplification"),
    )
