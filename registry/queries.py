"""One query per operator; each reads the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import settings as cfg
from tarnish.functions import dice
from tarnish.functions.coalitions import key_mask, mask_key, members
from tarnish.operators import bootstrap, defects as dfx, feature_defects as ffx, game, loss, permutations, sampling
from tarnish.plans import models, studies, workload
from tarnish.plans.surface import direct_surface, risk_surface
from tarnish.session import kept_once, shared_folder, stored, stored_once
from tarnish.sources import features, sinks, star
from tarnish.sources.star import LINE_KEY, Star, customers_of, event_star, line_star, lookup_customers, products_of, read

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
#: Columns of an attribution as a report has them.
ESTIMATES = (("channel", "string"), *((c, "double") for c in ("debt", "ci_low", "ci_high", "probability_harmful", "rank_1_probability", "singleton", "current_gain", "gain_ci_low", "gain_ci_high", "banzhaf")))
WHOLE = {"severity": cfg.SEVERITY, "master_seed": cfg.MASTER}


def register(name: str):
    def keep(function: Query) -> Query:
        REGISTRY[name] = function
        return function

    return keep


def lines(spark: SparkSession, sf: str) -> Star:
    """The retail star; orders are numbered and dimensions joined once per application."""
    return kept_once(spark, ("star-lines", sf), lambda: line_star(spark, sf))


def line_losses(spark: SparkSession, sf: str) -> DataFrame:
    """(severity, repeat, query, mask, loss): the observations that attribution starts from."""

    def build() -> DataFrame:
        return risk_surface(
            lines(spark, sf),
            dfx.default_defects(),
            severities=(cfg.SEVERITY,),
            repeats=cfg.REPEATS,
            master_seed=cfg.MASTER,
        ).losses

    return stored_once(spark, ("line-losses", sf), build)


def event_losses(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        return risk_surface(
            event_star(spark, sf),
            dfx.default_defects(),
            severities=(cfg.SEVERITY,),
            repeats=cfg.EVENT_REPEATS,
            master_seed=cfg.MASTER,
        ).losses

    return stored_once(spark, ("event-losses", sf), build)


def weights() -> dict[str, float]:
    return workload.query_weights([q.name for q in workload.star_workload()])


def risks(spark: SparkSession, sf: str) -> DataFrame:
    return loss.weighted_risk(line_losses(spark, sf), weights(), ["repeat", "mask"]).select("repeat", "mask", "loss")


def risk_game(spark: SparkSession, sf: str) -> DataFrame:
    return game.mean_game(risks(spark, sf))


def r(column, digits: int = 6) -> Column:
    """Rounded so that the order of additions cannot show."""
    value = F.col(column) if isinstance(column, str) else column
    # no negative zeros; a sum, so that the value is rounded once
    return F.round(value, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    def short(c: str) -> Column:
        # numbers of at most 15 digits that end in time are what their rounding gives; others go through decimal numbers
        x, scale = F.col(c), 10.0**digits
        ends = (F.abs(x) < 1e15 / scale) & (F.rint(x * scale) / scale == x)
        return F.when(ends, x + F.lit(0.0)).otherwise(r(c, digits)).alias(c)

    return df.select(*[short(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def day(column: str = "order_date") -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# ---- sources and sinks -------------------------------------------------------


@register("star_fact")
def star_fact(spark, sf):
    orders = line_star(spark, sf).orders
    return orders.select("order_id", "customer_id", "product_id", day(), "quantity", r("unit_price", 9).alias("unit_price"), "discount", "status")


@register("star_customers")
def star_customers(spark, sf):
    return customers_of(spark, sf)


@register("lookup_csv")
def lookup_csv(spark, sf):
    """Customers as a lookup file has them, with another header, and read back from it."""
    path = f"{shared_folder(spark)}/tarnish/lookup-{uuid4().hex}"
    people = customers_of(spark, sf).select(F.col("customer_id").alias("LocationID"), F.when(F.col("region") != "ASIA", F.col("region")).alias("Borough"), F.col("segment").alias("Zone"))
    people.write.csv(path, header=True)
    return lookup_customers(spark.read.csv(path, header=True), {"LocationID": "customer_id", "Borough": "region", "Zone": "segment"})


@register("star_products")
def star_products(spark, sf):
    return products_of(spark, sf)


@register("star_events")
def star_events(spark, sf):
    star = event_star(spark, sf)
    people = star.customers.select("customer_id", "region", "segment")
    goods = star.products.select("product_id", "category")
    joined = star.orders.join(people, "customer_id").join(goods, "product_id")
    return joined.select(
        "order_id", "customer_id", "region", "segment", "product_id", "category", day(), "quantity", "unit_price", "discount", "status"
    )


@register("table_fingerprint")
def table_fingerprint(spark, sf):
    parts = None
    for name in cfg.FINGERPRINTS:
        part = sinks.table_fingerprint(read(spark, sf, name)).select(F.lit(name).alias("table_name"), "*")
        parts = part if parts is None else parts.unionByName(part)
    return parts


@register("range_scan")
def range_scan(spark, sf):
    found = star.range_scan(read(spark, sf, "lineitem"), "l_shipdate", *cfg.SCAN_DATES, {"l_quantity": cfg.SCAN_QUANTITY})
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@register("observation_records")
def observation_records(spark, sf):
    base = risks(spark, sf).select(
        "repeat",
        "mask",
        members(F.col("mask"), cfg.CHANNELS).alias("coalition"),
        mask_key(F.col("mask"), cfg.CHANNELS).alias("coalition_key"),
        F.bit_count("mask").cast("int").alias("coalition_size"),
    )
    return sinks.observation_records(base).select("repeat", "mask", "coalition_key", "record")



@register("result_files")
def result_files(spark, sf):
    """Risks and query losses written as result files and read back: lists and maps are JSON text in CSV files."""
    folder = f"{shared_folder(spark)}/tarnish/results-{uuid4().hex}"
    told = loss.weighted_risk(line_losses(spark, sf), weights(), ["repeat", "mask"]).withColumn("coalition", members(F.col("mask"), cfg.CHANNELS))
    sinks.write_results({"risks": told}, folder, fmt="csv")
    back = spark.read.csv(f"{folder}/risks", header=True)
    losses = F.from_json("query_losses", "map<string, double>")
    return back.select(
        F.col("repeat").cast("int").alias("repeat"),
        F.col("mask").cast("long").alias("mask"),
        r(F.col("loss").cast("double")).alias("loss"),
        F.size(F.from_json("coalition", "array<string>")).alias("members"),
        r(losses["daily_revenue"]).alias("daily_loss"),
    )


@register("coalition_masks")
def coalition_masks(spark, sf):
    """Means by text key, and the mask that each key stands for."""
    keyed = game.mean_game(risks(spark, sf)).select(mask_key(F.col("mask"), cfg.CHANNELS).alias("coalition_key"), r("value").alias("value"))
    return keyed.select(key_mask(F.col("coalition_key"), cfg.CHANNELS).alias("mask"), "coalition_key", "value")


# ---- workload and joins ------------------------------------------------------


def _answer(query: workload.Query) -> Query:
    def run(spark, sf):
        answer = workload.run_query(lines(spark, sf), query)
        key = F.date_format(query.key_name, "yyyy-MM-dd") if query.kind == "date" else F.col(query.key_name)
        return answer.select(key.alias(query.key_name), r(query.value, 4).alias(query.value))

    return run


for _query in workload.star_workload():
    REGISTRY[_query.name] = _answer(_query)


def _texts() -> tuple[workload.SqlQuery, ...]:
    return (
        workload.SqlQuery(
            "status_by_region",
            "SELECT c.region, o.status, COUNT(*) AS n, AVG(o.discount) AS mean_discount FROM orders o"
            " JOIN customers c ON o.customer_id = c.customer_id GROUP BY c.region, o.status",
            ("region", "status"),
            ("n", "mean_discount"),
            ("customer_id", "region", "status", "discount"),
        ),
        workload.SqlQuery(
            "all_quantity",
            "WITH kept AS (SELECT * FROM orders WHERE status <> 'cancelled') SELECT SUM(quantity) AS quantity FROM kept",
            (),
            ("quantity",),
            ("status", "quantity"),
        ),
        workload.SqlQuery(
            "list_price",
            "SELECT p.category, MAX(p.base_price) AS top FROM orders o JOIN products p USING (product_id) GROUP BY p.category",
            ("category",),
            ("top",),
            ("product_id", "category", "base_price"),
        ),
    )


@register("workload_direct")
def workload_direct(spark, sf):
    answers = workload.long_answers(lines(spark, sf), _texts())
    return answers.select("query", "key", "measure", r("value").alias("value"))


def _damaged(spark, sf, names=cfg.CHANNELS) -> Star:
    chosen = [d for d in dfx.default_defects() if d.name in names]
    star = lines(spark, sf)
    (scenario,) = dfx.plan_scenarios(star, chosen, [cfg.SEVERITY], [0], cfg.MASTER)
    return dfx.damaged_star(star, chosen, scenario, cfg.MASTER)


@register("answer_alignment")
def answer_alignment(spark, sf):
    queries = {q.name: q for q in workload.star_workload()}
    q = queries["daily_revenue"]
    clean, hurt = workload.run_query(lines(spark, sf), q), workload.run_query(_damaged(spark, sf), q)
    return rounded(loss.align_answers(clean, hurt, [q.key_name], [q.value]), 4)


@register("answer_loss")
def answer_loss(spark, sf):
    queries = workload.star_workload()
    clean, hurt = workload.execute_workload(lines(spark, sf)), workload.execute_workload(_damaged(spark, sf))
    return rounded(loss.query_losses(clean, hurt, queries))


@register("answer_loss_global")
def answer_loss_global(spark, sf):
    totals = [F.expr(f"sum({workload.NET})").alias("revenue"), F.count("*").cast("double").alias("n")]
    clean = lines(spark, sf).orders.agg(*totals)
    hurt = _damaged(spark, sf).orders.agg(*totals)
    return rounded(loss.answer_loss(clean, hurt, [], ["revenue", "n"]))


@register("answer_loss_multi")
def answer_loss_multi(spark, sf):
    q = _texts()[0]
    return rounded(
        loss.answer_loss(
            workload.run_sql(lines(spark, sf), q), workload.run_sql(_damaged(spark, sf), q), q.keys, q.values
        )
    )


@register("workload_risk")
def workload_risk(spark, sf):
    policy = {"revenue_region": 3.0, "daily_revenue": 1.0}
    queries = workload.star_workload()
    clean, hurt = workload.execute_workload(lines(spark, sf)), workload.execute_workload(_damaged(spark, sf))
    one = loss.workload_risk(clean, hurt, queries, policy)
    told = one.select(r("loss").alias("risk"), F.explode("query_losses").alias("query", "loss"))
    return told.select("risk", "query", r("loss").alias("loss"))


@register("orphan_audit")
def orphan_audit(spark, sf):
    star = _damaged(spark, sf, ("orphan_foreign_keys",))
    lost = star.orders.join(star.customers, "customer_id", "left_anti")
    return lost.groupBy("status").agg(
        F.count("*").alias("orphans"), F.min("customer_id").alias("lowest"), F.max("customer_id").alias("highest")
    )


@register("drift_impact")
def drift_impact(spark, sf):
    star = lines(spark, sf)
    drift = [dfx.dimension_drift()]
    (scenario,) = dfx.plan_scenarios(star, drift, [cfg.SEVERITY], [0], cfg.MASTER)
    moved = dfx.struck(star.customers, {"hit": (scenario, drift[0])}, cfg.MASTER, dfx.KEYS).filter("hit")
    touched = star.orders.join(moved, "customer_id", "left_semi")
    return touched.agg(F.count("*").alias("impacted_orders"), F.count_distinct("customer_id").alias("customers_with_orders"))


# ---- row choices -------------------------------------------------------------


@register("dense_ids")
def dense_ids(spark, sf):
    table = read(spark, sf, "lineitem").select(*LINE_KEY).withColumn("_tie", F.monotonically_increasing_id())
    numbered = sampling.dense_ids(table, [*LINE_KEY, "_tie"], "order_id")
    return numbered.select("order_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("exact_sample")
def exact_sample(spark, sf):
    orders = lines(spark, sf).orders.select("order_id", "status")
    size = orders.count()
    return sampling.exact_sample(
        orders, "order_id", dice.seed_words("exact", cfg.SEED), sampling.affected(cfg.SEVERITY, size), size
    )


@register("sample_with_replacement")
def sample_with_replacement(spark, sf):
    orders = lines(spark, sf).orders.select("order_id")
    size = orders.count()
    return sampling.sample_with_replacement(orders, "order_id", ("again", cfg.SEED), size, size)


@register("hash_sample")
def hash_sample(spark, sf):
    events = read(spark, sf, "events").select("event_id", "user_id", "event_type")
    return sampling.hash_sample(events, "event_id", dice.seed_words("hash", cfg.SEED), cfg.HASH_SAMPLE)


# ---- defects on the star -----------------------------------------------------


def amount() -> Column:
    return r(F.expr("quantity * unit_price"), 4).alias("amount")


def _order_rows(star: Star) -> DataFrame:
    return star.orders.select("order_id", "customer_id", day(), amount(), "status")


def _channel(name: str) -> Query:
    def query(spark, sf):
        return _order_rows(_damaged(spark, sf, (name,)))

    return query


for _name in ("missing_measures", "value_noise", "stale_timestamps", "duplicate_facts"):
    REGISTRY[f"chan_{_name.replace('_timestamps', '_ts')}"] = _channel(_name)
REGISTRY["chan_orphan_fk"] = _channel("orphan_foreign_keys")


@register("chan_dimension_drift")
def chan_dimension_drift(spark, sf):
    return _damaged(spark, sf, ("dimension_drift",)).customers


@register("chan_all_composed")
def chan_all_composed(spark, sf):
    star = _damaged(spark, sf)
    joined = star.orders.join(star.customers, "customer_id", "left")
    return joined.select("order_id", "customer_id", "region", day(), amount(), "status")


@register("dup_facts")
def dup_facts(spark, sf):
    star = _damaged(spark, sf, ("duplicate_facts",))
    return star.orders.groupBy("order_id").agg(F.count("*").alias("copies")).filter("copies > 1")


@register("channel_diagnostics")
def channel_diagnostics(spark, sf):
    star, chosen = lines(spark, sf), dfx.default_defects()
    scenarios = dfx.plan_scenarios(star, chosen, [cfg.SEVERITY], range(cfg.REPEATS), cfg.MASTER)
    told = dfx.diagnostics(star, chosen, scenarios, cfg.MASTER)
    return rounded(told.fillna(0, ["impacted_orders", "linked_orders", "fact_amplification"]))


# ---- surfaces ----------------------------------------------------------------


@register("risk_surface")
def risk_surface_query(spark, sf):
    surface = risk_surface(
        lines(spark, sf),
        dfx.default_defects(),
        severities=(cfg.SEVERITY,),
        repeats=cfg.REPEATS,
        master_seed=cfg.MASTER,
    )
    return surface.losses.select("severity", "repeat", "query", "mask", r("loss").alias("loss"))


@register("direct_risk_surface")
def direct_risk_surface(spark, sf):
    """Losses of queries in plain SQL under every combination of defects."""
    surface = direct_surface(
        lines(spark, sf),
        dfx.default_defects(),
        severity=cfg.SEVERITY,
        repeats=cfg.REPEATS,
        master_seed=cfg.MASTER,
        workload=_texts(),
    )
    return rounded(surface.losses)


@register("risk_observations")
def risk_observations(spark, sf):
    surface = risk_surface(
        lines(spark, sf), dfx.default_defects(), severities=(cfg.SEVERITY,), repeats=cfg.REPEATS, master_seed=cfg.MASTER
    )
    drift = F.col("diagnostics")["dimension_drift"]["impacted_orders"]
    return surface.observations().select(
        "repeat",
        "coalition_key",
        "coalition_size",
        r("loss").alias("loss"),
        "orders",
        r(F.col("query_losses")["daily_revenue"]).alias("daily_loss"),
        F.coalesce(drift.cast("long"), F.lit(0)).alias("impacted_orders"),
    )


@register("coalition_means")
def coalition_means(spark, sf):
    means = game.mean_game(risks(spark, sf))
    return means.select(mask_key(F.col("mask"), cfg.CHANNELS).alias("coalition_key"), r("value").alias("value"))


@register("design_check")
def design_check(spark, sf):
    return game.design_problems(line_losses(spark, sf), cfg.CHANNELS, ["query"])


@register("evidence_checks")
def evidence_checks(spark, sf):
    status = F.col("query") == "orders_status"
    values = line_losses(spark, sf).agg(
        F.count("*").alias("cells"),
        F.max("loss").alias("largest_loss"),
        F.max(F.when(F.col("mask") == 0, F.col("loss"))).alias("clean_loss"),
        F.max(F.when(status & (F.col("mask") == 32), F.col("loss"))).alias("status_copies"),
        F.max(F.when(status & (F.col("mask") == 1), F.col("loss"))).alias("missing_on_status"),
    )
    return rounded(sinks.check_evidence(values, cfg.EVIDENCE))


@register("dose_response")
def dose_response(spark, sf):
    chosen = [d for d in dfx.default_defects() if d.name in cfg.DOSE_CHANNELS]
    told = studies.dose_response(
        lines(spark, sf),
        chosen,
        severities=cfg.DOSES,
        repeats=cfg.DOSE_REPEATS,
        master_seed=cfg.MASTER,
        bootstrap_samples=cfg.DRAWS,
        seed=cfg.SEED,
    )
    return rounded(told)


def _both(spark, sf) -> DataFrame:
    two = line_losses(spark, sf).filter(F.col("repeat") < cfg.EVENT_REPEATS).withColumn("regime", F.lit("lines"))
    return two.unionByName(event_losses(spark, sf).withColumn("regime", F.lit("events")))


def _both_risks(spark, sf) -> DataFrame:
    return loss.weighted_risk(_both(spark, sf), weights(), ["regime", "repeat", "mask"]).drop("query_losses")


@register("all_populations")
def all_populations(spark, sf):
    result = game.attribute_debt(
        _both_risks(spark, sf), cfg.CHANNELS, bootstrap_samples=cfg.DRAWS, seed=cfg.SEED, groups=["regime"]
    )
    return rounded(result.estimates)


@register("snapshot_study")
def snapshot_study(spark, sf):
    observed = _both_risks(spark, sf).filter("regime = 'events'")
    told = game.study_summary(
        observed, cfg.CHANNELS, bootstrap_samples=cfg.DRAWS, seed=cfg.SEED, groups=["regime"]
    )
    return rounded(told)


# ---- attribution -------------------------------------------------------------


@register("coalition_completeness")
def coalition_completeness(spark, sf):
    walk = permutations.prefixes(permutations.orders_of(spark, cfg.CHANNELS, 8, cfg.SEED, False))
    partial = risk_game(spark, sf).join(permutations.visited(walk), "mask", "left_semi")
    return game.coalition_gaps(partial, cfg.CHANNELS)


@register("marginal_contributions")
def marginal_contributions(spark, sf):
    return rounded(game.marginal_contributions(risk_game(spark, sf), cfg.CHANNELS).drop("idx"))


@register("shapley_exact")
def shapley_exact(spark, sf):
    return rounded(game.shapley_values(risk_game(spark, sf), cfg.CHANNELS).select("player", "debt"))


@register("banzhaf")
def banzhaf(spark, sf):
    return rounded(game.banzhaf_values(risk_game(spark, sf), cfg.CHANNELS).select("player", "banzhaf"))


@register("shapley_interactions")
def shapley_interactions(spark, sf):
    return rounded(game.shapley_interactions(risk_game(spark, sf), cfg.CHANNELS))


@register("singleton_gain")
def singleton_gain(spark, sf):
    return rounded(game.singletons_and_gains(risk_game(spark, sf), cfg.CHANNELS).drop("idx"))


@register("debt_accounting")
def debt_accounting(spark, sf):
    return rounded(game.debt_accounting(risk_game(spark, sf), cfg.CHANNELS))


@register("attribution")
def attribution(spark, sf):
    result = game.attribute_debt(risks(spark, sf), cfg.CHANNELS, bootstrap_samples=cfg.DRAWS, seed=cfg.SEED)
    return rounded(result.estimates)


@register("query_attribution")
def query_attribution(spark, sf):
    result = game.attribute_debt(
        line_losses(spark, sf), cfg.CHANNELS, bootstrap_samples=cfg.DRAWS, seed=cfg.SEED, groups=["query"]
    )
    return rounded(result.estimates)


@register("repair_decision")
def repair_decision(spark, sf):
    return rounded(game.repair_decisions(risk_game(spark, sf), cfg.CHANNELS))


@register("study_summary")
def study_summary(spark, sf):
    return rounded(game.study_summary(risks(spark, sf), cfg.CHANNELS, bootstrap_samples=cfg.DRAWS, seed=cfg.SEED))


@register("accounting_vs_gain")
def accounting_vs_gain(spark, sf):
    return rounded(game.accounting_and_gain(_both_risks(spark, sf), cfg.CHANNELS, ["regime"]))


# ---- bootstrap ---------------------------------------------------------------


@register("bootstrap_draws")
def bootstrap_draws(spark, sf):
    """Each draw's game: the drawn repeats' losses of every combination, averaged."""
    slots = bootstrap.draw_slots(spark, list(range(cfg.REPEATS)), cfg.DRAWS, cfg.SEED)
    drawn = slots.join(risks(spark, sf), "repeat").groupBy("draw", "mask")
    return rounded(drawn.agg(F.count("*").alias("slots"), F.min("repeat").alias("first_repeat"), F.max("repeat").alias("last_repeat"), F.avg("loss").alias("value")))


def _boot(spark, sf) -> DataFrame:
    effects = game.per_repeat_effects(risks(spark, sf), cfg.CHANNELS)
    return game.bootstrap_effects(effects, [], list(range(cfg.REPEATS)), cfg.DRAWS, cfg.SEED)


@register("bootstrap_shapley")
def bootstrap_shapley(spark, sf):
    return rounded(_boot(spark, sf).select("draw", "player", "debt", "gain"))


@register("bootstrap_intervals")
def bootstrap_intervals(spark, sf):
    told = game.interval_table(_boot(spark, sf), [], 0.95)
    return rounded(told.select("player", "ci_low", "ci_high", "gain_ci_low", "gain_ci_high"))


@register("rank_probability")
def rank_probability(spark, sf):
    told = game.interval_table(_boot(spark, sf), [], 0.95)
    return rounded(told.select("player", "probability_harmful", "rank_1_probability"))


@register("paired_ablation")
def paired_ablation(spark, sf):
    told = bootstrap.paired_ablation(risks(spark, sf), cfg.CHANNELS, samples=cfg.DRAWS, seed=cfg.SEED)
    return told.select(
        "channel", r("paired_width").alias("paired_width"), r("unpaired_width").alias("unpaired_width"),
        r("paired_unpaired_ratio", 4).alias("paired_unpaired_ratio"),
    )


@register("paired_ratio_summary")
def paired_ratio_summary(spark, sf):
    told = bootstrap.paired_ablation(risks(spark, sf), cfg.CHANNELS, samples=cfg.DRAWS, seed=cfg.SEED)
    return rounded(bootstrap.ratio_summary(told), 4)


# ---- permutation sampling ----------------------------------------------------


def _walk(spark, antithetic: bool = False) -> DataFrame:
    return permutations.prefixes(permutations.orders_of(spark, cfg.CHANNELS, cfg.ORDERS, cfg.SEED, antithetic))


def _named_game(spark, sf) -> Callable[[DataFrame], DataFrame]:
    """The mean game on given combinations, from a surface that evaluates no other."""

    def value(masks: DataFrame) -> DataFrame:
        surface = risk_surface(
            lines(spark, sf), dfx.default_defects(), severities=(cfg.SEVERITY,), repeats=cfg.REPEATS, master_seed=cfg.MASTER, masks=masks
        )
        return game.mean_game(surface.risks().select("repeat", "mask", "loss"))

    return value


def _ordered_values(spark, sf, antithetic: bool) -> DataFrame:
    """Each order's path through the game: the value that every player completes."""
    walk = stored(_walk(spark, antithetic), "walk")
    reached = walk.join(_named_game(spark, sf)(permutations.visited(walk)), "mask")
    return reached.select("draw", "position", "player", r("value").alias("value"))


@register("permutation_orders")
def permutation_orders(spark, sf):
    return _ordered_values(spark, sf, False)


@register("antithetic_orders")
def antithetic_orders(spark, sf):
    return _ordered_values(spark, sf, True)


@register("permutation_prefixes")
def permutation_prefixes(spark, sf):
    walk = _walk(spark).join(risk_game(spark, sf), "mask")
    return walk.select("draw", "position", "player", "mask", "before", r("value").alias("value"))


@register("permutation_marginals")
def permutation_marginals(spark, sf):
    told = permutations.marginals(_walk(spark), risk_game(spark, sf))
    return told.select("draw", "position", "player", r("contribution").alias("contribution"))


@register("prefix_coalitions")
def prefix_coalitions(spark, sf):
    """The surface, restricted to the coalitions that eight random orders pass."""
    walk = permutations.prefixes(permutations.orders_of(spark, cfg.CHANNELS, 8, cfg.SEED, False))
    surface = risk_surface(
        lines(spark, sf),
        dfx.default_defects(),
        severities=(cfg.SEVERITY,),
        repeats=cfg.REPEATS,
        master_seed=cfg.MASTER,
        masks=permutations.visited(walk),
    )
    return surface.risks().select("repeat", "mask", r("loss").alias("loss"))


def _sampled(spark, sf, antithetic: bool) -> permutations.Sampled:
    return permutations.permutation_shapley(
        spark, _named_game(spark, sf), cfg.CHANNELS, permutations=cfg.ORDERS, seed=cfg.SEED, antithetic=antithetic
    )


@register("permutation_shapley")
def permutation_shapley(spark, sf):
    told = _sampled(spark, sf, False)
    return rounded(told.values.select("player", "value", "standard_error", F.lit(told.radius).alias("hoeffding_radius")))


@register("antithetic_shapley")
def antithetic_shapley(spark, sf):
    told = _sampled(spark, sf, True)
    return rounded(told.values.select("player", "value", "standard_error", F.lit(told.radius).alias("hoeffding_radius")))


@register("permutation_coverage")
def permutation_coverage(spark, sf):
    """Coverage of the surface by the sampled orders, with the share of the total risk seen."""
    told = _sampled(spark, sf, False)
    seen = told.game.agg(F.sum("value").alias("seen_value"))
    return rounded(game.side_by_side([told.summary.drop("hoeffding_radius", "antithetic"), seen]))


def wide_defects() -> tuple[dfx.Defect, ...]:
    """Twelve defects: too many for all combinations, so that only sampled ones are evaluated."""
    more = (
        replace(dfx.value_noise(0.25), name="mild_noise", priority=21),
        dfx.OrderDefect("cut_prices", 60, ("unit_price",), lambda row, rolls: {"unit_price": F.floor(row["unit_price"]).cast("double")}),
        dfx.OrderDefect("lost_discounts", 61, ("discount",), lambda row, rolls: {"discount": F.lit(0.0)}),
        dfx.OrderDefect("unit_mixup", 62, ("quantity",), lambda row, rolls: {"quantity": row["quantity"] * 10.0}),
        dfx.OrderDefect("wrong_refunds", 63, ("status",), lambda row, rolls: {"status": F.lit("refunded")}),
        replace(dfx.stale_timestamps(7), name="late_week", priority=64),
    )
    return (*dfx.default_defects(), *more)


def _wide_losses(spark, sf) -> DataFrame:
    """(repeat, query, mask, loss) of the combinations that a few random orders of twelve defects pass."""

    def build() -> DataFrame:
        orders = permutations.orders_of(spark, cfg.WIDE_CHANNELS, cfg.WIDE_ORDERS, cfg.SEED, False)
        surface = risk_surface(
            lines(spark, sf),
            wide_defects(),
            severities=(cfg.SEVERITY,),
            repeats=cfg.REPEATS,
            master_seed=cfg.MASTER,
            masks=permutations.visited(permutations.prefixes(orders)),
        )
        return surface.losses.select("repeat", "query", "mask", "loss")

    return stored_once(spark, ("wide-losses", sf), build)


@register("wide_surface")
def wide_surface(spark, sf):
    return rounded(_wide_losses(spark, sf))


@register("wide_shapley")
def wide_shapley(spark, sf):
    """Sampled values of twelve defects; the workload runs on the combinations that the orders pass."""

    def value(masks: DataFrame) -> DataFrame:
        told = loss.weighted_risk(_wide_losses(spark, sf), weights(), ["repeat", "mask"])
        return game.mean_game(told.select("repeat", "mask", "loss")).join(masks, "mask", "left_semi")

    told = permutations.permutation_shapley(spark, value, cfg.WIDE_CHANNELS, permutations=cfg.WIDE_ORDERS, seed=cfg.SEED)
    return rounded(told.values.select("player", "value", "standard_error", F.lit(told.radius).alias("hoeffding_radius")))


def _trials(spark, sf) -> DataFrame:
    table = stored(risk_game(spark, sf), "risk-game")
    exact = game.shapley_values(table, cfg.CHANNELS)
    return permutations.convergence_trials(
        table, exact, cfg.CHANNELS, budgets=cfg.BUDGETS, trials=cfg.TRIALS, seed=cfg.SEED
    )


@register("convergence_trials")
def convergence_trials(spark, sf):
    return rounded(_trials(spark, sf))


@register("convergence_summary")
def convergence_summary(spark, sf):
    return rounded(permutations.convergence_summary(_trials(spark, sf)))


# ---- feature tables and models -----------------------------------------------


def prices(spark: SparkSession, sf: str) -> ffx.Features:
    rows = kept_once(spark, ("price-features", sf), lambda: features.price_regression(spark, sf).rows)
    return ffx.Features(rows, tuple(c for c in rows.columns if c not in ("row_id", "label")), "regression")


def _hurt(table: ffx.Features, *chosen) -> ffx.Features:
    return ffx.damage_features(table, chosen, severity=cfg.MODEL_SEVERITY, master_seed=cfg.MODEL_MASTER)[0]


@register("price_features")
def price_features(spark, sf):
    return rounded(features.price_regression(spark, sf).rows)


@register("document_features")
def document_features(spark, sf):
    return rounded(features.document_quality(spark, sf).rows)


@register("ml_missing_cells")
def ml_missing_cells(spark, sf):
    return rounded(_hurt(prices(spark, sf), ffx.MissingCells()).rows)


@register("ml_feature_noise")
def ml_feature_noise(spark, sf):
    return rounded(_hurt(prices(spark, sf), ffx.FeatureNoise()).rows, 4)


@register("ml_target_noise")
def ml_target_noise(spark, sf):
    return rounded(_hurt(prices(spark, sf), ffx.TargetNoise()).rows.select("row_id", "label"), 4)


@register("ml_target_flip")
def ml_target_flip(spark, sf):
    table = features.embedding_classes(spark, sf)
    return _hurt(table, ffx.TargetNoise()).rows.select("row_id", "label")


@register("ml_duplicate_rows")
def ml_duplicate_rows(spark, sf):
    return rounded(_hurt(prices(spark, sf), ffx.DuplicateRows()).rows.select("row_id", "quantity", "label"))


@register("ml_all_composed")
def ml_all_composed(spark, sf):
    return rounded(_hurt(prices(spark, sf), *ffx.default_feature_defects()).rows, 4)


@dataclass(frozen=True)
class CutCells:
    """A defect of one's own: hit rows lose the fractions of their features."""

    name: str = "cut_cells"
    priority: int = 15

    def apply(self, table: ffx.Features, dice_: ffx.Dice) -> tuple[ffx.Features, dict]:
        hit = dice_.hit_rows(table, self.name)
        cut = {c: F.when(F.col("_hit"), F.floor(c).cast("double")).otherwise(F.col(c)) for c in table.columns}
        return table.with_rows(hit.select(*[cut[c].alias(c) if c in cut else F.col(c) for c in table.rows.columns])), {}


@register("ml_own_defect")
def ml_own_defect(spark, sf):
    return rounded(_hurt(prices(spark, sf), CutCells(), ffx.MissingCells()).rows)


@register("split_random")
def split_random(spark, sf):
    return models.splits(prices(spark, sf), cfg.SPLITS, cfg.TEST_SIZE, cfg.MODEL_MASTER).all()


@register("split_stratified")
def split_stratified(spark, sf):
    table = features.document_quality(spark, sf)
    return models.splits(table, cfg.SPLITS, cfg.TEST_SIZE, cfg.MODEL_MASTER).all()


@register("impute_scale")
def impute_scale(spark, sf):
    table = _hurt(prices(spark, sf), ffx.MissingCells())
    prepared = models.learn_preparation(table.rows, table.columns).apply(table.rows)
    return rounded(prepared.drop("label"))


@register("loss_classification")
def loss_classification(spark, sf):
    told = read(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return rounded(loss.prediction_loss(told, "classification"))


@register("loss_regression")
def loss_regression(spark, sf):
    told = prices(spark, sf).rows.select("label", F.expr("quantity * retail_price").alias("prediction"))
    return rounded(loss.prediction_loss(told, "regression"))


def _fitted(table: ffx.Features, model: str) -> DataFrame:
    """Predictions of a model trained on damaged rows, for the clean rows."""
    hurt = _hurt(table, *ffx.default_feature_defects())
    fitted = models.fit(hurt, models.model_factory(table.task, model), cfg.MODEL_MASTER)
    return loss.prediction_loss(fitted.predict(table.rows), table.task).select(F.lit(model).alias("model"), "loss")


@register("ml_fit_ridge")
def ml_fit_ridge(spark, sf):
    return rounded(_fitted(prices(spark, sf), "ridge"))


@register("ml_ridge_surface")
def ml_ridge_surface(spark, sf):
    """Losses of a ridge regression under every combination of the feature defects, from one table of moments."""
    study = models.model_surface(
        prices(spark, sf),
        ffx.default_feature_defects(),
        models.model_factory("regression", "ridge"),
        severity=cfg.MODEL_SEVERITY,
        repeats=cfg.REPEATS,
        master_seed=cfg.MODEL_MASTER,
    )
    return rounded(study.observations.select("repeat", "mask", "coalition_key", "coalition_size", "loss", "train_rows"))


@register("ml_fit_logistic")
def ml_fit_logistic(spark, sf):
    return _fitted(features.document_quality(spark, sf), "logistic")


@register("ml_fit_forest")
def ml_fit_forest(spark, sf):
    return _fitted(features.document_quality(spark, sf), "forest")


def _model_observations(spark, sf) -> DataFrame:
    def build() -> DataFrame:
        study = models.model_surface(
            features.document_quality(spark, sf),
            ffx.default_feature_defects(),
            models.model_factory("classification", "logistic"),
            severity=cfg.MODEL_SEVERITY,
            repeats=cfg.REPEATS,
            master_seed=cfg.MODEL_MASTER,
        )
        return study.observations

    return stored_once(spark, ("model-observations", sf), build)


@register("ml_risk_surface")
def ml_risk_surface(spark, sf):
    return _model_observations(spark, sf).select(
        "repeat", "mask", "coalition_key", "coalition_size", "loss", "train_rows"
    )


@register("audit_report")
def audit_report(spark, sf):
    """The estimates of the audit of a CSV file of price features, from the file to the report."""
    folder = f"{shared_folder(spark)}/tarnish/audit-{uuid4().hex}"
    prices(spark, sf).rows.drop("row_id").write.csv(f"{folder}/data", header=True)
    report = studies.audit_csv(
        spark,
        f"{folder}/data",
        "label",
        "regression",
        f"{folder}/report",
        model="ridge",
        severity=cfg.MODEL_SEVERITY,
        repeats=cfg.REPEATS,
        test_size=cfg.TEST_SIZE,
        bootstrap_samples=cfg.DRAWS,
        seed=cfg.MODEL_MASTER,
        bootstrap_seed=cfg.SEED,
    )
    told = spark.read.text(f"{folder}/report", wholetext=True).selectExpr(f"from_json(value, 'attributions array<struct<{', '.join(f'{c}: {k}' for c, k in ESTIMATES)}>>').attributions AS a")
    # a report holds one entry for each defect
    assert len(report["attributions"]) == len(ffx.default_feature_defects())
    return rounded(told.select(F.inline("a")))


@register("model_dose_response")
def model_dose_response(spark, sf):
    """Attribution of a ridge regression's loss at several severities."""
    told = studies.model_dose_response(
        prices(spark, sf),
        models.model_factory("regression", "ridge"),
        severities=cfg.DOSES,
        repeats=cfg.DOSE_REPEATS,
        master_seed=cfg.MODEL_MASTER,
        bootstrap_samples=cfg.DRAWS,
        seed=cfg.SEED,
    )
    return rounded(told)


@register("ml_study")
def ml_study(spark, sf):
    """Two datasets with a linear model each, all defects: attributions, with each setting's total and ablation."""
    tables = {"prices": prices(spark, sf), "documents": features.document_quality(spark, sf)}
    chosen = {
        "regression": {"ridge": models.model_factory("regression", "ridge")},
        "classification": {"logistic": models.model_factory("classification", "logistic")},
    }
    told = studies.model_study(
        tables, chosen, severity=cfg.MODEL_SEVERITY, repeats=cfg.REPEATS, master_seed=cfg.MODEL_MASTER, bootstrap_samples=cfg.DRAWS, seed=cfg.SEED
    )
    summary = told["summary"].select("setting", "total_debt", "top_channel", "max_abs_interaction", "median_paired_unpaired_width_ratio")
    return rounded(told["attributions"].join(summary, "setting"))
