import pytest
from pyspark.sql import functions as F

from tarnish.operators import defects as dfx
from tarnish.operators import loss
from tarnish.operators.game import attribute_debt
from tarnish.plans import surface as sf
from tarnish.plans import workload
from tarnish.session import stored
from tarnish.sources.generator import generate_star


@pytest.fixture(scope="module")
def star(spark):
    made = generate_star(spark, 1_000, regime="skewed", seed=12)
    return made.with_tables(
        orders=stored(made.orders, "o"), customers=stored(made.customers, "c"), products=stored(made.products, "p")
    )


def losses(surface):
    return {(r.repeat, r.query, r.mask): r.loss for r in surface.losses.collect()}


def worst(fast, slow):
    a, b = losses(fast), losses(slow)
    assert set(a) == set(b)
    return max(abs(a[k] - b[k]) for k in a)


def test_generator_is_repeatable_and_linked(spark, star):
    again = generate_star(spark, 1_000, regime="skewed", seed=12)
    assert again.orders.exceptAll(star.orders).count() == 0
    assert star.orders.join(star.customers, "customer_id", "left_anti").count() == 0
    assert star.orders.join(star.products, "product_id", "left_anti").count() == 0
    top = star.orders.groupBy("customer_id").count().agg(F.max("count")).first()[0]
    assert top > 100  # the first rank of a skewed population holds a good part of the orders
    for bad in ({"n_orders": 999}, {"regime": "odd"}):
        with pytest.raises(ValueError):
            generate_star(spark, **{"n_orders": 1_000, **bad})


def test_exact_counts_of_orphans_and_copies(star):
    hurt, told = dfx.corrupt(
        star, [dfx.duplicate_facts(), dfx.orphan_foreign_keys()], severity=0.1, master_seed=7
    )
    assert hurt.orders.count() == 1_100
    assert hurt.orders.filter("customer_id < 0").select("order_id").distinct().count() == 100
    assert {r.channel: r.affected for r in told.collect()} == {"duplicate_facts": 100, "orphan_foreign_keys": 100}


def test_hits_do_not_depend_on_other_defects(star):
    def missing(chosen):
        hurt, _ = dfx.corrupt(star, chosen, severity=0.2, master_seed=19, repeat=2)
        return {r.order_id for r in hurt.orders.filter("unit_price IS NULL").select("order_id").distinct().collect()}

    alone = missing([dfx.missing_measures()])
    assert len(alone) == 200
    assert alone == missing(list(dfx.default_defects()))


def test_hits_of_two_defects_and_two_repeats_are_unrelated(star):
    def hits(defect, repeat):
        (scenario,) = dfx.plan_scenarios(star, [defect], [0.5], [repeat], 3)
        rows = dfx.struck(star.orders, {"hit": (scenario, defect)}, 3, dfx.KEYS).filter("hit")
        return {r.order_id for r in rows.select("order_id").collect()}

    a, b, c = hits(dfx.missing_measures(), 0), hits(dfx.missing_measures(), 1), hits(dfx.value_noise(), 0)
    for x, y in ((a, b), (a, c)):
        assert 190 < len(x & y) < 310


def test_names_must_be_unique(star):
    with pytest.raises(ValueError):
        dfx.corrupt(star, [dfx.value_noise(), dfx.value_noise()], severity=0.1, master_seed=1)


def test_one_pass_equals_damaging_and_running(star):
    chosen = [dfx.missing_measures(), dfx.orphan_foreign_keys(), dfx.dimension_drift(), dfx.duplicate_facts()]
    fast = sf.risk_surface(star, chosen, severities=[0.2], repeats=[4], master_seed=22)
    slow = sf.direct_surface(star, chosen, severity=0.2, repeats=[4], master_seed=22, masks=[0, 5, 10, 15])
    wanted = {k: v for k, v in losses(fast).items() if k[2] in (0, 5, 10, 15)}
    got = losses(slow)
    assert set(wanted) == set(got)
    assert max(abs(wanted[k] - got[k]) for k in got) < 1e-12
    assert all(v == 0 for k, v in wanted.items() if k[2] == 0)


def test_surface_is_complete_bounded_and_allocates(star):
    chosen = [dfx.missing_measures(), dfx.orphan_foreign_keys()]
    made = sf.risk_surface(star, chosen, severities=[0.1], repeats=2, master_seed=22)
    seen = made.observations()
    rows = seen.collect()
    assert len(rows) == 8
    assert all(0 <= r.loss <= 1 for r in rows)
    assert {r.coalition_key for r in rows} == {
        "EMPTY", "missing_measures", "orphan_foreign_keys", "missing_measures|orphan_foreign_keys"
    }
    full = next(r for r in rows if r.coalition_size == 2)
    assert set(full.diagnostics) == {"missing_measures", "orphan_foreign_keys"} and full.orders == 1000
    assert full.diagnostics["missing_measures"]["affected"] == "100"
    result = attribute_debt(made.risks(), made.channels, bootstrap_samples=100, seed=1)
    assert abs(result.accounting.first().efficiency_residual) < 1e-12


def test_structural_zeros(star):
    made = sf.risk_surface(star, dfx.default_defects(), severities=[0.1], repeats=1, master_seed=5)
    alone = {(r.query, r.mask): r.loss for r in made.losses.filter(F.bit_count("mask") == 1).collect()}
    bit = {name: 1 << i for i, name in enumerate(made.channels)}
    deaf = {
        "orders_status": set(bit) - {"duplicate_facts"},
        "customers_region": {"missing_measures", "value_noise", "stale_timestamps", "duplicate_facts"},
        "revenue_category": {"orphan_foreign_keys", "stale_timestamps", "dimension_drift"},
        "refund_region": {"missing_measures", "value_noise", "stale_timestamps"},
        "revenue_month": {"orphan_foreign_keys", "dimension_drift"},
        "daily_revenue": {"orphan_foreign_keys", "dimension_drift"},
        "revenue_region": {"stale_timestamps"},
        "aov_segment": {"stale_timestamps", "dimension_drift"},
    }
    for query, names in deaf.items():
        for name, b in bit.items():
            assert (alone[query, b] == 0) == (name in names), (query, name)
    assert alone["orders_status", bit["duplicate_facts"]] == pytest.approx(0.1)


def test_own_defects_and_queries(star):
    """A rewritten measure, a rewritten filter column and a composed key, against the direct surface."""
    halved = dfx.OrderDefect("halved", 15, ("discount",), lambda row, rolls: {"discount": row["discount"] / 2})
    # looks at a column that another defect writes
    bulk = dfx.OrderDefect(
        "bulk", 36, ("quantity",), lambda row, rolls: {"quantity": F.when(row["status"] == "completed", 9.0).otherwise(row["quantity"])}, reads=("status",)
    )
    relabel = dfx.OrderDefect("relabel", 35, ("status",), lambda row, rolls: {"status": F.lit("completed")})
    queries = (
        workload.Query("by_product", "product_id % 3", "rest", "sum", "units", "quantity * (1 - discount)"),
        workload.Query("done", "segment", "segment", "avg", "value", "quantity", "status = 'completed'", ("customers",)),
        workload.Query("years", "trunc(order_date, 'YEAR')", "year", "count", "n", kind="date"),
    )
    chosen = [halved, relabel, bulk, dfx.stale_timestamps(400), dfx.duplicate_facts()]
    fast = sf.risk_surface(star, chosen, severities=[0.3], repeats=1, master_seed=2, workload=queries)
    slow = sf.direct_surface(star, chosen, severity=0.3, repeats=1, master_seed=2, workload=queries, masks=[0, 2, 6, 13, 20, 31])
    got, want = losses(fast), losses(slow)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert any(v > 0 for v in want.values())


def test_many_defects_use_the_narrow_plan(star, monkeypatch):
    chosen = [dfx.missing_measures(), dfx.value_noise(), dfx.stale_timestamps(), dfx.duplicate_facts()]
    wide = sf.risk_surface(star, chosen, severities=[0.3], repeats=1, master_seed=2)
    expected = losses(wide)
    monkeypatch.setattr(sf, "PLAN_ROW_LIMIT", 10)
    narrow = sf.risk_surface(star, chosen, severities=[0.3], repeats=1, master_seed=2)
    assert losses(narrow) == pytest.approx(expected, abs=1e-12)


def test_a_row_adds_a_part_of_its_hits_at_most_once(spark, star, monkeypatch):
    chosen = [dfx.missing_measures(), dfx.value_noise(), dfx.orphan_foreign_keys(), dfx.dimension_drift(), dfx.duplicate_facts()]
    queries = list(enumerate(q for q in workload.star_workload() if q.aggregate != "distinct"))
    plan = sf._hit_plan(spark, chosen, queries, {i: 0 for i, _ in queries})
    full = plan.where(f"h = {(1 << len(chosen)) - 1}")
    # 2 ** k contributions of a row that k defects hit, not 3 ** k
    assert full.count() == sum(2 ** sf.relevant_mask(chosen, q).bit_count() for _, q in queries)
    seen = []
    inner = sf._sum_cells
    monkeypatch.setattr(sf, "_sum_cells", lambda *args: seen.append(inner(*args)) or seen[-1])
    pairs = losses(sf.risk_surface(star, chosen, severities=[0.3], repeats=2, master_seed=4))
    assert "u" in seen[0].columns
    monkeypatch.setattr(sf, "_pair_rows", lambda *_: sf.PLAN_ROW_LIMIT + 1)
    signed = losses(sf.risk_surface(star, chosen, severities=[0.3], repeats=2, master_seed=4))
    assert "u" not in seen[1].columns
    assert pairs == pytest.approx(signed, abs=1e-12)


def test_distinct_counts_under_two_cutters(star):
    def cutter(name, priority):
        return dfx.OrderDefect(
            name, priority, ("customer_id",), lambda row, rolls: {"customer_id": -(row["order_id"] + 1)}, unlinks="customers"
        )

    chosen = [cutter("lost_a", 30), dfx.dimension_drift(), cutter("lost_b", 31)]
    queries = [q for q in workload.star_workload() if q.name in ("customers_region", "refund_region")]
    fast = sf.risk_surface(star, chosen, severities=[0.4], repeats=2, master_seed=8, workload=queries)
    slow = sf.direct_surface(star, chosen, severity=0.4, repeats=2, master_seed=8, workload=queries)
    assert worst(fast, slow) < 1e-12


def test_unrewritable_settings_are_named(star):
    relink = dfx.OrderDefect("relink", 30, ("customer_id",), lambda row, rolls: {"customer_id": F.lit(1).cast("long")})
    with pytest.raises(ValueError, match="direct surface"):
        sf.risk_surface(star, [relink], repeats=1)
    text = workload.SqlQuery("n", "SELECT COUNT(*) AS n FROM orders", (), ("n",))
    with pytest.raises(ValueError, match="direct surface"):
        sf.risk_surface(star, [dfx.value_noise()], repeats=1, workload=[text])
    made = sf.direct_surface(star, [dfx.duplicate_facts()], severity=0.1, workload=[text])
    assert losses(made)[0, "n", 1] == pytest.approx(0.1)
    for bad in ({"repeats": 0}, {"severities": [1.5]}):
        with pytest.raises(ValueError):
            sf.risk_surface(star, [dfx.value_noise()], **{"repeats": 1, **bad})
    eleven = [dfx.OrderDefect(f"d{i}", i, ("quantity",), lambda row, rolls: {"quantity": F.lit(1.0)}) for i in range(11)]
    with pytest.raises(ValueError, match="beyond"):
        sf.risk_surface(star, eleven, repeats=1)


def test_clean_answers_have_no_loss(star):
    queries = workload.star_workload()
    answers = workload.execute_workload(star, queries)
    assert loss.workload_risk(answers, answers, queries).first().loss == 0.0


def test_answer_loss_counts_missing_groups(spark):
    clean = spark.createDataFrame([("a", 4.0), ("b", 4.0), (None, 2.0)], "k string, v double")
    seen = spark.createDataFrame([("a", 4.0), ("c", 1.0), (None, 2.0)], "k string, v double")
    assert loss.answer_loss(clean, seen, ["k"], ["v"]).first().loss == pytest.approx(0.5)
    empty = loss.answer_loss(clean, seen.filter("false"), ["k"], ["v"]).first().loss
    assert empty == pytest.approx(1.0)


def test_query_weights():
    names = [q.name for q in workload.star_workload()]
    assert set(workload.query_weights(names).values()) == {1 / 8}
    own = workload.query_weights(names, {"revenue_region": 3, "daily_revenue": 1})
    assert own["revenue_region"] == 0.75 and own["aov_segment"] == 0.0
    for bad in ({"unknown": 1.0}, {"revenue_region": -1.0}, {"revenue_region": 0.0}):
        with pytest.raises(ValueError):
            workload.query_weights(names, bad)


def test_one_customer_with_a_third_of_the_orders(spark, star):
    """A hot key changes nothing in the results, and no task sees all of its rows."""
    hot = star.with_tables(
        orders=star.orders.withColumn("customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(5)).otherwise(F.col("customer_id")))
    )
    chosen = [dfx.orphan_foreign_keys(), dfx.dimension_drift()]
    queries = [q for q in workload.star_workload() if "customers" in q.joins]
    fast = sf.risk_surface(hot, chosen, severities=[0.3], repeats=1, master_seed=8, workload=queries)
    slow = sf.direct_surface(hot, chosen, severity=0.3, repeats=1, master_seed=8, workload=queries)
    assert worst(fast, slow) < 1e-12


def test_next_region_is_cyclic(star):
    cycle = {r.region: r.next_region for r in dfx.next_regions(star.customers).collect()}
    assert cycle == {"central": "east", "east": "north", "north": "south", "south": "west", "west": "central"}


def test_next_region_of_a_long_catalogue(spark):
    names = [f"r{i:03d}" for i in range(100)]
    customers = spark.createDataFrame([(i, names[i % 100]) for i in range(300)], "customer_id long, region string")
    cycle = {r.region: r.next_region for r in dfx.next_regions(customers).collect()}
    assert cycle == {a: names[(i + 1) % 100] for i, a in enumerate(names)}


def test_named_masks_of_many_defects(spark, star):
    """Twelve defects are too many for all combinations, not for some; the other way gives the same losses."""
    chosen = [dfx.missing_measures(), dfx.value_noise(), dfx.stale_timestamps(), dfx.dimension_drift(), dfx.duplicate_facts(), dfx.orphan_foreign_keys()]
    more = [dfx.OrderDefect(f"d{i}", 60 + i, ("discount",), lambda row, rolls: {"discount": row["discount"] * 0.5}) for i in range(6)]
    masks = [0, 1, 0b100000000001, 0b111111111111]
    named = spark.createDataFrame([(m,) for m in masks], "mask long")
    queries = [q for q in workload.star_workload() if q.aggregate == "count"]
    fast = sf.risk_surface(star, [*chosen, *more], severities=[0.2], repeats=1, master_seed=5, workload=queries, masks=named)
    slow = sf.direct_surface(star, [*chosen, *more], severity=0.2, repeats=1, master_seed=5, workload=queries, masks=masks)
    assert fast.losses.count() == len(masks)
    assert worst(fast, slow) < 1e-12
