"""Surfaces of named combinations, direct surfaces of SQL texts, ridge surfaces from moments, against plainer ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnish.operators import defects as dfx
from tarnish.operators import feature_defects as ffx
from tarnish.operators.quantiles import exact_quantiles
from tarnish.plans import logistic, marked, models, workload
from tarnish.plans import surface as sf
from tarnish.session import stored
from tarnish.sources.generator import generate_star


@pytest.fixture(scope="module")
def star(spark):
    made = generate_star(spark, 1_000, regime="skewed", seed=12)
    return made.with_tables(
        orders=stored(made.orders, "o"), customers=stored(made.customers, "c"), products=stored(made.products, "p")
    )


def losses(surface):
    return {(r.severity, r.repeat, r.query, r.mask): r.loss for r in surface.losses.collect()}


def table_of(spark, masks):
    return spark.createDataFrame([(m,) for m in masks], "mask long")


def test_named_combinations_have_the_losses_of_the_whole_surface(spark, star):
    masks = [0, 3, 5, 20, 37, 63, 63]
    settings = {"severities": [0.1, 0.4], "repeats": 2, "master_seed": 3}
    whole = losses(sf.risk_surface(star, dfx.default_defects(), **settings))
    named = losses(sf.risk_surface(star, dfx.default_defects(), masks=table_of(spark, masks), **settings))
    assert set(named) == {k for k in whole if k[3] in masks}
    assert all(named[k] == pytest.approx(whole[k], abs=1e-12) for k in named)


def test_only_what_is_named_is_evaluated(spark, star, monkeypatch):
    """Answers are summed up for the parts of the named combinations, and no cell is damaged in another way."""
    chosen, masks = dfx.default_defects(), [0, 3, 24]
    evaluated = {}
    inner = sf._sum_losses

    def watched(cells, defects, queries, n, seen=None):
        out = inner(cells, defects, queries, n, seen)
        evaluated["cells"] = {(r.q, r.t, r.u) for r in cells.select("q", "t", "u").distinct().collect()}
        evaluated["parts"] = {(r.q, r.s_mask) for r in out.select("q", "s_mask").distinct().collect()}
        return out

    monkeypatch.setattr(sf, "_sum_losses", watched)
    sf.risk_surface(star, chosen, severities=[0.3], repeats=1, master_seed=3, masks=table_of(spark, masks)).losses.count()
    queries = dict(enumerate(workload.star_workload()))
    of = {i: {m & sf.relevant_mask(chosen, q) for m in masks} for i, q in queries.items() if q.aggregate != "distinct"}
    assert evaluated["parts"] == {(i, part) for i, parts in of.items() for part in parts}
    assert all(u == 0 or any(u == part & t for part in of[q]) for q, t, u in evaluated["cells"])


def test_twelve_defects_against_damaging_and_running(spark, star):
    more = [dfx.OrderDefect(f"d{i}", 60 + i, ("discount",), lambda row, rolls, i=i: {"discount": row["discount"] * (0.3 + 0.1 * i)}) for i in range(6)]
    chosen = [*dfx.default_defects(), *more]
    masks = [0, 1, 0b100001010110, 0b111111000000, 0b111111111111]
    fast = losses(sf.risk_surface(star, chosen, severities=[0.2], repeats=1, master_seed=5, masks=table_of(spark, masks)))
    slow = losses(sf.direct_surface(star, chosen, severity=0.2, repeats=1, master_seed=5, masks=masks))
    assert set(fast) == set(slow)
    assert all(fast[k] == pytest.approx(slow[k], abs=1e-12) for k in fast)


TEXTS = (
    workload.SqlQuery(
        "top_orders",
        "SELECT region, COUNT(*) AS n, MAX(quantity * unit_price) AS top FROM (SELECT o.*, c.region, ROW_NUMBER() OVER"
        " (PARTITION BY c.region ORDER BY o.order_id) AS place FROM orders o JOIN customers c USING (customer_id)) WHERE place <= 200 GROUP BY region",
        ("region",),
        ("n", "top"),
        ("customer_id", "region", "quantity", "unit_price", "order_id"),
    ),
    workload.SqlQuery("plain", "SELECT status, SUM(quantity) AS units FROM orders GROUP BY status", ("status",), ("units",), ("status", "quantity")),
)


def test_direct_surface_runs_alike_combinations_once(star, monkeypatch):
    ran = []
    inner = sf.run
    monkeypatch.setattr(sf, "run", lambda s, q: (ran.append(q.name), inner(s, q))[1])
    merged = losses(sf.direct_surface(star, dfx.default_defects(), severity=0.2, repeats=2, master_seed=4, workload=TEXTS))
    # missing and noise and orphans and drift and copies; copies alone
    assert (ran.count("top_orders"), ran.count("plain")) == (2 * 31, 2 * 1)
    some = [0, 1, 8, 21, 40, 63]
    blind = [workload.SqlQuery(q.name, q.sql, q.keys, q.values) for q in TEXTS]
    every = losses(sf.direct_surface(star, dfx.default_defects(), severity=0.2, repeats=2, master_seed=4, workload=blind, masks=some))
    assert set(every) == {k for k in merged if k[3] in some}
    assert all(merged[k] == pytest.approx(every[k], abs=1e-12) for k in every)


def test_direct_surface_equals_the_damaged_star(star):
    """Rows put together from the flags are those of the defects applied one after the other."""
    chosen = dfx.default_defects()
    scenarios = dfx.plan_scenarios(star, chosen, [0.3], [0, 1], 9)
    flagged = sf._flagged(star, chosen, scenarios, 9)
    for n, mask in ((0, 63), (1, 0b101110)):
        made = sf._assembled(star, flagged, chosen, n, mask)
        want = dfx.damaged_star(star, [d for i, d in enumerate(chosen) if mask >> i & 1], scenarios[n], 9)
        for table in ("orders", "customers"):
            assert getattr(made, table).exceptAll(getattr(want, table)).isEmpty()
            assert getattr(want, table).exceptAll(getattr(made, table)).isEmpty()


@pytest.fixture(scope="module")
def measured(spark):
    rows = spark.range(400).selectExpr(
        "id AS row_id", "1000 + sin(id) AS a", "CASE WHEN id % 11 <> 0 THEN cos(id * 2) END AS b", "cast(id % 4 AS double) AS c",
        "3 * sin(id) - cos(id * 2) + id % 3 AS label",
    )
    return ffx.Features(stored(rows, "measured"), ("a", "b", "c"), "regression")


@pytest.mark.parametrize("chosen", [ffx.default_feature_defects(), (ffx.TargetNoise(), ffx.MissingCells()), (ffx.DuplicateRows(), ffx.FeatureNoise(5.0))])
def test_ridge_from_moments_equals_single_fits(measured, monkeypatch, chosen):
    factory = models.model_factory("regression", "ridge")
    fast = models.model_surface(measured, chosen, factory, severity=0.3, repeats=2, master_seed=8).observations.collect()
    monkeypatch.setattr(models, "rewritable", lambda defects: False)
    slow = models.model_surface(measured, chosen, factory, severity=0.3, repeats=2, master_seed=8).observations.collect()
    key = lambda r: (r.repeat, r.mask)
    for a, b in zip(sorted(fast, key=key), sorted(slow, key=key), strict=True):
        assert key(a) == key(b) and a.loss == pytest.approx(b.loss, abs=1e-6)
        assert (a.train_rows, a.coalition_key, a.diagnostics) == (b.train_rows, b.coalition_key, b.diagnostics)


def test_logistic_by_joint_steps_equals_single_fits(spark, monkeypatch):
    rows = spark.range(500).selectExpr(
        "id AS row_id", "100 + 9 * sin(id) AS a", "CASE WHEN id % 13 <> 0 THEN cos(id * 2) END AS b",
        "cast(sin(id) - 0.6 * cos(id * 2) + 0.8 * sin(id * 7) > 0.1 AS int) AS label",
    )
    table = ffx.Features(stored(rows, "two-classes"), ("a", "b"), "classification")
    factory = models.model_factory("classification", "logistic")
    settings = {"severity": 0.3, "repeats": 2, "master_seed": 8}
    passes = []
    inner = logistic._slopes
    monkeypatch.setattr(logistic, "_slopes", lambda *a: (passes.append(1), inner(*a))[1])
    fast = models.model_surface(table, ffx.default_feature_defects(), factory, **settings).observations.collect()
    assert len(passes) <= 9  # all repeats and combinations
    monkeypatch.setattr(models, "rewritable", lambda defects: False)
    slow = models.model_surface(table, ffx.default_feature_defects(), factory, **settings).observations.collect()
    key = lambda r: (r.repeat, r.mask)
    for a, b in zip(sorted(fast, key=key), sorted(slow, key=key), strict=True):
        assert key(a) == key(b) and a.loss == pytest.approx(b.loss, abs=1e-6)
        assert (a.train_rows, a.coalition_key, a.diagnostics) == (b.train_rows, b.coalition_key, b.diagnostics)


def test_defects_that_moments_cannot_follow(measured):
    class Own(ffx.MissingCells):
        pass

    assert marked.rewritable(ffx.default_feature_defects())
    assert not marked.rewritable([Own()])
    assert not marked.rewritable([ffx.MissingCells(priority=25), ffx.FeatureNoise()])
    assert not marked.rewritable([ffx.DuplicateRows(priority=1), ffx.TargetNoise()])


def test_quantiles_of_many_columns(spark):
    rows = spark.range(300).select(*[((F.hash("id", F.lit(i)) % 50) * 0.1).alias(f"c{i}") for i in range(300)], F.lit(None).cast("double").alias("nothing"))
    rows = stored(rows, "wide")
    names = rows.columns
    got = exact_quantiles(rows, names, [0.5, 0.9])
    frame = rows.drop("nothing").toPandas()
    assert got["nothing"] == [None, None]
    for c in frame.columns:
        assert got[c] == pytest.approx(list(np.quantile(frame[c], [0.5, 0.9])))
