import json

import pytest
from pyspark.sql import functions as F

from tarnish.operators import feature_defects as ffx
from tarnish.operators.loss import prediction_loss
from tarnish.plans import models, studies
from tarnish.session import stored
from tarnish.sources.features import csv_features


@pytest.fixture(scope="module")
def grid(spark):
    columns = ", ".join(f"cast(id * 4 + {j} AS double) AS f{j}" for j in range(4))
    rows = spark.range(30).selectExpr("id AS row_id", columns.split(", ")[0], *columns.split(", ")[1:], "cast(id % 2 AS int) AS label")
    return ffx.Features(rows, ("f0", "f1", "f2", "f3"), "classification")


@pytest.fixture(scope="module")
def linear(spark):
    """A label that follows the first feature."""
    rows = spark.range(160).selectExpr(
        "id AS row_id", "sin(id) AS a", "cos(id * 1.3) AS b", "cast(id % 7 AS double) AS c", "if(sin(id) > 0.1, 1, 0) AS label"
    )
    return ffx.Features(rows, ("a", "b", "c"), "classification")


def hurt(table, *defects, severity=0.2, repeat=0):
    return ffx.damage_features(table, defects, severity=severity, master_seed=19, repeat=repeat)


def nulls(table):
    counts = table.rows.agg(*[F.sum(F.col(c).isNull().cast("int")) for c in table.columns]).first()
    return sum(counts)


def test_missing_cells_are_counted_exactly(grid):
    out, told = hurt(grid, ffx.MissingCells(), severity=0.1)
    assert nulls(out) == 12 and told["missing_cells"]["affected_cells"] == 12
    assert out.rows.select("row_id", "label").exceptAll(grid.rows.select("row_id", "label")).count() == 0


def test_hits_do_not_depend_on_other_defects(grid):
    alone, _ = hurt(grid, ffx.MissingCells(), repeat=2)
    both, _ = hurt(grid, ffx.MissingCells(), ffx.TargetNoise(), repeat=2)
    pattern = ["row_id", *[F.col(c).isNull().alias(c) for c in grid.columns]]
    assert alone.rows.select(pattern).exceptAll(both.rows.select(pattern)).count() == 0


def test_copies_come_last_and_stay_aligned(grid):
    out, told = hurt(grid, ffx.DuplicateRows(), ffx.MissingCells())
    assert out.rows.count() == 36 and told["duplicate_rows"]["added_rows"] == 6
    assert out.rows.distinct().count() <= 30


def test_noise_hits_cells_and_spares_the_rest(grid):
    out, _ = hurt(grid, ffx.FeatureNoise())
    pair = out.rows.alias("x").join(grid.rows.alias("y"), "row_id")
    changed = pair.agg(*[F.sum((F.col(f"x.{c}") != F.col(f"y.{c}")).cast("int")) for c in grid.columns]).first()
    assert sum(changed) == 24


def test_flipped_labels_are_other_classes(grid):
    out, told = hurt(grid, ffx.TargetNoise())
    pair = out.rows.alias("x").join(grid.rows.alias("y"), "row_id")
    assert pair.filter("x.label <> y.label").count() == 6 == told["target_noise"]["affected_rows"]
    assert {r.label for r in out.rows.select("label").distinct().collect()} == {0, 1}


def test_bad_input_is_rejected(grid):
    for severity in (-0.1, 1.1):
        with pytest.raises(ValueError):
            hurt(grid, ffx.MissingCells(), severity=severity)
    with pytest.raises(ValueError):
        hurt(grid, ffx.MissingCells(), ffx.MissingCells())
    with pytest.raises(ValueError):
        ffx.Features(grid.rows, ("f0",), "ranking")
    one = grid.with_rows(grid.rows.withColumn("label", F.lit(1)))
    with pytest.raises(ValueError):
        hurt(one, ffx.TargetNoise())


def test_own_defects(grid):
    class Shift:
        name, priority = "shift", 5

        def apply(self, table, rolls):
            return table.with_rows(table.rows.withColumn("f0", F.col("f0") + 1)), {"affected_rows": rolls.n_rows}

    out, told = hurt(grid, Shift(), ffx.MissingCells())
    assert told["shift"] == {"affected_rows": 30}
    assert out.rows.filter("f0 IS NOT NULL AND f0 <> row_id * 4 + 1").count() == 0


def test_losses(spark):
    classes = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    assert prediction_loss(classes, "classification").first().loss == 0.5
    far = spark.createDataFrame([(0.0, 100.0), (1.0, 1.0), (2.0, 2.0)], "label double, prediction double")
    assert prediction_loss(far, "regression").first().loss == pytest.approx(1 / 3)
    flat = spark.createDataFrame([(1.0, 1.5), (1.0, 1.0)], "label double, prediction double")
    assert prediction_loss(flat, "regression").first().loss == pytest.approx(0.25)
    with pytest.raises(ValueError):
        prediction_loss(classes, "ranking")


def test_splits_are_exact_and_stratified(linear):
    split = models.splits(linear, 3, 0.3, 5)
    told = split.all().join(linear.rows, "row_id").groupBy("repeat", "label").agg(
        F.sum(F.col("is_test").cast("int")).alias("t"), F.count("*").alias("n")
    )
    rows = told.collect()
    for repeat in range(3):
        assert sum(r.t for r in rows if r["repeat"] == repeat) == 48
    assert all(abs(r.t - 0.3 * r.n) <= 1 for r in rows)
    train, test = split.parts(1)
    assert train.rows.count() == 112 and test.count() == 48
    assert train.rows.join(test, "row_id").count() == 0


def test_preparation_fills_and_scales(spark):
    rows = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (None, None)], "a double, b double")
    learned = models.learn_preparation(rows, ["a", "b"])
    assert learned.medians == {"a": 2.0, "b": 0.0}
    done = learned.apply(rows).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.max("b").alias("b")).first()
    assert done.m == pytest.approx(0) and done.s == pytest.approx(1) and done.b == 0.0


def test_ridge_has_the_closed_form(spark):
    import numpy as np

    rows = spark.range(50).selectExpr("id AS row_id", "sin(id) AS a", "cos(id * 2) AS b", "3 * sin(id) - cos(id * 2) + id % 3 AS label")
    table = ffx.Features(rows, ("a", "b"), "regression")
    model = models.fit(table, models.model_factory("regression", "ridge"), 1).model
    frame = rows.toPandas()
    x = frame[["a", "b"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    y = frame.label.to_numpy()
    want = np.linalg.solve(x.T @ x + np.eye(2), x.T @ (y - y.mean()))
    assert list(model.coefficients) == pytest.approx(list(want), abs=1e-6)
    assert model.intercept == pytest.approx(y.mean())


def test_model_surface_is_complete_and_learns(linear):
    study = models.model_surface(
        linear, [ffx.MissingCells(), ffx.TargetNoise()], models.model_factory("classification", "logistic"), repeats=2
    )
    rows = study.observations.collect()
    assert {(r.repeat, r.mask) for r in rows} == {(a, b) for a in range(2) for b in range(4)}
    assert all(0 <= r.loss <= 1 for r in rows)
    assert all(r.loss < 0.2 for r in rows if r.mask == 0)
    assert all(set(r.diagnostics) == set(r.coalition) for r in rows)
    for bad in ({"repeats": 1}, {"test_size": 1.0}):
        with pytest.raises(ValueError):
            models.model_surface(linear, [ffx.MissingCells()], models.model_factory("classification", "logistic"), **bad)
    small = linear.with_rows(linear.rows.limit(39))
    with pytest.raises(ValueError):
        models.model_surface(small, [ffx.MissingCells()], models.model_factory("classification", "logistic"))
    with pytest.raises(ValueError):
        models.model_factory("classification", "ridge")


def test_csv_audit_writes_a_report(spark, tmp_path):
    lines = ["x1,x2,target"] + [f"{(i * 37 % 100) / 10},{(i * 53 % 90) / 7},{int(i * 37 % 100 > 50)}" for i in range(100)]
    source, output = tmp_path / "data.csv", tmp_path / "report"
    source.write_text("\n".join(lines) + "\n")
    studies.audit_csv(
        spark, str(source), "target", "classification", str(output), model="logistic", repeats=2, bootstrap_samples=100, parallelism=8
    )
    text = "".join(p.read_text() for p in output.glob("part-*"))
    payload = json.loads(text)
    assert len(payload["attributions"]) == 4 and len(payload["observations"]) == 32
    assert abs(payload["efficiency_residual"]) < 1e-12
    assert payload["configuration"]["target"] == "target" and "interpretation" in payload
    with pytest.raises(ValueError):
        csv_features(spark, str(source), "nothing", "classification")
    source.write_text("x1,x2,target\nred,1,0\n")
    with pytest.raises(ValueError):
        csv_features(spark, str(source), "target", "classification")


def test_labels_of_many_classes_are_flipped_to_others(spark):
    """Twelve thousand classes, one of which holds a third of the rows."""
    rows = spark.range(24_000).select(
        F.col("id").alias("row_id"), F.lit(1.0).alias("f0"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 12_000).cast("int").alias("label")
    )
    table = ffx.Features(rows, ("f0",), "classification")
    out, told = hurt(table, ffx.TargetNoise())
    pair = out.rows.alias("x").join(rows.alias("y"), "row_id")
    assert out.rows.count() == 24_000
    assert pair.filter("x.label <> y.label").count() == told["target_noise"]["affected_rows"]
    assert out.rows.join(rows.select("label").distinct(), "label", "left_anti").count() == 0


def test_rows_without_label_are_refused(spark):
    rows = spark.range(60).selectExpr("id AS row_id", "1.0D AS f0", "CASE WHEN id > 3 THEN cast(id % 2 AS int) END AS label")
    with pytest.raises(ValueError):
        models.splits(ffx.Features(rows, ("f0",), "classification"), 2)


def test_numbers_do_not_depend_on_files(spark, tmp_path):
    """The same CSV rows in one file and in many get the same numbers."""
    rows = spark.range(400).selectExpr("cast(hash(id) % 20 AS double) AS a", "cast(id % 7 AS double) AS b", "cast(id % 3 AS int) AS y")
    numbered = []
    for parts in (1, 9):
        path = str(tmp_path / str(parts))
        rows.repartition(parts).write.csv(path, header=True)
        numbered.append(sorted(map(tuple, csv_features(spark, path, "y", "regression").rows.collect())))
    assert numbered[0] == numbered[1]


def test_a_million_classes_are_split_without_a_list(spark, monkeypatch):
    """As many classes as there are rows, and one that holds a third of them: nothing of their number comes to the driver."""
    rows = spark.range(1_200_000).select(F.col("id").alias("row_id"), F.lit(1.0).alias("f0"), F.when(F.col("id") % 6 == 0, -1).otherwise(F.col("id")).cast("long").alias("label"))
    table = ffx.Features(stored(rows, "many-classes"), ("f0",), "classification")
    fetched = []
    collect = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: (fetched.append(len(out := collect(self))), out)[1])
    told = models.splits(table, 1, 0.25, 3).all().join(rows, "row_id")
    got = told.groupBy((F.col("label") == -1).alias("hot")).agg(F.sum(F.col("is_test").cast("int")).alias("t"), F.count("*").alias("n"))
    tested = {r.hot: r.t for r in got.collect()}
    assert tested[True] == 50_000 and sum(tested.values()) == 300_000
    assert max(fetched) < 1_000


def test_large_generated_methods_are_not_fused(spark):
    from tarnish.functions import dice
    from tarnish.session import METHOD_LIMIT

    spark.conf.unset(METHOD_LIMIT)
    dice.add_rolls(spark.range(3), {"h": ("id", (1, 2))})
    assert spark.conf.get(METHOD_LIMIT) == "8000"
    spark.conf.set(METHOD_LIMIT, "20000")
    dice.add_rolls(spark.range(3), {"h": ("id", (1, 2))})
    assert spark.conf.get(METHOD_LIMIT) == "20000"
    spark.conf.unset(METHOD_LIMIT)


def test_blocks_hold_the_rows_that_they_are_made_of(spark):
    from tarnish.plans import marked

    rows = [(i // 700, None if i % 9 == 0 else float(i), i % 3 == 0, i / 7, float(i % 5), -float(i), i % 4) for i in range(1_500)]
    table = spark.createDataFrame(rows, "repeat int, x0 double, lost0 boolean, noise0 double, y double, shift double, extra long").repartition(3)

    def told(batches):
        import pyarrow as pa

        for batch in batches:
            for repeat, got in marked.from_blocks(batch, 1):
                n = len(got["y"])
                flat = [pa.array(got[c].reshape(-1)) for c, _ in marked.KEPT]
                yield pa.RecordBatch.from_arrays([pa.array([repeat] * n, pa.int32()), *flat], names=["repeat", "x0", "lost0", "noise0", "y", "shift", "extra"])

    back = marked.in_blocks(table, 1).mapInArrow(told, table.schema).collect()
    plain = lambda x: None if x is None or x != x else x
    assert sorted((tuple(map(plain, r)) for r in back), key=str) == sorted(rows, key=str)
    assert marked.in_blocks(table, 1).count() < 30


def test_document_features_are_read_from_what_was_written(spark, data):
    from tarnish.sources.features import document_quality

    assert not any("documents.parquet" in f for f in document_quality(spark, data).rows.inputFiles())


def test_forests_on_many_rows_are_grown_a_few_trees_at_a_time(spark, monkeypatch):
    from tarnish.plans import models

    rows = spark.range(400).selectExpr("id AS row_id", "cast(id % 20 AS double) AS a", "cast(id % 7 AS double) AS b", "cast(id % 20 > 9 AS int) AS label")
    monkeypatch.setattr(models, "TREE_ROWS", 400 * 40)
    for task in ("classification", "regression"):
        table = ffx.Features(rows, ("a", "b"), task)
        fitted = models.fit(table, models.model_factory(task, "forest"), 5)
        assert len(fitted.model.paths) == 3
        told = fitted.predict(rows).collect()
        assert len(told) == 400 and sum(abs(r.prediction - r.label) > 0.2 for r in told) == 0


def test_cells_are_numbered_without_a_lambda(grid):
    cells = grid.cells()
    assert sorted(r.cell for r in cells.collect()) == list(range(30 * 4))
    assert "lambda" not in cells._jdf.queryExecution().executedPlan().toString()


def test_rounding_goes_through_decimals_only_where_it_matters(spark):
    from registry.queries import rounded

    odd = [None, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), 1e300, 1e11, 123456789.12345, 0.00005, 1.00005, -2.5e-5, 2.675, 17.0, 0.07, 0.29, 99999.99, 90909.90909]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id int, x double").unionByName(
        spark.range(2000).selectExpr("cast(id + 100 AS int) AS id", "if(id % 2 = 0, sin(id) * pow(10, id % 13), round(sin(id) * 1000, 3)) AS x")
    )
    plain = table.select("id", F.round("x", 4).alias("x")).select("id", F.when(F.col("x") == 0, F.lit(0.0)).otherwise(F.col("x")).alias("x"))
    got = rounded(table, 4)
    assert [(r.id, repr(r.x)) for r in got.orderBy("id").collect()] == [(r.id, repr(r.x)) for r in plain.orderBy("id").collect()]
    # a value is rounded once
    once = rounded(spark.range(5).selectExpr("rand(1) AS x"), 4)
    assert once._jdf.queryExecution().optimizedPlan().toString().count("round(") == 1


def test_a_grown_tree_is_that_of_a_plain_search():
    import numpy as np

    from tarnish.plans import forest

    draw = np.random.default_rng(3)
    codes, w = draw.integers(0, 6, (300, 3)).astype(np.uint8), draw.integers(1, 4, 300).astype(float)
    for classes in (3, 0):
        y = ((codes[:, 0] > 2) + (codes[:, 1] > 3) + (draw.random(300) < 0.2)) % 3.0 if classes else codes[:, 0] + draw.random(300)
        rules = forest.Rules(classes, 3, 3, 6, 5, 3, 1)

        def impurity(y, w):
            return sum(w) - sum(sum(w[y == c]) ** 2 for c in range(3)) / sum(w) if classes else sum(w * y * y) - sum(w * y) ** 2 / sum(w)

        def plain(rows, depth):
            best = (1e-9, None)
            for j in range(3):
                for cut in range(5):
                    sides = [rows[codes[rows, j] <= cut], rows[codes[rows, j] > cut]]
                    if min(w[s].sum() for s in sides) >= 3:
                        gain = impurity(y[rows], w[rows]) - sum(impurity(y[s], w[s]) for s in sides)
                        if gain > best[0] + 1e-9:
                            best = (gain, sides)
            shares = [w[rows][y[rows] == c].sum() / w[rows].sum() for c in range(3)] if classes else [(w * y)[rows].sum() / w[rows].sum()]
            if depth < 5 and best[1]:
                left, right = (plain(s, depth + 1) for s in best[1])
                same = isinstance(left, list) and isinstance(right, list) and (np.argmax(left) == np.argmax(right) if classes else left == right)
                return shares if same else (best[1][0], left, best[1][1], right)
            return shares

        told = np.zeros((300, 3 if classes else 1))

        def fill(rows, tree):
            if isinstance(tree, list):
                told[rows] = tree
            else:
                fill(tree[0], tree[1])
                fill(tree[2], tree[3])

        fill(np.arange(300), plain(np.arange(300), 0))
        feature, cut, child, value = forest.grow(rules, codes, y, w, 0, draw)
        assert len(value) > 5 and np.allclose(value[child[forest.walk(feature, cut, child, codes)]], told)


def test_forests_are_the_same_however_their_trees_are_parted(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    from tarnish.plans import forest

    def never(*_):
        raise AssertionError("MLlib holds all nodes of a forest in the driver")

    rows = spark.range(900).selectExpr("id AS row_id", "sin(id * 1.7) AS a", "cast(id % 3 AS double) AS b", "if(id % 5 = 0, NULL, cos(id)) AS c", "cast(2 * abs(sin(id * 1.7)) + id % 3 AS int) AS label")
    monkeypatch.setattr(models, "FEW_ROWS", 0)
    for kind, task in ((RandomForestClassifier, "classification"), (RandomForestRegressor, "regression")):
        monkeypatch.setattr(kind, "fit", never)
        told = {}
        for part, held in ((500_000, 2_000_000), (300, 20)):
            monkeypatch.setattr(forest, "PART", part)
            monkeypatch.setattr(forest, "HELD", held)
            table = ffx.Features(rows.repartition(2 if held == 20 else 5), ("a", "b", "c"), task)
            fitted = models.fit(table, lambda seed, n, spread: kind(numTrees=2, minInstancesPerNode=3, maxDepth=4, featureSubsetStrategy="all", seed=seed), 5)  # noqa: B023
            (path,) = fitted.model.paths
            assert (spark.read.parquet(path).count() > 4) == (part == 300)
            told[part] = sorted((r.label, r.prediction) for r in fitted.predict(rows).collect())
            wrong = sum(abs(a - b) > 0.5 for a, b in told[part])
            assert wrong < 90, wrong
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(told[300], told[500_000], strict=True))


def test_bins_end_between_few_values_and_at_quantiles_of_many(spark):
    from tarnish.plans import forest

    rows = spark.range(3000).selectExpr("cast(0 AS double) AS label", "array(cast(id % 3 AS double), if(id < 1500, 0.0, cast(id AS double)), 7.0) AS x")
    few, many, none = forest.thresholds(rows, 3, 3000, 32)
    assert list(few) == [0.5, 1.5] and list(none) == []
    assert many[0] == 0.0 and len(many) == 31 and 30 < min(b - a for a, b in zip(many[1:], many[2:])) and many[-1] < 2999


def _told(study):
    return sorted((r.repeat, r.mask, r.train_rows, round(r.loss, 9), str(sorted(r.diagnostics.items()))) for r in study.observations.collect())


def test_severities_share_splits_and_rows(spark, monkeypatch):
    from tarnish.plans import marked

    rows = spark.range(300).selectExpr("id AS row_id", "sin(id) AS a", "if(id % 11 = 0, NULL, cast(id % 7 AS double)) AS b", "3 * sin(id) + cos(id * 5) AS label")
    table, calls, given = ffx.Features(rows, ("a", "b"), "regression"), [], models.splits
    monkeypatch.setattr(models, "splits", lambda *a: calls.append(a) or given(*a))
    chosen = {"repeats": 2, "master_seed": 3}
    factory = models.model_factory("regression", "ridge")
    both = models.model_surfaces(table, ffx.default_feature_defects(), factory, severities=(0.05, 0.3), **chosen)
    assert len(calls) == 1
    alone = [models.model_surface(table, ffx.default_feature_defects(), factory, severity=s, **chosen) for s in (0.05, 0.3)]
    assert [_told(s) for s in both] == [_told(s) for s in alone] and _told(both[0]) != _told(both[1])
    # where the medians are looked for first does not show
    monkeypatch.setattr(marked, "HINT", 10)
    for around in (0.2, 0.0):
        monkeypatch.setattr(marked, "AROUND", around)
        assert _told(models.model_surface(table, ffx.default_feature_defects(), factory, severity=0.3, **chosen)) == _told(alone[1])
