import pytest
from pyspark.sql import functions as F

from tarnish.functions import dice
from tarnish.operators import sampling
from tarnish.operators.quantiles import exact_quantiles
from tarnish.session import stored


@pytest.mark.parametrize("n", [0, 1, 37, 500, 999, 1000])
def test_exact_sample_has_exactly_n_rows(spark, n):
    ids = spark.range(1000).selectExpr("id * 31 + 5 AS key")
    got = sampling.exact_sample(ids, "key", dice.seed_words("t", n), n)
    assert got.count() == n == got.distinct().count()


def test_sample_is_the_smallest_rolls(spark):
    seeds = dice.seed_words("smallest")
    ids = spark.range(5000)
    brute = ids.orderBy(dice.roll("id", seeds), "id").limit(700)
    got = sampling.exact_sample(ids, "id", seeds, 700)
    assert got.exceptAll(brute).count() == 0 and got.count() == 700


def test_harsher_choices_contain_milder_ones(spark):
    seeds = dice.seed_words("nested")
    ids = spark.range(3000)
    small, large = (sampling.exact_sample(ids, "id", seeds, n) for n in (100, 900))
    assert small.join(large, "id", "left_anti").count() == 0


def test_too_large_samples_are_rejected(spark):
    with pytest.raises(ValueError):
        sampling.hash_sample(spark.range(10), "id", (1, 2), 11)


def test_grouped_cuts(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', 'rest') AS kind")
    streams = [sampling.Stream((5, 6), 100, "hot", 1000), sampling.Stream((5, 6), 50, "rest", 2000)]
    cuts = sampling.find_cuts(rows, "id", streams, 3000, "kind")
    rolled = dice.add_rolls(rows, {"r": ("id", (5, 6))})
    for stream, cut in zip(streams, cuts, strict=True):
        assert rolled.filter(F.col("kind") == stream.group).filter(sampling.below("r", "id", cut)).count() == stream.count


def test_draws_with_replacement_add_up_and_spread(spark):
    got = sampling.sample_with_replacement(spark.range(20_000), "id", ("draws", 1), 20_000)
    row = got.agg(F.sum("times").alias("n"), F.count("*").alias("rows"), F.max("times").alias("top")).first()
    assert row.n == 20_000
    # 1 - 1/e of the rows are drawn at least once
    assert abs(row["rows"] / 20_000 - 0.632) < 0.01
    assert 4 <= row.top <= 10


def test_few_draws_from_few_rows(spark):
    got = sampling.sample_with_replacement(spark.range(3), "id", ("few",), 10)
    assert got.agg(F.sum("times")).first()[0] == 10


def test_affected_counts():
    assert sampling.affected(0.0, 100) == 0
    assert sampling.affected(0.001, 100) == 1
    assert sampling.affected(0.125, 20) == 2  # 2.5 rounds to even
    assert sampling.affected(1.0, 7) == 7
    for bad in (-0.1, 1.1):
        with pytest.raises(ValueError):
            sampling.affected(bad, 10)


def test_dense_ids_follow_the_key_even_if_one_key_holds_a_third(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7L, id) AS key", "id AS other")
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    got = sampling.dense_ids(tied, ["key", "_tie"], "n")
    row = got.agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count_distinct("n").alias("d")).first()
    assert (row.a, row.b, row.d) == (0, 2999, 3000)
    wrong = got.alias("x").join(got.alias("y"), F.expr("x.n + 1 = y.n")).filter("x.key > y.key").count()
    assert wrong == 0


def test_dense_ids_stay_the_same_when_read_twice(spark):
    rows = spark.range(500).selectExpr("hash(id) AS key")
    got = sampling.dense_ids(rows, ["key"], "n")
    assert got.exceptAll(got).count() == 0
    assert got.filter("n = 17").first() == got.filter("n = 17").first()


@pytest.mark.parametrize("size", [1001, 100_501])
def test_exact_quantiles_equal_the_builtin(spark, size):
    # a third of the rows share one value, some are null
    rows = spark.range(size).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0.5D WHEN id % 10 = 1 THEN NULL ELSE pow(hash(id) / 1e9, 3) END AS a",
        "cast(id AS double) AS b",
        "cast(NULL AS double) AS c",
    )
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(rows, ["a", "b", "c"], shares)
    listed = F.array(*[F.lit(s) for s in shares])
    want = rows.agg(F.percentile("a", listed).alias("a"), F.percentile("b", listed).alias("b")).first()
    assert got["a"] == pytest.approx(want.a) and got["b"] == pytest.approx(want.b)
    assert got["c"] == [None] * 6


def test_cuts_where_the_first_range_misses(spark, monkeypatch):
    """Rolls far from where an even spread would have them, and ranges that are counted piece by piece."""
    ids = spark.range(60_000)
    seeds = dice.seed_words("adverse", 1)
    # only ids with low rolls are left, so that the expected range holds none of them
    rolled = dice.add_rolls(ids, {"h": ("id", seeds)}).where(F.col("h") < (1 << 27))
    low = stored(rolled.select("id", "h"), "low-rolls")
    n = low.count()
    ranked = [(r.h, r.id) for r in low.orderBy("h", "id").collect()]
    largest = {}
    inner = sampling._holding

    def watched(rows, keys):
        counted = rows.selectExpr(*keys, sampling._PIECE, sampling._RANKED_ID).groupBy(*keys, "piece", "k").count().groupBy(*keys).count()
        largest["rows"] = max(largest.get("rows", 0), counted.agg(F.max("count")).first()[0])
        return inner(rows, keys)

    monkeypatch.setattr(sampling, "_holding", watched)
    monkeypatch.setattr(sampling, "RANKED", 50)
    monkeypatch.setattr(sampling, "PIECES", 16)
    for want in (1, 7, n // 2, n - 1):
        assert sampling.find_cuts(low.select("id"), "id", [sampling.Stream(seeds, want)], n) == [ranked[want - 1]]
    assert largest["rows"] <= 52


def test_group_cuts_agree_with_cuts_of_lists(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANKED", 40)
    monkeypatch.setattr(sampling, "PIECES", 8)
    ids = stored(spark.range(9_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g")), "groups")
    sizes = {r.g: r["count"] for r in ids.groupBy("g").count().collect()}
    seeds = dice.seed_words("groups", 4)
    wants = {g: (i * 7) % (n + 1) for i, (g, n) in enumerate(sorted(sizes.items()))} | {"hot": 1234}
    rows = [(g, 0, *seeds, sizes[g], wants[g]) for g in sizes]
    wanted = spark.createDataFrame(rows, "group string, slot int, one long, two long, size long, want long")
    got = {r.group: (r.h, r.k) for r in sampling.group_cuts(ids, "id", "g", wanted).collect()}
    listed = sampling.find_cuts(ids, "id", [sampling.Stream(seeds, wants[g], g, sizes[g]) for g in sizes], 9_000, "g")
    assert got == dict(zip(sizes, listed))


@pytest.mark.parametrize("hot", [sampling.HOT, 50])
def test_keyed_ids_are_dense_ids_without_sorting_rows(spark, monkeypatch, hot):
    """Ranks within counted keys, keys above HOT rows apart; only keys are dealt by range."""
    monkeypatch.setattr(sampling, "HOT", hot)
    rows = spark.range(1_000).selectExpr("if(id % 3 = 0, -7L, id % 200) AS key", "id * 37 % 11 AS v", "id AS _tie")
    got = sampling.keyed_ids(rows, "key", ["v", "_tie"], "n", ["key", "v", "_tie"])
    want = sampling.dense_ids(rows, ["key", "v", "_tie"], "n")
    assert sorted(got.select("n", "key", "v", "_tie").collect()) == sorted(want.select("n", "key", "v", "_tie").collect())
    assert sampling.keyed_ids(rows.limit(0), "key", ["v", "_tie"], "n", ["key"]).collect() == []


def test_size_of_partitions_does_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "DEALT", 100)
    rows = spark.range(5_000)
    assert sampling.dealt_by(rows, "id", 5_000).rdd.getNumPartitions() == 50
    assert sampling.dealt_by(rows, "id", 900) is rows


def test_places_of_draws_are_dealt_to_small_tasks(spark):
    draws = [sampling.Draws(("dealt", i), 900_000) for i in range(2)]
    placed = sampling._places(spark, list(enumerate(draws)), 2_000_000)
    # short keys only: a task counts its draws by them
    assert placed.columns == ["set", "block", "place"]
    dealt = placed.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in dealt) == 1_800_000 and max(r["count"] for r in dealt) < 600_000
    levels = sampling.occupancy(spark, draws, 2_000_000)
    assert [sum(counts) for counts in levels] == [900_000, 900_000]
    assert all(a >= b for counts in levels for a, b in zip(counts, counts[1:]))


def test_choices_of_equal_seeds_share_the_rolls_of_rows(spark, monkeypatch):
    n, seeds, others = 4_000, (11, 12), (13, 14)
    ids = spark.range(n).selectExpr("id * 3 AS id")
    ranked = {s: sorted((r.h, r.id) for r in sampling.dice.add_rolls(ids, {"h": ("id", s)}).collect()) for s in (seeds, others)}
    wants = [(seeds, w) for w in (1, 2, 3, 200, 1200, 1201, 3999)] + [(others, 400), (seeds, 0), (others, n)]
    streams = [sampling.Stream(s, w) for s, w in wants]
    right = [sampling.NOTHING if w == 0 else sampling.EVERYTHING if w == n else ranked[s][w - 1] for s, w in wants]
    assert sampling.find_cuts(ids, "id", streams, n) == right
    monkeypatch.setattr(sampling, "RANKED", 40)
    monkeypatch.setattr(sampling, "WIDTH", 0.0)
    assert sampling.find_cuts(ids, "id", streams, n) == right
    apart = [(i, sampling.Stream(seeds, w), low, high, 0) for i, (w, low, high) in enumerate([(10, 100, 200), (20, 300, 400)])]
    seen = []
    monkeypatch.setattr(sampling.dice, "add_rolls", lambda df, rolls, given=sampling.dice.add_rolls: seen.append(df.count()) or given(df, rolls))
    sampling._located(ids, "id", apart)
    assert seen == [n]
