from pyspark.sql import functions as F

from tarnish.functions import dice
from tarnish.functions.coalitions import key_mask, mask_key, mask_of, members


def test_rolls_look_uniform_and_independent(spark):
    a, b = dice.seed_words("test", 1), dice.seed_words("test", 2)
    rolled = dice.add_rolls(spark.range(200_000), {"a": ("id", a), "b": ("id", b)})
    u, v = dice.unit(F.col("a")), dice.unit(F.col("b"))
    row = rolled.select(
        F.avg(u).alias("mean"), F.stddev(u).alias("sd"), F.corr(u, v).alias("corr"), F.count_distinct("a").alias("n"),
        F.min(u).alias("low"), F.max(u).alias("high"),
    ).first()
    assert abs(row["mean"] - 0.5) < 0.003
    assert abs(row["sd"] - 12**-0.5) < 0.003
    assert abs(row["corr"]) < 0.01
    assert row["n"] > 199_900
    assert 0 < row["low"] and row["high"] < 1


def test_both_ways_to_roll_agree_also_for_ids_beyond_31_bits(spark):
    seeds = dice.seed_words("big")
    ids = spark.range(1000).selectExpr("id * 4000000000000037 AS id")
    both = dice.add_rolls(ids, {"r": ("id", seeds)}).withColumn("s", dice.roll("id", seeds))
    assert both.filter("r <> s OR r < 0 OR r >= 2147483648").count() == 0
    assert both.select("r").distinct().count() > 990


def test_normal_values(spark):
    rolled = dice.add_rolls(spark.range(100_000), {"a": ("id", (11, 12)), "b": ("id", (13, 14))})
    row = rolled.select(dice.normal(F.col("a"), F.col("b")).alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(row.m) < 0.015 and abs(row.s - 1) < 0.015


def test_picks_stay_in_range(spark):
    rolled = dice.add_rolls(spark.range(10_000), {"a": ("id", (1, 2)), "b": ("id", (3, 4))})
    row = rolled.select(dice.pick(F.col("a"), F.col("b"), 7).alias("p")).agg(F.min("p").alias("a"), F.max("p").alias("b")).first()
    assert (row.a, row.b) == (0, 6)


def test_coalition_keys_round_trip(spark):
    players = ("zeta", "alpha", "mid")
    table = spark.range(8).withColumnRenamed("id", "mask").withColumn("key", mask_key(F.col("mask"), players))
    rows = table.select("mask", "key", members(F.col("mask"), players).alias("m"), key_mask(F.col("key"), players).alias("back")).collect()
    keys = {r.mask: r.key for r in rows}
    assert keys[0] == "EMPTY" and keys[3] == "alpha|zeta" and keys[7] == "alpha|mid|zeta"
    assert all(r.mask == r.back for r in rows)
    assert mask_of({"mid", "zeta"}, players) == 5
    unknown = spark.createDataFrame([("alpha|nobody",)], "key string").select(key_mask(F.col("key"), players).alias("m")).first()
    assert unknown.m is None
