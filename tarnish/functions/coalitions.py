"""Coalitions as bit masks: bit i of a mask stands for player i."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY_KEY = "EMPTY"
EXACT_LIMIT = 10


def check_players(players) -> tuple[str, ...]:
    players = tuple(players)
    if len(set(players)) != len(players):
        raise ValueError("player names must be unique")
    if any("|" in p for p in players):
        raise ValueError("player names must not contain '|'")
    return players


def all_masks(spark: SparkSession, m: int) -> DataFrame:
    """Every coalition of m players, by mask."""
    return spark.range(1 << m).select(F.col("id").alias("mask"), F.bit_count("id").cast("int").alias("size"))


def members(mask: Column, players) -> Column:
    """Sorted member names of a mask."""
    named = sorted((name, i) for i, name in enumerate(players))
    slots = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for name, i in named]
    if not slots:
        return F.array().cast("array<string>")
    return F.filter(F.array(*slots), lambda x: x.isNotNull())


def mask_key(mask: Column, players) -> Column:
    """Stable text key: sorted names joined by '|'."""
    return F.when(mask == 0, F.lit(EMPTY_KEY)).otherwise(F.array_join(members(mask, players), "|"))


def key_mask(key: Column, players) -> Column:
    """Text key back to a mask; unknown names give null."""
    names = F.split(key, r"\|")
    total = F.lit(0).cast("long")
    known = F.lit(0)
    for i, name in enumerate(players):
        present = F.array_contains(names, name)
        total = total + F.when(present, F.lit(1 << i)).otherwise(F.lit(0))
        known = known + present.cast("int")
    return F.when(key == EMPTY_KEY, F.lit(0).cast("long")).when(known == F.size(names), total)


def mask_of(names, players) -> int:
    players = list(players)
    return sum(1 << players.index(n) for n in set(names))


def with_players(df: DataFrame, players) -> DataFrame:
    """One row per row and player, with the player's idx, bit and name."""
    rows = [
        F.struct(F.lit(i).alias("idx"), F.lit(1 << i).cast("long").alias("bit"), F.lit(p).alias("player"))
        for i, p in enumerate(players)
    ]
    return df.select("*", F.inline(F.array(*rows)))


def shapley_size_weight(size: int, m: int) -> float:
    """Share of orders in which a player joins right after ``size`` given others."""
    return factorial(size) * factorial(m - size - 1) / factorial(m)


def _by_size(size: Column, weights: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (size + 1).cast("int"))


def shapley_weights(spark: SparkSession, players) -> DataFrame:
    """Linear map (mask, player, weight) from coalition values to Shapley values."""
    m = len(players)
    inside = [0.0] + [shapley_size_weight(s - 1, m) for s in range(1, m + 1)]
    outside = [-shapley_size_weight(s, m) for s in range(m)] + [0.0]
    grid = with_players(all_masks(spark, m), players)
    weight = F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, _by_size(F.col("size"), inside)).otherwise(
        _by_size(F.col("size"), outside)
    )
    return grid.select("mask", "idx", "player", weight.alias("weight"))


def banzhaf_weights(spark: SparkSession, players) -> DataFrame:
    m = len(players)
    share = 1.0 / (1 << max(m - 1, 0))
    grid = with_players(all_masks(spark, m), players)
    weight = F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.lit(share)).otherwise(F.lit(-share))
    return grid.select("mask", "idx", "player", weight.alias("weight"))


def interaction_weights(spark: SparkSession, players) -> DataFrame:
    """Linear map (mask, left, right, weight) to pairwise Shapley interactions."""
    m = len(players)
    pairs = [
        F.struct(
            F.lit(i).alias("left_idx"),
            F.lit(j).alias("right_idx"),
            F.lit((1 << i) | (1 << j)).cast("long").alias("both"),
            F.lit(players[i]).alias("left"),
            F.lit(players[j]).alias("right"),
        )
        for i in range(m)
        for j in range(i + 1, m)
    ]
    if not pairs:
        schema = "mask long, left_idx int, right_idx int, left string, right string, weight double"
        return spark.createDataFrame([], schema)
    table = all_masks(spark, m).select("*", F.inline(F.array(*pairs)))
    hit = F.bit_count(F.col("mask").bitwiseAND(F.col("both")))
    others = F.col("size") - hit
    weight = _by_size(others, [factorial(s) * factorial(m - s - 2) / factorial(m - 1) for s in range(m - 1)])
    signed = F.when(hit == 1, -weight).otherwise(weight)
    return table.select("mask", "left_idx", "right_idx", "left", "right", signed.alias("weight"))
