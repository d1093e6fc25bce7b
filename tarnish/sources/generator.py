"""Generated star schemas for scale studies: every value is a function of the row number and the seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.functions import dice
from tarnish.sources.star import Star

# The populations of the study.
REGIMES = ("uniform", "skewed", "seasonal")
REGIONS = [("north", 0.18), ("south", 0.20), ("east", 0.22), ("west", 0.24), ("central", 0.16)]
SEGMENTS = [("consumer", 0.68), ("small_business", 0.23), ("enterprise", 0.09)]
CATEGORIES = ["office", "electronics", "home", "outdoor", "health", "apparel"]
STATUSES = [("completed", 0.91), ("refunded", 0.055), ("cancelled", 0.035)]
DISCOUNTS = [(0.0, 0.44), (0.05, 0.16), (0.10, 0.22), (0.20, 0.13), (0.30, 0.05)]
DAYS = 730
START = "2024-01-01"
ZIPF = 1.12
ZIPF_HEAD = 64
MIN_ORDERS = 1_000
SEASON_BUCKETS = 1024


def dimension_sizes(n_orders: int) -> tuple[int, int]:
    """Customers and products that go with a number of orders."""
    return max(1_000, n_orders // 20), max(250, n_orders // 200)


def seeds(seed: int, table: str, column: str) -> tuple[int, int]:
    return dice.seed_words("generate", seed, table, column)


def _share(key: str, seed: int, table: str, column: str) -> Column:
    return dice.unit(dice.roll(key, seeds(seed, table, column)))


def _wide(key: str, seed: int, table: str, column: str) -> tuple[Column, Column]:
    return dice.roll(key, seeds(seed, table, column)), dice.roll(key, seeds(seed, table, column + "-low"))


def _lognormal(key: str, seed: int, table: str, column: str, mean: float, sigma: float) -> Column:
    first, second = (dice.roll(key, seeds(seed, table, f"{column}-{s}")) for s in ("radius", "angle"))
    return F.exp(F.lit(mean) + F.lit(sigma) * dice.normal(first, second))


def season_table() -> list[tuple[float, float, int]]:
    """(low, high, day): the share of every day under a yearly wave and a late surge."""
    weights = [1.2 + math.sin(2 * math.pi * d / 365.0) + (0.7 if d > 650 else 0.0) for d in range(DAYS)]
    total, running, rows = sum(weights), 0.0, []
    for day, weight in enumerate(weights):
        low = running
        running += weight / total
        rows.append((low, running if day < DAYS - 1 else 1.0, day))
    return rows


def zipf_parts(n: int) -> tuple[list[float], float, float]:
    """Weights of the first ranks, their sum, and the mass of all ranks.

    Beyond the head the sum over ranks is replaced by the integral between half
    ranks, which differs from it by less than 1e-4 of a rank's own weight.
    """
    head = [k**-ZIPF for k in range(1, min(n, ZIPF_HEAD) + 1)]
    mass = sum(head)
    tail = 0.0
    if n > ZIPF_HEAD:
        tail = ((ZIPF_HEAD + 0.5) ** (1 - ZIPF) - (n + 0.5) ** (1 - ZIPF)) / (ZIPF - 1)
    return head, mass, mass + tail


def zipf_rank(share: Column, n: int) -> Column:
    """0-based rank with probability proportional to (rank + 1) ** -1.12, by inverting the running sum."""
    head, mass, total = zipf_parts(n)
    running, chosen = 0.0, None
    for rank, weight in enumerate(head):
        running += weight
        test = share < F.lit(running / total)
        value = F.lit(rank).cast("long")
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    left = F.lit((ZIPF_HEAD + 0.5) ** (1 - ZIPF)) - (share * F.lit(total) - F.lit(mass)) * F.lit(ZIPF - 1)
    rank = F.floor(F.pow(left, F.lit(1.0 / (1.0 - ZIPF))) + F.lit(0.5)).cast("long") - F.lit(1)
    return chosen.otherwise(F.least(F.greatest(rank, F.lit(min(n, ZIPF_HEAD))), F.lit(n - 1)))


def generated_customers(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select(
        F.col("id").alias("customer_id"),
        dice.categorical(_share("id", seed, "customers", "region"), REGIONS).alias("region"),
        dice.categorical(_share("id", seed, "customers", "segment"), SEGMENTS).alias("segment"),
    )


def _base_price(key: str, seed: int) -> Column:
    return _lognormal(key, seed, "products", "base_price", 3.0, 0.8)


def generated_products(spark: SparkSession, n: int, seed: int) -> DataFrame:
    even = [(c, 1.0) for c in CATEGORIES]
    return spark.range(n).select(
        F.col("id").alias("product_id"),
        dice.categorical(_share("id", seed, "products", "category"), even).alias("category"),
        _base_price("id", seed).alias("base_price"),
    )


def generated_orders(spark: SparkSession, n: int, regime: str, seed: int) -> DataFrame:
    customers, products = dimension_sizes(n)
    rows = spark.range(n).withColumn("product_id", dice.pick(*_wide("id", seed, "orders", "product"), products))
    high, low = _wide("id", seed, "orders", "customer")
    if regime == "skewed":
        share = (high * F.lit(1 << 22) + F.shiftright(low, 9)) / F.lit(float(1 << 53))
        rows = rows.withColumn("_share", share).withColumn("customer_id", zipf_rank(F.col("_share"), customers))
    else:
        rows = rows.withColumn("customer_id", dice.pick(high, low, customers))
    if regime == "seasonal":
        pieces = [
            (bucket, low, high, day)
            for low, high, day in season_table()
            for bucket in range(int(low * SEASON_BUCKETS), min(SEASON_BUCKETS - 1, int(high * SEASON_BUCKETS)) + 1)
        ]
        # a fixed table of some 1,750 rows
        season = F.broadcast(spark.createDataFrame(pieces, "_bucket int, _low double, _high double, _day int"))
        rows = rows.withColumn("_when", _share("id", seed, "orders", "day"))
        rows = rows.withColumn("_bucket", F.floor(F.col("_when") * F.lit(SEASON_BUCKETS)).cast("int")).join(
            season, "_bucket"
        )
        rows = rows.filter("_when >= _low AND _when < _high")
    else:
        rows = rows.withColumn("_day", dice.pick(*_wide("id", seed, "orders", "day"), DAYS).cast("int"))
    noise = _lognormal("id", seed, "orders", "price", 0.0, 0.12)
    return rows.select(
        F.col("id").alias("order_id"),
        "customer_id",
        "product_id",
        F.expr(f"timestamp_ntz'{START}' + make_dt_interval(_day)").alias("order_date"),
        dice.clipped_geometric(_share("id", seed, "orders", "quantity"), 0.42, 12).cast("double").alias("quantity"),
        (_base_price("product_id", seed) * noise).alias("unit_price"),
        dice.categorical(_share("id", seed, "orders", "discount"), DISCOUNTS).cast("double").alias("discount"),
        dice.categorical(_share("id", seed, "orders", "status"), STATUSES).alias("status"),
    )


def generate_star(
    spark: SparkSession, n_orders: int = 100_000, *, regime: str = "uniform", seed: int = 2027, name: str | None = None
) -> Star:
    if n_orders < MIN_ORDERS:
        raise ValueError(f"n_orders must be at least {MIN_ORDERS:,}")
    if regime not in REGIMES:
        raise ValueError(f"regime must be one of {REGIMES}")
    customers, products = dimension_sizes(n_orders)
    return Star(
        name or f"retail_{regime}_{n_orders}",
        generated_customers(spark, customers, seed),
        generated_products(spark, products, seed),
        generated_orders(spark, n_orders, regime, seed),
        regime,
    )
