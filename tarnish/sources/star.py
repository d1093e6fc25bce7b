"""Star schemas: one fact table ``orders`` with the dimensions ``customers`` and ``products``."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.functions import dice
from tarnish.operators.sampling import dealt_by, dense_ids, hash_sample, keyed_ids
from tarnish.session import stored

CUSTOMER_COLUMNS = ("customer_id", "region", "segment")
PRODUCT_COLUMNS = ("product_id", "category", "base_price")
ORDER_COLUMNS = (
    "order_id",
    "customer_id",
    "product_id",
    "order_date",
    "quantity",
    "unit_price",
    "discount",
    "status",
)
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]

# What the payment codes of the trip records mean.
PAYMENT_CODES = {
    0: "unknown",
    1: "credit_card",
    2: "cash",
    3: "no_charge",
    4: "dispute",
    5: "unknown",
    6: "voided",
}


@dataclass(frozen=True)
class Star:
    """``order_id`` and ``customer_id`` must be unique integers in their own table."""

    name: str
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    regime: str = "given"

    def __post_init__(self) -> None:
        for table, columns in (("customers", CUSTOMER_COLUMNS), ("products", PRODUCT_COLUMNS), ("orders", ORDER_COLUMNS)):
            missing = sorted(set(columns) - set(getattr(self, table).columns))
            if missing:
                raise ValueError(f"{table} lacks columns {missing}")

    def with_tables(self, **tables: DataFrame) -> Star:
        return replace(self, **tables)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def customers_of(spark: SparkSession, folder: str) -> DataFrame:
    nation = read(spark, folder, "nation").join(
        read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        read(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").cast("long").alias("customer_id"),
            F.col("r_name").alias("region"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


def products_of(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select(
        F.col("p_partkey").cast("long").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("double").alias("base_price"),
    )


def line_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of ``lineitem`` and its orders that facts are made of, dealt by order, not numbered yet."""
    lines = read(spark, folder, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", "l_returnflag", F.monotonically_increasing_id().alias("_tie"))
    heads = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return dealt_by(lines, "l_orderkey", lines.count()).join(heads, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def line_star(spark: SparkSession, folder: str) -> Star:
    """The retail star: ``lineitem`` as fact, ``customer`` and ``part`` as dimensions.

    The customers are written once, so that joins with them are planned by their real size.
    """
    status = F.when(F.col("l_returnflag") == "N", "completed").when(F.col("l_returnflag") == "R", "refunded").otherwise("cancelled")
    # by every column there is: the file layout decides between equal rows only
    values = [F.col("o_custkey").cast("long"), F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), status]
    orders = keyed_ids(
        line_facts(spark, folder),
        LINE_KEY[0],
        [*LINE_KEY[1:], *values, "_tie"],
        "order_id",
        [
            F.col("o_custkey").cast("long").alias("customer_id"),
            F.col("l_partkey").cast("long").alias("product_id"),
            F.col("l_shipdate").alias("order_date"),
            F.col("l_quantity").cast("double").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_discount").cast("double").alias("discount"),
            status.alias("status"),
        ],
    )
    return Star(
        "retail_lines",
        stored(customers_of(spark, folder), "customers"),
        products_of(spark, folder),
        orders.select(*ORDER_COLUMNS),
        "given",
    )


def event_star(spark: SparkSession, folder: str) -> Star:
    """The events log as a second population: users and event types as dimensions."""
    events = read(spark, folder, "events")
    kinds = events.select("event_type").distinct()
    numbered = dense_ids(kinds, ["event_type"], "product_id")
    goods = stored(numbered.select("product_id", F.col("event_type").alias("category"), F.lit(1.0).alias("base_price")), "goods")
    labelled = mapped_orders(
        events.join(goods, F.col("event_type") == F.col("category")),
        {
            "order_id": F.col("event_id"),
            "customer_id": F.col("user_id"),
            "product_id": F.col("product_id"),
            "order_date": F.col("ts"),
            "unit_price": F.col("value"),
            "status": F.when(F.col("event_type") == "error", "cancelled")
            .when(F.col("event_type") == "signup", "refunded")
            .otherwise("completed"),
        },
    )
    users = events.select(F.col("user_id").cast("long").alias("customer_id")).distinct()
    region = F.element_at(F.array(*[F.lit(f"zone_{i}") for i in range(5)]), (F.col("customer_id") % 5 + 1).cast("int"))
    segment = F.element_at(F.array(*[F.lit(f"tier_{i}") for i in range(3)]), (F.col("customer_id") % 3 + 1).cast("int"))
    return Star(
        "events",
        stored(users.select("customer_id", region.alias("region"), segment.alias("segment")), "users"),
        goods,
        labelled,
        "events",
    )


def mapped_orders(fact: DataFrame, mapping: Mapping[str, Column]) -> DataFrame:
    """Any fact table as ``orders``: unmapped quantity is 1, unmapped discount 0."""
    defaults = {"quantity": F.lit(1.0), "discount": F.lit(0.0), "status": F.lit("completed")}
    full = {**defaults, **mapping}
    missing = sorted(set(ORDER_COLUMNS) - set(full))
    if missing:
        raise ValueError(f"mapping lacks columns {missing}")
    kinds = {
        "order_id": "long",
        "customer_id": "long",
        "product_id": "long",
        "quantity": "double",
        "unit_price": "double",
        "discount": "double",
        "status": "string",
    }
    return fact.select(
        *[(full[c].cast(kinds[c]) if c in kinds else full[c]).alias(c) for c in ORDER_COLUMNS]
    )


def lookup_customers(lookup: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """A lookup table as ``customers``; missing labels become 'Unknown'."""
    for old, new in renames.items():
        lookup = lookup.withColumnRenamed(old, new)
    missing = sorted(set(CUSTOMER_COLUMNS) - set(lookup.columns))
    if missing:
        raise ValueError(f"lookup lacks columns {missing}")
    return lookup.select(
        F.col("customer_id").cast("long").alias("customer_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in ("region", "segment")],
    )


def code_products(spark: SparkSession, codes: Mapping[int, str]) -> DataFrame:
    """A fixed code list as ``products``."""
    rows = [(int(code), label, 1.0) for code, label in codes.items()]
    return spark.createDataFrame(rows, "product_id long, category string, base_price double")


def range_scan(table: DataFrame, time: str, start: str, stop: str, between: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows from ``start`` up to but not at ``stop`` with other columns between bounds, both included; filters reach the scan."""
    kind = table.schema[time].dataType
    wanted = (F.col(time) >= F.lit(start).cast(kind)) & (F.col(time) < F.lit(stop).cast(kind))
    for column, (low, high) in between.items():
        wanted &= F.col(column).between(low, high)
    return table.filter(wanted)


def trip_star(
    spark: SparkSession,
    trips: str,
    zones: str,
    *,
    n_orders: int = 100_000,
    start: str = "2025-01-01",
    stop: str = "2025-02-01",
) -> Star:
    """Taxi trip records (Parquet) and a zone lookup (CSV) as a star of n_orders sampled trips."""
    if n_orders < 1_000:
        raise ValueError("n_orders must be at least 1,000")
    lookup = spark.read.csv(zones, header=True, inferSchema=True)
    customers = lookup_customers(
        lookup, {"LocationID": "customer_id", "Borough": "region", "service_zone": "segment"}
    )
    keys = ["tpep_pickup_datetime", "PULocationID", "total_amount", "trip_distance", "payment_type"]
    scanned = range_scan(spark.read.parquet(trips).select(*keys), "tpep_pickup_datetime", start, stop, {"PULocationID": (1, 265), "total_amount": (0, 1000)})
    valid = scanned.withColumn("_tie", F.monotonically_increasing_id())
    numbered = dense_ids(valid, [*keys, "_tie"], "order_id")
    sampled = hash_sample(numbered, "order_id", dice.seed_words("trips", "sample"), n_orders)
    code = F.coalesce(F.col("payment_type"), F.lit(0))
    orders = mapped_orders(
        sampled,
        {
            "order_id": F.col("order_id"),
            "customer_id": F.col("PULocationID"),
            "product_id": code,
            "order_date": F.col("tpep_pickup_datetime"),
            "unit_price": F.col("total_amount"),
            "status": F.when(F.col("payment_type") == 4, "refunded")
            .when(F.col("payment_type") == 6, "cancelled")
            .otherwise("completed"),
        },
    )
    return Star("taxi_trips", customers, code_products(spark, PAYMENT_CODES), orders, "real_taxi")
