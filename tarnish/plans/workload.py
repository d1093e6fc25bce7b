"""Declared workloads: grouped aggregates over the star, in a form the one-pass surface can rewrite."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.sources.star import Star

NET = "quantity * unit_price * (1.0 - discount)"
DIMENSION_KEYS = {"customers": "customer_id", "products": "product_id"}
AGGREGATES = ("sum", "avg", "count", "distinct")


@dataclass(frozen=True)
class Query:
    """One grouped aggregate: ``aggregate(measure)`` by ``key`` over orders joined with ``joins``.

    ``key``, ``measure`` and ``where`` are SQL expressions over star columns. A
    key of kind ``date`` is grouped as a date, of kind ``text`` as a string.
    """

    name: str
    key: str
    key_name: str
    aggregate: str
    value: str
    measure: str = "1.0"
    where: str | None = None
    joins: tuple[str, ...] = ()
    kind: str = "text"

    def __post_init__(self) -> None:
        if self.aggregate not in AGGREGATES:
            raise ValueError(f"aggregate must be one of {AGGREGATES}")
        if self.kind not in ("text", "date"):
            raise ValueError("kind must be text or date")
        if set(self.joins) - set(DIMENSION_KEYS):
            raise ValueError(f"joins must be among {sorted(DIMENSION_KEYS)}")

    def reads(self, text: str | None = None) -> set[str]:
        texts = [text] if text is not None else [self.key, self.measure, self.where or ""]
        return {word for t in texts for word in re.findall(r"[A-Za-z_]\w*", t)}


@dataclass(frozen=True)
class SqlQuery:
    """Any SQL text over tables named orders, customers and products.

    ``columns`` may name all columns that the text uses: combinations that differ only in damage to
    others are then run once. Without it every combination is run.
    """

    name: str
    sql: str
    keys: tuple[str, ...]
    values: tuple[str, ...]
    columns: tuple[str, ...] | None = None


def star_workload() -> tuple[Query, ...]:
    done = "status = 'completed'"
    return (
        Query("revenue_region", "region", "region", "sum", "revenue", NET, done, ("customers",)),
        Query("revenue_month", "trunc(order_date, 'MM')", "month", "sum", "revenue", NET, done, kind="date"),
        Query("revenue_category", "category", "category", "sum", "revenue", NET, done, ("products",)),
        Query("aov_segment", "segment", "segment", "avg", "avg_value", NET, done, ("customers",)),
        Query(
            "refund_region",
            "region",
            "region",
            "avg",
            "refund_rate",
            "CASE WHEN status = 'refunded' THEN 1.0D ELSE 0.0D END",
            None,
            ("customers",),
        ),
        Query("orders_status", "status", "status", "count", "order_count"),
        Query("customers_region", "region", "region", "distinct", "customers", "customer_id", None, ("customers",)),
        Query("daily_revenue", "to_date(order_date)", "day", "sum", "revenue", NET, done, kind="date"),
    )


def value_of(query: Query) -> Column:
    measure = F.expr(query.measure)
    if query.aggregate == "sum":
        return F.sum(measure)
    if query.aggregate == "avg":
        return F.avg(measure)
    if query.aggregate == "count":
        return F.count(F.lit(1)).cast("double")
    return F.count_distinct(measure).cast("double")


def run_query(star: Star, query: Query) -> DataFrame:
    """The answer of one query on one star, in the order of its key."""
    rows = star.orders
    for table in query.joins:
        rows = rows.join(getattr(star, table), DIMENSION_KEYS[table])
    if query.where:
        rows = rows.filter(F.expr(query.where))
    return rows.groupBy(F.expr(query.key).alias(query.key_name)).agg(value_of(query).alias(query.value)).orderBy(query.key_name)


def run_sql(star: Star, query: SqlQuery) -> DataFrame:
    """The answer of any SQL text, with the star's tables under their plain names.

    The plain names are common table expressions over one-off views, so no view
    of the caller's session is touched.
    """
    spark = star.orders.sparkSession
    tag = uuid.uuid4().hex
    heads = []
    for table in ("orders", "customers", "products"):
        view = f"tarnish_{table}_{tag}"
        getattr(star, table).createOrReplaceTempView(view)
        heads.append(f"{table} AS (SELECT * FROM {view})")
    try:
        return spark.sql(f"WITH {', '.join(heads)} SELECT * FROM ({query.sql}) AS answer")
    finally:
        for table in ("orders", "customers", "products"):
            spark.catalog.dropTempView(f"tarnish_{table}_{tag}")


def run(star: Star, query: Query | SqlQuery) -> DataFrame:
    return run_sql(star, query) if isinstance(query, SqlQuery) else run_query(star, query)


def keys_of(query: Query | SqlQuery) -> tuple[str, ...]:
    return query.keys if isinstance(query, SqlQuery) else (query.key_name,)


def values_of(query: Query | SqlQuery) -> tuple[str, ...]:
    return query.values if isinstance(query, SqlQuery) else (query.value,)


def execute_workload(star: Star, workload: Sequence[Query | SqlQuery] | None = None) -> dict[str, DataFrame]:
    return {q.name: run(star, q) for q in (workload or star_workload())}


def long_answers(star: Star, workload: Sequence[Query | SqlQuery] | None = None) -> DataFrame:
    """All answers as one table (query, key, measure, value); several keys are joined by '|'."""
    parts = None
    for q in workload or star_workload():
        answer = run(star, q)
        keys = [F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys_of(q)]
        key = F.concat_ws("|", *keys) if keys else F.lit("")
        stacked = answer.select(
            F.lit(q.name).alias("query"),
            key.alias("key"),
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value"))
                        for v in values_of(q)
                    ]
                )
            ),
        )
        parts = stacked if parts is None else parts.unionByName(stacked)
    return parts


def query_weights(names: Sequence[str], weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Declared weights, normalized to 1; equal by default."""
    names = list(names)
    if weights is None:
        return {name: 1.0 / len(names) for name in names}
    unknown = sorted(set(weights) - set(names))
    if unknown:
        raise ValueError(f"no such query in the workload: {unknown}")
    full = {name: float(weights.get(name, 0.0)) for name in names}
    if min(full.values()) < 0:
        raise ValueError(f"a weight below zero: {min(full.values())}")
    total = sum(full.values())
    if total <= 0:
        raise ValueError("all weights are zero")
    return {name: w / total for name, w in full.items()}
