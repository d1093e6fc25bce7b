"""Bounded losses: how far an observed answer or prediction is from the trusted one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.operators.quantiles import exact_quantiles
from tarnish.plans.workload import Query, SqlQuery, keys_of, query_weights, values_of

GUARD = 1e-12
TASKS = ("classification", "regression")


def align_answers(reference: DataFrame, observed: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer alignment on the keys as text; a missing side or value counts as 0."""
    if not keys:
        # answers without keys have one row each: put both into one row
        left = reference.select(*[F.col(v).cast("double").alias(f"{v}_ref") for v in values])
        right = observed.select(*[F.col(v).cast("double").alias(f"{v}_obs") for v in values])
        both = left.unionByName(right, allowMissingColumns=True)
        joined = both.agg(*[F.max(c).alias(c) for c in both.columns])
        heads = []
    else:
        left = reference.select(
            *[F.col(k).cast("string").alias(f"{k}_l") for k in keys], *[F.col(v).alias(f"{v}_ref") for v in values]
        )
        right = observed.select(
            *[F.col(k).cast("string").alias(f"{k}_r") for k in keys], *[F.col(v).alias(f"{v}_obs") for v in values]
        )
        match = F.lit(True)
        for k in keys:
            match = match & F.col(f"{k}_l").eqNullSafe(F.col(f"{k}_r"))
        joined = left.join(right, match, "full_outer")
        heads = [F.coalesce(f"{k}_l", f"{k}_r").alias(k) for k in keys]
    filled = [F.coalesce(F.col(f"{v}_{s}").cast("double"), F.lit(0.0)).alias(f"{v}_{s}") for v in values for s in ("ref", "obs")]
    return joined.select(*heads, *filled)


def relative_error(reference: Column, observed: Column) -> Column:
    """Aggregate: sum of absolute errors over sum of absolute truth, at most 1."""
    wrong, truth = F.sum(F.abs(observed - reference)), F.sum(F.abs(reference))
    return F.coalesce(F.least(F.lit(1.0), wrong / (truth + F.lit(GUARD))), F.lit(0.0))


def answer_loss(reference: DataFrame, observed: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row: the mean relative error over the value columns."""
    aligned = align_answers(reference, observed, keys, values)
    errors = [relative_error(F.col(f"{v}_ref"), F.col(f"{v}_obs")).alias(f"e{i}") for i, v in enumerate(values)]
    total = sum((F.col(f"e{i}") for i in range(len(values))), F.lit(0.0))
    return aligned.agg(*errors).select((total / F.lit(float(len(values)))).alias("loss"))


def query_losses(
    reference: Mapping[str, DataFrame], observed: Mapping[str, DataFrame], workload: Sequence[Query | SqlQuery]
) -> DataFrame:
    """One row (query, loss) per query."""
    parts = None
    for q in workload:
        loss = answer_loss(reference[q.name], observed[q.name], keys_of(q), values_of(q))
        part = loss.select(F.lit(q.name).alias("query"), "loss")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def weight_column(query: Column, weights: Mapping[str, float]) -> Column:
    chosen = None
    for name, weight in weights.items():
        chosen = F.when(query == name, F.lit(weight)) if chosen is None else chosen.when(query == name, F.lit(weight))
    return chosen


def weighted_risk(losses: DataFrame, weights: Mapping[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Weighted sum of query losses per group, with the single losses as a map."""
    pair = F.struct(F.col("query"), F.col("loss"))
    return losses.groupBy(*groups).agg(
        F.sum(weight_column(F.col("query"), weights) * F.col("loss")).alias("loss"),
        F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("query_losses"),
    )


def workload_risk(
    reference: Mapping[str, DataFrame],
    observed: Mapping[str, DataFrame],
    workload: Sequence[Query | SqlQuery],
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row: the workload's risk and its per-query losses."""
    resolved = query_weights([q.name for q in workload], weights)
    return weighted_risk(query_losses(reference, observed, workload), resolved)


def label_scale(rows: DataFrame, label: str = "label") -> float:
    """Spread of the true labels: interquartile range, else standard deviation, else 1."""
    low, high = exact_quantiles(rows, [label], [0.25, 0.75])[label]
    if low is not None and high - low > GUARD:
        return high - low
    deviation = rows.agg(F.stddev_pop(label)).first()[0]
    return deviation if deviation is not None and deviation > GUARD else 1.0


def prediction_loss(
    predictions: DataFrame,
    task: str,
    label: str = "label",
    prediction: str = "prediction",
    scale: float | None = None,
) -> DataFrame:
    """One row: share of wrong classes, or mean error in units of the labels' spread, at most 1 per row."""
    if task not in TASKS:
        raise ValueError(f"task must be one of {TASKS}")
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    if task == "classification":
        return predictions.agg(F.avg((y != p).cast("double")).alias("loss"))
    scale = label_scale(predictions, label) if scale is None else scale
    return predictions.agg(F.avg(F.least(F.abs(p - y) / F.lit(scale), F.lit(1.0))).alias("loss"))
