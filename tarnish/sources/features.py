"""Feature tables from the given tables and from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tarnish.operators.feature_defects import Features
from tarnish.operators.sampling import dealt_by, dense_ids, keyed_ids
from tarnish.session import stored
from tarnish.sources.star import LINE_KEY, read


def price_regression(spark: SparkSession, folder: str) -> Features:
    """Extended price from quantity, discount, tax and part attributes; one row per line."""
    part = read(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    lines = read(spark, folder, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", "l_tax", F.monotonically_increasing_id().alias("_tie"))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    columns = {
        "quantity": "l_quantity",
        "discount": "l_discount",
        "tax": "l_tax",
        "part_size": "p_size",
        "retail_price": "p_retailprice",
    }
    # lines without an order come first, with the smallest of its numbers
    keyed = rows.withColumn("_order", F.coalesce(F.col(LINE_KEY[0]).cast("long"), F.lit(-(1 << 63))))
    values = {new: F.col(old).cast("double") for new, old in columns.items()}
    out = keyed_ids(
        dealt_by(keyed, "_order", lines.count()),
        "_order",
        [*LINE_KEY, *values.values(), "_tie"],
        "row_id",
        [*[v.alias(c) for c, v in values.items()], F.col("l_extendedprice").cast("double").alias("label")],
    )
    return Features(out, tuple(columns), "regression")


def embedding_classes(spark: SparkSession, folder: str, *, binary: bool = False) -> Features:
    """The elements of every embedding, with its class (or the class's parity) as label."""
    vectors = read(spark, folder, "embeddings")
    width = vectors.select(F.max(F.size("embedding"))).first()[0]
    label = F.col("label") % 2 if binary else F.col("label")
    columns = [f"e{i:02d}" for i in range(width)]
    out = vectors.select(
        F.col("vec_id").cast("long").alias("row_id"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)],
        label.cast("int").alias("label"),
    )
    return Features(out, tuple(columns), "classification")


def document_quality(spark: SparkSession, folder: str) -> Features:
    """Shape of a document's whole text, with its quality label; written, so that texts are read once."""
    docs = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    letters = F.greatest(F.length("text"), F.lit(1)).cast("double")
    digits = F.length(F.regexp_replace("text", r"[^0-9]", ""))
    upper = F.length(F.regexp_replace("text", r"[^A-Z]", ""))
    lengths = F.aggregate(words, F.lit(0), lambda total, w: total + F.length(w))
    columns = {
        "n_chars": F.col("n_chars").cast("double"),
        "n_words": F.size(words).cast("double"),
        "word_length": lengths / F.greatest(F.size(words), F.lit(1)),
        "digit_share": digits / letters,
        "upper_share": upper / letters,
    }
    out = docs.select(
        F.col("doc_id").cast("long").alias("row_id"),
        *[c.alias(name) for name, c in columns.items()],
        F.col("quality").cast("int").alias("label"),
    )
    return Features(stored(out, "document-features"), tuple(columns), "classification")


def csv_features(spark: SparkSession, path: str, target: str, task: str) -> Features:
    """A numeric CSV file with a header; all columns but ``target`` are features."""
    data = spark.read.csv(path, header=True, inferSchema=True)
    if target not in data.columns:
        raise ValueError(f"the file has no column {target!r} to predict")
    features = [f for f in data.schema.fields if f.name != target]
    text = [f.name for f in features if not isinstance(f.dataType, NumericType)]
    if text:
        raise ValueError(f"columns without numbers cannot be features: {text}")
    names = [f.name for f in features]
    return Features(_numbered(data, names, target), tuple(names), task)


def _numbered(data: DataFrame, names: list[str], target: str) -> DataFrame:
    placed = data.withColumn("_tie", F.monotonically_increasing_id())
    # by every column: a row's number does not depend on the files or splits it comes in
    return dense_ids(placed, [*names, target, "_tie"], "row_id").select("row_id", *[F.col(n).cast("double").alias(n) for n in names], F.col(target).alias("label"))
