"""URL filters: a sort-merge range join of urls with prefix rules, in DataFrame operations only.

A rule is a host and a path. With the labels of the host reversed, ``example.org`` + ``/es/``
becomes the key (``org.example``, ``/es/``), and the urls that it fits are those of one interval
of keys: all that start with it. A url has one key per rule depth (``org``, ``org.example``, ...).
Keys and rules are sorted together; the sweep over a host's keys holds the rules whose intervals
are open. Open rules nest, so they are a stack: slot d of it is the last rule of nesting depth d
that started, and a slot counts while the key still starts with its rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnish.session import small_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; it starts with ``/`` or is empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) of a list of rules."""
    return small_table(spark, rules, "verdict string, host string, path string")


def nested_rules(rules: DataFrame) -> DataFrame:
    """Rules with their key, label count and nesting depth: how many other rules of the host are prefixes of the path.

    Repeated rules count once; if verdicts of a rule contradict each other, ``block`` wins.
    """
    keyed = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            _reversed_host(F.split("host", r"\.")).alias("key"),
            F.size(F.split("host", r"\.")).alias("labels"),
            F.concat("host", "path").alias("rule"),
            "path",
            "verdict",
        )
    )
    prefixes = keyed.select("key", "rule", F.explode(F.sequence(F.lit(0), F.length("path") - F.lit(1))).alias("n"), "path").where("n >= 0 AND n < length(path)")
    above = (
        prefixes.select("key", "rule", F.expr("left(path, n)").alias("path"))
        .join(keyed.select("key", "path"), ["key", "path"])
        .groupBy("rule")
        .agg(F.count("*").alias("depth"))
    )
    return keyed.join(above, "rule", "left").withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int"))


def match_rules(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", salts: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``urls``; rule and verdict are null where no rule fits.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The
    longest rule (host and path together, then the host) wins. Null urls and urls without ``://``
    have an empty host and path. Repeated rows stay repeated, null ids are ids, other columns are
    ignored. ``salts`` deals the keys of a host over so many sorted runs, each of which sees all
    the host's rules; it defaults to the session's number of shuffle partitions.
    """
    spark = urls.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ruled = nested_rules(rules)
    depths, labels = ruled.agg(F.coalesce(F.max("depth"), F.lit(0)), F.coalesce(F.max("labels"), F.lit(0))).first()
    rows = urls.groupBy(F.col(id_column).alias("id"), F.col(url_column).alias("url")).agg(F.count("*").alias("copies"))
    pages = rows.select("id", "url", "copies", url_host(F.coalesce("url", F.lit(""))).alias("host"), url_path(F.coalesce("url", F.lit(""))).alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size("parts"), F.greatest(F.lit(labels), F.lit(1)))),
        lambda n: _reversed_host(F.slice("parts", F.size("parts") - n + 1, n)),
    )
    probes = (
        pages.withColumn("parts", parts)
        .withColumn("key", F.explode(suffixes))
        .drop("parts")
        .withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
        .withColumn("open", F.lit(None).cast("struct<path:string,rule:string,labels:int,verdict:string,depth:int>"))
    )
    starts = ruled.select(
        F.lit(None).cast(urls.schema[id_column].dataType).alias("id"),
        F.lit(None).cast("string").alias("url"),
        F.lit(0).cast("long").alias("copies"),
        F.lit(None).cast("string").alias("host"),
        "path",
        "key",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.struct("path", "rule", "labels", "verdict", "depth").alias("open"),
    )
    sweep = Window.partitionBy("key", "salt").orderBy("path", F.col("open").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = probes.unionByName(starts)
    stack = [F.last(F.when(F.col("open.depth") == d, F.col("open")), ignorenulls=True).over(sweep).alias(f"slot{d}") for d in range(depths + 1)]
    swept = both.select("*", *stack).where("open IS NULL")
    inner = F.coalesce(*[F.when(F.col("path").startswith(F.col(f"slot{d}.path")), F.col(f"slot{d}")) for d in reversed(range(depths + 1))])
    best = F.max(F.when(F.col("inner").isNotNull(), F.struct(F.length("inner.rule"), F.col("inner.labels"), F.col("inner.rule").alias("rule"), F.col("inner.verdict").alias("verdict"))))
    return (
        swept.select("id", "url", "copies", "host", "path", inner.alias("inner"))
        .groupBy("id", "url", "copies", "host", "path")
        .agg(best.alias("best"))
        .select("id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .drop("copy")
        .withColumnRenamed("id", id_column)
    )


def url_verdicts(urls: DataFrame, rules: DataFrame, default: str = "allow", **columns) -> DataFrame:
    """``match_rules``, with ``default`` as the verdict where no rule fits."""
    return match_rules(urls, rules, **columns).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
