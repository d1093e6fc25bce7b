"""One query per operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnish.llm.oracles import ORACLES as ORACLES
from tarnish.llm import classifier, decontamination, licences, minhash_tables, packing, quality_rules, simhash, source_audit, suffix_array, suffix_trees, token_files, url_rules, vector_codes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


#: The rules of the url query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def register(name: str) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("op1_substring_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_trees.dedup_words(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op2_decontamination")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op3_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


@register("op4_quality_rules")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf, "documents"))


@register("op5_classifier")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op6_url_rules")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.url_verdicts(table(spark, sf, "pages"), url_rules.rule_table(spark, URL_RULES))


@register("op7_simhash")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@register("op8_token_files")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@register("op9_licences")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf, "documents"))


@register("op10_suffix_array")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_array.dedup_bytes(table(spark, sf, "documents"))


@register("op11_source_audit")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return source_audit.source_divergences(table(spark, sf, "documents"))


@register("op12_vector_codes")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf, "embeddings"))


@register("op13_minhash")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_tables.minhash_duplicates(table(spark, sf, "documents"))
