"""Registered queries against their SQL, and the pipeline against brute force, on the given tables."""

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import connect, difference
from tarnish.llm import oracles
from tarnish.session import stored
from pyspark.sql import functions as F

from test_near_copies import brute_kept
from test_tables import CLASHES, as_key, brute_contained, check_packing, covered


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    got = queries()[name](spark, data).toPandas()
    assert difference(got, connect(data).execute(oracle_sql()[name]).fetchdf()) == ""


def test_every_operator_is_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries()


def test_pipeline_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows_in = lambda frame: [(r["doc_id"], r["text"]) for r in frame.collect()]
    before = rows_in(docs)
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data), name)
        results[name] = docs
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    accepted = dict(rows_in(results["quality"]))
    told = [(accepted.get(d) is not None) == bool(q) for d, q in quality.items()]
    assert np.mean(told) > 0.9 and accepted.items() <= dict(before).items()

    deduped = rows_in(results["near_dedup"])
    assert as_key(d for d, _ in deduped) == as_key(brute_kept(rows_in(results["quality"])))

    deduped.sort()
    marks = covered([t.encode() for _, t in deduped], 200)
    cut = {d: bytes(b for b, m in zip(t.encode(), ms) if not m).decode(errors="ignore") for (d, t), ms in zip(deduped, marks)}
    passages = rows_in(results["passage_dedup"])
    assert dict(passages) == cut

    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {w[0] for w in brute_contained(passages, items)}
    assert as_key(rows_in(results["decontamination"])) == as_key(p for p in passages if p[0] not in hit)

    for name in list(results)[:-1]:
        assert results[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    packed = results["packing"].toPandas()
    used = check_packing(packed, 2048)
    assert set(packed["doc_id"]) == {d for d, _ in rows_in(results["decontamination"])}
    assert used <= 1.02 * (-(-packed["length"].sum() // 2048)) + 1


def test_pipeline_of_no_documents_and_of_clashing_columns(spark, data, tmp_path):
    """Stages keep all columns, whatever they are called; an empty table gives an empty one."""
    table = spark.read.parquet(f"{data}/documents.parquet")
    named = table.limit(40).select("*", *[F.lit("clash").alias(c) for c in (*CLASHES, "score", "node", "marks", "cluster")])
    for docs in (named, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, data), name)
            if name != "packing":
                assert out.columns == docs.columns
            docs = out
    assert docs.isEmpty()
