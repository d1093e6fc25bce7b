"""Operators that judge each document on its own, and the classifier."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnish.llm import classifier, licences, quality_rules, token_files
from tarnish.llm.tokens import Encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: A null id, null and empty texts, a row that repeats, an id with two texts, and odd spacing.
ROWS = [
    (1, "Released under the MIT License. " * 2 + "one two three four five six seven\x0beight\x1cnine"),
    (1, "Released under the MIT License. " * 2 + "one two three four five six seven\x0beight\x1cnine"),
    (2, None),
    (2, "a  b \n c\t<|endoftext|> d\u00e9j\u00e0 vu\u3000x 's don't"),
    (3, ""),
    (None, "cc-by-NC\nunder the mit\u00a0license # SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath\n"),
    (4, "\n".join(["same line again"] * 9 + ["!!"])),
    (5, "x" * 70_000 + " long words " * 900),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Other columns have names that operators use themselves."""
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    return frame.select("*", *[F.lit("clash").alias(c) for c in ("n_words", "words", "score", "label", "ids", "key", "h", "row", "kept", "fp")])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_counts_against_brute_force(docs):
    got = rows_of(quality_rules.judge_documents(docs).drop("kept"))
    want = []
    for doc_id, text in ROWS:
        text = text or ""
        words = words_of(text)
        lines = [line for line in text.split("\n") if words_of(line)]
        windows = {}
        for i in range(len(words) - 4):
            windows.setdefault(tuple(words[i : i + 5]), []).append(i)
        covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed))
    assert got == sorted(want, key=repr)


def test_quality_keeps_only_what_passes_the_base(docs, nothing):
    found = quality_rules.judge_documents(docs).collect()
    assert not [r for r in found if r["kept"] and r["base_failed"]]
    assert quality_rules.judge_documents(nothing).collect() == []


def test_cascade_order_does_not_change_verdicts(spark, data):
    docs = quality_rules.with_counts(spark.read.parquet(f"{data}/documents.parquet"))
    rules = quality_rules.default_rules()
    both = docs.select(quality_rules.cascade(rules).alias("a"), quality_rules.cascade(rules[::-1]).alias("b"))
    assert both.where("a <> b").count() == 0


def test_rules_are_ordered_by_rejections_per_cost(spark, data):
    sample = quality_rules.with_counts(spark.read.parquet(f"{data}/documents.parquet")).cache()
    found = quality_rules.measured(sample, quality_rules.default_rules())
    gains = [share / cost for _, cost, share in found]
    assert gains == sorted(gains, reverse=True)


def licence_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_licence_places_against_brute_force(docs, nothing):
    got = rows_of(licences.scan_licences(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    want = []
    for doc_id, text in ROWS:
        n, places = licence_places(text)
        want.append((doc_id, n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({label for _, label in places}))))
    assert got == sorted(want, key=repr)
    assert licences.scan_licences(nothing).collect() == []


def test_licence_places_on_given_documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_base"]) for r in licences.scan_licences(table).collect()}
    for doc_id, text in table.select("doc_id", "text").collect():
        n, places = licence_places(text)
        assert got[doc_id] == (n, len(places))


@pytest.mark.parametrize(
    "expression, order",
    [
        ("MIT", ["mit"]),
        ("MIT OR Apache-2.0 AND BSD", ["mit", "apache-2.0", "bsd", "and", "or"]),
        ("(MIT OR Apache-2.0) AND BSD", ["mit", "apache-2.0", "or", "bsd", "and"]),
        ("GPL-2.0+ WITH Classpath-exception AND MIT", ["gpl-2.0+", "classpath-exception", "with", "mit", "and"]),
        ("MIT OR", None),
        ("(MIT", None),
        ("MIT)", None),
        ("MIT BSD", None),
        ("", None),
    ],
)
def test_expressions_in_postfix(expression, order):
    assert licences.postfix(expression) == order


def test_expressions_are_evaluated():
    reading = licences.evaluate("(MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath")
    assert reading.labels == {"mit", "apache-2.0", "gpl-2.0 with classpath"}
    assert reading.least == 2
    assert licences.evaluate("(MIT OR BSD) WITH x") is None


def test_tags_add_labels_and_base_labels_stay(docs):
    found = {r["doc_id"]: r for r in licences.scan_licences(docs).collect()}
    assert found[None]["base_labels"] == "cc-by-nc"
    assert set(found[None]["labels"].split(",")) >= {"cc-by-nc", "mit", "apache-2.0", "gpl-2.0 with classpath"}
    assert found[None]["score"] == 1.0
    assert found[3]["labels"] == "" and found[3]["score"] == 0.0


AWKWARD = ["  a b", " a", "a ", "a  b\n c", "\n\na b\n", "<|endoftext|> b a", "a\u3000b c", "\u00e8 \u00e9' s 's", "a\x00b c\x00 d", "", " ", "   ", "don't  we've, a!!! b.) c'", "\u0661\u0662 3 4", "a\x1c b\x85 c", "\u0120 \u0120a b\u0120", "a\u00a0 b", "\U0001f600 x"]


def test_encoder_agrees_with_the_library(spark, data):
    texts = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + AWKWARD
    library = Tokenizer.from_file(VOCABULARY)
    ours = Encoder(VOCABULARY)
    for _ in range(2):
        for text, raw in zip(texts, ours.encode(texts)):
            assert np.frombuffer(raw, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_control_and_data_bytes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 2000):
        ranks = (rng.integers(0, 2**31, n) >> rng.integers(0, 31, n)).astype(np.uint32)
        assert token_files.unpack(*token_files.pack(ranks), n).tolist() == ranks.tolist()


def test_token_files_round_trip(docs, nothing):
    got = [tuple(r) for r in token_files.token_digests(docs, VOCABULARY, 2).collect()]
    library = Tokenizer.from_file(VOCABULARY)
    ids = [(doc_id, library.encode(text or "", add_special_tokens=False).ids + [2]) for doc_id, text in ROWS]
    assert sorted((d, n, c) for d, _, n, c in got if d is not None) == sorted((d, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for d, x in ids if d is not None)
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda d: (d is not None, d))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    assert token_files.token_digests(nothing, VOCABULARY, 2).collect() == []


def test_frequent_ids_take_one_byte(spark, data):
    files = token_files.write_token_files(spark.read.parquet(f"{data}/documents.parquet"), VOCABULARY, 2)
    n, size = spark.read.parquet(files.path).agg(F.sum("n_ids"), F.sum(F.octet_length("data"))).first()
    assert size < 1.5 * n


def test_classifier_on_held_out_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = classifier.score_documents(docs, labels).join(labels, "doc_id").toPandas()
    unseen = scored[scored["held_out"]]
    assert (unseen["held_out"] == unseen["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert (unseen["predicted"] == unseen["quality"]).mean() > 0.9
    assert scored["score"].between(0, 1).all()


def test_classifier_never_learns_from_held_out_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(classifier.score_documents(docs, labels)) == rows_of(classifier.score_documents(docs, flipped))


def test_classifier_on_awkward_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, "x"), (1, None, "x"), (3, 0, "x"), (None, 1, "x"), (5, 0, "x"), (99, 1, "x")], "doc_id long, quality int, text string")
    found = classifier.score_documents(docs, labels).collect()
    assert len(found) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert classifier.score_documents(nothing, labels).collect() == []
    unlabelled = classifier.score_documents(docs, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    kept = classifier.accepted_documents(docs, labels)
    assert kept.columns == docs.columns
