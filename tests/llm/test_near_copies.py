"""The near-duplicate stage against brute-force groups of five-word shingles."""

import numpy as np
import pytest

import corpus_pipeline
from tarnish.llm import near_copies, similar_sets, simhash
from test_tables import ROWS, as_key


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    size = min(k, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def similarity(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def brute_kept(rows):
    """The smallest id of each component of documents that are similar at 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    while True:
        before = list(root)
        for i in range(len(rows)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    groups = {}
    for r, (doc_id, _) in zip(root, rows):
        groups.setdefault(r, []).append(doc_id)
    return [min((d for d in ids if d is not None), default=None) for ids in groups.values()]


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(10**9)}"
    return words


@pytest.fixture(scope="module")
def copies():
    """Copies from 0.6 to 1 in similarity, chains of them, and texts around the length of a shingle."""
    rng = np.random.default_rng(6)
    rows = list(ROWS)
    for base in range(20):
        words = [f"v{x}" for x in rng.integers(0, 10**6, 150)]
        for n in (0, 1, 2, 3, 4, 6, 9):
            rows.append((100 + len(rows), " ".join(edited(rng, words, n))))
    words = [f"u{x}" for x in rng.integers(0, 10**6, 150)]
    for _ in range(15):
        words = edited(rng, words, 2)
        rows.append((100 + len(rows), " ".join(words)))
    rows += [(1000 + i, t) for i, t in enumerate(["a b c d", "A  b\nc d", "a b c", "a b c d e", "a b c d e f"])]
    return rows


@pytest.mark.parametrize("members", [similar_sets.MEMBERS, 4])
def test_stage_against_brute_force(spark, monkeypatch, copies, members):
    monkeypatch.setattr(similar_sets, "MEMBERS", members)
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert as_key(r["doc_id"] for r in kept.collect()) == as_key(brute_kept(copies))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").collect() == []


def test_no_pair_at_the_threshold_stays(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    kept = [shingles(r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert max(similarity(x, y) for i, x in enumerate(kept) for y in kept[:i]) < 0.8


def test_bands_propose_pairs_at_the_threshold():
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(300):
        pool = rng.integers(0, 2**63, 100, dtype=np.uint64)
        x, y = near_copies.band_hashes([np.sort(pool[:90]), np.sort(pool[10:])])
        met += bool((x == y).any())
    assert met == 300


def test_fingerprints_propose_copies_that_share_no_band(spark, monkeypatch):
    """The stage goes through op7's grid join: without a common band its components alone lead to the copy, and the sets still decide."""
    words = [f"w{i}" for i in range(200)]
    other = [f"x{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:199], "new"])), (3, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []

    def together(points):
        found.append(points.count())
        return points.selectExpr("fp", "7L AS root")

    apart = near_copies._nodes
    monkeypatch.setattr(near_copies, "_nodes", lambda texts: apart(texts) | {"bands": [np.array([hash(t) + b for b in range(near_copies.BANDS)], dtype=np.int64) >> 1 for t in texts]})
    monkeypatch.setattr(simhash, "named_components", together)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert found == [3]
