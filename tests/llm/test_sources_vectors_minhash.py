"""Source divergences, vector codes and MinHash duplicates against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnish.llm import minhash_tables, similar_sets, source_audit, vector_codes
from test_tables import CLASHES, ROWS, as_key

MORE_CLASHES = (*CLASHES, "term", "df", "stripe", "profile", "vector", "of", "code", "node", "marks", "one", "bucket", "cluster", "block", "root")


def clashing(frame):
    return frame.select("*", *[F.lit("clash").alias(c) for c in MORE_CLASHES if c not in frame.columns])


# --- source divergences

AUDIT_ROWS = [
    ("en", "a", "The cat the DOG"),
    ("en", "a", "the the café İstanbul"),
    ("en", "b", "dog 1 dog_dog"),
    ("en", "b", None),
    ("en", "silent", None),
    ("en", None, "the cat"),
    ("de", "a", "einzig"),
    ("de", "b", ""),
    (None, "a", "null lang null"),
    (None, None, "null"),
    ("en", "a", "The cat the DOG"),
    ("fr", "long", "x" * 70_000 + " " + "mot " * 30_000),
    ("fr", "short", "mot"),
]


def brute_divergences(rows, least_docs, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= least_docs]
        counts = defaultdict(Counter)
        for of, source, terms in docs:
            if of == lang:
                counts[source].update(t for t in terms if t in set(kept))
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = p(whole)
        for source, own in counts.items():
            mine = p(own)
            pairs = [(sum(abs(mine[t] - p(other)[t]) for t in kept), item) for item, other in counts.items() if item != source]
            terms = [(mine[t] - q[t], t) for t in kept if own[t] and mine[t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return out


@pytest.mark.parametrize(("least_docs", "top", "entries"), [(1, 50, 400_000), (2, 1, 1), (3, 50, 5), (99, 50, 400_000)])
def test_divergences_against_brute_force(spark, monkeypatch, least_docs, top, entries):
    monkeypatch.setattr(source_audit, "ENTRIES", entries)
    docs = clashing(spark.createDataFrame(AUDIT_ROWS, "lang string, source string, text string"))
    got = source_audit.source_divergences(docs, least_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert as_key(map(tuple, got.collect())) == as_key(brute_divergences(AUDIT_ROWS, least_docs, top))
    assert source_audit.source_divergences(docs.limit(0), least_docs, top).collect() == []


def test_stripes_spill_and_start_anew(monkeypatch):
    stripes = source_audit.Stripes()
    for source, text in (("a", b"One two two"), ("b", b"two 3 three")):
        stripes.fold("en", source, text)
    rows = {r["term"]: (r["df"], dict(zip(r["sources"], r["counts"]))) for batch in stripes.spill() for r in batch.to_pylist()}
    assert rows == {"one": (1, {"a": 1}), "two": (2, {"a": 2, "b": 1}), "three": (1, {"b": 1})}
    assert not stripes.documents and list(stripes.spill()) == []
    monkeypatch.setattr(source_audit, "TERM_BYTES", 10)
    for _ in range(3):
        stripes.fold("en", "a", b"word")
    assert not stripes.full()
    stripes.fold("en", "a", b"longer words")
    assert stripes.full()


@given(st.lists(st.tuples(st.integers(0, 10**13), st.integers(0, 10**6)), min_size=1, max_size=20))
@settings(deadline=None)
def test_portions_are_exact(cells):
    counts = np.array([c for c, _ in cells])
    total = counts.sum()
    for n_terms in {len(cells), len(cells) + cells[0][1]}:
        assert source_audit.portions(counts, total, n_terms).tolist() == [1 + 10**9 * (int(c) + 5) // (int(total) + 5 * n_terms) for c in counts]


# --- vector codes


def brute_codes(rows, n_parts, n_entries, rounds):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(x * 256)) for x in r[1]] for r in kept]
    width = len(whole[0]) // n_parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(n_parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(n_entries, len(cut)))] for p in range(n_parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = defaultdict(list)
            for v in cut:
                of[nearest(v[p], book)[1]].append(v[p])
            books[p] = [tuple(sum(c) // len(c) for c in zip(*of[i])) if of[i] else e for i, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = []
    for r, v in zip(kept, cut):
        near = [nearest(v[p], books[p]) for p in range(n_parts)]
        coded.append((r[0], r[2], "".join(f"{i:02x}" for _, i in near), sum(d for d, _ in near)))
    sums = Counter()
    for _, label, _, error in coded:
        sums[label] += error
    return [(i, code, error, sums[label], digest) for i, label, code, error in coded]


@pytest.mark.parametrize("scale", [0.005, 1.0, 1000.0])
def test_codes_against_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(0, scale, (150, 32)) * rng.integers(0, 2, (150, 1))).tolist()
    rows = [(i // 2 if i % 2 else i, v, None if i % 7 == 0 else i % 3) for i, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [None] + [0.5] * 31, 1), (202, [float("nan")] * 32, 1), (203, [float("-inf")] * 32, 1), (None, vectors[3], 2), (5, vectors[9], 2), (5, vectors[9], 2)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = vector_codes.vector_codes(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert as_key(map(tuple, got.collect())) == as_key(brute_codes(rows, 16, 64, 2))
    few = frame.where("vec_id < 4")
    assert as_key(map(tuple, vector_codes.vector_codes(few).collect())) == as_key(brute_codes([r for r in rows if r[0] is not None and r[0] < 4], 16, 64, 2))


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [0.5] * 16, None), (2, [0.5] * 15, None), (3, [], 1), (4, [3e38] * 16, 1), (5, [0.25] * 16, 1)]
    got = {r["vec_id"]: r for r in vector_codes.vector_codes(spark.createDataFrame(rows, schema)).collect()}
    assert {i for i, r in got.items() if r["code"] is None} == {2, 3, 4}
    assert got[1]["label_error"] == got[2]["label_error"] == got[1]["error"] == 0
    only = vector_codes.vector_codes(spark.createDataFrame(rows[1:3], schema)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in only] == [(None, None, None)] * 2


@pytest.mark.parametrize("seed", range(30))
def test_tree_finds_the_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.integers(1, 6))
    points = rng.integers(-9, 10, (int(rng.integers(1, 300)), width)) * int(rng.choice([1, 10**7]))
    queries = np.concatenate([rng.integers(-12, 13, (400, width)) * int(rng.choice([1, 10**7])), points])
    index, least = vector_codes.Gnat(points).nearest(queries)
    whole = vector_codes.squared(queries, points)
    assert (index == whole.argmin(axis=1)).all() and (least == whole.min(axis=1)).all()


def test_tree_rules_out_subtrees():
    rng = np.random.default_rng(0)
    tree = vector_codes.Gnat(rng.integers(-2000, 2000, (256, 2)))
    tree.nearest(rng.integers(-2000, 2000, (5000, 2)))
    assert tree.computed < 0.25 * 256 * 5000


def test_integer_roots():
    squares = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 31) ** 2, 3037000499**2 // 2, (1 << 62) - 1])
    assert (vector_codes.floor_roots(squares) ** 2 <= squares).all() and ((vector_codes.floor_roots(squares) + 1).astype(object) ** 2 > squares.astype(object)).all()
    assert vector_codes.ceil_roots(np.array([0, 1, 2, 4, 5])).tolist() == [0, 1, 2, 2, 3]


# --- MinHash duplicates


def shingles(text, k):
    words = (text or "").encode().lower().split()
    size = min(k, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute_duplicates(rows, k=4):
    sets = [shingles(text, k) for _, text in rows]
    root = list(range(len(rows)))
    while True:
        before = list(root)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    ids = defaultdict(list)
    for r, (doc_id, _) in zip(root, rows):
        ids[r].append(doc_id)
    least = {r: min((d for d in of if d is not None), default=None) for r, of in ids.items()}
    return [(d, len(s), least[r], d == least[r]) for (d, _), s, r in zip(rows, sets, root)]


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(10**9)}"
    return words


def copies(seed, groups, edits, length=120):
    rng = np.random.default_rng(seed)
    rows = list(ROWS)
    for _ in range(groups):
        words = [f"v{x}" for x in rng.integers(0, 10**6, length)]
        rows += [(100 + len(rows) + i, " ".join(edited(rng, words, n))) for i, n in enumerate(edits)]
    words = [f"u{x}" for x in rng.integers(0, 10**6, length)]
    for _ in range(12):  # a chain whose ends have nothing in common
        words = edited(rng, words, 2)
        rows.append((100 + len(rows), " ".join(words)))
    return rows + [(1000 + i, t) for i, t in enumerate(["a b c", "A  b\nc", "a b", "a b c d", "a b c d e", " \t"])] + [(2000, "y" * 70_000), (2001, "y" * 70_000)]


@pytest.mark.parametrize("members", [2048, 5])
def test_duplicates_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(similar_sets, "MEMBERS", members)
    rows = copies(4, 8, (0, 0, 1, 2, 3, 4, 5, 6, 8, 10))
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = minhash_tables.minhash_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert as_key(map(tuple, got.collect())) == as_key(brute_duplicates(rows))
    assert minhash_tables.minhash_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("members", [10_000, 12])
def test_large_group_of_near_copies(spark, monkeypatch, members):
    """Copies near the threshold of each other, dealt into blocks: the same components as of all pairs."""
    monkeypatch.setattr(similar_sets, "MEMBERS", members)
    rows = copies(5, 1, [int(n) for n in np.random.default_rng(1).integers(1, 6, 150)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_key(map(tuple, minhash_tables.minhash_duplicates(docs).collect())) == as_key(brute_duplicates(rows))


def test_comparisons_grow_with_the_group():
    """Sets compared with sets: about one for each copy, not one for each pair."""
    rng = np.random.default_rng(2)
    base = [f"v{x}" for x in rng.integers(0, 10**6, 120)]
    asked = {}

    class Counted(similar_sets.Likeness):
        def meets(self, marks, one):
            asked[n] = asked.get(n, 0) + len(marks)
            return super().meets(marks, one)

    for n in (150, 300, 600):
        sets = [minhash_tables.word_set(" ".join(edited(rng, base, int(rng.integers(1, 4))))) for _ in range(n)]
        likeness = Counted(minhash_tables.word_set, (80, 100), (minhash_tables.HALVES,) * 2)
        root = similar_sets.Sets(likeness, sets, minhash_tables.half_keys(sets)).reached()
        assert (root == 0).all()
    assert asked[600] < 6 * asked[150] and asked[600] < 600 * 600 / 20


def test_tables_propose_pairs_at_the_threshold():
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(300):
        pool = rng.integers(0, 2**63, 180, dtype=np.uint64)
        sets = [np.sort(pool[:160]), np.sort(pool[20:])]  # 140 of 180
        x, y = minhash_tables.half_keys(sets)
        half = minhash_tables.HALVES
        met += bool((x[:half] == y[:half]).any() and (x[half:] == y[half:]).any())
    assert met >= 299  # similarity 0.78, a little under the threshold


def test_key_tables_are_pairs_of_half_keys(spark):
    half = minhash_tables.HALVES
    rows = [(1, [*range(half), *range(100, 100 + half)]), (2, [*range(half), *range(200, 200 + half)]), (3, [*range(50, 50 + half), *range(100, 100 + half)])]
    nodes = spark.createDataFrame(rows, "node long, marks array<long>")
    gathered = nodes.selectExpr("explode(slice(marks, 1, 2)) AS bucket", "node", "node AS root")
    got = minhash_tables.table_rows(gathered, nodes).collect()
    assert Counter(r["node"] for r in got) == dict.fromkeys((1, 2, 3), 2 * half)
    assert len({r["bucket"] for r in got}) == 6 * half  # no two of these share a whole key
