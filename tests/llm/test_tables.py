"""Operators that look across documents: duplicates, passages, test items, packing, urls."""

import hashlib
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnish.llm import decontamination, packing, repeats, simhash, suffix_array, suffix_trees, url_rules
from tarnish.llm.components import component_roots

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PASSAGE = " ".join(f"word{i % 40}x{i}" for i in range(60))
CLASHES = ("n", "h", "at", "kept", "row", "key", "fp", "item", "hash", "ka", "spans", "c_id", "c_key", "text_key", "guessed")


def own(i, n=50):
    return " ".join(f"w{(i * 7919 + j * j * 31) % 100_003}" for j in range(n))


ROWS = [
    (1, f"{own(1)} {PASSAGE} {own(2)}"),
    (2, f"{own(3)}\n{PASSAGE}\t{own(4)}"),
    (3, f"{PASSAGE}"),
    (4, own(5, 300)),
    (5, own(5, 300)),
    (5, own(5, 300)),
    (6, own(5, 299) + " other"),
    (7, None),
    (8, ""),
    (9, "short text"),
    (None, f"{own(7)} {PASSAGE}"),
    (None, None),
    (10, "ab" * 400),
    (11, "\u00e9\u00e8" * 200 + "A" + own(8)),
    (12, "z" + "\u00e9\u00e8" * 200 + "B" + own(9)),
    (13, " ".join(["again"] * 120)),
    (3, own(11)),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    return frame.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def as_key(values):
    return sorted(map(repr, values))


def covered(sequences, width):
    places = {}
    for s, seq in enumerate(sequences):
        for i in range(len(seq) - width + 1):
            places.setdefault(tuple(seq[i : i + width]) if isinstance(seq, list) else seq[i : i + width], []).append((s, i))
    marks = [bytearray(len(seq)) for seq in sequences]
    for found in places.values():
        if len(found) > 1:
            for s, i in found:
                marks[s][i : i + width] = b"\1" * width
    return marks


def runs_of(marks):
    return sum(1 for i in range(len(marks)) if marks[i] and (i == 0 or not marks[i - 1]))


def without_words(rows, width=35):
    lists = [(text or "").encode().split() for _, text in rows]
    out = []
    for (doc_id, _), words, marks in zip(rows, lists, covered(lists, width)):
        left = b" ".join(w for w, m in zip(words, marks) if not m)
        out.append((doc_id, len(words), sum(marks), runs_of(marks), hashlib.sha256(left).hexdigest()))
    return out


def without_bytes(rows, width=200):
    raws = [(text or "").encode() for _, text in rows]
    out = []
    for (doc_id, _), raw, marks in zip(rows, raws, covered(raws, width)):
        left = bytes(b for b, m in zip(raw, marks) if not m)
        out.append((doc_id, len(raw), sum(marks), runs_of(marks), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [4000, 1])
def test_word_windows_against_brute_force(docs, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    assert as_key(map(tuple, suffix_trees.dedup_words(docs).collect())) == as_key(without_words(ROWS))


@pytest.mark.parametrize("crowded", [4000, 1])
def test_byte_strings_against_brute_force(docs, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    assert as_key(map(tuple, suffix_array.dedup_bytes(docs).collect())) == as_key(without_bytes(ROWS))


def test_repeats_of_given_documents(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    assert as_key(map(tuple, suffix_array.dedup_bytes(table).collect())) == as_key(without_bytes(rows))
    assert as_key(map(tuple, suffix_trees.dedup_words(table).collect())) == as_key(without_words(rows))


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_random_sequences(spark, seed, monkeypatch):
    """Few symbols, many partial repeats: every shape of shared left and right context."""
    rng = np.random.default_rng(seed)
    pool = [[f"s{x}" for x in rng.integers(0, 3, 60)] for _ in range(3)]
    rows = []
    for i in range(40):
        words = []
        while len(words) < 90:
            source = pool[rng.integers(0, 3)]
            a = rng.integers(0, 50)
            words += source[a : a + rng.integers(3, 25)]
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(repeats, "CROWDED", int(rng.integers(2, 30)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_key(map(tuple, suffix_trees.dedup_words(frame, width=12, k=4).collect())) == as_key(without_words(rows, 12))
    assert as_key(map(tuple, suffix_array.dedup_bytes(frame, width=40, k=10).collect())) == as_key(without_bytes(rows, 40))


def test_repeats_without_rows(nothing):
    assert suffix_trees.dedup_words(nothing).collect() == []
    assert suffix_array.dedup_bytes(nothing).collect() == []


def test_interval_tree_lists_nested_ranges():
    assert sorted(suffix_array.intervals(np.array([0, 5, 7, 7, 5, 0, 3]), 4)) == [(0, 4, 5), (1, 3, 7)]
    assert suffix_array.intervals(np.array([0]), 1) == []


def test_documents_lose_whole_characters(docs):
    kept = {r["doc_id"]: r["text"] for r in suffix_array.documents_without_repeats(docs).collect()}
    assert suffix_array.documents_without_repeats(docs).columns == docs.columns
    assert kept[9] == "short text" and kept[4] == kept[5] == ""
    assert kept[11] == "A" + own(8) and kept[12] == "zB" + own(9)


def brute_groups(rows):
    """Fingerprints, and rows by the first row of their component."""
    prints = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(prints)))
    while True:
        before = list(root)
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    ids = {}
    for r, (doc_id, _) in zip(root, rows):
        ids.setdefault(r, []).append(doc_id)
    return prints, root, {r: min((d for d in found if d is not None), default=None) for r, found in ids.items()}


def brute_components(rows):
    prints, root, least = brute_groups(rows)
    return [(doc_id, f"{p:016x}", least[r]) for (doc_id, _), p, r in zip(rows, prints, root)]


def test_components_against_brute_force(docs, nothing):
    assert as_key(map(tuple, simhash.near_duplicates(docs).collect())) == as_key(brute_components(ROWS))
    assert simhash.near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("crowded", [2048, 4, 1])
def test_links_join_what_all_pairs_join(spark, monkeypatch, crowded):
    """Chains and crowds of fingerprints; crowded cells are dealt anew, also twice."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    prints = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)}
    for base in list(prints)[:12]:
        at = base & 0xFFFFFFFFFFFFFFFF
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                at ^= 1 << int(b)
            prints.add(at - (1 << 64) if at >> 63 else at)
    prints = sorted(prints)
    points = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.named_components(points).collect()}
    unsigned = np.array(prints, dtype=np.int64).view(np.uint64)
    root = np.arange(len(prints))
    near = np.bitwise_count(unsigned[:, None] ^ unsigned) <= 3
    while True:
        low = np.where(near, root, len(root)).min(axis=1)
        if (low == root).all():
            break
        root = low
    for r in set(root):
        members = [p for p, x in zip(prints, root) if x == r]
        assert {got[m] for m in members} == {min(members)}


def test_distance_of_segment_counts_is_a_lower_bound(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63 - 1, (200, 2))]
    frame = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.segment_counts(F.col("a")).alias("x"), simhash.segment_counts(F.col("b")).alias("y"))
    for a, b, x, y in frame.collect():
        fields = lambda v: [(v >> s) & 3 for s in range(0, 64, 2)]
        assert fields(x) == [((a >> s) & 1) + ((a >> (s + 1)) & 1) for s in range(0, 64, 2)]
        assert sum(abs(p - q) for p, q in zip(fields(x), fields(y))) <= ((a ^ b) & (2**64 - 1)).bit_count()


def test_components_of_a_long_chain(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted(map(tuple, component_roots(links).collect())) == [(i, 0) for i in range(1, 61)]
    assert component_roots(links.limit(0)).collect() == []


def test_one_document_of_each_component_stays(docs):
    kept = simhash.documents_without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert as_key(r["doc_id"] for r in kept.collect()) == as_key(brute_groups(ROWS)[2].values())


ITEMS = [(1, PASSAGE, "x"), (1, PASSAGE, "x"), (2, " ".join(PASSAGE.upper().split()[:30]), "x"), (3, own(1, 50) + " " + own(20, 13), "x"), (4, own(1, 50) + " " + own(21, 12), "x"), (5, "four words are few", "x"), (6, None, "x"), (None, own(3), "x"), (7, "", "x"), (8, "again again again again again", "x")]


def brute_contained(rows, items):
    shingles = lambda text: {tuple(w[i : i + 5]) for w in [(text or "").lower().split()] for i in range(len(w) - 4)}
    found = set()
    for doc_id, text in rows:
        for item_id, item, *_ in items:
            wanted = shingles(item)
            shared = len(wanted & shingles(text))
            if wanted and 5 * shared >= 4 * len(wanted):
                found.add((doc_id, item_id, len(wanted), shared, shared / len(wanted)))
    return found


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_contained_items_against_brute_force(spark, docs, nothing, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    items = spark.createDataFrame(ITEMS, "item_id long, text string, n string")
    want = brute_contained(ROWS, ITEMS)
    assert as_key(map(tuple, decontamination.contained_items(docs, items).collect())) == as_key(want)
    left = decontamination.documents_without_items(docs, items)
    hit = {repr(w[0]) for w in want}
    assert left.columns == docs.columns
    assert as_key(r["text"] for r in left.collect()) == as_key(t for d, t in ROWS if not brute_contained([(d, t)], ITEMS))
    assert hit
    assert decontamination.contained_items(nothing, items).collect() == []
    assert decontamination.contained_items(docs, items.limit(0)).collect() == []


def check_packing(frame, capacity):
    """Sequences are gapless and within capacity; returns how many there are."""
    frame = frame.sort_values(["sequence_id", "offset"])
    assert ((frame.groupby("sequence_id")["length"].cumsum() - frame["length"]) == frame["offset"]).all()
    assert frame.groupby("sequence_id")["length"].sum().max() <= capacity
    return frame["sequence_id"].nunique()


def test_packing_of_documents(docs, nothing):
    got = packing.pack_documents(docs, VOCABULARY, capacity=128).toPandas()
    used = check_packing(got, 128)
    assert used <= -(-got["length"].sum() // 128) + 1
    tops = got[got["piece"] > 0]
    assert (tops["length"] == 128).all()
    assert (got["piece"] == 0).sum() == len(ROWS)
    assert packing.pack_documents(nothing, VOCABULARY).collect() == []


def test_packing_in_many_shards(spark):
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(1, 100, 3000), rng.integers(40, 70, 300), [100] * 5])
    pieces = spark.createDataFrame(pd.DataFrame({"key": np.arange(len(lengths)), "length": lengths}))
    packed = packing.pack_pieces(pieces, 100, packing.Evolution(shard_pieces=400, generations=6))
    got = packed.join(pieces, "key").toPandas()
    assert len(got) == len(lengths)
    assert check_packing(got, 100) <= 1.02 * (packing.descending(lengths, 100, rng, 0.0).max() + 1)


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 60, 300)
    a, b = (packing.descending(lengths, 100, rng, noise) for noise in (0.0, 0.5))
    for _ in range(20):
        child = packing.crossover(a, b, lengths, 100, rng, 0.9)
        assert len(child) == 300 and child.min() == 0 and packing.fills(child, lengths).max() <= 100
        assert packing.fills(child, lengths).min() > 0


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "example.org", "/en/12"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.example.org", "/"), ("block", "org", "/")]
URLS = [
    (1, "http://example.org/es/1"),
    (1, "http://example.org/es/1"),
    (1, "https://www.Example.ORG/en/123?q#x"),
    (2, "https://www.example.org/en/13"),
    (3, "http://notexample.org/es/"),
    (4, "http://example.org"),
    (5, "http://b.com/fr/x"),
    (6, "http://com/de/"),
    (7, "no scheme"),
    (8, None),
    (None, "ftp://x.a.example.org/es/z"),
    (9, "://org/"),
    (10, ""),
    (11, "http://" + "a." * 200 + "org/" + "p" * 5000),
    (12, "http://example.org.evil/es/"),
    (13, "x://y.com?/fr/"),
]


@pytest.mark.parametrize("salts", [1, 5])
def test_urls_against_brute_force(spark, salts):
    urls = spark.createDataFrame(URLS, "page_id long, url string").select("*", F.lit("x").alias("host"), F.lit("x").alias("key"), F.lit(1).alias("open"))
    got = map(tuple, url_rules.url_verdicts(urls, url_rules.rule_table(spark, RULES), salts=salts).collect())
    want = []
    for page_id, url in URLS:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h.split(".")), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[2:] if fits else (None, "allow")
        want.append((page_id, host, path, rule, verdict))
    assert as_key(got) == as_key(want)


def test_urls_without_rows_or_rules(spark):
    urls = spark.createDataFrame(URLS, "page_id long, url string")
    assert url_rules.url_verdicts(urls.limit(0), url_rules.rule_table(spark, RULES)).collect() == []
    bare = url_rules.url_verdicts(urls, url_rules.rule_table(spark, RULES).limit(0), default="block").collect()
    assert len(bare) == len(URLS) and {(r["rule"], r["verdict"]) for r in bare} == {(None, "block")}
