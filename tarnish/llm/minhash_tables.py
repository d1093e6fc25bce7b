"""MinHash near-duplicates with tensored banding.

A table's key of 2 x ROWS minima would need hundreds of tables, each with minima of its own. Instead
there are two small collections of HALVES half keys, each of ROWS minima, and a table for each pair of a
half key of the one and a half key of the other: HALVES^2 tables from 2 x HALVES x ROWS minima. Two
sets meet in a table if they share a half key of either collection; at the least similarity s they
fail to with probability 1 - (1 - (1 - s^ROWS)^HALVES)^2 = 2e-5 at most.

Sets gather by half keys of the first collection, HALVES rows each, and those of the second complete the
key where sets are compared: only pairs that meet in a table are verified, on the full sets
(``similar_sets``). Where a half key leaves many sets undecided, its tables are written out.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.near_copies import SEED, shingle_set
from tarnish.llm.repeats import KEY, with_key
from tarnish.llm.similar_sets import Likeness, similar_components
from tarnish.llm.texts import _odd, mixed, per_text
from tarnish.session import stored

SHINGLE = 4
#: The least similarity, as a fraction.
SIMILAR = (80, 100)
HALVES, ROWS = 38, 6
_FACTORS = _odd(23, 2 * HALVES * ROWS)
_FOLDS = _odd(29, 2 * HALVES * ROWS).reshape(2 * HALVES, ROWS)


def word_set(text: str) -> np.ndarray:
    return shingle_set(text, SHINGLE)


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set, none of which is empty: HALVES half keys of the first collection, then those of the second."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.stack([np.minimum.reduceat(joined * f, starts) for f in _FACTORS], axis=1).reshape(len(sets), 2 * HALVES, ROWS)
    return mixed((mixed(least) * _FOLDS).sum(axis=2, dtype=np.uint64) + np.arange(2 * HALVES, dtype=np.uint64)).view(np.int64)


def _marked(texts: list[str]) -> dict:
    sets = [word_set(t) for t in texts]
    full = [i for i, s in enumerate(sets) if len(s)]
    marks: list = [[] for _ in texts]
    if full:
        for i, row in zip(full, half_keys([sets[i] for i in full])):
            marks[i] = row
    node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
    return {"node": node, "n": [len(s) for s in sets], "marks": marks}


def table_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bucket, node, root) by whole keys for rows (bucket, node, root) by half keys of the first collection."""
    # a node's half keys, HALVES at most, meet those of the other collection in one row
    met = rows.groupBy("node", "root").agg(F.collect_set("bucket").alias("firsts"))
    both = nodes.select("node", F.slice("marks", HALVES + 1, HALVES).alias("seconds")).join(met, "node")
    paired = both.select("node", "root", "seconds", F.explode("firsts").alias("first")).select("node", "root", "first", F.explode("seconds").alias("second"))
    return paired.select(F.xxhash64("first", "second").alias("bucket"), "node", "root")


def minhash_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    Documents whose sets of SHINGLE-word runs are similar by SIMILAR or more are linked; ``component_id``
    is the smallest doc_id that links lead to. A text of fewer words is one run; one without words, or
    null, has none and is linked with nothing, not even its like. Null ids stay but name no component
    unless it has no other id (then null, and kept); repeated rows stay each, other columns are ignored.
    Sets are known by 64-bit hashes of runs, equal sets by one hash of the set.
    """
    keyed = with_key(docs.select("doc_id", "text"), ["doc_id"])
    marked = stored(per_text(keyed.select(F.col("row.doc_id").alias("doc_id"), "text", *KEY), _marked, "node long, n long, marks array<long>"), "marked")
    full = marked.where("n > 0")
    nodes = stored(full.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct(*KEY)).alias("one"), F.first("n").alias("n"), F.first("marks").alias("marks")), "nodes")
    gathered = nodes.select("node", F.explode(F.slice("marks", 1, HALVES)).alias("bucket"))
    likeness = Likeness(word_set, SIMILAR, (HALVES, HALVES))
    roots = similar_components(nodes.select("node", "n", "marks", "one"), keyed, gathered, likeness, lambda rows: table_rows(rows, nodes))
    named = stored(nodes.select("node", "least").join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    ids = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    of_node = stored(named.join(ids, "root").select("node", "component_id"), "of_node")
    linked = full.join(of_node, "node").select("doc_id", "n", "component_id")
    alone = marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
