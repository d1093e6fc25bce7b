"""Near copies: documents whose sets of word shingles have a Jaccard similarity of SIMILAR or more.

Components of SimHash fingerprints, found by op7's grid join, propose pairs; so do MinHash bands, for the
similar texts whose fingerprints are further apart. The sets themselves prove them. With BANDS bands of
ROWS minima, a pair at the threshold shares no band with probability (1 - 0.8^5)^30 = 7e-6, a closer one
less. Documents with equal sets are one node throughout. ``similar_sets`` finds the components of what
shares a band or a component of fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.repeats import KEY
from tarnish.llm.similar_sets import Likeness, similar_components
from tarnish.llm.texts import _odd, mixed, per_text, span_hashes, window_hashes, word_hashes
from tarnish.session import stored

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 30, 5
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = _odd(17, BANDS * ROWS)
_FOLDS = _odd(19, BANDS * ROWS).reshape(BANDS, ROWS)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's runs of words, sorted; a shorter text is one run, an empty one has none."""
    codes = word_hashes(np.frombuffer(text.encode().translate(LOWER), dtype=np.uint8))[0]
    if 0 < len(codes) < shingle:
        return span_hashes(codes, np.array([0]), np.array([len(codes)]))
    return np.unique(window_hashes(codes, shingle))


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS hashes for each set, of which none is empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.stack([np.minimum.reduceat(joined * f, starts) for f in _FACTORS], axis=1).reshape(-1, BANDS, ROWS)
    return mixed((mixed(least) * _FOLDS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _nodes(texts: list[str]) -> dict:
    sets = [shingle_set(t) for t in texts]
    full = [i for i, s in enumerate(sets) if len(s)]
    bands: list = [[] for _ in texts]
    if full:
        for i, row in zip(full, band_hashes([sets[i] for i in full])):
            bands[i] = row
    node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
    return {"node": node, "n": [len(s) for s in sets], "bands": bands}


def copy_links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): each node but one of its component, with that one.

    ``nodes`` has (node, n, bands, fp, one): the key of one document each, whose text is in ``docs`` (text, KEY),
    and ``fp`` names the component of its fingerprint.
    """
    marked = nodes.where("n > 0").withColumn("marks", F.array_append("bands", F.col("fp")))
    return similar_components(marked, docs, marked.select("node", F.explode("marks").alias("bucket")), Likeness(shingle_set, SIMILAR, (BANDS + 1,)))


def one_of_each(keyed: DataFrame, fingerprints: Callable[[list[str]], np.ndarray], components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ka, kb) of one document of each component of ``keyed`` (row, text, KEY): that of the smallest id, null ids last, then of the smallest text hash.

    ``fingerprints`` gives each text's, ``components`` the (fp, root) of distinct ones. Texts without words
    (null, empty, blank) have equal sets and are copies of each other.
    """

    def told(texts: list[str]) -> dict:
        return _nodes(texts) | {"fp": fingerprints(texts)}

    marked = stored(per_text(keyed.select("text", *KEY, F.col("row.doc_id").isNull().alias("last")), told, "node long, n long, bands array<long>, fp long"), "nodes")
    # one fingerprint for a set of shingles: a candidate more or less
    nodes = stored(marked.groupBy("node").agg(F.min(F.struct("last", *KEY)).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "nodes")
    named = stored(components(nodes.where("n > 0").select("fp").distinct()), "components")
    nodes = nodes.join(named, "fp", "left").withColumn("fp", F.coalesce("root", "fp")).drop("root")
    roots = copy_links(nodes, keyed).select(F.col("a").alias("node"), F.col("b").alias("root"))
    first = nodes.select("node", "one").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("one").alias("one"))
    return first.select("one.ka", "one.kb")
