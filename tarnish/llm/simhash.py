"""SimHash near-duplicates by a grid join over segment popcounts.

A fingerprint's bits fall into 32 segments of two; the counts of set bits per segment are a point
whose Manhattan distance to another point is at most the Hamming distance of the fingerprints.
The segments are dealt into groups: three differing bits touch three groups at most, so two linked
fingerprints share the coordinates of all other groups, which are the cell of a grid. Each
fingerprint has one cell per choice of three groups. Within a cell, points are sorted by their
total count and compared only while the totals are within reach; pairs left over are compared bit
by bit. Crowded cells are dealt anew into finer grids, the last of which holds 4,096 fingerprints
per cell at most, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.components import component_roots
from tarnish.llm.near_copies import one_of_each
from tarnish.llm.repeats import KEY, with_key
from tarnish.llm.texts import per_text
from tarnish.session import stored

REACH = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that a cell may hold before it is dealt anew.
CROWDED = 2048
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS_OF_BYTE = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the hashes of the text's word shingles; 0 without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], dtype=np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ BITS_OF_BYTE for j in range(8)])
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist())


def signed(texts: list[str]) -> np.ndarray:
    """Fingerprints as signed 64-bit numbers."""
    return np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number; a null text has no words."""

    return per_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), lambda texts: {"fp": signed(texts)}, "fp long")


def segment_counts(fp: Column) -> Column:
    """The set bits of each pair of bits, as a number in that pair's place."""
    even, odd = fp.bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def grid_masks(width: int, groups: int) -> list[int]:
    """For each choice of REACH among the groups of ``width``-bit segments: the bits of all others."""
    of = [s * groups * width // 64 for s in range(64 // width)]
    bits = [sum(((1 << width) - 1) << (s * width) for s in range(64 // width) if of[s] == g) for g in range(groups)]
    return [_signed(sum(b for g, b in enumerate(bits) if g not in left_out)) for left_out in combinations(range(groups), REACH)]


def groups_for(n: int) -> int:
    """Groups at which a fingerprint meets few others by chance: two random counts of a segment agree in 3 of 8 cases."""
    for groups in range(REACH + 2, 16):
        if n * comb(groups, REACH) * 0.375 ** (32 * (groups - REACH) / groups) <= 40:
            return groups
    return 16


def cells(points: DataFrame, coordinates: Column, masks: list[int]) -> DataFrame:
    """(grid, cell, total, fp): one row per fingerprint and grid."""
    grids = F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)]))
    return points.select("fp", grids.alias("g")).select(F.col("g.grid").alias("grid"), coordinates.bitwiseAND(F.col("g.mask")).alias("cell"), F.bit_count("fp").cast("int").alias("total"), "fp")


def links_within(cell: np.ndarray, total: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked fingerprints among rows sorted by cell and total."""
    left, right = [], []
    active = np.arange(len(fp) - 1)
    step = 1
    while len(active):
        active = active[active + step < len(fp)]
        other = active + step
        near = (cell[other] == cell[active]) & (total[other] - total[active] <= REACH)
        active, other = active[near], other[near]
        linked = np.bitwise_count(fp[active] ^ fp[other]) <= REACH
        left.append(active[linked])
        right.append(other[linked])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, dtype=np.int64),) * 2


def spanning(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of n places is linked with, over any number of links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def links_of_cells(dealt: DataFrame) -> DataFrame:
    """(a, b): enough links to join all fingerprints that links within a cell join."""
    sorted_cells = dealt.repartition(F.col("grid"), F.col("cell")).sortWithinPartitions("grid", "cell", "total", "fp")

    def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
        grid, cell, total, fp = rows
        fresh = np.ones(len(fp), dtype=bool)
        fresh[1:] = (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])
        left, right = links_within(np.cumsum(fresh), total, fp.view(np.uint64))
        root = spanning(left, right, len(fp))
        tied = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[root[tied]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("grid", "cell", "total", "fp")]
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows)]
            if not len(rows[0]):
                continue
            # the last cell may go on in the next batch
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = int(np.argmax(same))
            if cut:
                yield solve([r[:cut] for r in rows])
            held = [r[cut:] for r in rows]
        if held is not None:
            yield solve(held)

    return sorted_cells.mapInArrow(run, "a long, b long")


def fingerprint_links(points: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` within REACH bits: not all pairs, but enough to join all that they join."""
    found = []
    grids = [(2, groups_for(points.count()), segment_counts(F.col("fp"))), (8, 8, F.col("fp")), (4, 16, F.col("fp"))]
    for level, (width, groups, coordinates) in enumerate(grids):
        dealt = stored(cells(points, coordinates, grid_masks(width, groups)), "cells")
        if level == len(grids) - 1:
            found.append(links_of_cells(dealt))
            break
        crowds = stored(dealt.groupBy("grid", "cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED), "crowds")
        if crowds.isEmpty():
            found.append(links_of_cells(dealt))
            break
        found.append(links_of_cells(dealt.join(crowds, ["grid", "cell"], "left_anti")))
        points = stored(dealt.join(crowds, ["grid", "cell"], "left_semi").select("fp").distinct(), "points")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def named_components(points: DataFrame) -> DataFrame:
    """(fp, root): a fingerprint of the same component for each distinct ``fp``."""
    roots = component_roots(fingerprint_links(points.select("fp")))
    return points.select("fp").join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document.

    Documents whose fingerprints differ in at most REACH bits are linked; ``component_id`` is the
    smallest doc_id that links lead to. Null and empty texts have the fingerprint zero and are
    linked as any other. Null ids stay but name no component (null if a component has no other
    id); repeated rows stay, other columns are ignored.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    points = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    named = stored(named_components(points), "components")
    ids = named.join(points, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def documents_without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns, one of each group of near copies (see ``near_copies``; fingerprints propose them too): that of the smallest id, null ids last, then of the smallest text hash.

    Of rows that repeat both id and text, one stays.
    """
    keyed = with_key(docs, docs.columns)
    return keyed.join(one_of_each(keyed, signed, named_components), KEY, "left_semi").groupBy(*KEY).agg(F.first("row").alias("row")).select("row.*")
