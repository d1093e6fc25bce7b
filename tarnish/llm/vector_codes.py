"""Compression of vectors to product codes, the nearest entry of each codebook found by a GNAT.

A vector's components become integers, its parts are coded by the nearest of a few entries, and two
rounds move every entry to the mean of its parts. A geometric near-neighbour access tree over a
codebook has split points; for each split point and each child it stores the range of distances to the
child's members. A query's distances to the split points rule out whole children strictly: bounds are
integer square roots rounded to the safe side, and what is left is decided by exact squared distances
and the smaller index.

Codebooks, and the sums and counts that move their entries, have a size that parameters set
(parts x entries x width); nothing else reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.session import stored

PARTS, ENTRIES, ROUNDS, STEPS = 16, 64, 2, 256
#: Split points of a node, and members that need no node of their own.
SPLITS, LEAF = 8, 12
#: Queries that a task holds distances for at a time.
BLOCK = 8192


def floor_roots(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, exact up to 2^62."""
    roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    roots -= roots * roots > squares
    roots += (roots + 1) * (roots + 1) <= squares
    return roots


def ceil_roots(squares: np.ndarray) -> np.ndarray:
    roots = floor_roots(squares)
    return roots + (roots * roots < squares)


def squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of each query to each point."""
    apart = queries[:, None, :] - points[None, :, :]
    return np.einsum("qpw,qpw->qp", apart, apart)


@dataclass
class _Node:
    """Entries, in ascending order: all of a leaf, or split points with children and ranges (low, high) of distances."""

    entries: np.ndarray
    children: list[tuple[_Node, np.ndarray, np.ndarray]]


class Gnat:
    """The nearest of some integer points; of equal distances, the smallest index."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._built(np.arange(len(points)))
        #: Distances computed so far, against queries x points without a tree.
        self.computed = 0

    def _built(self, members: np.ndarray) -> _Node:
        if len(members) <= LEAF:
            return _Node(members, [])
        chosen = [0]
        nearest = squared(self.points[members], self.points[members[:1]])[:, 0]
        while len(chosen) < SPLITS and nearest.max() > 0:  # far from those chosen so far
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, squared(self.points[members], self.points[members[chosen[-1:]]])[:, 0])
        if len(chosen) == 1:  # copies of one point
            return _Node(members[:1], [])
        splits = np.sort(members[chosen])
        rest = np.setdiff1d(members, splits)
        away = squared(self.points[rest], self.points[splits])
        home = away.argmin(axis=1)
        children = []
        for j in range(len(splits)):
            own = home == j
            if own.any():
                children.append((self._built(rest[own]), floor_roots(away[own].min(axis=0)), ceil_roots(away[own].max(axis=0))))
        return _Node(splits, children)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each query."""
        index = np.full(len(queries), len(self.points), dtype=np.int64)
        least = np.full(len(queries), np.iinfo(np.int64).max, dtype=np.int64)
        for lo in range(0, len(queries), BLOCK):
            self._visit(self.root, queries, np.arange(lo, min(lo + BLOCK, len(queries))), index, least)
        return index, least

    def _visit(self, node: _Node, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, least: np.ndarray) -> None:
        away = squared(queries[rows], self.points[node.entries])
        self.computed += away.size
        at = away.argmin(axis=1)
        found, entry = away[np.arange(len(rows)), at], node.entries[at]
        better = (found < least[rows]) | ((found == least[rows]) & (entry < index[rows]))
        least[rows[better]], index[rows[better]] = found[better], entry[better]
        if not node.children:
            return
        near, far = floor_roots(away), ceil_roots(away)
        for child, low, high in node.children:
            reach = ceil_roots(least[rows])[:, None]
            # every member is farther than the best: by what lies inside its range, or beyond it
            apart = (near - high > reach) | (low - far > reach)
            alive = rows[~apart.any(axis=1)]
            if len(alive):
                self._visit(child, queries, alive, index, least)


def largest(width: int) -> int:
    """Integers up to this size have squared distances of ``width`` components that fit 62 bits."""
    return isqrt((1 << 62) // width) // 2


def _integers(column: pa.Array, width: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * STEPS).astype(np.int64).reshape(-1, width)


def _coded(vectors: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance for each vector and part."""
    parts = vectors.reshape(len(vectors), len(trees), -1)
    found = [tree.nearest(parts[:, p]) for p, tree in enumerate(trees)]
    return np.stack([index for index, _ in found], axis=1), np.stack([least for _, least in found], axis=1)


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry at the floor of the mean of its parts."""
    n_parts, n_entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        held = np.zeros((n_parts * n_entries, width + 1), dtype=np.int64)
        for batch in batches:
            whole = _integers(batch.column("vector"), n_parts * width)
            codes, _ = _coded(whole, trees)
            parts = np.concatenate([whole.reshape(len(whole), n_parts, width), np.ones((len(whole), n_parts, 1), dtype=np.int64)], axis=2)
            np.add.at(held, (codes + np.arange(n_parts) * n_entries).ravel(), parts.reshape(-1, width + 1))
        used = np.flatnonzero(held[:, width])
        slots = (used[:, None] * (width + 1) + np.arange(width + 1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(held[used].ravel())], names=["slot", "value"])

    # no more rows than the codebooks have numbers
    rows = vectors.select("vector").mapInArrow(sums, "slot long, value long").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total = {row["slot"]: int(row["value"]) for row in rows}
    moved = books.copy()
    for slot, count in total.items():
        entry, at = divmod(slot, width + 1)
        if at == width:
            moved[divmod(entry, n_entries)] = [total[slot - width + t] // count for t in range(width)]
    return moved


def _seeds(vectors: DataFrame, by: str, n_parts: int, n_entries: int) -> np.ndarray:
    """Codebooks of the parts of the vectors with the smallest ids."""
    first = vectors.orderBy(F.col(by).asc_nulls_last(), "vector").limit(n_entries).select("vector").toArrow().column("vector").combine_chunks()
    whole = _integers(first, len(first[0]))
    return whole.reshape(len(whole), n_parts, -1).transpose(1, 0, 2).copy()


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' numbers by part, entry and place, in decimal with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(table: DataFrame, vector: str = "embedding", by: str = "vec_id", n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) for each vector: two hex digits a part, and the squared error of the code.

    Rows whose vector is null or has a null or non-finite component are left out. The width is that of
    the vector with the smallest id whose length ``n_parts`` divides; vectors of another length, or with
    a component too large for exact 64-bit distances, have a null code and error. With fewer vectors than
    entries there are as many entries as vectors. Null ids come last among the seeds, equal ids go by
    their vectors; repeated rows are coded each; other columns are ignored.
    """
    number = lambda x: F.abs(x.cast("double"))
    usable = table.select(F.col(by), F.col("label"), F.col(vector).alias("vector")).where(F.forall("vector", lambda x: x.isNotNull() & (number(x) < float("inf"))))
    n = F.size("vector")
    first = usable.where((n > 0) & (n % n_parts == 0)).orderBy(F.col(by).asc_nulls_last(), "vector").limit(1).select(n.alias("n")).first()
    result = f"{by} {table.schema[by].dataType.simpleString()}, label {table.schema['label'].dataType.simpleString()}, code string, error long, codebooks_sha256 string"
    if first is None:
        return usable.select(by, "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(book_digest(np.zeros(0))).alias("codebooks_sha256"))
    width = first["n"]
    fits = (n == width) & F.forall("vector", lambda x: number(x) * STEPS < largest(width))
    good = usable.where(fits)
    books = _seeds(good, by, n_parts, n_entries) if not good.isEmpty() else np.zeros((n_parts, 1, width // n_parts), dtype=np.int64)
    for _ in range(rounds):
        books = _moved(good, books)
    digest = book_digest(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(book) for book in books]
        for batch in batches:
            codes, errors = _coded(_integers(batch.column("vector"), width), trees)
            digits = codes.astype(np.uint8).tobytes().hex()
            texts = [digits[lo : lo + 2 * n_parts] for lo in range(0, len(digits), 2 * n_parts)]
            columns = [batch.column(by), batch.column("label"), pa.array(texts, pa.string()), pa.array(errors.sum(axis=1)), pa.array([digest] * batch.num_rows, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[by, "label", "code", "error", "codebooks_sha256"])

    coded = good.mapInArrow(code, result)
    bare = usable.where(~fits).select(by, "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(digest).alias("codebooks_sha256"))
    return coded.unionByName(bare)


def vector_codes(table: DataFrame, vector: str = "embedding", by: str = "vec_id") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): ``compressed``, and the sum of errors over equal labels.

    Null labels are one label; a label whose vectors all have no code has a null sum.
    """
    coded = stored(compressed(table, vector, by), "codes")
    # sums are written before the join, so that rows of a frequent label can be split
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(by, "code", "error", "label_error", "codebooks_sha256")
