"""Components of similar shingle sets, from buckets of candidates to proven links, without lists of pairs.

Two sets that meet in a bucket are candidates. Buckets are stars, their components are clusters, and
a set travels once, to its cluster. Within a cluster one task finds which sets are linked: it walks from
set to set and compares each with those that nothing has reached yet, if both meet in a bucket, by
bits of shared shingles. So a group of copies takes about one comparison per copy, and a task sends
one link per set.

A cluster of more than MEMBERS sets or SHINGLES shingles is dealt into blocks. Blocks are solved alike,
then one set of each component found, until these fit one block or stop getting fewer. What is left are buckets
in which several components meet: every set there but those of the cluster's largest component is
compared with all others there, block by block. No task holds more than two blocks, whatever the cluster's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.components import component_roots
from tarnish.llm.repeats import KEY
from tarnish.session import stored

#: Sets, and shingles in them, that a task compares at a time.
MEMBERS, SHINGLES = 2048, 1 << 20


@dataclass(frozen=True)
class Likeness:
    """How texts become sets, the least similarity as a fraction, and which of a set's marks make a candidate.

    ``collections`` are lengths of consecutive runs of marks; candidates have an equal mark, at the same place, in every one.
    """

    shingles: Callable[[str], np.ndarray]
    least: tuple[int, int]
    collections: tuple[int, ...]

    def meets(self, marks: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Which rows of marks are candidates of one row."""
        same = marks == one
        ends = np.cumsum(self.collections)
        return np.logical_and.reduce([same[:, end - size : end].any(axis=1) for end, size in zip(ends, self.collections)])


class Sets:
    """Sets as rows of bits, one for each shingle that two of them share; and their marks."""

    def __init__(self, likeness: Likeness, sets: list[np.ndarray], marks: np.ndarray):
        self.likeness, self.marks = likeness, marks
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        shingles, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        shared = counts[at] > 1
        self.width = int(column[-1]) // 64 + 1 if len(column) else 1
        bit = column[at[shared]]
        place = owner[shared] * self.width + bit // 64
        order = np.argsort(place, kind="stable")
        self.bits = np.zeros(len(sets) * self.width, dtype=np.uint64)
        if len(place):
            place, bit = place[order], bit[order]
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            self.bits[place[first]] = np.bitwise_or.reduceat(np.uint64(1) << (bit % 64).astype(np.uint64), first)
        self.bits = self.bits.reshape(len(sets), self.width)

    def linked(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are candidates and similar enough."""
        low, high = self.likeness.least
        size, sizes = self.sizes[one], self.sizes[others]
        others = others[(np.minimum(sizes, size) * high >= np.maximum(sizes, size) * low) & self.likeness.meets(self.marks[others], self.marks[one])]
        both = np.bitwise_count(self.bits[others] & self.bits[one]).sum(axis=1, dtype=np.int64)
        return others[both * (low + high) >= (self.sizes[others] + size) * low]

    def reached(self) -> np.ndarray:
        """For each set, the first set of its component."""
        root = np.full(len(self.sizes), -1)
        left = np.arange(len(root))
        while len(left):
            seed, left = left[0], left[1:]
            root[seed] = seed
            queue = [seed]
            while queue and len(left):
                found = self.linked(queue.pop(), left)
                root[found] = seed
                queue.extend(found)
                left = left[root[left] < 0]
        return root

    def bridges(self, asking: np.ndarray, root: np.ndarray) -> tuple[list[int], list[int]]:
        """Links from the sets that ask to sets of components they are not joined with, one for each component."""
        left: list[int] = []
        right: list[int] = []
        root = root.copy()
        for one in asking:
            found = self.linked(one, np.flatnonzero(root != root[one]))
            for other in found[np.unique(root[found], return_index=True)[1]]:
                left.append(int(one))
                right.append(int(other))
                root[root == root[other]] = root[one]
        return left, right


def _per_group(rows: DataFrame, keys: list[str], likeness: Likeness, solve: Callable[[Sets, np.ndarray, pa.Table, np.ndarray], tuple]) -> DataFrame:
    """(a, b): what ``solve`` links in each group of rows (node, marks, text, ...), a group at a time."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "node")

    def links(group: pa.Table) -> pa.RecordBatch:
        group = group.combine_chunks()
        node = group.column("node").to_numpy()
        # a node that comes twice, as both sides of a block, has one set
        _, first, place = np.unique(node, return_index=True, return_inverse=True)
        texts = group.column("text").take(pa.array(first)).to_pylist()
        marks = group.column("marks").take(pa.array(first)).combine_chunks().flatten().to_numpy().reshape(len(first), -1)
        left, right = solve(Sets(likeness, [likeness.shingles(t) for t in texts], marks), node[first], group, place)
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(k).to_numpy() for k in keys]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1), batch.num_rows]
            if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, codes)):
                yield links(pa.Table.from_batches(held))
                held = []
            for lo, hi in zip(cuts, cuts[1:]):
                held.append(batch.slice(lo, hi - lo))
                if hi < batch.num_rows:  # the last group may go on in the next batch
                    yield links(pa.Table.from_batches(held))
                    held = []
        if held:
            yield links(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def _within(sets: Sets, nodes: np.ndarray, group: pa.Table, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = sets.reached()
    tied = np.flatnonzero(root != np.arange(len(root)))
    return nodes[tied], nodes[root[tied]]


def _across(sets: Sets, nodes: np.ndarray, group: pa.Table, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    roots = np.zeros(len(nodes), dtype=np.int64)
    roots[place] = group.column("root").to_numpy()
    left, right = sets.bridges(np.unique(place[group.column("asks").to_numpy(zero_copy_only=False)]), roots)
    return roots[left], roots[right]


def _blocks(n, shingles):
    """How many blocks hold so many sets and shingles."""
    return F.greatest(F.ceil(n / MEMBERS), F.ceil(shingles / SHINGLES)).cast("long")


def _dealt(rows: DataFrame, turn: int) -> DataFrame:
    """Rows (node, n, cluster, ...) with the cluster's number of blocks and the row's own; sizes are written, so a large cluster can be split."""
    sizes = stored(rows.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks")), "cluster_sizes")
    return rows.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), "blocks"))


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (node, marks, one, ...) with the text of the document that stands for each."""
    wanted = rows.select("node", "marks", F.col("one.ka").alias("ka"), F.col("one.kb").alias("kb"))
    held = docs.select("text", *KEY).join(wanted, KEY)
    return held.groupBy("node").agg(F.first("text").alias("text"), F.first("marks").alias("marks"))


Narrowing = Callable[[DataFrame], DataFrame]


def similar_components(nodes: DataFrame, docs: DataFrame, meetings: DataFrame, likeness: Likeness, narrowed: Narrowing | None = None) -> DataFrame:
    """(a, b): each node but the first of its component, with that first.

    ``nodes`` has (node, n, marks, one): a set's hash, its size, its marks and the key of a document that
    has it, whose text is in ``docs`` (text, KEY). ``meetings`` has (bucket, node). ``narrowed`` turns
    rows (bucket, node, root) of buckets that leave sets of a large cluster undecided into rows of
    smaller buckets, in which all candidates among them still meet.
    """
    shared = stored(meetings.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("m")).where("m > 1").select("bucket", "least"), "buckets")
    rows = stored(meetings.join(shared, "bucket"), "meetings")
    stars = component_roots(rows.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("cluster")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct())
    dealt = stored(_dealt(nodes.join(members, "node"), 0), "clusters")
    sets = stored(_texts(docs, dealt), "sets")
    solve = lambda rows: stored(_per_group(rows.join(sets, "node"), ["cluster", "block"], likeness, _within), "links")
    roots = solve(dealt.select("node", "cluster", "block"))
    large = dealt.where("blocks > 1").select("node", "n", "cluster")
    size = large.count()
    if not size:
        return roots
    firsts, fewer, turn = large.join(roots.select(F.col("a").alias("node")), "node", "left_anti"), True, 1
    while fewer:
        # one set of each component found so far, while that makes them fewer
        first = stored(_dealt(firsts.select("node", "n", "cluster"), turn), "firsts")
        tied = solve(first.select("node", "cluster", "block"))
        roots = stored(_led_on(roots, tied), "roots")
        now, most = first.agg(F.count("*"), F.max("blocks")).first()
        firsts, fewer, size, turn = first.join(tied.select(F.col("a").alias("node")), "node", "left_anti"), most > 1 and 2 * now < size, now, turn + 1
    bridges = _bridges(large, rows, sets, roots, likeness, narrowed)
    return roots if bridges is None else _led_on(roots, component_roots(bridges))


def _led_on(roots: DataFrame, more: DataFrame) -> DataFrame:
    """Stars whose centres may be tied to others: (a, b) of both, with the last b."""
    further = more.select(F.col("a").alias("b"), F.col("b").alias("last"))
    return roots.join(further, "b", "left").select("a", F.coalesce("last", "b").alias("b")).unionByName(more)


def _undecided(met: DataFrame) -> DataFrame:
    """The buckets of rows (bucket, node, root) that hold several components."""
    return stored(met.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket"), "undecided")


def _bridges(large: DataFrame, meetings: DataFrame, sets: DataFrame, roots: DataFrame, likeness: Likeness, narrowed: Narrowing | None) -> DataFrame | None:
    """(a, b): components that are linked, of those that meet in a bucket: each set there outside the cluster's largest component against all there."""
    of = roots.select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = stored(large.join(of, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    met = meetings.select("bucket", "node").join(named.select("node", "root"), "node")
    several = _undecided(met)
    if several.isEmpty():
        return None
    if narrowed is not None:
        met = stored(narrowed(met.join(several, "bucket", "left_semi")), "narrowed")
        several = _undecided(met)
    left = stored(named.join(met.join(several, "bucket", "left_semi").select("node").distinct(), "node", "left_semi"), "left")
    main = left.groupBy("cluster", "root").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
    marked = stored(left.join(main, "cluster").withColumn("asks", F.col("root") != F.col("main")), "asking")
    asking = F.when(F.col("asks"), F.col("n"))
    blocks = stored(marked.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n")).alias("of_all"), _blocks(F.count(asking), F.coalesce(F.sum(asking), F.lit(0))).alias("of_asking")), "blocks")
    placed = marked.join(blocks, "cluster").withColumn("i", F.pmod(F.xxhash64("node", F.lit(-1)), "of_asking")).withColumn("j", F.pmod(F.xxhash64("node", F.lit(-2)), "of_all"))
    asks = placed.where("asks").select("node", "cluster", "root", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_all") - 1)).alias("j"), F.lit(True).alias("asks"))
    answers = placed.select("node", "cluster", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_asking") - 1)).alias("i"), "j", F.lit(False).alias("asks"))
    return _per_group(asks.unionByName(answers).join(sets, "node"), ["cluster", "i", "j"], likeness, _across)
