"""Packing of documents into sequences by a grouping genetic algorithm on distributed islands.

A solution is a set of sequences (bins). Crossover injects whole well-filled bins of one parent
into the other, removes the bins that hold the same pieces, and best-fits the pieces displaced by
that. The pieces are dealt into shards of bounded size; every shard is solved on several islands
at once, whose elites migrate along a ring between epochs. Pieces of badly filled bins of all
shards are dealt again, to fewer shards, until one shard holds what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.texts import per_text
from tarnish.llm.tokens import encoder
from tarnish.session import stored


@dataclass(frozen=True)
class Evolution:
    """Sizes of the search; ``shard_pieces`` bounds what a task holds."""

    shard_pieces: int = 4000
    islands: int = 2
    epochs: int = 2
    population: int = 5
    generations: int = 12
    well_filled: float = 0.97
    settled: float = 0.99
    seed: int = 2027


def best_fit(items: np.ndarray, sizes: list[int], rooms: list[int], capacity: int) -> list[int]:
    """The bin of each item in turn: the fullest that still takes it, or a new one; ``rooms`` is brought up to date.

    Bins are listed by the room they have left, and a bit mask tells which rooms exist.
    """
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, room in enumerate(rooms):
        if room:
            by_room.setdefault(room, []).append(b)
            mask |= 1 << room
    found = []
    for item in items.tolist():
        size = sizes[item]
        open_rooms = mask >> size
        if open_rooms:
            room = size + (open_rooms & -open_rooms).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(rooms)
            rooms.append(0)
        left = room - size
        rooms[b] = left
        if left:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left
        found.append(b)
    return found


def numbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def fills(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def fitness(bins: np.ndarray, lengths: np.ndarray) -> tuple[int, int]:
    """Fewer bins first, then more uneven ones, which leave room in one place."""
    filled = fills(bins, lengths)
    return len(filled), -int((filled**2).sum())


def descending(lengths: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> np.ndarray:
    """Best fit of the pieces from the longest on, with an order that is shaken by ``noise``."""
    order = np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    bins[order] = best_fit(order, lengths.tolist(), [], capacity)
    return bins


def crossover(mother: np.ndarray, father: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator, well_filled: float) -> np.ndarray:
    """The mother's bins with some of the father's well-filled ones; a few of her worst bins are broken up as well."""
    good = np.flatnonzero(fills(father, lengths) >= well_filled * capacity)
    chosen = good[rng.random(len(good)) < rng.uniform(0.05, 0.25)]
    injected = np.isin(father, chosen)
    filled = fills(mother, lengths)
    broken = np.zeros(len(filled), dtype=bool)
    broken[mother[injected]] = True
    broken[np.argsort(filled, kind="stable")[: 1 + rng.integers(0, 4)]] = True
    displaced = np.flatnonzero(~injected & broken[mother])
    child = np.where(injected, father + len(filled), mother)
    child[displaced] = -1
    placed = child >= 0
    child[placed] = numbered(child[placed])
    used = fills(child[placed], lengths[placed]) if placed.any() else np.zeros(0, dtype=np.int64)
    order = displaced[np.argsort(-lengths[displaced], kind="stable")]
    child[order] = best_fit(order, lengths.tolist(), (capacity - used).tolist(), capacity)
    return child


def evolve(lengths: np.ndarray, elites: list[np.ndarray], capacity: int, rng: np.random.Generator, plan: Evolution) -> np.ndarray:
    """The best solution of one island after an epoch that starts from ``elites`` and shaken best fits."""
    people = [e.copy() for e in elites] or [descending(lengths, capacity, rng, 0.0)]
    while len(people) < plan.population:
        people.append(descending(lengths, capacity, rng, 0.15 * len(people) / plan.population))
    scores = [fitness(p, lengths) for p in people]
    floor = -(-int(lengths.sum()) // capacity)
    for _ in range(plan.generations):
        if min(scores)[0] <= floor or len(lengths) < 3:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        mother, father = (a, b) if scores[a] <= scores[b] else (b, a)
        child = crossover(people[mother], people[father], lengths, capacity, rng, plan.well_filled)
        score = fitness(child, lengths)
        worst = max(range(len(people)), key=scores.__getitem__)
        if score < scores[worst] and score not in scores:
            people[worst], scores[worst] = child, score
    return people[min(range(len(people)), key=scores.__getitem__)]


ISLAND = "shard long, island int, keys array<long>, lengths array<int>, bins array<int>, n_bins long, unevenness long"


def _epoch(islands: DataFrame, capacity: int, plan: Evolution, stamp: int) -> DataFrame:
    """Every island's elite; rows hold a whole island, so they need no grouping."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples():
                lengths = np.asarray(row.lengths, dtype=np.int64)
                rng = np.random.default_rng([plan.seed, stamp, int(row.shard), int(row.island)])
                elites = [np.asarray(e, dtype=np.int64) for e in row.elites]
                bins = evolve(lengths, elites, capacity, rng, plan)
                n_bins, unevenness = fitness(bins, lengths)
                rows.append((row.shard, row.island, row.keys, row.lengths, bins, n_bins, unevenness))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in ISLAND.split(", ")])

    return islands.select("shard", "island", "keys", "lengths", "elites").mapInPandas(run, ISLAND)


def solve_shards(pieces: DataFrame, shards: int, capacity: int, plan: Evolution, stamp: int) -> DataFrame:
    """(shard, keys, lengths, bins): the best island's solution of every shard of (key, length)."""
    dealt = pieces.groupBy(F.pmod(F.xxhash64("key", F.lit(stamp)), F.lit(shards)).alias("shard")).agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("held"))
    islands = dealt.select(
        "shard",
        F.explode(F.array(*[F.lit(i) for i in range(plan.islands)])).alias("island"),
        F.col("held.key").alias("keys"),
        F.col("held.length").cast("array<int>").alias("lengths"),
        F.array().cast("array<array<int>>").alias("elites"),
    )
    elites = stored(_epoch(islands.repartition(F.col("shard"), F.col("island")), capacity, plan, 100 * stamp), "islands")
    for epoch in range(1, plan.epochs):
        migrants = elites.select("shard", F.pmod(F.col("island") + 1, F.lit(plan.islands)).alias("island"), F.col("bins").alias("guest"))
        met = elites.join(migrants, ["shard", "island"]).withColumn("elites", F.array("bins", "guest"))
        elites = stored(_epoch(met, capacity, plan, 100 * stamp + epoch), "islands")
    return elites.groupBy("shard").agg(F.min_by(F.struct("keys", "lengths", "bins"), F.struct("n_bins", "unevenness", "island")).alias("best")).select("shard", "best.*")


def _places(solved: DataFrame, capacity: int, settled: float, last: bool, stamp: int) -> DataFrame:
    """(key, length, sequence_id, offset) of each piece; sequence_id is -1 for pieces to be dealt again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                lengths, bins = np.asarray(row.lengths, dtype=np.int64), np.asarray(row.bins, dtype=np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(lengths[order])
                filled = fills(bins, lengths)
                before = np.cumsum(filled) - filled
                offsets = ends - lengths[order] - before[bins[order]]
                good = filled >= (0 if last else min(settled * capacity, np.median(filled)))
                number = (stamp << 56) + (int(row.shard) << 24) + bins[order]
                yield pd.DataFrame(
                    {
                        "key": np.asarray(row.keys, dtype=np.int64)[order],
                        "length": lengths[order],
                        "sequence_id": np.where(good[bins[order]], number, -1),
                        "offset": offsets,
                    }
                )

    return solved.mapInPandas(run, "key long, length long, sequence_id long, offset long")


def pack_pieces(pieces: DataFrame, capacity: int, plan: Evolution = Evolution()) -> DataFrame:
    """(key, sequence_id, offset) for (key, length) with unique keys and lengths from 1 to ``capacity``."""
    full = pieces.where(F.col("length") >= capacity).select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_pieces = pieces.where(F.col("length") < capacity).select("key", "length")
    done = [full]
    stamp, shards = 1, None
    while shards != 1:
        wanted = max(1, -(-open_pieces.count() // plan.shard_pieces))
        shards = wanted if shards is None else min(wanted, max(1, shards - 1))
        placed = stored(_places(solve_shards(open_pieces, shards, capacity, plan, stamp), capacity, plan.settled, shards == 1, stamp), "places")
        done.append(placed.where("sequence_id >= 0").select("key", "sequence_id", "offset"))
        open_pieces = placed.where("sequence_id < 0").select("key", "length")
        stamp += 1
    packed = done[0]
    for part in done[1:]:
        packed = packed.unionByName(part)
    return packed


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces.

    A document longer than ``capacity`` is cut into pieces of that length; the first is shorter
    if they do not come out even.
    """

    def cut(texts: list[str]) -> dict:
        end = np.uint32(end_id).astype("<u4").tobytes()
        starts, lengths, crcs = [], [], []
        for ids in encoder(vocabulary).encode(texts):
            ids += end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            starts.append(cuts[:-1])
            lengths.append([b - a for a, b in zip(cuts, cuts[1:])])
            crcs.append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])])
        return {"starts": starts, "lengths": lengths, "crcs": crcs}

    cut_docs = per_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), cut, "starts array<long>, lengths array<long>, crcs array<long>")
    return cut_docs.select("doc_id", F.posexplode(F.arrays_zip("starts", "lengths", "crcs"))).select(
        "doc_id", F.col("pos").cast("int").alias("piece"), F.col("col.starts").alias("start"), F.col("col.lengths").alias("length"), F.col("col.crcs").alias("ids_crc32")
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, plan: Evolution = Evolution()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null text is an empty one and takes one token, the end id. Repeated rows are packed as
    documents of their own, null ids are ids, other columns are ignored; no documents, no rows.
    """
    pieces = stored(cut_pieces(docs, vocabulary, capacity, end_id).withColumn("key", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack_pieces(pieces.select("key", "length"), capacity, plan), "key").drop("key")
