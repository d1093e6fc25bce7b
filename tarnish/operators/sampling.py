"""Exactly counted random row choices that never sort or gather the table.

A choice of n rows is the n smallest rolls of a seeded hash stream. Knowing the
cut (the n-th smallest pair of roll and id) makes the choice a row-local
predicate. Finding the cut takes narrow passes over the ids: rows outside the
range where the cut may lie are only counted. A range of more than RANKED rows is
counted in PIECES and the pass goes on inside the piece that holds the cut; the rows
of a smaller one are ranked. The first range is about sqrt(N) rows around the expected
cut; if the cut lies elsewhere, the side where it lies is the next range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnish.functions import dice
from tarnish.session import small_table, stored

RANGE = 1 << 31
BLOCKS = 4096
CHUNK = 32768
DRAWS_PER_TASK = 500_000
#: Rows that one window ranks, and pieces that a range of rolls is counted in.
RANKED, PIECES = 20_000, 4096
#: Populations up to so many times RANKED trust the expected number of rows in their first range; larger ones count it.
TRUSTED = 50
WIDTH = 8.0
#: Rows of a key that one window numbers; rows of a partition, for tables of more than so many partitions of them.
HOT, DEALT, FEW_DEALT = 100_000, 200_000, 10

Cut = tuple[int, int]
NOTHING: Cut = (-1, -1)
EVERYTHING: Cut = (RANGE, 0)


def affected(severity: float, population: int) -> int:
    """How many of ``population`` a severity hits: half-even rounding, at least 1 if positive."""
    if not 0 <= severity <= 1:
        raise ValueError("severity must be in [0, 1]")
    if severity == 0 or population == 0:
        return 0
    return min(population, max(1, round(severity * population)))


@dataclass(frozen=True)
class Stream:
    """Choose ``count`` rows by the hash stream with these seed words.

    With a ``group`` only rows of that group count, of which there are ``population``.
    """

    seeds: tuple[int, int]
    count: int
    group: str | None = None
    population: int | None = None


def _bracket(count: int, population: int, width: float) -> tuple[int, int]:
    share = count / population
    slack = width * (math.sqrt(population * share * (1 - share)) + 1.0)
    low = max(0, math.floor((count - slack) / population * RANGE))
    high = min(RANGE, math.ceil((count + slack) / population * RANGE) + 1)
    return low, high


def _step(low: int, high: int, rows: float) -> int:
    """Rolls of a piece of the range, or 0 where its rows are ranked."""
    return 0 if rows <= RANKED or high - low <= 1 else -(-(high - low) // PIECES)


#: SQL values of a rolled row: its piece (or its roll's place) in the range, or the side it lies on; its id where rows are ranked.
_PIECE = f"CASE WHEN h < low THEN -1L WHEN h >= high THEN {RANGE}L WHEN step = 0 THEN h - low ELSE (h - low) div step END AS piece"
_RANKED_ID = "if(h >= low AND h < high AND step = 0, k, -1L) AS k"


def _holding(rolled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., piece, k, n): the piece of each stream that holds the wanted rank.

    Rows outside the range fall into one group below and one above it; a filter instead would
    make the optimizer evaluate the rolls a second time.
    """
    counted = rolled.selectExpr(*keys, _PIECE, _RANKED_ID).groupBy(*keys, "piece", "k").agg(F.count("*").alias("n"))
    # RANKED rows or PIECES counts, and two more
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("piece", "k"))
    return counted.withColumn("upto", upto).where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))).drop("upto")


def _located(ids: DataFrame, key: str, slots: list[tuple]) -> dict[int, tuple[int, int, int, float]]:
    """{slot: (side of its range: -1, 0 or 1, piece, k, n)} of the piece that holds the wanted rank.

    Streams of equal seeds whose ranges lie apart share a row's roll and its count: the rows up to a
    range are those of all ranges below it and between them.
    """
    families: list[tuple[tuple[int, int], list[tuple]]] = []
    for slot in sorted(slots, key=lambda s: s[2]):
        home = next((some for seeds, some in families if seeds == slot[1].seeds and some[-1][3] <= slot[2]), None)
        if home is None:
            families.append((slot[1].seeds, [slot]))
        else:
            home.append(slot)
    most = max(len(some) for _, some in families)
    fields, wants, place = [], [], {}
    for f, (seeds, some) in enumerate(families):
        ranges = [(low, high, step) for _, _, low, high, step in some] + [(RANGE, RANGE, 1)] * (most - len(some))
        ends = "".join(f", 'low{j}', {low}L, 'high{j}', {high}L, 'step{j}', {step}L" for j, (low, high, step) in enumerate(ranges))
        fields.append(f"named_struct('family', {f}, 'one', {seeds[0]}L, 'two', {seeds[1]}L{ends})")
        wants += [(f, slot[0], slot[1].count) for slot in some]
        place |= {slot[0]: j for j, slot in enumerate(some)}

    def told(outside, inside, last) -> str:
        cases = " ".join(f"WHEN h < low{j} THEN {outside(j)} WHEN h < high{j} THEN {inside(j)}" for j in range(most))
        return f"CASE {cases} ELSE {last} END"

    slotted = ids.selectExpr(f"cast(`{key}` AS bigint) AS k", f"inline(array({', '.join(fields)}))")
    counted = dice.add_rolls(slotted, {"h": ("k", ("one", "two"))}).selectExpr(
        "family",
        told(lambda j: 2 * j, lambda j: 2 * j + 1, 2 * most) + " AS side",
        told(lambda j: "-1L", lambda j: f"if(step{j} = 0, h - low{j}, (h - low{j}) div step{j})", "-1L") + " AS piece",
        told(lambda j: "-1L", lambda j: f"if(step{j} = 0, k, -1L)", "-1L") + " AS k",
    ).groupBy("family", "side", "piece", "k").agg(F.count("*").alias("n"))
    # RANKED rows or PIECES counts of each stream, and the rows between
    upto = counted.withColumn("upto", F.sum("n").over(W.partitionBy("family").orderBy("side", "piece", "k")))
    holding = upto.join(small_table(ids.sparkSession, wants, "family int, slot int, want long"), "family").where("upto >= want AND upto - n < want")
    found = {}
    for row in holding.select("slot", "side", "piece", "k", "n").collect():
        own = 2 * place[row.slot] + 1
        side = (row.side > own) - (row.side < own)
        found[row.slot] = (side, row.piece, row.k, math.inf if side else row.n)
    return found


def find_cuts(
    ids: DataFrame, key: str, streams: list[Stream], population: int, group: str | None = None
) -> list[Cut]:
    """The cut of every stream over the unique integer column ``key``, all streams in the same passes.

    ``group`` names the column whose text the streams' groups refer to.
    """
    cuts: list[Cut | None] = [None] * len(streams)
    sizes = [population if s.population is None else s.population for s in streams]
    ranges: dict[int, tuple[int, int, float]] = {}
    for i, s in enumerate(streams):
        if s.count <= 0:
            cuts[i] = NOTHING
        elif s.count >= sizes[i]:
            cuts[i] = EVERYTHING
        else:
            low, high = _bracket(s.count, sizes[i], WIDTH)
            ranges[i] = (low, high, sizes[i] * (high - low) / RANGE if sizes[i] <= TRUSTED * RANKED else math.inf)
    while ranges:
        slots = [(i, streams[i], low, high, _step(low, high, rows)) for i, (low, high, rows) in ranges.items()]
        if group is None:
            found = _located(ids, key, slots)
        else:
            rows = [(s.group, i, *s.seeds, low, high, step, s.count) for i, s, low, high, step in slots]
            table = small_table(ids.sparkSession, rows, "g string, slot int, one long, two long, low long, high long, step long, want long")
            named = ids.selectExpr(f"cast(`{key}` AS bigint) AS k", f"cast(`{group}` AS string) AS g")
            rolled = dice.add_rolls(named.join(table, "g").drop("g"), {"h": ("k", ("one", "two"))})
            held = _holding(rolled, ["slot", "want"]).collect()
            found = {r.slot: ((r.piece == RANGE) - (r.piece < 0), r.piece, r.k, r.n) for r in held}
        for i, _, low, high, step in slots:
            if i not in found:
                raise ValueError("no cut found: are there fewer ids than the stated population?")
            side, piece, k, n = found[i]
            if side < 0:
                ranges[i] = (0, low, n)
            elif side > 0:
                ranges[i] = (high, RANGE, n)
            elif step:
                ranges[i] = (low + piece * step, min(high, low + (piece + 1) * step), n)
            else:
                cuts[i] = (low + piece, k)
                del ranges[i]
    return cuts  # type: ignore[return-value]


def group_cuts(ids: DataFrame, key: str, group: str, wanted: DataFrame) -> DataFrame:
    """As ``find_cuts``, for a table of streams: (group, slot, one, two, h, k) for ``wanted`` (group, slot, one, two, size, want).

    Streams and cuts stay tables, so groups may be as many as rows.
    """
    whole = wanted.where("want <= 0 OR want >= size").selectExpr(
        "group", "slot", "one", "two", f"if(want <= 0, {NOTHING[0]}L, {EVERYTHING[0]}L) AS h", f"if(want <= 0, {NOTHING[1]}L, {EVERYTHING[1]}L) AS k"
    )
    slack = f"{WIDTH} * (sqrt(want * (1 - want / size)) + 1.0)"
    ranges = wanted.where("want > 0 AND want < size").selectExpr(
        "*",
        f"greatest(0L, cast(floor((want - {slack}) / size * {RANGE}) AS bigint)) AS low",
        f"least({RANGE}L, cast(ceil((want + {slack}) / size * {RANGE}) AS bigint) + 1) AS high",
    ).selectExpr("group", "slot", "one", "two", "want", "low", "high", f"if(size <= {TRUSTED * RANKED}L, size * (high - low) / {RANGE}, double('infinity')) AS n")
    step = f"if(n <= {RANKED} OR high - low <= 1, 0L, (high - low + {PIECES - 1}) div {PIECES}) AS step"
    keys = ["group", "slot", "one", "two", "want", "low", "high", "step"]
    ranges, done = stored(ranges, "ranges"), whole
    named = ids.selectExpr(f"cast(`{key}` AS bigint) AS k", f"cast(`{group}` AS string) AS group")
    while not ranges.isEmpty():
        rolled = dice.add_rolls(named.join(ranges.selectExpr(*keys[:-1], step), "group"), {"h": ("k", ("one", "two"))})
        found = stored(_holding(rolled, keys), "holding")
        ranked = f"step = 0 AND piece >= 0 AND piece < {RANGE}"
        done = done.unionByName(found.where(ranked).selectExpr("group", "slot", "one", "two", "low + piece AS h", "k"))
        side = f"CASE WHEN piece < 0 THEN named_struct('low', 0L, 'high', low) WHEN piece = {RANGE} THEN named_struct('low', high, 'high', {RANGE}L) ELSE named_struct('low', low + piece * step, 'high', least(high, low + (piece + 1) * step)) END AS side"
        ranges = found.where(f"NOT ({ranked})").selectExpr("group", "slot", "one", "two", "want", "n", side)
        ranges = stored(ranges.selectExpr("group", "slot", "one", "two", "want", "side.low AS low", "side.high AS high", "cast(n AS double) AS n"), "ranges")
    return done


def below(rolled: str, key: str, cut: tuple) -> str:
    """SQL test: is this row among those up to the cut (numbers or expressions)?"""
    high, last = cut
    return f"({rolled} < {high} OR ({rolled} = {high} AND {key} <= {last}))"


def exact_sample(df: DataFrame, key: str, seeds: tuple[int, int], n: int, population: int | None = None) -> DataFrame:
    """Exactly n rows without replacement; ``key`` must be a unique integer."""
    population = df.count() if population is None else population
    if n > population:
        raise ValueError(f"only {population} rows available; requested {n}")
    (cut,) = find_cuts(df.select(key), key, [Stream(seeds, n)], population)
    return dice.add_rolls(df, {"_roll": (f"cast(`{key}` AS bigint)", seeds)}).filter(below("_roll", key, cut)).drop("_roll")


@dataclass(frozen=True)
class Draws:
    """``count`` draws with replacement from ``population`` rows."""

    label: tuple
    count: int

    @property
    def seeds(self) -> list[tuple[int, int]]:
        """Two words for the block of a draw, two for its place inside the block."""
        return [dice.seed_words(*self.label, part) for part in ("block-high", "block-low", "place-high", "place-low")]

    @property
    def row_seeds(self) -> tuple[int, int]:
        return dice.seed_words(*self.label, "rows")


def _places(spark: SparkSession, live: list[tuple[int, Draws]], population: int) -> DataFrame:
    """(set, block, place) of every draw, about DRAWS_PER_TASK of them in a task; a task holds all draws of its blocks.

    Draws are first only counted per block of positions; the places inside a
    block are then drawn where the block's count already sits, so single draws
    are never shuffled.
    """
    blocks = min(population, BLOCKS)
    words = ", ".join(
        f"named_struct('set', {i}, 'n', {d.count}L, "
        + ", ".join(f"'w{p}{q}', {w}L" for p, pair in enumerate(d.seeds) for q, w in enumerate(pair))
        + ")"
        for i, d in live
    )

    def place(key: str, first: int) -> dict[str, tuple]:
        return {f"_{side}": (key, (f"s.w{first + side}0", f"s.w{first + side}1")) for side in (0, 1)}

    drawn = dice.add_rolls(
        spark.range(max(d.count for _, d in live)).selectExpr("id", f"explode(array({words})) AS s").filter("id < s.n"),
        place("id", 0),
    ).select("s", dice.pick(F.col("_0"), F.col("_1"), population).alias("p"))
    counted = drawn.selectExpr("s", f"(p * {blocks}L) div {population}L AS block").groupBy("s", "block").count()
    start = f"(block * {population}L + {blocks - 1}L) div {blocks}L"
    stop = f"((block + 1) * {population}L + {blocks - 1}L) div {blocks}L"
    # the counts are tiny but the draws they stand for are not: spread them by the draws
    tasks = max(1, min(len(live) * blocks, sum(d.count for _, d in live) // DRAWS_PER_TASK + 1))
    unrolled = (
        counted.selectExpr("s.set AS set", "s", "block", "count")
        .repartition(tasks, "set", "block")
        .selectExpr("set", "s", "block", "count", f"explode(sequence(0L, (count - 1) div {CHUNK}L)) AS chunk")
        .selectExpr("set", "s", "block", f"explode(sequence(chunk * {CHUNK}L, least(count, (chunk + 1) * {CHUNK}L) - 1)) AS i")
        .selectExpr("set", "s", "block", "shiftleft(block, 40) + i AS key", f"{stop} - {start} AS width")
    )
    placed = dice.add_rolls(unrolled, place("key", 2))
    return placed.select("set", "block", dice.pick(F.col("_0"), F.col("_1"), F.col("width")).alias("place"))


def occupancy(spark: SparkSession, draws: list[Draws], population: int) -> list[list[int]]:
    """For every draw set: how many rows are drawn at least 1, 2, 3, ... times. A handful of numbers per draw set."""
    live = [(i, d) for i, d in enumerate(draws) if d.count > 0]
    result: list[list[int]] = [[] for _ in draws]
    if not live:
        return result
    placed = _places(spark, live, population)
    # a task counts its places by short keys; the seed words are not among them
    times = placed.groupBy("set", "block", "place").count().groupBy("set", F.col("count").alias("times")).count()
    for row in times.collect():
        levels = result[row.set]
        levels.extend([0] * (row.times - len(levels)))
        for level in range(row.times):
            levels[level] += row["count"]
    return result


def find_all_cuts(
    ids: DataFrame, key: str, streams: list[Stream], draws: list[Draws], population: int
) -> tuple[list[Cut], list[list[Cut]]]:
    """Cuts of choices without and of draws with replacement, in one pass over the ids.

    A draw set has cuts c1 >= c2 >= ...: a row is drawn once for every cut it is below.

    Under sampling with replacement all rows are alike, so given how many rows
    are drawn once, twice, ... any random assignment of rows to those counts
    has the right distribution; ranking rows by a hash is one, and needs no join.
    """
    levels = occupancy(ids.sparkSession, draws, population)
    first, streams, owner = len(streams), list(streams), []
    for i, (d, counts) in enumerate(zip(draws, levels, strict=True)):
        for count in counts:
            streams.append(Stream(d.row_seeds, count))
            owner.append(i)
    cuts: list[list[Cut]] = [[] for _ in draws]
    found = find_cuts(ids, key, streams, population)
    for i, cut in zip(owner, found[first:], strict=True):
        cuts[i].append(cut)
    return found[:first], cuts


def multiplicity(rolled: str, key: str, cuts: list[Cut]) -> str:
    """SQL value: how often a row was drawn, from its roll."""
    return " + ".join([f"cast({below(rolled, key, cut)} AS bigint)" for cut in cuts] or ["0L"])


def sample_with_replacement(df: DataFrame, key: str, label: tuple, n: int, population: int | None = None) -> DataFrame:
    """Rows drawn at least once, with the number of ``times``; the times add up to n."""
    population = df.count() if population is None else population
    draws = Draws(label, n)
    _, (cuts,) = find_all_cuts(df.select(key), key, [], [draws], population)
    rolled = dice.add_rolls(df, {"_roll": (f"cast(`{key}` AS bigint)", draws.row_seeds)})
    counted = rolled.withColumn("times", F.expr(multiplicity("_roll", key, cuts))).drop("_roll")
    return counted.filter("times > 0")


def hash_sample(df: DataFrame, key: str, seeds: tuple[int, int], n: int) -> DataFrame:
    """Order-independent sample of n rows, an error if there are fewer."""
    population = df.count()
    if population < n:
        raise ValueError(f"only {population} valid rows available; requested {n}")
    return exact_sample(df, key, seeds, n, population)


def dense_ids(df: DataFrame, keys: list[str], name: str = "row_id") -> DataFrame:
    """Number the rows 0..N-1 in key order, without a global window.

    Rows are range-partitioned and written with their place inside the
    partition; only the partition sizes are summed up on the driver. The
    stored places keep the ids the same however often they are read.
    End ``keys`` with a tie-break column when rows may be exact copies, so that
    a large group of copies is spread over several partitions.
    """
    low = (1 << 33) - 1
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = stored(placed, "placed")
    part = F.shiftright("_place", 33).cast("int")
    sizes = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row._part, total))
        total += row["count"]
    # one row per written partition
    offsets = small_table(df.sparkSession, starts, "_part int, _start long")
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_start") + F.col("_place").bitwiseAND(F.lit(low)))
        .drop("_part", "_start", "_place")
    )


def dealt_by(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows dealt by the key, a large table's into so many partitions that the size of one does not grow with it."""
    if rows <= FEW_DEALT * DEALT:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT)), key)


def key_starts(counts: DataFrame, key: str) -> DataFrame:
    """(key, _n, _start): how many rows the smaller keys have, from (key, _n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column("_n").to_numpy()
            upto = total + np.cumsum(n)
            total = int(upto[-1]) if len(upto) else total
            yield batch.append_column("_before", pa.array(upto - n))

    # written first, as finding the ranges reads the counts twice
    dealt = stored(counts, "key-counts").repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    kind = counts.schema[key].dataType.simpleString()
    placed = stored(dealt.select(key, "_n", "_part").mapInArrow(run, f"{key} {kind}, _n long, _part int, _before long"), "starts")
    starts, total = [], 0
    for row in placed.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect():
        starts.append((row._part, total))
        total += row.n
    offsets = small_table(counts.sparkSession, starts, "_part int, _first long")
    return placed.join(offsets, "_part").select(key, "_n", (F.col("_first") + F.col("_before")).alias("_start"))


def keyed_ids(df: DataFrame, key: str, rest: list[str], name: str, columns: list) -> DataFrame:
    """``columns`` of the rows numbered 0..N-1 by ``key``, never null, and ``rest``, as ``dense_ids`` numbers them, and written.

    Rows are counted by key, and keys, not rows, are sorted; a row's number is its key's first and its rank
    among the rows of the key. So whole rows travel once, to their key, and not at all if they
    are there already. Keys of more than HOT rows are numbered by ``dense_ids``.
    """
    starts = key_starts(df.groupBy(key).agg(F.count("*").alias("_n")), key)
    # as many as HOT goes into the rows
    hot = starts.where(F.col("_n") > HOT).orderBy(key).collect()
    few = df
    if hot:
        firsts, total = [], 0
        for row in hot:
            firsts.append((row[key], row._start - total))
            total += row._n
        crowded = small_table(df.sparkSession, firsts, f"{key} {starts.schema[key].dataType.simpleString()}, _shift long")
        few = df.join(crowded, key, "left_anti")
    rank = F.row_number().over(W.partitionBy(key).orderBy(*rest))
    numbered = few.join(starts, key).withColumn(name, F.col("_start") + rank - 1).select(name, *columns)
    if hot:
        many = dense_ids(df.join(crowded, key), [key, *rest], "_at")
        numbered = numbered.unionByName(many.withColumn(name, F.col("_at") + F.col("_shift")).select(name, *columns))
    return stored(numbered, "numbered")
