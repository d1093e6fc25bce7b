"""What the two searches for repeated passages share: anchors, their contexts, and the way back to documents.

A passage is a window of ``width`` symbols (words or bytes). Each window has an anchor: the place
of the smallest hash among its runs of ``k`` symbols. Equal windows have their anchors at equal
offsets, so only suffixes that start at anchors have to be compared, one in (width - k) / 2 or so.
An anchor's context is the text of all windows that chose it.

1. Anchors whose run of k symbols stands alone in the corpus are dropped: counts, no texts.
2. Contexts that occur twice or more as a whole are repeated as a whole; one of each stays.
3. The contexts that are left travel, by the run they begin with, to the operator's own search.
   A run with more than CROWDED different contexts is not gathered: its prefix is made longer, by
   halves of the offsets at which windows may hold the anchor, until the groups fit or the prefix
   is a whole window, for which a count is enough.
4. The spans found go back to the documents they come from.

Documents are known by their id and a hash of their text, so rows that repeat an id are apart, and
rows that repeat both have the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnish.llm.texts import BASE, BYTE_CODES, UNBASE, fields_of, mixed, powers, sliced, word_bounds, word_hashes
from tarnish.session import stored

#: Different contexts of one prefix that a task compares.
CROWDED = 4000
#: Symbols that are hashed together; a longer document is hashed alone.
BLOCK = 1 << 16
KEY = ["ka", "kb"]


@dataclass(frozen=True)
class Alphabet:
    """Words or bytes: the window, the run that anchors hash, and how a text becomes symbols."""

    name: str
    width: int
    k: int

    @property
    def reach(self) -> int:
        """Offsets at which a window may hold its anchor."""
        return self.width - self.k + 1

    def codes(self, data: np.ndarray) -> np.ndarray:
        return word_hashes(data)[0] if self.name == "words" else BYTE_CODES[data]

    def pieces(self, text: bytes) -> Callable[[int, int], bytes]:
        """A function that gives the symbols from one place up to another."""
        if self.name == "bytes":
            return lambda a, b: text[a:b]
        words = text.split()
        return lambda a, b: b" ".join(words[a:b])

    def length(self, content: bytes) -> int:
        return content.count(b" ") + 1 if self.name == "words" else len(content)

    def kept(self, text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
        """(symbols, removed symbols, removed runs, what is left) of a text without its spans."""
        symbols = text.split() if self.name == "words" else text
        parts, at, removed, runs = [], 0, 0, 0
        for a, b in merged(spans):
            parts.append(symbols[at:a])
            removed += b - a
            runs += 1
            at = b
        parts.append(symbols[at:])
        left = b"".join(parts) if self.name == "bytes" else b" ".join([w for part in parts for w in part])
        return len(symbols), removed, runs, left


def merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The union of spans, in order."""
    start = stop = None
    for a, b in sorted(spans):
        if stop is None or a > stop:
            if stop is not None:
                yield start, stop
            start, stop = a, b
        else:
            stop = max(stop, b)
    if stop is not None:
        yield start, stop


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of a UTF-8 text, each widened to the characters that it touches."""

    def begin(at: int) -> int:
        while text[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def end(at: int) -> int:
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return at

    return [(begin(a), end(b)) for a, b in spans]


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values the place of the first of its smallest."""
    best, at, span = values, np.arange(len(values)), 1

    def joined(step: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(best) - step
        later = best[step:] < best[:n]
        return np.where(later, best[step:], best[:n]), np.where(later, at[step:], at[:n])

    while 2 * span <= w:
        best, at = joined(span)
        span *= 2
    if span < w:
        best, at = joined(w - span)
    return at


def anchors(codes: list[np.ndarray], alphabet: Alphabet) -> tuple[np.ndarray, ...]:
    """(document, anchor, offset of the first window, further windows, run hash, context hash) of each anchor."""
    width, k = alphabet.width, alphabet.k
    lengths = np.array([len(c) for c in codes], dtype=np.int64)
    ends = np.cumsum(lengths)
    joined = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint64)
    n = len(joined)
    if n < width:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(joined * powers(BASE, n), out=sums[1:])
    undo = powers(UNBASE, n + 1)
    runs = mixed((sums[k:] - sums[:-k]) * undo[: n - k + 1])
    chosen = sliding_least(runs, alphabet.reach)
    # windows that cross into the next document are none
    crossing = np.zeros(n + 1, dtype=np.int32)
    np.add.at(crossing, np.maximum(ends - width + 1, ends - lengths), 1)
    np.add.at(crossing, ends, -1)
    windows = np.flatnonzero(np.cumsum(crossing[: n - width + 1]) == 0)
    if not len(windows):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    anchor = chosen[windows]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    anchor, low, high = anchor[first], windows[first], windows[last]
    document = np.searchsorted(ends, anchor, side="right")
    whole = (sums[high + width] - sums[low]) * undo[low]
    context = mixed(whole ^ mixed((anchor - low).astype(np.uint64) * np.uint64(BASE) + (high - low).astype(np.uint64)))
    return document, anchor - (ends - lengths)[document], anchor - low, high - low, runs[anchor], context


def with_key(docs: DataFrame, carried: list[str]) -> DataFrame:
    """(row, text, ka, kb): the carried columns, the text and a key, of which the last three are never null."""
    whole = isinstance(docs.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType))
    text = F.coalesce("text", F.lit(""))
    ka = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")) if whole else F.xxhash64("doc_id")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), text.alias("text"), ka.alias("ka"), F.xxhash64(text, F.col("doc_id").isNull()).alias("kb"))


def _table(arrays: list, schema: str) -> pa.RecordBatch:
    fields = fields_of(schema)
    return pa.RecordBatch.from_arrays([pa.array(a, kind) for a, (_, kind) in zip(arrays, fields)], names=[name for name, _ in fields])


ANCHORS = "ka long, kb long, h long, context long, at long, left long, more long"


def anchor_table(keyed: DataFrame, alphabet: Alphabet) -> DataFrame:
    """A row for each anchor of each document; no texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, "text"):
                ka, kb = (piece.column(c).to_numpy() for c in KEY)
                codes: list[np.ndarray] = []
                rows: list[int] = []
                for i, text in enumerate(piece.column("text").cast(pa.binary())):
                    found = alphabet.codes(np.frombuffer(text.as_buffer(), dtype=np.uint8)) if len(text.as_buffer()) else ()
                    if len(found) >= alphabet.width:
                        codes.append(found)
                        rows.append(i)
                    if sum(map(len, codes[-1:])) and sum(map(len, codes)) >= BLOCK:
                        yield flush(codes, rows, ka, kb)
                        codes, rows = [], []
                if codes:
                    yield flush(codes, rows, ka, kb)

    def flush(codes: list[np.ndarray], rows: list[int], ka: np.ndarray, kb: np.ndarray) -> pa.RecordBatch:
        document, at, left, more, h, context = anchors(codes, alphabet)
        row = np.array(rows, dtype=np.int64)[document]
        return _table([ka[row], kb[row], h.view(np.int64), context.view(np.int64), at, left, more], ANCHORS)

    return keyed.select("text", *KEY).mapInArrow(find, ANCHORS)


CONTEXT = "h long, ka long, kb long, at long, left long, content binary"
SPANS = "ka long, kb long, start long, stop long"


def _sorted_groups(contexts: DataFrame, solve: Callable, alphabet: Alphabet) -> DataFrame:
    """``solve`` of all contexts, given whole groups of equal h at a time."""
    dealt = contexts.select("h", "ka", "kb", "at", "left", "content").repartition("h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            h = held.column("h").to_numpy()
            if not len(h):
                continue
            cut = int(np.searchsorted(h, h[-1], side="left"))
            if cut:
                yield from solved(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from solved(held)

    def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h = table.column("h").to_numpy()
        # several thousand contexts at a time, cut between groups
        fresh = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        cuts = [0]
        for f in fresh.tolist() + [len(h)]:
            if f - cuts[-1] >= CROWDED:
                cuts.append(f)
        if cuts[-1] != len(h):
            cuts.append(len(h))
        for a, b in zip(cuts, cuts[1:]):
            part = table.slice(a, b - a)
            contents = part.column("content").to_pylist()
            at, left = part.column("at").to_numpy(), part.column("left").to_numpy()
            member, before, after = solve(h[a:b], left, contents, alphabet)
            yield _table([part.column("ka").to_numpy()[member], part.column("kb").to_numpy()[member], at[member] - before, at[member] + after], SPANS)

    return dealt.mapInArrow(run, SPANS)


def _whole(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Spans of contexts that are repeated as a whole."""
    start = F.col("at") - F.col("left")
    return rows.select(*KEY, start.alias("start"), (start + F.col("more") + F.lit(alphabet.width)).alias("stop"))


def _longer_prefixes(crowded: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Each context twice, for the windows that hold the anchor early and late, each by the prefix these share."""
    width = alphabet.width
    schema = f"{CONTEXT}, low long, high long"

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, ka, kb, at, left, content, low, high in zip(*[batch.column(c).to_pylist() for c, _ in fields_of(schema)]):
                piece = alphabet.pieces(content)
                least = left - (alphabet.length(content) - width)
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(a, least), min(b, left)
                    if a > b or first > last:
                        continue
                    prefix = piece(left - a, left + width - b)
                    code = xxhash.xxh64_intdigest(prefix, seed=(h ^ (a << 20) ^ b) & 0xFFFFFFFFFFFFFFFF)
                    rows.append((code - (1 << 64) if code >> 63 else code, ka, kb, at, last, piece(left - last, left + width - first), a, b))
            yield _table(list(zip(*rows)) if rows else [[]] * 8, schema)

    return crowded.select(*[c for c, _ in fields_of(schema)]).mapInArrow(halves, schema)


def _crowded_spans(crowded: DataFrame, solve: Callable, alphabet: Alphabet) -> DataFrame:
    """Spans among contexts whose prefix is too frequent to be gathered; at most log2(reach) + 1 rounds."""
    spans = []
    crowded = crowded.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(alphabet.reach - 1).cast("long"))
    while True:
        split = stored(_longer_prefixes(crowded, alphabet).withColumn("context", F.xxhash64("left", "content", "h")), "prefixes")
        more = (F.octet_length("content") if alphabet.name == "bytes" else F.size(F.split(F.col("content").cast("string"), " "))) - alphabet.width
        same = stored(split.groupBy("h", "context").agg(F.count("*").alias("c"), F.min(F.struct("ka", "kb", "at")).alias("one")), "contexts")
        twice = same.where("c > 1").select("h", "context")
        spans.append(_whole(split.withColumn("more", more.cast("long")).join(twice, ["h", "context"], "left_semi"), alphabet))
        different = stored(same.groupBy("h").agg(F.count("*").alias("d")).where("d > 1"), "different")
        one_each = split.join(same.select("h", "context", "one.*"), ["h", "context", "ka", "kb", "at"], "left_semi")
        left_over = stored(one_each.join(different, "h"), "prefixes")
        spans.append(_sorted_groups(left_over.where(F.col("d") <= CROWDED), solve, alphabet))
        crowded = left_over.where(F.col("d") > CROWDED)
        if crowded.isEmpty():
            break
    found = spans[0]
    for part in spans[1:]:
        found = found.unionByName(part)
    return found


def repeated_spans(keyed: DataFrame, alphabet: Alphabet, solve: Callable, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): documents that may hold spans with their texts, the others with their digest (or text, on request)."""
    rows = anchor_table(keyed, alphabet)
    # counts are written, so that the joins below are of two shuffles and Spark can split a frequent key
    again = stored(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    survivors = stored(rows.join(again, "h", "left_semi"), "anchors")
    place = F.struct("ka", "kb", "at", "left", "more")
    same = stored(survivors.groupBy("h", "context").agg(F.count("*").alias("c"), F.min(place).alias("one")), "contexts")
    whole = _whole(survivors.join(same.where("c > 1").select("h", "context"), ["h", "context"], "left_semi"), alphabet)
    different = stored(same.groupBy("h").agg(F.count("*").alias("d")).where("d > 1"), "different")
    wanted = same.join(different, "h").select("one.*", "h", (F.col("d") > CROWDED).alias("crowd"))
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("h", "at", "left", "more", "crowd")).alias("w"))
    touched = survivors.join(same.where("c > 1").select("h", "context"), ["h", "context"], "left_semi").select(*KEY).distinct()
    notes = lists.join(touched.withColumn("touched", F.lit(True)), KEY, "full")
    documents = stored(_documents(keyed.join(notes, KEY, "left"), alphabet, with_text), "documents")
    contexts = documents.where("size(h) > 0").select(*KEY, F.explode(F.arrays_zip("h", "at", "left", "content", "crowd")).alias("c")).select(*KEY, "c.*")
    spans = whole.unionByName(_sorted_groups(contexts.where("NOT crowd"), solve, alphabet))
    crowded = contexts.where("crowd")
    if not different.where(F.col("d") > CROWDED).isEmpty():
        spans = spans.unionByName(_crowded_spans(crowded, solve, alphabet))
    return documents, spans


def _documents(noted: DataFrame, alphabet: Alphabet, with_text: bool) -> DataFrame:
    """Texts and contexts of documents that may hold repeats; of the others, what the result needs."""
    kind = noted.schema["row"].dataType.simpleString()
    rest = "ka long, kb long, text string, n long, digest string, h array<long>, at array<long>, left array<long>, content array<binary>, crowd array<boolean>"
    names = [name for name, _ in fields_of("ka long, kb long, text string, n long, digest string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                texts, digests, counts, lists = [], [], [], []
                for text, wanted, touched in zip(*[part.column(c).to_pylist() for c in ("text", "w", "touched")]):
                    raw = text.encode()
                    if not wanted and not touched:
                        n, _, _, left = alphabet.kept(raw, [])
                        texts.append(text if with_text else None)
                        counts.append(n)
                        digests.append(hashlib.sha256(left).hexdigest())
                        lists.append(([], [], [], [], []))
                        continue
                    texts.append(text)
                    counts.append(None)
                    digests.append(None)
                    piece = alphabet.pieces(raw)
                    wanted = wanted or []
                    lists.append(
                        (
                            [w["h"] for w in wanted],
                            [w["at"] for w in wanted],
                            [w["left"] for w in wanted],
                            [piece(w["at"] - w["left"], w["at"] - w["left"] + w["more"] + alphabet.width) for w in wanted],
                            [w["crowd"] for w in wanted],
                        )
                    )
                arrays = [part.column("row"), part.column("ka"), part.column("kb"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
                arrays += [pa.array([x[j] for x in lists], pa.list_(kinds[j])) for j in range(5)]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", *names, "h", "at", "left", "content", "crowd"])

    return noted.select("row", "text", *KEY, "w", "touched").mapInArrow(run, f"row {kind}, {rest}")


def without_repeats(docs: DataFrame, alphabet: Alphabet, solve: Callable, carried: list[str], with_text: bool = False) -> DataFrame:
    """(row, n, n_removed, n_spans, digest, kept) of each document after every repeated window is cut out.

    ``row`` holds the carried columns, ``digest`` the SHA-256 of what is left, in lowercase hex,
    and ``kept``, on request, what is left as bytes; characters then are cut as a whole.
    """
    documents, spans = repeated_spans(with_key(docs, carried), alphabet, solve, with_text)
    # rows that repeat a document have the same spans, so once per key is enough
    lists = spans.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    hurt = documents.where("digest IS NULL").select("row", *KEY, "text").join(lists, KEY, "left")
    kind = documents.schema["row"].dataType.simpleString()
    made = "n long, n_removed long, n_spans long, digest string, kept binary"
    fields = fields_of(made)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                found = []
                for text, held in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    data, cuts = text.encode(), [(s["start"], s["stop"]) for s in held or []]
                    n, removed, runs, left = alphabet.kept(data, whole_characters(data, cuts) if with_text else cuts)
                    found.append((n, removed, runs, hashlib.sha256(left).hexdigest(), left if with_text else None))
                arrays = [pa.array([f[j] for f in found], t) for j, (_, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *arrays], names=["row", *[name for name, _ in fields]])

    done = hurt.select("row", "text", "spans").mapInArrow(cut, f"row {kind}, {made}")
    zero = F.lit(0).cast("long")
    plain = documents.where("digest IS NOT NULL").select("row", "n", zero.alias("n_removed"), zero.alias("n_spans"), "digest", F.col("text").cast("binary").alias("kept"))
    return done.unionByName(plain)
