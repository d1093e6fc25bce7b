"""How the sources of a language differ in their use of words.

In-mapper stripes: a task folds whole documents into one stripe per (language, term), the number
of documents that hold the term and its occurrences per source, and spills them as rows when they
outgrow their bounds. Stripes of a term meet by key and are merged; those of kept terms give the
divergences directly, a block of terms by sources at a time.

A portion is 1 + floor(SCALE * (count + WEIGHT) / (N + WEIGHT * V)) with integers throughout.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnish.llm.texts import sliced
from tarnish.session import stored

SCALE_STEPS, WEIGHT = 3, 5
#: Documents of its language that a term must stand in, and ranks of the term part.
LEAST_DOCS, TOP = 30, 50
#: Entries (term and source) and bytes of terms that a task holds before it spills.
ENTRIES, TERM_BYTES = 400_000, 32 << 20
#: Cells of a block of terms by sources.
CELLS = 1 << 19
#: Letters and all bytes of other scripts stay, A-Z in lower case; every other byte parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
CELL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


class Stripes:
    """The stripes of a task: documents per (language, term), occurrences per (language, source) and term."""

    def __init__(self) -> None:
        self.documents: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.bytes = 0

    def fold(self, lang: str, source: str, text: bytes) -> None:
        terms = text.translate(LETTERS).split()
        different = set(terms)
        self.counts[lang, source].update(terms)
        self.documents[lang].update(different)
        self.bytes += sum(map(len, different))

    def full(self) -> bool:
        if self.bytes > TERM_BYTES:  # terms met again were added again
            self.bytes = sum(sum(map(len, held)) for held in self.documents.values())
        return self.bytes > TERM_BYTES or sum(map(len, self.counts.values())) > ENTRIES

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All stripes as rows; nothing is held afterwards."""
        for lang, held in self.documents.items():
            if not held:
                continue
            place = {term: i for i, term in enumerate(held)}
            sources = [source for of, source in self.counts if of == lang]
            parts = [self.counts[lang, source] for source in sources]
            at = np.concatenate([np.fromiter(map(place.__getitem__, part), np.int64, len(part)) for part in parts])
            order = np.argsort(at, kind="stable")
            owner = np.repeat(np.arange(len(parts)), [len(part) for part in parts])[order]
            counts = np.concatenate([np.fromiter(part.values(), np.int64, len(part)) for part in parts])[order]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(held)))]), pa.int32())
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(held), pa.string()),
                    pa.array(list(held), pa.binary()).cast(pa.string()),
                    pa.array(list(held.values()), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(sources, pa.string()).take(pa.array(owner))),
                    pa.ListArray.from_arrays(offsets, pa.array(counts)),
                ],
                schema=STRIPE,
            )
            for lo in range(0, rows.num_rows, 20_000):
                yield rows.slice(lo, 20_000)
        self.__init__()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for batch in batches:
        for piece in sliced(batch, "text"):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            for lang, source, text in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), texts):
                stripes.fold(lang, source, text)
            if stripes.full():
                yield from stripes.spill()
    yield from stripes.spill()


def merged_stripes(stripes: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, stripe): one row for each term of enough documents, its counts by source.

    All rows of a term come together in one shuffle; they are one for each spill, whatever the corpus holds.
    """
    entry = F.posexplode(F.arrays_zip("sources", "counts")).alias("at", "entry")
    # the document frequency of a stripe counts with its first source
    entries = stripes.repartition("lang", "term").select("lang", "term", "df", entry).select("lang", "term", F.when(F.col("at") == 0, F.col("df")).otherwise(0).alias("df"), F.col("entry.sources").alias("source"), F.col("entry.counts").alias("n"))
    by_source = entries.groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    whole = by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("stripe"))
    return whole.where(F.col("df") >= least_docs).select("lang", "term", "stripe")


def portions(counts: np.ndarray, totals: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + WEIGHT) / (total + WEIGHT n_terms)), three decimal digits at a time so that 64 bits suffice."""
    whole = totals + WEIGHT * n_terms
    rest, quotient = counts + WEIGHT, np.zeros_like(counts)
    first, rest = np.divmod(rest, whole)
    quotient += first
    for _ in range(SCALE_STEPS):
        digits, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digits
    return quotient + 1


def _first(gain: np.ndarray, top: int) -> np.ndarray:
    """Places of the positive gains that are among the ``top`` greatest, ties of the last one included."""
    places = np.flatnonzero(gain > 0)
    if len(places) > top:
        places = places[gain[places] >= -np.partition(-gain[places], top - 1)[top - 1]]
    return places


def _cells(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Sums of differences between sources over the task's terms, and the terms that may be among the first."""
    sums: dict[str, np.ndarray] = {}
    names: dict[str, pa.Array] = {}
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = batch.take(pa.array(np.flatnonzero(langs.indices.to_numpy() == code)))
            profile = rows.column("profile")[0].values
            names[lang], totals = profile.field("source"), profile.field("n").to_numpy()
            width, n_terms = len(totals), rows.column("n_terms")[0].as_py()
            sums.setdefault(lang, np.zeros((width, width), dtype=np.int64))
            for lo in range(0, rows.num_rows, max(1, CELLS // width)):
                block = rows.slice(lo, max(1, CELLS // width))
                stripe = block.column("stripe")
                entries = stripe.flatten()
                counts = np.zeros((block.num_rows, width), dtype=np.int64)
                at = np.repeat(np.arange(block.num_rows), pc.list_value_length(stripe).to_numpy())
                counts[at, pc.index_in(entries.field("source"), names[lang]).to_numpy()] = entries.field("n").to_numpy()
                own = portions(counts, totals, n_terms)
                base = portions(counts.sum(axis=1), totals.sum(), n_terms)
                for i in range(width):
                    sums[lang][i] += np.abs(own - own[:, [i]]).sum(axis=0)
                    gain = np.where(counts[:, i] > 0, own[:, i] - base, 0)
                    places = pa.array(_first(gain, top))
                    yield _rows(lang, names[lang][i], "term", block.column("term").take(places), gain[places])
    for lang, square in sums.items():
        for i, source in enumerate(names[lang]):
            yield _rows(lang, source, "pair", names[lang], square[i])


def _rows(lang: str, source: pa.Scalar, part: str, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source.as_py()] * n, pa.string()), pa.array([part] * n, pa.string()), items, pa.array(values, pa.int64())], schema=CELL)


def source_divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs.

    Part ``pair``: the sum over the language's kept terms of the difference between the portions of
    the source and of another one. Part ``term``: terms that the source has and uses more than its
    language does, the first ``top`` of them. Null text, language and source are empty strings, a
    language and a source like any other; a group without terms counts nothing and keeps its rows;
    a language without kept terms has pairs of value 0 and no terms. Repeated rows are documents of
    their own; other columns are ignored. Ranks go by value, then by the bytes of the item.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    folded = plain.mapInArrow(_fold, "lang string, term string, df long, sources array<string>, counts array<long>")
    kept = stored(merged_stripes(folded, least_docs), "stripes")
    groups = stored(plain.select("lang", "source").distinct(), "groups")
    counted = kept.select("lang", F.explode("stripe").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"))
    sized = groups.join(counted, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    profiles = sized.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("profile"))
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    described = stored(profiles.join(n_terms, "lang"), "profiles")
    found = kept.join(described, "lang").mapInArrow(lambda batches: _cells(batches, top), "lang string, source string, part string, item string, value long")
    others = groups.select("lang", F.col("source").alias("item"))
    nothing = groups.join(others, "lang").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = found.unionByName(nothing).where((F.col("part") == "term") | (F.col("source") != F.col("item"))).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return summed.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
