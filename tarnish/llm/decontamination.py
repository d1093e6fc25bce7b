"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A test item is contained in a document if a large enough share of its word shingles stands there.
Items are partitioned by their number of shingles; a partition's upper size bound sets how many of
an item's smallest shingle hashes form its sketch: one more than the shingles that an item of that
size may miss. So a document that contains an item shares at least one hash with its sketch, and
the search loses nothing. Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.texts import SPACES, unused
from tarnish.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE, CONTAINED = 5, 0.8
#: Sketch rows that are broadcast (about 3 MB); a larger table is joined by shuffling.
BROADCAST_ROWS = 100_000


def folded_words(text: Column) -> Column:
    """Words between space characters, A-Z lower-cased; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACES), lambda w: w != "")


def _runs(column: str, k: int, use) -> Column:
    """``use`` of the k elements from each place on; empty for shorter arrays.

    The array is a column, as an expression would be evaluated anew for each element.
    """
    values = F.col(column)
    at = F.sequence(F.lit(0), F.greatest(F.size(values) - k, F.lit(0)))
    return F.when(F.size(values) < k, F.array()).otherwise(F.transform(at, lambda i: use([F.get(values, i + j) for j in range(k)])))


def shingle_hashes(word_hashes: str, k: int) -> Column:
    return _runs(word_hashes, k, lambda e: F.xxhash64(*e)).cast("array<bigint>")


def shingle_texts(words: str, k: int) -> Column:
    return F.array_distinct(_runs(words, k, lambda e: F.concat_ws(" ", *e)).cast("array<string>"))


def item_shingles(items: DataFrame, k: int) -> DataFrame:
    """(item_id, shingles, n) of each distinct (id, text); items of fewer than k words have no shingles and are left out."""
    return (
        items.select("item_id", "text")
        .distinct()
        .select("item_id", folded_words(F.col("text")).alias("words"))
        .select("item_id", shingle_texts("words", k).alias("shingles"))
        .withColumn("n", F.size("shingles").cast("long"))
        .where("n > 0")
        .withColumn("item", F.xxhash64("item_id", "shingles"))
    )


def sketches(items: DataFrame, contained: float) -> DataFrame:
    """(item, needed, hash): each item's smallest shingle hashes, and how many a document must share.

    Partition p has the items of 2^p to 2^(p+1) - 1 shingles, whose sketches are sized for the
    largest of them.
    """
    may_miss = lambda n: n - F.ceil(F.lit(contained) * n - 1e-9)
    bound = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("long") - 1
    hashed = items.select("item", "n", F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(*[F.xxhash64(F.get(F.split(s, " "), F.lit(j))) for j in range(SHINGLE)]))).alias("hashes"))
    sized = hashed.withColumn("sketch", F.slice(F.sort_array("hashes"), F.lit(1), (may_miss(bound) + 1).cast("int")))
    needed = F.greatest(F.lit(1).cast("long"), F.size("sketch") - may_miss(F.col("n")))
    return sized.select("item", needed.alias("needed"), F.explode("sketch").alias("hash"))


def contained_items(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every document and item that it contains.

    ``contained`` is the least share of an item's distinct 5-word shingles (A-Z lower-cased).
    Items of fewer than five words match nothing, nor do null texts. Null ids stay; rows that
    repeat both id and text have one row per item, rows that hold one id with several texts are
    documents of their own, items that repeat are one item; other columns are ignored.
    """
    found = _proven(docs, items, contained)
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def documents_without_items(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The documents, all columns, that contain no item."""
    c_id, c_key = unused(docs, "c_id"), unused(docs, "c_key")
    found = _proven(docs, items, contained).select(F.col("doc_id").alias(c_id), F.col("text_key").alias(c_key)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(c_id)) & (F.xxhash64(docs["text"]) == F.col(c_key)), "left_anti")


def _proven(docs: DataFrame, items: DataFrame, contained: float) -> DataFrame:
    wanted = stored(item_shingles(items, SHINGLE), "items")
    sketch = stored(sketches(wanted, contained), "sketches")
    if sketch.count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    coded = keyed.select("doc_id", "text_key", F.transform(folded_words(F.col("text")), lambda w: F.xxhash64(w)).alias("codes"))
    hashes = coded.select("doc_id", "text_key", F.explode(shingle_hashes("codes", SHINGLE)).alias("hash"))
    hits = hashes.join(sketch, "hash").groupBy("doc_id", "text_key", "item", "needed").agg(F.count_distinct("hash").alias("hits")).where("hits >= needed")
    # the guess at a document's items is small beside the documents, which are read again for the proof
    guess = hits.groupBy("doc_id", "text_key").agg(F.collect_set("item").alias("guessed")).select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "guessed")
    near = keyed.join(guess, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")))
    one_each = near.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.first("guessed").alias("guessed"))
    shingled = one_each.select("doc_id", "text_key", "guessed", folded_words(F.col("text")).alias("words")).select("doc_id", "text_key", F.explode("guessed").alias("item"), shingle_texts("words", SHINGLE).alias("own"))
    shared = shingled.join(wanted, "item").select("doc_id", "text_key", "item_id", F.col("n").alias("n_shingles"), F.size(F.array_intersect("shingles", "own")).cast("long").alias("n_shared"))
    # a filter on top would be pushed into the shingling, where the words are split once per element
    shared = stored(shared, "shared")
    return shared.where(F.col("n_shared") >= F.ceil(F.lit(contained) * F.col("n_shingles") - 1e-9))
