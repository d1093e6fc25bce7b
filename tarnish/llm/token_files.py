"""Token files: frequency-ranked ids in whole bytes, lengths in separate control bytes.

Ids are ranked by how often the corpus uses them, so that the most frequent 256 take one byte. A
control byte holds the byte counts (less one, two bits each) of four ids; data bytes follow each
other without marks. Readers look the four lengths of a control byte up in a table and gather the
data bytes with numpy. A file row is a block of whole documents, and its place in the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnish.llm.texts import per_text, sliced
from tarnish.llm.tokens import encoder, load
from tarnish.session import write_table

#: Ids per block, about; a document is never split.
BLOCK_IDS = 1 << 16
#: The four byte counts that each control byte states.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of a block's ranks."""
    values = ranks.astype("<u4")
    more = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = more
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= more[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a block."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8)]).astype(np.uint32)
    ranks = raw[starts]
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        ranks[longer] |= raw[starts[longer] + byte] << np.uint32(8 * byte)
    return ranks


@dataclass(frozen=True)
class TokenFiles:
    """Where the blocks are, and the id of each rank."""

    path: str
    id_of_rank: np.ndarray


def tokenised(docs: DataFrame, vocabulary: str, end_id: int | None) -> DataFrame:
    """(doc_id, ids): ids of the whole text and the end id, as unsigned integers of 16 or, for large vocabularies, 32 bits."""
    narrow = load(vocabulary).get_vocab_size() <= 1 << 16

    def ids(texts: list[str]) -> dict:
        found = encoder(vocabulary).encode(texts)
        if end_id is not None:
            end = np.uint32(end_id).astype("<u4").tobytes()
            found = [x + end for x in found]
        return {"ids": [np.frombuffer(x, dtype="<u4").astype("<u2").tobytes() for x in found] if narrow else found}

    return per_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ids, "ids binary")


def ranked_ids(tokens: DataFrame, vocabulary: str) -> np.ndarray:
    """All ids of the vocabulary, the most frequent first, ties by id. What reaches the driver is one row per id."""
    size = load(vocabulary).get_vocab_size()
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for piece in sliced(batch, "ids"):
                raw = b"".join(piece.column("ids").to_pylist())
                total += np.bincount(np.frombuffer(raw, dtype=kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size, dtype=np.int64)
    for row in rows:
        total[row["id"]] = row["n"]
    return np.argsort(-total, kind="stable")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int | None) -> TokenFiles:
    """Write every document's ids in ascending doc_id order (null ids first, equal ids in the order of their bytes)."""
    spark = docs.sparkSession
    kind_of_id = np.dtype("<u2" if load(vocabulary).get_vocab_size() <= 1 << 16 else "<u4")
    tokens = spark.read.parquet(write_table(tokenised(docs, vocabulary, end_id), "tokens", compression="zstd"))
    id_of_rank = ranked_ids(tokens, vocabulary)
    rank_of_id = np.empty(len(id_of_rank), dtype=np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "tie", "ids"]
    dealt = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).select("doc_id", "ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = pa.int32() if kind == "int" else pa.int64() if kind == "bigint" else pa.string()
    names = ["shard", "block", "start", "n_ids", "doc_ids", "counts", "control", "data"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join([raw for _, raw in held]), dtype=kind_of_id)
            values = [shard, block, start, size, [doc_id for doc_id, _ in held], [len(raw) // ids.itemsize for _, raw in held], *pack(rank_of_id[ids])]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for piece in sliced(batch, "ids"):
                for doc_id, raw in zip(piece.column("doc_id").to_pylist(), piece.column("ids").to_pylist()):
                    held.append((doc_id, raw))
                    size += len(raw) // kind_of_id.itemsize
                    if size >= BLOCK_IDS:
                        yield flush()
                        block, start, held, size = block + 1, start + size, [], 0
        if held:
            yield flush()

    schema = f"shard int, block long, start long, n_ids long, doc_ids array<{kind}>, counts array<long>, control binary, data binary"
    return TokenFiles(write_table(dealt.mapInArrow(blocks, schema), "token-files", compression="zstd"), id_of_rank)


def read_token_files(spark, files: TokenFiles, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document; ids are little-endian unsigned 32-bit integers.

    With ``digest`` their CRC-32 stands in for the ids, as ``ids_crc32``.
    """
    blocks = spark.read.parquet(files.path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # one row per shard: as many as the partitions they were written from
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    id_of_rank = files.id_of_rank.astype("<u4")
    last = ("ids_crc32", "long", pa.int64(), zlib.crc32) if digest else ("ids", "binary", pa.binary(), bytes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                counts = np.array(row["counts"].as_py(), dtype=np.int64)
                raw = id_of_rank[unpack(row["control"].as_py(), row["data"].as_py(), int(counts.sum()))].tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts + row["start"].as_py() + row["before"].as_py()
                made = [last[3](raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(made, last[2])],
                    names=["doc_id", "start", "n_tokens", last[0]],
                )

    return blocks.join(before, "shard").select("before", "start", "doc_ids", "counts", "control", "data").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, {last[0]} {last[1]}")


def token_digests(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from files that are written and read back.

    A null text is an empty one: its only id is the end id. Repeated rows are documents of their
    own, other columns are ignored, and an empty table gives no rows.
    """
    return read_token_files(docs.sparkSession, write_token_files(docs, vocabulary, end_id), digest=True)
