"""Helpers for work on whole texts: Arrow batches in bounded slices, and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a task turns into Python objects at a time; a longer text comes alone.
SLICE_BYTES = 1 << 20
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
#: Java's regular expression and Python's bytes.split() agree on these six characters.
SPACES = r"[\x20\x09-\x0D]+"


def sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE_BYTES of a text or binary column."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    group = np.cumsum(lengths) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def fields_of(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(part.split()[0], _KINDS[part.split()[1]]) for part in schema.split(", ")]


def per_text(df: DataFrame, work: Callable[[list[str]], dict], schema: str, text: str = "text") -> DataFrame:
    """The other columns of ``df`` as they are, and what ``work`` makes of each slice's texts, one row each."""
    kept = [f for f in df.schema.fields if f.name != text]
    fields = fields_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, text):
                made = work(piece.column(text).to_pylist())
                arrays = [piece.column(f.name) for f in kept] + [pa.array(made[name], kind) for name, kind in fields]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [name for name, _ in fields])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), schema])
    return df.mapInArrow(run, ddl)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: A random number for each byte value, the base of the polynomials and its inverse modulo 2^64.
BYTE_CODES = _odd(11, 256)
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; the longest table asked for is kept up to 2^22 entries."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(IS_SPACE[data], out=inside[1:-1].view(bool))
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each span, whatever stands around it."""
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * powers(BASE, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(UNBASE, n + 1)[starts])


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a byte array."""
    starts, ends = word_bounds(data)
    return span_hashes(BYTE_CODES[data], starts, ends), starts, ends


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    return span_hashes(codes, at, at + k)
