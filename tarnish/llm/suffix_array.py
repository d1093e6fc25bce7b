"""Substring dedup over bytes by the common-prefix interval tree of an enhanced suffix array.

Suffixes start at anchors (see ``repeats``). Sorted, with the lengths of the prefixes that
neighbours share, they form an enhanced suffix array, whose common-prefix intervals nest; a scan
with a stack lists them. All suffixes of an interval share its prefix, not only neighbours, so an
interval is a repeat with all its occurrences. Where the bytes to their left are diverse, sorting
them tells how far to the left each occurrence agrees with another; if that and the prefix make a
window, the occurrence is cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm import repeats
from tarnish.llm.suffix_trees import Spans, _rows, left_partners, ordered, shared_lengths

WIDTH, K = 200, 48
#: Interval members whose left contexts are compared at a time.
MEMBERS = 20_000


def intervals(shared: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, depth) of the maximal ranges of the sorted suffixes that share ``depth`` >= ``least`` symbols.

    ``shared[i]`` is what suffix i shares with the one before it; the stack holds the open ranges,
    each inside the one below it.
    """
    found = []
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*shared.tolist(), 0]):
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, open_depth = stack.pop()
            found.append((first, i - 1, open_depth))
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))
    return found


def solve(h: np.ndarray, left: np.ndarray, contents: list[bytes], alphabet: repeats.Alphabet) -> tuple[np.ndarray, ...]:
    """(member, bytes to the left, bytes to the right) of the contexts that a repeated window crosses."""
    codes = np.frombuffer(b"".join(contents), dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    first = np.cumsum([0] + [len(c) for c in contents])
    left = left.astype(np.int64)
    right = first[1:] - first[:-1] - left
    right_rows = _rows(codes, first[:-1] + left, right, alphabet.width, 1)
    left_rows = _rows(codes, first[:-1] + left - 1, left, max(1, alphabet.reach - 1), -1)
    lrank = np.empty(len(h), dtype=np.int64)
    lrank[ordered(left_rows)] = np.arange(len(h))

    group = np.unique(h, return_inverse=True)[1]
    suffixes = ordered(right_rows)
    suffixes = suffixes[np.argsort(group[suffixes], kind="stable")]
    shared = shared_lengths(right_rows, suffixes[:-1], suffixes[1:], right)
    shared[group[suffixes[1:]] != group[suffixes[:-1]]] = 0
    spans = Spans(len(h))
    nodes = intervals(np.concatenate([[0], shared]), alphabet.k)
    held: list[tuple[int, int, int]] = []
    size = 0
    for node in nodes:
        held.append(node)
        size += node[1] - node[0] + 1
        if size >= MEMBERS:
            _judge(spans, held, suffixes, lrank, left_rows, left, alphabet)
            held, size = [], 0
    if held:
        _judge(spans, held, suffixes, lrank, left_rows, left, alphabet)
    return spans.found()


def _judge(spans: Spans, nodes: list[tuple[int, int, int]], suffixes: np.ndarray, lrank, left_rows, left, alphabet) -> None:
    """Widen the spans of intervals whose prefix, with what members share to the left, makes a window."""
    low, high, depth = (np.array(x, dtype=np.int64) for x in zip(*nodes))
    sizes = high - low + 1
    node = np.repeat(np.arange(len(nodes)), sizes)
    member = suffixes[np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[node]]
    best = left_partners(node, member, lrank, left_rows, left)
    deep = best + depth[node] >= alphabet.width
    spans.widen(member[deep], best[deep], depth[node][deep])


def dedup_bytes(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) after cutting every byte that a repeated string covers.

    A string is ``width`` bytes of a text's UTF-8 form; it is repeated if it also starts anywhere
    else, in the same text too. ``n_spans`` counts the maximal runs that are cut. A null text has
    no bytes, repeated rows are documents of their own (and so repeat each other), null ids stay,
    other columns are ignored.
    """
    found = repeats.without_repeats(docs, repeats.Alphabet("bytes", width, k), solve, ["doc_id"])
    return found.select("row.doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.col("digest").alias("kept_sha256"))


def documents_without_repeats(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """The documents, all columns, with what ``dedup_bytes`` leaves of their texts.

    A character of which a byte is cut goes as a whole, ``n_chars`` (if there is one) follows the
    text, and a null text comes back empty.
    """
    carried = [c for c in docs.columns if c != "text"]
    found = repeats.without_repeats(docs, repeats.Alphabet("bytes", width, k), solve, carried, with_text=True)
    of = {c: F.col(f"row.`{c}`") for c in carried} | {"text": F.col("kept").cast("string")}
    if "n_chars" in carried:
        of["n_chars"] = F.char_length(of["text"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[of[c].alias(c) for c in docs.columns])
