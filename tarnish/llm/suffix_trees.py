"""Substring dedup over words by prefix-partitioned suffix trees.

Suffixes start at anchors and are partitioned by the words they begin with; a prefix that is too
frequent is made longer until its group fits in memory (see ``repeats``). Each group's suffix
tree grows from the root down: at every depth the nodes split by the next word. A node below which
the tree forks or ends is deep enough if its words to the right, with those that two of its
suffixes share to the left, make a window; these are maximal repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm import repeats
from tarnish.llm.texts import word_hashes

WIDTH, K = 35, 10


def _rows(flat: np.ndarray, first: np.ndarray, length: np.ndarray, columns: int, step: int) -> np.ndarray:
    """flat[first], flat[first + step], ... of each row, zero beyond its length."""
    column = np.arange(columns)
    at = first[:, None] + step * column
    inside = column < length[:, None]
    return np.where(inside, flat[np.where(inside, at, 0)], flat.dtype.type(0))


def shared_lengths(rows: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many leading symbols rows a and b share, pair by pair."""
    differ = rows[a] != rows[b]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(length[a], length[b]))


def ordered(rows: np.ndarray) -> np.ndarray:
    """Places of the rows in lexicographic order; zeros, which only pad, come first."""
    big = np.ascontiguousarray(rows.astype(rows.dtype.newbyteorder(">")))
    return np.argsort(big.view(f"S{big.shape[1] * big.itemsize}").reshape(-1), kind="stable")


def left_partners(node: np.ndarray, member: np.ndarray, lrank: np.ndarray, left_rows: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of each (node, member): how many symbols to the left it shares with another member of the node.

    Members are sorted by what stands to their left; the nearest one is a neighbour.
    """
    order = np.lexsort((lrank[member], node))
    n, m = node[order], member[order]
    same = n[1:] == n[:-1]
    shared = np.where(same, shared_lengths(left_rows, m[:-1], m[1:], left), -1)
    best = np.full(len(m), -1)
    np.maximum(best[1:], shared, out=best[1:])
    np.maximum(best[:-1], shared, out=best[:-1])
    back = np.empty(len(m), dtype=np.int64)
    back[order] = best
    return back


class Spans:
    """The widest repeated stretch around each context's anchor, as symbols to its left and right."""

    def __init__(self, n: int):
        self.start = np.zeros(n, dtype=np.int64)
        self.stop = np.zeros(n, dtype=np.int64)

    def widen(self, member: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        np.maximum.at(self.start, member, left)
        np.maximum.at(self.stop, member, right)

    def found(self) -> tuple[np.ndarray, ...]:
        member = np.flatnonzero(self.stop)
        return member, self.start[member], self.stop[member]


def solve(h: np.ndarray, left: np.ndarray, contents: list[bytes], alphabet: repeats.Alphabet) -> tuple[np.ndarray, ...]:
    """(member, words to the left, words to the right) of the contexts that a repeated window crosses."""
    codes, starts, _ = word_hashes(np.frombuffer(b" ".join(contents), dtype=np.uint8))
    codes |= np.uint64(1)
    bounds = np.cumsum([0] + [len(c) + 1 for c in contents])
    first = np.searchsorted(starts, bounds)
    left = left.astype(np.int64)
    right = first[1:] - first[:-1] - left
    right_rows = _rows(codes, first[:-1] + left, right, alphabet.width, 1)
    left_rows = _rows(codes, first[:-1] + left - 1, left, max(1, alphabet.reach - 1), -1)
    lrank = np.empty(len(h), dtype=np.int64)
    lrank[ordered(left_rows)] = np.arange(len(h))
    spans = Spans(len(h))

    # the root: suffixes of one prefix; depth after depth, nodes of one suffix are left out
    member = np.arange(len(h))
    node = np.unique(h, return_inverse=True)[1]
    for depth in range(1, alphabet.width + 1):
        word = right_rows[member, depth - 1]
        ends = right[member] < depth
        key = np.lexsort((word, node))
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (node[key][1:] != node[key][:-1]) | (word[key][1:] != word[key][:-1])
        child = np.empty(len(key), dtype=np.int64)
        child[key] = np.cumsum(fresh) - 1
        child[ends] = len(key) + np.arange(ends.sum())
        sizes = np.bincount(child, minlength=1)[child]
        # a node whose suffixes all go on together is judged further down
        forks = sizes != np.bincount(node, minlength=1)[node]
        if depth > 1:
            _judge(spans, node, member, depth - 1, forks, lrank, left_rows, left, alphabet)
        stay = (sizes > 1) & ~ends
        member, node = member[stay], np.unique(child[stay], return_inverse=True)[1]
        if not len(member):
            break
    else:
        _judge(spans, node, member, alphabet.width, np.ones(len(member), dtype=bool), lrank, left_rows, left, alphabet)
    return spans.found()


def _judge(spans: Spans, node: np.ndarray, member: np.ndarray, depth: int, forks: np.ndarray, lrank, left_rows, left, alphabet) -> None:
    """Widen the spans of nodes at their full depth by what their suffixes share to the left."""
    if depth < alphabet.k or not forks.any():
        return
    n, m = node[forks], member[forks]
    best = left_partners(n, m, lrank, left_rows, left)
    deep = best + depth >= alphabet.width
    spans.widen(m[deep], best[deep], np.full(deep.sum(), depth))


def dedup_words(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256) after cutting every word that a repeated window covers.

    A window is ``width`` consecutive words of a text; it is repeated if its words also start
    anywhere else, in the same text too. Words stand between space characters; what is left is
    joined by single spaces. A null text has no words, repeated rows are documents of their own
    (and so repeat each other), null ids stay, other columns are ignored.
    """
    found = repeats.without_repeats(docs, repeats.Alphabet("words", width, k), solve, ["doc_id"])
    return found.select("row.doc_id", F.col("n").alias("n_words"), "n_removed", "n_spans", F.col("digest").alias("kept_sha256"))
