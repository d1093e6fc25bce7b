"""A quality classifier of naive Bayes support vectors.

Features are indicators of hashed word n-grams and of word shapes. Each is scaled by the log ratio
of its frequencies in the two classes, and a linear model with hinge loss is fitted by dual
coordinate descent. The model is fitted on at most ``max_rows`` labelled documents, those with the
smallest hashes of their id; it is a weight per bucket, so its size does not depend on the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.texts import BASE, mixed, per_text, span_hashes, unused, word_hashes


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled documents of the fit, ``bits`` the buckets."""

    max_rows: int = 12_000
    bits: int = 18
    smoothing: float = 1.0
    penalty: float = 1.0
    passes: int = 12
    seed: int = 5


#: What a byte counts as in a word's shape: letters of both cases, digits, bytes beyond ASCII; other characters are themselves.
SHAPES = np.arange(256, dtype=np.uint64) + np.uint64(1)
SHAPES[97:123] = 1001
SHAPES[65:91] = 1002
SHAPES[48:58] = 1003
SHAPES[128:] = 1001
SHAPES = mixed(SHAPES) | np.uint64(1)

ECHOES = 4


def features(text: str, bits: int) -> np.ndarray:
    """The distinct buckets of a text's words, word pairs, word shapes and echoes; an empty text has bucket 0 alone.

    An echo is a word that stands again after one to three others or none; how common echoes of a
    distance are, to the nearest power of two, is an indicator as well.
    """
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words, starts, ends = word_hashes(data)
    if not len(words):
        return np.zeros(1, dtype=np.int64)
    codes = SHAPES[data]
    repeated = np.zeros(len(codes), dtype=bool)
    repeated[1:] = codes[1:] == codes[:-1]
    # runs of one class count once: their later members are left out
    kept = np.flatnonzero(~repeated)
    place = np.concatenate([[0], np.cumsum(~repeated)])
    # a word's first byte follows a space, so it is never left out
    shapes = span_hashes(codes[kept], place[starts], place[ends])
    pairs = mixed(words[:-1] * np.uint64(3) + words[1:])
    shift = np.uint64(64 - bits)
    echoes = [1000 * d + int(np.log2(max(1e-3, (words[d:] == words[:-d]).mean()))) for d in range(1, ECHOES + 1) if len(words) > d]
    found = np.concatenate([words, pairs, mixed(shapes + np.uint64(77)), mixed(np.array(echoes, dtype=np.uint64) * np.uint64(BASE))]) >> shift
    seen = np.unique(found.astype(np.int64))
    return seen


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias of the scaled hinge-loss model, by dual coordinate descent."""
    size = 1 << settings.bits
    positive, negative = np.full(size, settings.smoothing), np.full(size, settings.smoothing)
    for r, y in zip(rows, labels):
        (positive if y > 0 else negative)[r] += 1  # a row's buckets are distinct
    ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    values = [ratio[r] / np.sqrt(len(r)) for r in rows]
    # the rarer class weighs as much as the other one
    share = np.clip(np.mean(labels > 0), 1e-3, 1 - 1e-3)
    caps = np.where(labels > 0, settings.penalty / (2 * share), settings.penalty / (2 * (1 - share)))
    norms = np.array([v @ v + 1.0 for v in values])
    dual = np.zeros(len(rows))
    weights, bias = np.zeros(size), 0.0
    rng = np.random.default_rng(settings.seed)
    for _ in range(settings.passes):
        for i in rng.permutation(len(rows)):
            r, v, y = rows[i], values[i], labels[i]
            gradient = y * (weights[r] @ v + bias) - 1
            step = min(max(dual[i] - gradient / norms[i], 0.0), caps[i]) - dual[i]
            if step:
                dual[i] += step
                weights[r] += step * y * v
                bias += step * y
    return weights * ratio, bias


def margins(rows: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[r].sum() / np.sqrt(len(r)) + bias for r in rows])


def slope_and_shift(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The logistic curve that turns margins into probabilities, by Newton steps."""
    a, b = 1.0, 0.0
    target = (labels > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - target) * margin).sum() + 1e-2 * (a - 1), (p - target).sum() + 1e-2 * b])
        h = np.array([[(w * margin * margin).sum() + 1e-2, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


@dataclass(frozen=True)
class Model:
    """What scores a document: weight per bucket, bias and the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int

    def scores(self, texts: list[str]) -> np.ndarray:
        margin = margins([features(t, self.bits) for t in texts], self.weights, self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def fitted(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """The curve comes from margins of rows that the model behind them has not seen."""
    if len(rows) == 0 or (labels > 0).all() or (labels <= 0).all():
        share = 0.5 if len(rows) == 0 else float((labels > 0).mean())
        return Model(np.zeros(1 << settings.bits), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))), settings.bits)
    half = np.arange(len(rows)) % 2 == 0
    unseen = np.zeros(len(rows))
    for part in (half, ~half):
        seen = np.flatnonzero(~part)
        model = fit_rows([rows[i] for i in seen], labels[seen], settings)
        unseen[part] = margins([rows[i] for i in np.flatnonzero(part)], *model)
    slope, shift = slope_and_shift(unseen, labels)
    weights, bias = fit_rows(rows, labels, settings)
    return Model(weights, bias, slope, shift, settings.bits)


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that no label is learned from; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most ``max_rows`` labelled ids that are not held out.

    An id with several labels has that of the majority, 1 on a tie; null ids and labels are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
    voted = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the labelled documents; a labelled id without document is skipped, repeated documents count once each."""
    chosen = training_labels(labels, settings.max_rows)
    # the bound on rows bounds the broadcast; a document that repeats an id comes in once
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = per_text(rows, lambda texts: {"buckets": [features(t, settings.bits) for t in texts]}, "buckets array<int>").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("buckets").alias("buckets"))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        # four bytes a bucket, as they came in: the documents of the fit are held once
        model = fitted([np.asarray(b, dtype=np.int32) for b in part["buckets"]], np.where(part["label"].to_numpy() > 0, 1, -1), settings)
        return pd.DataFrame({"weights": [model.weights.astype("<f4").tobytes()], "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    one = found.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "weights binary, bias double, slope double, shift double").collect()
    if not one:
        return fitted([], np.zeros(0), settings)
    row = one[0]
    return Model(np.frombuffer(row["weights"], dtype="<f4").astype(float), row["bias"], row["slope"], row["shift"], settings.bits)


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document.

    A null text is scored as an empty one; repeated rows and null ids stay; only the text enters
    the score. Without labels of both classes every document gets the share of label 1 among
    those there are, 0.5 if there are none.
    """
    model = train(docs, labels, settings)
    scored = per_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), lambda texts: {"score": model.scores(texts)}, "score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents, all columns, that score 0.5 or more; texts are scored as in ``score_documents``."""
    model = train(docs, labels, settings)
    copy, score = unused(docs, "scored_text"), unused(docs, "score")
    scored = per_text(docs.withColumn(copy, F.coalesce("text", F.lit(""))), lambda texts: {score: model.scores(texts)}, f"{score} double", text=copy)
    return scored.where(F.col(score) >= 0.5).select(*docs.columns)
