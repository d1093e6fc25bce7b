"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule rejects on one condition. What a rule costs and how much it rejects is measured on a
bounded sample; rules are then asked in the order of rejections per cost, in one CASE whose later
branches run only for documents that the earlier ones let pass. The order decides the speed, never
the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.llm.texts import SPACES
from tarnish.session import stored

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A name and the condition that rejects, over ``text``, ``words`` and the counts."""

    name: str
    rejects: Column


def word_array(text: Column) -> Column:
    """Words between space characters, unchanged."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeat_words(hashes: str, windows: str) -> Column:
    """How many words lie in windows that a text holds twice or more.

    Few texts repeat a window at all, which a hash set tells. For the others the windows' hashes
    are sorted with their places in the low bits, so that equal ones are neighbours (up to
    collisions of what is left of 64 bits).
    """
    n = F.size(windows)
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1
    place = lambda packed: (packed.bitwiseAND(low) + 1).cast("int")
    packed = F.sort_array(F.transform(F.col(windows), lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
    code = lambda p: F.get(F.col(windows), place(p) - 1)
    twins = lambda a, b: code(a) == code(b)

    def repeated(p: Column) -> Column:
        found = F.filter(
            F.sequence(F.lit(1), F.size(p)),
            lambda j: (F.when(j > 1, twins(F.get(p, j - 1), F.get(p, j - 2))).otherwise(False))
            | (F.when(j < F.size(p), twins(F.get(p, j - 1), F.get(p, j))).otherwise(False)),
        )
        return F.sort_array(F.transform(found, lambda j: place(F.get(p, j - 1))))

    # binding a value to a name inside an expression: a one-element array
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    covered = lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(
        F.aggregate(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0), lambda x, y: x + y)
    )
    heavy = bound(packed, lambda p: bound(repeated(p), covered))
    return F.when(F.size(F.array_distinct(F.col(windows))) == n, F.lit(0)).otherwise(heavy).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """``text``, ``words`` and the base counts of each document; a null text has no words."""
    i = lambda h, at, k: F.get(h, at + F.lit(k))
    staged = (
        docs.withColumn("words", word_array(F.coalesce("text", F.lit(""))))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn(
            "windows",
            F.when(F.size("hashes") < WINDOW, F.array().cast("array<bigint>")).otherwise(
                F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda at: F.xxhash64(*[i(F.col("hashes"), at, k) for k in range(WINDOW)]))
            ),
        )
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    )
    return staged.select(
        *docs.columns,
        "words",
        "n_words",
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeat_words("hashes", "windows").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules beyond the base; each speaks of whole texts and leaves ordinary prose alone."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda kept: F.size(kept) / words
    return [
        Rule("symbols", F.col("n_symbols") > 0.25 * words),
        # one repeated line says nothing of a text of three
        Rule("line_repeats", (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * F.size(F.split("text", "\n")))),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("shouting", share(F.filter("words", lambda w: w.rlike(r"^\p{Lu}{2,}\P{L}*$"))) > 0.4),
        Rule("no_letters", share(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))) > 0.4),
        Rule("exclamations", share(F.filter("words", lambda w: w.endswith("!!"))) > 0.2),
    ]


def measured(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """Each rule's seconds and share of rejections on the sample, dearest last by rejections per second."""

    def seconds(condition: Column) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            share = sample.agg(F.avg(F.coalesce(condition.cast("double"), F.lit(0.0)))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    floor, _ = seconds(F.lit(False))
    found = [(rule, *seconds(rule.rejects)) for rule in rules]
    found = [(rule, max(cost - floor, 1e-4), share) for rule, cost, share in found]
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule]) -> Column:
    """True for documents that pass every rule; a rule runs only if those before it let the document pass."""
    verdict = None
    for rule in rules:
        rejects = F.coalesce(rule.rejects, F.lit(False))
        verdict = F.when(rejects, False) if verdict is None else verdict.when(rejects, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def judge_documents(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 300, sample_bytes: int = 1 << 14) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each document.

    The rules are ordered on the first ``sample_rows`` texts of at most ``sample_bytes`` that come
    to hand; no verdict depends on them. Repeated rows and null ids stay; a null or empty text has
    no words and fails the base; other columns are ignored.
    """
    rules = default_rules() if rules is None else rules
    slim = docs.select("doc_id", "text")
    counted = with_counts(slim)
    # taking rows reads as few partitions as give them, where a written limit would read all
    taken = slim.where(F.octet_length("text") <= sample_bytes).take(sample_rows)
    sample = stored(with_counts(docs.sparkSession.createDataFrame(taken, slim.schema)), "rule-sample")
    order = [rule for rule, _, _ in measured(sample, rules)]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = counted.withColumn("base_failed", base_failed())
    return failed.select("doc_id", *counts, "base_failed", F.when(F.col("base_failed"), False).otherwise(cascade(order)).alias("kept"))
