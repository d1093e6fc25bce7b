"""Licence scans: an Aho-Corasick automaton finds notices and identifier tags, a shunting-yard parser reads their expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.llm.texts import per_text

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notices, their labels and how surely each states a licence.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mozilla public license version 2 0": ("mpl-2", 0.9),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc by 4 0": ("cc-by", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "dedicated to the public domain": ("public-domain", 0.8),
    "all rights reserved": ("reserved", 0.4),
}
TAG = "spdx license identifier"
BASE_SURETY, TAG_SURETY = 0.9, 1.0
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: How tightly an operator binds.
BINDS = {"or": 1, "and": 2, "with": 3}


def _fold_table() -> bytes:
    """A-Z to a-z, digits and bytes of other scripts as they are, all else to a space."""
    folded = bytearray(b" " * 256)
    for code in range(256):
        if 48 <= code <= 57 or 97 <= code <= 122 or code >= 128:
            folded[code] = code
        elif 65 <= code <= 90:
            folded[code] = code + 32
    return bytes(folded)


FOLD = _fold_table()


def licence_words(text: str) -> list[bytes]:
    """Lower-cased words of letters, digits and any character beyond ASCII."""
    return text.encode().translate(FOLD).split()


def postfix(expression: str) -> list[str] | None:
    """The expression's identifiers and operators in postfix order (shunting-yard); None if it is malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True
    for token in TOKEN.findall(expression):
        word = token.lower()
        if word in BINDS or word == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(" and (word == ")" or BINDS[waiting[-1]] >= BINDS[word]):
                out.append(waiting.pop())
            if word != ")":
                waiting.append(word)
                operand = True
            elif not waiting:
                return None
            else:
                waiting.pop()
        elif not operand:
            return None
        elif word == "(":
            waiting.append(word)
        else:
            out.append(word)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


@dataclass
class Reading:
    """Which licences an expression names, and the fewest that must be kept together to satisfy it."""

    labels: set[str] = field(default_factory=set)
    least: int = 1


def evaluate(expression: str) -> Reading | None:
    """``or`` leaves a choice, ``and`` adds obligations, ``with`` ties an exception to its licence."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[Reading] = []
    for token in order:
        if token not in BINDS:
            stack.append(Reading({token}))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if len(left.labels) != 1 or len(right.labels) != 1:
                return None
            (base,), (exception,) = left.labels, right.labels
            stack.append(Reading({f"{base} with {exception}"}))
        elif token == "and":
            stack.append(Reading(left.labels | right.labels, left.least + right.least))
        else:
            stack.append(Reading(left.labels | right.labels, min(left.least, right.least)))
    return stack[0]


def phrase_automaton() -> ahocorasick.Automaton:
    """Phrases are stored between spaces, so they match whole words only."""
    found = ahocorasick.Automaton()
    surety = {p: (p, label, BASE_SURETY, True) for p, label in BASE_PHRASES.items()}
    surety |= {p: (p, label, weight, False) for p, (label, weight) in NOTICES.items()}
    surety[TAG] = (TAG, "", TAG_SURETY, False)
    for phrase, entry in surety.items():
        found.add_word(f" {phrase} ", entry)
    found.make_automaton()
    return found


def scan_text(text: str, automaton: ahocorasick.Automaton) -> dict:
    """Counts, places and labels of one text; see ``scan_licences``."""
    words = licence_words(text)
    joined = f" {b' '.join(words).decode()} "
    n_base, first, last, score, tagged = 0, None, None, 0.0, False
    base: set[str] = set()
    labels: set[str] = set()
    passed, at = 0, 0
    for end, (phrase, label, weight, counted) in automaton.iter(joined):
        if phrase == TAG:
            tagged = True
            continue
        labels.add(label)
        score = max(score, weight)
        if counted:
            start = end - len(phrase) - 1
            # ends come in order; starts may step back by less than a phrase
            passed = passed + joined.count(" ", at, start) if start >= at else passed - joined.count(" ", start, at)
            at = start
            base.add(label)
            n_base += 1
            first = passed if first is None else min(first, passed)
            last = passed if last is None else max(last, passed)
    expressions = []
    if tagged:
        for line in TAG_LINE.findall(text):
            reading = evaluate(line)
            if reading:
                labels |= reading.labels
                score = TAG_SURETY
                expressions.append(reading.least)
    return {
        "n_words": len(words),
        "n_base": n_base,
        "first_word": first,
        "last_word": last,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(labels)),
        "score": score,
        "n_expressions": len(expressions),
        "most_obligations": max(expressions, default=None),
    }


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long, most_obligations long"


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the base phrases, labels and how surely a licence is stated.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase in words
    (null if there is none). ``labels`` also has those of other notices and of well-formed
    expressions behind ``SPDX-License-Identifier:``; ``n_expressions`` counts these, and
    ``most_obligations`` is the largest number of licences that one of them makes hold together.
    Malformed expressions are ignored. ``score`` is the surest notice's weight, 0 without any. A
    null text is an empty one, repeated rows and null ids stay, other columns are ignored.
    """

    automaton = phrase_automaton()
    names = [part.split()[0] for part in SCANNED.split(", ")]

    def scan(texts: list[str]) -> dict:
        found = [scan_text(t, automaton) for t in texts]
        return {name: [row[name] for row in found] for name in names}

    return per_text(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), scan, SCANNED)
