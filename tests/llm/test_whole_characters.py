"""The passage stage cuts whole characters and leaves every other one as it stood."""

import numpy as np

from tarnish.llm import suffix_array
from test_tables import as_key, covered


def noise(seed, n=60):
    return " ".join(f"x{v}" for v in np.random.default_rng(seed).integers(0, 10**8, n))


def brute_text(texts, width=200):
    out = []
    for text, marks in zip(texts, covered([t.encode() for t in texts], width)):
        at, left = 0, []
        for c in text:
            size = len(c.encode())
            if not any(marks[at : at + size]):
                left.append(c)
            at += size
        out.append("".join(left))
    return out


def left_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in sorted(suffix_array.documents_without_repeats(docs).collect())]


def test_replacement_characters_away_from_a_cut_stay(spark):
    # the repeat begins within the first letter: D0 9F and D1 9F end alike
    texts = [f"� {noise(1)} П{'ab' * 120}", f"{noise(2)} � џ{'ab' * 120}"]
    got = left_of(spark, texts)
    assert got == brute_text(texts) and all("�" in t for t in got)


def test_bytes_beside_a_cut_form_no_letter(spark):
    middle = noise(3, 40)
    # U+041F is D0 9F, U+0435 is D0 B5: cut from 9F up to D0, they would leave D0 B5 joined
    texts = [f"{noise(4)} П{middle}е {noise(5)}", f"{noise(6)} џ{middle}а {noise(7)}"]
    got = left_of(spark, texts)
    assert got == brute_text(texts)
    assert "е" not in got[0]


def test_characters_of_every_width(spark):
    pool = ["a", "é", "е", "€", "�", "\U0001f600", " "]
    rng = np.random.default_rng(9)
    shared = "".join(rng.choice(pool, 150))
    texts = ["".join(rng.choice(pool, 80)) + x + shared + y + "".join(rng.choice(pool, 80)) for x, y in (("П", "е"), ("џ", "а"), ("€", "€"), ("¬", "\U0001f600"))]
    assert as_key(left_of(spark, texts)) == as_key(brute_text(texts))
