"""Per-row dice: repeatable pseudo-random numbers as plain integer Column arithmetic.

A roll depends only on the row's integer id and on two seed words, so it does
not matter which task evaluates it, how often, or next to which other columns.
Ids may use 62 bits. All products stay below 2**63, so ANSI overflow checks
never fire, and any SQL engine with 64-bit integers gives the same rolls.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnish.session import compiled

MASK = (1 << 31) - 1
MULTIPLIERS = (1103515245, 1566083941, 1812433253, 1597334677)
SPAN = float(1 << 31)


def seed_words(*parts) -> tuple[int, int]:
    """Two 31-bit words that depend on every part of the label."""
    digest = sha256("/".join(str(p) for p in parts).encode()).digest()
    return int.from_bytes(digest[:4], "big") & MASK, int.from_bytes(digest[4:8], "big") & MASK


def _spread(key: str, one) -> str:
    return f"(((({key}) & {MASK}L) ^ {one}) * {MULTIPLIERS[0]}L + shiftright({key}, 31) * {MULTIPLIERS[1]}L)"


def _stir(a: str, two) -> str:
    return f"((((({a}) ^ shiftright({a}, 29)) & {MASK}L) ^ {two}) * {MULTIPLIERS[2]}L)"


def _settle(c: str) -> str:
    return f"(shiftright(((({c}) ^ shiftright({c}, 31)) & {MASK}L) * {MULTIPLIERS[3]}L, 22) & {MASK}L)"


def roll(key: str, seeds) -> Column:
    """Uniform integer in [0, 2**31) for a bigint expression and two seed words (numbers or expressions)."""
    return F.expr(_settle(_stir(_spread(key, seeds[0]), seeds[1])))


def add_rolls(df: DataFrame, rolls: Mapping[str, tuple]) -> DataFrame:
    """Many rolls (name -> (key, seeds)) as columns.

    Every step reads the one before it twice; separate projections keep each
    step evaluated once and the generated code small. With many rolls, or long tests of them, a fused
    loop is too large for the JVM to compile, so such steps are not fused.
    """
    if not rolls:
        return df
    compiled(df.sparkSession)
    kept = [c for c in df.columns if c not in rolls]
    first = df.selectExpr(*kept, *[f"{_spread(key, seeds[0])} AS `{name}`" for name, (key, seeds) in rolls.items()])
    second = first.selectExpr(*kept, *[f"{_stir(name, seeds[1])} AS `{name}`" for name, (_, seeds) in rolls.items()])
    return second.selectExpr(*kept, *[f"{_settle(name)} AS `{name}`" for name in rolls])


def unit(rolled: Column) -> Column:
    """Roll to a double strictly inside (0, 1)."""
    return (rolled + F.lit(0.5)) / F.lit(SPAN)


def normal(first: Column, second: Column) -> Column:
    """Standard normal value of two rolls (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.ln(unit(first))) * F.cos(F.lit(2.0 * math.pi) * unit(second))


def pick(high: Column, low: Column, size) -> Column:
    """Uniform integer in [0, size) from 53 bits of two rolls."""
    size = size if isinstance(size, Column) else F.lit(int(size)).cast("long")
    share = (high * F.lit(1 << 22) + F.shiftright(low, 9)) / F.lit(float(1 << 53))
    return F.least(F.floor(share * size).cast("long"), size - F.lit(1))


def categorical(share: Column, options: list[tuple[object, float]]) -> Column:
    """Weighted draw: the first option whose running weight exceeds ``share``."""
    total, running, chosen = sum(w for _, w in options), 0.0, None
    for value, weight in options[:-1]:
        running += weight / total
        test = share < F.lit(running)
        chosen = F.when(test, F.lit(value)) if chosen is None else chosen.when(test, F.lit(value))
    return F.lit(options[-1][0]) if chosen is None else chosen.otherwise(F.lit(options[-1][0]))


def clipped_geometric(share: Column, p: float, top: int) -> Column:
    """Number of trials up to the first success, at most ``top``."""
    return F.least(F.ceil(F.ln(share) / F.lit(math.log(1.0 - p))), F.lit(top)).cast("long")
