"""Defects on feature tables: a unique ``row_id``, double features and a ``label``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.functions import dice
from tarnish.operators.loss import GUARD, TASKS
from tarnish.operators.sampling import Draws, Stream, affected, below, dense_ids, find_all_cuts, find_cuts, multiplicity


@dataclass(frozen=True)
class Features:
    rows: DataFrame
    columns: tuple[str, ...]
    task: str
    label: str = "label"
    key: str = "row_id"

    def __post_init__(self) -> None:
        if self.task not in TASKS:
            raise ValueError(f"task must be one of {TASKS}")
        missing = sorted({self.key, self.label, *self.columns} - set(self.rows.columns))
        if missing:
            raise ValueError(f"feature table lacks columns {missing}")

    def with_rows(self, rows: DataFrame) -> Features:
        return replace(self, rows=rows)

    def cell(self, column: str) -> str:
        """SQL value: a unique integer per cell."""
        return f"({self.key} * {len(self.columns)}L + {self.columns.index(column)}L)"

    def cells(self) -> DataFrame:
        width = len(self.columns)
        # an array of its elements is compiled; a lambda over a sequence is not
        listed = ", ".join(f"{self.key} * {width}L + {j}L" for j in range(width))
        return self.rows.selectExpr(f"explode(array({listed})) AS cell")


class Dice:
    """Seeds and hits of one (master seed, repeat) on one clean table.

    Hits are found on the clean ids, so they do not depend on which other
    defects are active; they are kept, so that all combinations share the passes.
    """

    def __init__(self, clean: Features, severity: float, master_seed: int, repeat: int, n_rows: int | None = None):
        if not 0 <= severity <= 1:
            raise ValueError("severity must be in [0, 1]")
        self.clean, self.severity, self.master_seed, self.repeat = clean, severity, master_seed, repeat
        self.n_rows = clean.rows.count() if n_rows is None else n_rows
        self.n_cells = self.n_rows * len(clean.columns)
        self._cuts: dict = {}
        self._lock = Lock()

    def seeds(self, name: str, stream: str = "hit") -> tuple[int, int]:
        return dice.seed_words("features", self.master_seed, self.repeat, name, stream)

    def draws(self, name: str) -> Draws:
        return Draws(("features", self.master_seed, self.repeat, name), affected(self.severity, self.n_rows))

    def _once(self, name: str, find):
        with self._lock:
            if name not in self._cuts:
                self._cuts[name] = find()
            return self._cuts[name]

    def cut(self, name: str, cells: bool):
        size = self.n_cells if cells else self.n_rows
        stream = Stream(self.seeds(name), affected(self.severity, size))

        def find():
            ids, key = (self.clean.cells(), "cell") if cells else (self.clean.rows, self.clean.key)
            return find_cuts(ids.select(key), key, [stream], size)[0]

        return self._once(name, find)

    def copies(self, name: str):
        ids = self.clean.rows.select(self.clean.key)
        return self._once(
            name, lambda: find_all_cuts(ids, self.clean.key, [], [self.draws(name)], self.n_rows)[1][0]
        )

    @staticmethod
    def find_together(dice_: Sequence[Dice], cells: Sequence[str], rows: Sequence[str], copies: Sequence[str]) -> None:
        """Finds the cuts of the same rows' dice, of several severities, in the same passes: by names of choices of cells, of rows and of copies."""
        clean, n_rows, n_cells = dice_[0].clean, dice_[0].n_rows, dice_[0].n_cells
        of_cells = [(d, name) for d in dice_ for name in cells]
        of_rows = [(d, name) for d in dice_ for name in rows]
        drawn = [(d, name) for d in dice_ for name in copies]
        found = find_cuts(clean.cells(), "cell", [Stream(d.seeds(name), affected(d.severity, n_cells)) for d, name in of_cells], n_cells)
        streams = [Stream(d.seeds(name), affected(d.severity, n_rows)) for d, name in of_rows]
        more = find_all_cuts(clean.rows.select(clean.key), clean.key, streams, [d.draws(name) for d, name in drawn], n_rows)
        for some, cuts in ((of_cells, found), (of_rows, more[0]), (drawn, more[1])):
            for (d, name), cut in zip(some, cuts, strict=True):
                d._cuts[name] = cut

    def hit_cells(self, table: Features, name: str) -> DataFrame:
        """Adds a boolean ``_hit_<column>`` per feature."""
        cut = self.cut(name, cells=True)
        rolls = {f"_hit_{c}": (table.cell(c), self.seeds(name)) for c in table.columns}
        rolled = dice.add_rolls(table.rows, rolls)
        tests = {f"_hit_{c}": F.expr(below(f"`_hit_{c}`", table.cell(c), cut)) for c in table.columns}
        return rolled.withColumns(tests)

    def hit_rows(self, table: Features, name: str) -> DataFrame:
        cut = self.cut(name, cells=False)
        rolled = dice.add_rolls(table.rows, {"_hit": (table.key, self.seeds(name))})
        return rolled.withColumn("_hit", F.expr(below("_hit", table.key, cut)))


def _scale(value: float | None) -> float:
    return value if value is not None and value > GUARD else 1.0


@dataclass(frozen=True)
class MissingCells:
    """Exactly ``severity`` of all feature cells become null."""

    name: str = "missing_cells"
    priority: int = 10

    def apply(self, table: Features, dice_: Dice) -> tuple[Features, dict]:
        hit = dice_.hit_cells(table, self.name)
        keep = [
            F.when(~F.col(f"_hit_{c}"), F.col(c)).alias(c) if c in table.columns else F.col(c) for c in table.rows.columns
        ]
        n = affected(dice_.severity, dice_.n_cells)
        return table.with_rows(hit.select(*keep)), {"affected_cells": n, "realized_rate": n / max(1, dice_.n_cells)}


@dataclass(frozen=True)
class FeatureNoise:
    """Exactly ``severity`` of all cells get normal noise of ``magnitude`` column deviations.

    The deviations are those of the table as it comes in, missing cells left out.
    """

    magnitude: float = 3.0
    name: str = "feature_noise"
    priority: int = 20

    def apply(self, table: Features, dice_: Dice) -> tuple[Features, dict]:
        spread = table.rows.agg(*[F.stddev_pop(c).alias(c) for c in table.columns]).first()
        hit = dice_.hit_cells(table, self.name)
        words = {}
        for c in table.columns:
            for stream in ("radius", "angle"):
                words[f"_{stream}_{c}"] = (table.cell(c), dice_.seeds(self.name, stream))
        hit = dice.add_rolls(hit, words)

        def noisy(c: str):
            step = F.lit(self.magnitude * _scale(spread[c])) * dice.normal(F.col(f"_radius_{c}"), F.col(f"_angle_{c}"))
            return F.when(F.col(f"_hit_{c}"), F.col(c) + step).otherwise(F.col(c)).alias(c)

        out = hit.select(*[noisy(c) if c in table.columns else F.col(c) for c in table.rows.columns])
        n = affected(dice_.severity, dice_.n_cells)
        info = {"affected_cells": n, "realized_rate": n / max(1, dice_.n_cells), "magnitude_sd": self.magnitude}
        return table.with_rows(out), info


@dataclass(frozen=True)
class TargetNoise:
    """Exactly ``severity`` of the rows get another class, or normal noise of ``magnitude`` label deviations."""

    magnitude: float = 2.0
    name: str = "target_noise"
    priority: int = 30

    def apply(self, table: Features, dice_: Dice) -> tuple[Features, dict]:
        hit = dice_.hit_rows(table, self.name)
        y = F.col(table.label)
        if table.task == "classification":
            # every class by its place among the sorted ones; the catalogue of classes is a table, whatever its size
            named = table.rows.select(y.alias("_class")).where("_class IS NOT NULL").distinct()
            classes = dense_ids(named, ["_class"], "_at")
            others = classes.count() - 1
            if others < 1:
                raise ValueError("flipping labels needs two classes or more")
            hit = dice.add_rolls(hit, {"_pick": (table.key, dice_.seeds(self.name, "class"))})
            hit = hit.join(classes.withColumnRenamed("_class", table.label), table.label, "left")
            pick = F.expr(f"shiftright(_pick * {others}L, 31)")
            hit = hit.withColumn("_to", F.when(F.col("_hit"), pick + (pick >= F.col("_at")).cast("long")))
            hit = hit.join(classes.select(F.col("_at").alias("_to"), F.col("_class").alias("_new")), "_to", "left")
            new, magnitude = F.col("_new"), "class_flip"
        else:
            spread = table.rows.agg(F.stddev_pop(y)).first()[0]
            words = {f"_{s}": (table.key, dice_.seeds(self.name, s)) for s in ("radius", "angle")}
            hit = dice.add_rolls(hit, words)
            step = F.lit(self.magnitude * _scale(spread)) * dice.normal(F.col("_radius"), F.col("_angle"))
            new, magnitude = y.cast("double") + step, self.magnitude
        out = hit.select(
            *[F.when(F.col("_hit"), new).otherwise(y).alias(c) if c == table.label else F.col(c) for c in table.rows.columns]
        )
        n = affected(dice_.severity, dice_.n_rows)
        return table.with_rows(out), {
            "affected_rows": n,
            "realized_rate": n / max(1, dice_.n_rows),
            "magnitude_sd": magnitude,
        }


@dataclass(frozen=True)
class DuplicateRows:
    """Copies of rows drawn with replacement, features and label together; ids repeat."""

    name: str = "duplicate_rows"
    priority: int = 100

    def apply(self, table: Features, dice_: Dice) -> tuple[Features, dict]:
        cuts = dice_.copies(self.name)
        rolled = dice.add_rolls(table.rows, {"_times": (table.key, dice_.draws(self.name).row_seeds)})
        counted = rolled.withColumn("_times", F.expr(multiplicity("_times", table.key, cuts)))
        out = counted.withColumn("_copy", F.explode(F.expr("sequence(0L, _times)"))).drop("_copy", "_times")
        n = affected(dice_.severity, dice_.n_rows)
        return table.with_rows(out), {"added_rows": n, "realized_rate": n / max(1, dice_.n_rows)}


def default_feature_defects() -> tuple:
    return (MissingCells(), FeatureNoise(), TargetNoise(), DuplicateRows())


def corrupt_features(table: Features, defects: Sequence, dice_: Dice) -> tuple[Features, dict[str, dict]]:
    """Apply defects in order of priority and name. Any object with name, priority and apply will do."""
    names = [d.name for d in defects]
    if len(names) != len(set(names)):
        raise ValueError("defect names must be unique")
    done = {}
    for defect in sorted(defects, key=lambda d: (d.priority, d.name)):
        table, done[defect.name] = defect.apply(table, dice_)
    return table, done


def damage_features(
    table: Features, defects: Sequence, *, severity: float, master_seed: int, repeat: int = 0
) -> tuple[Features, dict[str, dict]]:
    return corrupt_features(table, defects, Dice(table, severity, master_seed, repeat))
