"""Audit a numeric CSV file: spark-submit audit_job.py data.csv --target y --task classification --model logistic."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import SparkSession

from tarnish.operators.loss import TASKS
from tarnish.plans.models import model_factories
from tarnish.plans.studies import audit, audit_csv

#: Settings of the audit that have another name on the command line.
SHORT = {"bootstrap_samples": "bootstrap"}


def options() -> argparse.ArgumentParser:
    """The file, what to predict and how; every number that ``audit`` has a default for is an option with that default."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("csv")
    parser.add_argument("--output", default="audit-report")
    needed = {"target": None, "task": sorted(TASKS), "model": sorted({m for task in TASKS for m in model_factories(task)})}
    for name, choices in needed.items():
        parser.add_argument(f"--{name}", required=True, choices=choices)
    for name, setting in inspect.signature(audit).parameters.items():
        if isinstance(setting.default, (int, float)):
            parser.add_argument("--" + SHORT.get(name, name).replace("_", "-"), dest=name, type=type(setting.default), default=setting.default)
    return parser


def main() -> None:
    chosen = vars(options().parse_args())
    where = {name: chosen.pop(name) for name in ("csv", "target", "task", "output")}
    audit_csv(SparkSession.builder.appName("audit").getOrCreate(), **where, **chosen)


if __name__ == "__main__":
    main()
