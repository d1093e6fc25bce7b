"""Time the headline jobs; prints one JSON line.

BENCH_SF_DIR picks the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Every job starts from the given Parquet tables or from the star written by ``star_load``;
nothing is reused between jobs but that star and the observations of ``surface_12_repeats``.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import functions as F

from tarnish.operators import defects as dfx
from tarnish.operators.game import attribute_debt, mean_game, shapley_values
from tarnish.operators.permutations import convergence_trials
from tarnish.operators import feature_defects as ffx
from tarnish.plans import models, workload
from tarnish.plans.surface import direct_surface, risk_surface
from tarnish.session import local_session, stored
from tarnish.sources import features
from tarnish.sources.star import Star, line_star


def optional_jobs(spark, folder: str) -> dict:
    """Operators on training data, where that part is there."""
    if not (Path(__file__).resolve().parent / "tarnish" / "llm").is_dir():
        return {}
    from tarnish.llm.source_audit import source_divergences
    from tarnish.llm.vector_codes import vector_codes

    docs, vectors = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "embeddings"))
    return {"op11_source_audit": lambda: source_divergences(docs).collect(), "op12_vector_codes": lambda: vector_codes(vectors).collect()}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, **{"spark.sql.shuffle.partitions": cores})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, job):
        start = time.perf_counter()
        result = job()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def load() -> tuple[Star, int]:
        # orders with dense ids and customers are written by the loader
        star = line_star(spark, folder)
        return star, star.orders.count()

    star, facts = timed("star_load", load)

    def clean() -> None:
        for query in workload.star_workload():
            workload.run_query(star, query).collect()

    def surface(repeats: int, severities=(0.10,)):
        found = risk_surface(star, dfx.default_defects(), severities=severities, repeats=repeats, master_seed=2027)
        return stored(found.losses, "losses")

    timed("clean_workload_8_queries", clean)
    timed("surface_1_repeat", lambda: surface(1))
    losses = timed("surface_12_repeats", lambda: surface(12))
    timed("surface_4_severities", lambda: surface(2, (0.05, 0.10, 0.20, 0.30)))
    names = tuple(d.name for d in dfx.default_defects())
    risks = losses.groupBy("repeat", "mask").agg(F.avg("loss").alias("loss"))
    timed("attribution_2000_draws", lambda: attribute_debt(risks, names).estimates.collect())
    timed("query_attribution_1000_draws", lambda: attribute_debt(losses, names, bootstrap_samples=1000, groups=["query"]).estimates.collect())

    def sampling() -> None:
        game = stored(mean_game(risks), "game")
        exact = shapley_values(game, names)
        convergence_trials(game, exact, names, budgets=[2, 4, 8, 16, 32, 64], trials=50).collect()

    timed("convergence_300_trials", sampling)

    def damage() -> None:
        table = features.price_regression(spark, folder)
        hurt, _ = ffx.damage_features(table, ffx.default_feature_defects(), severity=0.15, master_seed=2027)
        models.fit(hurt, models.model_factory("regression", "ridge"), 1)

    timed("damage_and_fit_ridge", damage)
    texts = (
        workload.SqlQuery(
            "status_by_region",
            "SELECT c.region, o.status, COUNT(*) AS n, AVG(o.discount) AS mean_discount FROM orders o"
            " JOIN customers c ON o.customer_id = c.customer_id GROUP BY c.region, o.status",
            ("region", "status"),
            ("n", "mean_discount"),
            ("customer_id", "region", "status", "discount"),
        ),
        workload.SqlQuery(
            "top_prices",
            "SELECT p.category, MAX(o.unit_price) AS top, SUM(o.quantity) AS units FROM orders o JOIN products p USING (product_id) GROUP BY p.category",
            ("category",),
            ("top", "units"),
            ("product_id", "category", "unit_price", "quantity"),
        ),
    )
    timed("direct_surface_2_sql_queries", lambda: direct_surface(star, dfx.default_defects(), repeats=1, workload=texts).losses.collect())
    prices = features.price_regression(spark, folder)
    timed("ridge_surface_3_repeats", lambda: models.model_surface(prices, ffx.default_feature_defects(), models.model_factory("regression", "ridge"), repeats=3).observations.collect())
    for name, job in optional_jobs(spark, folder).items():
        timed(name, job)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "facts": facts,
                "cores": int(cores),
            }
        )
    )


if __name__ == "__main__":
    main()
