"""Every query with SQL must agree with DuckDB on the given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import connect, difference

from registry import oracles, settings
from registry.queries import rounded
from tarnish.sources import generator

# the operators on training data have tests of their own
SQL = {name: sql for name, sql in oracle_sql().items() if name in oracles.all_sql()}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, data, duck, name):
    got = queries()[name](spark, data).toPandas()
    want = duck.execute(SQL[name]).fetchdf()
    assert len(got) > 0
    assert difference(got, want) == ""


def test_every_oracle_has_a_query():
    assert not set(SQL) - set(queries())


def test_entry_is_the_risk_surface(spark):
    assert entry(spark).columns == ["severity", "repeat", "query", "mask", "loss"]


@pytest.mark.parametrize("name", sorted(oracles.generator_sql()))
def test_generated_tables_agree_with_sql(spark, data, duck, name):
    size = max(generator.MIN_ORDERS, spark.read.parquet(f"{data}/lineitem.parquet").count())
    regime = name.removeprefix("gen_orders_")
    star = generator.generate_star(spark, size, regime=regime if regime in generator.REGIMES else generator.REGIMES[0], seed=settings.GENERATOR_SEED)
    made = {"gen_customers": star.customers, "gen_products": star.products}.get(name, star.orders)
    if "order_date" in made.columns:
        made = made.selectExpr("* EXCEPT (order_date)", "date_format(order_date, 'yyyy-MM-dd') AS order_date")
    assert difference(rounded(made).toPandas(), duck.execute(oracles.generator_sql()[name]).fetchdf()) == ""
