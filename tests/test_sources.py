import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarnish.operators import defects as dfx
from tarnish.plans import studies
from tarnish.session import shared_folder, stored
from tarnish.sources import sinks, star


def test_trips_become_a_star(spark, tmp_path):
    rows = spark.range(1100).selectExpr(
        "id % 2 + 1 AS PULocationID",
        "if(id % 2 = 0, 1L, 4L) AS payment_type",
        "timestamp_ntz'2025-01-01' + make_dt_interval(0, 0, cast(id AS int)) AS tpep_pickup_datetime",
        "5 + id / 100.0D AS total_amount",
        "0.5 + id / 50.0D AS trip_distance",
    )
    late = rows.limit(5).withColumn("tpep_pickup_datetime", F.lit(dt.datetime(2025, 2, 1)).cast("timestamp_ntz"))
    rows.unionByName(late).write.parquet(str(tmp_path / "trips.parquet"))
    zones = tmp_path / "zones.csv"
    zones.write_text("LocationID,Borough,Zone,service_zone\n1,Manhattan,A,Yellow Zone\n2,,B,Boro Zone\n")
    made = star.trip_star(spark, str(tmp_path / "trips.parquet"), str(zones), n_orders=1_000)
    assert made.orders.count() == 1_000 and made.orders.select("order_id").distinct().count() == 1_000
    assert {r.status for r in made.orders.select("status").distinct().collect()} == {"completed", "refunded"}
    assert {r.region for r in made.customers.collect()} == {"Manhattan", "Unknown"}
    assert made.products.count() == 7
    with pytest.raises(ValueError):
        star.trip_star(spark, str(tmp_path / "trips.parquet"), str(zones), n_orders=2_000)
    with pytest.raises(ValueError):
        star.trip_star(spark, str(tmp_path / "trips.parquet"), str(zones), n_orders=10)
    zones.write_text("LocationID,Borough,Zone\n1,Manhattan,A\n")
    with pytest.raises(ValueError):
        star.trip_star(spark, str(tmp_path / "trips.parquet"), str(zones), n_orders=1_000)


def test_shared_folder_follows_the_setting(spark):
    """The setting is fixed at start, so a stand-in session plays the two cases."""

    class Session:
        def __init__(self, folder, master):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = type("Context", (), {"applicationId": f"{folder}-{master}", "master": master})

    assert shared_folder(Session("hdfs://shared/folder/", "yarn")) == "hdfs://shared/folder"
    with pytest.raises(RuntimeError):
        shared_folder(Session(None, "yarn"))
    local = Session(None, "local[2]")
    assert shared_folder(local) == shared_folder(local)
    given = spark.conf.get("spark.checkpoint.dir", None)
    assert given is None or shared_folder(spark) == given.rstrip("/")


def test_stored_tables_keep_their_rows(spark):
    rows = spark.range(10).selectExpr("id", "cast(id AS string) AS name", "array(id) AS listed")
    assert stored(rows, "rows").exceptAll(rows).count() == 0


def test_manifests_name_what_changed(spark, tmp_path):
    for name, text in (("a.txt", "alpha"), ("b.txt", "beta"), ("c.txt", "gamma")):
        (tmp_path / name).write_text(text)
    before = stored(sinks.file_hashes(spark, str(tmp_path)), "manifest")
    (tmp_path / "b.txt").write_text("changed")
    (tmp_path / "d.txt").write_text("new")
    expected = before.unionByName(before.filter("path LIKE '%a.txt'").withColumn("path", F.lit("gone.txt")))
    told = {r.path.rsplit("/", 1)[-1]: r.problem for r in sinks.compare_manifest(expected, sinks.file_hashes(spark, str(tmp_path))).collect()}
    assert told == {"b.txt": "mismatch", "d.txt": "unexpected", "gone.txt": "missing"}
    import hashlib

    hashes = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in before.collect()}
    assert hashes["a.txt"] == hashlib.sha256(b"alpha").hexdigest()


def test_fingerprints_ignore_order_but_not_multiplicity(spark):
    rows = spark.range(100).selectExpr("id", "cast(id % 7 AS string) AS s")
    one = sinks.table_fingerprint(rows).first()
    assert one == sinks.table_fingerprint(rows.orderBy(F.desc("id")).repartition(5)).first()
    twice = sinks.table_fingerprint(rows.unionByName(rows.limit(2)).unionByName(rows.limit(2))).first()
    assert twice.rows == 104 and twice.total != one.total


def test_evidence(spark):
    values = spark.createDataFrame([(5, 0.25)], "n long, x double")
    told = {r.check: r.passed for r in sinks.check_evidence(values, [("n", "==", 5), ("x", "<", 0.2), ("x", ">", 0.2)]).collect()}
    assert told == {"n == 5": True, "x < 0.2": False, "x > 0.2": True}


def test_study_writes_its_tables(spark, data, tmp_path):
    stars = {"lines": star.line_star(spark, data), "events": star.event_star(spark, data)}
    chosen = [dfx.missing_measures(), dfx.duplicate_facts()]
    tables = studies.relational_study(stars, chosen, bootstrap_samples=200, severities=(0.1,), repeats=2, master_seed=1)
    sinks.write_results(tables, str(tmp_path / "csv"), fmt="csv")
    sinks.write_results({"attributions": tables["attributions"]}, str(tmp_path / "pq"), by=["regime"])
    read = spark.read.csv(str(tmp_path / "csv" / "observations"), header=True, inferSchema=True)
    assert read.count() == 2 * 2 * 4
    assert set(json.loads(read.first().query_losses)) == {
        "revenue_region", "revenue_month", "revenue_category", "aov_segment", "refund_region", "orders_status", "customers_region", "daily_revenue"
    }
    assert spark.read.parquet(str(tmp_path / "pq" / "attributions")).filter("regime = 'events'").count() == 2
    summary = {r.regime: r for r in tables["summary"].collect()}
    assert summary["lines"].orders == 6000 and summary["events"].customers > 0
    assert tables["query_attributions"].count() == 2 * 8 * 2


def test_scale_study_reports_its_work(spark):
    rows = studies.scale_study(spark, [1_000]).collect()
    assert rows[0].coalition_evaluations == 64 and rows[0].query_executions == 512
    assert 0 < rows[0].peak_risk <= 1


def test_fingerprints_tell_tables_apart(spark):
    """Separators, nulls and the text NULL are not mixed up; the order of rows and columns does not matter."""
    tables = [[("a|b", "c")], [("a", "b|c")], [(None, "c")], [("NULL", "c")], [("N", "c")], [("a", "c"), ("a", "c")], [("a", "c")], [("", "ac")]]
    seen = [tuple(sinks.table_fingerprint(spark.createDataFrame(rows, "x string, y string")).first()) for rows in tables]
    assert len(set(seen)) == len(tables)
    one = spark.createDataFrame([(1, 0.5), (2, None)], "x int, y double")
    other = spark.createDataFrame([(None, 2), (0.5, 1)], "y double, x int")
    assert sinks.table_fingerprint(one).first() == sinks.table_fingerprint(other).first()


def test_doubles_are_written_by_their_bits(spark):
    import struct

    numbers = [0.0, -0.0, 1.0, -1.5, 0.1, 1e10, 2e10, 1e308, -1.7976931348623157e308, 2.2250738585072014e-308, 5e-324, 3e-320, float("inf"), float("-inf"), float("nan")]
    numbers += [2.0**k for k in range(-1074, 1024, 37)] + [float(np_next) for np_next in (0.9999999999999999, 1.0000000000000002, 3.9999999999999996)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    told = {r.i: r.t for r in rows.select("i", sinks.double_text(F.col("x")).alias("t")).collect()}
    bits = {i: struct.pack(">d", x if x else 0.0) for i, x in enumerate(numbers)}
    assert all((told[i] == told[j]) == (bits[i] == bits[j]) for i in told for j in told)
    assert told[2] == f"{1 << 52}p0" and told[0] == told[1] == "0"

    def printed(*values):
        return sinks.table_fingerprint(spark.createDataFrame([(v,) for v in values], "x double")).first()

    assert printed(1e10, 0.0) != printed(2e10, float("nan"))
    assert printed(0.1, None) != printed(0.1 + 1e-12, None)


def test_large_files_are_hashed_as_streams(spark, tmp_path, monkeypatch):
    import hashlib

    sizes = {"empty": 0, "small": 1_000, "large": 3 * sinks.PIECE + 17, "nested/also large": 2 * sinks.PIECE}
    for name, size in sizes.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(bytes(i * 31 % 251 for i in range(997)) * (size // 997) + b"x" * (size % 997))
    monkeypatch.setattr(sinks, "WHOLE_BYTES", 2_000)
    got = {r.path.split(str(tmp_path) + "/")[-1].replace("%20", " "): (r.length, r.sha256) for r in sinks.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {name: (size, hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()) for name, size in sizes.items()}
