"""Session defaults and the shared folder that derived tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_written: dict[tuple, str] = {}
_kept: dict[tuple, object] = {}


def local_session(app: str = "tarnish", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of a generated method that the JVM still compiles; a larger one is interpreted for every row.
COMPILED_BYTES = 8_000
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def compiled(spark: SparkSession) -> None:
    """Steps whose fused loop the JVM would not compile run operator by operator, unless the session names a limit of its own."""
    if spark.conf.get(METHOD_LIMIT) == "65535":
        spark.conf.set(METHOD_LIMIT, str(COMPILED_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local master, whose driver and executors are one machine, may go
    without the setting; it then gets a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        _local_folders[app] = tempfile.mkdtemp(prefix="tarnish-")
    return _local_folders[app]


def write_table(df: DataFrame, name: str, compression: str | None = None) -> str:
    """Write a derived table to the shared folder and return its path."""
    path = f"{shared_folder(df.sparkSession)}/tarnish/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: the same rows, read back from the shared folder."""
    return df.sparkSession.read.parquet(write_table(df, name))


def stored_once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """A table that this application builds at most once per key."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _written:
        _written[full] = write_table(build(), str(key[0]))
    return spark.read.parquet(_written[full])


def kept_once(spark: SparkSession, key: tuple, build):
    """As ``stored_once``, for what its builder has written already, as tables with dense ids are."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _kept:
        _kept[full] = build()
    return _kept[full]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


INLINE_ROWS = 5_000


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of parameters. Inline values have a known size, so joins with them need no hint and no job."""
    if not rows or len(rows) > INLINE_ROWS:
        return spark.createDataFrame(rows, schema)
    fields = [part.split() for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(f'`{name}`' for name, _ in fields)})")
    return table.selectExpr(*[f"cast(`{name}` AS {kind}) AS `{name}`" for name, kind in fields])
