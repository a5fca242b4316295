"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tidemark", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster, settings come from spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster where it is installed, or was sent with --py-files, the extra entry is idle.
    """
    here = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and all runs on one machine (tests), a temporary folder
    takes its place.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        known = sc._jsc.sc().getCheckpointDir()
    return str(known.get()).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for one run's table or model; no two calls return the same. What is there when the
    driver ends is deleted then."""
    uri = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    store, path = _store(spark, uri)
    store.deleteOnExit(path)
    return uri


def _store(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


_scopes: list[dict[str, SparkSession]] = []


@contextmanager
def scratch() -> Iterator[_Tables]:
    """Deletes the tables that materialize() writes inside, but for those that are kept.

    For work whose result is one small table: what leaves the block must not read the others.
    """
    _scopes.append({})
    try:
        yield _Tables(_scopes[-1])
    finally:
        for uri, spark in _scopes.pop().items():
            store, path = _store(spark, uri)
            store.delete(path, True)


class _Tables:
    def __init__(self, written: dict[str, SparkSession]) -> None:
        self.written = written

    def keep(self, table: DataFrame) -> DataFrame:
        """Leave a table that materialize() returned, to the scope around or to the driver's end."""
        uri = table.__dict__["written_to"]
        spark = self.written.pop(uri)
        if len(_scopes) > 1:
            _scopes[-2][uri] = spark
        return table


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there.

    Lost executors then cost only the tasks that ran on them, and later stages neither
    recompute df nor see other rows than the ones that were written.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1][path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["written_to"] = path
    return out


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else as it is, to be shuffled.

    For narrow tables that materialize() wrote: counting them reads footers only.
    """
    return F.broadcast(df) if df.count() <= rows else df
