"""Session defaults and the shared working folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: "Now" of every registered query: 2025-01-01T00:00:00Z in milliseconds.
NOW_MS = 1735689600000


def get_session(app: str = "loomdex", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects; on a cluster use its own session instead."""
    b = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomdex-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_scopes: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table. It goes with its scratch() block, and else with the application, whose folder is deleted at its end."""
    home = f"{shared_dir(spark)}/loomdex/{spark.sparkContext.applicationId}"
    fs, p = _file_system(spark, home)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables made inside the block are deleted when it ends, so frames that rest on them must be used up inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            fs, p = _file_system(spark, path)
            fs.delete(p, True)


def sweep(spark: SparkSession, older_than_ms: int) -> int:
    """Delete what applications that ended without cleaning up left longer ago than this; returns how many folders."""
    fs, p = _file_system(spark, f"{shared_dir(spark)}/loomdex")
    if not fs.exists(p):
        return 0
    own, now, n = spark.sparkContext.applicationId, int(time.time() * 1000), 0
    for s in fs.listStatus(p):
        if s.getPath().getName() != own and now - s.getModificationTime() > older_than_ms:
            n += bool(fs.delete(s.getPath(), True))
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage at a table written in the shared folder: it survives the loss of executors, unlike a cached frame."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of fewer splits than there are cores, dealt out to all of them: for work that is heavy for each row."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
