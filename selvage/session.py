"""Session factory and the few runtime helpers that need the session itself."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "selvage", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from outside."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SELVAGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (local mode, tests) a temporary folder is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(at)
        return at
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="selvage-"))
        have = spark.sparkContext.getCheckpointDir()
    return have


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts lineage (so a lost executor costs a re-read, not a re-run) and keeps columns compressed.
    The file system removes the table when the application ends.  The shuffle files behind it are
    not read again, so Spark is told to remove them at the end of the write: a query of several jobs
    holds on disk what one of them needs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/selvage-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables of :func:`cut` whose last reader has itself been written."""
    for df in written:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The shuffle width of the session, which the cluster sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
