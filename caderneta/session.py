"""Session helpers: local test sessions, shared scratch folders, size checks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Mapping
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "caderneta") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, empty path under the shared folder, in a folder of this application that can go when the application has ended."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# Shuffle files of a write are of no use once its result is there; otherwise those of all writes pile up until the driver collects garbage.
CLEANED_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_writes, _lock, _cleaning = 0, threading.Lock(), ExitStack()


@contextmanager
def _shuffles_cleaned_up(spark: SparkSession):
    """While a write runs. Writes of several threads overlap: the first sets what the last takes back."""
    global _writes
    with _lock:
        if not _writes:
            _cleaning.enter_context(settings(spark, CLEANED_UP))
        _writes += 1
    try:
        yield
    finally:
        with _lock:
            _writes -= 1
            if not _writes:
                _cleaning.close()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Used where several jobs read the same result: unlike cached blocks the files
    outlive a lost executor, the lineage behind them is cut, and the shuffles behind them go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_cleaned_up(spark):
        df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]):
    """Session settings for what runs inside; the earlier ones return."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
