"""Result sinks and versioned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header, every null an empty field."""
    blank = df.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    blank.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a consolidated table without rewriting it."""
    df.write.mode("append").parquet(path)


def flatten_predictions(df: DataFrame, transaction: str = "transaction", prediction: str = "prediction") -> DataFrame:
    """Two nested columns as one flat row for a CSV."""
    return df.select(f"{transaction}.*", f"{prediction}.*")


# --- versions: <root>/data/v=<version>, <root>/files/v=<version>, and a pointer row per accepted version ---
#
# Appending the pointer row is the commit: one row in one file, so it is there or not. Data and consumed files without a pointer row are
# leftovers of a run that broke off; the next run of that version replaces them.

POINTER = "v string, rows bigint, delta bigint, written_at timestamp"
FILES = "file_name string, status string"
MODELS = "v string, path string, written_at timestamp"
# Versions are as new as their writing; names need not sort.


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def _pointer(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, f"{root}/pointer", POINTER)


def _add_row(spark: SparkSession, path: str, columns: dict) -> None:
    """One row in one new file."""
    spark.range(1).coalesce(1).select(*[c.alias(n) for n, c in columns.items()]).write.mode("append").parquet(path)


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Accepted versions, newest first."""
    return _pointer(spark, root).orderBy(F.desc("written_at"), F.desc("v"))


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest accepted version, None before the first."""
    newest = _pointer(spark, root).agg(F.max_by("v", F.struct("written_at", "v"))).first()[0]
    return None if newest is None else spark.read.parquet(f"{root}/data/v={newest}")


def write_version(df: DataFrame, root: str, version: str, columns: Sequence[str], files: DataFrame | None = None) -> dict:
    """Write a version, read it back, and only then commit it together with the ``files`` (file_name, status) that went into it.

    A version that is empty or lacks the exact columns is refused and the old one stays current:
    nothing was overwritten, so there is nothing to restore. A version that was committed isn't written again.
    """
    spark = df.sparkSession
    pointer = _pointer(spark, root)
    if not pointer.filter(F.col("v") == version).isEmpty():
        return {"success": False, "error": "version exists", "rows": 0}
    before = pointer.agg(F.max_by("rows", F.struct("written_at", "v"))).first()[0] or 0
    path = f"{root}/data/v={version}"
    df.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    rows = written.count()
    error = None
    if rows == 0:
        error = "written data is empty"
    elif list(written.columns) != list(columns):
        error = "written columns differ"
    if error:
        return {"success": False, "error": error, "rows": rows}
    if files is not None:
        files.select("file_name", "status").write.mode("overwrite").parquet(f"{root}/files/v={version}")
    _commit(spark, root, version, rows, rows - before)
    return {"success": True, "original_rows": before, "final_rows": rows, "new_rows": rows - before}


def _commit(spark: SparkSession, root: str, version: str, rows: int, delta: int) -> None:
    entry = {"v": F.lit(version), "rows": F.lit(rows).cast("bigint"), "delta": F.lit(delta).cast("bigint"), "written_at": F.current_timestamp()}
    _add_row(spark, f"{root}/pointer", entry)


def committed_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_name, status) of the files that went into accepted versions."""
    written = _table(spark, f"{root}/files", f"{FILES}, v string")
    return written.join(_pointer(spark, root).select("v").distinct(), "v", "left_semi").select("file_name", "status")


def add_model(spark: SparkSession, root: str, version: str, path: str) -> None:
    """Note that the model of a version has been saved."""
    _add_row(spark, f"{root}/models", {"v": F.lit(version), "path": F.lit(path), "written_at": F.current_timestamp()})


def version_without_model(spark: SparkSession, root: str) -> str | None:
    """The newest version, if corrections went into it and its model hasn't been saved."""
    newest = _pointer(spark, root).agg(F.max_by("v", F.struct("written_at", "v"))).first()[0]
    files = _table(spark, f"{root}/files", f"{FILES}, v string").filter(F.col("v") == newest)
    done = _table(spark, f"{root}/models", MODELS).filter(F.col("v") == newest)
    return None if newest is None or files.isEmpty() or not done.isEmpty() else newest


def retention(snapshots: DataFrame, version: str = "v", keep: int = 5) -> DataFrame:
    """``keep`` is true for the newest versions. One row per version, so one window is enough."""
    place = F.row_number().over(W.partitionBy().orderBy(F.desc(version)))
    return snapshots.withColumn("keep", place <= keep)


def drop_old_versions(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Empty the data of all but the newest versions; the pointer history stays."""
    old = [r["v"] for r in retention(_pointer(spark, root).groupBy("v").agg(F.max("written_at").alias("at")), "at", keep).filter("NOT keep").collect()]
    for v in old:
        path = f"{root}/data/v={v}"
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
    return old
