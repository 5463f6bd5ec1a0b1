"""CSV, JSON and text sources. Everything is read as strings and typed later with ``try_`` casts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caderneta import schemas
from caderneta.functions.text import normalize_headers
from caderneta.operators.cascade import Settings
from caderneta.sources.records import file_list, read_lines


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """CSV with known columns. The header line (with or without a byte order mark) is skipped."""
    return spark.read.schema(schemas.all_strings(columns)).option("header", header).csv(path)


def read_csv_with_headers(spark: SparkSession, path: str, light: bool = False) -> DataFrame:
    """CSV whose header names the columns; names are normalised."""
    return normalize_headers(spark.read.option("header", True).csv(path), light)


def read_positional(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV without a header."""
    return read_csv(spark, path, names, header=False)


def read_ordered_csv(spark: SparkSession, path: str, width: int, glob: str | None = None) -> DataFrame:
    """Export rows ``(doc_id, line_no, c0, c1, ...)`` with the order of the file."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = read_lines(spark, path, glob).filter(F.trim("line") != "")
    return rows.select("doc_id", "line_no", F.from_csv("line", F.lit(schema)).alias("r")).select("doc_id", "line_no", "r.*")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One row per transaction of every request file, with the request's settings."""
    raw = spark.read.schema(schemas.REQUEST).option("multiLine", True).json(path)
    rows = raw.select(
        F.col("_metadata.file_name").alias("request"), "config", F.posexplode("transactions").alias("row_no", "t")
    )
    return rows.select("request", "row_no", "t.*", "config")


def settings_of(config) -> Settings:
    """Cascade settings of one request (a Row or dict); absent values keep their defaults."""
    given = config.asDict() if hasattr(config, "asDict") else dict(config or {})
    names = {
        "similarity_threshold": "similarity_threshold", "model_threshold": "model_threshold",
        "enable_deterministic_rules": "use_rules", "enable_tfidf_similarity": "use_similarity",
        "enable_fallback_ai": "use_replies", "use_pipeline_model": "use_model",
    }
    return Settings(**{ours: given[theirs] for theirs, ours in names.items() if given.get(theirs) is not None})


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, cards, rejects) of expected statement results, items with their position."""
    raw = spark.read.schema(schemas.GOLDEN).option("multiLine", True).json(path).withColumn(
        "doc_id", F.col("_metadata.file_name")
    )
    items = raw.select("doc_id", F.posexplode("items").alias("pos", "i")).select("doc_id", "pos", "i.*")
    cards = raw.select("doc_id", F.explode("stats.by_card").alias("card", "c")).select("doc_id", "card", "c.*")
    rejects = raw.select("doc_id", F.explode("rejects").alias("r")).select("doc_id", "r.*")
    return items, cards, rejects


def profile(spark: SparkSession, path: str, sample: int = 5) -> dict:
    """Columns, a few rows and the size of a CSV data set."""
    try:
        df = spark.read.option("header", True).csv(path)
    except Exception as exc:  # a missing path is an answer here
        if "PATH_NOT_FOUND" in str(exc):
            return {"exists": False}
        raise
    size = file_list(spark, path).agg(F.sum("size")).first()[0]
    rows = df.limit(sample).collect()
    return {"exists": True, "columns": df.columns, "column_count": len(df.columns), "sample_rows": len(rows), "sample": rows, "size": size}

