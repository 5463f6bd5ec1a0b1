"""Summaries of classified transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def _percent(df: DataFrame) -> Column:
    return F.round(100.0 * F.col("n") / df.agg(F.count("*")).scalar(), 6)


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per value; the total is a scalar subquery, so labels of any number stay distributed."""
    return frequency(df, column).withColumn("pct", _percent(df))


def top_labels(df: DataFrame, label: str, k: int = 5, unsure: str = "duvida") -> DataFrame:
    """The k most frequent labels without the unsure one; percentages are of all rows."""
    named = frequency(df, label).filter((F.col(label) != unsure) & (F.col(label) != ""))
    return named.orderBy(F.desc("n"), label).limit(k).withColumn("pct", _percent(df))


def batch_stats(df: DataFrame, sure: float = 0.7) -> DataFrame:
    """One row: totals, mean confidence, unsure and fallback counts. The labels are rows of ``frequency``."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.col("method_used") != "error", F.lit(True))).alias("succeeded"),
        (F.sum("confidence") / F.count("*")).alias("mean_confidence"),
        F.count_if(F.col("confidence") < sure).alias("low_confidence"),
        F.count_if(F.col("method_used").isin("fallback", "error")).alias("fallbacks"),
    )


def balance_rows(base: DataFrame, feedback: DataFrame, category: str) -> DataFrame:
    """(category, base, feedback): rows of each category on both sides, in one pass."""
    sides = base.select(F.col(category).alias("category"), F.lit(0).alias("s")).unionByName(
        feedback.select(F.col(category).alias("category"), F.lit(1).alias("s"))
    )
    return sides.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.count_if(F.col("s") == 0).alias("base"), F.count_if(F.col("s") == 1).alias("feedback")
    )


def balance(base: DataFrame, feedback: DataFrame, category: str) -> DataFrame:
    """One row: categories on each side, new ones, and rows with a category in the feedback."""
    return balance_rows(base, feedback, category).agg(
        F.count_if(F.col("base") > 0).alias("base_categories"),
        F.count_if(F.col("feedback") > 0).alias("feedback_categories"),
        F.count_if((F.col("feedback") > 0) & (F.col("base") == 0)).alias("new_categories"),
        F.coalesce(F.sum("feedback"), F.lit(0)).alias("feedback_rows"),
    )


def new_categories(base: DataFrame, feedback: DataFrame, category: str) -> DataFrame:
    return feedback.select(category).subtract(base.select(category))
