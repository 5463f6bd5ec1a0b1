"""Correction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def override(df: DataFrame, corrections: DataFrame, keys: Sequence[str], column: str, new: str = "corrected") -> DataFrame:
    """Replace ``column`` where the correction table has the keys; Spark picks the join by size."""
    joined = df.join(corrections.select(*keys, new), list(keys), "left")
    return joined.withColumn(column, F.coalesce(F.col(new), F.col(column))).select(*df.columns)
