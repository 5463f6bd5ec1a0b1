"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caderneta.llm import simhash
from caderneta.llm.common import table
from caderneta.llm.registry import query


@query("op6_simhash_gray")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
