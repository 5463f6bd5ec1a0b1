"""Query of operator 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caderneta.llm import imatch
from caderneta.llm.common import table
from caderneta.llm.registry import query


@query("op7_imatch")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare(table(spark, sf_dir, "documents"))
