"""Query of operator 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caderneta.llm import page_text
from caderneta.llm.common import table
from caderneta.llm.registry import query


@query("op5_page_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))
