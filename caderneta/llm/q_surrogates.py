"""Query of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caderneta.llm import surrogates
from caderneta.llm.common import table
from caderneta.llm.registry import query

@query("op2_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after replacement and the number of replaced mentions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, surrogates.DEMONSTRATION_KEY, counted="n_replaced")
