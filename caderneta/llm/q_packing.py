"""Query of operator 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caderneta.llm import packing
from caderneta.llm.common import table
from caderneta.llm.registry import query


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.tokenizer_path("word_bpe_49k.json"))
