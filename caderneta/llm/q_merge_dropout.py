"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caderneta.llm import merge_dropout
from caderneta.llm.common import table
from caderneta.llm.packing import tokenizer_path
from caderneta.llm.registry import query


@query("op3_merge_dropout")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under dropout, and the length and checksum of the text that they decode to."""
    model = tokenizer_path("piece_bpe_32k.model")
    both = merge_dropout.round_trip(table(spark, sf_dir, "documents"), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_chars", "decoded_sha256")
