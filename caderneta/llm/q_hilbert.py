"""Query of operator 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caderneta.llm import hilbert
from caderneta.llm.common import table
from caderneta.llm.registry import query
from caderneta.session import materialise

SHARDS = 24


@query("op9_hilbert_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: shard sizes in documents differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    stored = materialise(narrow, "hilbert")
    placed = hilbert.assign(
        stored, {"lang": "lang", "source": "source", "size": "size"}, ["doc_id", "text_crc32", "size"], SHARDS
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
