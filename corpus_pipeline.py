"""A training-data pipeline over ``documents``: language, quality, near-duplicates, personal data, packing.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``docs``; the last returns one row per piece of
a packed sequence. ``run`` writes each stage to the shared folder, so a lost executor repeats a task and no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caderneta.llm import language_id, line_quality, near_copies, packing, surrogates
from caderneta.llm.common import cols, fresh, table
from caderneta.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language. Those without letters, and those for which no language has half of the probability, go."""
    return language_id.keep_identified(docs, language_id.fit(docs.filter(~language_id.held_out())))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted, without the lines that are boilerplate of their source."""
    return line_quality.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that is, of five-word shingle sets with a similarity of 0.8 or more: the one with the smallest doc_id.

    Repeated rows are near copies of themselves; rows with one doc_id and different texts are judged by their texts. A document without
    doc_id stands behind all that have one, in the order of a hash of its text. Null and empty texts are alike.
    """
    (key,) = fresh(docs, "row_key")
    beyond = F.shiftrightunsigned(F.xxhash64("text"), 3) + F.lit(1 << 62)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id"), beyond))
    return near_copies.keep_first(keyed, key).select(*cols(docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by surrogates."""
    return surrogates.pseudonymise(docs, surrogates.DEMONSTRATION_KEY)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences that hold all documents."""
    return packing.packed(docs, packing.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

# Fitted models, token ids and keyed hashes have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
