"""File stream of corrections: every new file is read once, ids already in the target are skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caderneta.session import settings

BATCH = "ingest_batch"
# Keys on disk; a store of each partition sets nothing aside for its log.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def target_table(spark: SparkSession, target: str, schema: str | None = None) -> DataFrame | None:
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(target)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def first_rows(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key its first row by arrival, then ``order``: a streaming aggregate whose state is kept by key.

    ``__born`` and ``__latest`` are the times of the first and the last micro-batch that had the key; Spark fixes a batch's time in its
    log, so a repeated batch has the same one. Where they are equal, the key is new in this batch.
    """
    keys = list(keys)
    timed = stream.withColumn("__at", F.current_timestamp())
    row = F.struct(*[F.col(c) for c in stream.columns if c not in keys])
    return timed.groupBy(*keys).agg(
        F.min_by(row, F.struct("__at", *order)).alias("__row"), F.min("__at").alias("__born"), F.max("__at").alias("__latest")
    )


def append_new(batch: DataFrame, batch_id: int, target: str, columns: Sequence[str]) -> None:
    """Write the rows of the keys that are new in this batch. Each batch owns one folder and replaces it."""
    fresh = batch.filter("__born = __latest").select("*", "__row.*").select(*columns)
    fresh.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")


def ingest(
    spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str],
    file_format: str = "parquet", glob: str | None = None, files_per_batch: int = 1000, options: dict | None = None,
) -> None:
    """Consume all files that arrived since the last call and stop.

    The checkpoint is the ledger of consumed files and holds the keys seen so far, in a state store on disk that each micro-batch asks only
    for its own keys: what a batch does is independent of the size of the target. The target belongs to this stream. Pending files
    are taken in the order of arrival, ``files_per_batch`` at a time.
    """
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    arrived = reader.load(source)
    with settings(spark, STATE_STORE):
        stream = (
            first_rows(arrived, keys, order)
            .writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: append_new(df, n, target, arrived.columns))
            .start()
        )
        stream.awaitTermination()
