"""Interaction of five filters, counted by an incremental stream with retractions.

A file stream runs over all files in available-now micro-batches. Four filters look at a text alone; the fifth fails a text that a smaller
id has too, wherever in the table. The state of a text (by 128 bits of its SHA-256) is the smallest id seen so far and what
its rows count as. A smaller id that arrives later takes the place; the rows that held it are retracted from their part's counter and counted again
as copies. Counters of a micro-batch are written under its number, so a batch that runs twice counts once, and a run that broke off goes
on where it stood. Called again with the same folder, it reads only files that are new.

A call of a Python state function costs milliseconds, so the state store's key is a bucket of some thousand texts, and its value a small table
keyed by text, which a micro-batch updates in one pass. The store is on disk (RocksDB). Rows are combined
inside each Arrow batch before every shuffle, so neither a repeated row nor a text with a third of all rows sends its rows to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from caderneta.llm.common import col, partitions
from caderneta.session import scratch_path, settings

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
MICRO_BATCHES = 4
# Texts that a bucket of the state is laid out for.
BUCKET_TEXTS = 2048
COUNTERS = "part string, mask int, good int, toxic int, delta long"
# A store for each partition: without this, each of them would set aside megabytes for its log.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    bare = F.trim(text, F.lit(WHITE_CHARS))
    words = F.when(bare != "", F.split(bare, WHITE))
    n, distinct = F.coalesce(F.size(words), F.lit(0)), F.coalesce(F.size(F.array_distinct(words)), F.lit(0))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [
        n < 100,
        F.lit(100).cast("long") * distinct < F.lit(80).cast("long") * n,
        F.lit(100).cast("long") * capitals > F.lit(10).cast("long") * F.length(text),
        F.rlike(text, F.lit(r"[#$%&*|]")),
    ]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def facts(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(sha, mask, part, has_id, doc_id) of each row; the text goes no further."""
    whole = F.coalesce(col(text), F.lit(""))
    return docs.select(
        F.unhex(F.left(F.sha2(whole, 256), F.lit(32))).alias("sha"), failures(whole).alias("mask"), F.coalesce(col(part), F.lit("")).alias("part"),
        col(key).isNotNull().alias("has_id"), F.coalesce(col(key), F.lit(0)).cast("long").alias("doc_id"),
    )


def label_flags(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, good, toxic): whether any label of the document says so."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    return labels.filter(col(key).isNotNull()).groupBy(col(key).alias("doc_id")).agg(
        flag("quality").alias("good"), flag("toxic").alias("toxic")
    )


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of an Arrow batch as one row with their number ``n``."""
    for batch in batches:
        if batch.num_rows:
            names = batch.schema.names
            found = pa.table(batch).group_by(names).aggregate([([], "count_all")]).rename_columns([*names, "n"])
            yield from found.combine_chunks().to_batches()


def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text, part and label as one row: the smallest id, rows ``at`` that id, and rows ``n`` in all."""
    for batch in batches:
        if batch.num_rows:
            keys = ["sha", "mask", "part", "good", "toxic", "has_id"]
            ids = pa.table(batch).group_by([*keys, "doc_id"]).aggregate([("n", "sum")]).sort_by("doc_id")
            ids = ids.rename_columns([*keys, "doc_id", "n"])
            found = ids.group_by(keys, use_threads=False).aggregate([("doc_id", "first"), ("n", "first"), ("n", "sum")])
            yield from found.rename_columns([*keys, "doc_id", "at", "n"]).combine_chunks().to_batches()


ENTRY = ["sha", "mask", "part", "good", "toxic", "doc_id", "n"]


def updated(held: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """New state of some texts and the changes of the counters.

    ``rows`` has (sha, mask, part, good, toxic, has_id, doc_id, at, n). The state has, for each text, the rows with its smallest id: their part
    and labels, and how many they are. Rows without an id have no smaller one and are nobody's smaller one.
    """
    known = rows[rows["has_id"]]
    ids = pd.concat([held[["sha", "doc_id"]], known[["sha", "doc_id"]]], ignore_index=True)
    first = ids.groupby("sha", sort=False)["doc_id"].min()
    holds = known["doc_id"].to_numpy() == first.reindex(known["sha"]).to_numpy()
    new = known[holds].assign(n=known["at"][holds])
    gives_way = held["doc_id"].to_numpy() > first.reindex(held["sha"]).to_numpy()
    beaten = held[gives_way]
    copies = known.assign(n=known["n"] - known["at"].where(holds, 0))
    counted = [
        (new, 0, 1), (copies, COPY, 1), (rows[~rows["has_id"]], 0, 1), (beaten, 0, -1), (beaten, COPY, 1),
    ]
    delta = pd.concat([
        pd.DataFrame({"part": f["part"], "mask": f["mask"] | bit, "good": f["good"], "toxic": f["toxic"], "delta": f["n"] * sign})
        for f, bit, sign in counted
    ])
    delta = delta.groupby(["part", "mask", "good", "toxic"], as_index=False, sort=False)["delta"].sum()
    state = pd.concat([held[~gives_way], new[ENTRY]]).groupby(ENTRY[:-1], as_index=False, sort=False)["n"].sum()
    return state, delta[delta["delta"] != 0]


def packed(state: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    content = pa.Table.from_pandas(state[ENTRY], preserve_index=False)
    with pa.ipc.new_stream(sink, content.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(content)
    return sink.getvalue().to_pybytes()


def _on_bucket(key, frames, state):
    rows = pd.concat(frames, ignore_index=True)
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else rows[ENTRY].iloc[:0]
    after, delta = updated(held, rows)
    if len(after):
        state.update((packed(after),))
    yield delta


def changes(found: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """Changes of the counters (``COUNTERS``) from a stream of ``facts``."""
    once = found.mapInArrow(repeats, f"{_schema(found)}, n long")
    # Rows without an id must not meet in one task for the sake of a join in which they find nothing.
    spot = F.when(F.col("has_id"), F.col("doc_id")).otherwise(F.xxhash64("sha", "part"))
    flags = label_flags(labels).withColumnsRenamed({"doc_id": "labelled"})
    joined = once.join(flags, (spot == F.col("labelled")) & F.col("has_id"), "left").select(
        *once.columns, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    brief = "sha binary, mask int, part string, good int, toxic int, has_id boolean, doc_id long, at long, n long"
    bucket = F.pmod(F.xxhash64("sha"), F.lit(buckets))
    grouped = joined.mapInArrow(lowest, brief).withColumn("bucket", bucket).groupBy("bucket")
    return grouped.applyInPandasWithState(_on_bucket, COUNTERS, "texts binary", "update", GroupStateTimeout.NoTimeout)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _watched(path: str, names: list[str]) -> str:
    """``path`` as a file stream takes it: a single file must be a pattern, as a plain path has to be a folder."""
    own = path.rstrip("/").rpartition("/")[2]
    alone = len(names) == 1 and unquote(names[0]).rpartition("/")[2] == own
    return f"{path.rstrip('/')[:-1]}[{own[-1]}]" if alone else path


def _buckets(static: DataFrame, path: str) -> int:
    """Buckets of the state: as laid out by the first call with this folder, four times what its rows ask for."""
    spark = static.sparkSession
    wanted = max(4 * partitions(spark), 4 * static.count() // BUCKET_TEXTS)
    spark.createDataFrame([(wanted,)], "n long").write.mode("ignore").parquet(path)
    return spark.read.schema("n long").parquet(path).first()["n"]


def count(
    spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the set of filters that they fail, and how many of them are labelled so.

    ``path`` holds parquet files. ``folder`` keeps checkpoint, state and counters, a new one by default; with the folder of an earlier call,
    only files that are new since are read. Null texts count as empty, null parts as the empty string; repeated rows count each, and
    rows that share the smallest id of their text all pass filter E. Several labels of a document count as one that
    has what any of them says. Without rows the result is empty. Other columns may have any name.
    """
    folder = folder or scratch_path(spark, "filter-audit")
    stored = f"{folder}/counters"
    spark.createDataFrame([], COUNTERS).write.mode("overwrite").parquet(f"{stored}/batch=-1")
    static = spark.read.parquet(path)
    names = static.inputFiles()
    files = max(1, -(-len(names) // MICRO_BATCHES))

    buckets = _buckets(static, f"{folder}/buckets")

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("delta").alias("delta"))
        sums.write.mode("overwrite").parquet(f"{stored}/batch={number}")

    with settings(spark, STORE):
        docs = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files).parquet(_watched(path, names))
        writer = changes(facts(docs, key, text, part), labels, buckets).writeStream.outputMode("update").foreachBatch(write)
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    total = F.sum("delta")
    flagged = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("delta"))), F.lit(0))
    sums = spark.read.schema(COUNTERS).parquet(stored).groupBy("part", "mask").agg(
        total.alias("n"), flagged("good").alias("good"), flagged("toxic").alias("toxic")
    )
    return sums.filter("n != 0")


def steps(counts: DataFrame) -> DataFrame:
    """Every part, order of the filters and step, with what the step does, from the counts by failed filters.

    Work is 600 rows for each part and set of failed filters, of which there are 32 at most.
    """
    order, step = F.col("filter_order"), F.col("step")
    bit = lambda place: F.expr(f"shiftleft(1, ascii(substring(filter_order, {place}, 1)) - ascii('A'))")
    before = sum((F.when(step > j, bit(j)).otherwise(0) for j in range(1, len(FILTERS))), F.lit(0))
    every = counts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ",")))
    every = every.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    every = every.withColumns({"here": bit("step"), "before": before})
    mask, here, earlier = F.col("mask"), F.col("here"), F.col("before")
    fails, gone = mask.bitwiseAND(here) != 0, mask.bitwiseAND(earlier) != 0
    share = F.lit(len(ORDERS)) / F.greatest(F.bit_count(mask), F.lit(1))
    whole = {
        "kept": (~fails & ~gone, F.col("n")), "removed": (fails & ~gone, F.col("n")), "redundant": (fails & gone, F.col("n")),
        "unique_fails": (mask == here, F.col("n")), "good_lost": (fails & ~gone, F.col("good")),
        "toxic_lost": (fails & ~gone, F.col("toxic")), "shapley": (fails, F.col("n") * share.cast("long")),
    }
    sums = [F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("long").alias(name) for name, (test, value) in whole.items()]
    return every.groupBy("part", order, step).agg(*sums)
