"""Lines and CSV records of files of any size, with their order, cut into splits.

Spark reads text files in splits, so one file is many tasks. What a line is depends on the splits before it: its number, and whether it
begins inside a quoted field. Each split leaves one summary row (lines, quotes, and the records that begin in it if it starts outside
or inside a quoted field); a window over a file's few summaries gives every split what it has to add.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caderneta.session import materialise, settings

BOM = "\ufeff"


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(path, file_name, block, at, line): lines end at a line feed, a carriage return stays; ``at`` grows inside a split."""
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )


def _bare(line: Column, first: Column) -> Column:
    """Without the carriage return at the end and, in a file's first line, the byte order mark."""
    ended = F.regexp_replace(line, "\r$", "")
    return F.when(first & F.startswith(line, F.lit(BOM)), F.substr(ended, F.lit(2))).otherwise(ended)


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(doc_id, line_no, line) of every line, numbered from 0 through all splits of its file."""
    lines = _lines(spark, path, glob)
    inside = W.partitionBy("path", "block")
    sizes = lines.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.withColumn("number", F.row_number().over(inside.orderBy("at")))
    joined = numbered.join(sizes.select("path", "block", before.alias("before")), ["path", "block"])
    number = (F.col("before") + F.col("number") - 1).cast("bigint")
    return joined.select(F.col("file_name").alias("doc_id"), number.alias("line_no"), _bare(F.col("line"), number == 0).alias("line"))


def read_records(
    spark: SparkSession, path: str, glob: str | None = None, quote: str = '"', names: Sequence[str] | None = None
) -> DataFrame:
    """(file_name, record_no, record): CSV records, which may hold line breaks inside quoted fields.

    A line begins inside a quoted field if the quotes before it in its file are odd in number; a quote inside a field is doubled. Line breaks
    inside a record are kept. A field that is never closed runs to the end of its file. Empty lines are records. ``names`` keeps files of
    these names only; the others aren't opened.

    Lines stream past in the order of their split, so none is shuffled or sorted; only the pieces of records that a split's bounds cut are.
    """
    lines = _lines(spark, path, glob)
    if names is not None:
        lines = lines.filter(F.col("file_name").isin(list(names)))
    quotes = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    counted = lines.select("path", "file_name", "block", quotes.cast("bigint").alias("quotes")).mapInArrow(
        _summaries, "path string, file_name string, block bigint, quotes bigint, begin_0 bigint, begin_1 bigint"
    )
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    parity = counted.withColumn("parity", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    begun = F.when(F.col("parity") == 0, F.col("begin_0")).otherwise(F.col("begin_1"))
    carried = parity.withColumn("begun", begun).select(
        F.monotonically_increasing_id().alias("split"), "path", "file_name", "block", "parity",
        F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("before"),
        ((F.col("parity") == 1) | (F.col("quotes") % 2 == 1)).alias("cut"),
    )
    carried = materialise(carried, "splits")  # one row for each split

    def records(splits: DataFrame, cut: bool) -> DataFrame:
        known = F.broadcast(splits.select("path", "block", "split", "parity", "before"))
        found = lines.select("path", "block", "line").join(known, ["path", "block"], "inner" if cut else "left")
        # The same files are read again later; a line of a split that nobody counted ends the job, it isn't lost.
        same = F.coalesce("split", F.raise_error(F.lit("the files or their splits have changed while they were read")).cast("bigint"))
        found = found.select(same.alias("split"), "parity", "before", "line")
        found = found.mapInArrow(_records(quote, cut), "split bigint, record_no bigint, record string")
        return found.join(F.broadcast(splits.select("split", "path", "file_name", "block")), "split")

    whole = records(carried, False).select("file_name", "record_no", "record")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n")
    pieced = records(carried.filter("cut"), True).groupBy("path", "file_name", "record_no").agg(parts.alias("record"))
    both = whole.unionByName(pieced.select("file_name", "record_no", "record"))
    return both.select("file_name", "record_no", _bare(F.col("record"), F.col("record_no") == 0).alias("record"))


def _runs(*columns: pa.Array) -> list[int]:
    """Where the runs of equal values begin, and the end."""
    n = len(columns[0])
    if not n:
        return [0]
    changes = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns]
    return [0, *(np.flatnonzero(np.logical_or.reduce(changes)) + 1).tolist(), n]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split: its quotes, and the records that begin in it for an even and an odd number of quotes before it."""
    rows: list[list] = []
    for batch in batches:
        path, name, block, quotes = batch.columns
        bounds, counts = _runs(path, block), quotes.to_numpy()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = [path[a].as_py(), name[a].as_py(), block[a].as_py()]
            if not rows or rows[-1][:3] != at:
                rows.append([*at, 0, 0, 0])
            split, own = rows[-1], counts[a:b]
            odd = int(((split[3] + np.cumsum(own) - own) % 2).sum())
            split[4] += b - a - odd
            split[5] += odd
            split[3] += int(own.sum())
    names = ["path", "file_name", "block", "quotes", "begin_0", "begin_1"]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _records(quote: str, cut: bool):
    """Function over the lines of splits: the records that lie in one split whole, or with ``cut`` the pieces at its bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = None, []  # of the open record, the lines so far
        odd = number = 0
        opened = False  # the open record began in this split

        def emit(numbers, found: pa.Array) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([split] * n, pa.int64()), pa.array(numbers, pa.int64()), found], ["split", "record_no", "record"])

        def close(ended: bool) -> Iterator[pa.RecordBatch]:
            if held and cut != (opened and ended):
                yield emit([number], pa.array(["\n".join(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x), "\n")[0].as_py() for x in held)]))
            held.clear()

        for batch in batches:
            bounds = _runs(batch.column(0))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own, parity, before = (batch.column(i)[a].as_py() for i in range(3))
                lines = batch.column(3).slice(a, b - a)
                if own != split:
                    yield from close(odd == 0)
                    split, odd, number, opened = own, parity, before - 1, False
                quotes = pc.count_substring(lines, quote).to_numpy().astype(np.int64)
                upto = odd + np.cumsum(quotes)
                starts = np.flatnonzero((upto - quotes) % 2 == 0)
                odd = int(upto[-1] % 2)
                if not len(starts):
                    held.append(lines)
                    continue
                if starts[0]:
                    held.append(lines.slice(0, starts[0]))
                yield from close(True)
                if not cut and len(starts) > 1:
                    offsets = pa.array(starts - starts[0], pa.int32())
                    listed = pa.ListArray.from_arrays(offsets, lines.slice(starts[0], starts[-1] - starts[0]))
                    yield emit(number + 1 + np.arange(len(starts) - 1), pc.binary_join(listed, "\n"))
                number, opened = number + len(starts), True
                held.append(lines.slice(starts[-1]))
        yield from close(odd == 0)

    return run


# A task for each file, from its beginning.
ONE_FILE = {"spark.sql.files.maxPartitionBytes": str(1 << 50), "spark.sql.files.openCostInBytes": str(1 << 50)}
FILES_TOGETHER = 100


def first_line(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line): the first line of one file. The limit ends the task, so the rest of the file isn't read."""
    return _lines(spark, path, None).select("file_name", "line").limit(1)


def first_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_name, line): the first line of each file, whatever its size; the driver holds the names."""
    found = [r["path"] for r in _files(spark, path, glob).select("path").collect()]
    heads = spark.createDataFrame([], "file_name string, line string")
    with settings(spark, ONE_FILE):
        for at in range(0, len(found), FILES_TOGETHER):
            some = [first_line(spark, p) for p in found[at : at + FILES_TOGETHER]]
            heads = heads.unionByName(materialise(reduce(DataFrame.unionByName, some), "first-lines"))
    return heads.select("file_name", _bare(F.col("line"), F.lit(True)).alias("line"))


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def file_list(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_name, size, modified) of the files; their content isn't read."""
    name = F.element_at(F.split("path", "/"), -1)
    return _files(spark, path, glob).select(name.alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
