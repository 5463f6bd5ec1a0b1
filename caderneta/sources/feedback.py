"""User corrections: daily files, their gate, the ledger of consumed files, and collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caderneta import schemas
from caderneta.functions.numbers import money
from caderneta.operators import quality
from caderneta.operators.ordered import null_safe_join
from caderneta.session import materialise
from caderneta.sources import records

GLOB = "feedback_*.csv"
HEADER = ",".join(schemas.FEEDBACK_COLUMNS)
LEDGER = "file_name string, status string, ledgered_at timestamp"


def file_records(spark: SparkSession, folder: str, glob: str = GLOB) -> DataFrame:
    """(file_name, record_no, record) of every daily file. Spark's readers leave out files of no bytes, so these stay pending for nobody."""
    return records.read_records(spark, folder, glob)


def gate(found: DataFrame) -> DataFrame:
    """(file_name, status, rows): ``ok``, ``empty`` or ``wrong columns``.

    The first record must be the expected columns in order.
    """
    filled = F.trim("record") != ""
    per = found.groupBy("file_name").agg(
        F.max(F.when(F.col("record_no") == 0, F.col("record"))).alias("head"),
        F.count_if(filled & (F.col("record_no") > 0)).alias("rows"),
    )
    status = F.when(F.col("rows") == 0, "empty").when(~is_header(F.col("head")), "wrong columns").otherwise("ok")
    return per.select("file_name", status.alias("status"), "rows")


def is_header(record: Column) -> Column:
    return F.replace(F.trim(record), F.lit('"'), F.lit("")) == HEADER


def rows_of(found: DataFrame, good: DataFrame) -> DataFrame:
    """Correction rows of the accepted files with file name and row number; quotes inside a field are doubled."""
    body = found.filter((F.col("record_no") > 0) & (F.trim("record") != "")).join(good.select("file_name"), "file_name", "left_semi")
    parsed = F.from_csv("record", F.lit(schemas.all_strings(schemas.FEEDBACK_COLUMNS)), {"escape": '"', "multiLine": "true"})
    return body.select("file_name", F.col("record_no").alias("row_no"), parsed.alias("r")).select("file_name", "row_no", "r.*")


def unique_rows(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per id the last row of the first file (by name) that has it. ``files(file_name)`` may name the files, if that is known.

    Only ids and places, as one number each, are shuffled; most ids come once, and the rows themselves meet the places of the others where they are read.
    """
    names = (rows if files is None else files).select("file_name").distinct()
    numbered = names.select("file_name", F.row_number().over(W.orderBy("file_name")).cast("bigint").alias("__file"))  # a row for each file
    placed = rows.join(F.broadcast(numbered), "file_name")
    place = F.shiftleft("__file", 40) - F.col("row_no")
    places = placed.groupBy("transactionId").agg(F.min(place).alias("__first"), F.count("*").alias("__n"))
    repeated = materialise(places.filter("__n > 1").select("transactionId", "__first"), "repeated")
    wins = F.col("__first").isNull() | (F.col("__first") == place)
    return null_safe_join(placed, repeated, ["transactionId"], "left").filter(wins).select(*rows.columns)


def collect(spark: SparkSession, folder: str) -> DataFrame:
    """All corrections of a folder."""
    found = file_records(spark, folder)
    files = materialise(gate(found).filter("status = 'ok'"), "gated")
    return unique_rows(rows_of(found, files), files)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], LEDGER)
        raise


def append_ledger(files: DataFrame, path: str) -> None:
    """Call after the rows of these files are safely written."""
    files.select("file_name", "status", F.current_timestamp().alias("ledgered_at")).write.mode("append").parquet(path)


def clear_ledger(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(path)


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    return files.join(ledger.select("file_name").distinct(), "file_name", "left_anti")


def collect_new(
    spark: SparkSession, folder: str, ledger_path: str, done: DataFrame | None = None, glob: str = GLOB
) -> tuple[DataFrame, DataFrame]:
    """(rows, files) of the files not consumed yet, by the ledger and the file names ``done``. ``files`` lists refused ones too.

    Only these files are opened; the driver holds their names.
    """
    ledger = read_ledger(spark, ledger_path).select("file_name")
    fresh = new_files(records.file_list(spark, folder, glob), ledger if done is None else ledger.unionByName(done.select("file_name")))
    found = records.read_records(spark, folder, glob, names=[r["file_name"] for r in fresh.select("file_name").distinct().collect()])
    files = materialise(gate(found), "gated")
    good = files.filter("status = 'ok'")
    return unique_rows(rows_of(found, good), good), files


def status(spark: SparkSession, folder: str, ledger_path: str, glob: str = GLOB) -> DataFrame:
    """One row: files found, consumed and pending."""
    found = records.file_list(spark, folder, glob).select("file_name")
    done = read_ledger(spark, ledger_path).select("file_name").distinct().withColumn("done", F.lit(1))
    return found.join(done, "file_name", "left").agg(
        F.count("*").alias("found"), F.count("done").alias("processed"), (F.count("*") - F.count("done")).alias("pending")
    )


def file_info(spark: SparkSession, folder: str, glob: str = GLOB) -> DataFrame:
    """Size, time and header check per daily file; of a file's content only the beginning is read."""
    heads = records.first_lines(spark, folder, glob).select("file_name", is_header(F.col("line")).alias("has_header"))
    return records.file_list(spark, folder, glob).join(heads, "file_name", "left").select(
        "file_name", "size", "modified", F.coalesce("has_header", F.lit(False)).alias("has_header")
    )


def to_rows(items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Correction items -> rows in file columns and the columns ``keep``. The amount is per installment; one when not given."""
    count = F.coalesce("parcelas", F.lit(1))

    def text(name: str):
        return F.coalesce(F.col(name), F.lit(""))

    values = [
        text("description"), text("category"), (F.col("amount") * count).cast("string"), count.cast("string"),
        F.coalesce(F.col("numero_parcela").cast("string"), F.lit("")), F.col("amount").cast("string"), text("source"),
        text("comp"), text("date"), text("card"), text("transactionId"), text("modelVersion"), text("createdAt"), text("flux"),
    ]
    return items.select([v.alias(c) for v, c in zip(values, schemas.FEEDBACK_COLUMNS)] + [F.col(c) for c in keep])


def checked_items(items: DataFrame, now=None) -> DataFrame:
    """All items with the ``reason`` for which one is refused, else null; a missing ``createdAt`` becomes the given or current time."""
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss")
    return quality.with_reason(items.withColumn("createdAt", F.coalesce("createdAt", stamp)), quality.feedback_rules())


def check_items(items: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """(valid items, refused items with a reason), each read by itself; ``checked_items`` has both in one pass."""
    return quality.split(checked_items(items, now))


def parse_items(df: DataFrame, json: str) -> DataFrame:
    """Items of JSON bodies ``{"feedback": {...}}`` or ``{"feedback": [...]}``; unknown keys are ignored."""
    fields = schemas.FEEDBACK_ITEM.replace(" string", ":string").replace(" double", ":double").replace(" int", ":int")
    body = F.get_json_object(json, "$.feedback")
    listed = F.when(F.startswith(F.trim(body), F.lit("[")), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    return df.select(F.inline(F.from_json(listed, f"array<struct<{fields}>>")))


def save(items: DataFrame, folder: str, date=None) -> None:
    """Append valid items under their day; every call adds files, nothing is rewritten."""
    day = F.current_date() if date is None else F.lit(date).cast("date")
    to_rows(items).withColumn("ingest_date", day).write.mode("append").partitionBy("ingest_date").parquet(folder)


def amounts_as_money(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: money(F.col(f"`{c}`")) for c in ("valor total", "valor unitário")})
