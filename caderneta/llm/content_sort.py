"""Exact duplicates by sorting contents, with DataFrame operations only.

Texts are equal when they are identical without the white space ``[\\x20\\x09-\\x0D]``. Spark samples splitters and range-partitions the
normalised texts, an external sort inside each partition places equal texts next to each other, and each text is compared in full with its
neighbour. The sort key begins with the first ``BEGINNING`` characters and a 64-bit hash, so that a sampled splitter has a bounded size and
texts with a long common beginning still spread; equality is decided on whole texts alone.

A text whose copies hold more bytes than a partition should is cut into pieces by row number, so its copies lie in several partitions.
The best row of each piece carries the whole text into a second, small comparison. Such texts number at most ``PIECES`` for each
partition, by the definition of the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caderneta.llm.common import col, cols, fresh, partitions
from caderneta.session import materialise

WHITE = r"[\x20\x09-\x0D]+"
# Characters of a text that a splitter holds.
BEGINNING = 32
# A piece of a common text holds at most this part of a partition's share.
PIECES = 4
# What a row weighs beside its text, in bytes.
ROW_BYTES = 64


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _common(texts: DataFrame, total: int, parts: int) -> DataFrame:
    """(hash, pieces) of the texts whose copies outweigh a piece: at most ``parts * PIECES`` rows, as all weigh ``total`` at most."""
    weight = F.octet_length("norm") + F.lit(ROW_BYTES)
    piece = max(1, -(-total // (parts * PIECES)))
    weights = texts.groupBy("hash").agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    pieces = F.least(F.ceil(F.col("weight") / piece), F.col("n"))
    return weights.filter(F.col("weight") > piece).filter("n > 1").select("hash", pieces.alias("pieces"))


def mark(df: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(``key``, columns ``carry``, keep_id, group_size, kept, text_sha256), one row for each row of ``df``.

    Of equal texts the row with the most code points in its original text is kept, of those the one with the smallest ``key``, null
    keys last. Of repeated rows, equal in key and text, exactly one is kept. Null and empty texts and texts of white space
    alone are equal to each other. An empty table gives an empty result. Other columns of ``df`` may have any name; where ``key`` or a
    carried column has the name of a result column, the latter gets underscores behind it. ``df`` is read four times, so pass a stored one.
    """
    parts = partitions(df.sparkSession)
    norm = normalised(col(text))
    texts = df.select(
        F.struct(col(key).alias("key"), *[col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("row"),
        F.length(F.coalesce(col(text), F.lit(""))).alias("chars"), norm.alias("norm"),
    ).withColumn("hash", F.xxhash64("norm"))
    size = df.agg(F.sum(F.octet_length(col(text))), F.count("*")).first()
    total = (size[0] or 0) + ROW_BYTES * size[1]
    spread = texts.join(F.broadcast(_common(texts, total, parts)), "hash", "left").select(
        "row", "chars", "norm", "hash", F.substring("norm", 1, BEGINNING).alias("start"),
        F.coalesce("pieces", F.lit(1)).alias("pieces"),
        # Copies may agree in everything, so a piece follows from a row's place. No result depends on it.
        F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("pieces")), F.lit(0)).alias("piece"),
    )
    place = ["start", "hash", "piece"]
    best = [F.col("chars").desc(), F.col("row.key").asc_nulls_last()]
    sorted_texts = W.partitionBy(*place).orderBy("norm", *best)
    differs = ~F.col("norm").eqNullSafe(F.lag("norm").over(sorted_texts))
    runs = spread.repartitionByRange(parts, *place).withColumn("new", differs.cast("long")).withColumn(
        "run", F.sum("new").over(sorted_texts.rowsBetween(W.unboundedPreceding, 0))
    )
    run = W.partitionBy(*place, "run")
    order = run.orderBy(*best)
    found = runs.select(
        "row", "chars", "piece", "pieces", F.sha2("norm", 256).alias("sha"),
        F.row_number().over(order).alias("rank"),
        F.first("row.key").over(order).alias("keep"),
        F.count("*").over(run).alias("size"),
        F.when(F.col("pieces") > 1, F.col("norm")).alias("norm"),
    ).withColumn("norm", F.when(F.col("rank") == 1, F.col("norm")))
    return _joined_pieces(materialise(found, "content-sort"), key, carry)


def _joined_pieces(found: DataFrame, key: str, carry: Sequence[str]) -> DataFrame:
    """Results of texts in several pieces from the best row of each piece, compared in full; all others stand."""
    order = [F.col("chars").desc(), F.col("keep").asc_nulls_last(), F.col("piece")]
    heads = found.filter("rank = 1 AND pieces > 1").select("norm", "sha", "chars", "keep", "piece", "size")
    whole = W.partitionBy("sha", "norm")
    groups = heads.select(
        "sha", "piece", F.first("keep").over(whole.orderBy(*order)).alias("all_keep"),
        F.first("piece").over(whole.orderBy(*order)).alias("all_piece"), F.sum("size").over(whole).alias("all_size"),
    )
    # At most PIECES texts for each partition, in about as many pieces again: a bounded table of short rows.
    joined = found.drop("norm").join(F.broadcast(groups), ["sha", "piece"], "left")
    several = F.col("all_size").isNotNull()
    named = found.select(F.lit(0).alias(key), *[F.lit(0).alias(c) for c in carry])
    keep_id, group_size, kept, sha = fresh(named, "keep_id", "group_size", "kept", "text_sha256")
    return joined.select(
        F.col("row.key").alias(key),
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)],
        F.when(several, F.col("all_keep")).otherwise(F.col("keep")).alias(keep_id),
        F.coalesce("all_size", "size").alias(group_size),
        ((F.col("rank") == 1) & F.coalesce(F.col("piece") == F.col("all_piece"), F.lit(True))).alias(kept),
        F.col("sha").alias(sha),
    )


def distinct_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` that stay, with all their columns; cases as in ``mark``."""
    names = fresh(df, *(f"carried_{i}" for i in range(len(df.columns))))
    plain = df.toDF(*names)
    at = {c: n for c, n in zip(df.columns, names, strict=True)}
    marked = mark(plain, at[key], at[text], [n for c, n in at.items() if c != key])
    return marked.filter("kept").select(*cols(names)).toDF(*df.columns)
