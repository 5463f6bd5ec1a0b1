"""Quality rules with cross-document line frequency.

Per text: word, symbol and repetition measures and the base rules on them. Per host: lines are normalised and hashed, the distinct texts that hold a
line are counted, and a line above the limits is removed everywhere but from the document with the smallest id that holds it. A document
that keeps too little is rejected. Exact copies of a text count as one document of the host, so a copied page doesn't turn
its own lines into boilerplate.

Lines travel as 64-bit hashes. Copies of a text are one row before lines are exploded, counts are pre-aggregated, and what is known of a text goes back to
its rows by its 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.llm.common import col, cols, fresh, short_batches
from caderneta.session import materialise

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
# A line is boilerplate of a host above both: texts that hold it, and their share in the host's texts.
MAX_TEXTS = 20
MAX_SHARE = 0.05
# Least share of its words that a document must keep.
MIN_KEPT_SHARE = 0.5
SEED = 42

_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n, kinds = len(ids), len(known)
    if n <= window or kinds == n:
        return 0
    keys, kept = ids[: n - window + 1], kinds
    for i in range(1, window):
        if kept * kinds >= 1 << 62:  # number the keys anew, so that they stay exact
            _, keys = np.unique(keys, return_inverse=True)
            kept = n
        keys = keys * kinds + ids[i : n - window + 1 + i]
        kept *= kinds
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    found = np.concatenate([[0], np.cumsum(counts[at] > 1)])
    place = np.arange(n)
    last = len(found) - 1
    return int((found[np.minimum(place + 1, last)] > found[np.clip(place - window + 1, 0, last)]).sum())


def normal_lines(text: str) -> list[bytes]:
    """Lines with A-Z in lower case, digits as zeros and blanks as one space; without words they are empty."""
    return [b" ".join(line.split()) for line in text.encode().translate(_NORMAL).split(b"\n")]


def line_hash(line: bytes) -> int:
    h = xxhash.xxh64_intdigest(line, SEED)
    return h - (1 << 64) if h >> 63 else h


def measures(text: str) -> tuple[int, int, int, int, int]:
    """Values of ``MEASURES`` for a whole text."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, offsets, hashes, words = [], [0], [], []
        for value in batch.column(3):
            text = value.as_py() or ""
            rows.append(measures(text))
            of_text: dict[int, int] = {}
            for line in normal_lines(text):
                if line:
                    h = line_hash(line)
                    of_text[h] = of_text.get(h, 0) + line.count(b" ") + 1
            hashes += of_text.keys()
            words += of_text.values()
            offsets.append(len(hashes))
        lines = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.int64())], ["h", "words"])
        numbers = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(MEASURES))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *numbers, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines)],
            ["doc_id", "host", "key", *MEASURES, "lines"],
        )


def host_key(host: str, text: str) -> tuple[Column, Column]:
    """Host (null: empty) and hash of the text (null: empty)."""
    return F.coalesce(col(host).cast("string"), F.lit("")), F.unhex(F.md5(F.coalesce(col(text), F.lit("")).cast("binary")))


def measured(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Stored measures and line hashes of every row."""
    short_batches(docs.sparkSession)
    name, key = host_key(host, text)
    narrow = docs.select(col(doc_id).cast("long").alias("doc_id"), name.alias("host"), key.alias("key"), col(text).alias("text"))
    schema = ", ".join(
        ["doc_id long", "host string", "key binary", *[f"{m} long" for m in MEASURES], "lines array<struct<h: long, words: long>>"]
    )
    return materialise(narrow.mapInArrow(_measured, schema), "quality")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def boilerplate(base: DataFrame, max_texts: int = MAX_TEXTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, key, removed, cut) for each text that loses lines: the words and the hashes of these lines."""
    texts = base.groupBy("host", "key").agg(F.min("doc_id").alias("first"), F.first("lines").alias("lines"))
    texts = materialise(texts, "quality-texts")
    lines = texts.select("host", "key", "first", F.inline("lines"))
    sizes = texts.groupBy("host").agg(F.count("*").alias("texts"))
    heavy = (
        lines.groupBy("host", "h").agg(F.count("*").alias("holders"), F.min("first").alias("owner"))
        .filter(F.col("holders") > max_texts)
        .join(sizes, "host")
        .filter(F.col("holders") > max_share * F.col("texts"))
        .select("host", "h", "owner")
    )
    heavy = materialise(heavy, "quality-heavy")
    lost = lines.join(heavy, ["host", "h"]).filter(~F.col("first").eqNullSafe(F.col("owner")))
    return lost.groupBy("host", "key").agg(F.sum("words").alias("removed"), F.collect_list("h").alias("cut"))


def judged(base: DataFrame, lost: DataFrame, min_kept_share: float = MIN_KEPT_SHARE) -> DataFrame:
    """``base`` with removed, cut, base_failed and kept."""
    left = F.col("n_words") - F.col("removed")
    return (
        base.drop("lines")
        .join(lost, ["host", "key"], "left")
        .withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_kept_share * F.col("n_words")))
    )


def assess(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, measures, n_removed_words, base_failed, kept) for every row of ``docs``.

    A null text counts as empty and fails for want of words; a null host is a host of its own. Rows with equal host and text get
    equal verdicts. Of a line above the limits, the text with the smallest doc_id keeps it; without any doc_id no text does.
    """
    base = measured(docs, doc_id, host, text)
    return judged(base, boilerplate(base)).select(
        "doc_id", *MEASURES, F.col("removed").alias("n_removed_words"), "base_failed", "kept"
    )


def clean(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are kept, their texts without the lines that are removed; other columns stay as they are."""
    base = measured(docs, doc_id, host, text)
    verdicts = judged(base, materialise(boilerplate(base), "quality-lost"))
    changed = verdicts.filter("not kept or cut is not null").groupBy("host", "key").agg(
        F.first("kept").alias("kept"), F.first("cut").alias("cut")
    )
    host_name, key_name, kept, cut = fresh(docs, "host_of", "key_of", "kept_of", "cut_of")
    changed = changed.select(*[F.col(a).alias(b) for a, b in zip(("host", "key", "kept", "cut"), (host_name, key_name, kept, cut), strict=True)])
    name, key = host_key(host, text)

    @F.pandas_udf("string")
    def without(texts, cuts):
        def one(t, c):
            if t is None or c is None:
                return None
            gone = set(c)
            return "\n".join(x for x, n in zip(t.split("\n"), normal_lines(t), strict=True) if not n or line_hash(n) not in gone)

        return texts.combine(cuts, one)

    marked = docs.withColumns({host_name: name, key_name: key}).join(changed, [host_name, key_name], "left")
    stay = marked.filter(F.coalesce(col(kept), F.lit(True)))
    shorter = without(F.when(col(cut).isNotNull(), col(text)), col(cut))
    return stay.withColumn(text, F.coalesce(shorter, col(text))).select(*cols(docs.columns))
