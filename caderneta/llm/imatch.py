"""I-Match fingerprints with randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band of shares, that is, whose inverse document frequency lies in a band. Frequencies
and shares are those of distinct texts, so copies of a text, however many, don't lift its terms out of the band. For each of
several random subsets of the lexicon, the distinct terms of a text that lie in the subset are sorted and hashed.
Subsets come in levels of halving size, each inside the one above, so that short and long texts both find levels where a subset holds about one of their
terms. Two texts are alike in the share of subsets whose hashes agree, over the levels where subsets are small enough for both.

A document has at most a bounded number of terms at a share of ``least_share`` or more: the lexicon has no more entries than the mean
number of distinct terms of a document divided by ``least_share``, whatever the size of the corpus. That bound is
checked before the lexicon is sent to the executors.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.llm.common import col, partitions, short_batches
from caderneta.session import materialise

LEAST_SHARE, MOST_SHARE = 0.002, 0.1
LEVELS, SUBSETS = 11, 12
# Hex digits of the exact part and of each hash; a hash of zeros says that the text has no term in the subset.
EXACT_DIGITS, HASH_DIGITS = 16, 8
# A level counts if at most this share of its subsets holds a term of the text.
MOST_FILLED = 0.75
# Terms that a task counts before it hands them on.
COUNTED_TERMS = 200_000
# Repeated texts whose hashes and numbers of copies are sent to the executors, some hundred bytes each.
MOST_SENT = 1_000_000

_TERM = re.compile(r"\w+")
_STEP, _MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def terms(text: str) -> set[str]:
    """Distinct lower-case words."""
    return set(_TERM.findall(text.lower()))


def with_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, copies) for every row, null as the empty text: how many rows hold an equal text.

    Texts are told apart by 128 bits of their SHA-256, and only these are shuffled. Those that occur again are sent to the executors up to a
    bounded number; above it Spark decides on the join.
    """
    key = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    keyed = docs.select(F.coalesce(col(text), F.lit("")).alias("text")).withColumn("key", key)
    again = materialise(keyed.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1"), "imatch-repeated")
    if again.count() <= MOST_SENT:
        again = F.broadcast(again)
    return keyed.join(again, "key", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))


def lexicon(docs: DataFrame, text: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> list[str]:
    """Sorted terms that a share of the distinct texts inside the band holds, counted over all rows and whole texts."""
    short_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        rows = distinct = 0

        def hand_on() -> pa.RecordBatch:
            # The empty term counts texts, a blank one the distinct terms of all of them; neither is a word.
            names, n = [*found, "", " "], [*found.values(), rows, distinct]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.float64())], ["term", "n"])

        for batch in batches:
            for value, copies in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = terms(value.as_py())
                # The copies of a text have a share each, which sum to one text.
                if copies == 1:
                    found.update(own)
                else:
                    for term in own:
                        found[term] += 1 / copies
                rows += 1 / copies
                distinct += len(own) / copies
            if len(found) > COUNTED_TERMS:
                yield hand_on()
                found.clear()
                rows = distinct = 0
        yield hand_on()

    shares = with_copies(docs, text).mapInArrow(count, "term string, n double").groupBy("term").agg(F.sum("n").alias("n"))
    # Every count is whole; sums of shares miss it by far less than a half.
    counted = shares.select("term", F.round("n").cast("long").alias("n")).persist()
    try:
        totals = {r["term"]: r["n"] for r in counted.filter("term in ('', ' ')").collect()}
        rows, distinct = totals.get("", 0), totals.get(" ", 0)
        if not rows:
            return []
        inside = counted.filter("term not in ('', ' ')").filter(F.col("n").between(least_share * rows, most_share * rows))
        words = [r["term"] for r in inside.select("term").collect()]
    finally:
        counted.unpersist()
    if len(words) > distinct / rows / least_share + 1:
        raise RuntimeError("the lexicon exceeds its bound")
    return sorted(words)


class Fingerprints:
    """Fingerprints of texts under a sorted lexicon."""

    def __init__(self, words: list[str]):
        self._place = {w: i for i, w in enumerate(words)}
        self._hash = np.array([xxhash.xxh64_intdigest(w.encode(), 1) for w in words], np.uint64)
        mixed = self._hash[:, None] + _STEP * np.arange(1, SUBSETS + 1, dtype=np.uint64)[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(27))) * _SPREAD
        # A term is in the subsets of its first levels, as many as its mixed hash ends with zero bits.
        last = mixed & (~mixed + np.uint64(1))
        self._level = np.minimum(np.bitwise_count(last - np.uint64(1)), LEVELS).astype(np.uint8)

    def of(self, text: str) -> str:
        exact = hashlib.sha256(text.encode()).hexdigest()[:EXACT_DIGITS]
        place = self._place
        # Terms in the order of the lexicon, which is sorted; each subset's list of them is hashed.
        found = np.array(sorted(place[t] for t in terms(text) if t in place), np.int64)
        level, hashes = self._level[found].T, self._hash[found]
        out = np.zeros((LEVELS, SUBSETS), np.uint32)
        for i in range(LEVELS):
            subset, term = np.nonzero(level > i)
            if not len(term):
                break
            listed, start = hashes[term].tobytes(), 0
            for j, end in enumerate((8 * np.bincount(subset, minlength=SUBSETS).cumsum()).tolist()):
                if end > start:
                    out[i, j] = max(1, xxhash.xxh32_intdigest(listed[start:end]))
                start = end
        return exact + out.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else the share of agreeing subset hashes in the levels that suit both; 0 without any."""
    if a == b:
        return 1.0
    grids = [
        np.frombuffer(f[EXACT_DIGITS:].encode(), f"S{HASH_DIGITS}").reshape(LEVELS, SUBSETS) for f in (a, b)
    ]
    held = [g != b"0" * HASH_DIGITS for g in grids]
    filled = [h.mean(axis=1) for h in held]
    suits = (filled[0] <= MOST_FILLED) & (filled[1] <= MOST_FILLED)
    suits[-1] = True
    used = (held[0] | held[1])[suits]
    same = (grids[0] == grids[1])[suits]
    return float((same & used).sum() / used.sum()) if used.any() else 0.0


def _bucket_of(docs: DataFrame, doc_id: str, parts: int) -> Column:
    """Range of the doc_id, from quantiles over all rows; rows without doc_id come last."""
    cuts = [i / parts for i in range(1, parts)]
    bounds = np.array(docs.approxQuantile(doc_id, cuts, 1 / (4 * parts)) if cuts else [], np.float64)

    @F.pandas_udf("int")
    def bucket(ids):
        return ids.map(lambda v: int(np.searchsorted(bounds, v, "right")) if v == v and v is not None else parts - 1).astype("int32")

    return bucket(F.col(doc_id).cast("double"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, copy, doc_id, text), range partitioned and sorted, with a copy of the row that follows each range at its end.

    Order is by doc_id, rows without it last, ties by a hash of the text. Copies have ``copy`` 1. After the last row
    comes the first. Texts are shuffled once; the driver sees one id for each range.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text")).withColumn(
        "place", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    )
    ranged = rows.withColumn("part", _bucket_of(rows, "doc_id", parts))
    heads = sorted(ranged.groupBy("part").agg(F.min("place").alias("place")).collect(), key=lambda r: r["part"])
    follows = [(r["part"], *heads[(i + 1) % len(heads)]["place"]) for i, r in enumerate(heads)]
    begin = spark.createDataFrame(follows, "part int, last boolean, id long, h long")
    copies = rows.withColumnRenamed("place", "own").join(
        F.broadcast(begin.select("part", F.struct("last", "id", "h").alias("place"))), F.col("own").eqNullSafe(F.col("place"))
    )
    copies = copies.groupBy("part").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("place").alias("place"))
    both = ranged.select("part", F.lit(0).alias("copy"), "place", "doc_id", "text").unionByName(
        copies.select("part", F.lit(1).alias("copy"), "place", "doc_id", "text")
    )
    return both.repartitionById(parts, "part").sortWithinPartitions("part", "copy", "place").select("part", "copy", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    A null text counts as empty. A single row is its own next one. Texts without lexicon terms are alike only if equal.
    """
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(words.value)
        held = None
        for batch in batches:
            out: list[tuple] = []
            for part, copy, key, value in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = prints.of(value)
                if held is not None and held[0] == part:
                    _, old_key, old, old_print = held
                    new = edited(old, value)
                    changed = prints.of(new)
                    out.append((
                        old_key, len(old), hashlib.sha256(new.encode()).hexdigest(), old_print, changed,
                        likeness(old_print, changed), likeness(old_print, own),
                    ))
                held = None if copy else (part, key, value, own)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    result = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, doc_id, text).mapInArrow(run, result)
