"""Ordered computations per key that stay parallel when one key holds most rows.

A window over ``partitionBy(key)`` puts a whole key into one task. Here every key is cut
into chunks along its order (``chunk`` must grow with the order). Values are computed
inside each chunk, every chunk leaves one summary row, a window over the few summary
rows yields what each chunk receives from the ones before it, and the two are combined.
The big table is shuffled once, by (keys, chunk); summaries are pre-aggregated.

Null keys and null order values are values like others: nulls form a key, and sort first. Every row comes out once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caderneta.session import materialise

CHUNK = "__chunk"
PLACE = "__place"


@dataclass(frozen=True)
class Step:
    """One computed column. ``value`` is an expression over the input row."""

    name: str
    value: Column

    def local(self, w) -> Column:
        raise NotImplementedError

    def summary(self, order: Column) -> Column:
        raise NotImplementedError

    def carried(self, w, summary: Column) -> Column:
        raise NotImplementedError

    def combine(self, local: Column, carried: Column) -> Column:
        raise NotImplementedError


class RunningSum(Step):
    """Sum from the first row of the key up to this row."""

    def local(self, w):
        return F.sum(self.value).over(w.rowsBetween(W.unboundedPreceding, 0))

    def summary(self, order):
        return F.sum(self.value)

    def carried(self, w, summary):
        return F.sum(summary).over(w.rowsBetween(W.unboundedPreceding, -1))

    def combine(self, local, carried):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))


class MaxBefore(Step):
    """Largest value of all earlier rows."""

    def local(self, w):
        return F.max(self.value).over(w.rowsBetween(W.unboundedPreceding, -1))

    def summary(self, order):
        return F.max(self.value)

    def carried(self, w, summary):
        return F.max(summary).over(w.rowsBetween(W.unboundedPreceding, -1))

    def combine(self, local, carried):
        return F.greatest(local, carried)


class LastKnown(Step):
    """Latest non-null value up to this row (forward fill)."""

    def local(self, w):
        return F.last(self.value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))

    def summary(self, order):
        return F.max_by(self.value, F.when(self.value.isNotNull(), order))

    def carried(self, w, summary):
        return F.last(summary, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))

    def combine(self, local, carried):
        return F.coalesce(local, carried)


class LastKnownBefore(LastKnown):
    """Latest non-null value of the earlier rows only."""

    def local(self, w):
        return F.last(self.value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))


class FirstKnown(Step):
    """First non-null value of the whole key, known on every row."""

    def local(self, w):
        return F.lit(None)

    def summary(self, order):
        return F.min_by(self.value, F.when(self.value.isNotNull(), order))

    def carried(self, w, summary):
        return F.first(summary, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))

    def combine(self, local, carried):
        return carried


class Total(Step):
    """Sum over the whole key, known on every row."""

    def local(self, w):
        return F.lit(None)

    def summary(self, order):
        return F.sum(self.value)

    def carried(self, w, summary):
        return F.sum(summary).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))

    def combine(self, local, carried):
        return carried


class Previous(Step):
    """Value of the row before; null on the first row."""

    def local(self, w):
        return F.lag(F.struct(self.value.alias("v"))).over(w)

    def summary(self, order):
        return F.max_by(F.struct(self.value.alias("v")), order)

    def carried(self, w, summary):
        return F.lag(summary).over(w)

    def combine(self, local, carried):
        return F.coalesce(local, carried)["v"]


class Next(Step):
    """Value of the row after; null on the last row."""

    def local(self, w):
        return F.lead(F.struct(self.value.alias("v"))).over(w)

    def summary(self, order):
        return F.min_by(F.struct(self.value.alias("v")), order)

    def carried(self, w, summary):
        return F.lead(summary).over(w)

    def combine(self, local, carried):
        return F.coalesce(local, carried)["v"]


def row_number(name: str = "rn") -> RunningSum:
    return RunningSum(name, F.lit(1).cast("bigint"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on key columns of equal names, null keys being equal to each other. The keys of the left side stay."""
    theirs = {c: f"__r_{c}" for c in keys}
    same = [F.col(c).eqNullSafe(F.col(r)) for c, r in theirs.items()]
    return left.join(right.withColumnsRenamed(theirs), reduce(lambda a, b: a & b, same), how).drop(*theirs.values())


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, steps: Sequence[Step]
) -> DataFrame:
    """Add one column per step. ``order`` must be a total order inside a key."""
    keys, order = list(keys), list(order)
    # Keys and chunk as one value: null keys are equal, and the join takes the rows as the window has dealt them.
    cut = df.withColumn(CHUNK, chunk).withColumn(PLACE, F.struct(*keys, CHUNK))
    place = F.struct(*[F.col(c) for c in order])
    inside = W.partitionBy(PLACE).orderBy(*order)
    across = W.partitionBy(*[F.col(PLACE)[c] for c in keys]).orderBy(F.col(PLACE)[CHUNK])
    local_names = {s.name: f"__l_{s.name}" for s in steps}
    carry_names = {s.name: f"__c_{s.name}" for s in steps}

    local = cut.withColumns({local_names[s.name]: s.local(inside) for s in steps})
    summaries = cut.groupBy(PLACE).agg(*[s.summary(place).alias(carry_names[s.name]) for s in steps])
    carried = summaries.select(PLACE, *[s.carried(across, F.col(carry_names[s.name])).alias(carry_names[s.name]) for s in steps])
    joined = local.join(carried.hint("merge"), PLACE)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[s.combine(F.col(local_names[s.name]), F.col(carry_names[s.name])).alias(s.name) for s in steps],
    )


# Sampled rows that a chunk spans on average, chunks for each shuffle partition, and the fewest rows worth a chunk of their own.
SAMPLES_PER_CHUNK = 16
CHUNKS_PER_PARTITION = 4
BOUNDS_PER_NODE = 32
LEAST_ROWS = 4096


def even_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None, most: int | None = None, name: str = "chunk"
) -> DataFrame:
    """Add a chunk number that grows with ``order`` inside a key; chunks hold about ``rows`` rows each, whatever the values are.

    Bounds are quantiles of a sample by hash: every 16th sampled place of a key. ``rows`` follows from the table's size and the shuffle partitions by
    default, ``most`` at most. A row finds its chunk on the way down a tree of bounds with ``BOUNDS_PER_NODE`` to a node, so it never meets all bounds
    of its key; the levels hold one place for each chunk together, and are broadcast. Keys that are
    smaller have one chunk, 0. A place is the whole of ``order``, so rows piled up at one value are told apart by the columns
    behind it. ``df`` is read three times.
    """
    keys, order = list(keys), list(order)
    if rows is None:
        rows = rows_per_chunk(df)
        rows = min(rows, most) if most else rows
    place = F.struct(*[F.col(c) for c in order])
    rate = max(1, rows // SAMPLES_PER_CHUNK)
    every = max(1, rows // rate)
    sampled = df.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(rate)) == 0).select(*keys, place.alias("__bound"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("__bound")) - 1
    bounds = sampled.withColumn("__at", number).filter((F.col("__at") % every == 0) & (F.col("__at") > 0))
    bounds = materialise(bounds.withColumn("__at", F.floor(F.col("__at") / every)), "chunk-bounds")
    most_bounds = bounds.agg(F.max("__at")).first()[0] or 0
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((BOUNDS_PER_NODE - 1).bit_length()))])
    found = F.aggregate(
        F.filter(steps, lambda step: step <= F.size("__bounds")),
        F.lit(0),
        lambda acc, step: F.when(
            (acc + step <= F.size("__bounds")) & (F.get(F.col("__bounds"), acc + step - 1) <= place), acc + step
        ).otherwise(acc),
    )
    span = 1
    while span * BOUNDS_PER_NODE <= most_bounds:
        span *= BOUNDS_PER_NODE
    out = df.withColumn("__node", F.lit(0).cast("bigint"))
    while span and most_bounds:
        # Bounds of this level between two of the level above.
        level = bounds.filter((F.col("__at") % span == 0) & (F.col("__at") % (span * BOUNDS_PER_NODE) != 0)).groupBy(
            *keys, F.floor(F.col("__at") / (span * BOUNDS_PER_NODE)).alias("__node")
        ).agg(F.sort_array(F.collect_list("__bound")).alias("__bounds"))
        inside = F.when(F.col("__bounds").isNull(), 0).otherwise(found)
        joined = null_safe_join(out, F.broadcast(level), [*keys, "__node"], "left")
        out = joined.withColumn("__node", F.col("__node") * BOUNDS_PER_NODE + inside).drop("__bounds")
        span //= BOUNDS_PER_NODE
    return out.withColumnRenamed("__node", name)


def rows_per_chunk(df: DataFrame) -> int:
    """Rows of a chunk that give every shuffle partition a few chunks; counts the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(LEAST_ROWS, df.count() // (CHUNKS_PER_PARTITION * parts))


def hash_digits(df: DataFrame) -> int:
    """Leading hexadecimal digits of a hash that give every shuffle partition a few chunks; counts the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks, digits = min(df.count() / LEAST_ROWS, CHUNKS_PER_PARTITION * parts), 0
    while 16**digits < chunks:
        digits += 1
    return digits


def hash_chunk(*columns: Column, digits: int) -> tuple[Column, Column]:
    """(position, chunk) for a reproducible random order: an md5 and its leading digits."""
    position = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return position, F.substring(position, 1, digits)


def distinct_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key and value with its row count ``n``: what order statistics need."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))
