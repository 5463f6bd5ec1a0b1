"""Geometric grouping of ordered values: gaps, clusters, anchored rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.operators.automaton import FAN_OUT
from caderneta.operators.ordered import Next, Previous, RunningSum, distinct_values, even_chunks, null_safe_join, scan
from caderneta.session import materialise

# Values of a key that one row holds at most, about.
CHUNK_VALUES = 65_536


def segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
    start: str, end: str, gap: float, name: str = "segment",
) -> DataFrame:
    """Number the runs of rows whose ``start`` lies at most ``gap`` after the previous row's ``end``."""
    with_previous = scan(df, keys, order, chunk, [Previous("__end", F.col(end))])
    fresh = F.when(F.col(start) - F.col("__end") > gap, 1).otherwise(0)
    return scan(with_previous, keys, order, chunk, [RunningSum(name, fresh.cast("bigint"))]).drop("__end")


def merge_trailing(
    df: DataFrame, keys: Sequence[str], order: str, chunk: Column, text: str, is_tail: Column
) -> DataFrame:
    """Append each tail row's text to the row before it (a value printed on a line of its own).

    A tail at the very start of a key has nothing to join and stands alone.
    """
    flagged = df.withColumn("__tail", is_tail)
    numbered = scan(
        flagged, keys, [order], chunk, [RunningSum("__grp", F.when(F.col("__tail"), 0).otherwise(1).cast("bigint"))]
    )
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return (
        numbered.groupBy(*keys, "__grp")
        .agg(F.min(order).alias(order), parts.alias("__parts"))
        .select(*keys, order, F.array_join(F.col(f"__parts.{text}"), " ").alias(text))
    )


def largest_gap(
    df: DataFrame, keys: Sequence[str], value: str, chunk: Column, minimum: float
) -> DataFrame:
    """Middle of the widest gap between neighbouring values, null when it is below ``minimum``.

    Of equally wide gaps the first counts. Equal values cannot open a gap, so each value is seen once.
    """
    points = distinct_values(df, keys, value)
    gaps = scan(points, keys, [value], chunk, [Next("__next", F.col(value))]).filter(F.col("__next").isNotNull())
    width = F.col("__next") - F.col(value)
    middle = (F.col("__next") + F.col(value)) / 2
    best = gaps.groupBy(*keys).agg(
        F.max(width).alias("gap"), F.max_by(middle, F.struct(width, -F.col(value))).alias("split")
    )
    return best.select(*keys, "gap", F.when(F.col("gap") >= minimum, F.col("split")).alias("split"))


def two_means_split(df: DataFrame, keys: Sequence[str], value: str, chunk: Column) -> DataFrame:
    """Exact one-dimensional two-cluster split: midpoint of the two means with the least squared error.

    In one dimension the best clusters are a prefix and a suffix of the sorted values, and the
    error of every cut follows from running sums. A key with one distinct value keeps that value.
    """
    points = distinct_values(df, keys, value)
    x, n = F.col(value), F.col("n")
    sums = scan(
        points, keys, [value], chunk,
        [RunningSum("__n", n), RunningSum("__s", n * x), Next("__next", x)],
    )
    totals = points.groupBy(*keys).agg(F.sum(n).alias("__tn"), F.sum(n * x).alias("__ts"), F.min(x).alias("__only"))
    cut = sums.join(totals, list(keys))
    left_mean = F.col("__s") / F.col("__n")
    right_mean = (F.col("__ts") - F.col("__s")) / (F.col("__tn") - F.col("__n"))
    # Least squared error = largest weighted sum of squared means.
    gain = F.col("__s") * left_mean + (F.col("__ts") - F.col("__s")) * right_mean
    best = cut.groupBy(*keys).agg(
        F.max_by((left_mean + right_mean) / 2, F.when(F.col("__next").isNotNull(), F.struct(gain, -x))).alias("split"),
        F.min("__only").alias("__only"),
    )
    return best.select(*keys, F.coalesce("split", "__only").alias("split"))


def _next_beyond(values: np.ndarray, anchors: np.ndarray, tolerance: float) -> np.ndarray:
    """For each anchor the first index of sorted ``values`` with ``value - anchor > tolerance``."""
    n = len(values)
    at = np.searchsorted(values, anchors + tolerance, side="right")
    # The sum is rounded, the difference decides.
    while True:
        back = (at > 0) & (values[np.maximum(at, 1) - 1] - anchors > tolerance)
        on = ~back & (at < n) & ~(values[np.minimum(at, n - 1)] - anchors > tolerance)
        if not (back.any() or on.any()):
            return at
        at = at - back + on


def _effect(values: np.ndarray, tolerance: float) -> tuple[list[float], list[float]]:
    """What a run of values does to the anchor in front of it: (enter, leave).

    The first ``enter`` that lies beyond the tolerance of the anchor in front gives the last anchor of the run; without one the anchor
    stays. Values with the same last anchor are one entry, the largest of them.
    """
    following = _next_beyond(values, values, tolerance)
    last = np.where(following < len(values), following, np.arange(len(values)))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    reach = min(int(following[0]), len(values) - 1) + 1
    ends = values[last[:reach]]
    keep = np.append(ends[1:] != ends[:-1], True)
    return values[:reach][keep].tolist(), ends[keep].tolist()


def _through(anchor: float | None, enter: Sequence[float], leave: Sequence[float], tolerance: float) -> float:
    """The anchor behind a run."""
    if anchor is None:
        return leave[0]
    at = int(_next_beyond(np.asarray(enter, dtype=float), np.array([anchor]), tolerance)[0])
    return leave[at] if at < len(enter) else anchor


def _effect_of(runs: Sequence[Mapping], tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Effect of neighbouring runs (first, enter, leave) as one run: from the last run to the first, all entries of a run at once."""
    enter, leave = np.empty(0), np.empty(0)
    for run in reversed(runs):
        ends = np.asarray(run["leave"], dtype=float)
        if len(enter):
            at = _next_beyond(enter, ends, tolerance)
            ends = np.where(at < len(enter), leave[np.minimum(at, len(enter) - 1)], ends)
        enter, leave = np.append(np.asarray(run["enter"], dtype=float), enter), np.append(ends, leave)
        # An anchor in front of the first value can't pass a value beyond the first one's tolerance.
        reach = int(_next_beyond(enter, np.array([run["first"]]), tolerance)[0]) + 1
        enter, leave = enter[:reach], leave[:reach]
        keep = np.append(leave[1:] != leave[:-1], True)
        enter, leave = enter[keep], leave[keep]
    return enter, leave


def _anchors(values: np.ndarray, before: float | None, tolerance: float) -> np.ndarray:
    """Anchor of each sorted value."""
    following = _next_beyond(values, values, tolerance)
    at = 0 if before is None else int(_next_beyond(values, np.array([before]), tolerance)[0])
    out = np.full(len(values), np.nan if before is None else before)
    while at < len(values):
        out[at : following[at]] = values[at]
        at = int(following[at])
    return out


EFFECT = "enter array<double>, leave array<double>"


def _before_chunks(effects: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, __chunk, __before): the anchor in front of each chunk, null for the first; up and down a tree of composed effects.

    ``effects`` has (keys, __chunk, first, enter, leave) of keys with several chunks.
    """

    def compose(runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_effect_of(r, tolerance) for r in runs], columns=["enter", "leave"])

    def descend(runs: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for run, anchor in zip(runs, before, strict=True):
            anchor, seen = None if pd.isna(anchor) else anchor, []
            for child in run:
                seen.append(anchor)
                anchor = _through(anchor, child["enter"], child["leave"], tolerance)
            out.append(seen)
        return pd.Series(out)

    compose_runs, anchors_before = F.pandas_udf(compose, EFFECT), F.pandas_udf(descend, "array<double>")
    effects = materialise(effects, "anchor-effects")
    span = effects.agg(F.max("__chunk")).first()[0] or 0
    levels = [effects.withColumnRenamed("__chunk", "__node")]
    while span or len(levels) == 1:
        span //= FAN_OUT
        children = F.sort_array(F.collect_list(F.struct("__node", "first", "enter", "leave")))
        runs = levels[-1].groupBy(*keys, F.floor(F.col("__node") / FAN_OUT).cast("bigint").alias("__parent")).agg(children.alias("__run"))
        whole = runs.withColumn("__effect", compose_runs("__run"))
        levels.append(materialise(
            whole.select(*keys, F.col("__parent").alias("__node"), F.col("__run")[0]["first"].alias("first"), "__effect.*", "__run"),
            "anchor-level",
        ))
    known = levels[-1].select(*keys, "__node", F.lit(None).cast("double").alias("__before"))
    for parents in reversed(levels[1:]):
        joined = null_safe_join(parents.select(*keys, "__node", "__run"), known, [*keys, "__node"])
        zipped = F.arrays_zip(F.col("__run.__node").alias("n"), anchors_before("__run", "__before").alias("a"))
        known = joined.select(*keys, F.explode(zipped).alias("z")).select(
            *keys, F.col("z.n").alias("__node"), F.col("z.a").alias("__before")
        )
    return known.withColumnRenamed("__node", "__chunk")


def anchored_groups(
    df: DataFrame, keys: Sequence[str], value: str, tolerance: float, name: str = "anchor", rows: int | None = None
) -> DataFrame:
    """Give each row the first value of its group; a new group starts when ``value - anchor > tolerance``.

    The anchors of a key form one chain. The distinct values of a key are cut into chunks of about ``rows`` values (``CHUNK_VALUES`` at most by
    default) at quantiles of the data. What a chunk does to the anchor in front of it is a monotone step function; such functions compose, so
    a tree with ``FAN_OUT`` children to a node gives every chunk its anchor in front, and all chunks are then chained in parallel.
    A function has one entry for each distinct outcome of the values within the tolerance of the chunk's first one. Values are finite
    numbers; equal values are seen once. Rows without a value belong to no group and get a null anchor; null keys form a key.
    """
    keys = list(keys)
    points = materialise(
        df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v is not null").distinct(), "anchor-values"
    )
    chunked = even_chunks(points, keys, ["__v"], rows, CHUNK_VALUES, "__chunk")
    chunks = materialise(chunked.groupBy(*keys, "__chunk").agg(F.sort_array(F.collect_list("__v")).alias("__vs")), "anchor-chunks")

    def effect(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_effect(np.asarray(v, dtype=float), tolerance) for v in values], columns=["enter", "leave"])

    def chain(values: pd.Series, before: pd.Series) -> pd.Series:
        pairs = zip(values, before, strict=True)
        return pd.Series([_anchors(np.asarray(v, dtype=float), None if pd.isna(b) else b, tolerance).tolist() for v, b in pairs])

    several = chunks.filter("__chunk > 0").select(*keys).distinct()
    first = F.col("__vs")[0].alias("first")
    cut = null_safe_join(chunks, several, keys, "left_semi").select(
        *keys, "__chunk", first, F.pandas_udf(effect, EFFECT)("__vs").alias("__e")
    ).select(*keys, "__chunk", "first", "__e.*")
    before = _before_chunks(cut, keys, tolerance)
    known = null_safe_join(chunks, before, [*keys, "__chunk"], "left")
    anchors = F.pandas_udf(chain, "array<double>")("__vs", "__before")
    per_value = known.select(*keys, F.explode(F.arrays_zip(F.col("__vs").alias("v"), anchors.alias("a"))).alias("__z")).select(
        *keys, F.col("__z.v").alias("__at"), F.col("__z.a").alias(name)
    )
    placed = df.withColumn("__at", F.col(value).cast("double"))
    return null_safe_join(placed, per_value, [*keys, "__at"], "left").drop("__at")
