"""Shards along a Hilbert curve over several metadata dimensions, with DataFrame operations only.

Every dimension is quantised to ``2 ** bits`` steps of about equal row counts. The curve index of the steps orders the rows, and the
order is cut into runs. Neighbours on the curve are neighbours in every dimension, so the files of a shard cover a small
box of the metadata and a reader prunes by any of the dimensions.

Positions in the order need no global sort: a cell of the curve is a chunk, cells with many rows are cut into more chunks by a hash,
rows are numbered inside their chunk, and a running count over the chunks (at most ``2 ** (bits * dimensions)`` plus
a few for each shuffle partition) is added.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.llm.common import col, cols, fresh, partitions
from caderneta.operators import once, ordered

BITS = 4
# Bytes of a text that a dimension looks at, after what all its values begin with.
PREFIX_BYTES = 7
# Chunks for each shuffle partition, for cells that hold many rows.
CHUNKS_PER_PARTITION = 4


def transitions(n: int) -> list[int]:
    """Next state and curve digit, ``state << n | digit``, for each state and each corner of an n-dimensional cell.

    A state is an entry corner and a direction. The curve inside a cell runs along the reflected Gray code, turned
    and mirrored so that it begins at the entry and leaves towards the next cell.
    """
    mask = (1 << n) - 1

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def rotate(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & mask

    def entry(i: int) -> int:
        return gray((i - 1) & ~1) if i else 0

    def turn(i: int) -> int:
        odd = i if i % 2 else i - 1
        return 0 if i == 0 else ((~odd & (odd + 1)).bit_length() - 1) % n

    rank = {gray(i): i for i in range(1 << n)}
    table = []
    for state in range(n << n):
        e, d = state & mask, state >> n
        for corner in range(1 << n):
            digit = rank[rotate(corner ^ e, -(d + 1))]
            next_e, next_d = e ^ rotate(entry(digit), d + 1), (d + turn(digit) + 1) % n
            table.append(((next_d << n) | next_e) << n | digit)
    return table


def curve_index(steps: list[Column], bits: int) -> Column:
    """Hilbert index of integer ``steps``, each below ``2 ** bits``."""
    n = len(steps)
    table = F.array(*[F.lit(x) for x in transitions(n)])
    index, state = F.lit(0).cast("long"), F.lit(0)
    for level in reversed(range(bits)):
        corner = reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.shiftleft(F.shiftright(s, level).bitwiseAND(F.lit(1)), j) for j, s in enumerate(steps)],
        )
        move = F.get(table, F.shiftleft(state, n).bitwiseOR(corner))
        index = F.shiftleft(index, n) + move.bitwiseAND(F.lit((1 << n) - 1))
        state = F.shiftright(move, n)
    return index


def _numbers(df: DataFrame, dimensions: Mapping[str, str]) -> dict[str, Column]:
    """Dimensions as numbers in the order of their values. A text counts by the bytes after the common beginning."""
    types = dict(df.dtypes)
    texts = {d: c for d, c in dimensions.items() if types[c] == "string"}
    ends = df.agg(F.lit(1), *[f(col(c)).alias(f"{n}{d}") for d, c in texts.items() for n, f in (("a", F.min), ("b", F.max))]).first()
    out = {d: col(c).cast("double") for d, c in dimensions.items()}
    for d, c in texts.items():
        low, high = (ends[n + d] or "" for n in "ab")
        same = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
        part = F.substring(F.encode(F.substring(col(c), same + 1, PREFIX_BYTES), "UTF-8"), 1, PREFIX_BYTES)
        out[d] = F.conv(F.rpad(F.hex(part), 2 * PREFIX_BYTES, "0"), 16, 10).cast("double")
    return out


def quantised(df: DataFrame, dimensions: Mapping[str, str], bits: int = BITS) -> tuple[DataFrame, list[str]]:
    """``df`` with a column of steps for every dimension, from quantiles over all rows; null values have step 0."""
    names = fresh(df, *(f"step_{d}" for d in dimensions))
    numbers = once.evaluate_once(df, dict(zip(names, _numbers(df, dimensions).values(), strict=True)))
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    bounds = numbers.agg(F.lit(1), *[F.percentile_approx(col(n), cuts).alias(n) for n in names]).first()
    steps = {
        n: F.coalesce(reduce(lambda a, b: a + b, [(col(n) > b).cast("int") for b in bounds[n] or []], F.lit(0)), F.lit(0))
        for n in names
    }
    return once.evaluate_once(numbers, steps), names


def assign(
    df: DataFrame, dimensions: Mapping[str, str], tie: list[str], shards: int, bits: int = BITS,
    shard: str = "shard", slot: str = "slot",
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (0, 1, ... inside the shard).

    ``dimensions`` maps names to columns. Row counts of shards differ by one at most. Rows of a cell are ordered by a hash of the
    columns ``tie``; rows that agree in all of them may stand in any order. Nulls are values like others. With fewer rows
    than shards, some shards are empty; an empty table stays empty. ``df`` is read four times, so pass a stored one.
    """
    cell, place, pieces, position = fresh(df, "cell", "place", "pieces", "position")
    stepped, steps = quantised(df, dimensions, bits)
    index = {cell: curve_index(cols(steps), bits), place: F.shiftrightunsigned(F.xxhash64(*cols(tie)), 1)}
    curve = once.evaluate_once(stepped, index).drop(*steps)
    total = df.count()
    wanted = max(1, total // (CHUNKS_PER_PARTITION * partitions(df.sparkSession)))
    # At most 2 ** (bits * dimensions) cells exist.
    cells = curve.groupBy(cell).agg(F.ceil(F.count("*") / wanted).alias(pieces))
    placed = curve.join(F.broadcast(cells), cell)
    piece = F.least((col(place) / float(1 << 63) * col(pieces)).cast("long"), col(pieces) - 1)
    numbered = ordered.scan(
        placed, [], [cell, place, *tie], F.shiftleft(col(cell), 32) + piece, [ordered.row_number(position)]
    )
    at, number = fresh(numbered, "at", "number")
    rows = max(total, 1)
    return (
        numbered.withColumn(at, col(position) - 1)
        .withColumn(number, F.expr(f"`{at}` * {shards} div {rows}"))
        .select(
            *cols(df.columns),
            col(number).cast("int").alias(shard),
            (col(at) - F.expr(f"(`{number}` * {rows} + {shards - 1}) div {shards}")).alias(slot),
        )
    )
