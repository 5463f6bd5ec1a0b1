"""SimHash near-duplicates with a hierarchical index in Gray order.

Fingerprints that differ in at most two of 64 bits are linked. An upper node of the index is a set of masked bits and
the pattern that its fingerprints share there. The 64 bits are divided into three masks: two linked fingerprints agree on at least
one of them, so each fingerprint goes to three upper nodes and every link lies inside a node. A node with many fingerprints is
divided again, its free bits into three further masks, which keeps every link for the same reason; so no task gets an unbounded group.

Inside a node the fingerprints are sorted by Gray rank, where neighbours differ in few bits. Runs of neighbours form inner
nodes, each with the bits on which its members agree. Pairs of nodes are followed downwards while the differences in agreed bits are two at
most; a pair above that is dropped with everything below it, and a pair whose members are already connected is skipped.

A node yields a spanning star for each group that it connects, not its links. Stars of all nodes are joined into components by
alternating large-star and small-star steps, whose number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.llm.common import col, partitions, short_batches
from caderneta.session import materialise

BITS = 64
DIFFERENCES = 2
SHINGLE_WORDS = 3
SEED = 42
# Fingerprints of an upper node above which it is divided.
NODE_LIMIT = 20_000
# Free bits at which a node isn't divided further: it can't hold more than 2 ** 16 distinct fingerprints.
LEAST_FREE_BITS = 16
# Children of an inner node, and node pairs that are looked at together.
FAN_OUT = 8
PAIRS_AT_ONCE = 1 << 16


def fingerprint(text: str) -> int:
    """64-bit fingerprint of a whole text; zero without words."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        hashes = [digest(joined, SEED)]
    else:
        first, last = (ends - lengths)[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist()
        hashes = [digest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)]
    counts = np.zeros(BITS, np.int64)
    values = np.array(hashes, "<u8")
    for i in range(0, len(values), 1 << 15):
        part = values[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(v.as_py() or "") for v in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp has the bits of the fingerprint. A null text counts as empty."""
    short_batches(docs.sparkSession)
    return docs.select(col(doc_id).cast("long"), col(text)).mapInArrow(_fingerprints, "doc_id long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the reflected Gray code, as a long whose signed order is that of the rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _divided(mask: int) -> list[int]:
    """``mask`` (signed) with a third of its free bits added, three times."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    parts = DIFFERENCES + 1
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [_signed((mask % (1 << BITS)) | sum(1 << b for b in free[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each group after a and b are linked pairwise."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def groups_of(
    values: np.ndarray, differences: int = DIFFERENCES, join: Callable = _joined, labels: np.ndarray | None = None
) -> np.ndarray:
    """For fingerprints (uint64, by Gray rank): the index of the first member of each one's linked group.

    ``join`` gets the labels and near pairs (a, b) and returns the new labels; it may leave pairs unlinked. ``labels`` are groups that
    are known before.
    """
    n = len(values)
    labels = np.arange(n) if labels is None else labels
    # From the leaves up: bits that all members have set, and bits that any has.
    levels = [(values, values)]
    while len(levels[-1][0]) > FAN_OUT:
        every, any_ = levels[-1]
        starts = np.arange(0, len(every), FAN_OUT)
        levels.append((np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(any_, starts)))
    top = len(levels) - 1
    first = np.triu_indices(len(levels[top][0]), 1 if top == 0 else 0)
    stack = [(top, *first)]
    child = np.arange(FAN_OUT)
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS_AT_ONCE:
            stack += [(level, i[PAIRS_AT_ONCE:], j[PAIRS_AT_ONCE:])]
            i, j = i[:PAIRS_AT_ONCE], j[:PAIRS_AT_ONCE]
        every, any_ = levels[level]
        # Bits that are set in all members of one node and in none of the other.
        apart = (every[i] & ~any_[j]) | (every[j] & ~any_[i])
        near = np.bitwise_count(apart) <= differences
        i, j = i[near], j[near]
        if level == 0:
            labels = join(labels, i, j)
            continue
        if len(i) > PAIRS_AT_ONCE // FAN_OUT**2 or level == 1:
            span = FAN_OUT**level
            at = np.arange(0, n, span)
            low, high = np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)
            open_ = (np.minimum(low[i], low[j]) != np.maximum(high[i], high[j]))
            i, j = i[open_], j[open_]
        size = len(levels[level - 1][0])
        left = (i[:, None, None] * FAN_OUT + child[None, :, None]).repeat(FAN_OUT, axis=2).ravel()
        right = (j[:, None, None] * FAN_OUT + child[None, None, :]).repeat(FAN_OUT, axis=1).ravel()
        keep = (left < size) & (right < size) & ((left < right) if level == 1 else (left <= right))
        left, right = left[keep], right[keep]
        for k in range(0, len(left), PAIRS_AT_ONCE):
            stack.append((level - 1, left[k : k + PAIRS_AT_ONCE], right[k : k + PAIRS_AT_ONCE]))
    return labels


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (mask, pattern, fp) to links (a, b) that connect what each node connects."""

    def stars(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        labels = groups_of(values.view(np.uint64))
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return values[moved], values[labels[moved]]

    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        columns = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        mask, pattern, fp = columns
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
        last = cuts[-1] if len(cuts) else 0
        out = [stars(fp[i:j]) for i, j in zip([0, *cuts[:-1]], cuts, strict=False) if j - i > 1]
        held = [c[last:] for c in columns]
        yield _links(out)
    if len(held[2]) > 1:
        yield _links([stars(held[2])])


def _links(found: list) -> pa.RecordBatch:
    sides = [np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()) for s in sides], ["a", "b"])


def links(fps: DataFrame, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fps`` (fp) within two bits of each other."""
    spark = fps.sparkSession
    masks = _divided(0)
    nodes = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    done = []
    while True:
        nodes = nodes.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("pattern"), "fp")
        free = BITS - bin(masks[0] % (1 << BITS)).count("1")
        large = nodes.groupBy("mask", "pattern").count().filter(F.col("count") > node_limit).select("mask", "pattern")
        if free <= LEAST_FREE_BITS or (large := materialise(large, "simhash-large")).isEmpty():
            done.append(nodes)
            break
        done.append(nodes.join(large, ["mask", "pattern"], "left_anti"))
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(f) for f in _divided(m)]))])
        nodes = nodes.join(large, ["mask", "pattern"], "left_semi").select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
        nodes = nodes.distinct()  # different divisions can lead to the same node
        masks = sorted({f for m in masks for f in _divided(m)})
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    ranged = every.repartition(partitions(spark), "mask", "pattern").sortWithinPartitions("mask", "pattern", gray_rank(F.col("fp")))
    return ranged.mapInArrow(_stars, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; a root is the smallest node of its component."""
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        # Large star: larger neighbours move to the smallest one. Hubs are pre-aggregated, and their rows can be split in the join.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "stars")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "stars")
        # Small star: smaller neighbours and the node itself move to the smallest one.
        lowest = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "stars")


def cluster(fps: DataFrame, node_limit: int = NODE_LIMIT) -> DataFrame:
    """``fps`` (doc_id, fp) with component_id: the smallest doc_id reachable over links.

    Equal fingerprints are linked, also the zero of texts without words. Rows without doc_id belong to components but name
    none; a component without any doc_id has a null component_id. Repeated rows stay. ``fps`` is read more than once, so pass a stored one.
    """
    first = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    linked = components(links(first.select("fp"), node_limit))
    members = linked.select(F.col("node").alias("fp"), "root").unionByName(linked.select(F.col("root").alias("fp"), "root").distinct())
    members = materialise(members, "simhash-members")
    roots = members.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(roots, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    labels = first.join(named, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")
    )
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; see ``fingerprint`` and ``cluster``."""
    stored = materialise(fingerprints(docs, doc_id, text), "simhash")
    return cluster(stored).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
