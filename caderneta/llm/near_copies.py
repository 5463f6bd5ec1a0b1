"""Near copies by shingle similarity: wide SimHash fingerprints, the Gray-order index of ``simhash``, and an exact check.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. At that similarity some 15 % of the bits of two
fingerprints differ, too many for one index with a small radius. So a fingerprint is wide and cut into bands, and each band is a table
of its own in which values that differ in at most two bits meet, by upper nodes of shared masked bits and, inside a node, by Gray order and accumulated
differences. The number of bits in a band grows with the logarithm of the number of texts, which keeps chance meetings rare, and
the number of bands follows from the share of near copies at the threshold that a band must find (``tables``). Pairs that meet also pass a check
word of 64 bits before they leave the node, and each node gives a forest of pairs, never all pairs of a group.

Every pair is then decided on whole texts. Texts are equal by a 128-bit hash and enter once; only texts with a candidate are read again. Bands
are taken in two rounds: most of what the first one has connected is known to the second, so a large group isn't verified once for each band.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caderneta.llm import simhash
from caderneta.llm.common import col, fresh, partitions
from caderneta.session import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# Near copies at the threshold that the index is laid out to find, and bits of a band beyond the logarithm of the number of texts.
RECALL = 0.97
EXTRA_BITS = 10
LEAST_BITS, MOST_BITS = 20, 48
# Bits of the check word in which a pair may differ: chance pairs differ in 32 of 64, near copies in 10, give or take 4 and 3.
CHECK_DIFFERENCES = 20
# Bands of the first round.
FIRST_BANDS = 2
SEED = 42
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def bit_difference(similarity: float = SIMILARITY) -> float:
    """Share of bits that differ between texts of equal length with that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables(texts: int) -> tuple[int, int]:
    """(bits of a band, bands) for so many texts."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(texts, 2))) + EXTRA_BITS))
    p = bit_difference()
    found = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(simhash.DIFFERENCES + 1))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - found))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of all words if there are fewer, none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE_WORDS:
        return np.array([digest(joined, SEED)], np.uint64)
    first, last = (ends - lengths)[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist()
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(first, last, strict=True)], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; texts without words are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words whose bits are those that most hashes have, each word from hashes mixed in its own way."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    steps = np.arange(1, 2 * words, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), 255):  # so many that a byte counts them
        mixed = hashes[i : i + 255, None] * steps[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
        mixed ^= mixed >> np.uint64(32)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def bands(fingerprint: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first ``count * bits`` bits as numbers."""
    flat = np.unpackbits(fingerprint.astype("<u8").view(np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    return (flat.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _prints(bits: int, count: int):
    words = -(-bits * count // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_py() or "" for v in batch.column(1)]
            hashed = [hashlib.md5(t.encode()).digest() for t in texts]
            # Copies in a batch are fingerprinted once.
            once = {h: wide_fingerprint(shingles(t), words + 1) for h, t in zip(hashed, texts, strict=True)}
            values = [bands(once[h], bits, count).view(np.int64) for h in hashed]
            check = np.array([once[h][words] for h in hashed], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashed, pa.binary()), pa.array(values, pa.list_(pa.int64())), pa.array(check)],
                ["key", "hash", "bands", "check"],
            )

    return run


def _forest(values: np.ndarray, check: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near values with near check words that join each group without a circle; members of one ``known`` group are joined before."""
    left, right = [], []
    _, first, own = np.unique(known, return_index=True, return_inverse=True)

    def join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alike = np.bitwise_count(check[a] ^ check[b]) <= CHECK_DIFFERENCES
        a, b = a[alike], b[alike]
        while len(a):
            x, y = labels[a], labels[b]
            a, b, x, y = (v[x != y] for v in (a, b, x, y))
            # One pair for each group that moves to another.
            moved, at = np.unique(np.maximum(x, y), return_index=True)
            left.append(a[at])
            right.append(b[at])
            labels[moved] = np.minimum(x, y)[at]
            while not ((up := labels[labels]) == labels).all():
                labels = up
        return labels

    simhash.groups_of(values, join=join, labels=first[own])
    empty = [np.empty(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, value, check, id, known) to candidate pairs (a, b) of ids."""

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        node, value, check, ids, known = columns
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        sides: list[list[np.ndarray]] = [[], []]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i > 1:
                forest = _forest(value[i:j].view(np.uint64), check[i:j].view(np.uint64), known[i:j])
                for side, at in zip(sides, forest, strict=True):
                    side.append(ids[i:j][at])
        a, b = (np.concatenate(s) if s else np.empty(0, np.int64) for s in sides)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held = [np.empty(0, np.int64)] * 5
    for batch in batches:
        columns = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        changes = np.flatnonzero(columns[0][1:] != columns[0][:-1])
        last = changes[-1] + 1 if len(changes) else 0
        if last:
            yield found([c[:last] for c in columns])
        held = [c[last:] for c in columns]
    if len(held[0]) > 1:
        yield found(held)


def candidates(texts: DataFrame, bits: int, node_limit: int = simhash.NODE_LIMIT) -> DataFrame:
    """(a, b), a < b: pairs of ids that meet in a band, from (id, bands, check, known); groups that are ``known`` aren't joined again.

    A band's value goes to an upper node for each third of its bits; nodes above the limit are divided by thirds of the bits that are
    left, as in ``simhash``, so values within two bits always share a node.
    """
    spark = texts.sparkSession
    low = (1 << bits) - 1
    masks = [m & low for m in simhash._divided(simhash._signed(((1 << 64) - 1) ^ low))]
    rows = texts.select("id", "check", "known", F.posexplode("bands").alias("band", "value"))
    nodes = rows.select("*", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    key, done = ["band", "mask", "pattern"], []
    while True:
        nodes = nodes.withColumn("pattern", F.col("mask").bitwiseAND(F.col("value")))
        free = bits - bin(masks[0]).count("1")
        sizes = nodes.groupBy(*key).agg(F.approx_count_distinct("value").alias("n"), F.count("*").alias("rows"))
        large = materialise(sizes.filter(F.col("rows") > node_limit).filter(F.col("n") > node_limit // 2).select(*key), "near-large")
        if free <= simhash.LEAST_FREE_BITS // 2 or large.isEmpty():
            done.append(nodes)
            break
        done.append(nodes.join(large, key, "left_anti"))
        outside = ((1 << 64) - 1) ^ low
        parts = {m: [f & low for f in simhash._divided(simhash._signed(outside | m))] for m in masks}
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(f) for f in parts[m]]))])
        nodes = nodes.join(large, key, "left_semi").select("id", "check", "known", "band", "value", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        masks = sorted({f for fs in parts.values() for f in fs})
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more.select(*every.columns))
    node = F.xxhash64(*key)  # nodes that share a hash only meet: their values must still be near
    placed = every.select(node.alias("node"), "value", "check", "id", "known").repartition(partitions(spark), "node")
    ranged = placed.sortWithinPartitions("node", simhash.gray_rank(F.col("value")))
    return ranged.mapInArrow(_pairs, "a long, b long").distinct()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        sets: dict[int, np.ndarray] = {}
        near = []
        for i, j, s, t in zip(a, b, x, y, strict=True):
            for key, text in ((i, s), (j, t)):
                if key not in sets:
                    sets[key] = shingles(text)
            near.append(similarity(sets[i], sets[j]) >= SIMILARITY)
        yield pa.RecordBatch.from_arrays([pa.array([v for v, n in zip(c, near, strict=True) if n], pa.int64()) for c in (a, b)], ["a", "b"])


def _verify(docs: DataFrame, text: str, numbered: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose texts are similar enough; only texts of a pair are read."""
    wanted = numbered.select("hash", "id").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    value = F.coalesce(col(text), F.lit(""))
    whole = docs.select(F.unhex(F.md5(value.cast("binary"))).alias("hash"), value.alias("t"))
    found = materialise(whole.join(wanted, "hash").groupBy("id").agg(F.first("t").alias("t")), "near-found")
    both = pairs.join(found.withColumnsRenamed({"id": "a", "t": "x"}), "a").join(found.withColumnsRenamed({"id": "b", "t": "y"}), "b")
    return materialise(both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "near-links")


def _neighbours(links: DataFrame) -> DataFrame:
    """(id, near): the smallest id at most two links away. Rows of one ``near`` are connected; hubs are pre-aggregated."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "near-neighbours")
    two = both.join(one.withColumnsRenamed({"a": "b"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("m").alias("near"))
    return materialise(two, "near-neighbours")


def cluster(docs: DataFrame, key: str, text: str = "text", node_limit: int = simhash.NODE_LIMIT) -> DataFrame:
    """(key, hash, group, first): each distinct (``key``, text) with its group and whether it is the group's first row.

    ``key`` is a long without nulls; rows of equal key and text count as one, rows of equal key and different texts don't. ``hash`` is
    the MD5 of the text, null as empty. The first row has the smallest key, then the smallest hash. Texts without words are
    alike. An empty table gives an empty result. ``docs`` is read two or three times, so pass a stored one.
    """
    bits, count = tables(docs.count())
    printed = docs.select(col(key).cast("long").alias("key"), F.coalesce(col(text), F.lit("")).alias("text")).mapInArrow(
        _prints(bits, count), "key long, hash binary, bands array<long>, check long"
    )
    stored = materialise(printed, "near-prints")
    texts = stored.groupBy("hash").agg(F.first("bands").alias("bands"), F.first("check").alias("check"))
    numbered = materialise(texts.withColumn("id", F.monotonically_increasing_id()), "near-texts")
    prints = ["id", "bands", "check", "known"]
    first = numbered.withColumn("bands", F.slice("bands", 1, FIRST_BANDS)).withColumn("known", F.col("id"))
    links = _verify(docs, text, numbered, materialise(candidates(first.select(*prints), bits, node_limit), "near-pairs"))
    if count > FIRST_BANDS:
        rest = numbered.withColumn("bands", F.slice("bands", FIRST_BANDS + 1, count)).join(_neighbours(links), "id", "left")
        rest = rest.withColumn("known", F.coalesce("near", "id"))
        pairs = materialise(candidates(rest.select(*prints), bits, node_limit), "near-pairs")
        links = links.unionByName(_verify(docs, text, numbered, pairs))
    roots = simhash.components(links)
    members = numbered.select("hash", "id").join(roots, F.col("id") == F.col("node"), "left")
    rows = stored.select("key", "hash").distinct().join(members.select("hash", F.coalesce("root", "id").alias("group")), "hash")
    rows = materialise(rows, "near-rows")
    firsts = rows.groupBy("group").agg(F.min(F.struct("key", "hash")).alias("least"))
    return rows.join(firsts, "group").select("key", "hash", "group", (F.struct("key", "hash") == F.col("least")).alias("first"))


def keep_first(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all columns; of repeated rows one."""
    hashed, group = fresh(docs, "text_hash", "group_key")
    first = cluster(docs, key, text).filter("first").select(F.col("key").alias(group), F.col("hash").alias(hashed))
    marked = docs.withColumn(hashed, F.unhex(F.md5(F.coalesce(col(text), F.lit("")).cast("binary"))))
    kept = marked.join(first, (col(key) == col(group)) & (marked[hashed] == first[hashed]), "left_semi")
    return kept.dropDuplicates([key, hashed]).drop(hashed)
