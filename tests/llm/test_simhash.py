"""SimHash fingerprints, the Gray-order index and the components."""

import random

import numpy as np
import pytest
import xxhash

import __spark_entry__ as E
from caderneta.llm import simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(values):
    """Label of each value: the smallest index reachable over at most two differing bits."""
    labels = list(range(len(values)))

    def find(i):
        while labels[i] != i:
            i = labels[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                labels[b] = a
    return [find(i) for i in range(len(values))]


def near_values(seed, n, spread):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(max(1, n // 8))]
    out = set()
    while len(out) < n:
        v = r.choice(centres)
        for _ in range(r.randint(0, spread)):
            v ^= 1 << r.randrange(64)
        out.add(v)
    return list(out)


def gray_rank(v):
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> s
    return v


@pytest.mark.parametrize("n,spread", [(1, 1), (2, 1), (7, 2), (9, 3), (70, 3), (700, 4), (1500, 1)])
def test_groups_match_brute_force(n, spread):
    values = sorted(near_values(n, n, spread), key=gray_rank)
    assert simhash.groups_of(np.array(values, np.uint64)).tolist() == slow_groups(values)


@pytest.mark.parametrize("limit", [20_000, 40, 2])
def test_components_match_brute_force(spark, limit):
    values = near_values(5, 400, 3) + [0, 3, 2**64 - 1, 2**64 - 2]
    rows = [(i * 7 % 1000, v - 2**64 if v >> 63 else v) for i, v in enumerate(values)] + [(None, 0), (2000, 0), (2000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.cluster(df, limit).collect()}
    labels = slow_groups([v % 2**64 for _, v in rows])
    least = {}
    for (d, _), g in zip(rows, labels, strict=True):
        least[g] = min((x for x in (d, least.get(g)) if x is not None), default=None)
    assert got == {(d, v, least[g]) for (d, v), g in zip(rows, labels, strict=True)}


def test_long_chain(spark):
    values = [(1 << i) - 1 for i in range(0, 64, 2)]
    df = spark.createDataFrame([(100 + i, v - 2**64 if v >> 63 else v) for i, v in enumerate(values)], "doc_id long, fp long")
    assert {r["component_id"] for r in simhash.cluster(df, 3).collect()} == {100}


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in E.queries()["op6_simhash_gray"](spark, SF).collect()}
    values = [slow_fingerprint(r["text"]) for r in docs]
    labels, least = slow_groups(values), {}
    for r, g in zip(docs, labels, strict=True):
        least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    assert got == {r["doc_id"]: (f"{v:016x}", least[g]) for r, v, g in zip(docs, values, labels, strict=True)}


@pytest.mark.parametrize("text", [None, "", " \t", "a", "A b", "Ä É a B c", "x\x1cy z\x85w q", "a " * 70000])
def test_odd_texts(text):
    assert simhash.fingerprint(text or "") == slow_fingerprint(text)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
