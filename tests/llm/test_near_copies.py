"""Near copies: recall against all pairs, exactness, odd tables."""

import random

import numpy as np
import pytest

from caderneta.llm import near_copies as N


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"e{rng.randrange(10**9)}"
    return out


def corpus(seed=1):
    """150 texts with several edited copies each, of similarities around the threshold, and as many texts of their own."""
    rng = random.Random(seed)
    rows = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        rows += [words] + [edited(rng, words, rng.choice([0.004, 0.01, 0.02, 0.03, 0.05])) for _ in range(rng.randrange(4))]
        rows.append([f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))])
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def near_pairs(rows):
    sets = [N.shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            holders.setdefault(h, []).append(i)
    pairs = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    return {(rows[a][0], rows[b][0]) for a, b in pairs if N.similarity(sets[a], sets[b]) >= N.SIMILARITY}


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["group"], []).append(r["key"])
    return {k: min(v) for v in out.values() for k in v}


def test_recall_and_exactness(spark):
    rows = corpus()
    near = near_pairs(rows)
    label = groups(N.cluster(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id"))
    caught = sum(label[a] == label[b] for a, b in near)
    assert len(near) > 150 and caught >= 0.9 * len(near)
    # Whatever is joined is joined by chains of true near copies.
    true = {k: k for k, _ in rows}

    def find(k):
        while true[k] != k:
            k = true[k]
        return k

    for a, b in sorted(near):
        x, y = sorted((find(a), find(b)))
        true[y] = x
    assert all(find(k) == find(v) for k, v in label.items())


def test_small_nodes_are_divided(spark):
    rows = corpus(2)[:300]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = near_pairs(rows)
    label = groups(N.cluster(df, "doc_id", node_limit=8))
    assert sum(label[a] == label[b] for a, b in near) >= 0.9 * len(near)


def test_a_large_group_and_odd_rows(spark):
    rng = random.Random(3)
    words = [f"v{rng.randrange(900)}" for _ in range(200)]
    rows = [(i, " ".join(edited(rng, words, 0.005))) for i in range(400)] + [(500 + i, " ".join(words)) for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "two words"), (2004, "two  words"), (2005, "x " * 200_000), (2005, "another text"), (2003, "two words")]
    df = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id long, text string, group string, hash int")
    out = N.keep_first(df, "doc_id")
    assert out.columns == df.columns
    left = sorted((r["doc_id"], (r["text"] or "")[:12]) for r in out.collect())
    assert left == [(0, rows[0][1][:12]), (2000, ""), (2003, "two words"), (2005, "another text"), (2005, "x x x x x x ")]
    assert N.keep_first(df.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("texts", [2, 1000, 10**6, 10**10])
def test_layout_finds_near_copies_at_the_threshold(texts):
    bits, count = N.tables(texts)
    rng = np.random.default_rng(4)
    flips = rng.random((2000, count, bits)) < N.bit_difference()
    assert (flips.sum(axis=2) <= 2).any(axis=1).mean() > 0.95
    assert bits <= N.MOST_BITS and bits * count <= 128 * 64


def test_bands_hold_the_bits_of_the_fingerprint():
    hashes = N.shingles("a b c d e f g h i j k l m n o p")
    wide = N.wide_fingerprint(hashes, 3)
    flat = [int(wide[i // 64]) >> (i % 64) & 1 for i in range(150)]
    for k, value in enumerate(N.bands(wide, 30, 5).tolist()):
        assert [value >> i & 1 for i in range(30)] == flat[30 * k : 30 * k + 30]
    assert N.wide_fingerprint(np.repeat(hashes, 1), 2).tolist() == wide[:2].tolist()
    assert not N.wide_fingerprint(hashes[:0], 2).any()
