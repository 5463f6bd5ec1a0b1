"""I-Match fingerprints."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

import __spark_entry__ as E
from caderneta.llm import imatch

SF = "/root/testdata/sf0.001"


def slow(rows, words):
    """Brute force over (doc_id, text): next by id, then text hash as given."""
    prints = imatch.Fingerprints(words)
    out = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        a, b, c = prints.of(text), prints.of(new), prints.of(after)
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, imatch.likeness(a, b), imatch.likeness(a, c)))
    return out


def test_likeness():
    r = random.Random(1)
    words = sorted({f"w{i}" for i in range(3000)})
    prints = imatch.Fingerprints(words)
    for size in (5, 20, 100, 1000, 2900):
        own = r.sample(words, size)
        part = own[: size - size // 5]
        a, b = prints.of(" ".join(own)), prints.of(" ".join(part + [f"x{i}" for i in range(9)]))
        assert prints.of(" ".join(own)) == a and imatch.likeness(a, a) == 1.0
        assert imatch.likeness(a, b) == imatch.likeness(b, a)
        if size in (20, 100, 1000):
            other = prints.of(" ".join(r.sample(words, size)))
            assert imatch.likeness(a, b) > 0.3 + imatch.likeness(a, other) * (size < 1000)
    assert imatch.likeness(prints.of(""), prints.of("none of these")) == 0.0


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(5, "e five"), (1, None), (1, None), (3, "c " * 50), (2, ""), (None, "last one"), (7, "é" * 41)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in imatch.compare(df).collect()}
    order = [(1, ""), (1, ""), (2, ""), (3, "c " * 50), (5, "e five"), (7, "é" * 41), (None, "last one")]
    assert imatch.compare(df).count() == 7
    assert got == {r[:3] for r in slow(order, [])}
    assert imatch.compare(df.limit(0)).count() == 0
    assert imatch.compare(df.filter("doc_id = 5")).first()["near_next"] == 1.0


def test_a_text_of_a_third_of_the_rows_keeps_its_terms(spark):
    r = random.Random(3)
    texts = [" ".join(f"t{i}w{r.randrange(10**6)}" for _ in range(80)) for i in range(61)]
    rows = [x for i, text in enumerate(texts[1:]) for x in ([text, texts[0]] if i % 2 else [text])]
    assert 3 * rows.count(texts[0]) == len(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert set(imatch.lexicon(df)) == {t for x in texts for t in imatch.terms(x)}
    got = {r["doc_id"]: r for r in imatch.compare(df).collect()}
    hot = [got[i] for i, x in enumerate(rows) if x == texts[0]]
    assert len(hot) == 30 and all(r["near_edited"] > 0.3 for r in hot)


def test_query_counts_distinct_texts(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    texts = {x for _, x in docs}
    df = Counter(t for x in texts for t in imatch.terms(x))
    words = sorted(t for t, n in df.items() if imatch.LEAST_SHARE * len(texts) <= n <= imatch.MOST_SHARE * len(texts))
    got = [tuple(r) for r in E.queries()["op7_imatch"](spark, SF).collect()]
    assert len(texts) < len(docs) and sorted(got) == sorted(slow(docs, words))
    near = [r[5] > r[6] for r in got if r[1] > 200]
    assert sum(near) > 0.95 * len(near)


def test_hashes_are_those_of_sorted_lists():
    words = sorted({f"w{i}" for i in range(400)})
    prints = imatch.Fingerprints(words)
    own = random.Random(2).sample(words, 90)
    place = np.array(sorted(words.index(w) for w in own))
    got = np.frombuffer(bytes.fromhex(prints.of(" ".join(own))[imatch.EXACT_DIGITS:]), ">u4").reshape(imatch.LEVELS, imatch.SUBSETS)
    for level in range(imatch.LEVELS):
        for subset in range(imatch.SUBSETS):
            held = [i for i in place if prints._level[i, subset] > level]
            listed = b"".join(int(prints._hash[i]).to_bytes(8, "little") for i in held)
            assert got[level, subset] == (max(1, xxhash.xxh32_intdigest(listed)) if held else 0)


def test_long_text(spark):
    text = "palavra outra " * 150_000
    df = spark.createDataFrame([(1, text), (2, "curta"), (3, text + "fim")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.compare(df).collect()}
    assert got[1]["n_chars"] == len(text) and got[1]["edited_sha256"] == hashlib.sha256((text[: len(text) - len(text) // 4] + "curta").encode()).hexdigest()


def test_copies_are_counted_by_hash_and_no_text_is_shuffled_for_it(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(20)) for _ in range(40)] + ["", "é é", "É é"]
    rows = [x for i, x in enumerate(texts) for _ in range(1 + i % 7)] + [None] * 3
    df = spark.createDataFrame([(i % 4, x) for i, x in enumerate(rows)], "doc_id long, text string").repartition(5)
    copies = Counter(x or "" for x in rows)
    got = imatch.with_copies(df)
    assert Counter((x["text"], x["copies"]) for x in got.collect()) == Counter({(x, n): n for x, n in copies.items()})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    held = Counter(t for x in copies for t in imatch.terms(x))
    share = 2.5 / len(copies)
    assert imatch.lexicon(df, least_share=share, most_share=0.5) == sorted(
        t for t, n in held.items() if share * len(copies) <= n <= 0.5 * len(copies)
    )


def test_copies_beyond_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr(imatch, "MOST_SENT", 1)
    df = spark.createDataFrame([(i, f"a{i % 3} b") for i in range(9)] + [(9, "c"), (None, None)], "doc_id long, text string")
    got = Counter((x["text"], x["copies"]) for x in imatch.with_copies(df).collect())
    assert got == {("a0 b", 3): 3, ("a1 b", 3): 3, ("a2 b", 3): 3, ("c", 1): 1, ("", 1): 1}
