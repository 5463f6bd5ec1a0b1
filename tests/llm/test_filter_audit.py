"""Filter interactions: the stream with retractions against a plain count over all rows."""

import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caderneta.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, lang string"


def mask_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3
    )


def brute(rows, labels):
    """(part, mask) -> (n, good, toxic)."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = defaultdict(lambda: [0, 0, 0])
    for doc_id, text, lang in rows:
        copy = doc_id is not None and doc_id > least[text or ""]
        key = lang or "", mask_of(text or "") | copy << 4
        for i, x in enumerate((True, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic)):
            out[key][i] += x
    return {k: tuple(v) for k, v in out.items()}


def brute_steps(counts):
    docs = [(part, mask, n, g, t) for (part, mask), (n, g, t) in counts.items()]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        fair = Counter()
        for order in fa.ORDERS:
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                hit = [d for d in left if d[1] & bit]
                stay = [d for d in left if not d[1] & bit]
                fails = sum(d[2] for d in own if d[1] & bit)
                removed = sum(d[2] for d in hit)
                fair[letter] += removed
                out[part, order, step] = [
                    sum(d[2] for d in stay), removed, fails - removed, sum(d[2] for d in own if d[1] == bit),
                    sum(d[3] for d in hit), sum(d[4] for d in hit), letter,
                ]
                left = stay
        for order in fa.ORDERS:
            for step in range(1, 6):
                out[part, order, step][-1] = fair[out[part, order, step][-1]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Four files, smaller ids in later ones; a text with a third of the rows, nulls, repeats and a long text."""
    varied = " ".join(f"w{i}" for i in range(120))
    texts = [varied, varied.upper(), varied + " $", "short", "same " * 150, None, "", " \n", "É" * 9 + "A", "palavra nova " * 100_000]
    rows = []
    for i in range(400):
        text = "o mesmo texto" if i % 3 == 0 else texts[i % len(texts)] if i % 5 else f"{varied} {i}"
        rows.append((1000 - i, text, ("en", "fr", None, "")[i % 4]))
    rows += [(1, "o mesmo texto", "de"), (1, "o mesmo texto", "de"), (1, "o mesmo texto", "fr"), (None, "o mesmo texto", "fr"), (None, None, None)]
    folder = str(tmp_path_factory.mktemp("audit") / "documents.parquet")
    for k in range(4):
        part = rows[k * 100:] if k == 3 else rows[k * 100:(k + 1) * 100]
        df = spark.createDataFrame(part, SCHEMA).withColumns({"sha": F.lit("x"), "n": F.lit(1), "good": F.lit(9)})
        df.coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


LABELS = [(1, 1, 0), (1, 0, 1), (700, 0, 1), (701, 1, None), (1000, 1, 1), (997, None, 1), (None, 1, 1), (5555, 1, 1)]


def collected(counts):
    return {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in counts.collect()}


def test_masks(spark):
    texts = ["A" + "b" * 9, "A" + "b" * 8, "", " ", " a\x0b" * 99, "a " * 100, " ".join(map(str, range(100))), "x|", "é É" * 50, "\x85a\x1cb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fa.failures(F.col("t")).alias("m")).collect()
    assert {r["t"]: r["m"] for r in rows} == {t: mask_of(t) for t in texts}


def test_counts_and_steps(spark, files):
    folder, rows = files
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    counts = fa.count(spark, folder, labels)
    expected = brute(rows, LABELS)
    assert collected(counts) == expected
    steps = {tuple(r)[:3]: tuple(r)[3:] for r in fa.steps(counts).collect()}
    assert steps == brute_steps(expected)


def test_goes_on_with_new_files_and_retracts(spark, files, tmp_path):
    folder, rows = files
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    own, kept = f"{tmp_path}/docs.parquet", f"{tmp_path}/kept"
    read = spark.read.parquet(folder)
    read.filter("doc_id > 500").write.parquet(own)
    first = collected(fa.count(spark, own, labels, kept))
    assert first == brute([r for r in rows if r[0] is not None and r[0] > 500], LABELS)
    assert collected(fa.count(spark, own, labels, kept)) == first
    read.filter("doc_id <= 500 OR doc_id IS NULL").write.mode("append").parquet(own)
    assert collected(fa.count(spark, own, labels, kept)) == brute(rows, LABELS)


def test_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none")
    assert fa.steps(fa.count(spark, f"{tmp_path}/none", labels)).collect() == []
    spark.createDataFrame([(1, "a", None)], SCHEMA).write.parquet(f"{tmp_path}/one")
    assert collected(fa.count(spark, f"{tmp_path}/one", labels)) == {("", 1): (1, 0, 0)}


NOTHING = pd.DataFrame([], columns=fa.ENTRY).astype({c: "int64" for c in ("mask", "good", "toxic", "doc_id", "n")})
COLUMNS = ["sha", "mask", "part", "good", "toxic", "has_id", "doc_id", "at", "n"]


def step(held, rows):
    held, delta = fa.updated(held, pd.DataFrame(rows, columns=COLUMNS))
    return held, {tuple(r[:4]): r[4] for r in delta.itertuples(index=False)}


def test_state_takes_smaller_ids_and_retracts():
    held, delta = step(NOTHING, [(b"t", 3, "en", 1, 0, True, 7, 1, 2), (b"u", 0, "en", 0, 0, True, 5, 1, 1)])
    assert delta == {("en", 3, 1, 0): 1, ("en", 19, 1, 0): 1, ("en", 0, 0, 0): 1}
    held, delta = step(held, [(b"t", 3, "fr", 0, 0, True, 2, 2, 2), (b"t", 3, "fr", 0, 0, False, 0, 3, 3)])
    assert delta == {("en", 3, 1, 0): -1, ("en", 19, 1, 0): 1, ("fr", 3, 0, 0): 5}
    held, delta = step(held, [(b"t", 3, "en", 0, 1, True, 2, 1, 4)])
    assert delta == {("en", 3, 0, 1): 1, ("en", 19, 0, 1): 3}
    assert sorted(held.itertuples(index=False, name=None)) == [
        (b"t", 3, "en", 0, 1, 2, 1), (b"t", 3, "fr", 0, 0, 2, 2), (b"u", 0, "en", 0, 0, 5, 1),
    ]
