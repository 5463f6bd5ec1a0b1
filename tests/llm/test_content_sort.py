"""Exact duplicates by content sort."""

import hashlib
import re
from collections import defaultdict

from caderneta.llm import content_sort

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(rows):
    """Sorted (doc_id, keep_id, size, sha) and the number of kept rows for each text."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members)[2]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[2], keep, len(members), sha) for m in members]
    return sorted(out, key=repr), len(groups)


def held(df):
    rows = df.collect()
    kept = [r for r in rows if r["kept"]]
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert len({r["text_sha256"] for r in kept}) == len(kept)
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr), len(kept)


def test_nulls_ties_repeats_long_texts(spark):
    long = "palavra " * 200_000
    rows = [
        (1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb\n"), (4, "a\tb\n"), (None, "a\x0bb\r\r"), (5, None), (6, ""), (7, " \n"),
        (8, long), (9, long + "x"), (10, long.replace(" ", "")), (None, None), (11, "a b"), (12, "éé"), (13, "é é"),
    ]
    assert held(content_sort.mark(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert content_sort.mark(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_text_with_a_third_of_the_rows_lies_in_several_partitions(spark):
    rows = [(i, f"texto {i}" + " comum" * 20 if i % 3 else "o mesmo " * 30 + " " * (i % 5)) for i in range(3000)]
    rows += [(None, "o mesmo " * 30)] * 500 + [(7_000, "o mesmo " * 30 + " " * 9)] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert held(content_sort.mark(df)) == brute(rows)
    texts = df.selectExpr("'' as x", "text as norm").withColumn("hash", content_sort.F.xxhash64("norm"))
    common = content_sort._common(texts, sum(len(t) + 64 for _, t in rows), 8).collect()
    assert len(common) == 5 and all(1 < r["pieces"] <= 32 for r in common)


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "x", "k1", True), (2, " x", "k2", None), (None, "y", None, False), (None, "y", None, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string, `kept.x y` boolean")
    out = content_sort.distinct_texts(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[1], rows[2]], key=repr)
    named = content_sort.mark(df, carry=["keep_id"])
    assert named.columns == ["doc_id", "keep_id", "keep_id_", "group_size", "kept", "text_sha256"]
    assert sorted(named.filter("kept").select("keep_id").collect(), key=repr)[-1]["keep_id"] is None


def test_whole_table_and_no_python(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = content_sort.mark(df)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert held(out) == brute(rows)
    assert "Python" not in out._jdf.queryExecution().toString()
