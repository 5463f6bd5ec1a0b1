"""Shards along the Hilbert curve."""

import itertools
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as E
from caderneta.llm import hilbert

SF = "/root/testdata/sf0.001"


def test_curve_visits_every_cell_by_unit_steps(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        points = list(itertools.product(range(side), repeat=n))
        df = spark.createDataFrame(points, ", ".join(f"p{i} int" for i in range(n)))
        rows = df.withColumn("h", hilbert.curve_index([F.col(f"p{i}") for i in range(n)], bits)).collect()
        order = sorted(rows, key=lambda r: r["h"])
        assert [r["h"] for r in order] == list(range(side**n))
        for a, b in itertools.pairwise(order):
            assert sum(abs(x - y) for x, y in zip(a[:n], b[:n], strict=True)) == 1


def test_query_keeps_the_law(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op9_hilbert_shards"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, None, None, 1)] * 3 + [(1, "en", "a", 2)] * 40 + [(i, "fr", f"s{i % 3}", i) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, cell long")
    args = ({"lang": "lang", "source": "source", "size": "cell"}, ["doc_id", "cell"], 5)
    out = hilbert.assign(df, *args).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in out))) == sorted(map(repr, rows))
    sizes = defaultdict(list)
    for r in out:
        sizes[r["shard"]].append(r["slot"])
    assert sorted(map(len, sizes.values())) == [14, 14, 15, 15, 15]
    assert all(sorted(x) == list(range(len(x))) for x in sizes.values())
    assert hilbert.assign(df.limit(0), *args).count() == 0


def test_files_of_a_shard_cover_small_boxes(spark):
    df = spark.range(20_000).select("id", (F.xxhash64("id") % 1000).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000).alias("b"))
    out = hilbert.assign(df, {"a": "a", "b": "b"}, ["id"], 16)
    boxes = out.groupBy("shard").agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b")).collect()
    assert sum(r["a"] * r["b"] for r in boxes) < 0.25 * 16 * 2000 * 2000
