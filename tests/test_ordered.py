"""Chunked computations against plain Python, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from caderneta.operators import automaton, dedup, grouping, metrics, ordered, sampling


def skewed(n=600, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else rng.choice("abc"), i, rng.choice([None, *range(20)]), rng.random() * 100) for i in range(n)]


def by_key(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = skewed()
    return rows, spark.createDataFrame(rows, "k string, i long, v int, x double")


def test_scan(spark, data):
    rows, df = data
    steps = [
        ordered.RunningSum("s", F.col("v")), ordered.MaxBefore("m", F.col("v")), ordered.LastKnown("f", F.col("v")),
        ordered.LastKnownBefore("fb", F.col("v")), ordered.FirstKnown("first", F.col("v")),
        ordered.Previous("p", F.col("v")), ordered.Next("n", F.col("v")), ordered.row_number("rn"),
    ]
    got = {r["i"]: r for r in ordered.scan(df, ["k"], ["i"], F.floor(F.col("i") / 7), steps).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        total, high, last = 0, None, None
        first = next((r[2] for r in group if r[2] is not None), None)
        for j, (_, i, v, _x) in enumerate(group):
            assert (got[i]["m"], got[i]["fb"]) == (high, last)
            total += v or 0
            last = v if v is not None else last
            assert (got[i]["s"], got[i]["f"], got[i]["first"], got[i]["rn"]) == (total, last, first, j + 1)
            assert got[i]["p"] == (group[j - 1][2] if j else None)
            assert got[i]["n"] == (group[j + 1][2] if j + 1 < len(group) else None)
            high = v if high is None or (v is not None and v > high) else high


def test_states(spark, data):
    rows, df = data
    table = [[1, 2, 0], [0, 0, 2], [2, 1, 1]]
    coded = df.withColumn("code", F.when(F.col("v") < 3, F.col("v")))
    got = {r["i"]: r["state"] for r in automaton.states_before(coded, ["k"], "i", F.floor(F.col("i") / 11), "code", table, 0).collect()}
    for group in by_key(rows).values():
        state = 0
        for _, i, v, _x in group:
            assert got[i] == state
            if v is not None and v < 3:
                state = table[v][state]


def test_states_through_several_levels(spark, data, monkeypatch):
    """Four rows to a chunk and two children to a node: seven levels."""
    monkeypatch.setattr(automaton, "FAN_OUT", 2)
    rows, df = data
    table = [[1, 2, 0], [0, 0, 2], [2, 1, 1]]
    coded = df.withColumn("code", F.when(F.col("v") < 3, F.col("v")))
    got = {r["i"]: r["state"] for r in automaton.states_before(coded, ["k"], "i", F.floor(F.col("i") / 4), "code", table, 1).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        state = 1
        for _, i, v, _x in group:
            assert got[i] == state
            if v is not None and v < 3:
                state = table[v][state]
    holes = spark.createDataFrame([(None, 5, 0), (None, None, 1), ("a", 1 << 40, 0), ("a", -7, 1)], "k string, i long, code int")
    found = automaton.states_before(holes, ["k"], "i", automaton.fold_chunk("i"), "code", [[1, 0], [0, 0]], 0)
    assert {(r["k"], r["i"]): r["state"] for r in found.collect()} == {(None, 5): 0, (None, None): 0, ("a", 1 << 40): 0, ("a", -7): 0}
    none = automaton.states_before(df.limit(0).withColumn("code", F.col("v")), ["k"], "i", F.col("i"), "code", table, 0)
    assert none.collect() == []


def test_even_chunks(spark, data):
    """Chunks follow the order and hold similar numbers of rows, piled values included."""
    rows = [("hot", float(i % 3 == 0), i) for i in range(6000)] + [(f"k{i % 50}", 0.5, i) for i in range(3000)] + [(None, 1.0, 1)]
    df = spark.createDataFrame(rows, "k string, x double, i long")
    out = ordered.even_chunks(df, ["k"], ["x", "i"], rows=200)
    assert out.count() == len(rows)
    sizes = {(r["k"], r["chunk"]): r["count"] for r in out.groupBy("k", "chunk").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert 15 <= len(hot) <= 60 and max(hot) < 600
    assert all(c == 0 for k, c in sizes if k != "hot")
    ranges = out.groupBy("k", "chunk").agg(F.min(F.struct("x", "i")).alias("a"), F.max(F.struct("x", "i")).alias("b")).collect()
    ends = sorted((r["chunk"], tuple(r["a"]), tuple(r["b"])) for r in ranges if r["k"] == "hot")
    assert all(x[2] < y[1] for x, y in zip(ends, ends[1:], strict=False))
    assert ordered.even_chunks(df.limit(0), ["k"], ["x", "i"]).collect() == []


@pytest.mark.parametrize("tolerance, width, fan_out", [(0.7, 20, 2), (3.0, 16, 3), (30.0, 18, 2), (0.7, None, 256), (200.0, 16, 2)])
def test_anchors(spark, data, tolerance, width, fan_out, monkeypatch):
    monkeypatch.setattr(grouping, "FAN_OUT", fan_out)
    rows, df = data
    got = {r["i"]: r["anchor"] for r in grouping.anchored_groups(df, ["k"], "x", tolerance, rows=width).collect()}
    for group in by_key(rows).values():
        anchor = None
        for _, i, _v, x in sorted(group, key=lambda r: r[3]):
            if anchor is None or x - anchor > tolerance:
                anchor = x
            assert got[i] == anchor


def test_splits(spark, data):
    rows, df = data
    best = {r["k"]: r["split"] for r in grouping.two_means_split(df, ["k"], "x", F.floor(F.col("x") / 5)).collect()}
    gaps = {r["k"]: r["split"] for r in grouping.largest_gap(df, ["k"], "x", F.floor(F.col("x") / 5), 0.5).collect()}
    for key, group in by_key(rows).items():
        xs = sorted(r[3] for r in group)
        mean = lambda v: sum(v) / len(v)
        err = lambda v: sum((a - mean(v)) ** 2 for a in v)
        cut = min(range(1, len(xs)), key=lambda c: err(xs[:c]) + err(xs[c:]))
        assert best[key] == pytest.approx((mean(xs[:cut]) + mean(xs[cut:])) / 2)
        width, left = max((b - a, -a) for a, b in zip(xs, xs[1:]))
        assert gaps[key] == (pytest.approx(-left + width / 2) if width >= 0.5 else None)


def test_segments_and_tails(spark):
    rows = [("d", 1, "a", 0.0, 1.0), ("d", 2, "9,99", 2.0, 3.0), ("d", 3, "8,88", 50.0, 51.0), ("d", 4, "b", 52.0, 53.0), ("e", 1, "7,77", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, t string, x0 double, x1 double")
    seg = {(r["k"], r["i"]): r["segment"] for r in grouping.segments(df, ["k"], ["i"], F.floor(F.col("i") / 2), "x0", "x1", 40).collect()}
    assert [seg[("d", i)] for i in (1, 2, 3, 4)] == [0, 0, 1, 1]
    merged = grouping.merge_trailing(df.select("k", "i", "t"), ["k"], "i", F.floor(F.col("i") / 2), "t", F.col("t").rlike(r"^\d,\d\d$"))
    assert sorted((r["k"], r["i"], r["t"]) for r in merged.collect()) == [("d", 1, "a 9,99 8,88"), ("d", 4, "b"), ("e", 1, "7,77")]


def test_dedup(spark):
    df = spark.createDataFrame([("f2", "t", 1, "late"), ("f1", "t", 1, "x"), ("f1", "t", 2, "y"), ("f2", "u", 1, "z")], "f string, id string, n int, v string")
    assert sorted((r["id"], r["v"]) for r in dedup.first_file_wins(df, "id", "f", ["n"]).collect()) == [("t", "y"), ("u", "z")]
    plan = dedup.first_file_wins(df, "id", "f", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_auc_with_piled_scores(spark):
    """Scores piled at 0 and 1 and many distinct ones, several models at once, against all pairs."""
    rng = random.Random(3)
    rows = [(m, rng.choice("yn"), rng.choice([0.0, 1.0, rng.random()])) for m in "ab" for _ in range(300)]
    df = spark.createDataFrame([(m, t, [p]) for m, t, p in rows], "m string, t string, p array<double>")
    got = {r["m"]: r["auc"] for r in metrics.auc_per_class(df, "t", F.col("p"), ["y"], ["m"]).collect()}
    for m in "ab":
        pos, neg = ([p for k, t, p in rows if (k, t) == (m, y)] for y in "yn")
        assert got[m] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def test_sampling(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(200)], "id int, y string")
    counts = {(r["y"], r["part"]): r["count"] for r in sampling.stratified_split(df, "y", "id").groupBy("y", "part").count().collect()}
    assert counts == {("a", "test"): 36, ("a", "train"): 144, ("b", "test"): 4, ("b", "train"): 16}
    per = sampling.folds(df, "y", "id", 5).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in per if r["y"] == "b"} == {4}
    assert sampling.oversample(df, "y", "id").filter("y = 'b'").count() == int(180 * 0.7)


def test_copies_share_a_fold(spark):
    rows = [(i, f"t{i // 3}" if i < 90 else "hot" if i < 140 else None, "a" if i % 2 else "b") for i in range(160)]
    df = spark.createDataFrame(rows, "id int, t string, y string")
    out = sampling.grouped_folds(df, "y", "t", 4).collect()
    assert sorted(r["id"] for r in out) == list(range(160))
    folds = {}
    for r in out:
        folds.setdefault(r["t"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in folds.values()) and {f for s in folds.values() for f in s} == {0, 1, 2, 3}
    single = sampling.grouped_folds(df.withColumn("t", F.col("id")), "y", "t", 4).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in single} == {20}


def test_nulls_keep_their_rows(spark):
    rows = [("a", 1, 1.0), ("a", None, 2.0), (None, 2, 3.0), (None, None, 4.0), ("a", 3, None)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    out = ordered.scan(df, ["k"], ["i"], F.floor(F.col("i") / 2), [ordered.row_number("rn"), ordered.RunningSum("s", F.col("x"))])
    assert {(r["k"], r["i"], r["rn"], r["s"]) for r in out.collect()} == {
        ("a", None, 1, 2.0), ("a", 1, 2, 3.0), ("a", 3, 3, 3.0), (None, None, 1, 4.0), (None, 2, 2, 7.0),
    }
    assert {(r["k"], r["i"], r["anchor"]) for r in grouping.anchored_groups(df, ["k"], "x", 1.0).collect()} == {
        ("a", 1, 1.0), ("a", None, 1.0), ("a", 3, None), (None, 2, 3.0), (None, None, 3.0),
    }
    labelled = spark.createDataFrame([(i, None if i % 2 else "y") for i in range(10)], "i long, label string")
    assert sampling.stratified_split(labelled, "label", "i").groupBy("label", "part").count().count() == 4
    assert sampling.folds(labelled, "label", "i").count() == 10


def test_unusable_scores_count_as_lowest(spark):
    df = spark.createDataFrame([("y", [0.9]), ("y", [None]), ("n", [0.5]), ("n", [float("nan")])], "t string, p array<double>")
    assert metrics.auc_per_class(df, "t", F.col("p"), ["y"]).first()["auc"] == (2 + 0.5) / 4


def test_states_of_well_packed_rows_are_not_broadcast(spark):
    """Files of repetitive rows are much smaller than the rows, so their size says nothing about what a broadcast would hold."""
    from caderneta.session import materialise

    rows = materialise(spark.range(200_000).selectExpr("id % 500 AS k", "id DIV 500 AS i", "cast(null AS int) AS code"), "packed")
    found = automaton.states_before(rows, ["k"], "i", automaton.fold_chunk("i"), "code", [[1, 0], [0, 0]], 1)
    scanned = ordered.scan(found, ["k"], ["i"], F.floor(F.col("i") / 100), [ordered.row_number("rn")])
    assert scanned.filter("state = 1 AND rn = i + 1").count() == 200_000
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_many_chunks_of_one_key(spark, monkeypatch):
    """A tree of bounds of several levels, and composed functions with many entries: no row meets all bounds of its key."""
    monkeypatch.setattr(ordered, "BOUNDS_PER_NODE", 4)
    df = spark.range(3000).selectExpr("id AS i", "double(id * 7 % 3000) AS x", "cast(null AS string) AS k")
    cut = ordered.even_chunks(df, ["k"], ["x"], rows=40)
    per = {r["chunk"]: (r["low"], r["high"], r["n"]) for r in cut.groupBy("chunk").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).collect()}
    assert sorted(per) == list(range(len(per))) and len(per) > 40
    assert all(per[c][1] < per[c + 1][0] for c in range(len(per) - 1)) and sum(p[2] for p in per.values()) == 3000
    values = [float(v) for v in range(128_000)]
    runs = [{"first": run[0], "enter": run, "leave": run} for run in (values[at : at + 500] for at in range(0, len(values), 500))]
    began = __import__("time").time()
    enter, leave = grouping._effect_of(runs, 200_000.0)
    assert list(enter) == values == list(leave)
    assert __import__("time").time() - began < 10
