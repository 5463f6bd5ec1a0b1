import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from caderneta import schemas
from caderneta.operators import cascade, model
from caderneta.plans import jobs
from caderneta.session import scratch_path, settings
from caderneta.sources import feedback, files, records, sinks
from caderneta.streaming import feedback_stream

HEADER = feedback.HEADER


def line(tid, category="Farmácia", text="loja"):
    return f'"{text}, filial",{category},10.0,1,,10.0,crédito,,2025-01-01,Final 1111,{tid},v1,2025-01-01T00:00:00Z,Saida'


@pytest.fixture
def folder(tmp_path):
    put = lambda name, *rows: (tmp_path / name).write_text("\n".join(rows) + "\n", encoding="utf-8")
    put("feedback_2025-01-01.csv", "﻿" + HEADER, line("a", "first"), line("b"), line("a", "second"))
    put("feedback_2025-01-02.csv", HEADER, line("a", "later"), line("c"))
    put("feedback_2025-01-03.csv", "x,y", "1,2")
    put("feedback_2025-01-04.csv", HEADER)
    put("other.csv", HEADER, line("z"))
    return tmp_path


def test_gate_and_collection(spark, folder):
    status = {r["file_name"][-6:-4]: r["status"] for r in feedback.gate(feedback.file_records(spark, str(folder))).collect()}
    assert status == {"01": "ok", "02": "ok", "03": "wrong columns", "04": "empty"}
    got = {r["transactionId"]: r["natureza do gasto"] for r in feedback.collect(spark, str(folder)).collect()}
    assert got == {"a": "second", "b": "Farmácia", "c": "Farmácia"}
    info = {r["file_name"][-6:-4]: r["has_header"] for r in feedback.file_info(spark, str(folder)).collect()}
    assert info == {"01": True, "02": True, "03": False, "04": True}


def test_records_across_splits(spark, tmp_path):
    """Quoted line breaks, doubled quotes and long fields, with splits of a few bytes; against the csv module."""
    rng = random.Random(4)
    expected = {}
    for name in ("a.csv", "b.csv"):
        rows = [["id", "text"]]
        for i in range(120):
            rows.append([str(i), "".join(rng.choice(['x', '"', "\n", ",", "é", " ", "\r\n"]) for _ in range(rng.randrange(40)))])
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n" if name == "a.csv" else "\n").writerows(rows)
        (tmp_path / name).write_bytes(("\ufeff" + out.getvalue()).encode())
        expected[name] = rows
    with settings(spark, {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}):
        got = records.read_records(spark, str(tmp_path), "*.csv").collect()
        lines = records.read_lines(spark, str(tmp_path), "a.csv").collect()
    for name, rows in expected.items():
        own = sorted((r["record_no"], r["record"]) for r in got if r["file_name"] == name)
        assert [n for n, _ in own] == list(range(len(rows)))
        assert [next(csv.reader(io.StringIO(t, newline=""))) for _, t in own] == rows
    text = (tmp_path / "a.csv").read_bytes().decode("utf-8-sig")
    assert [r["line"] for r in sorted(lines, key=lambda r: r["line_no"])] == [t.removesuffix("\r") for t in text.split("\n")[:-1]]


def test_torn_record_and_empty_file(spark, tmp_path):
    (tmp_path / "feedback_1.csv").write_text(HEADER + "\n" + line("a", text='two\nlines ""quoted""') + "\n" + line("b") + "\n", encoding="utf-8")
    (tmp_path / "feedback_2.csv").write_text("\n\n")
    (tmp_path / "feedback_3.csv").write_text(HEADER + "\n" + line("c").replace('filial"', "filial") + "\n", encoding="utf-8")
    status = {r["file_name"][9]: (r["status"], r["rows"]) for r in feedback.gate(feedback.file_records(spark, str(tmp_path))).collect()}
    assert status == {"1": ("ok", 2), "2": ("empty", 0), "3": ("ok", 1)}
    got = {r["transactionId"]: r["aonde gastou"] for r in feedback.collect(spark, str(tmp_path)).collect()}
    assert got["a"] == 'two\nlines "quoted", filial' and got["b"] == "loja, filial"


def test_first_line_of_a_long_file(spark, tmp_path):
    (tmp_path / "feedback_long.csv").write_text(HEADER + "\n" + "x,y\n" * 3_000_000)
    (tmp_path / "feedback_none.csv").write_text("\n")
    info = {r["file_name"]: r for r in feedback.file_info(spark, str(tmp_path)).collect()}
    # The limit stands on the scan, so its task ends with the first line.
    plan = records.first_line(spark, str(tmp_path / "feedback_long.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "Limit 1" in plan and "Exchange" not in plan.split("Limit 1", 1)[1]
    assert records.read_lines(spark, str(tmp_path)).count() == 3_000_002
    assert info["feedback_long.csv"]["has_header"] and info["feedback_long.csv"]["size"] > 12_000_000
    assert not info["feedback_none.csv"]["has_header"]


def test_ledger(spark, folder):
    ledger = scratch_path(spark, "ledger")
    rows, found = feedback.collect_new(spark, str(folder), ledger)
    assert rows.count() == 3
    feedback.append_ledger(found, ledger)
    assert feedback.collect_new(spark, str(folder), ledger)[0].count() == 0
    (folder / "feedback_2025-02-01.csv").write_text(HEADER + "\n" + line("d") + "\n", encoding="utf-8")
    assert tuple(feedback.status(spark, str(folder), ledger).first()) == (5, 4, 1)
    assert [r["transactionId"] for r in feedback.collect_new(spark, str(folder), ledger)[0].collect()] == ["d"]
    feedback.clear_ledger(spark, ledger)
    assert feedback.collect_new(spark, str(folder), ledger)[0].count() == 4


def test_items(spark, tmp_path):
    base = {"transactionId": "t", "description": "x", "amount": 100.5, "date": "2024-01-01", "more": 1}
    bodies = [{"feedback": {**base, "parcelas": 5}}, {"feedback": [base, {**base, "amount": 0}, {**base, "date": "01/01/2024"}, {**base, "parcelas": 0}]}]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    good, bad = feedback.check_items(feedback.parse_items(df, "body"))
    rows = feedback.to_rows(good)
    assert rows.columns == list(schemas.FEEDBACK_COLUMNS)
    assert sorted((r["valor total"], r["parcelas"]) for r in rows.collect()) == [("100.5", "1"), ("502.5", "5")]
    assert sorted(r["reason"] for r in bad.collect()) == ["amount not positive", "date not ISO", "parcelas below 1"]
    out = str(tmp_path / "saved")
    feedback.save(good, out, "2024-02-01")
    feedback.save(good, out, "2024-02-02")
    assert spark.read.parquet(out).groupBy("ingest_date").count().count() == 2


def test_newest_version_is_the_last_written(spark, tmp_path):
    root = str(tmp_path / "v")
    for name, rows in (("2024-9", 2), ("2024-10", 3)):
        assert sinks.write_version(spark.range(rows), root, name, ["id"])["success"]
    assert sinks.current(spark, root).count() == 3
    assert sinks.drop_old_versions(spark, root, keep=1) == ["2024-9"]


def test_versions(spark):
    root = scratch_path(spark, "root")
    assert sinks.current(spark, root) is None
    df = spark.range(3).withColumn("x", F.lit("a"))
    assert sinks.write_version(df, root, "01", ["id", "x"])["new_rows"] == 3
    assert sinks.write_version(df.limit(0), root, "02", ["id", "x"])["error"] == "written data is empty"
    assert sinks.write_version(df, root, "03", ["x", "id"])["error"] == "written columns differ"
    assert sinks.write_version(df.union(df), root, "04", ["id", "x"]) == {"success": True, "original_rows": 3, "final_rows": 6, "new_rows": 3}
    assert sinks.current(spark, root).count() == 6
    assert [r["v"] for r in sinks.versions(spark, root).collect()] == ["04", "01"]
    assert sinks.drop_old_versions(spark, root, keep=1) == ["01"]
    assert sinks.current(spark, root).count() == 6


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Valor (R$),Descrição\n1,x\n", encoding="utf-8")
    df = files.read_csv_with_headers(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["valor__r__", "descricao"] and df.count() == 1
    assert files.read_csv(spark, str(tmp_path / "a.csv"), ["v", "d"]).first()["d"] == "x"
    assert files.read_positional(spark, str(tmp_path / "a.csv"), ["v", "d"]).count() == 2
    assert [r["c1"] for r in files.read_ordered_csv(spark, str(tmp_path), 2, "a.csv").orderBy("line_no").collect()] == ["Descrição", "x"]
    got = files.profile(spark, str(tmp_path / "a.csv"))
    assert got["exists"] and got["column_count"] == 2 and got["size"] > 0
    assert files.profile(spark, str(tmp_path / "none.csv")) == {"exists": False}
    sinks.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).orderBy("value").collect()[0][0] == "1,"


def test_requests_and_golden(spark, tmp_path):
    request = {"transactions": [{"description": "a", "amount": 1.5, "date": "2024-01-01", "installments": 3}, {"description": "b", "amount": 2.0, "date": "2024-01-01"}],
               "config": {"similarity_threshold": 0.8, "enable_deterministic_rules": True}}
    (tmp_path / "r.json").write_text(json.dumps(request, indent=1))
    rows = files.read_requests(spark, str(tmp_path / "r.json")).orderBy("row_no").collect()
    assert [(r["description"], r["installments"]) for r in rows] == [("a", 3), ("b", None)]
    settings = files.settings_of(rows[0]["config"])
    assert settings == cascade.Settings(similarity_threshold=0.8, use_rules=True)
    golden = {"items": [{"date": "2025-01-01", "description": "x", "amount": "1.00"}], "stats": {"by_card": {"1111": {"control_total": "1,00"}}}, "rejects": [{"line": "l", "reason": "r"}]}
    (tmp_path / "g.json").write_text(json.dumps(golden))
    items, cards, rejects = files.read_golden(spark, str(tmp_path / "g.json"))
    assert (items.first()["pos"], cards.first()["card"], rejects.first()["reason"]) == (0, "1111", "r")
    nested = spark.range(1).select(F.struct(F.lit("a").alias("t")).alias("transaction"), F.struct(F.lit("b").alias("p")).alias("prediction"))
    assert sinks.flatten_predictions(nested).columns == ["t", "p"]


def test_stream_reads_each_file_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "id string, n int"
    run = lambda: feedback_stream.ingest(spark, source, schema, target, checkpoint, ["id"], ["n"])
    spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], schema).write.parquet(source)
    run()
    spark.createDataFrame([("b", 0), ("c", 1)], schema).write.mode("append").parquet(source)
    run()
    run()
    got = sorted((r["id"], r["n"]) for r in feedback_stream.target_table(spark, target).collect())
    assert got == [("a", 0), ("b", 1), ("c", 1)]
    # A batch that is repeated after a failure leaves the same rows.
    at = "timestamp'2024-01-01'"
    again = spark.createDataFrame([("b", 1), ("c", 1)], schema).selectExpr(
        "id", "struct(n) AS __row", f"if(id = 'b', {at}, {at} + interval 1 day) AS __born", f"{at} + interval 1 day AS __latest"
    )
    feedback_stream.append_new(again, 1, target, ["id", "n"])
    assert feedback_stream.target_table(spark, target).count() == 3


def test_stream_asks_only_for_its_own_keys(spark, tmp_path):
    """The target isn't read: it may even have gone."""
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "id long, n int"
    for k in range(3):
        spark.range(k * 50, k * 50 + 100).selectExpr("id", f"{k} AS n").write.mode("append").parquet(source)
        feedback_stream.ingest(spark, source, schema, str(tmp_path / f"out{k}"), checkpoint, ["id"], ["n"])
    assert [feedback_stream.target_table(spark, str(tmp_path / f"out{k}")).count() for k in range(3)] == [100, 50, 50]


def test_monthly_batch(spark, tmp_path):
    card = spark.createDataFrame([("c", i, d, t, v) for i, (d, t, v) in enumerate([("", "Final 0001", ""), ("", "ANA", ""), ("", "Descrição", ""), ("05/01/2024", "Netflix Com (2/3)", "1.044,90"), ("", "Subtotal", "")])],
                                 "doc_id string, line_no long, c0 string, c1 string, c3 string")
    bank = spark.createDataFrame([("b", 0, "Data", "", "", "", "", ""), ("b", 1, "06/01/2024", "Salario", "", "", "", "9,00"), ("b", 2, "", "", "", "", "", ""), ("b", 3, "Total", "", "", "", "", "")],
                                 "doc_id string, line_no long, c0 string, c1 string, c2 string, c3 string, c4 string, c5 string")
    path = str(tmp_path / "all")
    jobs.monthly_batch(card, bank, path, settings=cascade.Settings(use_rules=True))
    rows = {r["tipo"]: r for r in spark.read.parquet(path).collect()}
    assert rows["crédito"]["valor_total"] == "3134,70" and rows["crédito"]["metodo"] == "rules_engine" and rows["crédito"]["data"] == "jan./24"
    assert rows["débito"]["natureza_do_gasto"] == "duvida" and rows["débito"]["aonde_gastou"] == "06/01/2024 - Salario"


def test_retrain(spark, folder, tmp_path):
    root, ledger, saved = scratch_path(spark, "base"), scratch_path(spark, "led"), str(tmp_path / "model")
    rows = [(f"{w} {i}", c) for i in range(12) for w, c in (("netflix com", "S"), ("supermercado abc", "M"), ("posto shell", "P"))]
    base = spark.createDataFrame([(t, c, "10.0", "1", "", "10.0", "crédito", "", "", "base") for t, c in rows], schemas.all_strings(schemas.BASE_COLUMNS))
    sinks.write_version(base, root, "0", schemas.BASE_COLUMNS)
    small = model.Training(features=1 << 10, max_iter=15)
    out = jobs.retrain(spark, str(folder), ledger, root, saved, "1", small, kinds=(model.LOGISTIC,), folds=2)
    assert out["success"] and out["write"]["new_rows"] == 3
    assert out["hold_out"]["f1_macro"].first()[0] > 0.5 and out["cv"].count() == 1
    # The files are committed with the version, the ledger holds none of them.
    assert sinks.committed_files(spark, root).count() == 4 and feedback.read_ledger(spark, ledger).count() == 0
    loaded = model.TextModel.load(saved)
    cases = spark.createDataFrame([("Netflix Com", "S"), ("Posto Shell", "P")], "text string, expected string")
    assert [r["match"] for r in model.check_cases(loaded, cases).collect()] == [True, True]
    assert jobs.retrain(spark, str(folder), ledger, root, saved, "2", small)["error"] == "no corrections to integrate"


class Killed(Exception):
    pass


def test_retrain_survives_a_kill_at_any_step(spark, folder, tmp_path, monkeypatch):
    root, ledger = scratch_path(spark, "base"), scratch_path(spark, "led")
    rows = [(f"{w} {i}", c) for i in range(6) for w, c in (("netflix com", "S"), ("supermercado abc", "M"))]
    base = spark.createDataFrame([(t, c, "10.0", "1", "", "10.0", "crédito", "", "", "base") for t, c in rows], schemas.all_strings(schemas.BASE_COLUMNS))
    sinks.write_version(base, root, "0", schemas.BASE_COLUMNS)
    small = model.Training(features=1 << 8, max_iter=5)
    run = lambda v: jobs.retrain(spark, str(folder), ledger, root, str(tmp_path / "m"), v, small, kinds=(model.LOGISTIC,), folds=2)

    def killed(*_a, **_k):
        raise Killed

    with monkeypatch.context() as m:  # data and files are written, the commit is not
        m.setattr(sinks, "_commit", killed)
        with pytest.raises(Killed):
            run("1")
    assert sinks.current(spark, root).count() == 12 and sinks.committed_files(spark, root).isEmpty()
    with monkeypatch.context() as m:  # committed, not trained
        m.setattr(model.TextModel, "save", killed)
        with pytest.raises(Killed):
            run("1")
    assert sinks.current(spark, root).count() == 15 and sinks.committed_files(spark, root).count() == 4
    assert sinks.version_without_model(spark, root) == "1"
    assert run("2")["resumed"] == "1"
    assert sinks.version_without_model(spark, root) is None and sinks.current(spark, root).count() == 15
    assert run("3")["error"] == "no corrections to integrate"
    assert sinks.write_version(base, root, "1", schemas.BASE_COLUMNS)["error"] == "version exists"


def test_svc_and_auxiliary(spark):
    rows = [(i, f"{w} loja", c, "Final 1") for i, (w, c) in enumerate([("farmacia", "a"), ("mercado", "b"), ("hotel", "c")] * 12)]
    df = spark.createDataFrame(rows, "id int, `aonde gastou` string, tipo string, cartao string")
    fitted = model.fit(df, "aonde gastou", "tipo", "id", model.Training(features=1 << 10, max_iter=15, kind=model.CALIBRATED_SVC))
    out = fitted.predict(df, "aonde gastou", threshold=0.99)
    assert out.filter("confidence >= 0.34").count() == 36 and out.filter("label IS NOT NULL AND confidence < 0.99").count() == 0
    assert abs(out.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s")).first()["s"] - 1.0) < 1e-9
    _, report = model.fit_auxiliary(df, "tipo", "id", card="cartao", training=model.Training(features=1 << 10, max_iter=15))
    assert report.count() == 3


def test_lines_are_not_shuffled_and_consumed_files_not_opened(spark, folder):
    found = records.read_records(spark, str(folder), "*.csv")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    ledger = f"{folder}/ledger"
    _, files = feedback.collect_new(spark, str(folder), ledger)
    feedback.append_ledger(files, ledger)
    again, none = feedback.collect_new(spark, str(folder), ledger)
    assert none.count() == 0 and not [p for p in again.inputFiles() if p.endswith(".csv")]


def test_rows_are_not_shuffled_to_find_repeated_ids(spark, monkeypatch):
    from caderneta.operators import dedup

    written = {}

    def spy(df, name):
        written[name] = materialise(df, name)
        return written[name]

    materialise = feedback.materialise
    monkeypatch.setattr(feedback, "materialise", spy)
    rng = random.Random(2)
    ids = [f"t{rng.randrange(400)}" if i % 9 else None for i in range(300)]
    rows = spark.createDataFrame([(f"f{rng.randrange(5)}", i, x, f"text {i}") for i, x in enumerate(ids)], "file_name string, row_no long, transactionId string, text string")
    rows = rows.repartition(6)
    out = feedback.unique_rows(rows)
    assert {r["transactionId"] for r in written["repeated"].collect()} == {x for x in ids if ids.count(x) > 1}
    want = dedup.first_file_wins(rows, "transactionId", "file_name", ["row_no"])
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.columns == rows.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(transactionId" not in plan


def test_shuffle_files_of_a_write_go_with_it(spark):
    import time
    from concurrent.futures import ThreadPoolExecutor

    from caderneta import session

    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    [key] = session.CLEANED_UP
    setting, before = spark.conf.get(key), shuffled()
    df = spark.range(5000).withColumn("k", F.col("id") % 1009).groupBy("k").agg(F.sum("id").alias("s"))
    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(lambda i: session.materialise(df.withColumn("i", F.lit(i)), "part"), range(6)))
    assert [p.count() for p in parts] == [1009] * 6 and spark.conf.get(key) == setting
    for _ in range(50):
        ids = {n.split("_")[1] for n in shuffled() - before}
        if len(ids) <= 6:  # those of the counts above, which are no writes
            break
        time.sleep(0.2)
    assert len(ids) <= 6, ids
