"""Statement parsing on written-out statements, layout and exports."""

import pytest
from pyspark.sql import functions as F

from caderneta.operators import automaton, export, layout, recon, statement

# Each statement: its lines, and the items (line, card, month-day, description, amount, flux, installments) it must yield.
STATEMENTS = {
    "one card": (
        ["Fatura 2024", "Lançamentos: compras e saques", "MARIA DA SILVA (final 1111)", "DATA ESTABELECIMENTO VALOR EM R$",
         "05/06 CAFÉ 2,00", "texto solto", "", "11/12 ESTORNO - 6,00 01/02 LOJA 7,00", "09/10 MERCADO 02/03 45,00"],
        [(4, "Final 1111 - MARIA DA SILVA", "06-05", "CAFÉ", "2.00", "Saida", None), (7, "Final 1111 - MARIA DA SILVA", "12-11", "ESTORNO", "6.00", "Entrada", None),
         (7, "Final 1111 - MARIA DA SILVA", "02-01", "LOJA", "7.00", "Saida", None), (8, "Final 1111 - MARIA DA SILVA", "10-09", "MERCADO", "45.00", "Saida", 3)],
    ),
    "no card yet": (
        ["2024", "05/06 BEFORE 1,00", "Lançamentos: compras e saques", "05/06 NOBODY 2,00", "Lançamentos: produtos e serviços", "05/06 FEE 3,00"],
        [(5, None, "06-05", "FEE", "3.00", "Saida", None)],
    ),
    "ignored parts": (
        ["2024", "Lançamentos: compras e saques", "JOÃO SOUZA (final 2222)", "01/02 A 1,00", "Limites de crédito", "02/02 B 2,00",
         "Compras parceladas - próximas faturas", "03/02 C 3,00", "JOÃO SOUZA (final 2222)", "04/02 D 4,00", "Encargos cobrados nesta fatura", "05/02 E 5,00"],
        [(3, "Final 2222 - JOAO SOUZA", "02-01", "A", "1.00", "Saida", None), (5, "Final 2222 - JOAO SOUZA", "02-02", "B", "2.00", "Saida", None),
         (9, "Final 2222 - JOAO SOUZA", "02-04", "D", "4.00", "Saida", None)],
    ),
    "charges inside services": (
        ["2024", "Lançamentos: produtos e serviços", "01/02 A 1,00", "Encargos cobrados nesta fatura", "02/02 B 2,00", "Limites de crédito", "03/02 C 3,00"],
        [(2, None, "02-01", "A", "1.00", "Saida", None), (4, None, "02-02", "B", "2.00", "Saida", None)],
    ),
    "the end": (
        ["2024", "Lançamentos: compras e saques", "MARIA DA SILVA (final 1111)", "01/02 A 1,00", "Total dos lançamentos atuais 1,00", "02/02 B 2,00"],
        [(3, "Final 1111 - MARIA DA SILVA", "02-01", "A", "1.00", "Saida", None)],
    ),
    "cut at the next part": (
        ["2024", "Lançamentos: compras e saques", "MARIA DA SILVA (final 1111)", "02/03 X 4,00 Compras parceladas - próximas faturas", "05/03 Y 1.000,00"],
        [(3, "Final 1111 - MARIA DA SILVA", "03-02", "X", "4.00", "Saida", None), (4, "Final 1111 - MARIA DA SILVA", "03-05", "Y", "1000.00", "Saida", None)],
    ),
    "header with a purchase": (
        ["2024", "Lançamentos: compras e saques", "MARIA DA SILVA (final 1111)", "PEDRO LIMA (final 3333)", "01/02 A 1,00", "MARIA DA SILVA (final 1111) 05/06 LATE 2,00", "06/06 C 3,00"],
        [(4, "Final 3333 - PEDRO LIMA", "02-01", "A", "1.00", "Saida", None), (5, "Final 1111 - MARIA DA SILVA", "06-05", "LATE", "2.00", "Saida", None),
         (6, "Final 1111 - MARIA DA SILVA", "06-06", "C", "3.00", "Saida", None)],
    ),
    "total of another card": (
        ["2024", "Lançamentos: compras e saques", "MARIA DA SILVA (final 1111)", "01/02 A 1,00", "Lançamentos no cartão (final 2222) 9,99", "02/02 B 2,00",
         "MARIA DA SILVA (final 1111)", "03/02 C 3,00"],
        [(3, "Final 1111 - MARIA DA SILVA", "02-01", "A", "1.00", "Saida", None), (5, "Final 2222", "02-02", "B", "2.00", "Saida", None),
         (7, "Final 1111 - MARIA DA SILVA", "02-03", "C", "3.00", "Saida", None)],
    ),
}


@pytest.mark.parametrize("fold", [4, 1024])
def test_written_statements(spark, monkeypatch, fold):
    monkeypatch.setattr(automaton, "ROWS_PER_FOLD", fold)
    monkeypatch.setattr(export, "LINES_PER_CHUNK", fold)
    rows = [(name, n, text) for name, (texts, _) in STATEMENTS.items() for n, text in enumerate(texts)]
    lines = spark.createDataFrame(rows, "doc_id string, line_no long, line string")
    items, rejects, controls = statement.parse(lines, keep_repeats=True)
    got = {}
    for r in items.orderBy("doc_id", "line_no", "match_no").collect():
        got.setdefault(r["doc_id"], []).append(
            (r["line_no"], r["last4"], str(r["date"])[5:], r["description"], str(r["amount"]), r["flux"], r["parcelas"])
        )
    for name, (_, wanted) in STATEMENTS.items():
        assert got.get(name, []) == wanted, name
    assert {(r["doc_id"], r["card"], str(r["control_total"])) for r in controls.collect()} == {("total of another card", "2222", "9.99")}
    assert rejects.count() == 0


def test_year_anywhere_or_reject(spark):
    texts = [*["x"] * 150, "Emitida em 2023", "Lançamentos: produtos e serviços", "01/02 A 1,00"]
    rows = [("late", i, t) for i, t in enumerate(texts)] + [("none", i, t) for i, t in enumerate(texts) if "2023" not in t]
    lines = spark.createDataFrame(rows, "doc_id string, line_no long, line string")
    items, rejects, _ = statement.parse(lines)
    assert [(r["doc_id"], str(r["date"])) for r in items.collect()] == [("late", "2023-02-01")]
    assert [(r["doc_id"], r["reason"]) for r in rejects.collect()] == [("none", "no year")]
    assert {str(r["date"]) for r in statement.parse(lines, 2020)[0].collect()} == {"2023-02-01", "2020-02-01"}


def test_transitions():
    """Rows of the transition table; a state is section * 2 + whether a card is known."""
    s, step = statement, statement.TRANSITIONS
    states = range(s.STOPPED)
    assert all(step[s.OPEN_PURCHASES][x] == s.PURCHASES * 2 + x % 2 for x in states)
    assert all(step[s.OPEN_PRODUCTS][x] == s.PRODUCTS * 2 for x in states)
    assert all(step[s.LEAVE][x] == s.IGNORED * 2 for x in states)
    assert all(step[s.LIMITS][x] == (x if x % 2 else s.IGNORED * 2) for x in states)
    assert all(step[s.STOP][x] == s.STOPPED for x in states)
    assert all(step[s.HEADING][x] == step[s.NOTHING][x] == x for x in states)
    assert all(step[s.HEADER][x] == (s.PURCHASES * 2 + 1 if x // 2 == s.IGNORED else x | 1) for x in states)
    charges = s.CHARGES + s.NOTHING
    assert all(step[charges][x] == (x if x // 2 == s.PRODUCTS else s.IGNORED * 2) for x in states)
    assert all(row[s.STOPPED] == s.STOPPED for row in step)


def test_repeats_rejects_and_recon(spark):
    texts = ["2024", "Lançamentos: compras e saques", "ANA MARIA (final 1234)", "01/02 A 10,00", "01/02 A 10,00", "31/02 B 5,00",
             "02/02 C - 3,00", "Lançamentos no cartão (final 1234) 8,00", "Lançamentos: produtos e serviços", "03/02 SEGURO 1,00"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, line_no long, line string")
    items, rejects, controls = statement.parse(lines)
    assert [(r["line_no"], r["last4"]) for r in items.orderBy("line_no").collect()] == [(3, "Final 1234 - ANA MARIA"), (6, "Final 1234 - ANA MARIA"), (9, None)]
    assert rejects.count() == 1
    out = {r["card"]: (str(r["control_total"]), str(r["calculated_total"]), str(r["delta"])) for r in statement.reconcile(items, controls).collect()}
    assert out == {"1234": ("8.00", "7.00", "1.00"), "unknown": ("0.00", "1.00", "-1.00")}
    summary = recon.document_summary(items, rejects, lines).first()
    assert (summary["lines"], summary["matched"], summary["rejected"], summary["status"]) == (10, 3, 1, "success")


def test_date_regressions(spark):
    rows = [("d", 1, 0, "2025-06-01"), ("d", 2, 0, "2024-12-01"), ("d", 3, 0, "2025-05-01"), ("d", 4, 0, "2025-12-01"), ("d", 5, 0, "2025-06-20")]
    items = spark.createDataFrame(rows, "doc_id string, line_no long, match_no int, d string").withColumn("date", F.to_date("d")).withColumn("last4", F.lit("Final 1111"))
    kept, rejected = statement.reject_date_regressions(items)
    assert sorted(r["line_no"] for r in rejected.collect()) == [2, 5]
    assert kept.count() == 3


def test_simple_items(spark):
    texts = ["Fatura 2023", "10/05  PADARIA BOA (2/3) 12,50", "11/05 AB 3,00", "nada", "12/05 LOJA X - 1.234,56", "13/05 CAFE 4.50"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, line_no long, line string")
    got = [(r["date"], r["description"], str(r["amount"]), r["parcelas"], r["year"]) for r in statement.simple_items(lines, "banco").orderBy("line_no").collect()]
    assert got == [("10/05", "PADARIA BOA (2/3)", "12.50", 3, 2023), ("12/05", "LOJA X", "1234.56", None, 2023), ("13/05", "CAFE", "4.50", None, 2023)]


def test_card_export(spark):
    rows = ["Cartão", "Final 1111", "ANA", "Descrição", "Loja A", "Final 2222", "Final 9999", "x", "Loja B", "Subtotal", "", "Loja C", "Resumo de despesas", "Loja D"]
    raw = spark.createDataFrame([("d", i, "01/01/2024", t, "1,00") for i, t in enumerate(rows)], "doc_id string, line_no long, c0 string, c1 string, c3 string")
    got = [(r["descricao"], r["cartao"]) for r in export.card_rows(raw).orderBy("line_no").collect()]
    assert got == [("Cartão", None), ("Loja A", "Final 1111 - ANA"), ("Loja B", "Final 2222 - Final 9999"), ("Loja C", "Final 2222 - Final 9999")]
    popped = [r["descricao"] for r in export.card_rows(raw, pop_before_summary=True).orderBy("line_no").collect()]
    assert popped == ["Cartão", "Loja A", "Loja B"]


def test_bank_export(spark):
    rows = [("x", None, None, None, None, None), ("Data", "Hist", None, None, "D", "C"), ("05/01/2024", "A", None, None, "1.000,00", None), ("sem data", "B", None, None, None, "-2,50"),
            ("03/01/2024", "C", None, None, None, None), ("09/01/2024", "saldo", None, None, "9,00", None), ("Total", None, None, None, None, None), ("06/01/2024", "Z", None, None, "1,00", None)]
    raw = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc_id string, line_no long, c0 string, c1 string, c2 string, c3 string, c4 string, c5 string")
    got = [(r["descricao"], r["valor"], r["cartao"]) for r in export.bank_rows(raw).orderBy("line_no").collect()]
    label = "CC - 05/01/2024 a 03/01/2024"
    assert got == [("A", "-1000,00", label), ("B", "2,50", label), ("C", "", label)]


def test_layout(spark):
    words = [("01/02", 10, 30, 5.0), ("LOJA", 40, 60, 5.5), ("10,00", 150, 170, 5.2), ("03/02", 300, 320, 5.1), ("BAR", 330, 350, 5.1), ("20,00", 450, 470, 5.3),
             ("02/02", 10, 30, 20.0), ("CAFE", 40, 60, 20.0), ("30,00", 150, 170, 20.0), ("04/02", 300, 320, 40.0), ("PAO", 330, 350, 40.0), ("5,00", 340, 350, 60.0)]
    df = spark.createDataFrame([("d", 1, i, t, float(a), float(b), top) for i, (t, a, b, top) in enumerate(words)],
                               "doc_id string, page int, word_no int, text string, x0 double, x1 double, top double")
    got = [r["line"] for r in layout.lines(df).orderBy("line_no").collect()]
    assert got == ["01/02 LOJA 10,00", "02/02 CAFE 30,00", "03/02 BAR 20,00", "04/02 PAO 5,00"]


def test_category_lines_and_columns(spark):
    texts = ["01/02 LOJA 1,00", "VESTUARIO .SAO PAULO", "VESTUARIO .SAO PAULO", "02/02 BAR 2,00", "texto"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, line_no long, line string")
    assert [r["line_no"] for r in layout.drop_category_lines(lines).orderBy("line_no").collect()] == [0, 2, 3, 4]
    blocks = spark.createDataFrame([("d", None, "left", 0, 0), ("d", "1", "right", 1, 1), ("d", "1", "left", 3, 0), ("d", "1", "right", 4, 1)],
                                   "doc_id string, card string, side string, line_no long, idx int")
    adopted = layout.adopt_unassigned(blocks)
    headers = spark.createDataFrame([("d", "1", 2)], "doc_id string, card string, line_no long")
    ordered = layout.two_column_order(adopted, headers).orderBy("card_rank", "bucket", "major", "minor")
    assert [(r["side"], r["line_no"]) for r in ordered.collect()] == [("left", 0), ("right", 1), ("left", 3), ("right", 4)]


def test_export_parts_are_not_broadcast_by_file_size(spark, monkeypatch):
    from caderneta.plans import queries_statement as Q

    plans = {}

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    written = Q.materialise
    monkeypatch.setattr(Q, "materialise", spy)
    Q.export_card_rows(spark, "/root/testdata/sf0.001")
    assert "SortMergeJoin" in plans["exported"] and "BroadcastHashJoin" not in plans["exported"]


def test_facts_travel_without_texts(spark, monkeypatch):
    """Only the lines themselves hold texts; what is written on the way are facts."""
    written = {}

    def noted(df, name):
        out = materialise(df, name)
        written[name] = out
        return out

    materialise = statement.materialise
    monkeypatch.setattr(statement, "materialise", noted)
    texts, _ = STATEMENTS["one card"]
    lines = spark.createDataFrame([("a", n, t) for n, t in enumerate(texts)], "doc_id string, line_no long, line string")
    items, _, _ = statement.parse(lines, keep_repeats=True)
    assert items.count() == 4
    assert written and not any("line" in df.columns or "norm" in df.columns for df in written.values())


def test_lines_without_year_raise_nothing(spark):
    """A cast of an empty text fails by an exception for every line, so nothing is cast there."""
    from caderneta.functions import dates

    df = spark.createDataFrame([("x",), ("Fatura 2024",), (None,)], "line string").select(dates.year_in_text(F.col("line")).alias("y"))
    assert [r["y"] for r in df.collect()] == [None, 2024, None]
    assert "try_cast" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
