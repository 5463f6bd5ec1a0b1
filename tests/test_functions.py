from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caderneta.functions import dates, fields, lines, numbers, prompts
from caderneta.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "fn, given, wanted",
    [
        (T.scoring_text, "Café DO João (02/12)", "cafe do joao"),
        (T.normalize_description, "06/06/2025 - Drogasil1148", "drogasil1148"),
        (T.normalize_description, "Hb - Loja (04/04)", "loja"),
        (T.normalize_description, "Évo*Usina Ltda (02/03)", "usina ltda"),
        (T.normalize_description, None, ""),
        (T.normalize_description, "PIX Compra  no  bar", "no bar"),
        (T.training_text, "12/01/2024 Compra CARTAO Loja (1/3)", "Loja (1/3)"),
        (T.similarity_text, "04/05 Netflix", "netflix"),
        (T.rule_text, "Pagamento NETFLIX  01/02/2024", "netflix"),
        (T.clean_description, "PIX compra bar", "compra bar"),
        (T.establishment_name, "Pix Loja do Zé - 01/02/2024 (1/2)", "Loja Do Zé"),
        (T.without_controls, " a\x00b\x7f ", "ab"),
        (T.ascii_line, " São   Paulo ☃ ", "Sao Paulo"),
        (numbers.ptbr_to_decimal, "1.333,34", Decimal("1333.34")),
        (numbers.ptbr_to_decimal, "abc", None),
        (numbers.mixed_to_decimal, "12.30", Decimal("12.30")),
        (numbers.mixed_to_decimal, "12,3", Decimal("12.30")),
        (numbers.comma_to_double, "1.333,34", None),
        (numbers.int_or_null, "duvida 3", None),
        (numbers.int_or_null, " 7 ", 7),
        (fields.card_ending, "Final 1234 - X 56789", "5678"),
        (fields.card_ending, "none", None),
        (lines.is_noise, "Vencimento: 10/10", True),
        (lines.is_noise, "Lançamentos no cartão (final 1234) 9,99", False),
        (lines.is_noise, "12/08 LOJA 9,99", False),
        (lines.is_noise, "", True),
        (lines.subtotal_value, "Subtotal 1.234,50", Decimal("1234.50")),
        (lines.line_value, "12/08 BAR 10,80 Lançamentos no cartão (final 1234) 9.139,39", Decimal("9139.39")),
        (lines.line_value, "12/08 BAR -10,80", Decimal("-10.80")),
        (lines.line_value, "nothing", None),
        (lines.split_line, "12/08 BAR 10,80 13/08 LOJA 04/10 20,00", ["12/08 BAR 10,80", "13/08 LOJA 04/10 20,00"]),
        (lines.line_description, "12/08 LOJA BOA 03/10 1.234,56", "LOJA BOA"),
        (lines.line_description, "12/08 123 9,99", ""),
        (lines.line_description, "12/08/2024 *LOJA# R$ 1.234,56 10% parc. c/ juros x", "*LOJA#"),
        (lines.line_description, "12/08 LOJA 11 3456 7890 9,99 Simulação de Compras 1", "LOJA 11 3456 7890"),
        (lines.line_description, "12/08 LOJA 0800 123 4567 9,99", "LOJA"),
        (lines.line_description, "12/08 LOJA PC - 3 OUTRA 9,99", "LOJA"),
    ],
)
def test_scalar(spark, fn, given, wanted):
    assert value(spark, fn(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("(3/12)", (3, 12)), ("[3/12]", (3, 12)), ("x 3/12 y", (3, 12)), ("( 3 / 12 )", (3, 12)),
        ("(5/3)", None), ("(100/200)", None), ("(1/2) (3/4)", (1, 2)), ("none", None), (None, None), ("(0/3)", None),
    ],
)
def test_installments(spark, text, wanted):
    got = value(spark, fields.installments(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [("12/08 LOJA BOA 03/10 99,90", (3, 10)), ("03/10 99,90", None), ("12/08 LOJA COMPRIDA 12/10 9,90", None),
     ("12/08 LOJA 02/03 " + "um nome muito comprido " * 9 + "9,90", (2, 3)), ("05/12 A 1,00", None), ("LOJA 05/12 1,00", (5, 12))],
)
def test_line_installments(spark, text, wanted):
    got = value(spark, lines.line_installments(F.lit(text)))
    assert (tuple(got) if got else None) == wanted


def test_value_prefers_first_before_subtotal(spark):
    line = F.lit("12/08 BAR 10,80 Lançamentos no cartão (final 1234) 9.139,39")
    assert value(spark, lines.line_value(line, prefer_last=False)) == Decimal("10.80")


def test_format(spark):
    assert value(spark, numbers.to_ptbr(F.lit("-9139.39").cast("decimal(18,2)"))) == "-9.139,39"
    assert value(spark, numbers.to_ptbr(F.lit("9139.39").cast("decimal(18,2)"), thousands=False)) == "9139,39"


@pytest.mark.parametrize(
    "text, wanted",
    [("31/12/2024", "2024-12-31"), ("2024-1-5", "2024-01-05"), ("2024-01-05T10:00:00Z", "2024-01-05"), ("31/02/2024", None), ("7/3", "2020-03-07"), ("x", None)],
)
def test_dates(spark, text, wanted):
    assert value(spark, dates.parse_date(F.lit(text), 2020).cast("string")) == wanted


def test_statement_date(spark):
    assert value(spark, dates.statement_date(F.lit("0731/03"), F.lit(2025)).cast("string")) == "2025-03-31"
    assert value(spark, dates.statement_date(F.lit("00/13"), F.lit(2025))) is None


def test_markers(spark):
    assert tuple(value(spark, lines.card_marker(F.lit("LANÇAMENTOS NO CARTÃO (final 1234) 1.000,00")))) == ("total", "1234")
    assert tuple(value(spark, lines.card_marker(F.lit("5555.XXXX.XXXX.9876")))) == ("start", "9876")
    assert value(spark, lines.card_marker(F.lit("12/08 BAR 10,00"))) is None
    assert tuple(value(spark, lines.card_header(F.lit(" MARIA DA SILVA (final 1234)")))) == ("MARIA DA SILVA", "1234")
    assert value(spark, lines.card_header(F.lit("ANA (final 1234)"))) is None


def test_replies(spark):
    assert tuple(value(spark, prompts.parse_reply(F.lit("CATEGORIA: Farmácia\nCONFIANÇA: 0.8")))) == ("Farmácia", 0.8)
    assert tuple(value(spark, prompts.parse_reply(F.lit("CATEGORIA: Farmácia\nCONFIANÇA: alta")))) == ("Farmácia", 0.5)
    assert value(spark, prompts.accepted_reply(F.lit("CATEGORIA: Farmácia\nCONFIANÇA: 0.5"))) is None
    assert tuple(value(spark, prompts.parse_bar_reply(F.lit("Nada|1.7")))) == ("Gastos pessoais", 1.0)
    assert tuple(value(spark, prompts.parse_bar_reply(F.lit("Nada")))) == ("", 0.0)


def test_headers():
    assert T.header_name("﻿ Descrição ") == "descricao"
    assert T.header_name(" Não Sei ", light=True) == "nao sei"


def test_items_are_checked_in_one_pass(spark):
    """Good and refused items come from one reading of the bodies, by the same rules as apart."""
    from caderneta.plans import queries_ingest
    from caderneta.sources import feedback

    bodies = spark.createDataFrame(
        [('{"feedback": {"transactionId": "1", "description": "x", "amount": 2.0, "date": "%s"}}' % d,) for d in ("2024-02-30", "2024-02-29T00:00:00Z", "29/02/2024")],
        "body string",
    )
    checked = feedback.checked_items(feedback.parse_items(bodies, "body"))
    assert [r["reason"] for r in checked.collect()] == ["date not ISO", None, "date not ISO"]
    plan = queries_ingest.feedback_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= 1 and "Union" not in plan


def test_amounts_of_a_line_are_searched_once(spark):
    """``line_value`` looks for amounts once per line."""
    from caderneta.functions import lines as L

    df = spark.createDataFrame([("01/02 A 1,00 Total 99,00",), ("01/02 A 3,00",), ("x",)], "line string")
    got = df.select(L.line_value(F.col("line")).alias("v"))
    assert [r["v"] and float(r["v"]) for r in got.collect()] == [99.0, 3.0, None]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
