"""Numbers, dates, derived fields, prompt text and reply parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from caderneta.functions import dates as D
from caderneta.functions import fields as P
from caderneta.functions import numbers as N
from caderneta.functions import prompts as R
from caderneta.operators.once import evaluate_once
from caderneta.plans.catalog import query
from caderneta.plans.queries_text import rx, strip_sql
from caderneta.plans.tx import table, transactions, with_tx

PTBR_TEXT = "replace(replace(replace(format('{:,.2f}', CAST(amount AS DOUBLE)), ',', '#'), '.', ','), '#', '.')"


@query(
    "q_ptbr_parse_format",
    with_tx(
        f"""SELECT tx_id, {PTBR_TEXT} AS shown,
              CAST(TRY_CAST(replace(replace({PTBR_TEXT}, '.', ''), ',', '.') AS DECIMAL(18,2)) AS DOUBLE) AS parsed,
              CAST(CASE WHEN l_linenumber % 2 = 0
                   THEN TRY_CAST(replace(replace({PTBR_TEXT}, '.', ''), ',', '.') AS DECIMAL(18,2))
                   ELSE amount END AS DOUBLE) AS mixed,
              CASE WHEN TRY_CAST(replace({PTBR_TEXT}, ',', '.') AS DOUBLE) IS NULL THEN 'lost' ELSE 'kept' END AS naive,
              replace({PTBR_TEXT}, '.', '') AS plain
            FROM tx"""
    ),
)
def ptbr_parse_format(spark, sf_dir):
    shown = N.to_ptbr(F.col("amount"))
    either = F.when(F.col("l_linenumber") % 2 == 0, shown).otherwise(F.col("amount").cast("string"))
    return transactions(spark, sf_dir).select(
        "tx_id",
        shown.alias("shown"),
        N.ptbr_to_decimal(shown).cast("double").alias("parsed"),
        N.mixed_to_decimal(either).cast("double").alias("mixed"),
        F.when(N.comma_to_double(shown).isNull(), "lost").otherwise("kept").alias("naive"),
        N.to_ptbr(F.col("amount"), thousands=False).alias("plain"),
    )


@query(
    "q_date_chain",
    """SELECT o_orderkey, CAST(COALESCE(CAST(d AS DATE), DATE '1900-01-01') AS VARCHAR) AS parsed FROM (
         SELECT o_orderkey, CASE o_orderkey % 5
             WHEN 4 THEN NULL
             WHEN 3 THEN make_date(2024, month(o_orderdate), least(day(o_orderdate), 28))
             ELSE CAST(o_orderdate AS DATE) END AS d
         FROM orders)""",
)
def date_chain(spark, sf_dir):
    short = F.concat_ws(
        "/",
        F.lpad(F.least(F.dayofmonth("o_orderdate"), F.lit(28)).cast("string"), 2, "0"),
        F.date_format("o_orderdate", "MM"),
    )
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
        .when(kind == 3, short)
        .otherwise(F.lit("31/02/2024"))
    )
    parsed = F.coalesce(D.parse_date(text, 2024), F.lit("1900-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed.cast("string").alias("parsed"))


@query(
    "q_date_tokens",
    with_tx(
        """SELECT tx_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS full_date,
             CASE WHEN NOT (month(l_shipdate) = 2 AND day(l_shipdate) = 29) THEN strftime(l_shipdate, '2001-%m-%d') END AS short_date,
             strftime(l_shipdate, '2004-%m-%d') AS glued_date,
             CAST(year(l_shipdate) AS BIGINT) AS guessed_year
           FROM tx"""
    ),
)
def date_tokens(spark, sf_dir):
    short = F.concat(F.date_format("l_shipdate", "dd/MM"), F.col("merchant"), F.lit(" 10,00"))
    glued = F.concat(F.lit("07"), F.date_format("l_shipdate", "dd/MM"))
    return (
        transactions(spark, sf_dir)
        .select(
            "tx_id",
            D.date_token(F.col("descr"), F.lit(1999)).cast("string").alias("full_date"),
            D.date_token(short, F.lit(2001)).cast("string").alias("short_date"),
            D.statement_date(glued, F.lit(2004)).cast("string").alias("glued_date"),
            F.year(D.date_in_description(F.col("descr"))).cast("bigint").alias("guessed_year"),
        )
    )


@query(
    "q_month_label",
    """SELECT CAST(month(o_orderdate) AS BIGINT) AS month_no, strftime(o_orderdate, '%y') AS yy,
         lower(strftime(o_orderdate, '%b./%y')) AS label, count(*) AS n,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders GROUP BY 1, 2, 3""",
)
def month_label(spark, sf_dir):
    label, month, yy = D.month_columns(F.col("o_orderdate"))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(month.cast("bigint").alias("month_no"), yy.alias("yy"), label.alias("label"))
        .agg(F.count("*").alias("n"), F.sum(N.money(F.col("o_totalprice"))).cast("double").alias("total"))
    )


@query(
    "q_signed_amount",
    with_tx(
        """SELECT tx_id, CAST(CASE WHEN l_returnflag = 'R' THEN -amount ELSE amount END AS DOUBLE) AS signed,
             CASE WHEN l_returnflag = 'R' THEN 'Entrada' ELSE 'Saida' END AS flux,
             CAST(amount AS DOUBLE) AS absolute FROM tx"""
    ),
)
def signed_amount(spark, sf_dir):
    debit = F.when(F.col("l_returnflag") == "R", F.col("amount"))
    signed = N.signed_amount(debit, F.col("amount"))
    return transactions(spark, sf_dir).select(
        "tx_id", signed.cast("double").alias("signed"), N.flux(signed).alias("flux"),
        F.abs(signed).cast("double").alias("absolute"),
    )


@query(
    "q_installment_total",
    with_tx(
        """SELECT tx_id, CAST(CASE WHEN l_linenumber = 7 THEN amount ELSE amount * CAST(l_linenumber AS DECIMAL(18,0)) END AS DOUBLE) AS total
           FROM tx"""
    ),
)
def installment_total(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 7, "duvida 7").otherwise(F.col("l_linenumber").cast("string"))
    total = N.installment_total(N.int_or_null(text), F.col("amount"), F.col("amount"))
    return transactions(spark, sf_dir).select("tx_id", total.cast("double").alias("total"))


# The form of the token turns with the order: (n/m), [n / m], n/m, an impossible pair, none.
INSTALLMENT_SQL = """
  SELECT tx_id,
    CASE l_orderkey % 5 WHEN 3 THEN '-' WHEN 4 THEN '-' ELSE CAST(l_linenumber AS VARCHAR) || '/' ||
      CASE l_orderkey % 5 WHEN 0 THEN '7' ELSE '12' END END AS checked,
    CASE WHEN l_orderkey % 5 IN (0, 1) THEN CAST(l_linenumber AS VARCHAR)
         WHEN l_orderkey % 5 = 3 THEN '13' ELSE '-' END AS bracketed
  FROM tx"""


@query("q_installments", with_tx(INSTALLMENT_SQL))
def installments(spark, sf_dir):
    kind, number = F.col("l_orderkey") % 5, F.col("l_linenumber").cast("string")
    text = F.concat(
        F.col("p_name"),
        F.when(kind == 0, F.concat(F.lit(" ("), F.lpad(number, 2, "0"), F.lit("/07)")))
        .when(kind == 1, F.concat(F.lit(" [ "), number, F.lit(" / 12 ] 5/9")))
        .when(kind == 2, F.concat(F.lit(" "), number, F.lit("/12 fim")))
        .when(kind == 3, F.lit(" (13/7)"))
        .otherwise(F.lit(" (100/200)")),
    )
    rows = evaluate_once(
        transactions(spark, sf_dir), {"parsed": P.installments(text), "simple": P.bracketed_installments(text)}
    )
    pair = F.concat_ws("/", F.col("parsed.number").cast("string"), F.col("parsed.total").cast("string"))
    return rows.select(
        "tx_id", F.when(F.col("parsed").isNull(), "-").otherwise(pair).alias("checked"),
        F.coalesce(F.col("simple.number").cast("string"), F.lit("-")).alias("bracketed"),
    )


@query(
    "q_last4_holder",
    with_tx(
        """SELECT card, list_last(regexp_extract_all(card, '[0-9]{4}')) AS ending,
             CASE WHEN l_suppkey % 3 = 0 THEN 'ana' WHEN l_suppkey % 3 = 1 THEN 'bia' ELSE '-' END AS holder,
             'Final ' || list_last(regexp_extract_all(card, '[0-9]{4}')) || CASE WHEN l_suppkey % 3 = 0 THEN ' - ana'
                WHEN l_suppkey % 3 = 1 THEN ' - bia' ELSE '' END AS label, count(*) AS n
           FROM tx GROUP BY ALL"""
    ),
)
def last4_holder(spark, sf_dir):
    who = F.when(F.col("l_suppkey") % 3 == 0, " ANA").when(F.col("l_suppkey") % 3 == 1, " Bia").otherwise("")
    cards = (
        transactions(spark, sf_dir)
        .groupBy("card", F.concat(F.col("card"), who).alias("text"))
        .agg(F.count("*").alias("n"))
    )
    ending, holder = P.card_ending(F.col("text")), P.holder_of(F.col("text"))
    return cards.select(
        "card", ending.alias("ending"), F.coalesce(holder, F.lit("-")).alias("holder"),
        P.card_label(ending, holder).alias("label"), "n",
    )


CARD_TEXT_SQL = """CASE l_suppkey % 6 WHEN 0 THEN 'CC - conta' WHEN 1 THEN 'Final 0001 - Ana' WHEN 2 THEN 'Final 0002 - ANA'
   WHEN 3 THEN 'Final 0009 - Bia' WHEN 4 THEN 'Cartao Casa 0004' ELSE 'Final 0005 - Caio' END"""


@query(
    "q_card_type_share",
    with_tx(
        f"""SELECT card_text, CASE WHEN card_text LIKE 'CC -%' THEN 'débito' ELSE '-' END AS card_type,
              CASE WHEN upper(card_text) LIKE '%CASA%' THEN 'planilha comp' ELSE '-' END AS card_share,
              CASE origem WHEN 'fatura' THEN 'crédito' ELSE 'débito' END AS origin_type,
              CASE card_text WHEN 'Cartao Casa 0004' THEN 'planilha comp' WHEN 'Final 0009 - Bia' THEN 'planilha comp'
                WHEN 'Final 0001 - Ana' THEN 'Gastos Ana' WHEN 'Final 0002 - ANA' THEN 'Gastos Ana'
                WHEN 'Final 0005 - Caio' THEN 'Gastos Caio' ELSE '' END AS text_share,
              CASE card_text WHEN 'Final 0009 - Bia' THEN 'planilha comp' WHEN 'Final 0001 - Ana' THEN 'planilha comp'
                WHEN 'Final 0002 - ANA' THEN 'gastos ana' WHEN 'Final 0005 - Caio' THEN '' ELSE 'duvida x' END AS share,
              CASE WHEN upper(card_text) LIKE '%CASA%' THEN 0.9 ELSE 0.7 END AS confidence,
              count(*) AS n
            FROM (SELECT {CARD_TEXT_SQL} AS card_text, origem FROM tx) GROUP BY ALL"""
    ),
)
def card_type_share(spark, sf_dir):
    labels = ["CC - conta", "Final 0001 - Ana", "Final 0002 - ANA", "Final 0009 - Bia", "Cartao Casa 0004", "Final 0005 - Caio"]
    picked = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("l_suppkey") % 6 + 1).cast("int"))
    grouped = transactions(spark, sf_dir).groupBy(picked.alias("card_text"), "origem").agg(F.count("*").alias("n"))
    card = F.col("card_text")
    rule = F.when(P.card_share(card).isNotNull(), "casa_keyword").otherwise("other")
    return grouped.select(
        "card_text",
        F.coalesce(P.card_type(card)["label"], F.lit("-")).alias("card_type"),
        F.coalesce(P.card_share(card)["label"], F.lit("-")).alias("card_share"),
        P.origin_type(F.col("origem")).alias("origin_type"),
        P.share_from_card_text(card).alias("text_share"),
        P.adjusted_share(F.lit("duvida x"), card).alias("share"),
        P.rule_confidence(rule).alias("confidence"),
        "n",
    )


PLACE_SQL = strip_sql(rx("upper(merchant)", "[-–—]"))


@query(
    "q_prompt",
    with_tx(
        f"""SELECT md5(concat_ws(chr(10), {R.sql_literal(R.PROMPT_HEAD)}, '"' || merchant || '"', '', {R.sql_literal(R.PLACE_HEAD)},
               '"' || upper(substr(place, 1, 1)) || lower(substr(place, 2, position(' ' IN place) - 1))
                   || upper(substr(place, position(' ' IN place) + 1, 1)) || lower(substr(place, position(' ' IN place) + 2)) || '"',
               '', {R.sql_literal(R.PROMPT_TAIL)})) AS prompt_md5, count(*) AS n
            FROM (SELECT merchant, {PLACE_SQL} AS place FROM tx) GROUP BY ALL"""
    ),
)
def prompt(spark, sf_dir):
    text = R.classification_prompt(F.col("merchant"))
    per_merchant = transactions(spark, sf_dir).groupBy("merchant").agg(F.count("*").alias("n"))
    return per_merchant.select(F.md5(text).alias("prompt_md5"), "n")


@query(
    "q_parse_reply",
    with_tx(
        """SELECT tx_id, p_type AS category,
             CASE l_linenumber % 3 WHEN 0 THEN 0.5 ELSE round(l_discount * 10, 6) END AS confidence,
             CASE WHEN CASE l_linenumber % 3 WHEN 0 THEN 0.5 ELSE round(l_discount * 10, 6) END > 0.5 THEN p_type ELSE 'none' END AS accepted,
             CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type ELSE 'Gastos pessoais' END AS legacy_category,
             least(1.0, round(l_discount * 100, 6)) AS legacy_confidence
           FROM tx"""
    ),
)
def parse_reply(spark, sf_dir):
    number = F.when(F.col("l_linenumber") % 3 == 0, "alta").otherwise(F.round(F.col("l_discount") * 10, 6).cast("string"))
    reply = F.concat(F.lit("Analise\n CATEGORIA: "), F.col("p_type"), F.lit("\nCONFIANÇA: "), number)
    bar = F.concat(F.col("p_type"), F.lit(" | "), F.round(F.col("l_discount") * 100, 6).cast("string"))
    parsed = R.parse_reply(reply)
    legacy = R.parse_bar_reply(bar, ["PROMO", "SMALL"])
    return transactions(spark, sf_dir).select(
        "tx_id",
        parsed["category"].alias("category"),
        F.round(parsed["confidence"], 6).alias("confidence"),
        F.coalesce(R.accepted_reply(reply)["category"], F.lit("none")).alias("accepted"),
        legacy["category"].alias("legacy_category"),
        F.round(legacy["confidence"], 6).alias("legacy_confidence"),
    )


@query(
    "q_softmax_scores",
    """SELECT vec_id, dim, round(exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id), 6) AS p,
         round(1 / (1 + exp(-s)), 6) AS sigmoid, CASE WHEN s < 0 THEN 0.0 ELSE least(s, 1.0) END AS clamped
       FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS s FROM embeddings)""",
)
def softmax_scores(spark, sf_dir):
    scores = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scores.alias("s"))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip("s", N.softmax(F.col("s")).alias("p"))).alias("at", "x"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("bigint").alias("dim"), F.round("x.p", 6).alias("p"),
        F.round(N.sigmoid(F.col("x.s")), 6).alias("sigmoid"), N.clamp01(F.col("x.s")).alias("clamped"),
    )
