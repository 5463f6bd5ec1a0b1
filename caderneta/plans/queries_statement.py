"""Statement queries over lines printed from the transactions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caderneta.functions import lines as L
from caderneta.functions.numbers import to_ptbr
from caderneta.operators import export, layout, ordered, statement
from caderneta.operators.once import evaluate_once
from caderneta.plans.catalog import query
from caderneta.plans.queries_fields import PTBR_TEXT
from caderneta.plans.tx import table, transactions, with_tx
from caderneta.session import materialise, settings


# Sides of joins are broadcast by the size of their rows at run time, never by the size of their files.
MEASURED_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
FOOT = 1 << 40  # number of the first line below all items


def printed(spark, sf_dir):
    """Statement lines of all transactions: one document per order, with heading, card header, items and printed total."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "amount", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    tx = transactions(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), "l_linenumber", "p_name", "amount", "flux", "l_shipdate",
        F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("bigint").alias("rn"),
    )
    digits = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    sign = F.when(F.col("flux") == "Entrada", "- ").otherwise("")
    items = tx.select(
        "doc_id", (F.col("rn") + 2).alias("line_no"),
        F.concat_ws(
            " ", F.date_format("l_shipdate", "dd/MM"), "p_name", F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("/07")),
            F.concat(sign, to_ptbr(F.col("amount"))),
        ).alias("line"),
    )
    signed = F.when(F.col("flux") == "Entrada", -F.col("amount")).otherwise(F.col("amount"))
    docs = tx.groupBy("doc_id").agg(F.sum(signed).alias("total"))
    frame = docs.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("line_no"), F.lit("Fatura 2004 Lançamentos: compras e saques").alias("line")),
                F.struct(F.lit(1).cast("bigint").alias("line_no"), F.concat(F.lit("Maria da Silva (final "), digits, F.lit(")")).alias("line")),
                F.struct(F.lit(2).cast("bigint").alias("line_no"), F.lit("DATA ESTABELECIMENTO VALOR EM R$").alias("line")),
                F.struct((F.lit(FOOT) + 0).alias("line_no"),
                         F.concat(F.lit("Lançamentos no cartão (final "), digits, F.lit(") "), to_ptbr(F.abs("total"))).alias("line")),
                F.struct((F.lit(FOOT) + 1).alias("line_no"), F.lit("Limites de crédito").alias("line")),
                F.struct((F.lit(FOOT) + 2).alias("line_no"), F.lit("Compras parceladas - próximas faturas").alias("line")),
                F.struct((F.lit(FOOT) + 3).alias("line_no"), F.lit("01/02 nunca lido 9,99").alias("line")),
                F.struct((F.lit(FOOT) + 4).alias("line_no"), F.lit("Total dos lançamentos atuais 1,00").alias("line")),
            )
        ).alias("r"),
    ).select("doc_id", "r.*")
    # Statement lines arrive as a table.
    return materialise(items.unionByName(frame), "statement-lines")


ITEMS_SQL = "d AS (SELECT l_orderkey AS doc_id, l_linenumber, p_name, amount, flux, l_shipdate FROM tx)"


@query(
    "q_statement_items",
    with_tx(
        f"""WITH {ITEMS_SQL} SELECT doc_id, strftime(l_shipdate, '2004-%m-%d') AS date, p_name AS description,
              CAST(amount AS DOUBLE) AS amount, 'Final ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || ' - MARIA DA SILVA' AS last4,
              flux, CAST(7 AS BIGINT) AS parcelas, CAST(l_linenumber AS BIGINT) AS numero_parcela FROM d"""
    ),
)
def statement_items(spark, sf_dir):
    items, _, _ = statement.parse(printed(spark, sf_dir), keep_repeats=True)
    return items.select(
        "doc_id", F.col("date").cast("string").alias("date"), "description", F.col("amount").cast("double").alias("amount"),
        "last4", "flux", F.col("parcelas").cast("bigint").alias("parcelas"), F.col("numero_parcela").cast("bigint").alias("numero_parcela"),
    )


@query(
    "q_statement_recon",
    with_tx(
        f"""WITH {ITEMS_SQL}, s AS (SELECT doc_id, sum(CASE WHEN flux = 'Entrada' THEN -amount ELSE amount END) AS t FROM d GROUP BY 1)
            SELECT doc_id, lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS card, CAST(abs(t) AS DOUBLE) AS control_total,
              CAST(t AS DOUBLE) AS calculated_total, CAST(abs(t) - t AS DOUBLE) AS delta FROM s"""
    ),
)
def statement_recon(spark, sf_dir):
    items, _, controls = statement.parse(printed(spark, sf_dir), keep_repeats=True)
    out = statement.reconcile(items, controls)
    return out.select("doc_id", "card", *[F.col(c).cast("double").alias(c) for c in ("control_total", "calculated_total", "delta")])


@query(
    "q_explode_transactions",
    with_tx(
        f"""SELECT tx_id, CAST(0 AS BIGINT) AS match_no, strftime(l_shipdate, '%d/%m') AS date_token, p_name AS description,
              CAST(l_linenumber AS VARCHAR) || '/7' AS installment, CAST(amount AS DOUBLE) AS amount, 'Saida' AS flux FROM tx
            UNION ALL SELECT tx_id, 1, '0731/03', s_name, '-', CAST(amount AS DOUBLE), 'Entrada' FROM tx"""
    ),
)
def explode_transactions(spark, sf_dir):
    line = F.concat_ws(
        " ", F.date_format("l_shipdate", "dd/MM"), "p_name",
        F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("/07")), to_ptbr(F.col("amount")),
        F.lit("0731/03"), "s_name", F.concat(F.lit("- "), to_ptbr(F.col("amount"))),
    )
    rows = transactions(spark, sf_dir).select("tx_id", F.posexplode(L.line_transactions(line)).alias("match_no", "t"))
    rows = evaluate_once(rows, {"i": L.last_installment(F.col("t.text"))})
    number, total, rest = F.col("i.number"), F.col("i.total"), F.col("i.rest")
    return rows.select(
        "tx_id", F.col("match_no").cast("bigint").alias("match_no"), F.col("t.date").alias("date_token"),
        F.trim(F.regexp_replace(rest, r"\s+", " ")).alias("description"),
        F.coalesce(F.when(number.isNotNull(), F.concat_ws("/", number.cast("string"), total.cast("string"))), F.lit("-")).alias("installment"),
        F.abs(statement.ptbr_to_decimal(F.col("t.amount"))).cast("double").alias("amount"),
        statement.flux_from_text(F.col("t.amount")).alias("flux"),
    )


@query(
    "q_line_fields",
    with_tx(
        f"""SELECT tx_id, CAST(amount AS DOUBLE) AS value, CAST(amount AS DOUBLE) AS first_value,
             CAST(l_linenumber AS VARCHAR) || '/7' AS installment, upper(p_name) AS description, 0 AS noise,
             CAST(2 AS BIGINT) AS pieces FROM tx"""
    ),
)
def line_fields(spark, sf_dir):
    amount = to_ptbr(F.col("amount"))
    made = F.concat_ws(
        " ", F.date_format("l_shipdate", "dd/MM"), F.upper("p_name"),
        F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("/07")), amount,
    )
    columns = F.concat_ws(" ", F.date_format("l_shipdate", "dd/MM"), "p_name", amount, F.date_format("l_shipdate", "dd/MM"), "s_name", amount)
    # Lines are printed once, and what several columns read of them is found once.
    rows = evaluate_once(transactions(spark, sf_dir), {"line": made, "both": columns}).select("tx_id", "line", "both")
    line, both = F.col("line"), F.col("both")
    with_subtotal = F.concat(line, F.lit(" Lançamentos no cartão (final 1234) 9,99"))
    rows = evaluate_once(rows, {"parts": L.line_installments(line)})
    parts = F.col("parts")
    return rows.select(
        "tx_id",
        L.line_value(line).cast("double").alias("value"),
        L.line_value(with_subtotal).cast("double").alias("first_value"),
        F.concat_ws("/", parts["number"].cast("string"), parts["total"].cast("string")).alias("installment"),
        L.line_description(line).alias("description"),
        L.is_noise(line).cast("int").alias("noise"),
        F.size(L.split_line(both)).cast("bigint").alias("pieces"),
    )


@query(
    "q_export_card_rows",
    with_tx(
        """SELECT l_suppkey AS doc_id, p_name AS descricao, 'Final ' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') || ' - ' || s_name AS cartao,
             count(*) AS n FROM tx GROUP BY 1, 2, 3"""
    ),
)
def export_card_rows(spark, sf_dir):
    """Exports printed per supplier: card block, item rows, subtotal, summary tail."""
    tx = transactions(spark, sf_dir).select("l_suppkey", "s_name", "p_name", "tx_id", "l_partkey", "amount", "l_shipdate")
    # Written once, as the numbering and both readers of it would join again. The parts go through the driver only if they are
    # small when measured: files of repeated names look ten times smaller than their rows.
    with settings(spark, MEASURED_BROADCAST):
        tx = materialise(tx, "exported")
    place, chunk = ordered.hash_chunk(
        F.col("tx_id"), F.col("l_partkey"), F.col("amount"), F.col("l_shipdate"), digits=ordered.hash_digits(table(spark, sf_dir, "lineitem"))
    )
    tx = ordered.scan(tx.withColumn("place", place), ["l_suppkey"], ["place"], chunk, [ordered.row_number("line")])
    tx = materialise(tx.select("l_suppkey", "s_name", "p_name", "amount", "l_shipdate", "line"), "numbered")
    items = tx.select(
        F.col("l_suppkey").alias("doc_id"), (F.col("line") + 2).alias("line_no"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("c0"), F.col("p_name").alias("c1"), to_ptbr(F.col("amount")).alias("c3"),
    )
    suppliers = tx.groupBy("l_suppkey", "s_name").agg(F.max("line").alias("last"))
    tail = F.col("last") + 3
    texts = [(0, F.concat(F.lit("Final "), F.lpad(F.col("l_suppkey").cast("string"), 4, "0"))), (1, F.col("s_name")), (2, F.lit("Descrição")),
             (tail, F.lit("Subtotal")), (tail + 1, F.lit("Resumo de despesas")), (tail + 2, F.lit("nunca lido"))]
    frame = suppliers.select(
        F.col("l_suppkey").alias("doc_id"),
        F.explode(F.array(*[F.struct((F.lit(n) if isinstance(n, int) else n).cast("bigint").alias("line_no"), t.alias("c1")) for n, t in texts])).alias("r"),
    ).select("doc_id", "r.line_no", F.lit("").alias("c0"), "r.c1", F.lit("").alias("c3"))
    rows = export.card_rows(materialise(items.unionByName(frame), "card-export"))
    return rows.groupBy("doc_id", "descricao", "cartao").agg(F.count("*").alias("n"))


@query(
    "q_layout_lines",
    """WITH p AS (SELECT conv_id AS doc_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2)
       SELECT doc_id, strip_line AS line, count(*) AS n FROM (
         SELECT doc_id, '01/0' || (turn + 1) || ' ' || role || ' 10,00' AS strip_line FROM p
         UNION ALL SELECT doc_id, '02/0' || (turn + 1) || ' right 20,00' FROM p) GROUP BY 1, 2""",
)
def layout_lines(spark, sf_dir):
    """A two-column page per conversation: every turn prints a dated left and right entry on one row."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    day = (F.col("turn") + 1).cast("string")
    left = [(F.concat(F.lit("01/0"), day), 20.0), (F.col("role"), 60.0), (F.lit("10,00"), 150.0)]
    right = [(F.concat(F.lit("02/0"), day), 330.0), (F.lit("right"), 370.0), (F.lit("20,00"), 450.0)]
    cells = [
        F.struct(F.lit(i).alias("word_no"), text.alias("text"), F.lit(x).alias("x0"), F.lit(x + 30.0).alias("x1"), F.lit(dy).alias("dy"))
        for i, ((text, x), dy) in enumerate([*[(c, 0.0) for c in left], *[(c, 0.5) for c in right]])
    ]
    # Right entries of odd turns sit on rows of their own, so both columns have dated first words.
    words = turns.select(
        F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), "turn", F.explode(F.array(*cells)).alias("c")
    ).select(
        "doc_id", "page", "c.word_no", "c.text", "c.x0", "c.x1",
        (F.col("turn") * 20.0 + F.when(F.col("c.dy") > 0, 8.0).otherwise(0.0)).alias("top"),
    )
    return layout.lines(words).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
