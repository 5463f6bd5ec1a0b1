"""Correction files through gate, ledger and collection; rules, folds, sections and summaries of the jobs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caderneta import schemas
from caderneta.functions import lines as L
from caderneta.functions.numbers import to_ptbr
from caderneta.operators import export, layout, metrics, quality, recon, rules, sampling
from caderneta.plans import jobs
from caderneta.plans.catalog import query
from caderneta.plans.tx import table, transactions, with_tx
from caderneta.session import materialise, scratch_path
from caderneta.sources import feedback, sinks


def corrections(spark, sf_dir):
    """Correction items of all transactions; names hold quotes and line breaks."""
    return transactions(spark, sf_dir).select(
        F.concat_ws("-", "tx_id", "l_partkey", "l_suppkey", "l_quantity", "amount").alias("transactionId"),
        F.concat(F.col("merchant"), F.lit(' "loja"\nfilial')).alias("description"), F.col("amount").cast("double").alias("amount"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.lit("crédito").alias("source"), "card", F.lit("v1").alias("modelVersion"),
        F.lit("2024-01-01T00:00:00").alias("createdAt"), F.col("p_type").alias("category"), "flux", F.lit(None).cast("string").alias("comp"),
        F.col("l_linenumber").cast("int").alias("parcelas"), F.lit(1).alias("numero_parcela"), "l_shipdate",
    )


@query(
    "q_correction_files",
    with_tx(
        """WITH u AS (SELECT DISTINCT tx_id, l_partkey, l_suppkey, l_quantity, amount, p_type, l_linenumber, merchant FROM tx)
           SELECT p_type AS category, count(*) AS n, round(sum(CAST(amount AS DOUBLE) * l_linenumber), 2) AS total,
             count(DISTINCT merchant || ' "loja"' || chr(10) || 'filial') AS names, CAST(0 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS again,
             true AS all_headed FROM u GROUP BY 1"""
    ),
)
def correction_files(spark, sf_dir):
    """Written as compressed CSV files, gated, collected, ledgered; a second look finds no new file and no new row."""
    folder, ledger = scratch_path(spark, "corrections"), scratch_path(spark, "ledger")
    rows = feedback.to_rows(corrections(spark, sf_dir))
    # A compressed file is read by one task, so files are of limited length.
    rows.write.option("header", True).option("escape", '"').option("compression", "gzip").option("maxRecordsPerFile", 500_000).csv(folder)
    found, files = feedback.collect_new(spark, folder, ledger, glob="*.csv.gz")
    found = materialise(found, "collected")
    feedback.append_ledger(files, ledger)
    again = feedback.collect_new(spark, folder, ledger, glob="*.csv.gz")[0].count()
    pending = feedback.status(spark, folder, ledger, "*.csv.gz").first()["pending"]
    headed = feedback.file_info(spark, folder, "*.csv.gz").agg(F.bool_and("has_header")).first()[0]
    total = F.round(F.sum(F.col("`valor total`").cast("double")), 2)
    return found.groupBy(F.col("`natureza do gasto`").alias("category")).agg(
        F.count("*").alias("n"), total.alias("total"), F.count_distinct("`aonde gastou`").alias("names"),
    ).select("*", F.lit(pending).alias("pending"), F.lit(again).cast("long").alias("again"), F.lit(headed).alias("all_headed"))


@query(
    "q_corrections_by_day",
    with_tx(
        """SELECT CASE WHEN l_shipdate < TIMESTAMP '1995-06-01' THEN '2024-02-01' ELSE '2024-02-02' END AS day, count(*) AS n,
             count(*) FILTER (flux = 'Entrada') AS entries FROM tx GROUP BY 1"""
    ),
)
def corrections_by_day(spark, sf_dir):
    """Every call appends a day's files; nothing that was written is touched."""
    folder = scratch_path(spark, "days")
    items = corrections(spark, sf_dir)
    early = F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp")
    feedback.save(items.filter(early).drop("l_shipdate"), folder, "2024-02-01")
    feedback.save(items.filter(~early).drop("l_shipdate"), folder, "2024-02-02")
    return spark.read.parquet(folder).groupBy(F.col("ingest_date").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("flux") == "Entrada").alias("entries")
    )


@query(
    "q_duplicate_ids",
    with_tx("SELECT DISTINCT CAST(tx_id AS VARCHAR) AS id FROM tx WHERE amount > 20000 INTERSECT SELECT CAST(tx_id AS VARCHAR) FROM tx WHERE l_quantity < 30"),
)
def duplicate_ids(spark, sf_dir):
    """Ids of the base that come again as corrections."""
    rows = transactions(spark, sf_dir).withColumn("transactionId", F.col("tx_id").cast("string"))
    found = jobs.duplicates(rows.filter("amount > 20000").select("transactionId"), rows.filter("l_quantity < 30").select("transactionId"))
    return found.select(F.col("transactionId").alias("id"))


KNOWN_SQL = "(SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO')"


@query(
    "q_rule_admission",
    f"""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS pattern, p_type AS category, p_size / 100.0 AS confidence FROM part),
          g AS (SELECT * FROM r WHERE pattern IS NOT NULL AND category IN {KNOWN_SQL}),
          a AS (SELECT category, count(*) AS rules, round(avg(confidence), 6) AS confidence FROM g GROUP BY 1
                UNION ALL SELECT 'all', count(*), round(avg(confidence), 6) FROM g)
        SELECT *, (SELECT count(*) FROM r) - (SELECT count(*) FROM g) AS refused FROM a""",
)
def rule_admission(spark, sf_dir):
    """One rule for each part; those without a pattern or with an unknown category are refused, the rest is counted by category."""
    part = table(spark, sf_dir, "part")
    own = part.select(
        F.col("p_partkey").cast("int").alias("priority"), F.col("p_partkey").cast("string").alias("name"), F.lit(rules.LITERAL).alias("kind"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("pattern"), F.col("p_type").alias("category"),
        (F.col("p_size") / 100.0).alias("confidence"), F.lit(None).cast("double").alias("amount_min"), F.lit(None).cast("double").alias("amount_max"),
        F.lit(None).cast("string").alias("holder"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("int").alias("installments"),
    )
    known = part.filter("p_type <> 'PROMO'").select(F.col("p_type").alias("category")).distinct()
    good, bad = rules.admissible(own, known)
    stats = rules.rule_stats(good).select(
        F.coalesce("category", F.lit("all")).alias("category"), "rules", F.round("mean_confidence", 6).alias("confidence")
    )
    return stats.withColumn("refused", F.lit(bad.count()).cast("long"))


@query(
    "q_frequent_labels",
    "SELECT p_name, count(*) AS n FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING count(*) >= 32) GROUP BY 1",
)
def frequent_labels(spark, sf_dir):
    return quality.frequent_labels(table(spark, sf_dir, "part").select("p_name"), "p_name", 32).groupBy("p_name").agg(F.count("*").alias("n"))


@query(
    "q_document_summary",
    """SELECT l_orderkey AS doc_id, count(*) AS lines, count(*) FILTER (l_returnflag = 'N') AS matched, count(*) FILTER (l_returnflag = 'R') AS rejected,
         CASE WHEN count(*) FILTER (l_returnflag = 'N') > 0 THEN 'success' ELSE 'empty' END AS status FROM lineitem GROUP BY 1""",
)
def document_summary(spark, sf_dir):
    """Orders as documents: lines, items and rejects of each, documents without items too."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_returnflag")
    items, rejects = lines.filter("l_returnflag = 'N'"), lines.filter("l_returnflag = 'R'")
    return recon.document_summary(items, rejects, lines)


# Three made-up models: they give the other class where a digit of a hash is small.
MODELS = {"careful": "2", "average": "4", "hasty": "7"}
MODELS_SQL = " UNION ALL ".join(
    f"""SELECT '{m}' AS model, doc_id, CAST(quality AS VARCHAR) AS truth, CASE WHEN substr(md5('{m}' || doc_id), 1, 1) < '{d}'
        THEN CAST(1 - quality AS VARCHAR) ELSE CAST(quality AS VARCHAR) END AS predicted FROM labels""" for m, d in MODELS.items()
)


@query(
    "q_best_of_folds",
    f"""WITH r AS (SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INT) AS fold FROM labels),
          p AS (SELECT * FROM ({MODELS_SQL}) JOIN r USING (doc_id)),
          c AS (SELECT model, fold, l.label, count(*) FILTER (truth = label AND predicted = label) AS tp, count(*) FILTER (truth = label) AS support,
                  count(*) FILTER (predicted = label) AS pn FROM p, (VALUES ('0'), ('1')) l(label) GROUP BY ALL),
          f AS (SELECT model, fold, avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (support + pn) END) AS f1 FROM c WHERE support > 0 OR pn > 0 GROUP BY ALL),
          m AS (SELECT model, avg(f1) AS f1 FROM f GROUP BY 1)
        SELECT model, round(f1, 6) AS f1_macro, model = (SELECT arg_max(model, f1) FROM m) AS chosen FROM m""",
)
def best_of_folds(spark, sf_dir):
    """Macro F1 of every fold, its mean for each model, and the model that wins."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("truth"))
    folded = sampling.folds(labels, "truth", "doc_id")
    model = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(d).alias("digit")) for m, d in MODELS.items()]))
    rows = folded.select("*", model.alias("m")).select("*", "m.*")
    wrong = F.substring(F.md5(F.concat("model", F.col("doc_id").cast("string"))), 1, 1) < F.col("digit")
    rows = rows.withColumn("predicted", F.when(wrong, (1 - F.col("truth").cast("int")).cast("string")).otherwise(F.col("truth")))
    means = metrics.fold_means(metrics.macro_f1(rows, "truth", "predicted", ["model", "fold"]), ["model"], ["f1_macro"])
    best = metrics.best_model(means).first()["model"]
    return means.select("model", F.round("f1_macro", 6).alias("f1_macro"), (F.col("model") == best).alias("chosen"))


@query(
    "q_noise_and_markers",
    with_tx(
        """SELECT tx_id, l_linenumber IN (1, 2, 3, 7) AS noise,
             CASE l_linenumber WHEN 4 THEN 'total ' WHEN 5 THEN 'start ' ELSE '-' END
               || CASE WHEN l_linenumber IN (4, 5) THEN lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') ELSE '' END AS marker,
             CASE WHEN l_linenumber IN (1, 4) THEN CAST(amount AS DOUBLE) END AS subtotal FROM tx"""
    ),
)
def noise_and_markers(spark, sf_dir):
    """Headings, totals, card starts and plain items, one form for each line number."""
    amount, last4 = to_ptbr(F.col("amount")), F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0")
    forms = [
        F.concat(F.lit("Total da fatura "), amount), F.lit("Vencimento: 10/05/2024"), F.lit("Saldo anterior"),
        F.concat(F.lit("Lançamentos no cartão (final "), last4, F.lit(") "), amount), F.concat(F.lit("5555.XXXX.XXXX."), last4),
        F.concat_ws(" ", F.date_format("l_shipdate", "dd/MM"), "p_name", F.lit("12,50")),
    ]
    line = F.lit("Pagamentos efetuados")
    for number, form in enumerate(forms, 1):
        line = F.when(F.col("l_linenumber") == number, form).otherwise(line)
    rows = transactions(spark, sf_dir).select("tx_id", line.alias("line"))
    marker = L.card_marker(F.col("line"))
    return rows.select(
        "tx_id", L.is_noise(F.col("line")).alias("noise"),
        F.coalesce(F.concat_ws(" ", marker["kind"], marker["last4"]), F.lit("")).alias("m"),
        L.subtotal_value(F.col("line")).cast("double").alias("subtotal"),
    ).select("tx_id", "noise", F.when(F.col("m") == "", "-").otherwise(F.col("m")).alias("marker"), "subtotal")


EXPORT_ORDER = ["tx_id", "l_partkey", "amount", "l_shipdate", "l_quantity", "l_discount", "l_tax"]


@query(
    "q_export_without_last_row",
    with_tx(
        f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(EXPORT_ORDER)}) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS c FROM tx)
            SELECT l_suppkey AS doc_id, p_name AS descricao, count(*) AS n FROM n WHERE rn < c GROUP BY 1, 2"""
    ),
)
def export_without_last_row(spark, sf_dir):
    """Card exports whose last row in front of the summary goes."""
    tx = transactions(spark, sf_dir).withColumn("rn", F.row_number().over(W.partitionBy("l_suppkey").orderBy(*EXPORT_ORDER)))
    items = tx.select(
        F.col("l_suppkey").alias("doc_id"), (F.col("rn") + 2).cast("bigint").alias("line_no"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("c0"), F.col("p_name").alias("c1"), to_ptbr(F.col("amount")).alias("c3"),
    )
    heads = tx.groupBy("l_suppkey", "s_name").agg(F.max("rn").alias("last"))
    texts = [(F.lit(0), F.lit("Final 1234")), (F.lit(1), F.col("s_name")), (F.lit(2), F.lit("Descrição")), (F.col("last") + 3, F.lit("Resumo de despesas"))]
    frame = heads.select(F.col("l_suppkey").alias("doc_id"), F.explode(F.array(*[
        F.struct(n.cast("bigint").alias("line_no"), t.alias("c1")) for n, t in texts
    ])).alias("r")).select("doc_id", "r.line_no", F.lit("").alias("c0"), "r.c1", F.lit("").alias("c3"))
    rows = export.card_rows(materialise(items.unionByName(frame), "card-export"), pop_before_summary=True)
    return rows.groupBy("doc_id", "descricao").agg(F.count("*").alias("n"))


@query(
    "q_union_with_origin",
    with_tx(
        """SELECT 'fatura' AS origem, s_name AS cartao, count(*) AS n FROM tx WHERE origem = 'fatura' GROUP BY ALL
           UNION ALL SELECT 'extrato', s_name, count(*) FROM tx WHERE origem = 'extrato' GROUP BY ALL"""
    ),
)
def union_with_origin(spark, sf_dir):
    """Both kinds of rows in one table that later runs append to."""
    path = scratch_path(spark, "consolidated")
    tx = transactions(spark, sf_dir).select(F.col("s_name").alias("cartao"), "tx_id", F.col("origem").alias("kind"))
    for kind in ("fatura", "extrato"):  # two runs, one table
        card, bank = (tx.filter((F.col("kind") == k) & (F.col("kind") == kind)).drop("kind") for k in ("fatura", "extrato"))
        sinks.append(export.union_with_origin(card, bank), path)
    return spark.read.parquet(path).groupBy("origem", "cartao").agg(F.count("*").alias("n"))


SECTION_SQL = """SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS kind FROM events"""


@query(
    "q_section_slice",
    f"""WITH e AS ({SECTION_SQL}), b AS (SELECT user_id, min(event_id) FILTER (kind = 1) AS a, min(event_id) FILTER (kind = 2) AS z FROM e GROUP BY 1)
        SELECT user_id AS doc_id, event_id AS line_no FROM e JOIN b USING (user_id) WHERE event_id >= a AND (z IS NULL OR event_id <= z)""",
)
def section_slice(spark, sf_dir):
    """Lines from the start of a card to its printed total; users are documents, sign-ups and errors the marks."""
    line = F.when(F.col("event_type") == "signup", "5555.XXXX.XXXX.5678").when(
        F.col("event_type") == "error", "Lançamentos no cartão (final 5678) 10,00"
    ).otherwise("nada")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), line.alias("line"))
    return layout.section_slice(rows, "5678").select("doc_id", "line_no")


@query(
    "q_adopt_unassigned",
    """WITH b AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'Final ' || (event_id % 10000) END AS card FROM events)
       SELECT event_id, COALESCE(card, first_value(card IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '-') AS card FROM b""",
)
def adopt_unassigned(spark, sf_dir):
    """Blocks without a card go to the first card of their document."""
    card = F.when(F.col("event_type") == "signup", F.concat(F.lit("Final "), (F.col("event_id") % 10000).cast("string")))
    blocks = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.lit(0).alias("idx"), "event_id", card.alias("card")
    )
    return layout.adopt_unassigned(blocks).select("event_id", F.coalesce("card", F.lit("-")).alias("card"))


@query(
    "q_structure_check",
    with_tx(
        """SELECT 'complete' AS kind, true AS same, count(*) AS n FROM tx UNION ALL SELECT 'without comp', false, count(*) FROM tx"""
    ),
)
def structure_check(spark, sf_dir):
    """Corrections in the base's columns, and without one of the essential ones; the row counts go through the alignment."""
    rows = feedback.to_rows(corrections(spark, sf_dir))
    out = None
    for kind, incoming in (("complete", rows), ("without comp", rows.drop("comp"))):
        same = quality.same_essentials(rows, incoming, schemas.ESSENTIAL_COLUMNS)
        aligned = quality.align_to(incoming, schemas.BASE_COLUMNS)
        counted = aligned.agg(F.count("aonde gastou").alias("n")).select(F.lit(kind).alias("kind"), F.lit(same).alias("same"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out
