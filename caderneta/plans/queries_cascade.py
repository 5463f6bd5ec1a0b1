"""Rules and the classification cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from caderneta.functions import text as T
from caderneta.operators import cascade, report, rules
from caderneta.operators.rules import LITERAL, REGEX, Rule
from caderneta.plans.catalog import query
from caderneta.plans.queries_text import normalize_sql
from caderneta.plans.tx import table, transactions, with_tx

# Demo rules over the merchants of the test tables.
DEMO_RULES = (
    Rule("large_anvil", LITERAL, ("anvil",), "Obra casa", 0.95, amount_range=(50_000.0, 200_000.0)),
    Rule("widget", REGEX, ("^(red|blue).*widget$",), "Supermercado", 0.90),
    Rule("parts", LITERAL, ("bolt", "rod"), "Obra casa", 0.85),
    Rule("new_things", REGEX, (r"\bnew\b",), "Gastos com presentes", 0.60),
    Rule("gear_invoice", REGEX, ("gear",), "Carro (Manutenção/ IPVA/ Seguro)", 0.80, origin="fatura"),
    Rule("ring", REGEX, ("ring$",), "Casamento", 0.70),
)
RULE_SQL = """CASE WHEN contains(clean, 'anvil') AND amount BETWEEN 50000 AND 200000 THEN 'large_anvil'
  WHEN regexp_matches(clean, '^(red|blue).*widget$') THEN 'widget'
  WHEN contains(clean, 'bolt') OR contains(clean, 'rod') THEN 'parts'
  WHEN regexp_matches(clean, '\\bnew\\b') THEN 'new_things'
  WHEN regexp_matches(clean, 'gear') AND origem = 'fatura' THEN 'gear_invoice'
  WHEN regexp_matches(clean, 'ring$') THEN 'ring' END"""
CONFIDENCE_SQL = """CASE rule WHEN 'large_anvil' THEN 0.95 WHEN 'widget' THEN 0.9 WHEN 'parts' THEN 0.85
  WHEN 'new_things' THEN 0.6 WHEN 'gear_invoice' THEN 0.8 WHEN 'ring' THEN 0.7 ELSE 0.3 END"""
RULED_SQL = f"""SELECT *, CAST({CONFIDENCE_SQL} AS DOUBLE) AS confidence FROM (
   SELECT tx_id, amount, clean, origem, l_linenumber, l_discount, p_type, {RULE_SQL} AS rule FROM (
     SELECT *, {normalize_sql('merchant')} AS clean FROM tx))"""


def cleaned(spark, sf_dir):
    return transactions(spark, sf_dir).select(
        "tx_id", "amount", T.normalize_description(F.col("merchant")).alias("clean"),
        F.col("origem").alias("origin"), F.lit(None).cast("string").alias("holder"), "l_linenumber", "l_discount", "p_type",
    )


def ruled(df):
    return rules.rules_stage(F.col("clean"), rules=DEMO_RULES, has=("origin", "holder"))


@query(
    "q_tx_rules_method_mix",
    with_tx(
        f"""SELECT CASE WHEN rule IS NULL THEN 'fallback' ELSE 'rules_engine' END AS method_used, count(*) AS n,
              round(100.0 * count(*) / (SELECT count(*) FROM tx), 6) AS pct FROM ({RULED_SQL}) GROUP BY 1"""
    ),
)
def tx_rules_method_mix(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    out = cascade.classify(df, [cascade.ColumnStage("rules_engine", ruled(df))])
    return report.share_of_total(out, "method_used")


@query(
    "q_rule_hits",
    with_tx(f"SELECT COALESCE(rule, 'none') AS rule, count(*) AS n, round(avg(confidence), 6) AS confidence FROM ({RULED_SQL}) GROUP BY 1"),
)
def rule_hits(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    match = rules.first_rule(DEMO_RULES, F.col("clean"), has=("origin", "holder"))
    return df.select(
        F.coalesce(match["rule"], F.lit("none")).alias("rule"), F.coalesce(match["confidence"], F.lit(0.3)).alias("c")
    ).groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("confidence"))


@query(
    "q_rule_table_join",
    with_tx(
        f"SELECT clean, coalesce(rule, 'none') AS rule, count(*) AS n FROM ({RULED_SQL}) GROUP BY 1, 2"
    ),
)
def rule_table_join(spark, sf_dir):
    out = rules.match_rule_table(cleaned(spark, sf_dir), rules.rule_table(spark, DEMO_RULES), "clean", ("amount", "origin", "holder"))
    return out.groupBy("clean", F.coalesce(F.col("rule.rule"), F.lit("none")).alias("rule")).agg(F.count("*").alias("n"))


@query(
    "q_cascade_legacy",
    with_tx(
        f"""SELECT method_used, label, count(*) AS n, round(avg(conf), 6) AS confidence FROM (
             SELECT CASE WHEN rule IS NOT NULL AND confidence >= 0.7 THEN 'rules_engine'
                         WHEN l_linenumber = 1 THEN 'ai_fallback' ELSE 'default' END AS method_used,
                    CASE WHEN rule IS NOT NULL AND confidence >= 0.7 THEN
                      CASE rule WHEN 'large_anvil' THEN 'Obra casa' WHEN 'widget' THEN 'Supermercado' WHEN 'parts' THEN 'Obra casa'
                           WHEN 'gear_invoice' THEN 'Carro (Manutenção/ IPVA/ Seguro)' ELSE 'Casamento' END
                         WHEN l_linenumber = 1 THEN p_type ELSE 'Gastos pessoais' END AS label,
                    CASE WHEN rule IS NOT NULL AND confidence >= 0.7 THEN confidence WHEN l_linenumber = 1 THEN l_discount ELSE 0.1 END AS conf
             FROM ({RULED_SQL})) GROUP BY 1, 2"""
    ),
)
def cascade_legacy(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    reply = F.when(
        F.col("l_linenumber") == 1, F.struct(F.col("p_type").alias("label"), F.col("l_discount").alias("confidence"))
    )
    stages = cascade.legacy_stages(rules=ruled(df), reply=reply)
    out = cascade.classify(df, stages, **cascade.LEGACY_DEFAULT)
    return out.groupBy("method_used", "label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(
    "q_batch_stats",
    with_tx(
        f"""SELECT count(*) AS total, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (confidence < 0.7) AS low_confidence,
              count(*) FILTER (rule IS NULL) AS fallbacks FROM ({RULED_SQL})"""
    ),
)
def batch_stats(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    stats = report.batch_stats(cascade.classify(df, [cascade.ColumnStage("rules_engine", ruled(df))]))
    return stats.select("total", F.round("mean_confidence", 6).alias("mean_confidence"), "low_confidence", "fallbacks")


@query(
    "q_transaction_ids",
    with_tx(
        """SELECT tx_id, CASE WHEN l_linenumber = 1 THEN 'pre' || tx_id WHEN l_linenumber = 2 THEN 'raw' || tx_id
             ELSE CAST(tx_id AS VARCHAR) END AS transaction_id FROM tx"""
    ),
)
def transaction_ids(spark, sf_dir):
    tx = F.col("tx_id").cast("string")
    preloaded = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("pre"), tx)).when(F.col("l_linenumber") == 2, "")
    raw = F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("raw"), tx))
    return transactions(spark, sf_dir).select(
        "tx_id", cascade.transaction_id(preloaded, raw, F.col("tx_id")).alias("transaction_id")
    )


@query(
    "q_rule_table_parts",
    with_tx(
        f"""WITH m AS (SELECT clean, max(amount) AS amount FROM (SELECT amount, {normalize_sql('merchant')} AS clean FROM tx) GROUP BY 1),
              p AS (SELECT p_partkey, {normalize_sql('p_name')} AS name, p_retailprice FROM part)
            SELECT m.clean, coalesce(min(p_partkey), -1) AS rule FROM m
            LEFT JOIN p ON contains(m.clean, p.name) AND (p_partkey % 5 != 0 OR m.amount <= p_retailprice * 10) GROUP BY 1"""
    ),
)
def rule_table_parts(spark, sf_dir):
    """One rule for each part, half of them regular expressions, every fifth with a limit on the amount: thousands of patterns in several blocks."""
    name = T.normalize_description(F.col("p_name"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("priority"), F.col("p_partkey").cast("string").alias("name"),
        F.when(F.col("p_partkey") % 2 == 0, REGEX).otherwise(LITERAL).alias("kind"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("(?:"), F.replace(name, F.lit(" "), F.lit(r"\s")), F.lit(")"))).otherwise(name).alias("pattern"),
        F.lit("Obra casa").alias("category"), F.lit(0.9).alias("confidence"),
        F.when(F.col("p_partkey") % 5 == 0, 0.0).alias("amount_min"),
        F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice") * 10).alias("amount_max"),
        F.lit(None).cast("string").alias("holder"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("int").alias("installments"),
    )
    merchants = cleaned(spark, sf_dir).groupBy("clean").agg(F.max("amount").alias("amount"))
    out = rules.match_rule_table(merchants, parts, "clean", ("amount",), block_bytes=1 << 18)
    return out.select("clean", F.coalesce(F.col("rule.rule").cast("bigint"), F.lit(-1)).alias("rule"))
