"""Totals, reconciliation, differences, set operations and reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caderneta.functions.numbers import money
from caderneta.operators import dedup, overrides, quality, recon, report
from caderneta.plans.catalog import query
from caderneta.plans.tx import table, transactions, with_tx


def dbl(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


@query(
    "q_flux_sums",
    with_tx(
        """SELECT card, CAST(COALESCE(sum(amount) FILTER (flux = 'Saida'), 0) AS DOUBLE) AS saida,
             CAST(COALESCE(sum(amount) FILTER (flux = 'Entrada'), 0) AS DOUBLE) AS entrada,
             CAST(sum(CASE WHEN flux = 'Saida' THEN amount ELSE -amount END) AS DOUBLE) AS net,
             CAST(sum(amount) AS DOUBLE) AS gross, count(*) AS matched FROM tx GROUP BY 1"""
    ),
)
def flux_sums(spark, sf_dir):
    totals = recon.flux_totals(transactions(spark, sf_dir).select("card", "amount", "flux"), ["card"])
    return totals.select("card", *dbl("saida", "entrada", "net", "gross"), "matched")


# Printed totals: the order totals of each customer's nation stand in for a statement's controls.
CONTROL_SQL = """c AS (SELECT right(card4, 4) AS card_no, sum(net) + CASE WHEN min(l_suppkey) % 3 = 0 THEN 1.50 ELSE 0 END AS control_total
   FROM (SELECT substr(card, 7, 4) AS card4, l_suppkey, CASE WHEN flux = 'Saida' THEN amount ELSE -amount END AS net FROM tx)
   WHERE l_suppkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT 'none', 12.34),
   k AS (SELECT substr(card, 7, 4) AS card_no, sum(CASE WHEN flux = 'Saida' THEN amount ELSE -amount END) AS calculated_total FROM tx GROUP BY 1),
   r AS (SELECT card_no, COALESCE(control_total, 0) AS control_total, COALESCE(calculated_total, 0) AS calculated_total,
           COALESCE(control_total, 0) - COALESCE(calculated_total, 0) AS delta FROM k FULL JOIN c USING (card_no))"""


def _recon(spark, sf_dir, absolute=False):
    tx = transactions(spark, sf_dir).select(
        recon.card_key(F.col("card")).alias("card_no"), "amount", "flux", "l_suppkey"
    )
    signed = F.when(F.col("flux") == "Saida", F.col("amount")).otherwise(-F.col("amount"))
    off = F.when(F.min("l_suppkey") % 3 == 0, F.lit("1.50")).otherwise(F.lit("0")).cast("decimal(18,2)")
    controls = (
        tx.filter(F.col("l_suppkey") % 5 != 0).groupBy("card_no")
        .agg(money(F.sum(signed) + off).alias("control_total"))
    )
    extra = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(
        F.lit("none").alias("card_no"), F.lit("12.34").cast("decimal(18,2)").alias("control_total")
    )
    return recon.reconcile(tx, controls.unionByName(extra), ["card_no"], absolute)


@query(
    "q_card_recon",
    with_tx(f"""WITH {CONTROL_SQL} SELECT card_no, CAST(control_total AS DOUBLE) AS control_total,
       CAST(calculated_total AS DOUBLE) AS calculated_total, CAST(delta AS DOUBLE) AS delta FROM r"""),
)
def card_recon(spark, sf_dir):
    return _recon(spark, sf_dir).select("card_no", *dbl("control_total", "calculated_total", "delta"))


@query(
    "q_card_recon_absolute",
    with_tx(f"WITH {CONTROL_SQL} SELECT card_no, CAST(abs(delta) AS DOUBLE) AS delta FROM r"),
)
def card_recon_absolute(spark, sf_dir):
    return _recon(spark, sf_dir, absolute=True).select("card_no", *dbl("delta"))


@query(
    "q_recon_ok",
    with_tx(f"""WITH {CONTROL_SQL} SELECT CAST(card_no = 'none' AS BIGINT) AS extra, CAST(bool_and(abs(delta) <= 0.01) AS BIGINT) AS ok,
       count(*) FILTER (abs(delta) > 0.01) AS cards_off FROM r GROUP BY 1"""),
)
def recon_ok(spark, sf_dir):
    checked = recon.within_tolerance(
        _recon(spark, sf_dir).withColumn("extra", (F.col("card_no") == "none").cast("bigint")), ["extra"]
    )
    return checked.select("extra", F.col("ok").cast("bigint").alias("ok"), "cards_off")


# Two versions of the same list: rows dropped, changed and added by simple arithmetic on the id. Rows with equal ids are told apart by their position.
VERSIONS_SQL = """a AS (SELECT tx_id, row_number() OVER (PARTITION BY tx_id ORDER BY merchant, amount, card) AS pos,
                 merchant AS description, amount, card FROM tx),
  b AS (SELECT tx_id, pos, CASE WHEN tx_id % 19 = 4 THEN description || '!' ELSE description END AS description,
               CASE WHEN tx_id % 10 = 3 THEN amount + 1 ELSE amount END AS amount,
               CASE WHEN tx_id % 13 = 5 THEN 'Final 0000' ELSE card END AS card FROM a WHERE tx_id % 97 <> 0
        UNION ALL SELECT -1 - tx_id, pos, description, amount, card FROM a WHERE tx_id % 89 = 1)"""


def _versions(spark, sf_dir):
    inside = W.partitionBy("tx_id").orderBy("merchant", "amount", "card")
    a = transactions(spark, sf_dir).select(
        "tx_id", F.row_number().over(inside).cast("bigint").alias("pos"), F.col("merchant").alias("description"), "amount", "card"
    )
    tx = F.col("tx_id")
    changed = a.filter(tx % 97 != 0).select(
        "tx_id", "pos",
        F.when(tx % 19 == 4, F.concat("description", F.lit("!"))).otherwise(F.col("description")).alias("description"),
        money(F.when(tx % 10 == 3, F.col("amount") + 1).otherwise(F.col("amount"))).alias("amount"),
        F.when(tx % 13 == 5, "Final 0000").otherwise(F.col("card")).alias("card"),
    )
    added = a.filter(tx % 89 == 1).withColumn("tx_id", -1 - tx)
    return a, changed.unionByName(added)


@query(
    "q_snapshot_diff",
    with_tx(
        f"""WITH {VERSIONS_SQL}
        SELECT tx_id, pos, CASE WHEN b.tx_id IS NULL THEN 'missing' WHEN a.tx_id IS NULL THEN 'extra' ELSE 'mismatch' END AS kind,
          CASE WHEN a.tx_id IS NULL OR b.tx_id IS NULL THEN '-' WHEN a.description <> b.description THEN 'description'
               WHEN a.amount <> b.amount THEN 'amount' ELSE 'card' END AS field,
          CASE WHEN a.tx_id IS NULL OR b.tx_id IS NULL THEN '-' WHEN a.description <> b.description THEN b.description
               WHEN a.amount <> b.amount THEN CAST(b.amount AS VARCHAR) ELSE b.card END AS actual
        FROM a FULL JOIN b USING (tx_id, pos)
        WHERE a.description IS DISTINCT FROM b.description OR a.amount IS DISTINCT FROM b.amount OR a.card IS DISTINCT FROM b.card"""
    ),
)
def snapshot_diff(spark, sf_dir):
    expected, actual = _versions(spark, sf_dir)
    diff = recon.positional_diff(expected, actual, ["tx_id", "pos"], ["description", "amount", "card"])
    return diff.select(
        "tx_id", "pos", "kind", F.coalesce("field", F.lit("-")).alias("field"), F.coalesce("actual", F.lit("-")).alias("actual")
    )


@query(
    "q_keyed_diff",
    with_tx(
        f"""WITH {VERSIONS_SQL},
        x AS (SELECT description, amount, max_by(card, (tx_id, pos)) AS expected FROM a GROUP BY 1, 2),
        y AS (SELECT description, amount, max_by(card, (tx_id, pos)) AS actual FROM b GROUP BY 1, 2)
        SELECT description, CAST(amount AS DOUBLE) AS amount, expected, actual FROM x JOIN y USING (description, amount)
        WHERE expected <> actual"""
    ),
)
def keyed_diff(spark, sf_dir):
    expected, actual = _versions(spark, sf_dir)
    diff = recon.keyed_diff(expected, actual, ["description", "amount"], "card", ["tx_id", "pos"])
    return diff.select("description", *dbl("amount"), "expected", "actual")


@query(
    "q_set_diff",
    with_tx(
        f"""WITH {VERSIONS_SQL}, x AS (SELECT description, amount, card FROM a), y AS (SELECT description, amount, card FROM b)
        SELECT description, CAST(amount AS DOUBLE) AS amount, card, 'missing' AS side FROM (SELECT * FROM x EXCEPT SELECT * FROM y)
        UNION ALL SELECT description, CAST(amount AS DOUBLE), card, 'extra' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)"""
    ),
)
def set_diff(spark, sf_dir):
    expected, actual = _versions(spark, sf_dir)
    diff = recon.set_diff(expected, actual, ["description", "amount", "card"])
    return diff.select("description", *dbl("amount"), "card", "side")


@query(
    "q_intersect_ids",
    with_tx(
        """SELECT merchant || '_' || CAST(amount AS VARCHAR) || '_' || origem AS combo FROM tx WHERE l_linenumber <= 3
           INTERSECT SELECT merchant || '_' || CAST(amount AS VARCHAR) || '_' || origem FROM tx WHERE l_linenumber > 2"""
    ),
)
def intersect_ids(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    combo = F.concat_ws("_", "merchant", F.col("amount").cast("string"), "origem").alias("combo")
    return tx.filter("l_linenumber <= 3").select(combo).intersect(tx.filter("l_linenumber > 2").select(combo))


@query(
    "q_schema_align_union",
    """SELECT source, count(*) AS n, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) FILTER (status = '') AS blank FROM (
         SELECT 'base' AS source, CAST(o_totalprice AS VARCHAR) AS total, o_orderstatus AS status FROM orders
         UNION ALL SELECT '', CAST(l_extendedprice AS VARCHAR), '' FROM lineitem) GROUP BY 1""",
)
def schema_align_union(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(
        F.lit("base").alias("source"), F.col("o_totalprice").cast("string").alias("total"), F.col("o_orderstatus").alias("status")
    )
    incoming = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").cast("string").alias("total"), "l_shipdate", "l_tax"
    )
    merged = base.unionByName(quality.align_to(incoming, base.columns))
    return merged.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(money(F.col("total"))).cast("double").alias("total"),
        F.count_if(F.col("status") == "").alias("blank"),
    )


@query(
    "q_new_categories",
    """SELECT l_partkey || '/' || l_suppkey AS category FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'
       EXCEPT SELECT l_partkey || '/' || l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'""",
)
def new_categories(spark, sf_dir):
    category = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("category")
    rows = table(spark, sf_dir, "lineitem").select(category, (F.year("l_shipdate") >= 1997).alias("later"))
    return report.new_categories(rows.filter("not later"), rows.filter("later"), "category")


@query(
    "q_balance",
    with_tx(
        """WITH b AS (SELECT p_brand || p_type || p_name AS c FROM tx WHERE year(l_shipdate) < 1998),
             f AS (SELECT p_brand || p_type || p_name AS c FROM tx WHERE year(l_shipdate) >= 1998)
           SELECT (SELECT count(DISTINCT c) FROM b) AS base_categories, (SELECT count(DISTINCT c) FROM f) AS feedback_categories,
             (SELECT count(DISTINCT c) FROM f WHERE c NOT IN (SELECT c FROM b)) AS new_categories,
             (SELECT count(*) FROM f) AS feedback_rows"""
    ),
)
def balance(spark, sf_dir):
    tx = transactions(spark, sf_dir).select(
        F.concat("p_brand", "p_type", "p_name").alias("c"), F.year("l_shipdate").alias("y")
    )
    return report.balance(tx.filter("y < 1998"), tx.filter("y >= 1998"), "c")


@query(
    "q_balance_rows",
    with_tx(
        """SELECT p_brand || p_type || p_name AS category, count(*) FILTER (year(l_shipdate) < 1998) AS base,
             count(*) FILTER (year(l_shipdate) >= 1998) AS feedback FROM tx GROUP BY 1"""
    ),
)
def balance_rows(spark, sf_dir):
    tx = transactions(spark, sf_dir).select(
        F.concat("p_brand", "p_type", "p_name").alias("c"), F.year("l_shipdate").alias("y")
    )
    return report.balance_rows(tx.filter("y < 1998"), tx.filter("y >= 1998"), "c")


@query(
    "q_dup_groups",
    "SELECT md5(text) AS text_md5, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def dup_groups(spark, sf_dir):
    return dedup.duplicate_groups(table(spark, sf_dir, "documents"), [F.md5("text").alias("text_md5")])


@query(
    "q_dup_transactions",
    with_tx(
        """SELECT year(l_shipdate) AS yr, merchant AS descr, CAST(round(amount, -2) AS DOUBLE) AS value, count(*) AS copies
           FROM tx GROUP BY 1, 2, 3 HAVING count(*) > 1"""
    ),
)
def dup_transactions(spark, sf_dir):
    keys = [
        F.year("l_shipdate").cast("bigint").alias("yr"), F.col("merchant").alias("descr"),
        F.round("amount", -2).cast("double").alias("value"),
    ]
    return dedup.duplicate_groups(transactions(spark, sf_dir), keys)


@query(
    "q_overrides",
    with_tx(
        """SELECT tx_id, CASE p_name WHEN 'cold widget' THEN 'fixed one' WHEN 'red rod' THEN 'fixed two' ELSE p_name END AS description
           FROM tx"""
    ),
)
def apply_overrides(spark, sf_dir):
    fixes = spark.createDataFrame([("cold widget", "fixed one"), ("red rod", "fixed two")], "p_name string, corrected string")
    tx = transactions(spark, sf_dir).select("tx_id", "p_name")
    looked = tx.withColumn("description", F.col("p_name"))
    fixed = overrides.override(looked, fixes, ["p_name"], "description")
    return fixed.select("tx_id", "description")


@query(
    "q_category_mix",
    with_tx(
        """SELECT p_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM tx), 6) AS pct FROM tx GROUP BY 1"""
    ),
)
def category_mix(spark, sf_dir):
    return report.share_of_total(transactions(spark, sf_dir), "p_type")


@query(
    "q_top5",
    with_tx(
        """SELECT p_name, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM tx), 6) AS pct FROM tx
           WHERE p_name <> 'cold widget' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
    ),
)
def top5(spark, sf_dir):
    return report.top_labels(transactions(spark, sf_dir), "p_name", unsure="cold widget")


@query(
    "q_section_audit",
    with_tx(
        """SELECT l_orderkey AS order_no, CAST(sum(CASE WHEN l_linenumber < 7 AND l_returnflag <> 'R' THEN amount ELSE 0 END) AS DOUBLE) AS positive,
             CAST(sum(CASE WHEN l_linenumber < 7 AND l_returnflag = 'R' THEN amount ELSE 0 END) AS DOUBLE) AS negative,
             CAST(sum(CASE WHEN l_linenumber < 7 THEN 0 WHEN l_returnflag = 'R' THEN -amount ELSE amount END) AS DOUBLE) AS printed, count(*) AS n
           FROM tx GROUP BY 1"""
    ),
)
def section_audit(spark, sf_dir):
    sign = F.when(F.col("l_returnflag") == "R", "- ").otherwise("")
    shown = F.translate(F.format_number(F.col("amount"), 2), ",.", ".,")
    name = F.when(F.col("l_linenumber") < 7, F.col("p_name")).otherwise("Total")
    lines = transactions(spark, sf_dir).select(
        F.col("l_orderkey").alias("order_no"), F.concat(name, F.lit(" "), sign, shown).alias("line")
    )
    audit = recon.section_audit(lines, ["order_no"], "line", F.startswith("line", F.lit("Total ")))
    count = lines.groupBy("order_no").agg(F.count("*").alias("n"))
    return audit.join(count, "order_no").select("order_no", *dbl("positive", "negative", "printed"), "n")
