"""The transaction table derived from the star schema, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Breaks every tie between rows that share a transaction id.
TOTAL_ORDER = ("tx_id", "l_partkey", "l_suppkey", "amount", "l_shipdate", "l_quantity", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card transactions: one row per line item.

    ``part`` and ``supplier`` are joined without a hint: Spark broadcasts them only
    while their size statistics allow it.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    merchant = F.concat_ws("*", F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_name"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tx_id"),
            merchant.alias("merchant"),
            F.concat(
                F.date_format("l_shipdate", "dd/MM/yyyy"), F.lit(" - "), merchant, F.lit(" ("),
                F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("/07)"),
            ).alias("descr"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
            F.concat(
                F.lit("Final "), F.lpad(F.col("l_suppkey").cast("string"), 4, "0"), F.lit(" - "), F.col("s_name")
            ).alias("card"),
            F.when(F.col("l_returnflag") == "R", "Entrada").otherwise("Saida").alias("flux"),
            F.when(F.col("l_linestatus") == "O", "fatura").otherwise("extrato").alias("origem"),
            "p_name", "p_type", "p_brand", "s_name",
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        )
    )


TX_SQL = """
  SELECT l_orderkey * 10 + l_linenumber AS tx_id,
         replace(p_brand, '#', '') || '*' || p_name AS merchant,
         strftime(l_shipdate, '%d/%m/%Y') || ' - ' || replace(p_brand, '#', '') || '*' || p_name
           || ' (' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '/07)' AS descr,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         'Final ' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') || ' - ' || s_name AS card,
         CASE WHEN l_returnflag = 'R' THEN 'Entrada' ELSE 'Saida' END AS flux,
         CASE WHEN l_linestatus = 'O' THEN 'fatura' ELSE 'extrato' END AS origem,
         p_name, p_type, p_brand, s_name,
         l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""


def with_tx(body: str) -> str:
    """SQL text that can read ``tx``."""
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE tx AS ({TX_SQL}), {body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH tx AS ({TX_SQL}), {body[5:]}"
    return f"WITH tx AS ({TX_SQL}) {body}"
