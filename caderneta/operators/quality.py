"""Validity rules, quarantine and quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.functions.dates import parse_date
from caderneta.functions.numbers import mixed_to_decimal
from caderneta.functions.text import strip

MIN_AMOUNT = "0.01"

Rules = Sequence[tuple[str, Column]]


def transaction_rules(description: str = "description", amount: str = "amount") -> Rules:
    return (
        ("blank description", strip(F.col(description)) != ""),
        ("amount not positive", F.col(amount) > 0),
    )


def feedback_rules() -> Rules:
    """Checks of a user correction; optional fields may be null."""

    def optional_count(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) >= 1)

    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9:.]+(?:Z|[+-][0-9:]+)?)?$"

    def iso_date(name: str) -> Column:
        return F.rlike(F.col(name), F.lit(iso)) & F.left(F.col(name), F.lit(10)).try_cast("date").isNotNull()

    return (
        ("transactionId missing", F.col("transactionId").isNotNull()),
        ("description missing", F.col("description").isNotNull()),
        ("amount not positive", F.col("amount") > 0),
        ("date not ISO", iso_date("date")),
        ("createdAt not ISO", F.col("createdAt").isNull() | iso_date("createdAt")),
        ("parcelas below 1", optional_count("parcelas")),
        ("numero_parcela below 1", optional_count("numero_parcela")),
    )


def with_reason(df: DataFrame, rules: Rules, name: str = "reason") -> DataFrame:
    """First broken rule, null for a good row. An undecidable check counts as broken."""
    reason = F.coalesce(*[F.when(~F.coalesce(check, F.lit(False)), F.lit(label)) for label, check in rules])
    return df.withColumn(name, reason)


def split(df: DataFrame, name: str = "reason") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows): together they are the input."""
    return df.filter(F.col(name).isNull()).drop(name), df.filter(F.col(name).isNotNull())


def lenient_load(df: DataFrame, amount_text: str, date_text: str, today: Column | None = None) -> DataFrame:
    """Typed ``amount`` and ``date`` that are never missing; ``dq_flags`` names what was replaced."""
    today = F.current_date() if today is None else today
    amount, date = mixed_to_decimal(F.col(amount_text)), parse_date(F.col(date_text))
    usable = F.coalesce(amount > 0, F.lit(False))
    flags = F.array_compact(
        F.array(F.when(~usable, F.lit("amount")), F.when(date.isNull(), F.lit("date")))
    )
    return df.select(
        "*",
        F.when(usable, amount).otherwise(F.lit(MIN_AMOUNT).cast("decimal(18,2)")).alias("amount"),
        F.coalesce(date, today).alias("date"),
        flags.alias("dq_flags"),
    )


def in_value_range(amount: Column, low: str | None = None, high: str | None = None) -> Column:
    """Whether an amount without its sign lies within the bounds that are given; rows outside are the caller's to keep aside."""
    size, out = F.abs(amount), amount.isNotNull()
    if low is not None:
        out = out & (size >= F.lit(low).cast("decimal(18,2)"))
    if high is not None:
        out = out & (size <= F.lit(high).cast("decimal(18,2)"))
    return out


def report(df: DataFrame, critical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Nulls per critical column and negatives per numeric column, in one pass."""
    fields = list(dict.fromkeys([*critical, *numeric]))
    counts = [F.count_if(F.col(c).isNull() if c in critical else F.lit(False)).alias(f"n_{i}") for i, c in enumerate(fields)]
    counts += [F.count_if(F.col(c) < 0 if c in numeric else F.lit(False)).alias(f"m_{i}") for i, c in enumerate(fields)]
    row = df.agg(*counts)
    per_field = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.col(f"n_{i}").alias("nulls"), F.col(f"m_{i}").alias("negatives"))
            for i, c in enumerate(fields)
        ]
    )
    return row.select(F.inline(per_field))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def same_essentials(base: DataFrame, incoming: DataFrame, essential: Sequence[str]) -> bool:
    """Both sides carry the same essential columns, whatever their order."""
    return {c for c in essential if c in base.columns} == {c for c in essential if c in incoming.columns}


def align_to(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns``, in order: missing ones blank, others dropped."""
    return df.select([F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])


def frequent_labels(df: DataFrame, label: str, at_least: int = 2) -> DataFrame:
    """Rows of labels with enough examples."""
    enough = df.groupBy(label).agg(F.count("*").alias("__n")).filter(F.col("__n") >= at_least).select(label)
    return df.join(enough, label, "left_semi")
