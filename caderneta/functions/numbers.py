"""pt-BR numbers, amounts and score transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def zero() -> Column:
    return F.lit("0").cast(MONEY)


def money(c: Column) -> Column:
    return c.try_cast(MONEY)


def ptbr_to_decimal(text: Column) -> Column:
    """``1.234,56`` -> 1234.56; anything else -> null."""
    plain = F.replace(F.replace(F.trim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return money(plain)


def mixed_to_decimal(text: Column) -> Column:
    """``1.234,56``, ``12,3`` or ``12.30``."""
    return F.when(F.contains(text, F.lit(",")), ptbr_to_decimal(text)).otherwise(money(F.trim(text)))


def comma_to_double(text: Column) -> Column:
    """Comma swap only: a thousands separator makes the result null."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def to_ptbr(amount: Column, thousands: bool = True) -> Column:
    grouped = F.translate(F.format_number(amount, 2), ",.", ".,")
    return grouped if thousands else F.replace(grouped, F.lit("."), F.lit(""))


def signed_amount(debit: Column, credit: Column) -> Column:
    """Debit column counts negative, else the credit column counts positive."""
    return F.coalesce(-F.abs(debit), F.abs(credit))


def flux(signed: Column) -> Column:
    return F.when(signed < 0, F.lit("Entrada")).otherwise(F.lit("Saida"))


def flux_from_text(token: Column) -> Column:
    return F.when(F.startswith(token, F.lit("-")), F.lit("Entrada")).otherwise(F.lit("Saida"))


def int_or_null(text: Column) -> Column:
    """Integer text; the "duvida…" placeholder and other text give null."""
    trimmed = F.trim(text)
    return F.when(~F.startswith(F.lower(trimmed), F.lit("duvida")), trimmed.try_cast("int"))


def installment_total(count: Column, unit: Column, original: Column) -> Column:
    """count x unit when both are known, else the amount as it came."""
    return F.coalesce(money(count.cast("int") * unit), original)


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def softmax(scores: Column) -> Column:
    """Softmax over an array column, shifted by its maximum."""
    shifted = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, s: acc + s)
    return F.transform(shifted, lambda s: s / F.greatest(total, F.lit(1e-12)))
