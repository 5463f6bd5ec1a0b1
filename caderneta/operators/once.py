"""Evaluate expressions once.

Catalyst substitutes a projected expression into every filter and projection above it. For a
long chain of patterns that repeats the work and can outgrow the code generator. A one-element
generator is a place it does not substitute through, and it stays inside the generated code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Like ``withColumns`` for new names, evaluated exactly here."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
