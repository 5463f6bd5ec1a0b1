"""Classification cascade: an ordered list of stages, the first sure answer wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.functions.numbers import clamp01
from caderneta.operators.once import evaluate_once
from caderneta.session import materialise

DECIDED = "struct<label:string,confidence:double,method:string>"


@dataclass(frozen=True)
class Settings:
    """Thresholds and switches of one run; passed as an argument, never through the environment."""

    similarity_threshold: float = 0.9
    model_threshold: float = 0.7
    use_preloaded: bool = False
    use_rules: bool = False
    use_similarity: bool = False
    use_model: bool = True
    use_replies: bool = True
    default_label: str = "duvida"
    default_confidence: float = 0.3


@dataclass(frozen=True)
class ColumnStage:
    """Answers from the row itself: struct(label, confidence), null for no answer."""

    method: str
    answer: Column
    threshold: float = 0.0


@dataclass(frozen=True)
class TextStage:
    """Answers from a lookup or model over distinct texts.

    ``score`` receives the distinct unanswered texts as column ``text`` and returns
    ``(text, label, confidence)`` with at most one row per text. Repeated descriptions are
    therefore scored once, however many transactions share them.
    """

    method: str
    score: Callable[[DataFrame], DataFrame]
    text: Column
    threshold: float = 0.0


Stage = ColumnStage | TextStage


def _accepted(answer: Column, threshold: float) -> Column:
    sure = answer["label"].isNotNull() & (answer["confidence"] >= threshold)
    return F.when(F.coalesce(sure, F.lit(False)), answer)


def _as_answer(answer: Column, method: str) -> Column:
    return F.when(
        answer.isNotNull(),
        F.struct(
            answer["label"].cast("string").alias("label"),
            clamp01(answer["confidence"].cast("double")).alias("confidence"),
            F.lit(method).alias("method"),
        ),
    )


def classify(
    df: DataFrame, stages: Sequence[Stage], default_label: str = "duvida", default_confidence: float = 0.3,
    default_method: str = "fallback", failed: Column | None = None,
) -> DataFrame:
    """``df`` with ``label``, ``confidence`` and ``method_used``; every input row comes out once.

    A column stage is evaluated for open rows only; a text stage only sees the texts of rows no
    earlier stage has answered. With text stages the input is read once, and written with what the stages in front answered. Rows where ``failed`` holds are unusable:
    no stage sees them, and they get the default answer with method ``error``.
    """
    nothing = F.lit(None).cast(DECIDED)
    error = F.struct(F.lit(default_label).alias("label"), F.lit(default_confidence).alias("confidence"), F.lit("error").alias("method"))
    out = df.withColumn("__answer", nothing if failed is None else F.when(failed, error.cast(DECIDED)))
    written = False
    for number, stage in enumerate(stages):
        open_row = F.col("__answer").isNull()
        if isinstance(stage, ColumnStage):
            out = evaluate_once(out, {"__raw": F.when(open_row, stage.answer)})
        else:
            key = f"__text{number}"
            out = evaluate_once(out, {key: stage.text})
            if not written:
                # Rows are read again by every text stage and at the end; what is in front of the first is done once.
                out, written = materialise(out, "cascade-rows"), True
            # Written once: the next stages read the few scored texts, not the work behind them.
            unanswered = out.filter(open_row & (F.col(key) != "")).select(F.col(key).alias("text")).distinct()
            scored = materialise(stage.score(materialise(unanswered, "cascade-open")), "cascade-scored").select(
                F.col("text").alias(key), F.struct("label", "confidence").alias("__raw")
            )
            out = out.join(scored, key, "left").drop(key)
        found = _as_answer(_accepted(F.col("__raw"), stage.threshold), stage.method)
        out = out.withColumn("__answer", F.coalesce("__answer", found)).drop("__raw")
    return out.select(
        *df.columns,
        F.coalesce(F.col("__answer.label"), F.lit(default_label)).alias("label"),
        F.coalesce(F.col("__answer.confidence"), F.lit(default_confidence)).alias("confidence"),
        F.coalesce(F.col("__answer.method"), F.lit(default_method)).alias("method_used"),
    )


def standard_stages(
    settings: Settings, *, preloaded: Column | None = None, rules: Column | None = None,
    similarity: TextStage | None = None, model: TextStage | None = None, reply: Column | None = None,
) -> list[Stage]:
    """preloaded -> rules -> similarity -> model -> reply, as far as switched on and supplied."""
    stages: list[Stage] = []
    if settings.use_preloaded and preloaded is not None:
        stages.append(ColumnStage("preloaded", preloaded))
    if settings.use_rules and rules is not None:
        stages.append(ColumnStage("rules_engine", rules))
    if settings.use_similarity and similarity is not None:
        stages.append(TextStage("similarity_engine", similarity.score, similarity.text, settings.similarity_threshold))
    if settings.use_model and model is not None:
        stages.append(TextStage("model_adapter", model.score, model.text, settings.model_threshold))
    if settings.use_replies and reply is not None:
        stages.append(ColumnStage("ai_fallback", reply))
    return stages


def legacy_stages(
    *, model: TextStage | None = None, rules: Column | None = None, similarity: TextStage | None = None,
    reply: Column | None = None, threshold: float = 0.7,
) -> list[Stage]:
    """model -> rules -> similarity under one threshold, then any reply."""
    stages: list[Stage] = []
    if model is not None:
        stages.append(TextStage("ml_model", model.score, model.text, threshold))
    if rules is not None:
        stages.append(ColumnStage("rules_engine", rules, threshold))
    if similarity is not None:
        stages.append(TextStage("similarity_engine", similarity.score, similarity.text, threshold))
    if reply is not None:
        stages.append(ColumnStage("ai_fallback", reply))
    return stages


LEGACY_DEFAULT = {"default_label": "Gastos pessoais", "default_confidence": 0.1, "default_method": "default"}


def transaction_id(preloaded_id: Column, raw_id: Column, row_id: Column) -> Column:
    """Id carried by the row, else its position."""
    return F.coalesce(F.nullif(preloaded_id, F.lit("")), raw_id, row_id.cast("string"))
