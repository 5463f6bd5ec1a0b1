"""The monthly batch and the retraining job, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caderneta import schemas
from caderneta.functions import dates, fields, numbers
from caderneta.functions import text as T
from caderneta.operators import cascade, export, model, quality, recon, report, rules, similarity
from caderneta.sources import feedback, sinks


def merge_base(base: DataFrame, corrections: DataFrame) -> DataFrame:
    """Training base plus corrections in the base's columns. Repeats are kept on purpose."""
    return base.unionByName(quality.align_to(corrections, base.columns))


def duplicates(base: DataFrame, corrections: DataFrame) -> DataFrame:
    """Ids on both sides; without ids the combination of merchant, total and type."""
    key = "transactionId"
    if key in base.columns and key in corrections.columns:
        return base.select(key).na.drop().intersect(corrections.select(key).na.drop())
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("aonde gastou", "valor total", "tipo")]
    combo = F.concat_ws("_", *parts).alias("combo")
    return base.select(combo).intersect(corrections.select(combo))


@dataclass
class IntegrationReport:
    success: bool
    error: str | None = None
    duplicates: DataFrame | None = None
    quality: DataFrame | None = None
    balance: DataFrame | None = None
    balance_rows: DataFrame | None = None


def check_integration(base: DataFrame, corrections: DataFrame) -> IntegrationReport:
    """Structure, duplicates, quality and category balance of corrections against the base."""
    if not quality.same_essentials(base, corrections, schemas.ESSENTIAL_COLUMNS):
        return IntegrationReport(False, "essential columns differ")
    if corrections.isEmpty():
        return IntegrationReport(False, "no corrections to integrate")
    typed = corrections
    numeric = [c for c in ("valor unitário", "valor total", "parcelas") if c in corrections.columns]
    for c in numeric:
        typed = typed.withColumn(c, F.col(f"`{c}`").try_cast("double"))
    safe = {c: f"f{i}" for i, c in enumerate(typed.columns)}
    plain = typed.toDF(*safe.values())
    critical = [safe[c] for c in ("aonde gastou", "valor unitário", "data", "transactionId") if c in safe]
    names = F.create_map(*[F.lit(x) for c, n in safe.items() for x in (n, c)])
    issues = quality.report(plain, critical, [safe[c] for c in numeric]).withColumn("field", F.element_at(names, F.col("field")))
    return IntegrationReport(
        True, None, duplicates(base, corrections), issues.filter("nulls > 0 OR negatives > 0"),
        report.balance(base, corrections, "natureza do gasto"), report.balance_rows(base, corrections, "natureza do gasto"),
    )


def unified(card_export: DataFrame, bank_export: DataFrame) -> DataFrame:
    """Both exports as ``(doc_id, line_no, data, descricao, valor, cartao, origem)``."""
    return export.union_with_origin(export.card_rows(card_export), export.bank_rows(bank_export))


def classify_table(
    rows: DataFrame, stages: Sequence[cascade.Stage] | None = None, settings: cascade.Settings = cascade.Settings(),
    holders: fields.HolderRules = fields.HolderRules(), similarity_stage: cascade.TextStage | None = None,
    model_stage: cascade.TextStage | None = None,
) -> DataFrame:
    """Unified rows -> the categorised table.

    Amounts with a thousands separator are read correctly and refunds keep their sign.
    """
    kept = rows.filter(F.col("descricao").isNotNull()).withColumn("__clean", T.rule_text(F.col("descricao")))
    if stages is None:
        stages = cascade.standard_stages(
            settings, rules=rules.rules_stage(F.col("__clean"), F.col("cartao"), holders=holders),
            similarity=similarity_stage, model=model_stage,
        )
    out = cascade.classify(kept, stages, settings.default_label, settings.default_confidence)
    unit = numbers.mixed_to_decimal(F.col("valor"))
    parts = fields.bracketed_installments(F.col("descricao"))
    total = F.coalesce(
        numbers.to_ptbr(F.col("__total").cast("int") * unit, thousands=False), F.col("valor")
    )
    ready = out.withColumns({"__no": parts["number"], "__total": parts["total"]})
    return ready.select(
        "doc_id", "line_no",
        fields.dated_label(F.col("data"), F.col("descricao")).alias("aonde_gastou"),
        F.col("label").alias("natureza_do_gasto"), F.col("confidence").alias("confianca"), F.col("method_used").alias("metodo"),
        total.alias("valor_total"), F.coalesce(F.col("__total").cast("string"), F.lit("")).alias("parcelas"),
        F.coalesce(F.col("__no").cast("string"), F.lit("")).alias("no_da_parcela"), F.col("valor").alias("valor_unitario"),
        fields.origin_type(F.col("origem"), holders).alias("tipo"),
        fields.share_from_card_text(F.col("cartao"), holders).alias("comp"), "cartao",
    )


def consolidated_rows(classified: DataFrame) -> DataFrame:
    """Classified rows as they enter the consolidated table: no card, month columns from the label's date."""
    label, month, year = dates.month_columns(dates.date_in_description(F.col("aonde_gastou")))
    return classified.drop("cartao").select(
        "*", F.coalesce(label, F.lit("")).alias("data"), F.coalesce(month.cast("string"), F.lit("")).alias("mes"),
        F.coalesce(year, F.lit("")).alias("ano"),
    )


def monthly_batch(card_export: DataFrame, bank_export: DataFrame, consolidated_path: str, **classify_args) -> DataFrame:
    """Exports -> classified rows, appended to the consolidated table. One plan, one write."""
    classified = classify_table(unified(card_export, bank_export), **classify_args)
    sinks.append(consolidated_rows(classified), consolidated_path)
    return classified


def history_stages(history: DataFrame, settings: cascade.Settings, text: str = "aonde gastou", label: str = "natureza do gasto", row_id: str = "row_id"):
    """Similarity stage over earlier labelled rows."""
    index = similarity.build_index(history, text, label, row_id)
    return cascade.TextStage(
        "similarity_engine", similarity.text_scorer(index, settings.similarity_threshold), F.col("descricao")
    )


def retrain(
    spark: SparkSession, folder: str, ledger_path: str, root: str, model_path: str, version: str,
    training: model.Training = model.Training(), kinds: Sequence[str] = (model.LOGISTIC, model.CALIBRATED_SVC), folds: int = 5,
) -> dict:
    """Collect new corrections, merge, commit a version with the files that went into it, train, check and save.

    The commit is one step: a run that breaks off before it has consumed nothing and written nothing that counts, one that breaks off
    behind it trains the committed version when it is called again. Files that are refused or empty are ledgered also when the job
    stops early, so they are not read again for ever; good files stay pending until their rows are committed.
    """
    base = sinks.current(spark, root)
    if base is None:
        raise ValueError(f"no base version under {root}")
    rows, files = feedback.collect_new(spark, folder, ledger_path, sinks.committed_files(spark, root))
    checked = check_integration(base, rows)
    if not checked.success:
        feedback.append_ledger(files.filter("status <> 'ok'"), ledger_path)
        unfinished = sinks.version_without_model(spark, root)
        if unfinished is None:
            return {"success": False, "error": checked.error}
        return {"resumed": unfinished} | _train(spark, root, unfinished, model_path, training, kinds, folds)
    written = sinks.write_version(merge_base(base, rows), root, version, base.columns, files)
    if not written["success"]:
        feedback.append_ledger(files.filter("status <> 'ok'"), ledger_path)
        return written
    done = _train(spark, root, version, model_path, training, kinds, folds)
    return done | {"write": written, "quality_issues": checked.quality}


def _train(
    spark: SparkSession, root: str, version: str, model_path: str, training: model.Training, kinds: Sequence[str], folds: int
) -> dict:
    """Train on the current version, save the best model and note that the version has one."""
    data = sinks.current(spark, root)
    prepared = data.select(
        F.sha2(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in data.columns]), 256).alias("row_id"),
        T.scoring_text(F.col("`aonde gastou`")).alias("text"), F.col("`natureza do gasto`").alias("target"),
    ).filter(F.col("target").isNotNull() & (F.col("target") != ""))
    best, summary, held_out = model.train_best(prepared, "text", "target", "row_id", training, kinds, k=folds)
    best.save(model_path)
    passed = model.sanity(best, spark).first()
    sinks.add_model(spark, root, version, model_path)
    return {"success": bool(passed["ok"]), "cv": summary, "hold_out": held_out, "model": best.kind}


def statement_report(items: DataFrame, controls: DataFrame) -> DataFrame:
    """Card totals of parsed statements against the printed ones."""
    keyed = items.withColumn("card", recon.card_key(F.col("last4")))
    return recon.reconcile(keyed, controls, ["doc_id", "card"])
