"""Sampling, training and evaluation queries over documents with quality labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from caderneta.functions import text as T
from caderneta.operators import cascade, metrics, model, sampling
from caderneta.plans.catalog import query
from caderneta.plans.queries_cascade import cleaned, ruled
from caderneta.plans.tx import table
from caderneta.session import materialise, scratch_path


def labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.join(labels, "doc_id")


RANK_SQL = """r AS (SELECT doc_id, CAST(quality AS VARCHAR) AS quality,
    row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn,
    count(*) OVER (PARTITION BY quality) AS n FROM labels)"""


@query(
    "q_stratified_split",
    f"WITH {RANK_SQL} SELECT doc_id, quality, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM r",
)
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return sampling.stratified_split(rows, "quality", "doc_id")


@query("q_folds", f"WITH {RANK_SQL} SELECT doc_id, quality, CAST((rn - 1) % 5 AS BIGINT) AS fold FROM r")
def folds(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return sampling.folds(rows, "quality", "doc_id").withColumn("fold", F.col("fold").cast("bigint"))


@query(
    "q_grouped_folds",
    """WITH d AS (SELECT l.doc_id, CAST(quality AS VARCHAR) AS quality, sha256(coalesce(d.text, '')) AS text_key FROM labels l JOIN documents d USING (doc_id)),
         p AS (SELECT text_key, quality, count(*) AS n FROM d GROUP BY 1, 2),
         g AS (SELECT text_key, min({'n': -n, 'q': quality}).q AS own, sum(n) AS size FROM p GROUP BY 1),
         w AS (SELECT *, sum(size) OVER (PARTITION BY own ORDER BY md5(text_key), text_key) AS upto, sum(size) OVER (PARTITION BY own) AS total FROM g)
       SELECT doc_id, quality, CAST(least(floor((2 * upto - size) * 5 / (2 * total)), 4) AS BIGINT) AS fold FROM d JOIN w USING (text_key)""",
)
def grouped_folds(spark, sf_dir):
    """Copies of a document share a fold."""
    rows = labelled(spark, sf_dir).withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
    return sampling.grouped_folds(rows, "quality", "text_key").select("doc_id", "quality", F.col("fold").cast("bigint").alias("fold"))


@query(
    "q_oversample",
    f"""WITH {RANK_SQL}, m AS (SELECT *, CAST(greatest(floor((SELECT max(n) FROM r) * 0.7) - n, 0) AS BIGINT) AS missing FROM r)
        SELECT doc_id, quality, CAST(1 + missing // n + CASE WHEN rn <= missing % n THEN 1 ELSE 0 END AS BIGINT) AS copies FROM m""",
)
def oversample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    out = sampling.oversample(rows, "quality", "doc_id")
    return out.groupBy("doc_id", "quality").agg(F.count("*").alias("copies"))


# Pseudo-predictions: the class from one hex digit of an md5, the probabilities from two more.
PSEUDO_SQL = """p AS (SELECT doc_id, CAST(quality AS VARCHAR) AS truth,
    CASE WHEN substr(md5('p' || doc_id), 1, 1) < '4' THEN CAST(1 - quality AS VARCHAR) ELSE CAST(quality AS VARCHAR) END AS predicted,
    (instr('0123456789abcdef', substr(md5('s' || doc_id), 1, 1)) - 1) / 15.0 AS p1 FROM labels)"""


def pseudo(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    digit = F.substring(F.md5(F.concat(F.lit("p"), F.col("doc_id").cast("string"))), 1, 1)
    other = F.substring(F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), 1, 1)
    p1 = (F.call_function("instr", F.lit("0123456789abcdef"), other) - 1) / F.lit(15.0)
    return rows.select(
        "doc_id", F.col("quality").cast("string").alias("truth"),
        F.when(digit < "4", (1 - F.col("quality")).cast("string")).otherwise(F.col("quality").cast("string")).alias("predicted"),
        F.array(1 - p1, p1).alias("probs"),
    )


@query(
    "q_confusion",
    f"""WITH {PSEUDO_SQL} SELECT truth, count(*) FILTER (predicted = '0') AS "0", count(*) FILTER (predicted = '1') AS "1" FROM p GROUP BY 1""",
)
def confusion(spark, sf_dir):
    return metrics.confusion_matrix(pseudo(spark, sf_dir), "truth", "predicted", ["0", "1"])


@query(
    "q_class_report",
    f"""WITH {PSEUDO_SQL}, c AS (SELECT l.label, count(*) FILTER (truth = label AND predicted = label) AS tp,
          count(*) FILTER (truth = label) AS support, count(*) FILTER (predicted = label) AS pn
          FROM p, (VALUES ('0'), ('1')) AS l(label) GROUP BY 1)
        SELECT label, round(tp / pn, 6) AS precision, round(tp / support, 6) AS recall,
          round(2 * (tp / pn) * (tp / support) / (tp / pn + tp / support), 6) AS f1, support FROM c""",
)
def class_report(spark, sf_dir):
    out = metrics.class_report(pseudo(spark, sf_dir), "truth", "predicted")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "q_brier",
    f"""WITH {PSEUDO_SQL} SELECT round(avg((pow(1 - p1 - (truth = '0')::INT, 2) + pow(p1 - (truth = '1')::INT, 2)) / 2), 6) AS brier FROM p""",
)
def brier(spark, sf_dir):
    out = metrics.brier(pseudo(spark, sf_dir), "truth", F.col("probs"), ["0", "1"])
    return out.select(F.round("brier", 6).alias("brier"))


@query(
    "q_auc",
    f"""WITH {PSEUDO_SQL}, s AS (SELECT '0' AS label, 1 - p1 AS score, truth = '0' AS pos FROM p UNION ALL SELECT '1', p1, truth = '1' FROM p),
          g AS (SELECT label, round(score, 9) AS score, count(*) FILTER (pos) AS pos, count(*) FILTER (NOT pos) AS neg FROM s GROUP BY 1, 2),
          w AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
        SELECT label, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM w GROUP BY 1""",
)
def auc(spark, sf_dir):
    out = metrics.auc_per_class(pseudo(spark, sf_dir), "truth", F.transform("probs", lambda p: F.round(p, 9)), ["0", "1"])
    return out.select("label", F.round("auc", 6).alias("auc"))


DIMENSIONS = 64  # of the embeddings table


@query(
    "q_top_classes",
    """SELECT vec_id, 'c' || list_position(embedding, list_max(embedding)) AS best,
         round(CAST(list_reverse_sort(embedding)[1] AS DOUBLE) - CAST(list_reverse_sort(embedding)[2] AS DOUBLE), 6) AS margin FROM embeddings""",
)
def top_classes(spark, sf_dir):
    scores = F.transform("embedding", lambda x: x.cast("double"))
    top = metrics.top_k(F.col("s"), [f"c{i}" for i in range(1, DIMENSIONS + 1)], 2)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scores.alias("s")).select("vec_id", top.alias("top"))
    return rows.select("vec_id", F.col("top")[0]["label"].alias("best"), F.round(metrics.margin(F.col("top")), 6).alias("margin"))


def _scored(spark, sf_dir, kind):
    rows = labelled(spark, sf_dir).withColumn("text", T.scoring_text(F.col("text")))
    split = materialise(sampling.stratified_split(rows, "quality", "doc_id"), "split")
    train = sampling.oversample(split.filter("part = 'train'").drop("part"), "quality", "doc_id")
    train = train.withColumn("rid", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("copy_no").cast("string")))
    fitted = model.fit(train, "text", "quality", "rid", model.Training(kind=kind))
    path = scratch_path(spark, "model")
    fitted.save(path)
    test = split.filter("part = 'test'")
    again = model.TextModel.load(path).predict(test).select("doc_id", F.col("label").alias("l"), F.col("confidence").alias("c"))
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return fitted.predict(test).join(again, "doc_id").select(
        "doc_id", "quality",
        F.col("label").isin(fitted.labels).alias("label_known"),
        (F.abs(total - 1) < 1e-6).alias("sums_to_one"),
        (F.abs(F.col("confidence") - F.array_max("probs")) < 1e-9).alias("confidence_is_largest"),
        ((F.col("label") == F.col("l")) & (F.abs(F.col("confidence") - F.col("c")) < 1e-9)).alias("same_when_loaded"),
    )


# Every test row, and what must hold for its prediction by a fitted, saved and reloaded model.
SCORED_SQL = f"""WITH {RANK_SQL} SELECT doc_id, quality, true AS label_known, true AS sums_to_one, true AS confidence_is_largest,
    true AS same_when_loaded FROM r WHERE rn <= floor(n * 0.2 + 0.5)"""


@query("q_train_score_quality", SCORED_SQL)
def train_score_quality(spark, sf_dir):
    return _scored(spark, sf_dir, model.LOGISTIC)


@query("q_calibrated_svc", SCORED_SQL)
def calibrated_svc(spark, sf_dir):
    return _scored(spark, sf_dir, model.CALIBRATED_SVC)


@query("q_cascade_full")
def cascade_full(spark, sf_dir):
    """Rules, then the TF-IDF lookup in earlier transactions, then a classifier trained on them, then the default."""
    from caderneta.operators import similarity

    tx = materialise(cleaned(spark, sf_dir), "cleaned")
    # Promotions are known without their brand only, so the lookup leaves some of them to the classifier.
    name = F.when(F.col("p_type") == "PROMO", F.regexp_replace("clean", r"^\S+\s+", "")).otherwise(F.col("clean"))
    history = tx.groupBy(name.alias("text")).agg(
        F.min("tx_id").alias("row_id"), F.mode("p_type", True).alias("label")
    )
    index = similarity.build_index(history, "text", "label", "row_id")
    fitted = model.fit(history, "text", "label", "row_id", model.Training())
    settings = cascade.Settings(use_rules=True, use_similarity=True, similarity_threshold=0.95, model_threshold=0.5)
    stages = cascade.standard_stages(
        settings, rules=ruled(tx),
        similarity=cascade.TextStage("similarity_engine", similarity.text_scorer(index, settings.similarity_threshold), F.col("clean")),
        model=cascade.TextStage("model_adapter", fitted.scorer(), F.col("clean")),
    )
    out = cascade.classify(tx, stages, settings.default_label, settings.default_confidence)
    return out.groupBy("method_used", "label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
