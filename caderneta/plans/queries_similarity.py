"""TF-IDF and lexical similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caderneta.functions import text as T
from caderneta.operators import similarity as S
from caderneta.plans.catalog import query
from caderneta.plans.queries_text import similarity_sql
from caderneta.plans.tx import table, transactions, with_tx

THRESHOLD = 0.25


def gram_sql(name: str, source: str, key: str) -> str:
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {source}),
      {name} AS (SELECT {key}, term, count(*) AS tf FROM (
        SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_w)
        GROUP BY 1, 2)"""


INDEX_SQL = f"""hist AS (SELECT doc_id, lang, {similarity_sql("text")} AS t FROM documents),
   n AS (SELECT count(*) AS n FROM hist),
   {gram_sql("hg", "hist", "doc_id")},
   idf AS (SELECT term, df, total_tf, ln((1.0 + n) / (1.0 + df)) + 1 AS idf
           FROM (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM hg GROUP BY 1), n)"""

SCORE_SQL = f"""{INDEX_SQL},
   qry AS (SELECT item_id, {similarity_sql("trim(text)")} AS t FROM benchmark),
   {gram_sql("qg", "qry", "item_id")},
   hv AS (SELECT doc_id, term, tf * idf AS w FROM hg JOIN idf USING (term)),
   qv AS (SELECT item_id, term, tf * idf AS w FROM qg JOIN idf USING (term)),
   hn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM hv GROUP BY 1),
   qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qv GROUP BY 1),
   dots AS (SELECT item_id, doc_id, sum(hv.w * qv.w) AS dot FROM hv JOIN qv USING (term) GROUP BY 1, 2),
   scored AS (SELECT item_id, doc_id, round(dot / hn.norm / qn.norm, 9) AS score FROM dots JOIN hn USING (doc_id) JOIN qn USING (item_id))"""


def _index(spark, sf_dir):
    return S.build_index(table(spark, sf_dir, "documents"), "text", "lang", "doc_id")


@query(
    "q_tfidf_terms",
    f"WITH {INDEX_SQL} SELECT term, df, CAST(total_tf AS BIGINT) AS total_tf, round(idf, 6) AS idf FROM idf",
)
def tfidf_terms(spark, sf_dir):
    vocab = S.fit_vocabulary(table(spark, sf_dir, "documents"), "text")
    return vocab.select("term", "df", "total_tf", F.round("idf", 6).alias("idf"))


@query(
    "q_similarity_top1",
    f"""WITH {SCORE_SQL} SELECT item_id, lang AS label, doc_id AS row_id, round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM scored WHERE score >= {THRESHOLD})
        JOIN documents USING (doc_id) WHERE rn = 1""",
)
def similarity_top1(spark, sf_dir):
    best = S.top_match(table(spark, sf_dir, "benchmark"), "item_id", "text", _index(spark, sf_dir), THRESHOLD)
    return best.select("item_id", "label", "row_id", F.round("score", 6).alias("score"))


@query(
    "q_topn_similar",
    f"""WITH {SCORE_SQL}, sigs AS (SELECT doc_id, md5(string_agg(term || ':' || w, '|' ORDER BY term)) AS sig FROM hv GROUP BY 1),
        firsts AS (SELECT min(doc_id) AS doc_id FROM sigs GROUP BY sig)
        SELECT item_id, CAST(place AS BIGINT) AS place, doc_id AS row_id, round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
          FROM scored SEMI JOIN firsts USING (doc_id) WHERE score >= {THRESHOLD}) WHERE place <= 3""",
)
def topn_similar(spark, sf_dir):
    found = S.top_matches(table(spark, sf_dir, "benchmark"), "item_id", "text", _index(spark, sf_dir), 3, THRESHOLD)
    return found.select("item_id", F.col("place").cast("bigint").alias("place"), "row_id", F.round("score", 6).alias("score"))


def _names(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    texts = tx.select(F.lower(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("text")).distinct()
    part = table(spark, sf_dir, "part")
    examples = part.groupBy(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text")).agg(
        F.min("p_partkey").alias("ex_id"), F.min_by("p_brand", "p_partkey").alias("label")
    )
    return texts, examples


@query(
    "q_jaccard_best",
    with_tx(
        """WITH a AS (SELECT DISTINCT lower(p_brand || ' ' || p_name || ' ' || p_type) AS text FROM tx),
          b AS (SELECT lower(p_name || ' ' || p_type) AS example, min(p_partkey) AS ex_id FROM part GROUP BY 1),
          s AS (SELECT text, ex_id, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS score FROM (
             SELECT text, ex_id, list_distinct(string_split(text, ' ')) AS x, list_distinct(string_split(example, ' ')) AS y FROM a, b))
          SELECT text, ex_id, round(score, 6) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, ex_id) AS rn FROM s WHERE score >= 0.5) WHERE rn = 1"""
    ),
)
def jaccard_best(spark, sf_dir):
    texts, examples = _names(spark, sf_dir)
    pairs = S.jaccard_pairs(texts.select(F.col("text").alias("l")), examples.select(F.col("text").alias("r")), 0.5)
    known = examples.select(F.col("text").alias("r"), "ex_id")
    best = pairs.join(known, "r").groupBy("l").agg(
        F.max_by(F.struct("ex_id", "words"), F.struct(F.col("words"), -F.col("ex_id"))).alias("b")
    )
    return best.select(F.col("l").alias("text"), "b.ex_id", F.round("b.words", 6).alias("score"))
