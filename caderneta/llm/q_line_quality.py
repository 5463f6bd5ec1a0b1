"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caderneta.llm import line_quality
from caderneta.llm.common import table
from caderneta.llm.registry import query

SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM parts)
), repeated AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM windows
        JOIN (SELECT rid, w FROM windows GROUP BY rid, w HAVING count(*) > 1) USING (rid, w))
  GROUP BY rid
), base AS (
  SELECT rid, doc_id, host, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lines
  FROM parts LEFT JOIN repeated USING (rid)
), texts AS (
  SELECT host, text, min(doc_id) AS first, any_value(lines) AS lines FROM base GROUP BY host, text
), lines AS (
  SELECT host, text, first, line, sum(words) AS words
  FROM (SELECT host, text, first, array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
                 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+'), ' ') AS line,
               len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words
        FROM (SELECT host, text, first, unnest(lines) AS l FROM texts))
  GROUP BY ALL
), heavy AS (
  SELECT host, line, min(first) AS owner FROM lines JOIN (SELECT host, count(*) AS texts FROM texts GROUP BY host) USING (host)
  GROUP BY host, line HAVING count(*) > 20 AND count(*) > 0.05 * any_value(texts)
), lost AS (
  SELECT host, text, sum(words) AS removed FROM lines JOIN heavy USING (host, line)
  WHERE first IS DISTINCT FROM owner GROUP BY host, text
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coalesce(removed, 0)::BIGINT AS n_removed_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - coalesce(removed, 0) >= 10
         AND n_words - coalesce(removed, 0) >= 0.5 * n_words AS kept
FROM base LEFT JOIN lost USING (host, text)
"""


@query("op4_line_frequency", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.assess(table(spark, sf_dir, "documents"))
