"""Query of operator 12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caderneta.llm import content_sort
from caderneta.llm.common import table
from caderneta.llm.registry import query

SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), ranked AS (
  SELECT doc_id, norm, row_number() OVER best AS rank, first_value(doc_id) OVER best AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM texts
  WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, rank = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""


@query("op12_content_sort", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, one row for each document."""
    return content_sort.mark(table(spark, sf_dir, "documents"))
