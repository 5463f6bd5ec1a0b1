"""Query of operator 11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caderneta.llm import conversation_repair as repair
from caderneta.llm.common import table
from caderneta.llm.registry import query
from caderneta.session import materialise


def _then(state: str, cost: str, letter: str, line: str = "''") -> str:
    """The edits of a state and one more; null stays null. ``line`` is what the edit adds to the repaired conversation."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}} END"


def _best(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _inserted(a: str) -> tuple[str, str]:
    users = [_then(f"{a}.s{i}", "2", "I", r"chr(10) || 'user:'") for i in (0, 1, 3)]
    return _best(f"{a}.s2", *users), _then("i2", "2", "I", r"chr(10) || 'assistant:'")


def _placed(states: tuple[str, ...], initial: str, role: str) -> list[str]:
    """Rows that are kept or get another role behind one of the states."""
    out = []
    for s in states:
        kept = _then(s, "t", "K", "chr(10) || role || ':' || text")
        other = _then(s, "2 + t", "R", f"chr(10) || '{role}:' || text")
        out += [f"CASE WHEN NOT gone AND initial = '{initial}' THEN {kept} END", f"CASE WHEN NOT gone THEN {other} END"]
    return out


def _deleted(state: str) -> str:
    return _then(state, "3", "D")


def _sql() -> str:
    i2, i3 = _inserted("p")
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR))"
    keep_system = f"CASE WHEN NOT gone AND initial = 's' THEN {_then('s0', 't', 'K', "chr(10) || role || ':' || text")} END"
    steps = "SELECT i, i AS c0 FROM range(256) t(i)"
    for k in range(8):
        steps = f"SELECT i, xor(c{k} >> 1, 3988292384 * (c{k} & 1)) AS c{k + 1} FROM ({steps})"
    return rf"""
WITH RECURSIVE crc AS (SELECT list(c8 ORDER BY i) AS crc_table FROM ({steps})),
plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS label
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
           list_transform(string_split(label, ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS kind
  FROM plain, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM kinds, range(2) t(copy) WHERE kind != 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed
), facts AS (
  SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 1 ELSE 0 END AS t FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(t) AS truncated,
         count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM facts GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS at, CAST({{'c': 0, 'a': '', 'r': ''}} AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR)) AS s0,
         {none} AS s1, {none} AS s2, {none} AS s3
  FROM counts
  UNION ALL
  SELECT conv_id, i AS at, {_deleted('s0')} AS s0, {_best(_deleted('s1'), keep_system)} AS s1,
         {_best(_deleted('i2'), *_placed(('s0', 's1', 'i3'), 'u', 'user'))} AS s2,
         {_best(_deleted('i3'), *_placed(('i2',), 'a', 'assistant'))} AS s3
  FROM (
    SELECT *, {_best('s3', i3)} AS i3 FROM (
      SELECT p.conv_id, p.s0, p.s1, p.s3, {i2} AS i2, f.i, f.role, f.text, f.initial, f.gone, f.t
      FROM walk p JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.at + 1
    )
  )
), ends AS (
  SELECT conv_id, {_best('s0', 's3', i3)} AS best FROM (
    SELECT p.conv_id, p.s0, p.s3, {i2} AS i2 FROM walk p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.at
  )
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_conversation_repair", _sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, cheapest repair and its audit for every conversation, after damage that follows from conversation and turn."""
    rows = repair.plain_rows(table(spark, sf_dir, "conversations"))
    broken = materialise(repair.damaged(rows), "conversation-damage")
    return repair.repair(rows, broken).withColumnRenamed("conv", "conv_id")
