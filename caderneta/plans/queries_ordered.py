"""Order-dependent queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caderneta.functions.dates import period_label
from caderneta.operators import automaton, dedup, export, grouping, ordered, quality
from caderneta.plans.catalog import query
from caderneta.plans.tx import TOTAL_ORDER, table, transactions, with_tx

HOUR = 3600


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def day(column="ts"):
    return F.date_trunc("day", F.col(column))


@query(
    "q_forward_fill_card",
    """SELECT event_id, COALESCE(last_value(CASE WHEN event_type = 'signup' THEN 'Final ' || event_id END IGNORE NULLS)
             OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '-') AS card,
         COALESCE(lead(event_type) OVER w, '-') AS following,
         CAST(CASE WHEN lag(event_type, 1) OVER w = 'signup' OR lag(event_type, 2) OVER w = 'signup' THEN 1 ELSE 0 END AS BIGINT) AS skipped
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def forward_fill_card(spark, sf_dir):
    header = F.when(F.col("event_type") == "signup", F.concat(F.lit("Final "), F.col("event_id").cast("string")))
    keys, order = ["user_id"], ["ts", "event_id"]
    once = ordered.scan(
        table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), keys, order, day(),
        [
            ordered.LastKnown("card", header),
            ordered.Next("following", F.col("event_type")),
            ordered.Previous("back1", F.col("event_type")),
        ],
    )
    twice = ordered.scan(once, keys, order, day(), [ordered.Previous("back2", F.col("back1"))])
    near_header = (F.col("back1") == "signup") | (F.col("back2") == "signup")
    return twice.select(
        "event_id",
        F.coalesce("card", F.lit("-")).alias("card"),
        F.coalesce("following", F.lit("-")).alias("following"),
        F.when(near_header, 1).otherwise(0).cast("bigint").alias("skipped"),
    )


@query(
    "q_crop_between_markers",
    """SELECT event_id, e.user_id, value FROM events e JOIN (
         SELECT m.user_id, m.begin_ts, min(x.ts) AS end_ts FROM (
           SELECT user_id, min(ts) AS begin_ts FROM events WHERE event_type = 'signup' GROUP BY 1) m
         LEFT JOIN events x ON x.user_id = m.user_id AND x.event_type = 'error' AND x.ts > m.begin_ts
         GROUP BY 1, 2) c ON c.user_id = e.user_id
       WHERE e.ts > c.begin_ts AND (c.end_ts IS NULL OR e.ts < c.end_ts)""",
)
def crop_between_markers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    cropped = export.crop(
        rows, ["user_id"], "ts", F.col("event_type") == "signup", F.col("event_type") == "error"
    )
    return cropped.select("event_id", "user_id", "value")


FILE_OF_TX = "CAST(year(l_shipdate) AS VARCHAR)"
ORDER_SQL = ", ".join(TOTAL_ORDER)


@query(
    "q_dedup_keep_last",
    with_tx(
        f"""SELECT file, tx_id, CAST(amount AS DOUBLE) AS amount, merchant FROM (
              SELECT *, {FILE_OF_TX} AS file, row_number() OVER (PARTITION BY {FILE_OF_TX}, tx_id
                ORDER BY l_partkey DESC, l_suppkey DESC, amount DESC, l_shipdate DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn
              FROM tx) WHERE rn = 1"""
    ),
)
def dedup_keep_last(spark, sf_dir):
    tx = transactions(spark, sf_dir).withColumn("file", F.year("l_shipdate").cast("string"))
    kept = dedup.keep_last(tx.select("file", "merchant", *TOTAL_ORDER), ["file", "tx_id"], TOTAL_ORDER[1:])
    return kept.select("file", "tx_id", F.col("amount").cast("double").alias("amount"), "merchant")


@query(
    "q_first_file_wins",
    with_tx(
        f"""SELECT file, tx_id, CAST(amount AS DOUBLE) AS amount, merchant FROM (
              SELECT *, {FILE_OF_TX} AS file, row_number() OVER (PARTITION BY tx_id ORDER BY {FILE_OF_TX},
                l_partkey DESC, l_suppkey DESC, amount DESC, l_shipdate DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn
              FROM tx) WHERE rn = 1"""
    ),
)
def first_file_wins(spark, sf_dir):
    tx = transactions(spark, sf_dir).withColumn("file", F.year("l_shipdate").cast("string"))
    kept = dedup.first_file_wins(tx.select("file", "merchant", *TOTAL_ORDER), "tx_id", "file", TOTAL_ORDER[1:])
    return kept.select("file", "tx_id", F.col("amount").cast("double").alias("amount"), "merchant")


@query(
    "q_first_occurrence",
    with_tx(
        """SELECT l_orderkey, d AS ship_day, p_name, CAST(min(l_linenumber) AS BIGINT) AS line_no, count(*) AS copies
           FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d FROM tx) GROUP BY 1, 2, 3"""
    ),
)
def first_occurrence(spark, sf_dir):
    tx = transactions(spark, sf_dir).select(
        "l_orderkey", F.col("l_shipdate").cast("date").cast("string").alias("ship_day"), "p_name",
        F.col("l_linenumber").cast("bigint").alias("line_no"),
    )
    return dedup.first_occurrence(tx, ["l_orderkey", "ship_day", "p_name"], ["line_no"], count="copies")


@query(
    "q_running_max_regression",
    """SELECT event_id, CAST(CASE WHEN COALESCE(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - value > 150, false) THEN 1 ELSE 0 END AS BIGINT) AS rejected
       FROM events""",
)
def running_max_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    seen = ordered.scan(rows, ["user_id"], ["ts", "event_id"], day(), [ordered.MaxBefore("high", F.col("value"))])
    late = F.coalesce(F.col("high") - F.col("value") > 150, F.lit(False))
    return seen.select("event_id", late.cast("bigint").alias("rejected"))


SEC = "epoch_us(ts) / 1e6"


@query(
    "q_gap_segments",
    f"""SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM (
          SELECT *, CASE WHEN {SEC} - lag({SEC}) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 14400 THEN 1 ELSE 0 END AS fresh
          FROM events)""",
)
def gap_segments(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "ts", "event_id", "sec")
    return grouping.segments(rows, ["user_id"], ["ts", "event_id"], day(), "sec", "sec", 4 * HOUR).select(
        "event_id", "segment"
    )


@query(
    "q_largest_gap",
    f"""SELECT user_id, round(gap, 3) AS gap, round(split, 3) AS split FROM (
          SELECT user_id, nxt - s AS gap, (s + nxt) / 2 AS split,
             row_number() OVER (PARTITION BY user_id ORDER BY nxt - s DESC, s) AS rn
          FROM (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nxt
                FROM (SELECT DISTINCT user_id, {SEC} AS s FROM events)) WHERE nxt IS NOT NULL) WHERE rn = 1""",
)
def largest_gap(spark, sf_dir):
    found = grouping.largest_gap(
        events(spark, sf_dir).select("user_id", "sec"), ["user_id"], "sec", F.floor(F.col("sec") / (24 * HOUR)), 60
    )
    return found.select("user_id", F.round("gap", 3).alias("gap"), F.round("split", 3).alias("split"))


@query(
    "q_two_means_split",
    """SELECT user_id, round(split, 6) AS split FROM (
         SELECT user_id, (s / n + (ts - s) / (tn - n)) / 2 AS split,
            row_number() OVER (PARTITION BY user_id ORDER BY s * (s / n) + (ts - s) * ((ts - s) / (tn - n)) DESC, v) AS rn
         FROM (SELECT user_id, v, sum(c) OVER w AS n, sum(c * v) OVER w AS s,
                 sum(c) OVER (PARTITION BY user_id) AS tn, sum(c * v) OVER (PARTITION BY user_id) AS ts
               FROM (SELECT user_id, value AS v, count(*) AS c FROM events GROUP BY 1, 2)
               WINDOW w AS (PARTITION BY user_id ORDER BY v)) WHERE tn > n) WHERE rn = 1""",
)
def two_means_split(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "value")
    split = grouping.two_means_split(rows, ["user_id"], "value", F.floor(F.col("value") / 50))
    return split.select("user_id", F.round("split", 6).alias("split"))


@query(
    "q_anchored_groups",
    f"""WITH RECURSIVE v AS (SELECT DISTINCT user_id, round({SEC} - epoch(TIMESTAMP '2024-01-01'), 3) AS s FROM events),
          n AS (SELECT a.user_id, a.s, min(b.s) AS nxt FROM v a LEFT JOIN v b ON b.user_id = a.user_id AND b.s - a.s > 36000 GROUP BY 1, 2),
          c AS (SELECT user_id, min(s) AS anchor FROM v GROUP BY 1
                UNION ALL SELECT n.user_id, n.nxt FROM c JOIN n ON n.user_id = c.user_id AND n.s = c.anchor WHERE n.nxt IS NOT NULL)
        SELECT e.event_id, max(c.anchor) AS anchor FROM events e
        JOIN c ON c.user_id = e.user_id AND c.anchor <= round({SEC.replace('ts', 'e.ts')} - epoch(TIMESTAMP '2024-01-01'), 3) GROUP BY 1""",
)
def anchored_groups(spark, sf_dir):
    epoch = F.lit("2024-01-01 00:00:00").cast("timestamp").cast("double")
    rows = events(spark, sf_dir).select("event_id", "user_id", F.round(F.col("sec") - epoch, 3).alias("s"))
    return grouping.anchored_groups(rows, ["user_id"], "s", 10 * HOUR).select("event_id", "anchor")


@query(
    "q_value_line_merge",
    """SELECT conv_id, CAST(min(turn) AS BIGINT) AS turn, md5(string_agg(text, ' ' ORDER BY turn)) AS merged_md5 FROM (
         SELECT *, sum(CASE WHEN len(text) < 300 AND role = 'assistant' THEN 0 ELSE 1 END)
            OVER (PARTITION BY conv_id ORDER BY turn) AS grp
         FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2)) GROUP BY conv_id, grp""",
)
def value_line_merge(spark, sf_dir):
    lines = (
        table(spark, sf_dir, "conversations").groupBy("conv_id", "turn")
        .agg(F.min("role").alias("role"), F.min("text").alias("text"))
    )
    tail = (F.length("text") < 300) & (F.col("role") == "assistant")
    merged = grouping.merge_trailing(lines, ["conv_id"], "turn", F.floor(F.col("turn") / 4096), "text", tail)
    return merged.select("conv_id", "turn", F.md5("text").alias("merged_md5"))


@query(
    "q_first_last_valid_date",
    """SELECT user_id, 'CC - ' || strftime(min_by(ts, event_id), '%d/%m/%Y') || ' a '
          || strftime(max_by(ts, event_id), '%d/%m/%Y') AS period
       FROM events WHERE value >= 50 GROUP BY 1""",
)
def first_last_valid_date(spark, sf_dir):
    """Row order is event_id; rows below 50 stand for unparsable dates."""
    parsed = F.when(F.col("value") >= 50, F.col("ts").cast("date"))
    ends = export.first_last_valid(
        table(spark, sf_dir, "events").withColumn("d", parsed), ["user_id"], "event_id", "d"
    )
    return ends.filter(F.col("first_valid").isNotNull()).select(
        "user_id", period_label(F.col("first_valid"), F.col("last_valid")).alias("period")
    )


@query(
    "q_reading_order",
    """SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value < 250 THEN 0 ELSE 1 END, ts, event_id) AS BIGINT) AS line_no
       FROM events""",
)
def reading_order(spark, sf_dir):
    """Left column top to bottom, then the right one; user = page, value = x, ts = y."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", F.when(F.col("value") < 250, 0).otherwise(1).alias("side")
    )
    chunk = F.struct(F.col("side"), day().alias("d"))
    return ordered.scan(
        rows, ["user_id"], ["side", "ts", "event_id"], chunk, [ordered.row_number("line_no")]
    ).select("event_id", "line_no")


@query(
    "q_quality_split",
    """SELECT c_custkey, CASE WHEN trim(c_name) = '' THEN 'blank description'
         WHEN c_acctbal <= 0 THEN 'amount not positive' ELSE 'ok' END AS reason FROM customer""",
)
def quality_split(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("description"), F.col("c_acctbal").alias("amount")
    )
    good, bad = quality.split(quality.with_reason(rows, quality.transaction_rules()))
    out = good.withColumn("reason", F.lit("ok")).unionByName(bad)
    return out.select("c_custkey", "reason")


@query(
    "q_quality_report",
    """SELECT 'c_acctbal' AS field, count(*) FILTER (c_acctbal IS NULL) AS nulls, count(*) FILTER (c_acctbal < 0) AS negatives FROM customer
       UNION ALL SELECT 'c_name', count(*) FILTER (c_name IS NULL), 0 FROM customer""",
)
def quality_report(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "customer"), critical=["c_acctbal", "c_name"], numeric=["c_acctbal"])


@query(
    "q_lenient_load",
    with_tx(
        """SELECT tx_id, CAST(CASE WHEN l_linenumber = 1 THEN 0.01 ELSE amount END AS DOUBLE) AS amount,
             CASE WHEN l_linenumber = 1 THEN 'amount' WHEN l_linenumber = 2 THEN 'date' ELSE '' END AS dq_flag,
             CASE WHEN l_linenumber = 2 THEN '2000-01-01' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS day
           FROM tx"""
    ),
)
def lenient_load(spark, sf_dir):
    tx = transactions(spark, sf_dir).select(
        "tx_id",
        F.when(F.col("l_linenumber") == 1, "-5,00").otherwise(F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(","))).alias("amount_text"),
        F.when(F.col("l_linenumber") == 2, "31/02/2020").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("date_text"),
    )
    loaded = quality.lenient_load(tx, "amount_text", "date_text", F.lit("2000-01-01").cast("date"))
    return loaded.select(
        "tx_id", F.col("amount").cast("double").alias("amount"), F.array_join("dq_flags", ",").alias("dq_flag"),
        F.col("date").cast("string").alias("day"),
    )


# A reduced machine: signup opens, error closes, view toggles only when open.
MACHINE = {"signup": 0, "error": 1, "view": 2}
MACHINE_TABLE = [[1, 1, 1], [0, 0, 0], [0, 2, 1]]


@query(
    "q_state_machine",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
       m AS (SELECT user_id, rn, event_id, event_type, 0 AS state FROM o WHERE rn = 1
             UNION ALL SELECT o.user_id, o.rn, o.event_id, o.event_type,
               CASE m.event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0
                 WHEN 'view' THEN CASE m.state WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END ELSE m.state END
             FROM m JOIN o ON o.user_id = m.user_id AND o.rn = m.rn + 1)
       SELECT event_id, CAST(state AS BIGINT) AS state FROM m""",
)
def state_machine(spark, sf_dir):
    code = F.lit(None).cast("int")
    for kind, number in MACHINE.items():
        code = F.when(F.col("event_type") == kind, number).otherwise(code)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", code.alias("code"))
    found = automaton.states_before(
        rows, ["user_id"], "event_id", F.floor(F.col("event_id") / 1000), "code", MACHINE_TABLE, 0
    )
    return found.select("event_id", F.col("state").cast("bigint").alias("state"))


# A third of the users count as one, so one key holds a third of all rows.
HOT_USER = "CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END"


@query(
    "q_state_machine_hot",
    f"""SELECT event_id, CAST(CASE WHEN opened IS NULL OR closed > opened THEN 0 ELSE 1 + (views - views_then) % 2 END AS BIGINT) AS state FROM (
         SELECT *, max(views_at) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS views_then FROM (
           SELECT k, event_id, coalesce(max(event_id) FILTER (event_type = 'signup') OVER w, NULL) AS opened,
             coalesce(max(event_id) FILTER (event_type = 'error') OVER w, -1) AS closed,
             count(*) FILTER (event_type = 'view') OVER w AS views,
             CASE WHEN event_type = 'signup' THEN count(*) FILTER (event_type = 'view') OVER w END AS views_at
           FROM (SELECT {HOT_USER} AS k, event_id, event_type FROM events)
           WINDOW w AS (PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))""",
)
def state_machine_hot(spark, sf_dir):
    """The same machine for keys of which one holds a third of the rows: a tree of chunks of 64 event numbers."""
    code = F.lit(None).cast("int")
    for kind, number in MACHINE.items():
        code = F.when(F.col("event_type") == kind, number).otherwise(code)
    rows = table(spark, sf_dir, "events").select(F.expr(HOT_USER).alias("k"), "event_id", code.alias("code"))
    found = automaton.states_before(rows, ["k"], "event_id", F.floor(F.col("event_id") / 64), "code", MACHINE_TABLE, 0)
    return found.select("event_id", F.col("state").cast("bigint").alias("state"))


@query(
    "q_anchored_groups_hot",
    f"""WITH RECURSIVE v AS (SELECT DISTINCT {HOT_USER} AS k, round({SEC} - epoch(TIMESTAMP '2024-01-01'), 3) AS s FROM events),
          f AS (SELECT k, min(s) AS anchor FROM v GROUP BY 1),
          c AS (SELECT k, anchor FROM f
                UNION ALL SELECT c.k, (SELECT min(v.s) FROM v WHERE v.k = c.k AND v.s - c.anchor > 36000) FROM c
                WHERE EXISTS (SELECT 1 FROM v WHERE v.k = c.k AND v.s - c.anchor > 36000))
        SELECT event_id, anchor FROM (
          SELECT event_id, {HOT_USER} AS k, round({SEC} - epoch(TIMESTAMP '2024-01-01'), 3) AS s FROM events) e
        ASOF JOIN c ON c.k = e.k AND e.s >= c.anchor""",
)
def anchored_groups_hot(spark, sf_dir):
    """Groups of ten hours; chunks of about 500 values, so that the common key has several at every size."""
    epoch = F.lit("2024-01-01 00:00:00").cast("timestamp").cast("double")
    rows = events(spark, sf_dir).select("event_id", F.expr(HOT_USER).alias("k"), F.round(F.col("sec") - epoch, 3).alias("s"))
    return grouping.anchored_groups(rows, ["k"], "s", 10 * HOUR, rows=500).select("event_id", "anchor")


@query(
    "q_even_chunks",
    f"SELECT {HOT_USER} AS k, count(*) AS n, CAST(1 AS BIGINT) AS in_order, CAST(1 AS BIGINT) AS even FROM events GROUP BY 1",
)
def even_chunks(spark, sf_dir):
    """Chunks of about 500 events: their ranges follow each other, and none holds more than five times as many."""
    order = ["value", "event_id"]
    rows = table(spark, sf_dir, "events").select(F.expr(HOT_USER).alias("k"), *order)
    cut = ordered.even_chunks(rows, ["k"], order, rows=500)
    place = F.struct(*order)
    per = cut.groupBy("k", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    ordered_chunks = ordered.scan(per, ["k"], ["chunk"], F.floor(F.col("chunk") / 4096), [ordered.Previous("before", F.col("high"))])
    follows = F.col("before").isNull() | (F.col("before") < F.col("low"))
    return ordered_chunks.groupBy("k").agg(
        F.sum("n").alias("n"), F.min(follows.cast("bigint")).alias("in_order"), F.min((F.col("n") <= 2500).cast("bigint")).alias("even")
    )
