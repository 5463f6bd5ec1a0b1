"""Words with coordinates -> text lines in reading order.

Input ``words(doc_id, page, word_no, text, x0, x1, top)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caderneta.functions import lines as L
from caderneta.functions.text import squeeze, strip
from caderneta.operators import automaton, grouping
from caderneta.operators.export import line_chunk
from caderneta.operators.ordered import FirstKnown, row_number, scan

ROW_TOLERANCE = 2.5
CHAR_TOLERANCE = 2.0
COLUMN_GAP = 60.0
SEGMENT_GAP = 40.0
COLUMN_MARGIN = 90.0
POINTS_PER_CHUNK = 512.0
PAGE = ["doc_id", "page"]


def rows(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Words with the ``top`` of the row they belong to as ``row_top``."""
    placed = words.filter(F.col("top").isNotNull()).withColumn("top", F.col("top").cast("double"))
    return grouping.anchored_groups(placed, PAGE, "top", tolerance, "row_top")


def column_split(row_words: DataFrame) -> DataFrame:
    """Where a page's two columns part: the widest gap between the left edges of dated rows."""
    first = row_words.groupBy(*PAGE, "row_top").agg(
        F.min_by(F.struct("text", "x0"), F.struct("top", "x0", "word_no")).alias("w")
    )
    dated = first.filter(F.rlike("w.text", F.lit(L.DATE_START))).select(*PAGE, F.col("w.x0").alias("x"))
    split = grouping.largest_gap(dated, PAGE, "x", F.floor(F.col("x") / POINTS_PER_CHUNK), COLUMN_GAP)
    return split.select(*PAGE, "split")


def centre_split(chars: DataFrame, edge: str = "x1") -> DataFrame:
    """Two-cluster split of a page's character edges."""
    inked = chars.filter(strip(F.col("text")) != "")
    return grouping.two_means_split(inked, PAGE, edge, F.floor(F.col(edge) / POINTS_PER_CHUNK))


def char_lines(chars: DataFrame, tolerance: float = CHAR_TOLERANCE) -> DataFrame:
    """Lines of a page given as characters."""
    placed = chars.filter(F.col("top").isNotNull()).withColumn("top", F.col("top").cast("double"))
    grouped = grouping.anchored_groups(placed, PAGE, "top", tolerance, "row_top")
    parts = F.sort_array(F.collect_list(F.struct("x0", "word_no", "text")))
    return grouped.groupBy(*PAGE, "row_top").agg(parts.alias("p")).select(
        *PAGE, "row_top", F.array_join(F.col("p.text"), "").alias("line")
    )


def _parts(row_words: DataFrame) -> DataFrame:
    """Pieces of each row with the x of their first word.

    Words more than ``SEGMENT_GAP`` apart open a new piece, but an amount that stands alone, or in
    front of a date, closes the piece to its left. A row is one printed line, so its window is small.
    """
    row = W.partitionBy(*PAGE, "row_top").orderBy("x0", "word_no")
    value = F.rlike("text", F.lit(L.VALUE_ONLY))
    dated = F.rlike("text", F.lit(L.DATE_START))
    far = F.col("x0") - F.lag("x1").over(row) > SEGMENT_GAP
    w = row_words.withColumns({"first": F.lag("x1").over(row).isNull(), "opens": F.coalesce(far, F.lit(True))})
    next_opens = F.coalesce(F.lead("opens").over(row), F.lit(True))
    next_dated = F.coalesce(F.lead(dated).over(row), F.lit(False))
    closes = F.col("opens") & ~F.col("first") & value & (next_opens | next_dated)
    w = w.withColumn("closes", closes)
    after_closing = F.coalesce(F.lag("closes").over(row), F.lit(False)) & ~F.col("opens")
    fresh = F.when(F.col("first") | after_closing | (F.col("opens") & ~F.col("closes")), 1).otherwise(0)
    w = w.withColumn("piece", F.sum(fresh).over(row.rowsBetween(W.unboundedPreceding, 0)))
    ordered = F.sort_array(F.collect_list(F.struct("x0", "word_no", "text")))
    return w.groupBy(*PAGE, "row_top", "piece").agg(ordered.alias("p")).select(
        *PAGE, "row_top", "piece", F.col("p")[0]["x0"].alias("x"), strip(F.array_join(F.col("p.text"), " ")).alias("text")
    )


def _joined(parts: DataFrame, text: Column, keep: Column, side: int) -> DataFrame:
    chosen = parts.select(*PAGE, "row_top", "piece", F.when(keep, text).alias("t")).filter(
        F.col("t").isNotNull() & (F.col("t") != "")
    )
    ordered = F.sort_array(F.collect_list(F.struct("piece", "t")))
    return chosen.groupBy(*PAGE, "row_top").agg(ordered.alias("p")).select(
        *PAGE, "row_top", F.lit(side).alias("side"), F.array_join(F.col("p.t"), " ").alias("line")
    )


def lines(words: DataFrame) -> DataFrame:
    """``lines(doc_id, line_no, line)``: per page the left column from top to bottom, then the right one.

    A line holding only an amount is appended to the line before it.
    """
    row_words = rows(words)
    split = column_split(row_words)
    parts = _parts(row_words).join(split, PAGE, "left")
    two = F.col("split").isNotNull()
    right = two & (F.col("x") >= F.col("split") + COLUMN_MARGIN)
    # An amount at the start of a left piece stays left, what follows it belongs to the right column.
    lead = F.regexp_extract("text", rf"^({L.SIGNED_AMOUNT})", 1)
    value_first = two & ~right & (lead != "")
    rest = strip(F.substr(F.col("text"), F.length(lead) + 1))
    left_side = _joined(parts, F.when(value_first, strip(lead)).otherwise(F.col("text")), ~right, 0)
    right_side = _joined(parts, F.when(value_first, rest).otherwise(F.col("text")), right | value_first, 1)
    both = left_side.unionByName(right_side)
    chunk = F.struct("page", "side", F.floor(F.col("row_top") / POINTS_PER_CHUNK).alias("band"))
    numbered = scan(both, ["doc_id"], ["page", "side", "row_top"], chunk, [row_number("line_no")])
    tidy = numbered.select("doc_id", (F.col("line_no") - 1).alias("line_no"), strip(squeeze(F.col("line"))).alias("line"))
    merged = grouping.merge_trailing(
        tidy.filter("line <> ''"), ["doc_id"], "line_no", line_chunk(), "line", F.rlike("line", F.lit(L.VALUE_LINE))
    )
    return scan(
        merged.withColumnRenamed("line_no", "__at"), ["doc_id"], ["__at"], line_chunk("__at"), [row_number("line_no")]
    ).select("doc_id", (F.col("line_no") - 1).alias("line_no"), "line")


# Category lines: a line is skipped when the line before it held a transaction and was not skipped itself.
_PLAIN, _ITEM, _CATEGORY, _BOTH = range(4)
_SKIP_TABLE = [[0, 0], [1, 1], [0, 0], [1, 0]]


def drop_category_lines(text_lines: DataFrame) -> DataFrame:
    """Without the category line printed under a transaction."""
    has_item = F.size(L.split_line(F.col("line"))) > 0
    category = F.rlike("line", F.lit(L.CATEGORY_LINE))
    code = F.when(has_item & category, _BOTH).when(category, _CATEGORY).when(has_item, _ITEM).otherwise(_PLAIN)
    flagged = text_lines.withColumns({"__code": code, "__cat": category})
    known = automaton.states_before(flagged, ["doc_id"], "line_no", automaton.fold_chunk("line_no"), "__code", _SKIP_TABLE, 0, "__skip")
    return known.filter(~((F.col("__skip") == 1) & F.col("__cat"))).select(*text_lines.columns)


def adopt_unassigned(blocks: DataFrame, card: str = "card") -> DataFrame:
    """Blocks read before any card header go to the first card of the document."""
    filled = scan(
        blocks, ["doc_id"], ["line_no", "idx"], line_chunk(), [FirstKnown("__first", F.col(card))]
    )
    return filled.withColumn(card, F.coalesce(F.col(card), F.col("__first"))).drop("__first")


def two_column_order(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """Sort keys of blocks read across both columns.

    ``blocks(doc_id, card, side, line_no, idx)``, ``headers(doc_id, card, line_no)``. Cards come in
    order of appearance; per card the left blocks above the header, the right ones up to it, then
    the left and right ones below. Adds ``card_rank``, ``bucket``, ``major``, ``minor``.
    """
    header = headers.groupBy("doc_id", "card").agg(F.min("line_no").alias("__header"))
    cards = blocks.groupBy("doc_id", "card").agg(F.min(F.struct("line_no", "idx")).alias("__seen"))
    ranked = scan(
        cards.select("doc_id", "card", F.col("__seen.line_no").alias("l"), F.col("__seen.idx").alias("i")),
        ["doc_id"], ["l", "i", "card"], line_chunk("l"), [row_number("card_rank")],
    ).select("doc_id", "card", "card_rank")
    placed = blocks.join(ranked, ["doc_id", "card"]).join(header, ["doc_id", "card"], "left")
    left = F.col("side") == "left"
    early_left = F.col("__header").isNull() | (F.col("line_no") < F.col("__header"))
    early_right = F.col("__header").isNull() | (F.col("line_no") <= F.col("__header"))
    bucket = (
        F.when(left & early_left, 0).when(~left & early_right, 1).when(left, 2).otherwise(3)
    )
    return placed.select(
        *blocks.columns, "card_rank", bucket.alias("bucket"),
        F.when(left, F.col("line_no")).otherwise(F.col("idx")).alias("major"),
        F.when(left, F.col("idx")).otherwise(F.col("line_no")).alias("minor"),
    )


def section_slice(text_lines: DataFrame, last4: str) -> DataFrame:
    """Lines from the start of a card up to its printed total."""
    marker = L.card_marker(F.col("line"))
    marked = text_lines.withColumn("__m", marker)
    at = F.col("line_no")
    mine = F.col("__m.last4") == last4
    bounds = marked.filter(mine).groupBy("doc_id").agg(
        F.min(F.when(F.col("__m.kind") == "start", at)).alias("__a"),
        F.min(F.when(F.col("__m.kind") == "total", at)).alias("__b"),
    )
    inside = (at >= F.col("__a")) & (F.col("__b").isNull() | (at <= F.col("__b")))
    return text_lines.join(bounds, "doc_id").filter(inside).select(*text_lines.columns)
