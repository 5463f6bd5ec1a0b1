"""Cheapest repair of a conversation's structure, with an audit of the edits.

A repaired conversation's roles are ``(s?(ua)+)?``. A dynamic program over the rows keeps, for each of the four states of that pattern, the
cheapest edits so far and among equally cheap ones the audit that comes first in ASCII order. Audits are linked nodes: an edit adds one node to the
audit before it, so audits share what they have in common. A node knows ancestors at distances of powers of two and a rolling hash;
two audits are compared at the end of their longest common prefix, which a binary descent over the hashes finds. The prefix is then
compared node by node up to the first shared one, so a collision of hashes can't decide.

Equally cheap audits of the same state are never prefixes of each other, because an audit determines its cost; so the first audit of a
longer conversation begins with the first audit of each state.

Rows are sorted over all partitions by conversation and turn, so a conversation of any length lies in several. A partition solves the conversations
that lie in it whole; at its ends, and after ``PIECE_ROWS`` rows, it leaves pieces: cheapest edits from each state to each state. Pieces
of a conversation are joined in order. Only the audit and the hash of a repaired conversation, each one value by its nature, come about in one task, in a
stream of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.llm.common import col, partitions
from caderneta.operators.ordered import null_safe_join
from caderneta.session import materialise

WHITE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
# States of the pattern: nothing yet, after the system row, after a user, after an assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
BEFORE_USER = (EMPTY, SYSTEM, ASSISTANT)
LEGAL = {"su", "ua", "au"}
PRIME = (1 << 61) - 1
BASE = 1_000_003
PIECE_ROWS = 1 << 14
BATCH_BYTES = 1 << 22


class Node:
    """The last edit of an audit; ``up[j]`` is the node 2**j edits earlier."""

    __slots__ = ("letter", "depth", "hash", "up")

    def __init__(self, before: Node | None = None, letter: str = "", prime: int = PRIME):
        self.letter = letter
        if before is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth, self.hash = before.depth + 1, (before.hash * BASE + ord(letter)) % prime
        up = [before]
        while len(up) <= len(up[-1].up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)


def text_of(node: Node) -> str:
    letters = []
    while node.depth:
        letters.append(node.letter)
        node = node.up[0]
    return "".join(reversed(letters))


def _lifted(node: Node, depth: int) -> Node:
    while node.depth > depth:
        node = node.up[(node.depth - depth).bit_length() - 1]
    return node


def _same(x: Node, y: Node) -> bool:
    """Whether audits of equal length are equal, read back to the first node that they share."""
    while x is not y:
        if x.letter != y.letter:
            return False
        if not x.depth:
            return True
        x, y = x.up[0], y.up[0]
    return True


def precedes(a: Node, b: Node) -> bool:
    """Whether audit ``a`` stands before ``b`` in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = _lifted(a, depth), _lifted(b, depth)
    if x.hash == y.hash:
        return a.depth < b.depth if _same(x, y) else text_of(a) < text_of(b)
    for j in reversed(range(len(x.up))):
        if j < len(x.up) and x.up[j].hash != y.up[j].hash:
            x, y = x.up[j], y.up[j]
    return x.letter < y.letter if x.letter != y.letter and _same(x.up[0], y.up[0]) else text_of(a) < text_of(b)


Best = list[tuple[int, Node] | None]


def _offer(best: Best, state: int, cost: int, before: Node, letter: str, prime: int) -> None:
    held = best[state]
    if held is None or cost < held[0]:
        best[state] = cost, Node(before, letter, prime)
    elif cost == held[0] and precedes(node := Node(before, letter, prime), held[1]):
        best[state] = cost, node


def inserted(best: Best, prime: int = PRIME) -> Best:
    """``best`` after any useful insertions: a user, an assistant, or both."""
    out = list(best)
    for state in BEFORE_USER:
        if best[state]:
            _offer(out, USER, best[state][0] + INSERT_COST, best[state][1], INSERT, prime)
    if out[USER]:
        _offer(out, ASSISTANT, out[USER][0] + INSERT_COST, out[USER][1], INSERT, prime)
    return out


def after_row(best: Best, initial: str, must_go: bool, truncated: bool, prime: int = PRIME) -> Best:
    """The cheapest edits behind one more row, insertions in front of it included."""
    out: Best = [None] * 4
    for state, held in enumerate(inserted(best, prime)):
        if held is None:
            continue
        cost, node = held
        _offer(out, state, cost + DELETE_COST, node, DELETE, prime)
        if must_go:
            continue
        cost += TRUNCATED_COST if truncated else 0
        if state == EMPTY and initial == "s":
            _offer(out, SYSTEM, cost, node, KEEP, prime)
        target, wanted = (ASSISTANT, "a") if state == USER else (USER, "u")
        if initial == wanted:
            _offer(out, target, cost, node, KEEP, prime)
        _offer(out, target, cost + REROLE_COST, node, REROLE, prime)
    return out


def start(state: int) -> Best:
    out: Best = [None] * 4
    out[state] = 0, Node()
    return out


def final(best: Best, prime: int = PRIME) -> tuple[int, Node]:
    """The cheapest complete repair."""
    ends = [x for x in (best[EMPTY], inserted(best, prime)[ASSISTANT]) if x]
    cost = min(c for c, _ in ends)
    nodes = [n for c, n in ends if c == cost]
    return cost, nodes[0] if len(nodes) == 1 or precedes(*nodes) else nodes[1]


@dataclass
class Facts:
    """Counts of a run of rows, which join with those of the run behind it."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str = ""
    last: str = ""
    first_turn: int | None = None
    last_turn: int | None = None
    rows: int = 0

    def join(self, other: Facts) -> None:
        if not other.rows:
            return
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal + (self.rows > 0 and self.last + other.first not in LEGAL)
        # Rows are in the order of turns, so only neighbouring runs can share one; null turns come first.
        self.turns += other.turns - (other.turns > 0 and self.turns > 0 and self.last_turn == other.first_turn)
        self.low = other.low if self.low is None else self.low
        self.high = other.high if other.high is not None else self.high
        self.first = other.first if not self.rows else self.first
        self.first_turn = other.first_turn if not self.rows else self.first_turn
        self.last, self.last_turn = other.last, other.last_turn
        self.rows += other.rows

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last", "first_turn", "last_turn", "rows"]


@dataclass
class Piece:
    """A run of rows of one conversation: its facts, and the best edits from every possible state in front of it."""

    conv: object
    opening: tuple
    known: bool
    bests: dict[int, Best] = field(default_factory=dict)
    facts: Facts = field(default_factory=Facts)

    def __post_init__(self) -> None:
        self.bests = {s: start(s) for s in ([EMPTY] if self.known else range(4))}

    def add(self, turn: int | None, role: str, n: int, seen: bool, blank: bool, truncated: bool) -> None:
        """``n`` equal rows; ``seen`` if an equal row of another turn stands earlier."""
        initial = role[:1]
        spare = 0 if blank else n if seen else n - 1
        held = n - spare if not blank else 0
        must_go = blank or seen
        row = Facts(
            n if blank else 0, spare, held if truncated else 0, n - 1, turn is not None, turn, turn, initial, initial, turn, turn, n
        )
        self.facts.join(row)
        for state, best in self.bests.items():
            best = after_row(best, initial, must_go, truncated)
            for _ in range(n - 1):
                best = after_row(best, initial, True, False)
            self.bests[state] = best


def pieces(rows: Iterable[tuple]) -> Iterator[tuple[Piece, bool, bool]]:
    """(piece, conversation begins with it, conversation ends with it) for sorted rows (conv, turn, role, sha, n, seen, blank, truncated).

    At either end of the rows it isn't known whether the conversation goes on in another partition.
    """
    piece, begins, first = None, False, True
    for conv, turn, role, sha, n, seen, blank, truncated in rows:
        if piece is not None and piece.conv != conv:
            yield piece, begins, True
            piece = None
            first = False
            begins = True
        elif piece is None:
            begins = not first
        elif piece.facts.rows >= PIECE_ROWS:
            yield piece, begins, False
            piece, begins = None, False
        if piece is None:
            piece = Piece(conv, (turn, role, sha), begins)
        piece.add(turn, role, n, seen, blank, truncated)
    if piece is not None:
        yield piece, begins, False


def facts_of(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: (conv, turn, role, sha, n, seen, blank, truncated), from (conv, turn, role, text)."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE_CHARS))
    brief = rows.select(
        "conv", "turn", "role", F.sha2("text", 256).alias("sha"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    equal = materialise(
        brief.groupBy("conv", "turn", "role", "sha", "blank", "truncated").agg(F.count("*").alias("n")), "conversation-rows"
    )
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    earliest = equal.groupBy("conv", "role", "sha").agg(F.min(place).alias("earliest"))
    joined = null_safe_join(equal, earliest, ["conv", "role", "sha"])
    seen = ~F.col("earliest.turn").eqNullSafe(F.col("turn"))
    return joined.select("conv", "turn", "role", "sha", "n", seen.alias("seen"), "blank", "truncated")


def _flat(facts: Facts) -> list:
    return [getattr(facts, c) for c in COUNTS]


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterable[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``BATCH_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


PIECE_SCHEMA = (
    "turn long, role string, sha string, whole boolean, cost long, audit string, costs array<long>, audits array<string>, "
    "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, "
    "first_turn long, last_turn long, rows long"
)
AUDIT_SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arrow(df: DataFrame, spec: str) -> tuple[pa.Schema, str]:
    """Arrow and Spark schema of a result that begins with the column ``conv`` of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([df.schema["conv"], *StructType.fromDDL(spec).fields])
    return to_arrow_schema(schema), schema


def _solved(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for piece, begins, ends in pieces(_tuples(batches)):
                whole = begins and ends
                cost, audit = None, None
                costs, audits = [None] * 16, [None] * 16
                if whole:
                    cost, node = final(piece.bests[EMPTY])
                    audit = text_of(node)
                else:
                    for s, best in piece.bests.items():
                        for t, held in enumerate(best):
                            if held:
                                costs[4 * s + t], audits[4 * s + t] = held[0], text_of(held[1])
                yield (piece.conv, *piece.opening, whole, cost, audit, costs, audits, *_flat(piece.facts))

        yield from _batched(rows(), schema, lambda r: 300 + len(r[6] or "") + sum(len(a or "") for a in r[8]))

    return run


class Rope:
    """Audit of several pieces: the last piece's part and the rope before it."""

    __slots__ = ("before", "part", "depth")

    def __init__(self, before: Rope | None = None, part: str = ""):
        self.before, self.part, self.depth = before, part, 0 if before is None else before.depth + 1

    def parts(self, down_to: Rope | None = None) -> str:
        out, at = [], self
        while at is not None and at is not down_to:
            out.append(at.part)
            at = at.before
        return "".join(reversed(out))

    def precedes(self, other: Rope) -> bool:
        """ASCII order, decided behind the last rope that both share; both are as many pieces long."""
        x, y = self, other
        while x is not y:
            x, y = x.before, y.before
        return self.parts(x) < other.parts(x)


def joined(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conv, facts, cost, audit) from the sorted pieces (conv, costs, audits, facts) of conversations."""
    conv, best, facts = None, None, None

    def done():
        ends = [(c, r) for c, r in (best[EMPTY] or (None, None), best[ASSISTANT] or (None, None)) if r]
        for state, edits in ((EMPTY, "II"), (SYSTEM, "II"), (USER, "I"), (ASSISTANT, "II")):
            if best[state]:
                ends.append((best[state][0] + INSERT_COST * len(edits), Rope(best[state][1], edits)))
        cost = min(c for c, _ in ends)
        return conv, facts, cost, min(r.parts() for c, r in ends if c == cost)

    for piece_conv, costs, audits, piece_facts in rows:
        if best is not None and piece_conv != conv:
            yield done()
            best = None
        if best is None:
            conv, facts, best = piece_conv, Facts(), [(0, Rope()), None, None, None]
        out = [None] * 4
        for s, held in enumerate(best):
            for t in range(4):
                if held is None or costs[4 * s + t] is None:
                    continue
                cost, rope = held[0] + costs[4 * s + t], Rope(held[1], audits[4 * s + t])
                if out[t] is None or cost < out[t][0] or (cost == out[t][0] and rope.precedes(out[t][1])):
                    out[t] = cost, rope
        best = out
        facts.join(piece_facts)
    if best is not None:
        yield done()


def _merged(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r[0], r[7], r[8], Facts(*r[9:])) for r in _tuples(batches))
        out = ((c, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, cost, audit) for c, f, cost, audit in joined(rows))
        yield from _batched(out, schema, lambda r: 100 + len(r[-1]))

    return run


def plain_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) of any table; a null role or text counts as one space."""
    space = F.lit(" ")
    return df.select(
        col(conv).alias("conv"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), space).alias("role"),
        F.coalesce(col(text), space).alias("text"),
    )


def audits(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``plain_rows``.

    Rows go by turn, nulls first; rows of one turn by role and hash of the text, so repeated rows are neighbours. Rows without a
    conversation form one. Ties between equally cheap audits go to the first in ASCII order. A text of any length counts by its hash, its first
    fault and nothing else. An empty table gives an empty result. ``gaps`` ignores null turns.
    """
    parts = partitions(rows.sparkSession)
    order = ["conv", "turn", "role", "sha"]
    sorted_rows = facts_of(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    arrow, spark_schema = _arrow(rows, PIECE_SCHEMA)
    found = materialise(sorted_rows.mapInArrow(_solved(arrow), spark_schema), "conversation-pieces")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = found.filter("whole").select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    cut = found.filter("NOT whole").repartition(parts, "conv").sortWithinPartitions(*order)
    arrow, spark_schema = _arrow(rows, AUDIT_SCHEMA)
    return whole.unionByName(cut.mapInArrow(_merged(arrow), spark_schema))


def messages(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conv, role, text, edit) of repaired conversations; (conv, None, None, None) ends one.

    ``rows`` are (conv, is_row, role, text), sorted, with the audit as the text of the row in front of each conversation.
    """

    def insertions(audit: str, at: int, place: int) -> Iterator[tuple]:
        while at < len(audit) and audit[at] == INSERT:
            yield "assistant" if place % 2 else "user", "", INSERT
            at, place = at + 1, place + 1

    audit, at, place, conv, opened = "", 0, 0, None, False

    def closing():
        return [*((conv, *m) for m in insertions(audit, at, place)), (conv, None, None, None)]

    for row_conv, is_row, role, text in rows:
        if not is_row:
            if opened:
                yield from closing()
            audit, at, place, conv, opened = text, 0, 0, row_conv, True
            continue
        for message in insertions(audit, at, place):
            yield (conv, *message)
            at, place = at + 1, place + 1
        edit, at = audit[at], at + 1
        if edit == DELETE:
            continue
        if edit == KEEP and role[:1] == "s":
            yield conv, role, text, edit
            continue
        yield conv, role if edit == KEEP else "assistant" if place % 2 else "user", text, edit
        place += 1
    if opened:
        yield from closing()


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of each conversation in order, its audit in front; one shuffle by conversation, sorted on disk."""
    nothing = F.lit("")
    fronts = found.select(
        "conv", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("sha"),
        F.col("audit").alias("text"),
    )
    body = rows.select("conv", F.lit(True).alias("is_row"), "turn", "role", F.sha2("text", 256).alias("sha"), "text")
    both = fronts.unionByName(body).repartition(partitions(rows.sparkSession), "conv")
    return both.sortWithinPartitions("conv", "is_row", "turn", "role", "sha").select("conv", "is_row", "role", "text")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, role, text, edit): the rows of the repaired conversations, from ``plain_rows`` and their ``audits``."""
    arrow, spark_schema = _arrow(rows, "place long, role string, text string, edit string")

    def run(batches):
        def out():
            place = 0
            for conv, role, text, edit in messages(_tuples(batches)):
                if role is None:
                    place = 0
                else:
                    yield conv, place, role, text, edit
                    place += 1

        yield from _batched(out(), arrow, lambda r: 50 + len(r[3]))

    return _with_audits(rows, found).mapInArrow(run, spark_schema)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): hash of each repaired conversation's ``role:text`` lines."""
    arrow, spark_schema = _arrow(rows, "repaired_sha256 string")

    def run(batches):
        def out():
            sha, lines = hashlib.sha256(), 0
            for conv, role, text, _ in messages(_tuples(batches)):
                if role is None:
                    yield conv, sha.hexdigest()
                    sha, lines = hashlib.sha256(), 0
                else:
                    sha.update(("\n" if lines else "").encode() + role.encode() + b":" + text.encode())
                    lines += 1

        yield from _batched(out(), arrow, lambda r: 100)

    return _with_audits(rows, found).mapInArrow(run, spark_schema)


def repair(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Facts, audit and hash for each ``conv`` of ``original``; one without ``rows`` has zeros and the hash of the empty string."""
    found = materialise(audits(rows), "conversation-audits")
    known = null_safe_join(original.select("conv").distinct(), found, ["conv"], "left")
    hashed = null_safe_join(known, digests(rows, found), ["conv"], "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return hashed.select(
        "conv", *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``plain_rows`` damaged by the CRC-32 of ``conv:turn``, nulls as one space: rows lost, emptied, cut, repeated, or of another role."""
    label = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    kind = F.crc32(F.concat(label[0], F.lit(":"), label[1]).cast("binary")) % 20
    text: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    out = rows.withColumn("kind", kind).filter("kind != 0").select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return out.select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("col")
