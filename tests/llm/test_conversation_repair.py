"""Repair of conversations: audits against every possible sequence of edits, facts and hashes against plain code."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from caderneta.llm import conversation_repair as cr

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def faults(rows):
    """First fault of each (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        if BLANK.match(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows):
    """(cost, audit, lines) of all sequences of edits with at most two insertions at a place."""
    found = [(0, "", ())]
    marks = faults(rows)
    for at in range(len(rows) + 1):
        for _ in range(2):
            found += [(c + 2, a + "I", (*m, f"{r}:")) for c, a, m in found for r in ("user", "assistant") if not a.endswith("II")]
        found = list(set(found))
        if at == len(rows):
            break
        role, text = rows[at]
        after = []
        for c, a, m in found:
            after.append((c + 3, a + "D", m))
            if marks[at] not in ("blank", "duplicate"):
                t = marks[at] == "truncated"
                after.append((c + t, a + "K", (*m, f"{role}:{text}")))
                after += [(c + 2 + t, a + "R", (*m, f"{r}:{text}")) for r in ("user", "assistant")]
        found = after
    return [x for x in found if PATTERN.match("".join(line[:1] for line in x[2]))]


def plain_walk(rows):
    """(cost, audit, lines) by the same recurrence over whole strings, for longer conversations."""
    best = {0: (0, "", ())}

    def offer(to, state, value):
        if state not in to or value < to[state]:
            to[state] = value

    def insertions(held):
        out = dict(held)
        for s in (0, 1, 3):
            if s in held:
                c, a, m = held[s]
                offer(out, 2, (c + 2, a + "I", (*m, "user:")))
        if 2 in out:
            c, a, m = out[2]
            offer(out, 3, (c + 2, a + "I", (*m, "assistant:")))
        return out

    for (role, text), mark in zip(rows, faults(rows), strict=True):
        after = {}
        for s, (c, a, m) in insertions(best).items():
            offer(after, s, (c + 3, a + "D", m))
            if mark in ("blank", "duplicate"):
                continue
            c += mark == "truncated"
            to, name = (3, "assistant") if s == 2 else (2, "user")
            if role[:1] == "s" and s == 0:
                offer(after, 1, (c, a + "K", (*m, f"{role}:{text}")))
            if role[:1] == name[:1]:
                offer(after, to, (c, a + "K", (*m, f"{role}:{text}")))
            offer(after, to, (c + 2, a + "R", (*m, f"{name}:{text}")))
        best = after
    best = insertions(best)
    return min(best[s] for s in (0, 3) if s in best)


def brute(rows, walk):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, role or (" " if role is None else ""), " " if text is None else text))
    out = {}
    for conv, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        marks = faults([m[1:] for m in members])
        turns = [m[0] for m in members if m[0] is not None]
        cost, audit, lines = walk([m[1:] for m in members])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(members, members[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def collected(df):
    return {r["conv"]: tuple(r)[1:] for r in df.collect()}


def solved(rows, prime=cr.PRIME):
    best = cr.start(cr.EMPTY)
    for (role, _), mark in zip(rows, faults(rows), strict=True):
        best = cr.after_row(best, role[:1], mark in ("blank", "duplicate"), mark == "truncated", prime)
    cost, node = cr.final(best, prime)
    return cost, cr.text_of(node)


def made_up(rng, most):
    return [
        (rng.choice(["user", "assistant", "system", "tool", "", "u"]), rng.choice(["Yes.", "No.", "and", "", " \n", "What? ", "cut off", "!"]))
        for _ in range(rng.randrange(most))
    ]


def test_audits_are_the_first_of_the_cheapest():
    rng = random.Random(1)
    for _ in range(40):
        rows = made_up(rng, 4)
        cost, audit, lines = min(every_repair(rows), key=lambda x: x[:2])
        assert solved(rows) == (cost, audit)
        assert plain_walk(rows) == (cost, audit, lines)


@pytest.mark.parametrize("prime", [cr.PRIME, 2, 7])
def test_colliding_hashes_decide_nothing(prime):
    rng = random.Random(2)
    for _ in range(60):
        rows = made_up(rng, 60)
        assert solved(rows, prime) == plain_walk(rows)[:2]
    for _ in range(300):
        words = ["".join(rng.choice("DIKR") for _ in range(rng.randrange(9))) for _ in range(2)]
        nodes = []
        for word in words:
            node = cr.Node()
            for letter in word:
                node = cr.Node(node, letter, prime)
            nodes.append(node)
        assert cr.precedes(*nodes) == (words[0] < words[1])


def test_pieces_join_to_the_whole(monkeypatch):
    rng = random.Random(3)
    rows = []
    for conv in range(20):
        rows += sorted({(conv, t // 3, f"{r}", f"h{i}") for i, (t, (r, _)) in enumerate(enumerate(made_up(rng, 60)))})
    facts = [(*r, rng.randrange(1, 3), rng.random() < 0.1, rng.random() < 0.1, rng.random() < 0.3) for r in rows]
    whole = {p.conv: (p.facts, *cr.final(p.bests[cr.EMPTY])) for p, _, _ in cr.pieces([(-1,) + facts[0][1:], *facts, (99,) + facts[0][1:]])
             if p.conv not in (-1, 99)}
    monkeypatch.setattr(cr, "PIECE_ROWS", 7)
    parts = []
    for cut in (facts[:100], facts[100:103], facts[103:]):
        for piece, _, _ in cr.pieces(cut):
            costs, audits = [None] * 16, [None] * 16
            for s, best in piece.bests.items():
                for t, held in enumerate(best):
                    if held:
                        costs[4 * s + t], audits[4 * s + t] = held[0], cr.text_of(held[1])
            parts.append((piece.conv, costs, audits, piece.facts))
    assert len(parts) > 2 * len(whole)
    for conv, total, cost, audit in cr.joined(parts):
        expected, want, node = whole[conv]
        assert (total, cost, audit) == (expected, want, cr.text_of(node))


def test_nulls_ties_repeats_and_lost_conversations(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (1, 9, "user", "x" * 300_000),
        (2, None, None, None), (2, None, "user", "A."), (2, 3, "user", "A."), (2, 3, "assistant", "B"), (2, 3, "assistant", "B"),
        (None, 5, "assistant", "Só isso."), (None, None, "user", None), (3, 1, "user", " \n"), (4, 2, "", ""),
        (5, 2, "tool", "é?"), (5, 2, "tool", "é?"), (5, 2, "user", "é?\x0b"), (6, 1, "system", "S."), (7, -4, "user", "q"), (7, 4, "assistant", "."),
    ]
    df = spark.createDataFrame([(*r, "kept") for r in rows], SCHEMA + ", `conv.cost x` string")
    plain = cr.plain_rows(df)
    assert collected(cr.repair(plain, plain)) == brute(rows, plain_walk)
    empty = cr.repair(plain, plain.filter("conv = 1"))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {c for c, v in collected(empty).items() if v == nothing} == {None, 2, 3, 4, 5, 6, 7}
    assert collected(cr.repair(plain.limit(0), plain.limit(0))) == {}


def test_a_conversation_with_a_third_of_the_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, t, *x) for c in range(300) for t, x in enumerate(made_up(rng, 8))]
    rows += [(1000, t, rng.choice(["user", "assistant"]), f"{t}" + rng.choice([".", ""])) for t in range(len(rows) // 2)]
    rows += [(1001, None, "user", "same.")] * 200
    plain = cr.plain_rows(spark.createDataFrame(rows, SCHEMA).repartition(8))
    found = cr.audits(plain)
    assert collected(cr.repair(plain, plain)) == brute(rows, plain_walk)
    fixed = defaultdict(list)
    for r in sorted(cr.repaired(plain, found).collect(), key=lambda r: r["place"]):
        fixed[r["conv"]].append(r)
    assert all(PATTERN.match("".join(r["role"][0] for r in rs)) for rs in fixed.values())
    assert all([r["place"] for r in rs] == list(range(len(rs))) for rs in fixed.values())


def test_query_over_the_whole_table(spark):
    import __spark_entry__ as E

    rows = damage([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    expected = brute(rows, plain_walk)
    got = {r["conv_id"]: r for r in E.queries()["op11_conversation_repair"](spark, SF).collect()}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {c: tuple(r[n] for n in names) for c, r in got.items() if c in expected} == expected
    assert {r["audit"] for c, r in got.items() if c not in expected} <= {""}
