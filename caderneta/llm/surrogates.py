"""Surrogates for personal data: keyed, type-consistent replacements.

Entities are found by patterns with checks (card and account check digits, address ranges) and names by titles or known given names. Each entity has a canonical value; the
distinct ones of the corpus form a ledger in which a keyed hash gives each a surrogate of the same kind: an address stays an address of the same
shape, a card number keeps its length, separators and a valid check digit, a name keeps gender and script. Surrogates that meet, or that are
real entities of the corpus, are drawn again until all are distinct, so different entities stay different; where a short shape has too few
values, the replacement gets longer. The same entity has
the same surrogate everywhere, also where a surname or given name stands alone later in the text.

Only texts that a cheap test of the JVM can't rule out are looked at, and only these are joined with their surrogates. A text that occurs often
is looked at for each row but has its surrogates looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.llm.common import col, cols, fresh, short_batches
from caderneta.session import materialise

# Attempts in the value's own shape; later ones are wider by a character each, as all values of a short shape may be taken.
# Telephone numbers have room enough and lose their layout sooner.
PLAIN_ATTEMPTS, PLAIN_PHONES = 8, 64
# A deployment passes its own secret; the checkable queries use this public one, so that their results can be repeated.
DEMONSTRATION_KEY = "public demonstration key"

# Titles by gender, given names by gender and script, surname parts by script.
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Doña Госпожа Κυρία",
    "m": "Mr Sir Herr Monsieur Señor Sr Don Господин Κύριος",
    "x": "Dr Prof",
}
GIVEN = {
    ("f", "latin"): "Anna Maria Emma Julia Sophie Laura Clara Elena Lucía Carmen Marie Camille Chloé Claire Ingrid Greta Heidi Sabine Sarah Emily Jane Alice Mary Susan",
    ("m", "latin"): "John James Robert Michael David Peter Thomas Paul Jean Pierre Louis Antoine Hans Klaus Jürgen Stefan Carlos José Miguel Luis Diego Henry George William",
    ("x", "latin"): "Alex Robin Sascha Kim Dominique Charlie Jordan Morgan",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна",
    ("m", "cyrillic"): "Иван Сергей Алексей Дмитрий Николай Андрей Михаил Павел",
    ("x", "cyrillic"): "Саша Женя Валя",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα",
    ("m", "greek"): "Γιώργος Δημήτρης Νίκος Κώστας Παύλος",
    ("x", "greek"): "Άλεξ Βίκι",
}
ENDINGS = {
    ("f", "latin"): "a ina elle", ("m", "latin"): "o en us", ("x", "latin"): "y in is",
    ("f", "cyrillic"): "а ина ия", ("m", "cyrillic"): "ий ан ор", ("x", "cyrillic"): "е и ю",
    ("f", "greek"): "α ινα ώ", ("m", "greek"): "ος ης ας", ("x", "greek"): "ι υ ε",
}
SYLLABLES = {
    "latin": "ba ber bor cal dan del dor far fen gar hal hol ken lan lin lor mar mel mor nan nor pel ral ren ros sal sel tan tor val ven wil",
    "cyrillic": "ба бор вал вин гор дан дор жар зан кал кор лан лин мар мор нар ов пел рас ров сал сел тар тин фед хар",
    "greek": "βα γαλ δαν δορ θαν καλ κορ λαν λιν μαρ μελ ναν νορ παλ ραν ροδ σαλ σελ ταν τορ φαν χαλ",
}

_CAP = r"[^\W\d_a-zà-öø-ÿа-яёα-ω][^\W\d_]+(?:[-'’](?!s\b)[^\W\d_]+)*"
_GENDER = {n: g for (g, _), names in GIVEN.items() for n in names.split()}
_TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles.split()}
_ANY_TITLE = "|".join(sorted(_TITLE_GENDER, key=len, reverse=True))
_ANY_GIVEN = "|".join(sorted(_GENDER, key=len, reverse=True))
_BLANK = r"[ \t\xa0]"
_PARTICLE = r"(?:de|la|las|los|del|della|dei|di|da|do|dos|das|du|des|le|van|von|vom|der|den|ter|ten|zu|zum|zur|af|av|bin|ibn|al|el|y)"
# One letter with a dot, or without it before a further part.
_INITIAL = rf"[^\W\d_a-zà-öø-ÿа-яёα-ω](?:\.|(?={_BLANK}+[^\W\d_a-zà-öø-ÿа-яёα-ω]))"
_LINK = rf"(?:{_INITIAL}{_BLANK}*|{_PARTICLE}{_BLANK}+)*"
_RUN = rf"{_LINK}{_CAP}(?:{_BLANK}+{_LINK}{_CAP})*"

PATTERNS: list[tuple[str, str]] = [
    ("email", r"(?<![A-Za-z0-9_%+.-])[A-Za-z0-9_%+-]{1,64}(?:\.[A-Za-z0-9_%+-]{1,64}){0,8}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    ("secret", r"(?i:(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd))\b[\"']?[ \t]*[=:][ \t]*[\"']?(?P<secret>[A-Za-z0-9_/+.~-]{6,})"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"),
    ("card", r"(?<![\d+])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
     r"|(?<![\w+.-])00[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
     r"|(?<![\w+.-])0[1-9]\d{1,4}[ /-]\d{2,8}(?:[ -]\d{2,8}){0,4}(?![\d-])|(?<![\w+.-])0[1-9](?:[ .-]\d{2}){4}(?![\d-])"
     r"|(?<![\w+])\(0\d{1,4}\)[ .-]?\d{2,8}(?:[ -]\d{2,8}){0,3}(?!\d)|(?<![\w+.-])[1-9]\d{2} \d{3} \d{4}(?![\d-])"),
    ("name", rf"(?<!\w)(?:(?P<title>{_ANY_TITLE})\.?{_BLANK}+(?P<titled>{_RUN})|(?P<given>{_ANY_GIVEN}){_BLANK}+(?P<family>{_RUN}))(?!\w)"),
]
# What a text must hold for a kind; patterns of other kinds aren't tried on it.
_NEEDS = {
    "email": re.compile("@"), "secret": re.compile("[=:]"), "ip": re.compile(r"\d\."), "ssn": re.compile(r"\d-\d"),
    **dict.fromkeys(("iban", "card", "phone"), re.compile(r"\d")),
}


@cache
def _finder(kinds: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<k_{kind}>{pattern})" for kind, pattern in PATTERNS if kind in kinds))


# Every text with an entity passes this: other kinds need one of these characters, names two words with capitals in a row, one before a particle, or a title with a dot.
# Each branch begins with a class of characters, which most places in a text fail at once.
MAY_HOLD = r"[@0-9=:]|\p{Lu}(?<!\p{L}\p{Lu})\p{L}*+[ \t\xa0]++\p{Lu}|(?=\p{Lu})\b(?:" + _ANY_TITLE + r")\.[ \t\xa0]|\p{Lu}(?<!\p{L}\p{Lu})\p{L}++[ \t\xa0]++" + _PARTICLE + r"[ \t\xa0]"


def luhn_digit(digits: str) -> str:
    """Check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in f"{rest}{country}00"))
    return f"{98 - number % 97:02d}"


def script_of(word: str) -> str:
    for c in word:
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _mentions(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value), not overlapping; kinds of name parts tell gender and script."""
    held = {need: need.search(text) is not None for need in set(_NEEDS.values())}
    kinds = tuple(kind for kind, _ in PATTERNS if kind not in _NEEDS or held[_NEEDS[kind]])
    for m in _finder(kinds).finditer(text):
        kind = m.lastgroup if m.lastgroup.startswith("k_") else next(k for k, v in m.groupdict().items() if v is not None and k.startswith("k_"))
        kind, value = kind[2:], m[0]
        if kind == "email":
            yield m.start(), m.end(), kind, value.lower()
        elif kind == "iban":
            plain = value.replace(" ", "")
            if 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]:
                yield m.start(), m.end(), kind, plain
        elif kind == "secret":
            if any(c.isdigit() for c in m["secret"]):
                yield m.start("secret"), m.end("secret"), kind, m["secret"]
        elif kind == "card":
            plain = _digits(value)
            if luhn_digit(plain[:-1]) == plain[-1]:
                yield m.start(), m.end(), kind, plain
        elif kind == "phone":
            plain = _digits(value)
            if 8 <= len(plain) <= 15:
                yield m.start(), m.end(), kind, ("+" if value[0] == "+" else "") + plain
        elif kind == "name":
            yield from _name_parts(m)
        else:
            yield m.start(), m.end(), kind, value


def _name_parts(m: re.Match) -> Iterator[tuple[int, int, str, str]]:
    if m["given"]:
        begin, gender = m.start("family"), _GENDER[m["given"]]
        parts = [m.span("given")] + [(begin + w.start(), begin + w.end()) for w in re.finditer(rf"(?<!\w){_CAP}", m["family"])]
    else:
        begin, gender = m.start("titled"), _TITLE_GENDER[m["title"]]
        parts = [(begin + w.start(), begin + w.end()) for w in re.finditer(rf"(?<!\w){_CAP}", m["titled"])]
        first = m.string[slice(*parts[0])]
        gender = _GENDER.get(first, gender) if gender == "x" else gender
    if not all(m.string[a].isupper() for a, _ in parts):
        return
    for i, (a, b) in enumerate(parts):
        word = m.string[a:b]
        given = len(parts) > 1 and i < len(parts) - 1 and (i == 0 or not m["given"] or word in _GENDER)
        yield a, b, f"given {gender} {script_of(word)}" if given else f"family {script_of(word)}", word.casefold()


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a whole text in order, with the parts of its names where they stand alone."""
    found = list(_mentions(text))
    parts = {v: k for _, _, k, v in found if k.startswith(("given", "family"))}
    if parts:
        taken = [(a, b) for a, b, _, _ in found]
        alone = re.compile(rf"(?<!\w){_CAP}(?!\w)")
        at = 0
        for m in alone.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if (at == len(taken) or m.end() <= taken[at][0]) and m[0].casefold() in parts:
                found.append((*m.span(), parts[m[0].casefold()], m[0].casefold()))
        found.sort()
    return found


def _stream(key: str, kind: str, value: str, attempt: int) -> Callable[[int], int]:
    """Numbers below n, one after another, that depend on all arguments."""
    n, state = 0, f"{key}\x00{kind}\x00{value}\x00{attempt}"

    def draw(below: int) -> int:
        nonlocal n
        n += 1
        return xxhash.xxh3_64_intdigest(f"{state}\x00{n}".encode()) % below

    return draw


def _same_kind(c: str, draw: Callable[[int], int], hexadecimal: bool = False) -> str:
    if c.isdigit():
        return str(draw(10))
    if hexadecimal and c in "abcdefABCDEF":
        return ("abcdef" if c.islower() else "ABCDEF")[draw(6)]
    if "a" <= c <= "z":
        return chr(97 + draw(26))
    if "A" <= c <= "Z":
        return chr(65 + draw(26))
    return c


@cache
def _words(listed: str) -> list[str]:
    return listed.split()


def surrogate(key: str, kind: str, value: str, attempt: int = 0) -> str:
    """Replacement of a canonical value, in canonical form; another one for each attempt.

    After ``PLAIN_ATTEMPTS`` the shape gets wider with each attempt, so that in the end there is a free value for every one.
    """
    draw = _stream(key, kind, value, attempt)
    wider = max(0, attempt + 1 - (PLAIN_PHONES if kind == "phone" else PLAIN_ATTEMPTS))
    if kind == "email":
        local, _, domain = value.partition("@")
        *names, top = domain.split(".")
        return "".join(_same_kind(c, draw) for c in local) + "".join(chr(97 + draw(26)) for _ in range(wider)) + "@" + ".".join("".join(_same_kind(c, draw) for c in n) for n in names) + "." + top
    if kind == "ip":
        parts = [3 if wider else len(p) for p in value.split(".")]
        return ".".join(str(1 + draw(9) if n == 1 else 10 + draw(90) if n == 2 else 100 + draw(156)) for n in parts)
    if kind == "card":
        body = value[0] + "".join(str(draw(10)) for _ in value[1:-1])
        return body + luhn_digit(body)
    if kind == "ssn":
        return f"{100 + draw(900) if wider else 900 + draw(100)}-{10 + draw(90)}-{1000 + draw(9000)}"
    if kind == "iban":
        rest = "".join(_same_kind(c, draw) for c in value[4:])
        return value[:2] + iban_check(value[:2], rest) + rest
    if kind == "phone":
        # Sign and first digit of the country code, or the prefix of zeros.
        kept = 2 if value[0] == "+" else len(value) - len(value[:-1].lstrip("0")) - 1
        return value[:kept] + "".join(str(1 + draw(9)) if c == value[kept] and i == 0 else str(draw(10)) for i, c in enumerate(value[kept:] + "0" * wider))
    if kind == "secret":
        hexadecimal = all(c in "0123456789abcdefABCDEF" for c in value)
        return "".join(_same_kind(c, draw, hexadecimal) for c in value + "0" * wider)
    part, *rest = kind.split()
    script = rest[-1]
    syllables = _words(SYLLABLES[script])
    stem = "".join(syllables[draw(len(syllables))] for _ in range(2 + min(attempt, 4) + wider))
    if part == "family":
        return stem + syllables[draw(len(syllables))]
    if attempt == 0:
        names = _words(GIVEN[rest[0], script])
        return names[draw(len(names))].casefold()
    endings = _words(ENDINGS[rest[0], script])
    return stem + endings[draw(len(endings))]


def rendered(mention: str, kind: str, replacement: str) -> str:
    """The canonical replacement in the format of the mention: separators and letter case."""
    if kind in ("card", "phone", "iban"):
        plain = iter(replacement.lstrip("+") if kind == "phone" else replacement)
        return "".join(next(plain) if c.isalnum() else c for c in mention) + "".join(plain)
    if kind == "email":
        if mention.isupper():
            return replacement.upper()
        return "".join(r.upper() if mention[i : i + 1].isupper() else r for i, r in enumerate(replacement))
    if kind.startswith(("given", "family")):
        if mention.isupper():
            return replacement.upper()
        return "-".join(replacement.title() if i == 0 else replacement[:3].title() for i, _ in enumerate(re.split("-", mention)))
    return replacement


def replaced(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """Text with the spans (start, end, kind, canonical replacement) replaced, each in the format of its mention."""
    out, at = [], 0
    for start, end, kind, new in sorted(spans):
        out += [text[at:start], rendered(text[start:end], kind, new)]
        at = end
    return "".join(out) + text[at:]


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def ledger(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value), all surrogates of a kind distinct and none of them an entity."""

    @F.pandas_udf("string")
    def draw(kind, value, attempt):
        return kind.combine(value, lambda k, v: (k, v)).combine(attempt, lambda kv, a: surrogate(key, *kv, int(a)))

    known = materialise(entities.select("kind", "value").distinct(), "entities")
    held = known.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw("kind", "value", "attempt"))
    real = known.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    group = F.element_at(F.split("kind", " "), 1)  # name parts of different gender must differ too
    while True:
        held = materialise(held, "ledger")
        first = held.groupBy(group.alias("sort"), "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", F.xxhash64("kind", "value"), "kind", "value")).alias("first"))
        shared = first.filter("n > 1").select("sort", "surrogate", "first.kind", "first.value", F.lit(True).alias("shared"))
        shared = shared.withColumnsRenamed({"kind": "first_kind", "value": "first_value"})
        taken = real.select(group.alias("sort"), "surrogate", "real").distinct()
        judged = (
            held.withColumn("sort", group).join(shared, ["sort", "surrogate"], "left").join(taken, ["sort", "surrogate"], "left")
            .withColumn("again", F.col("real").isNotNull() | (F.col("shared").isNotNull() & ~((F.col("kind") == F.col("first_kind")) & (F.col("value") == F.col("first_value")))))
            .select("kind", "value", "attempt", "surrogate", "again")
        )
        judged = materialise(judged, "ledger")
        if judged.filter("again").isEmpty():
            return judged.select("kind", "value", "surrogate")
        later = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        moved = judged.filter("again").select("kind", "value", later.alias("attempt")).withColumn("surrogate", draw("kind", "value", "attempt"))
        held = judged.filter("not again").select("kind", "value", "attempt", "surrogate").unionByName(moved)


MENTION = "key binary, start int, end int, kind string, value string"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (key, *mention)
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            for mention in find(value.as_py())
        ]
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "start", "end", "kind", "value"])


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counted: str | None = None) -> DataFrame:
    """``docs`` with entities of the text column replaced; other columns and null texts stay as they are.

    ``key`` is the secret that the replacements depend on. With ``counted``, a column of that name gives the number of replaced mentions. Repeated rows
    get equal texts; an empty table stays empty.
    """
    short_batches(docs.sparkSession)
    key_name, pairs, n_name = fresh(docs, "text_key", "pairs", "n_replaced")
    may = F.coalesce(col(text).rlike(MAY_HOLD), F.lit(False))
    looked, rest = docs.filter(may), docs.filter(~may)
    found = looked.select(_key(col(text)).alias("key"), col(text)).mapInArrow(_found, MENTION).distinct()
    found = materialise(found, "mentions")
    book = ledger(found, key)
    # The places found in the first pass come back with their surrogates; no text is searched twice.
    of_text = found.join(book, ["kind", "value"]).groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind", "surrogate")).alias(pairs))
    of_text = of_text.withColumnRenamed("key", key_name)

    @F.pandas_udf("struct<text string, n long>")
    def apply(texts, lists):
        import pandas as pd

        out = [
            (t, 0) if ps is None else (replaced(t, [(p["start"], p["end"], p["kind"], p["surrogate"]) for p in ps]), len(ps))
            for t, ps in zip(texts, lists, strict=True)
        ]
        return pd.DataFrame(out, columns=["text", "n"])

    joined = looked.withColumn(key_name, _key(col(text))).join(of_text, key_name, "left")
    joined = joined.withColumn(n_name, apply(col(text), col(pairs)))
    new = joined.withColumn(text, col(n_name)["text"]).withColumn(n_name, col(n_name)["n"])
    every = new.select(*cols(docs.columns), col(n_name)).unionByName(rest.withColumn(n_name, F.lit(0).cast("long")))
    return every.withColumnRenamed(n_name, counted) if counted else every.drop(n_name)
