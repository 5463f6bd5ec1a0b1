"""Text clean-up of transaction descriptions.

Java's ``\\w``, ``\\b`` and ``\\s`` are ASCII by default while descriptions are
pt-BR, so every class below is spelled out in Unicode terms.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"

# Words that say how something was paid, not what was bought.
GENERIC_WORDS = ("pagamento", "compra", "anuidade", "debito", "credito", "pix")
TRAINING_GENERIC_WORDS = GENERIC_WORDS + ("cartao",)
KEEP_PURCHASE_WORDS = ("pagamento", "anuidade", "debito", "credito", "pix")
ESTABLISHMENT_WORDS = (
    "PIX", "TED", "DOC", "PAGAMENTO", "CARTAO", "CARTÃO", "DEB", "CRED", "ENVIO", "ENVIADO", "COMPRA",
)
# Merchant prefixes dropped from the start of a description.
MERCHANT_PREFIXES = (r"Hyundai\s+", r"Hb\s*-\s*")

# The look-ahead in front spares most positions the costlier look-behind.
FULL_DATE = rf"(?=[0-9]){NOT_AFTER_WORD}[0-9]{{2,4}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}{NOT_BEFORE_WORD}"
BRACKETED_INSTALLMENT = rf"[(\[]{WS}*([0-9]{{1,2}}){WS}*/{WS}*([0-9]{{1,2}}){WS}*[)\]]"


def sub(text: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


@lru_cache(maxsize=1)
def _blanks() -> str:
    """The characters of ``WS``."""
    codes = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85]
    codes += [c for c in range(0x80, 0x3001) if unicodedata.category(chr(c)).startswith("Z")]
    return "".join(map(chr, codes))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_blanks()))


def squeeze(text: Column) -> Column:
    """Every run of blanks becomes one space; single spaces are left alone."""
    return sub(text, rf"{WS}{{2,}}|[\t-\r\x1c-\x1f\x85\p{{Z}}&&[^ ]]", " ")


def without_words(text: Column, words: Sequence[str]) -> Column:
    initials = "".join(sorted({c for w in words for c in (w[0].lower(), w[0].upper())}))
    return sub(text, rf"(?=[{initials}]){NOT_AFTER_WORD}(?iu:{'|'.join(words)}){NOT_BEFORE_WORD}")


def without_full_dates(text: Column) -> Column:
    return sub(text, FULL_DATE)


def _tidy(text: Column) -> Column:
    edges = F.btrim(text, F.lit(_blanks() + "-"))
    return strip(F.lower(F.replace(F.replace(squeeze(edges), F.lit("("), F.lit("")), F.lit(")"), F.lit(""))))


def normalize_description(text: Column) -> Column:
    """Merchant name of a description: no dates, installments, prefixes or payment words."""
    out = sub(F.coalesce(text, F.lit("")), rf"^[0-9]{{2,4}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}{WS}*-{WS}*")
    out = sub(without_full_dates(out), r"\([0-9/]+\)")
    out = sub(out, rf"^{WORD}+\*")
    for prefix in MERCHANT_PREFIXES:
        out = sub(out, "(?iu)^" + prefix.replace(r"\s", WS))
    return _tidy(without_words(out, GENERIC_WORDS))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every BMP letter whose canonical decomposition is one base character plus marks."""
    accented, plain = [], []
    for code in range(0xC0, min(sys.maxunicode, 0xFFFF)):
        char = chr(code)
        decomposed = unicodedata.normalize("NFD", char)
        if decomposed == char or 0xD800 <= code <= 0xDFFF:
            continue
        base = "".join(c for c in decomposed if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != char:
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


def strip_accents(text: Column) -> Column:
    accented, plain = _accent_table()
    return F.when(is_ascii(text), text).otherwise(sub(F.translate(text, accented, plain), r"\p{Mn}+"))


def is_ascii(text: Column) -> Column:
    """Cheap test: as many bytes as characters."""
    return F.octet_length(text) == F.length(text)


def scoring_text(text: Column) -> Column:
    """The one cleaner used for training and for scoring."""
    return strip(strip_accents(normalize_description(text)))


def training_text(text: Column) -> Column:
    """Light cleaner: keeps case and installments."""
    return strip(squeeze(without_words(without_full_dates(F.coalesce(text, F.lit(""))), TRAINING_GENERIC_WORDS)))


def similarity_text(text: Column) -> Column:
    """Cleaner of the similarity lookup: also drops dates without a year."""
    out = sub(F.coalesce(text, F.lit("")), r"[0-9]{2}/[0-9]{2}/[0-9]{4}")
    out = sub(sub(out, r"[0-9]{2}/[0-9]{2}(?![0-9])"), r"\([0-9/]+\)")
    out = sub(out, rf"^{WORD}+\*")
    return _tidy(without_words(out, GENERIC_WORDS))


def rule_text(text: Column) -> Column:
    """Text the rules are matched against."""
    return strip(squeeze(without_words(without_full_dates(F.lower(F.coalesce(text, F.lit("")))), GENERIC_WORDS)))


def clean_description(text: Column) -> Column:
    """Readable description; "compra" stays."""
    return strip(squeeze(without_words(without_full_dates(F.coalesce(text, F.lit(""))), KEEP_PURCHASE_WORDS)))


def establishment_name(text: Column, for_prompt: bool = False) -> Column:
    """Title-cased merchant. The prompt variant also drops "LOJA" but keeps inner spacing."""
    words = ESTABLISHMENT_WORDS + (("LOJA",) if for_prompt else ())
    out = without_words(F.upper(F.coalesce(text, F.lit(""))), words)
    out = sub(sub(out, r"[0-9]{2}/[0-9]{2}/[0-9]{4}"), "[-–—]")
    if not for_prompt:
        out = squeeze(sub(out, BRACKETED_INSTALLMENT))
    return F.initcap(F.lower(strip(out)))


def lexical_text(text: Column) -> Column:
    """Cleaner of the lexical (sequence + word set) similarity."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = sub(without_words(without_full_dates(out), GENERIC_WORDS), "[-–—]")
    return strip(squeeze(out))


def without_controls(text: Column) -> Column:
    """Control characters out; tab, line feed and carriage return stay inside the line."""
    return strip(sub(text, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]"))


def ascii_line(text: Column) -> Column:
    """Accent-free, ASCII-only, single-spaced."""
    return strip(squeeze(sub(strip_accents(text), r"[^\x00-\x7f]")))


def card_feature(text: Column, card: Column) -> Column:
    """Feature text of the classifiers that may look at the card."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit(" [cartao: "), F.coalesce(card, F.lit("")), F.lit("]"))


def mask(text: Column, dictionary: Mapping[str, str]) -> Column:
    """Replace each key by its value, in dictionary order, each step seeing the last one's result."""
    for original, neutral in dictionary.items():
        text = F.replace(text, F.lit(original), F.lit(neutral))
    return text


def mask_columns(df, dictionary: Mapping[str, str], columns: Sequence[str] | None = None):
    """``mask`` over every string column."""
    chosen = set(columns or [n for n, t in df.dtypes if t == "string"])
    return df.select([mask(F.col(c), dictionary).alias(c) if c in chosen else F.col(c) for c in df.columns])


def tokens(text: Column) -> Column:
    """Lower-case words of two or more characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}{{2,}}"), F.lit(0))


def header_name(name: str, light: bool = False) -> str:
    """Canonical column name. ``light`` only trims, lower-cases and folds "ã"."""
    name = name.lstrip("\ufeff").strip().lower()
    if light:
        return name.replace("ã", "a")
    folded = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    folded = folded.replace("valor__rs__", "valor_r_")
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789_" else "_" for c in folded)


def normalize_headers(df, light: bool = False):
    return df.toDF(*[header_name(c, light) for c in df.columns])
