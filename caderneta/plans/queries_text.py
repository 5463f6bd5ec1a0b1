"""Text clean-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caderneta.functions import text as T
from caderneta.plans.catalog import query
from caderneta.plans.tx import table, transactions, with_tx

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
GENERIC = r"(?i)\b(pagamento|compra|anuidade|debito|credito|pix)\b"
FULL_DATE = r"\b[0-9]{2,4}[/-][0-9]{1,2}[/-][0-9]{2,4}\b"


def rx(expr: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"


def strip_sql(expr: str) -> str:
    return rx(expr, f"^{WS}+|{WS}+$")


def tidy_sql(expr: str) -> str:
    edges = rx(expr, f"^(?:{WS}|-)+|(?:{WS}|-)+$")
    return strip_sql(f"lower({rx(rx(edges, WS + '+', ' '), '[()]+')})")


def normalize_sql(expr: str) -> str:
    out = rx(expr, rf"^[0-9]{{2,4}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}{WS}*-{WS}*")
    out = rx(rx(out, FULL_DATE), r"\([0-9/]+\)")
    out = rx(out, r"^[\p{L}\p{N}_]+\*")
    out = rx(rx(out, rf"(?i)^Hyundai{WS}+"), rf"(?i)^Hb{WS}*-{WS}*")
    return tidy_sql(rx(out, GENERIC))


@query(
    "q_normalize_text",
    f"SELECT doc_id, md5({normalize_sql('text')}) AS clean_md5 FROM documents",
)
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.normalize_description(F.col("text"))).alias("clean_md5")
    )


@query(
    "q_normalize_tx",
    with_tx(f"SELECT {normalize_sql('descr')} AS clean, count(*) AS n FROM tx GROUP BY 1"),
)
def normalize_tx(spark, sf_dir):
    clean = T.normalize_description(F.col("descr")).alias("clean")
    return transactions(spark, sf_dir).groupBy(clean).agg(F.count("*").alias("n"))


@query("q_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS plain_md5 FROM documents")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.strip_accents(F.col("text"))).alias("plain_md5")
    )


@query(
    "q_scoring_text",
    f"SELECT doc_id, md5({strip_sql('strip_accents(' + normalize_sql('text') + ')')}) AS clean_md5 FROM documents",
)
def scoring_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.scoring_text(F.col("text"))).alias("clean_md5"))


TRAINING = strip_sql(
    rx(rx(rx("descr", FULL_DATE), r"(?i)\b(pagamento|compra|anuidade|debito|credito|pix|cartao)\b"), WS + "+", " ")
)


@query("q_train_clean", with_tx(f"SELECT tx_id, {TRAINING} AS clean FROM tx"))
def train_clean(spark, sf_dir):
    return transactions(spark, sf_dir).select("tx_id", T.training_text(F.col("descr")).alias("clean"))


# RE2 has no look-ahead, so the digit after dd/mm is captured and put back.
def similarity_sql(expr: str) -> str:
    out = rx(rx(expr, r"[0-9]{2}/[0-9]{2}/[0-9]{4}"), r"[0-9]{2}/[0-9]{2}([^0-9]|$)", r"\1")
    out = rx(rx(out, r"\([0-9/]+\)"), r"^[\p{L}\p{N}_]+\*")
    return tidy_sql(rx(out, GENERIC))


SIMILARITY = similarity_sql("descr")


@query("q_similarity_clean", with_tx(f"SELECT tx_id, {SIMILARITY} AS clean FROM tx"))
def similarity_clean(spark, sf_dir):
    return transactions(spark, sf_dir).select("tx_id", T.similarity_text(F.col("descr")).alias("clean"))


RULE_TEXT = strip_sql(rx(rx(rx("lower(descr)", FULL_DATE), GENERIC), WS + "+", " "))


@query("q_rule_text", with_tx(f"SELECT tx_id, {RULE_TEXT} AS clean FROM tx"))
def rule_text(spark, sf_dir):
    return transactions(spark, sf_dir).select("tx_id", T.rule_text(F.col("descr")).alias("clean"))


CLEAN_TEXT = strip_sql(
    rx(rx(rx("'Pagamento Compra ' || descr", FULL_DATE), r"(?i)\b(pagamento|anuidade|debito|credito|pix)\b"), WS + "+", " ")
)


@query("q_clean_description", with_tx(f"SELECT tx_id, {CLEAN_TEXT} AS clean FROM tx"))
def clean_description(spark, sf_dir):
    text = F.concat(F.lit("Pagamento Compra "), F.col("descr"))
    return transactions(spark, sf_dir).select("tx_id", T.clean_description(text).alias("clean"))


LEXICAL = strip_sql(rx(rx(rx(rx("lower(descr)", FULL_DATE), GENERIC), "[-–—]"), WS + "+", " "))


@query("q_lexical_text", with_tx(f"SELECT tx_id, {LEXICAL} AS clean FROM tx"))
def lexical_text(spark, sf_dir):
    return transactions(spark, sf_dir).select("tx_id", T.lexical_text(F.col("descr")).alias("clean"))


# initcap has no counterpart in DuckDB: split at blanks and raise each first letter.
ESTABLISHMENT = strip_sql(
    rx(
        rx(
            rx(
                rx(
                    rx(
                        "upper('Pix ' || p_name || ' ' || strftime(l_shipdate, '%d/%m/%Y') || ' - ' || s_name || ' (01/02)')",
                        r"(?i)\b(PIX|TED|DOC|PAGAMENTO|CARTAO|CARTÃO|DEB|CRED|ENVIO|ENVIADO|COMPRA)\b",
                    ),
                    r"[0-9]{2}/[0-9]{2}/[0-9]{4}",
                ),
                "[-–—]",
            ),
            rf"[(\[]{WS}*[0-9]{{1,2}}{WS}*/{WS}*[0-9]{{1,2}}{WS}*[)\]]",
        ),
        WS + "+",
        " ",
    )
)


@query(
    "q_establishment",
    with_tx(
        f"""SELECT array_to_string(list_transform(string_split(lower({ESTABLISHMENT}), ' '),
                   lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS place, count(*) AS n
            FROM tx GROUP BY 1"""
    ),
)
def establishment(spark, sf_dir):
    text = F.concat(
        F.lit("Pix "), F.col("p_name"), F.lit(" "), F.date_format("l_shipdate", "dd/MM/yyyy"),
        F.lit(" - "), F.col("s_name"), F.lit(" (01/02)"),
    )
    return transactions(spark, sf_dir).groupBy(T.establishment_name(text).alias("place")).agg(F.count("*").alias("n"))


@query(
    "q_control_chars",
    f"""SELECT doc_id, md5({strip_sql(rx("text", r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x{9f}]"))}) AS clean_md5
        FROM documents""",
)
def control_chars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.without_controls(F.col("text"))).alias("clean_md5")
    )


MASKS = {"Supplier#00000000": "Loja ", "widget": "item", "item": "produto", "of the": "***"}
MASK_SQL = "text"
for _old, _new in MASKS.items():
    MASK_SQL = f"replace({MASK_SQL}, '{_old}', '{_new}')"


@query("q_mask_dictionary", f"SELECT doc_id, md5({MASK_SQL}) AS masked_md5 FROM documents")
def mask_dictionary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.mask(F.col("text"), MASKS)).alias("masked_md5"))


@query(
    "q_word_counts",
    r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS words, md5(array_to_string(t, ' ')) AS words_md5
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents)""",
)
def word_counts(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return words.select(
        "doc_id", F.size("t").cast("bigint").alias("words"), F.md5(F.array_join("t", " ")).alias("words_md5")
    )
