"""Surrogates for personal data."""

import re

import pytest

import __spark_entry__ as E
from caderneta.llm import surrogates as S

SF = "/root/testdata/sf0.001"
TEXT = (
    "Mrs. Anna Müller met Herr Schmidt. Anna called +1 (974) 555-3436, mail und.34@mail7.example.com; Müller's card "
    'is 4845168114407329 5, ip 97.51.17.173, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", IBAN DE89 3704 0044 0532 0130 00 '
    "ssn 123-45-6789. Иван Петров и Петров. Card 4539-5787-6362-1486."
)
CLEAN = "Version 1.2.3.4.5 of v4.0 in 2024: 1234567890123456 and 300.1.1.1 cost = 12.50. The Old Man said: 10:30 or 5-6. A. Ntea password: please"


def test_finds_each_kind():
    found = [(TEXT[a:b], k) for a, b, k, _ in S.find(TEXT)]
    assert found == [
        ("Anna", "given f latin"), ("Müller", "family latin"), ("Schmidt", "family latin"), ("Anna", "given f latin"),
        ("+1 (974) 555-3436", "phone"), ("und.34@mail7.example.com", "email"), ("Müller", "family latin"), ("4845168114407329", "card"),
        ("97.51.17.173", "ip"), ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "secret"), ("DE89 3704 0044 0532 0130 00", "iban"),
        ("123-45-6789", "ssn"), ("Иван", "given m cyrillic"), ("Петров", "family cyrillic"), ("Петров", "family cyrillic"), ("4539-5787-6362-1486", "card"),
    ]
    assert S.find(CLEAN) == [] and S.find("") == [] and S.find("A" * 300_000 + " a" * 1000) == []


@pytest.mark.parametrize("attempt", range(3))
def test_surrogates_keep_type_and_format(attempt):
    for a, b, kind, value in S.find(TEXT):
        mention = TEXT[a:b]
        new = S.rendered(mention, kind, S.surrogate("k", kind, value, attempt))
        assert new != mention
        if not kind.startswith(("given", "family")):
            shape = [re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", x)) for x in (mention, new)]
            assert kind in ("secret",) and len(mention) == len(new) or shape[0] == shape[1], (mention, new)
        if kind in ("email", "card", "ip", "phone", "iban", "ssn"):
            assert [k for _, _, k, _ in S.find(f"x {new} y")] == [kind]
        else:
            assert kind == "secret" or S.script_of(new) == kind.split()[-1] and new[0].isupper()


def test_corpus(spark):
    rows = [
        (1, TEXT), (2, CLEAN), (3, None), (4, ""), (5, "Mail UND.34@mail7.example.com and Mr. Anna Schmidt, Frau Schmidt"), (5, "same a@b.example.org"),
        (5, "same a@b.example.org"), (None, "a@b.example.org"), *[(100 + i, f"10.0.0.{i} 1.1.1.{i % 9 + 1}") for i in range(200)],
    ]
    df = spark.createDataFrame([(*r, "z", [1]) for r in rows], "doc_id long, text string, n_replaced string, pairs array<int>")
    out = S.pseudonymise(df, "k1", counted="hits").collect()
    assert len(out) == len(rows) and all(r["n_replaced"] == "z" and r["pairs"] == [1] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["text"] == CLEAN and by[2][0]["hits"] == 0 and by[3][0]["text"] is None and by[4][0]["text"] == ""
    new = by[1][0]["text"]
    assert by[1][0]["hits"] == 16
    assert not any(v in new for v in ("Anna", "Müller", "Schmidt", "555-3436", "und.34", "97.51", "Петров", "04dbe"))
    mail = re.search(r"\S+@\S+?\.com", new)[0]
    assert any(mail.lower() in r["text"].lower() for r in by[5])  # the same address everywhere
    same = [r["text"] for r in by[5] if r["text"].startswith("same")]
    assert same[0] == same[1] == "same " + by[None][0]["text"]
    # Small domains collide; distinct entities still get distinct surrogates, none of them a real one.
    before = {a for i in range(200) for a in (f"10.0.0.{i}", f"1.1.1.{i % 9 + 1}")}
    after = {a for i in range(200) for a in by[100 + i][0]["text"].split()}
    assert len(after) == len(before) and not after & before
    assert {r["text"] for r in S.pseudonymise(df, "k2").collect()} != {r["text"] for r in out}
    assert S.pseudonymise(df.limit(0), "k").count() == 0 and S.pseudonymise(df, "k").columns == df.columns


def test_crowded_shapes_end_without_error(spark):
    """5 000 of the 6 561 addresses of four digits other than zero, and 600 of 676 addresses of one letter each."""
    digits = [f"{i // 729 % 9 + 1}.{i // 81 % 9 + 1}.{i // 9 % 9 + 1}.{i % 9 + 1}" for i in range(5000)]
    mails = [f"{chr(97 + i // 26)}@{chr(97 + i % 26)}.com" for i in range(600)]
    rows = [(v, "ip") for v in digits] + [(v, "email") for v in mails]
    book = S.ledger(spark.createDataFrame(rows, "value string, kind string"), "k").collect()
    assert len(book) == 5600 and len({(r["kind"], r["surrogate"]) for r in book}) == 5600
    real = set(rows)
    assert not any((r["surrogate"], r["kind"]) in real for r in book)
    for r in book[::97]:
        assert [k for _, _, k, _ in S.find(f"x {r['surrogate']} y")] == [r["kind"]]


def test_query_matches_brute_force(spark):
    """Each text is rewritten with some ledger that is one to one and agrees between texts."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op2_surrogates"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    book = {}
    for r in rows:
        found, at, rest = S.find(docs[r["doc_id"]]), 0, r["text"]
        assert r["n_replaced"] == len(found)
        for a, b, kind, value in found:
            kept = docs[r["doc_id"]][at:a]
            assert rest.startswith(kept)
            new = rest[len(kept) :][: b - a]
            assert book.setdefault((kind, value), new.lower()) == new.lower()
            rest, at = rest[len(kept) + b - a :], b
        assert rest == docs[r["doc_id"]][at:]
    assert len(set(book.values())) == len(book)


def test_cheap_test_rules_out_nothing(spark):
    texts = [TEXT, CLEAN, *TEXT.split(". "), "Dr. Who", "Frau Schmidt", "Jean Dupont", "x@y.example.org"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    passed = {r["text"] for r in df.filter(df["text"].rlike(S.MAY_HOLD)).collect()}
    assert all(t in passed for t in texts if S.find(t))


NAMES = {
    "Maria García López": "Maria García López", "Mr John Ronald Reuel Tolkien": "John Ronald Reuel Tolkien", "John F. Kennedy": "John Kennedy",
    "Dr. J. Smith": "Smith", "Dr J. R. R. Tolkien": "Tolkien", "Maria de la Cruz": "Maria Cruz", "Herr von Braun": "Braun",
}
PHONES = ["020 7946 0958", "(030) 1234567", "0049 30 1234567", "555 123 4567", "01 23 45 67 89"]


@pytest.mark.parametrize("name", NAMES)
def test_names_of_any_length(name):
    text = f"there {name} went"
    assert " ".join(text[a:b] for a, b, _, _ in S.find(text)) == NAMES[name]


@pytest.mark.parametrize("phone", PHONES)
def test_national_and_international_phones(phone):
    text = f"call {phone} now"
    ((a, b, kind, value),) = S.find(text)
    assert text[a:b] == phone and kind == "phone"
    for attempt in range(50):
        new = S.rendered(phone, kind, S.surrogate("k", kind, value, attempt))
        assert [k for _, _, k, _ in S.find(f"x {new} y")] == ["phone"] and new != phone
    assert S.find("on 01-12-2024 and 2024-01-02, 0.125 or 12 000 000") == []


def test_cheap_test_passes_new_layouts(spark):
    texts = [f"there {x} went" for x in [*NAMES, *PHONES]]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.filter(df["text"].rlike(S.MAY_HOLD)).count() == len(texts)
