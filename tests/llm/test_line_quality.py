"""Quality rules with cross-document line frequency."""

import random
import re

import pytest

from caderneta.llm import line_quality


def slow_repeat(words, k=5):
    seen, hit = {}, set()
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit |= {i + j for i in places for j in range(k)}
    return len(hit)


@pytest.mark.parametrize("n,kinds", [(0, 1), (4, 1), (5, 1), (6, 1), (50, 2), (400, 3), (5000, 9), (40000, 20000)])
def test_repeated_words(n, kinds):
    r = random.Random(n)
    words = [str(r.randrange(kinds)).encode() for _ in range(n)]
    words += words[: n // 7]
    assert line_quality.repeat_words(words) == slow_repeat(words)


@pytest.mark.parametrize("text", ["", "\n\n", "a b\na b\n a b\n", "x\x1cy\x85z   # $$\r\nü <b>|&%*", "Ab 12\nab 34"])
def test_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert line_quality.measures(text) == (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), slow_repeat(words)
    )


LETTERS = str.maketrans("0123456789", "abcdefghij")


def corpus(spark):
    def body(i, n=30):
        return " ".join(f"w{i}x{k}".translate(LETTERS) for k in range(n))  # digits don't tell lines apart

    rows = [(i, f"Read MORE at {10 + i}\n{body(i)}", "a") for i in range(40)]  # one boilerplate line in 40 texts
    rows += [(100 + i, f"read  more at 77\n{body(7, 3)} tail " + body(100 + i, 8), "a") for i in range(3)]
    rows += [(200, body(1, 3), "a"), (201, None, "a"), (202, body(202), None), (202, body(202), None), (None, body(203), "b")]
    rows += [(300 + i, "copied page line one is here to stay for good\n" + body(300), "b") for i in range(60)]
    rows += [(400 + i, body(400, 20) + "\n" + "only this is new " + body(i, 1), "c") for i in range(30)]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, kept int, h string")


def test_assess_and_clean(spark):
    df = corpus(spark)
    got = line_quality.assess(df).collect()
    assert len(got) == df.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_removed_words"] == 0  # keeps the line that it has first
    assert all(by[i]["kept"] and by[i]["n_removed_words"] == 4 for i in range(1, 40))
    assert by[200]["base_failed"] and by[201]["base_failed"] and not by[201]["kept"]
    assert by[202]["kept"] and by[None]["kept"]
    assert all(by[300 + i]["kept"] for i in range(60))  # exact copies aren't boilerplate
    assert by[400]["kept"] and not any(by[400 + i]["kept"] or by[400 + i]["base_failed"] for i in range(1, 30))
    kept = line_quality.clean(df)
    assert kept.columns == df.columns and dict(kept.dtypes) == dict(df.dtypes)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) == {r["doc_id"] for r in got if r["kept"]}
    assert texts[0].startswith("Read MORE") and texts[1].startswith("wbxa")
    assert kept.filter("doc_id = 202").count() == 2


def test_empty(spark):
    df = corpus(spark).limit(0)
    assert line_quality.assess(df).count() == 0 and line_quality.clean(df).count() == 0
