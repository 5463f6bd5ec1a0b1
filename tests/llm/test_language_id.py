"""Language identification."""

import numpy as np
import pytest

import __spark_entry__ as E
from caderneta.llm import language_id as L
from caderneta.llm.language_id import held_out

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", held_out().alias("h")).collect()}
    rows = E.queries()["op1_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == truth[r["doc_id"]]["h"] and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in out]) > 0.95
    # Calibrated: mean score close to accuracy.
    assert abs(np.mean([r["score"] for r in out]) - np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in out])) < 0.1


def test_only_learns_from_text_and_lang(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a = L.fit(df.filter(~held_out()))
    b = L.fit(df.filter(~held_out()).selectExpr("text", "lang", "'x' score", "rand() source").repartition(3))
    assert a.languages == b.languages and np.allclose(a.weights, b.weights) and a.temperature == b.temperature
    assert 0 < (a.weights != 0).mean() < 0.5


@pytest.mark.parametrize("text", ["", " \t12 ###", "x", "Ünï çödé", "日本語", "\U00010400\U0001f600", "İ", "a" * 300_000])
def test_counts_match_brute_force(text):
    s = L.Settings(features=1 << 12)
    features, n = L.counts(text, s)
    clean = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    clean = __import__("re").sub(" +", " ", clean)
    total = sum(max(0, len(clean) - k + 1) for k in s.orders) if clean.strip() else 0
    assert n.sum() == total and len(set(features.tolist())) == len(features)


def test_unknown_nulls_repeats_and_empty(spark):
    rows = [(i, t, lang, 1.0) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    df = spark.createDataFrame(rows + [(None, None, "en", 0.0), (50, "12 # 3", None, 0.0), (50, "the dog", None, 0.0)], "doc_id long, text string, lang string, score double")
    model = L.fit(df)
    got = L.predict(df, model).collect()
    assert len(got) == 43
    assert {(r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] in (None, 50)} == {(None, "und"), (50, "und"), (50, "en")}
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == 41
    none = L.fit(df.filter("lang is null"))
    assert {(r["lang_pred"], r["score"]) for r in L.predict(df, none).collect()} == {("und", 0.0)}
    assert L.predict(df.limit(0), model).count() == 0 and L.fit(df.limit(0)).languages == []


def test_temperature_undoes_scaling():
    r = np.random.default_rng(0)
    logits = r.normal(size=(4000, 3)) * 2
    p = L._softmax(logits)
    labels = np.array([r.choice(3, p=x) for x in p])
    assert abs(L._temperature(logits * 4, labels) - 4) < 0.6
