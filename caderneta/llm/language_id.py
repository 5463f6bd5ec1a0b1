"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, what isn't a letter becomes one space, and its n-grams are hashed into a fixed number of features, weighted by logarithmic count
and inverse document frequency and brought to length one. Document frequencies cover all rows that may be learned from. The weights are fitted by
FTRL-proximal with elastic-net penalties, which keeps them sparse, on a sample of stated size for each language; a temperature fitted on a
held-back part of that sample calibrates the probabilities.

Work on the data is one pass for document frequencies and one for predictions, without a shuffle of texts. The driver sees
one number for each feature, and the features of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caderneta.llm.common import col, short_batches

UNKNOWN = "und"
_SPACE = 32
# Letters lie below this code point.
_LETTERS_END = 0x33480
SAMPLE_PART = 5  # one row of so many calibrates


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    features: int = 1 << 16
    # Expected number of sampled rows for each language; a language with fewer rows gives all.
    rows_per_language: int = 1000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float
    settings: Settings = field(default_factory=Settings)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from; null for rows without doc_id, which are not learned from either."""
    return F.crc32(col(doc_id).cast("string").cast("binary")) % 4 == 2


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_LETTERS_END)), bool, _LETTERS_END)


def _letters(text: str) -> np.ndarray:
    """Code points with one space for each run of other characters and at both ends; empty without letters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4")
    letter = _is_letter()[np.minimum(codes, _LETTERS_END - 1)] & (codes < _LETTERS_END)
    if not letter.any():
        return codes[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    return np.where(letter, codes, _SPACE).astype(np.uint32)[keep]


def counts(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs."""
    codes = _letters(text)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = settings.features.bit_length() - 1
    found = []
    for order in settings.orders:
        if len(codes) < order:
            continue
        mixed = np.full(len(codes) - order + 1, order, np.uint32)
        for i in range(order):
            mixed = (mixed ^ codes[i : len(codes) - order + 1 + i]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        found.append((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
    total = np.bincount(np.concatenate(found), minlength=settings.features)
    features = np.flatnonzero(total)
    return features, total[features]


def _vector(features: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[features]
    return x / np.sqrt(x @ x) if len(x) else x


def _document_frequencies(docs: DataFrame, text: str, settings: Settings) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(settings.features, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                features, _ = counts(value.as_py() or "", settings)
                df[features] += 1
                n += len(features) > 0
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(df[used], n), pa.int64())], ["feature", "n"]
        )

    rows = docs.select(col(text)).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(settings.features, np.int64), 0
    for r in rows:
        if r["feature"] < 0:
            total = r["n"]
        else:
            df[r["feature"]] = r["n"]
    return df, total


def _sampled(docs: DataFrame, sizes: dict[str, int], lang: str, text: str, settings: Settings) -> list:
    """(lang, features, counts) of sampled rows in hash order; each language keeps its rows below a share of the hash range."""
    place = F.shiftrightunsigned(F.xxhash64(col(text), col(lang)), 1)
    shares = [
        F.when(col(lang) == name, F.lit(min(1.0, settings.rows_per_language / n))) for name, n in sizes.items()
    ]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(v.as_py() or "", settings) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in (0, 1))],
                ["place", "lang", "features", "n"],
            )

    rows = (
        docs.filter(place < F.coalesce(*shares) * float(1 << 63))
        .select(place.alias("place"), col(lang).alias("lang"), col(text))
        .mapInArrow(extract, "place long, lang string, features array<int>, n array<int>")
        .toArrow()
    )
    order = np.argsort(rows["place"].to_numpy(), kind="stable")
    langs = rows["lang"].to_pylist()
    features, n = (rows[c].combine_chunks() for c in ("features", "n"))
    return [
        (langs[i], features[i].values.to_numpy().astype(np.int64), n[i].values.to_numpy()) for i in order.tolist() if len(features[i])
    ]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: list, languages: list[str], idf: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows in order; (weights, bias). The bias has no penalty."""
    k = len(languages)
    z, squares = np.zeros((s.features + 1, k)), np.zeros((s.features + 1, k))
    l1 = np.full(s.features + 1, s.l1)
    l1[-1] = 0.0

    def weights(at) -> np.ndarray:
        over = np.abs(z[at]) - l1[at, None]
        return -np.sign(z[at]) * np.maximum(over, 0) / ((s.beta + np.sqrt(squares[at])) / s.alpha + s.l2)

    prepared = [(languages.index(lang), np.append(f, s.features), np.append(_vector(f, n, idf), 1.0)) for lang, f, n in rows]
    for _ in range(s.epochs):
        for label, at, x in prepared:
            w = weights(at)
            error = _softmax(x @ w)
            error[label] -= 1
            gradient = x[:, None] * error
            grown = squares[at] + gradient**2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(squares[at])) / s.alpha * w
            squares[at] = grown
    every = weights(np.arange(s.features + 1))
    return every[:-1], every[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the logits with the least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", settings: Settings = Settings()) -> Model:  # noqa: B008
    """Learn from rows with a language. Without such rows the model knows no language and every text is ``und``."""
    short_batches(docs.sparkSession)
    labelled = docs.select(col(lang).alias("lang"), col(text).alias("text")).filter("lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(settings.features), np.zeros((settings.features, 0)), np.zeros(0), 1.0, settings)
    df, total = _document_frequencies(labelled, "text", settings)
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = _sampled(labelled, sizes, "lang", "text", settings)
    held = rows[::SAMPLE_PART] if len(rows) > 2 * SAMPLE_PART else []
    learned = [r for i, r in enumerate(rows) if not held or i % SAMPLE_PART]
    weights, bias = _ftrl(learned, languages, idf, settings)
    logits = np.array([_vector(f, n, idf) @ weights[f] + bias for _, f, n in held]).reshape(-1, len(languages))
    temperature = _temperature(logits, np.array([languages.index(r[0]) for r in held], np.int64))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias, temperature, settings)


def predict_text(model: Model, text: str | None) -> tuple[str, float]:
    """Language and its calibrated probability; ``und`` and zero without letters."""
    features, n = counts(text or "", model.settings)
    if not len(features) or not model.languages:
        return UNKNOWN, 0.0
    p = _softmax((_vector(features, n, model.idf) @ model.weights[features] + model.bias) / model.temperature)
    best = int(np.argmax(p))
    return model.languages[best], float(p[best])


def prediction(model: Model, text: str = "text") -> Column:
    """Column ``struct<lang, score>`` of a text column."""
    @F.pandas_udf("struct<lang string, score double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict_text(model, t) for t in texts], columns=["lang", "score"])

    return of(col(text))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``. Ties go to the first language by name; repeated rows stay."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict_text(model, v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(col(doc_id).cast("long"), col(text)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least_score: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text has a language with at least this probability; all columns stay as they are."""
    short_batches(docs.sparkSession)
    found = prediction(model, text)
    return docs.filter((found["lang"] != UNKNOWN) & (found["score"] >= least_score))
