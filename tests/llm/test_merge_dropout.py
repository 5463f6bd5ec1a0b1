"""Merge-dropout encoding and decoding."""

import hashlib
import re

import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as E
from caderneta.llm import merge_dropout as M
from caderneta.llm.packing import tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("piece_bpe_32k.model")
ODD = [
    "", " ", "a", "▁ a▁b ▁", " \U0001d4b3 é\t\n", "a" * 39 + " " + "the" * 30, "  x  ", "日本ǆ" * 5, "<s> </s> <0x41> <unk>", "x\x00y", "é ﬁ",
    "long" * 3000 + " " * 200,
]


def test_rate_zero_is_plain_encoding(spark):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t for t in ODD if "▁" not in t]
    plain = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text, ids in zip(texts, M.Codec(PATH, 0.0).encode_batch(texts), strict=True):
        assert ids.tolist() == plain.encode(text)


@pytest.mark.parametrize("rate,draws", [(0.0, 1), (0.1, 8), (0.5, 3), (1.0, 2)])
def test_decodes_losslessly(spark, rate, draws):
    texts = ODD + [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    codec = M.Codec(PATH, rate, 5, draws)
    for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
        assert codec.decode(ids.tolist()) == text and M.Codec.decode(codec, ids.tolist()) == text


@pytest.mark.parametrize("rate", [0.0, 0.2, 0.6])
def test_rounds_match_the_agenda(rate, monkeypatch):
    words = re.findall(r" *[^ ]+| +", " " + " ".join(ODD[:-1]) + " some ordinary words, repeatedly tokenised; Übergrößenträger")
    codec = M.Codec(PATH, rate, 9, 4)
    together = codec._learn([(d, w) for w in words for d in range(4)])
    monkeypatch.setattr(M, "LONGEST_TOGETHER", 0)
    assert together == codec._learn([(d, w) for w in words for d in range(4)])


def test_seed_decides(spark):
    text = "a sentence with several longer words, encoded again and again. " * 20
    a, b, c = (M.Codec(PATH, 0.3, s).encode(text).tolist() for s in (1, 1, 2))
    assert a == b != c and len(a) > len(M.Codec(PATH, 0.0).encode(text))
    small = M.Codec(PATH, 0.3, 1)
    small._known = {(9, str(i)): b"" for i in range(M.CACHED_SEGMENTS)}  # a full cache is emptied
    assert small.encode(text).tolist() == a


def test_query_round_trip(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    encoded = E.queries()["op3_merge_dropout"](spark, SF)
    back = {r["doc_id"]: r["text"] for r in M.decode(encoded, PATH).collect()}
    assert back == texts


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "a b", 2), (2, "a b", 2)], "doc_id long, text string, ids int")
    rows = M.encode(df, PATH, rate=0.0).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in rows) == [("1", 0), ("2", 2), ("2", 2), ("None", 0)]
    assert M.encode(df.limit(0), PATH).count() == 0 and M.decode(M.encode(df, PATH), PATH).count() == 4


def test_query_decodes_the_whole_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op3_merge_dropout"](spark, SF).collect()
    assert {r["doc_id"]: (r["decoded_chars"], r["decoded_sha256"]) for r in rows} == {
        k: (len(x), hashlib.sha256(x.encode()).hexdigest()) for k, x in texts.items()
    }


def test_decoded_columns_come_from_the_ids(spark):
    df = spark.createDataFrame([(1, x) for x in ODD] + [(1, None)], "doc_id long, text string")
    rows = M.round_trip(df, PATH, rate=0.5, seed=3).collect()
    codec = M.Codec(PATH, 0.0)
    assert len(rows) == len(ODD) + 1
    for r in rows:
        back = codec.decode(r["ids"])
        assert (r["decoded_chars"], r["decoded_sha256"]) == (len(back), hashlib.sha256(back.encode()).hexdigest())


def test_texts_of_a_batch_are_decoded_together():
    codec = M.Codec(PATH, 0.1, 3)
    texts = ["", "olá  mundo", " ", "▁ x ▁▁", "日本 \U0001f600 é", "a\nb\tc", "y" * 90]
    found = codec.encode_batch(texts)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])])
    backs = codec.decoded_batch(np.concatenate(found), bounds)
    assert [b.decode() for b in backs] == texts == [codec.decode(x.tolist()) for x in found]
    assert [b.decode() for b in codec.decoded_batch(np.empty(0, np.int32), np.array([0, 0]))] == [""]


def test_pairs_that_share_an_address_are_all_found():
    codec = M.Codec(PATH)
    held = codec._pairs[codec._pairs >= 0]
    key, rank = held >> M._RANK_BITS, held & (1 << M._RANK_BITS) - 1
    assert (M._address(key) != np.flatnonzero(codec._pairs >= 0)).any()  # some had to move on
    assert (codec._ranks(key // M._PAIR, key % M._PAIR) == rank).all()
    pieces = {i: p for p, i in codec._id.items()}
    for left, right, r in zip((key // M._PAIR)[:2000].tolist(), (key % M._PAIR)[:2000].tolist(), rank.tolist()):
        names = [pieces[x] if x in pieces else chr(x - codec._first_char) for x in (left, right)]
        assert codec._rank["".join(names)] == r
    assert (codec._ranks(key % M._PAIR, np.full(len(key), M._PAIR - 1)) == M._NEVER).all()


@pytest.mark.parametrize("limits", [(M.CACHED_SEGMENTS, M.CACHED_IDS), (30, M.CACHED_IDS), (M.CACHED_SEGMENTS, 50)])
def test_a_batch_gives_one_array_whatever_is_forgotten(limits, monkeypatch):
    texts = [*ODD, "some words and some other words, some again", *ODD, "other words"]
    alone = [M.Codec(PATH, 0.3, 7).encode(t).tolist() for t in texts]
    monkeypatch.setattr(M, "CACHED_SEGMENTS", limits[0])
    monkeypatch.setattr(M, "CACHED_IDS", limits[1])
    codec = M.Codec(PATH, 0.3, 7)
    for size in (1, 3, len(texts)):
        got = []
        for i in range(0, len(texts), size):
            ids, bounds = codec.encode_all(texts[i : i + size])
            assert ids.dtype == np.int32 and bounds[0] == 0 and bounds[-1] == len(ids)
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == alone
    assert [x.tolist() for x in codec.encode_all([])] == [[], [0]] and codec.encode_batch([]) == []
