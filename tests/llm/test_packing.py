"""Packing of token sequences."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
from caderneta.llm import packing
from caderneta.llm.packing import tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("word_bpe_49k.json")


def verify(pieces, texts, window):
    """Brute force: tokenise every whole text and follow its pieces."""
    tok = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert (p["start"], p["doc_tokens"], len(part)) == (at, len(ids), p["length"])
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return len(by_sequence), sum(p["length"] for p in pieces)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sequences, tokens = verify(E.queries()["op8_packing"](spark, SF).collect(), texts, 2048)
    assert sequences * 2048 <= 1.05 * tokens + 2048


@pytest.mark.parametrize("parts", [1, 5])
def test_odd_texts(spark, parts):
    texts = {
        1: None, 2: "", 3: "  \t\n ", 4: "Don't STOP now<|endoftext|>x \x1c\x85y", 5: "é ́a ΣΣ ﬁ \U0001d4b3 z",
        6: "long " * 5000, 7: "a" * 3000, 8: "same same", 9: "same same", 10: "#" * 50, 11: "İİ 1234567 's", 12: "it's we'll\r\nx",
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, open string").repartition(parts)
    out = packing.packed(df, PATH, window=64, open_windows=3, least_room=8).collect()
    sequences, tokens = verify(out, texts, 64)
    assert sequences * 64 <= 1.1 * tokens + 64


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c"), (3, "c")], "doc_id long, text string")
    out = packing.packed(df, PATH).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in out) == [("3", 2), ("3", 2), ("None", 3), ("None", 3)]
    assert packing.packed(df.limit(0), PATH).count() == 0


def test_windows_stay_bounded():
    windows = packing.Windows(100, 4, 50)
    for i in range(500):
        windows.add(i, 30 + i % 40, None)
        assert len(windows._rooms) <= 4
