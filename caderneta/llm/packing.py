"""Packing of tokenised documents into sequences: bounded-space online best fit.

Each partition streams its documents through a fixed number of open windows. A document longer than a window fills whole
sequences first. The rest goes to the open window where it leaves the least room. When it fits nowhere and all windows are open,
the fullest one is emitted and a new one is opened. Emitting a window that has much room left would waste it, so such a
window is first filled up with the beginning of the document. At the end the windows still open in neighbouring partitions are merged
the same way, pieces in falling order of length.

Memory of a task is bounded by the windows, whose pieces are only numbers, by one batch of documents, and by the word cache.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caderneta.llm.common import col, short_batches
from caderneta.session import materialise

WINDOW = 2048
OPEN_WINDOWS = 64
# Room at which a window is filled up before it is emitted.
LEAST_ROOM = 64
# Partitions whose leftovers are merged in one task.
MERGED_PARTITIONS = 64
END_ID = 1
# Words whose ids a worker remembers, in each of two generations.
CACHED_WORDS = 200_000

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, grp long"
)


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Token ids of texts, word by word, as little-endian unsigned 32-bit numbers.

    For the tokenizer that drops white space and tells runs of letters from runs of symbols, so that the ids of a text are those of its
    words in a row. Words of plain letters and symbols after them go to the merges of the tokenizer directly; all others, and
    words with characters that normalisation may change, take its whole way. Two generations of remembered words bound the memory.
    """

    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=?-@\[-`{-~]*)", re.ASCII)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        self._symbols = _byte_symbols()
        self._known: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _run(self, run: str) -> bytes:
        symbols = run if run.isascii() else "".join([self._symbols[b] for b in run.encode()])
        ids = [t.id for t in self._merge(symbols)]
        return pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[bytes]) -> None:
        known, old, odd, plain = self._known, self._old, [], self._PLAIN.fullmatch
        for w in words:
            ids = old.get(w)
            if ids is None:
                found = plain(w.decode())
                if found is None:
                    odd.append(w)
                    continue
                letters, symbols = found.groups()
                letters = letters.lower()
                key = letters.encode()
                ids = known.get(key) or old.get(key)
                if ids is None:
                    ids = known[key] = self._run(letters)
                if symbols:
                    key = symbols.encode()
                    more = known.get(key)
                    if more is None:
                        more = known[key] = self._run(symbols)
                    ids += more
            known[w] = ids
        for i in range(0, len(odd), 1024):
            part = odd[i : i + 1024]
            for w, e in zip(part, self._tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = pack(f"<{len(e.ids)}I", *e.ids)

    def encode(self, text: str) -> bytes:
        words = text.encode().split()  # at ASCII white space only
        if len(self._known) > CACHED_WORDS:
            self._known, self._old = {}, self._known
        known = self._known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self._learn([w for w in dict.fromkeys(words) if w not in known])
            return b"".join([known[w] for w in words])


class Windows:
    """Open windows in the order of their room, and the sequences emitted so far."""

    def __init__(self, window: int, most: int, least_room: int):
        self.window, self.most, self.least_room = window, most, least_room
        self._rooms: list[tuple[int, int]] = []  # (room, number), sorted
        self._pieces: dict[int, list] = {}
        self._next = 0
        self.emitted: list[list] = []

    def _open(self, pieces: list, length: int) -> None:
        if length == self.window:
            self.emitted.append(pieces)
            return
        self._pieces[self._next] = pieces
        insort(self._rooms, (self.window - length, self._next))
        self._next += 1

    def _fill(self, at: int, piece, length: int) -> None:
        room, number = self._rooms.pop(at)
        pieces = self._pieces.pop(number)
        pieces.append((piece, self.window - room))
        self._open(pieces, self.window - room + length)

    def add(self, piece, length: int, cut) -> None:
        """Place a piece of at most a window. ``cut(piece, n)`` gives its first n tokens and the rest; None if it can't be cut."""
        at = bisect_left(self._rooms, (length, -1))
        if at == len(self._rooms) and len(self._rooms) >= self.most:
            room, number = self._rooms[0]
            if cut is not None and room >= self.least_room:
                head, piece = cut(piece, room)
                self._fill(0, head, room)
                self.add(piece, length - room, cut)
                return
            self._rooms.pop(0)
            self.emitted.append(self._pieces.pop(number))
            at = len(self._rooms)
        if at < len(self._rooms):
            self._fill(at, piece, length)
        else:
            self._open([(piece, 0)], length)

    def take(self) -> list[list]:
        done, self.emitted = self.emitted, []
        return done

    def rest(self) -> list[list]:
        return [self._pieces.pop(number) for _, number in self._rooms]


def _cut(piece: tuple, n: int) -> tuple:
    doc_id, start, ids, total = piece
    return (doc_id, start, ids[: 4 * n], total), (doc_id, start + n, ids[4 * n :], total)


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"open": pa.bool_()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()})


def packed(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, least_room: int = LEAST_ROOM,
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a tokenizer file on every machine, whose tokenizer drops white space. A document is its ids and ``end_id``; a null or
    empty text is ``end_id`` alone. Every id lies in exactly one piece; pieces of a sequence are gapless from offset 0 and sum to
    ``window`` at most. Repeated rows are packed as often as they occur, also with a null id. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    short_batches(spark)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, windows, made = WordIds(tokenizer), Windows(window, open_windows, least_room), 0
        end = np.array([end_id], "<u4").tobytes()

        def rows(sequences: list[list], is_open: bool) -> pa.RecordBatch:
            nonlocal made
            out: dict[str, list] = {k.split()[0]: [] for k in PIECE_SCHEMA.split(", ")}
            for pieces in sequences:
                for (doc, start, ids, total), offset in pieces:
                    for name, value in zip(
                        out, (doc, start, len(ids) // 4, zlib.crc32(ids), total, part << 33 | made, offset, is_open, part // MERGED_PARTITIONS), strict=True
                    ):
                        out[name].append(value)
                made += 1
            return _batch(out)

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.encode(value.as_py() or "") + end
                total = len(ids) // 4
                whole = total - total % window
                for start in range(0, whole, window):
                    windows.emitted.append([((key, start, ids[4 * start : 4 * (start + window)], total), 0)])
                if whole < total:
                    windows.add((key, whole, ids[4 * whole :], total), total - whole, _cut)
            yield rows(windows.take(), False)
        yield rows(windows.rest(), True)

    pieces = materialise(docs.select(col(doc_id).cast("long"), col(text)).mapInArrow(stream, PIECE_SCHEMA), "packing")

    def merge(batch: pa.Table) -> pa.Table:
        """Leftover pieces of neighbouring partitions into as few sequences as first fit by falling length finds."""
        rows = sorted(batch.to_pylist(), key=lambda r: (-r["length"], r["sequence_id"], r["offset"]))
        windows = Windows(window, len(rows), window)
        for r in rows:
            windows.add(r, r["length"], None)
        # Above every number that the first partition of the group has given.
        base = (rows[0]["grp"] * MERGED_PARTITIONS << 33) + (1 << 32)
        out = [
            r | {"sequence_id": base + number, "offset": offset}
            for number, members in enumerate(windows.take() + windows.rest())
            for r, offset in members
        ]
        return pa.Table.from_pylist(out, schema=batch.schema)

    merged = pieces.filter("open").groupBy("grp").applyInArrow(merge, PIECE_SCHEMA)
    return pieces.filter("not open").unionByName(merged).drop("open", "grp")
