"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding follows the merge type of SentencePiece: the characters of a text are symbols, an agenda holds adjacent pairs that form a piece, and the best pair
is merged until none is left. With dropout, a pair that is taken from the agenda is skipped when its keyed hash falls below the rate. The hash covers the seed, the
draw, the segment, the pair's place and its piece, so a run can be repeated on any machine in any order. Rate zero is the plain encoding.

No piece joins a letter with a space after it, so a text falls into independent segments, spaces with the word after them. Each occurrence of
a segment takes one of ``draws`` draws by a hash of the seed, the text and the occurrence. A worker numbers the segments it meets and
remembers the ids of (draw, segment) in one bounded array; those of a batch are gathered from it together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from caderneta.llm.common import col, short_batches

RATE = 0.1
DRAWS = 8
# A worker forgets what it knows above either: distinct segments, and ids of their draws.
CACHED_SEGMENTS, CACHED_IDS = 200_000, 8_000_000
# Segments up to this length are merged together, so many at a time.
LONGEST_TOGETHER = 40
TOGETHER = 4096
# Rows whose agenda is empty leave the matrix when fewer than this share of rows is left.
STILL_LIVE = 0.75
SPACE = "▁"

_SEGMENT = re.compile(r" *[^ ]+| +")
_MASK = (1 << 64) - 1
_PLACE_KEY, _RANK_KEY = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_MIX, _SPREAD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PAIR = 1 << 22  # above every symbol
_NEVER = 1 << 30
# Addresses in the table of pairs, twice the pairs at least; an entry is a pair and its rank, -1 if free.
_ADDRESSES, _RANK_BITS = 1 << 20, 19
# A space mark that stands in the text itself: no piece, so it is written as bytes and isn't decoded to a space.
_LITERAL = "▁\x00"


def _address(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) * _MIX >> np.uint64(65 - _ADDRESSES.bit_length())).astype(np.int64)


def _table(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Entries by the address of their key, or the next free one behind it."""
    if 2 * len(key) > _ADDRESSES or rank.max(initial=0) >> _RANK_BITS:
        raise ValueError("the model has more pairs than the table of pairs holds")
    out = np.full(_ADDRESSES, -1, np.int64)
    at, left = _address(key), np.arange(len(key))
    while len(left):
        free = left[out[at[left]] < 0]
        took = free[np.unique(at[free], return_index=True)[1]]
        out[at[took]] = key[took] << _RANK_BITS | rank[took]
        left = np.setdiff1d(left, took, assume_unique=True)
        at[left] = at[left] + 1 & _ADDRESSES - 1
    return out


class Codec:
    """Encoder and decoder for a SentencePiece model file of the merge type with byte fallback."""

    def __init__(self, path: str, rate: float = RATE, seed: int = 0, draws: int = DRAWS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        normal = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        ]
        self._id = {model.id_to_piece(i): i for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self._id):
            raise ValueError("pieces with a space after a letter aren't supported")
        order = sorted(normal, key=lambda i: (-model.get_score(i), i))
        self._rank = {model.id_to_piece(i): r for r, i in enumerate(order)}
        self._piece_at = np.array(order, np.int64)
        self._first_char = model.get_piece_size()  # symbols from here on are characters that are no piece
        pairs = [
            (self._symbol(p[:k]) * _PAIR + self._symbol(p[k:]), self._rank[p])
            for p in self._id for k in range(1, len(p)) if all(x in self._id or len(x) == 1 for x in (p[:k], p[k:]))
        ]
        self._pairs = _table(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        self._char = np.arange(1 << 16) + self._first_char
        for piece, i in self._id.items():
            if len(piece) == 1 and ord(piece) < 1 << 16 and piece != SPACE:
                self._char[ord(piece)] = i
        self._char[ord(" ")] = self._id[SPACE]
        self._byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self._data = {i: p.replace(SPACE, " ").encode() for p, i in self._id.items()} | {i: bytes([b]) for b, i in enumerate(self._byte.tolist())}
        # The bytes of every id, to be gathered for many ids at a time; ids that write nothing have none.
        self._bytes = pa.array([self._data.get(i) for i in range(model.get_piece_size())], pa.binary())
        self._below = min(int(rate * (1 << 64)), _MASK)
        self._seed, self._draws = seed, draws if rate else 1
        self._forget()

    def _symbols(self, segment: str, draw: int) -> list[str]:
        """Pieces of one segment, by an agenda in a heap."""
        symbols: list = [_LITERAL if c == SPACE else SPACE if c == " " else c for c in segment]
        rank, below, n = self._rank, self._below, len(symbols)
        base = xxhash.xxh64_intdigest(segment, self._draw_seed(draw))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append((r, i, len(symbols[i]) + len(symbols[i + 1])))
        heapify(agenda)
        while agenda:
            r, i, size = heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or len(left) + len(symbols[j]) != size:
                continue  # one side has been merged meanwhile
            if below:
                h = (base ^ ((i * int(_PLACE_KEY) + r * int(_RANK_KEY)) & _MASK)) & _MASK
                h = ((h ^ (h >> 32)) * int(_MIX)) & _MASK
                if (h ^ (h >> 29)) * int(_SPREAD) & _MASK < below:
                    continue
            merged = symbols[i] = left + symbols[j]
            symbols[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(merged + symbols[k])
                if r is not None:
                    heappush(agenda, (r, i, size + len(symbols[k])))
            k = before[i]
            if k >= 0:
                r = rank.get(symbols[k] + merged)
                if r is not None:
                    heappush(agenda, (r, k, size + len(symbols[k])))
        return [s for s in symbols if s is not None]

    def _symbol(self, piece: str) -> int:
        return self._id[piece] if piece in self._id else self._first_char + ord(piece[0])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair forms; most pairs are settled at their first address."""
        key = left * _PAIR + right
        at = _address(key)
        met = self._pairs[at]
        same = met >> _RANK_BITS == key
        out = np.where(same, met & (1 << _RANK_BITS) - 1, _NEVER)
        more = np.flatnonzero(~same & (met >= 0))
        while len(more):
            at[more] = at[more] + 1 & _ADDRESSES - 1
            met = self._pairs[at[more]]
            same = met >> _RANK_BITS == key[more]
            out[more[same]] = met[same] & (1 << _RANK_BITS) - 1
            more = more[~same & (met >= 0)]
        return out

    def _draw_seed(self, draw: int) -> int:
        return (self._seed * 0x9E3779B97F4A7C15 + draw) & _MASK

    def _together(self, segments: list[str], draws: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of short segments of similar length, and how many each has. Each segment has its agenda in a row of a matrix, and every round takes
        one pair from each. Symbols keep their place, neighbours are linked; a symbol that went into the one on its left is -1."""
        n = np.array([len(s) for s in segments])
        m, width = len(segments), int(n.max())
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4").astype(np.int64)
        mapped = self._char[np.minimum(codes, 0xFFFF)]
        astral = codes >= 1 << 16
        if astral.any():
            own = {c: self._id.get(chr(c), self._first_char + c) for c in set(codes[astral].tolist())}
            mapped[astral] = [own[c] for c in codes[astral].tolist()]
        inside = np.arange(width) < n[:, None]
        grid = np.full((m, width), -1, np.int64)
        grid[inside] = mapped
        agenda = np.full((m, width), _NEVER, np.int32)
        pair = inside[:, 1:]
        agenda[:, :-1][pair] = self._ranks(grid[:, :-1][pair], grid[:, 1:][pair])
        symbols = grid.ravel()
        after, before = np.arange(1, m * width + 1), np.arange(-1, m * width - 1)
        row = np.arange(m)
        after[row * width + n - 1] = -1
        before[row * width] = -1
        seeds = [self._draw_seed(d) for d in range(max(draws) + 1)]
        base = np.fromiter(map(xxhash.xxh64_intdigest, segments, [seeds[d] for d in draws]), np.uint64, m)
        while True:
            best = agenda.argmin(axis=1)
            every = np.arange(len(row))
            rank = agenda[every, best]
            live = np.flatnonzero(rank < _NEVER)
            if not len(live):
                break
            if len(live) < STILL_LIVE * len(row):
                agenda, row, best, rank = agenda[live], row[live], best[live], rank[live]
                live = np.arange(len(live))
            elif len(live) < len(row):
                best, rank = best[live], rank[live]
            asked, own = agenda.ravel(), row[live]
            i, shift = own * width + best, (live - own) * width
            if self._below:
                h = base[own] ^ (best.astype(np.uint64) * _PLACE_KEY + rank.astype(np.uint64) * _RANK_KEY)
                h = (h ^ (h >> np.uint64(32))) * _MIX
                skipped = (h ^ (h >> np.uint64(29))) * _SPREAD < np.uint64(self._below)
                asked[(i + shift)[skipped]] = _NEVER
                go = ~skipped
                i, shift, rank = i[go], shift[go], rank[go]
            merged = self._piece_at[rank]
            j = after[i]
            k, left = after[j], before[i]
            symbols[i], symbols[j] = merged, -1
            asked[j + shift] = _NEVER
            after[i] = k
            right_of, left_of = k >= 0, left >= 0
            k, left = k[right_of], left[left_of]
            before[k] = i[right_of]
            asked[i + shift] = _NEVER
            changed = np.concatenate([i[right_of], left]) + np.concatenate([shift[right_of], shift[left_of]])
            asked[changed] = self._ranks(
                np.concatenate([merged[right_of], symbols[left]]), np.concatenate([symbols[k], merged[left_of]])
            )
        kept = grid >= 0
        return self._written(grid[kept], kept.sum(axis=1))

    def _written(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, ``count`` to a segment, with characters that are no piece as bytes, and how many ids each segment has."""
        bare = symbols >= self._first_char
        if not bare.any():
            return symbols.astype(np.int32), count
        data = [chr(c).encode() for c in (symbols[bare] - self._first_char).tolist()]
        size = np.ones(len(symbols), np.int64)
        size[bare] = [len(d) for d in data]
        ids = np.repeat(symbols, size).astype(np.int32)
        ids[np.repeat(bare, size)] = self._byte[np.frombuffer(b"".join(data), np.uint8)]
        ends = np.concatenate([[0], size.cumsum()])[count.cumsum()]
        return ids, np.diff(ends, prepend=0)

    def _learn(self, wanted: list[tuple[int, str]]) -> tuple[bytes, list[int], list[int]]:
        """Ids of (draw, segment), and where in them those of each wanted one begin and how many they are."""
        size = np.array([len(s) for _, s in wanted], np.int64)
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], LONGEST_TOGETHER, "right"))
        listed = [wanted[i] for i in order.tolist()]
        ids, count = [], []
        for i in range(0, short, TOGETHER):
            part = listed[i : min(i + TOGETHER, short)]
            found = self._together([s for _, s in part], [d for d, _ in part])
            ids.append(found[0])
            count.append(found[1])
        for draw, segment in listed[short:]:
            symbols = np.array([self._symbol(x) for x in self._symbols(segment, draw)], np.int64)
            found = self._written(symbols, np.array([len(symbols)]))
            ids.append(found[0])
            count.append(found[1])
        lengths, starts = np.empty(len(wanted), np.int64), np.empty(len(wanted), np.int64)
        if count:
            lengths[order] = (every := np.concatenate(count))
            starts[order] = every.cumsum() - every
        return b"".join(x.tobytes() for x in ids), starts.tolist(), lengths.tolist()

    def _forget(self) -> None:
        self._known, self._segments = {}, []
        self._ids = np.empty(0, np.int32)
        # Of draw d of segment s: place s * draws + d; below 0 if not learnt.
        self._start, self._count = np.empty(0, np.int64), np.empty(0, np.int32)

    def _draws_of(self, texts: list[str], counts: np.ndarray) -> np.ndarray:
        """Draw of each occurrence of a segment, by its number in its text."""
        if self._draws == 1:
            return np.zeros(int(counts.sum()), np.int64)
        seed = self._seed & _MASK
        own = np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in texts), np.uint64, len(texts))
        number = np.arange(int(counts.sum())) - np.repeat(counts.cumsum() - counts, counts)
        h = number.astype(np.uint64) + np.repeat(own, counts)
        h = (h ^ (h >> np.uint64(30))) * _MIX
        h = (h ^ (h >> np.uint64(27))) * _SPREAD
        return ((h >> np.uint64(33)) % np.uint64(self._draws)).astype(np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after the other, and the bounds between texts; a text without characters has none."""
        segments: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = _SEGMENT.findall(f" {text}")
                counts[i] = len(own)
                segments += own
        distinct = dict.fromkeys(segments)
        new = [s for s in distinct if s not in self._known]
        if len(self._known) + len(new) > CACHED_SEGMENTS or len(self._ids) > CACHED_IDS:
            self._forget()
            new = list(distinct)
        self._known.update(zip(new, range(len(self._segments), len(self._segments) + len(new)), strict=True))
        self._segments += new
        unknown = len(new) * self._draws
        self._start = np.concatenate([self._start, np.full(unknown, -1)])
        self._count = np.concatenate([self._count, np.zeros(unknown, np.int32)])
        place = np.fromiter(map(self._known.__getitem__, segments), np.int64, len(segments))
        place = place * self._draws + self._draws_of(texts, counts)
        wanted = np.unique(place[self._start[place] < 0])
        if len(wanted):
            names = self._segments
            ids, starts, lengths = self._learn([(w % self._draws, names[w // self._draws]) for w in wanted.tolist()])
            self._start[wanted] = np.array(starts) + len(self._ids)
            self._count[wanted] = lengths
            self._ids = np.concatenate([self._ids, np.frombuffer(ids, np.int32)])
        size = self._count[place].astype(np.int64)
        ends = np.concatenate([[0], size.cumsum()])
        ids = self._ids[np.arange(ends[-1]) + np.repeat(self._start[place] - ends[:-1], size)]
        return ids, ends[np.concatenate([[0], counts.cumsum()])]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; a text without characters has none."""
        ids, bounds = self.encode_all(texts)
        return np.split(ids, bounds[1:-1]) if texts else []

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decoded_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts whose ids lie between neighbouring ``bounds``; no ids, an empty text."""
        taken = self._bytes.take(pa.array(ids, pa.int32()))
        if taken.null_count:
            raise KeyError("an id that stands for no text")
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int32)[: len(ids) + 1]
        data = memoryview(data) if data is not None else memoryview(b"")
        # Each text begins with the space that encoding puts in front.
        cuts = ends[bounds].tolist()
        return [bytes(data[a + 1 : b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids) -> str:
        """Text of ids: the inverse of ``encode`` at any rate, seed and number of draws."""
        data = self._data
        return b"".join([data[i] for i in ids]).decode()[1:]


def encode(
    docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", rate: float = RATE, seed: int = 0, draws: int = DRAWS
) -> DataFrame:
    """(doc_id, ids) for every row. ``model`` is the path of the model file on every machine. A null or empty text has no ids."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, rate, seed, draws)
        for batch in batches:
            values, offsets = codec.encode_all([v or "" for v in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], ["doc_id", "ids"]
            )

    return docs.select(col(doc_id).cast("long"), col(text)).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(
    docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", rate: float = RATE, seed: int = 0, draws: int = DRAWS
) -> DataFrame:
    """(doc_id, ids, decoded_chars, decoded_sha256) for every row: the ids of ``encode``, and the text that ``Codec.decode`` makes of these ids.

    Encoding and decoding share one pass, so the ids aren't sent to the workers a second time.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, rate, seed, draws)
        for batch in batches:
            values, offsets = codec.encode_all([v or "" for v in batch.column(1).to_pylist()])
            backs = codec.decoded_batch(values, offsets)
            lengths = [len(back.decode()) for back in backs]
            sums = [hashlib.sha256(back).hexdigest() for back in backs]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(lengths, pa.int64()), pa.array(sums, pa.string())],
                ["doc_id", "ids", "decoded_chars", "decoded_sha256"],
            )

    return docs.select(col(doc_id).cast("long"), col(text)).mapInArrow(
        run, "doc_id long, ids array<int>, decoded_chars long, decoded_sha256 string"
    )


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) for every row; null ids give an empty text."""
    short_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model, 0.0)
        for batch in batches:
            texts = [codec.decode(v.values.to_pylist()) if v.is_valid else "" for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(col(doc_id).cast("long"), col(ids)).mapInArrow(run, "doc_id long, text string")
