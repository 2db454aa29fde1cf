"""SentencePiece BPE encoding with seeded merge-dropout, and its decoding.

Pieces, scores and types come from a SentencePiece model file. A text is cut where a
blank follows another character (no piece spans such a place); each cut, a *word*, is
segmented by the usual agenda: of all neighbours whose join is a piece, the one with
the highest score, leftmost first, is merged, until none is left. With dropout a candidate
merge is skipped if a hash keyed by seed, text, the word's place in it and the candidate's three
positions falls below ``dropout``, so the same seed always gives the same ids and every
occurrence of a word is segmented by draws of its own.
Characters that are no piece become byte pieces, so every segmentation decodes to the
text itself; a literal U+2581, which the file uses for blanks, is always written in bytes.
Without dropout the ids are the library's own (but for that character).

Distinct words of a batch are segmented together, one merge of every word per step; words
of over ``LONG`` characters go through a heap. With dropout, occurrences whose draws agree on every
candidate that came up share that segmentation: first each word without any skip, then
one occurrence of each group that is left, until every occurrence has its own.

Defined results: null and empty texts have no ids and decode to the empty text; repeated
rows get the same ids; keys may be null; an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import python_ready, text_or_empty
from .textkernel import byte_view, mix, parts, span_hashes

DROPOUT = 0.1
SEED = 2024
LONG = 256
_BLANK = 0x2581
_NONE = np.int32(2**31 - 1)
#: Piece types of the file format.
_NORMAL, _BYTE, _USER = 1, 6, 4


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, kind, data[at : at + n]
            at += n


class Pieces:
    """The pieces of a model file as lookup tables."""

    _shared: dict[str, Pieces] = {}

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        self.text: list[str] = []
        scores, kinds = [], []
        for number, _, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.text.append(piece)
                scores.append(score)
                kinds.append(kind)
        self.id = {p: i for i, (p, k) in enumerate(zip(self.text, kinds)) if k in (_NORMAL, _USER)}
        self.byte = np.zeros(256, dtype=np.int32)
        for i, (p, k) in enumerate(zip(self.text, kinds)):
            if k == _BYTE:
                self.byte[int(p[3:5], 16)] = i
        order = sorted({scores[i] for i in self.id.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        self.rank = np.full(len(self.text), _NONE, dtype=np.int32)
        for i in self.id.values():
            self.rank[i] = rank_of[scores[i]]
        # single characters by code point; the rest are told by their negative
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        pairs = {(self.id[p[:c]], self.id[p[c:]]): i for p, i in self.id.items() for c in range(1, len(p)) if p[:c] in self.id and p[c:] in self.id}
        self.pairs = pairs
        self._hash_pairs(pairs)
        # bytes of each piece, blanks as blanks
        raw_pieces = [bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(chr(_BLANK), " ").encode() if k in (_NORMAL, _USER) else b"" for p, k in zip(self.text, kinds)]
        self.width = np.array([len(b) for b in raw_pieces], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw_pieces), dtype=np.uint8)

    @classmethod
    def shared(cls, path: str) -> Pieces:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _hash_pairs(self, pairs: dict[tuple[int, int], int]) -> None:
        bits = max(8, (4 * len(pairs)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._keys = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self._joined = np.full((1 << bits) + 64, -1, dtype=np.int32)
        self._probes = 1
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        for key, slot, joined in zip(keys.tolist(), self._slots(keys).tolist(), pairs.values()):
            n = 1
            while self._keys[slot] != -1:
                slot += 1
                n += 1
            self._keys[slot], self._joined[slot] = key, joined
            self._probes = max(self._probes, n)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that left and right make, or -1."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot, out = self._slots(keys), np.full(len(keys), -1, dtype=np.int32)
        open_ = np.arange(len(keys))
        for p in range(self._probes):
            at = slot[open_] + p
            held = self._keys[at]
            hit = held == keys[open_]
            out[open_[hit]] = self._joined[at[hit]]
            open_ = open_[~hit & (held != -1)]
            if not len(open_):
                break
        return out


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Is this candidate merge of a word (by its key) left out?"""
    if dropout <= 0:
        return np.zeros(len(key), dtype=bool)
    place = start.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + middle.astype(np.uint64) * np.uint64(0x165667B19E3779F9) + end.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5)
    return (mix(key ^ mix(place)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def agenda(pieces: Pieces, symbols: list[int], key: int, dropout: float) -> list[int]:
    """Segmentation of one word with a heap of candidates."""
    n = len(symbols)
    ids, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
    end = list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []
    one = np.array([key], dtype=np.uint64)

    def offer(a: int, b: int) -> None:
        joined = pieces.pairs.get((ids[a], ids[b]), -1)
        if joined >= 0 and not skipped(one, np.array([a]), np.array([b]), np.array([end[b]]), dropout)[0]:
            heapq.heappush(heap, (int(pieces.rank[joined]), a, b, end[b], joined))

    for a in range(n - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, stop, joined = heapq.heappop(heap)
        if ids[a] is None or after[a] != b or end[b] != stop or end[a] != b:
            continue
        ids[a], ids[b], end[a] = joined, None, stop
        after[a] = after[b]
        if after[a] >= 0:
            before[after[a]] = a
            offer(a, after[a])
        if before[a] >= 0:
            offer(before[a], a)
    return [i for i in ids if i is not None]


def segment(pieces: Pieces, symbols: np.ndarray, first: np.ndarray, keys: np.ndarray, dropout: float, offers: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words after merging, where each word's begin, and one more); word w is first[w] to first[w + 1].

    ``offers`` takes (words, starts, middles, ends) of the candidates that came up in words of up to ``LONG`` symbols."""
    size = np.diff(first)
    alive = np.ones(len(symbols), dtype=bool)
    out = symbols.copy()
    done = np.zeros(len(size), dtype=bool)
    longer: dict[int, list[int]] = {}
    for w in np.flatnonzero(size > LONG).tolist():
        longer[w] = agenda(pieces, symbols[first[w] : first[w + 1]].tolist(), int(keys[w]), dropout)
        done[w] = True
        a = first[w]
        out[a : a + len(longer[w])] = longer[w]
        alive[a + len(longer[w]) : first[w + 1]] = False
    wide = 2
    while wide <= LONG:
        which = np.flatnonzero(~done & (size > wide // 2) & (size <= wide)) if wide > 2 else np.flatnonzero(~done & (size == 2))
        for at in range(0, len(which), 1 << 15):
            _merge(pieces, out, alive, first, size, which[at : at + (1 << 15)], wide, keys, dropout, offers)
        wide *= 2
    kept = np.concatenate([[0], np.cumsum(alive)])
    return out[alive], kept[first]


def _merge(pieces: Pieces, out: np.ndarray, alive: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray, wide: int, keys: np.ndarray, dropout: float, offers: list | None) -> None:
    """All merges of words of up to ``wide`` symbols, one of each word per step."""
    n, key, base = size[which], keys[which], first[which]
    columns = np.arange(wide + 1)
    ids = np.full((len(which), wide + 2), -1, dtype=np.int32)
    inside = columns[None, :wide] < n[:, None]
    ids[:, :wide][inside] = out[(base[:, None] + columns[None, :wide])[inside]]
    after = np.minimum(columns[None, :] + 1, n[:, None])  # n: the end
    after = np.concatenate([after, n[:, None]], axis=1)
    before = np.broadcast_to(np.arange(-1, wide + 1), ids.shape).copy()
    best = np.full((len(which), wide), _NONE, dtype=np.int32)
    joined = np.full((len(which), wide), -1, dtype=np.int32)

    def offer(r: np.ndarray, a: np.ndarray) -> None:
        """Candidates at (row, left position): the join with what follows."""
        b = after[r, a]
        ok = b < n[r]
        best[r[~ok], a[~ok]] = _NONE
        r, a, b = r[ok], a[ok], b[ok]
        j = pieces.join(ids[r, a], ids[r, b])
        good = j >= 0
        best[r[~good], a[~good]] = _NONE
        r, a, b, j = r[good], a[good], b[good], j[good]
        if offers is not None:
            offers.append((which[r], a, b, after[r, b]))
        drop = skipped(key[r], a, b, after[r, b], dropout)
        best[r, a] = np.where(drop, _NONE, pieces.rank[j])
        joined[r, a] = j

    r, a = np.nonzero(inside[:, : wide - 1] & inside[:, 1:])
    offer(r, a)
    rows = np.arange(len(which))
    while len(rows):
        a = best[rows].argmin(axis=1)
        go = best[rows, a] != _NONE
        rows, a = rows[go], a[go]
        if not len(rows):
            break
        b = after[rows, a]
        ids[rows, a] = joined[rows, a]
        c = after[rows, b]
        after[rows, a] = c
        inner = c < n[rows]
        before[rows[inner], c[inner]] = a[inner]
        best[rows, b] = _NONE
        alive[base[rows] + b] = False
        offer(rows, a)
        left = before[rows, a]
        has = left >= 0
        offer(rows[has], left[has])
    out[(base[:, None] + columns[None, :wide])[inside]] = ids[:, :wide][inside]


def _expanded(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    upto = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - upto, size)


def segment_occurrences(pieces: Pieces, symbols: np.ndarray, first: np.ndarray, word: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all segmentations, where each begins, which one each occurrence takes); occurrence i is word[i] under keys[i]."""
    size = np.diff(first)
    parts_, ends, taken, n_done = [], [np.zeros(1, np.int64)], np.full(len(word), -1, dtype=np.int64), 0

    def run(words: np.ndarray, keys_: np.ndarray, rate: float, offers: list | None) -> None:
        nonlocal n_done
        out, at = segment(pieces, symbols[_expanded(first[words], size[words])], np.concatenate([[0], np.cumsum(size[words])]), keys_, rate, offers)
        parts_.append(out)
        ends.append(at[1:] + ends[-1][-1])
        n_done += len(words)

    def agreeing(left: np.ndarray, group: np.ndarray, lead: np.ndarray | None, offers: list) -> tuple[np.ndarray, np.ndarray]:
        """(does the occurrence skip what its group's segmentation skipped, a hash of what it skips)."""
        of, a, b, c = (np.concatenate([o[k] for o in offers]) if offers else np.zeros(0, np.int64) for k in range(4))
        order = np.argsort(of, kind="stable")
        a, b, c = a[order], b[order], c[order]
        count = np.bincount(of, minlength=int(group.max()) + 1)
        begin = np.cumsum(count) - count
        same, bits = np.ones(len(left), dtype=bool), np.zeros(len(left), dtype=np.uint64)
        step = max(1, (1 << 20) // max(1, int(count.max(initial=1))))
        for x in range(0, len(left), step):
            g = group[x : x + step]
            at, row = _expanded(begin[g], count[g]), np.repeat(np.arange(len(g)), count[g])
            skips = skipped(keys[left[x : x + step]][row], a[at], b[at], c[at], dropout)
            led = skipped(keys[lead[g]][row], a[at], b[at], c[at], dropout) if lead is not None else np.zeros(len(at), bool)
            same[x : x + step] = np.bincount(row[skips != led], minlength=len(g)) == 0
            mark = mix((at - begin[g][row]).astype(np.uint64) + np.uint64(1))
            np.add.at(bits, x + row[skips], mark[skips])
        return same, bits

    # words without a skip; all further ones by one occurrence of each group
    n_words = len(size)
    if dropout <= 0:
        run(np.arange(n_words), np.zeros(n_words, np.uint64), 0, None)
        return np.concatenate(parts_), np.concatenate(ends), word
    long = np.flatnonzero(size[word] > LONG)
    if len(long):
        taken[long] = np.arange(len(long))
        run(word[long], keys[long], dropout, None)
    left = np.flatnonzero(size[word] <= LONG)
    used, group = np.unique(word[left], return_inverse=True)
    base, offers = n_done, []
    run(used, np.zeros(len(used), np.uint64), 0, offers)
    lead = None
    while len(left):
        same, bits = agreeing(left, group, lead, offers)
        taken[left[same]] = base + group[same]
        left, group, bits = left[~same], group[~same], bits[~same]
        if not len(left):
            break
        _, one, group = np.unique(mix(bits) ^ mix(group.astype(np.uint64) + np.uint64(1 << 40)), return_index=True, return_inverse=True)
        lead = left[one]
        base, offers = n_done, []
        run(word[lead], keys[lead], dropout, offers)
    return np.concatenate(parts_), np.concatenate(ends), taken


class Encoder:
    def __init__(self, path: str, dropout: float, seed: int, variants: int | None = None) -> None:
        """``variants`` is no longer used: every occurrence draws freely."""
        self.pieces, self.dropout, self.seed = Pieces.shared(path), dropout, seed

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text in them); each text begins with the blank that the library puts there."""
        buf, bounds = byte_view(col)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(col) + 1, np.int64)
        cut = np.zeros(len(buf), dtype=bool)
        cut[1:] = ((buf[1:] == 0x20) & (buf[:-1] != 0x20)) | (buf[1:] == 0x0A) | (buf[:-1] == 0x0A)
        cut[bounds[:-1][bounds[:-1] < len(buf)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))
        hashes = span_hashes(buf, start, end)
        _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if self.dropout > 0:
            text_of = np.searchsorted(bounds, start, side="right") - 1
            own = mix(span_hashes(buf, bounds[:-1], bounds[1:]) ^ mix(np.full(len(col), self.seed & (1 << 64) - 1, dtype=np.uint64)))
            keys = mix(own[text_of] ^ mix((start - bounds[text_of]).astype(np.uint64) + np.uint64(1)))
        else:
            keys = hashes
        a, b = start[one], end[one]
        width = b - a
        upto = np.concatenate([[0], np.cumsum(width)])
        flat = buf[np.arange(upto[-1]) + np.repeat(a - upto[:-1], width)]
        points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])[upto]
        literal = points == _BLANK
        points[points == 0x20] = _BLANK
        symbols = self.pieces.char[points].copy()
        unknown = (symbols < 0) | literal
        symbols[unknown] = -2 - np.where(literal, _BLANK, points)[unknown]
        merged, at, which = segment_occurrences(self.pieces, symbols, first, which, keys, self.dropout)
        merged, at = self._bytes(merged, at)
        size = np.diff(at)[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = merged[np.arange(upto[-1]) + np.repeat(at[:-1][which] - upto[:-1], size)]
        return ids, upto[np.searchsorted(start, bounds, side="left")]

    def _bytes(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the pieces of their bytes."""
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols, at
        coded = [chr(p).encode() for p in (-2 - symbols[odd].astype(np.int64)).tolist()]
        width = np.ones(len(symbols), dtype=np.int64)
        width[odd] = [len(c) for c in coded]
        upto = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(symbols, width)
        spots = np.repeat(upto[odd], width[odd]) + np.concatenate([np.arange(len(c)) for c in coded])
        out[spots] = self.pieces.byte[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        return out, upto[at]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, bounds of each), the leading blank included."""
        width = self.pieces.width[ids]
        upto = np.concatenate([[0], np.cumsum(width)])
        return self.pieces.bytes[np.arange(upto[-1]) + np.repeat(self.pieces.begin[ids] - upto[:-1], width)], upto[bounds]


def encode_with_dropout(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", dropout: float = DROPOUT, seed: int = SEED, keep_ids: bool = True) -> DataFrame:
    """key, n_pieces, ids_crc32 (of little-endian 32-bit ids), lossless (they decode to the text)[, ids]."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.when(F.length(text_or_empty(text)) > 0, F.concat(F.lit(" "), F.col(text))).otherwise("").alias("text"))
    schema = T.StructType([rows.schema["key"], T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, dropout, seed)
        for batch in batches:
            for at, col in parts(batch.column(1), 2 << 20):
                ids, bounds = encoder.encode(col)
                back, ends = encoder.decode(ids, bounds)
                buf, begins = byte_view(col)
                # one comparison for all texts; only where it fails, one by one
                if len(back) == len(buf) and np.array_equal(ends, begins) and np.array_equal(back, buf):
                    same = [True] * len(col)
                else:
                    same = [np.array_equal(back[ends[i] : ends[i + 1]], buf[begins[i] : begins[i + 1]]) for i in range(len(col))]
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [batch.column(0).slice(at, len(col)), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(make, schema).withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the text that each row's ids stand for (null ids: empty)."""
    python_ready(encoded.sparkSession)
    rows = encoded.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, 0, 0)
        for batch in batches:
            column = batch.column(1)
            bounds = column.offsets.to_numpy().astype(np.int64)
            back, ends = encoder.decode(column.flatten().to_numpy(), bounds - bounds[0])
            raw = back.tobytes()
            texts = [raw[a + 1 : b].decode("utf-8") if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return rows.mapInArrow(make, T.StructType([rows.schema["key"], T.StructField("text", T.StringType())])).withColumnRenamed("key", key)
