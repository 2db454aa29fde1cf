"""Spelling variants of the corpus's words, by k-d trees over letter counts.

One edit changes a word's letter counts little: a replacement adds one letter and takes one
(L1 distance two), an insertion adds one (distance one). Near words of length n are thus
found by range searches in two trees of letter-count vectors, that of length n and that of length n + 1.

* The top of each length's tree is built on the driver from a sample of at most ``SAMPLE`` vectors and
  deals all words of the length into cells of about ``CELL`` words. A word is searched in every cell whose
  box it can reach by its one edit; that is its own and those across one or two of the tree's borders.
* In a cell the tree goes on to leaves of ``LEAF`` words with the tight box of each node. Searches go down in
  blocks; a node is left where letters to add or to take exceed the edit's. Vectors in the leaves are
  compared first by the parity of their counts, then letter by letter; last, the order of letters is
  verified on the words themselves.
* What leaves a cell is one row for each word with near words there: how many, and which has the
  largest count. Pairs are not written.

Words come from runs of letters with a keyed deletion (see ``word_counts``). A word's form is its near
word of largest count if that is at least ``ratio`` times its own; roots follow forms by
pointer doubling, and counts grow by that ratio on the way, so no form leads back.

Defined results: a null text has no words; a null key deletes nothing; equal counts take the word that is
smallest in code-point order; repeated rows count; long texts are read in pieces cut at blanks; a word of any
length is compared whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import python_ready, staged
from .textkernel import WordCounts, latin_runs_of, packed, span_hashes, span_strings, word_parts

CELL = 4096
SAMPLE = 20_000  # vectors of a length that shape the top of its tree
PER_CELL = 64  # sampled vectors per cell wanted
LEAF = 32
BLOCK = 1024
SHORT = 64  # bytes of a run up to which checksums are computed column by column

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def run_checksums(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run's bytes, going on from the checksum ``before`` of what precedes it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    long = int((size > SHORT).sum())
    out = np.empty(len(start), np.uint32)
    for k in order[:long].tolist():
        out[k] = zlib.crc32(buf[start[k] : end[k]].tobytes(), int(before[k]))
    rest = order[long:]
    state = ~before[rest].astype(np.uint32)
    lengths = size[rest]
    for j in range(int(lengths[0]) if len(rest) else 0):
        n = int(np.searchsorted(-lengths, -j, side="left"))  # runs longer than j
        state[:n] = _CRC[(state[:n] ^ buf[start[rest[:n]] + j]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[rest] = ~state
    return out


def word_counts(docs: DataFrame, key: str, text: str, every: int, least_points: int, least_count: int) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased. Where ``every`` divides the CRC-32 h of ``<key>:<run>``, the run loses
    its code point h modulo its length. Words of ``least_points`` code points and ``least_count`` occurrences or more."""
    names = ["word", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordCounts(1)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, col in word_parts(batch.column(1)):
                w = latin_runs_of(col)
                points = np.zeros(len(w.buf) + 1, np.int64)
                np.cumsum((w.buf & 0xC0) != 0x80, out=points[1:])
                n_points = points[w.end] - points[w.start]
                doc = np.repeat(np.arange(at, at + len(col)), np.diff(w.first))
                some = np.flatnonzero(n_points >= least_points)
                start, end, n_points, doc = w.start[some], w.end[some], n_points[some], doc[some]
                mine = keys[at : at + len(col)]
                before = np.array([0 if k is None else zlib.crc32(f"{k}:".encode()) for k in mine], np.uint32)
                named = np.array([k is not None for k in mine], bool)
                h = run_checksums(w.buf, start, end, before[doc - at])
                cut = (h % every == 0) & named[doc - at]
                whole = np.flatnonzero(~cut)
                _, first, times = np.unique(span_hashes(w.buf, start[whole], end[whole]), return_index=True, return_counts=True)
                first = whole[first]
                held.add(span_strings(w.buf, start[first], end[first]).to_pylist(), packed(times))
                for k in np.flatnonzero(cut).tolist():
                    run = w.buf[start[k] : end[k]].tobytes().decode()
                    place = int(h[k]) % len(run)
                    if len(run) > least_points:
                        held.add([run[:place] + run[place + 1 :]], [1])
                if held.full:
                    yield held.taken(names)
        yield held.taken(names)

    counted = docs.select(F.col(key), F.coalesce(F.col(text), F.lit(""))).mapInArrow(count, "word string, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    return staged(counted.withColumn("size", F.char_length("word")), "words")


def codes_of(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points (all below 256)."""
    size = len(words[0]) if words else 0
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), 256), np.int32)
    row = np.arange(len(codes))
    for j in range(codes.shape[1]):
        out[row, codes[:, j]] += 1
    return out


def parities(codes: np.ndarray) -> np.ndarray:
    """One bit per letter (modulo 64): whether its count is odd."""
    bits = np.left_shift(np.uint64(1), (codes & 63).astype(np.uint64))
    return np.bitwise_xor.reduce(bits, axis=1) if codes.shape[1] else np.zeros(len(codes), np.uint64)


class KdTree:
    """Nodes with boxes ``low`` .. ``high`` over count vectors; ``left`` is -1 at leaves, whose points are ``order[a:b]``.

    Boxes are tight, or, for the top of a tree over points not seen yet, the whole region of a node.
    """

    def __init__(self, points: np.ndarray, leaf: int, tight: bool = True) -> None:
        dims = points.shape[1]
        top = np.iinfo(np.int32).max // 4
        self.low, self.high, self.left, self.right, self.first, self.last = [], [], [], [], [], []
        self.split: list[tuple[int, int] | None] = []
        self.order = np.arange(len(points))
        work = [(0, len(points), np.zeros(dims, np.int32), np.full(dims, top, np.int32), -1, False)]
        while work:
            a, b, low, high, parent, is_right = work.pop()
            mine = points[self.order[a:b]]
            node = len(self.left)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            if tight:
                low, high = mine.min(0), mine.max(0)
            self.low.append(low)
            self.high.append(high)
            self.first.append(a)
            self.last.append(b)
            self.left.append(-1)
            self.right.append(-1)
            cut = most_even_cut(mine) if b - a > leaf else None
            self.split.append(cut)
            if cut is None:
                continue
            dim, at = cut
            below = mine[:, dim] <= at
            self.order[a:b] = np.concatenate([self.order[a:b][below], self.order[a:b][~below]])
            mid = a + int(below.sum())
            less, more = high.copy(), low.copy()
            less[dim], more[dim] = at, at + 1
            work += [(mid, b, more, high, node, True), (a, mid, low, less, node, False)]
        # a region only has the borders that cuts drew
        self.dims = np.arange(dims) if tight else np.unique([c[0] for c in self.split if c] or [0])
        self.low, self.high = np.array(self.low)[:, self.dims], np.array(self.high)[:, self.dims]
        self.left, self.right, self.first, self.last = (np.array(x) for x in (self.left, self.right, self.first, self.last))

    def leaves(self, queries: np.ndarray, add: int, take: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) where a vector of the leaf's box is ``add`` letters more and ``take`` letters less, at most, than the query's."""
        queries = queries[:, self.dims]
        i, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found_i, found_node = [], []
        while len(i):
            q = queries[i]
            near = (np.maximum(self.low[node] - q, 0).sum(1) <= add) & (np.maximum(q - self.high[node], 0).sum(1) <= take)
            i, node = i[near], node[near]
            leaf = self.left[node] < 0
            found_i.append(i[leaf])
            found_node.append(node[leaf])
            i, node = i[~leaf], node[~leaf]
            i, node = np.concatenate([i, i]), np.concatenate([self.left[node], self.right[node]])
        return np.concatenate(found_i), np.concatenate(found_node)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that holds each vector, by the cuts."""
        out = np.zeros(len(vectors), np.int64)
        work = [(0, np.arange(len(vectors)))]
        while work:
            node, some = work.pop()
            if self.split[node] is None:
                out[some] = node
            elif len(some):
                dim, at = self.split[node]
                below = vectors[some, dim] <= at
                work += [(int(self.left[node]), some[below]), (int(self.right[node]), some[~below])]
        return out


def most_even_cut(points: np.ndarray) -> tuple[int, int] | None:
    """(letter, count) so that about half of the points have at most that count of the letter; None where all are equal."""
    low, high = points.min(0), points.max(0)
    if (low == high).all():
        return None
    best, half = None, len(points) / 2
    for at in range(int(low.min()), int(min(high.max(), low.min() + 8))):
        below = (points <= at).sum(0)
        off = np.where((below > 0) & (below < len(points)), np.abs(below - half), np.inf)
        dim = int(off.argmin())
        if best is None or off[dim] < best[0]:
            best = (off[dim], dim, at)
    if best is None or np.isinf(best[0]):
        dim = int((high - low).argmax())
        return dim, int(low[dim])
    return best[1], best[2]


class Cell:
    """Words of one length in one cell, searched by blocks of words of this length or one less."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.words, self.n = np.array(words, object), np.array(counts, np.int64)
        self.codes = codes_of(words)
        vectors = letter_counts(self.codes)
        self.used = np.flatnonzero(vectors.any(0))
        self.vectors = self._narrow(vectors)
        self.odd = parities(self.codes)
        self.tree = KdTree(self.vectors, LEAF)
        self.rank = self._ranks(self.words, self.n)

    def _narrow(self, vectors: np.ndarray) -> np.ndarray:
        """Letters that the cell has, and all others as one count."""
        kept = vectors[:, self.used]
        return np.concatenate([kept, vectors.sum(1, keepdims=True) - kept.sum(1, keepdims=True)], axis=1).astype(np.int16 if vectors.shape[1] and vectors.max(initial=0) < 16000 else np.int32)

    @staticmethod
    def _ranks(words: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Place by falling count, then by the word."""
        out = np.empty(len(words), np.int64)
        out[sorted(range(len(words)), key=lambda k: (-n[k], words[k]))] = np.arange(len(words))
        return out

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) one edit apart; queries have the cell's length (replacement) or one less (insertion)."""
        take = int(codes.shape[1] == self.codes.shape[1])
        queries = self._narrow(letter_counts(codes)).astype(self.vectors.dtype)
        odd = parities(codes)
        i, leaf = self.tree.leaves(queries, 1, take)
        size = self.tree.last[leaf] - self.tree.first[leaf]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        j = self.tree.order[np.repeat(self.tree.first[leaf], size) + at]
        i = np.repeat(i, size)
        keep = np.bitwise_count(odd[i] ^ self.odd[j]) <= 1 + take
        i, j = i[keep], j[keep]
        more = self.vectors[j] - queries[i]
        keep = (np.maximum(more, 0).sum(1) == 1) & (np.maximum(-more, 0).sum(1) == take)
        i, j = i[keep], j[keep]
        a, b = codes[i], self.codes[j]
        if take:
            keep = (a != b).sum(1) == 1
        else:
            size = codes.shape[1]
            front = np.cumprod(a == b[:, :size], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
            back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
            keep = front + back >= size
        return i[keep], j[keep]


def _best(i: np.ndarray, j: np.ndarray, n: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per i: how many j, and the j of least rank."""
    place = np.full(n, len(rank))
    np.minimum.at(place, i, rank[j])
    of_rank = np.empty(len(rank), np.int64)
    of_rank[rank] = np.arange(len(rank))
    return np.bincount(i, minlength=n), of_rank[np.minimum(place, max(len(rank) - 1, 0))]


def _tops(words: DataFrame) -> dict[int, KdTree]:
    """The top of the tree of each length with more than ``CELL`` words, from sampled words (by hash, so the same ones each time)."""
    sizes = {r["size"]: r["held"] for r in words.groupBy("size").agg(F.count("*").alias("held")).filter(F.col("held") > CELL).collect()}
    wanted = {size: min(SAMPLE, PER_CELL * -(-held // CELL)) for size, held in sizes.items()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for size, held in sizes.items() for x in (size, wanted[size] / held)])
    drawn = words.filter(F.col("size").isin(list(sizes))).filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share[F.col("size")] * (1 << 30))
    sample: dict[int, list[str]] = {size: [] for size in sizes}
    for r in drawn.select("size", "word").collect():
        sample[r["size"]].append(r["word"])
    return {size: KdTree(letter_counts(codes_of(sorted(some))), max(1, len(some) * CELL // sizes[size]), tight=False) for size, some in sample.items() if some}


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of (word, n, size), for words with near words."""
    tops = _tops(words)
    names = ["tree", "cell", "role", "word", "n"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Role 0: the word in its cell, 1: searched in another cell of its length, 2: in a cell of the next length."""
        for batch in batches:
            word, n, size = (batch.column(k) for k in range(3))
            sizes = size.to_numpy()
            for length in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == length)
                vectors = letter_counts(codes_of(word.take(pa.array(mine)).to_pylist())) if length in tops or length + 1 in tops else None
                out = []
                own = tops[length].leaf_of(vectors) if length in tops else np.zeros(len(mine), np.int64)
                out.append((length, 0, np.arange(len(mine)), own))
                if length in tops:
                    i, cell = tops[length].leaves(vectors, 1, 1)
                    other = cell != own[i]
                    out.append((length, 1, i[other], cell[other]))
                i, cell = tops[length + 1].leaves(vectors, 1, 0) if length + 1 in tops else out[0][2:]
                out.append((length + 1, 2, i, cell if length + 1 in tops else np.zeros(len(i), np.int64)))
                for tree, role, i, cell in out:
                    at = pa.array(mine[i])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), tree), pa.int32()), pa.array(cell, pa.int64()), pa.array(np.full(len(i), role), pa.int32()), word.take(at), n.take(at)], names=names)

    dealt = words.select("word", "n", "size").mapInArrow(deal, "tree int, cell long, role int, word string, n long")
    n_parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = dealt.repartition(n_parts, "tree", "cell").sortWithinPartitions("tree", "cell", "role", "word")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, cell, told = None, ([], []), None, {}
        block: tuple[int, list[str], list[int]] = (0, [], [])
        out: list[tuple[str, int, int, str]] = []

        def note(words: np.ndarray, i: np.ndarray, j: np.ndarray, rank: np.ndarray, to: np.ndarray, to_n: np.ndarray) -> None:
            times, best = _best(i, j, len(words), rank)
            for k in np.flatnonzero(times).tolist():
                out.append((words[k], int(times[k]), int(to_n[best[k]]), to[best[k]]))

        def ask() -> None:
            role, words, n = block
            if words and cell is not None:
                names, counts = np.array(words, object), np.array(n, np.int64)
                i, j = cell.near(codes_of(words))
                note(names, i, j, cell.rank, cell.words, cell.n)
                if role == 2 and len(i):
                    note(cell.words, j, i, Cell._ranks(names, counts), names, counts)
            words.clear()
            n.clear()

        def close_data() -> None:
            """The cell's own words: the tree is built, and each of them is searched."""
            nonlocal cell, block
            if held[0]:
                cell = Cell(list(held[0]), list(held[1]))
                for a in range(0, len(held[0]), BLOCK):
                    block = (1, held[0][a : a + BLOCK], held[1][a : a + BLOCK])
                    ask()
            held[0].clear()
            held[1].clear()

        def taken() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])
            out.clear()
            return done

        for batch in batches:
            for tree, number, role, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, number) != at:
                    close_data()
                    ask()
                    at, cell = (tree, number), None
                if role == 0:
                    held[0].append(word)
                    held[1].append(n)
                    continue
                close_data()
                if role != block[0] or len(block[1]) >= BLOCK:
                    ask()
                    block = (role, [], [])
                block[1].append(word)
                block[2].append(n)
            yield taken()
        close_data()
        ask()
        yield taken()

    found = dealt.mapInArrow(search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    told = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return staged(told.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best")), "near")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, each round twice as far."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 199, least_points: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word."""
    python_ready(docs.sparkSession, batch_rows=4000)
    words = word_counts(docs, key, text, every, least_points, least_count)
    near = near_words(words)
    told = words.select("word", "n").join(near, "word", "left")
    has_form = F.col("best_n") >= ratio * F.col("n")
    told = staged(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")), "forms")
    roots = last_forms(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
