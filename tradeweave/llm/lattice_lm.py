"""Language-model scores by the likelihood of a subword lattice.

A text is a sequence of words (A-Z lower-cased) and one end. A word, with the word mark in front, is
the lattice of all its segmentations into pieces of an existing vocabulary; a character can also go
by its bytes, so every text has a probability. Pieces are drawn independently (a unigram model), and a
text's probability is the sum over *all* segmentations: as only the first piece of a word carries the
word mark, it is the product of its words' sums, each found by forward recursion in log space.

1. Words are counted over all documents, in all and in those that may teach: (word, total, c).
2. The vocabulary's own scores weight the segmentations of every training word; its
   forward-backward sums give each piece an expected count, and these, with the scores as a prior worth
   ``PRIOR`` pieces, are the model's probabilities (``rounds`` times). The scores of a merge vocabulary are
   merge ranks: they become probabilities by Zipf's law.
3. Every distinct word is scored once. Words that make up at least one in ``HEAD`` of all tokens, so at most
   ``HEAD`` of them, go to every task; the documents' other words are joined to the table of words. None
   of those has more than one in ``HEAD`` of the rows.

``base_score`` is the plain word model with one added to every count, over the same words.

Defined results: a null, empty or blank text is its end alone; a null key is not held out and doesn't teach; repeated
rows each get their row; without documents to learn from, the prior alone scores; texts are read in pieces cut at
blanks, so memory follows the longest word; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import python_ready, staged
from .textkernel import WordCounts, packed, span_hashes, span_strings, word_parts, words_of

HEAD = 1 << 20
PRIOR = 1000.0
MARK = "▁"
NEVER = -1e8  # scores below: pieces for white space, which no word holds
END_SHARE = 0.01  # of the prior
BYTE_SHARE = 0.01
SMALL = 1e-250  # a word of less probability is summed in log space


class Vocabulary(NamedTuple):
    """Pieces and the log probability of each; then those of the 256 bytes, then that of the end."""

    pieces: list[str]
    logs: np.ndarray


def vocabulary(model_path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > NEVER]
    scores = np.array([model.get_score(i) for i in ids])
    ranks = bool((scores == np.round(scores)).all())
    weight = 1 / (1 - scores) if ranks else np.exp(scores)
    weight *= (1 - END_SHARE - BYTE_SHARE) / weight.sum()
    return Vocabulary([model.id_to_piece(i) for i in ids], np.log(np.concatenate([weight, np.full(256, BYTE_SHARE / 256), [END_SHARE]])))


class Lattice:
    """Forward and backward sums over all segmentations of a word."""

    def __init__(self, vocab: Vocabulary) -> None:
        import ahocorasick

        self.matcher = ahocorasick.Automaton()
        logs = vocab.logs.tolist()
        for i, piece in enumerate(vocab.pieces):
            self.matcher.add_word(piece, (len(piece), logs[i], math.exp(logs[i]), i))
        self.matcher.make_automaton()
        self.n_pieces, self.bytes = len(vocab.pieces), logs[len(vocab.pieces) : -1]
        self.by_bytes: dict[str, float] = {}
        self.counts = [0.0] * len(vocab.pieces)
        self.char_counts: dict[str, float] = {}

    def _spelled(self, char: str) -> float:
        log = self.by_bytes[char] = sum(self.bytes[b] for b in char.encode())
        return log

    def arcs(self, text: str) -> list[tuple[int, int, float, int]]:
        """(from, to, log probability, piece or -1 for a character's bytes), by end."""
        at, out, known = 0, [], self.by_bytes
        for last, (size, log, _, piece) in self.matcher.iter(text):
            while at <= last:
                out.append((at, at + 1, known.get(text[at]) or self._spelled(text[at]), -1))
                at += 1
            out.append((last + 1 - size, last + 1, log, piece))
        out += [(k, k + 1, known.get(text[k]) or self._spelled(text[k]), -1) for k in range(at, len(text))]
        return out

    @staticmethod
    def _ahead(arcs: list, n: int) -> list[float]:
        log1p, exp = math.log1p, math.exp
        ahead: list[float | None] = [None] * (n + 1)
        ahead[0] = 0.0
        for a, b, log, _ in arcs:
            x, y = ahead[a] + log, ahead[b]
            ahead[b] = x if y is None else (x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y)))
        return ahead

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the sum over all segmentations, by forward recursion in log space."""
        text = MARK + word
        return self._ahead(self.arcs(text), len(text))[-1]

    def expect(self, word: str, times: float) -> None:
        """Adds the expected number of every piece in ``times`` such words.

        In plain numbers; where these would become too small, in log space.
        """
        text, exp = MARK + word, math.exp
        n = len(text)
        ahead = [0.0] * (n + 1)
        ahead[0] = 1.0
        at, arcs, known = 0, [], self.by_bytes
        for last, (size, _, p, piece) in self.matcher.iter(text):
            while at <= last:
                q = exp(known.get(text[at]) or self._spelled(text[at]))
                arcs.append((at, at + 1, q, -1))
                ahead[at + 1] += ahead[at] * q
                at += 1
            a = last + 1 - size
            arcs.append((a, last + 1, p, piece))
            ahead[last + 1] += ahead[a] * p
        for at in range(at, n):
            q = exp(known.get(text[at]) or self._spelled(text[at]))
            arcs.append((at, at + 1, q, -1))
            ahead[at + 1] += ahead[at] * q
        if ahead[n] < SMALL:
            return self._expect_small(text, times)
        behind, counts, chars = [0.0] * (n + 1), self.counts, self.char_counts
        behind[n] = times / ahead[n]
        for a, b, p, piece in reversed(arcs):
            x = p * behind[b]
            behind[a] += x
            if piece >= 0:
                counts[piece] += ahead[a] * x
            else:
                chars[text[a]] = chars.get(text[a], 0.0) + ahead[a] * x

    def _expect_small(self, text: str, times: float) -> None:
        arcs = self.arcs(text)
        ahead = self._ahead(arcs, len(text))
        n, whole = len(text), ahead[-1]
        behind = self._ahead([(n - b, n - a, log, piece) for a, b, log, piece in reversed(arcs)], n)
        for a, b, log, piece in arcs:
            share = math.exp(ahead[a] + log + behind[n - b] - whole) * times
            if piece >= 0:
                self.counts[piece] += share
            else:
                self.char_counts[text[a]] = self.char_counts.get(text[a], 0.0) + share

    def expected(self) -> np.ndarray:
        """Expected counts gathered so far: pieces, bytes, and 0 for the end."""
        out = np.array([*self.counts, *[0.0] * 257])
        for char, share in self.char_counts.items():
            for byte in char.encode():
                out[self.n_pieces + byte] += share
        return out


def word_table(docs: DataFrame) -> DataFrame:
    """(word, total, c) of (text, learn): occurrences in all documents and in those that teach."""
    names = ["word", "total", "c"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordCounts(2)
        for batch in batches:
            teaches = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, col in word_parts(batch.column(0)):
                w = words_of(col, lower=True)
                hashes = span_hashes(w.buf, w.start, w.end)
                _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                learned = np.repeat(teaches[at : at + len(col)], np.diff(w.first))
                counts = packed(np.bincount(which, minlength=len(first)), np.bincount(which, learned, minlength=len(first)))
                held.add(span_strings(w.buf, w.start[first], w.end[first]).to_pylist(), counts)
                if held.full:
                    yield held.taken(names)
        yield held.taken(names)

    counted = docs.select("text", "learn").mapInArrow(count, "word string, total long, c long")
    return staged(counted.groupBy("word").agg(F.sum("total").alias("total"), F.sum("c").alias("c")), "words")


def fitted(words: DataFrame, docs_learned: int, vocab: Vocabulary, rounds: int) -> Vocabulary:
    """The vocabulary with the probabilities of expected counts over all training words.

    One row per piece comes to the driver: the vocabulary bounds them.
    """
    prior = np.exp(vocab.logs) * PRIOR
    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], vocab: Vocabulary = vocab) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(vocab)
            for batch in batches:
                for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    lattice.expect(word, c)
            found = lattice.expected()
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found[some])], names=["piece", "n"])

        counts = prior.copy()
        for piece, n in words.filter("c > 0").select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[piece] += n
        counts[-1] += docs_learned
        vocab = Vocabulary(vocab.pieces, np.log(counts / counts.sum()))
    return vocab


def lattice_scores(docs: DataFrame, model_path: str, held_out: Column, key: str = "doc_id", text: str = "text", rounds: int = 2) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10): one row per row of ``docs``.

    The model learns from rows that are not ``held_out`` and whose key is not null.
    """
    python_ready(docs.sparkSession)
    out = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), out.alias("held_out"), (~out & F.col(key).isNotNull()).alias("learn"))
    docs_learned = rows.filter("learn").count()
    words = word_table(rows)
    total, train_words, known_words = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_train, n_kinds = train_words + docs_learned, known_words + (docs_learned > 0)
    vocab = fitted(words, docs_learned, vocabulary(model_path), rounds)
    lg = math.log(10)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocab)
        for batch in batches:
            logs = [lattice.log_probability(w) / lg for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], names=["word", "total", "c", "model"])

    base = F.log10((F.col("c") + 1) / F.lit(float(n_train + n_kinds + 1)))
    scored = staged(words.mapInArrow(score, "word string, total long, c long, model double").withColumn("base", base), "scored")

    # at most HEAD words have one in HEAD of all tokens
    frequent = F.col("total") * HEAD >= max(total, 1)
    head = scored.filter(frequent).select("word", "c", "base", "model").toArrow()
    names = head.column("word").combine_chunks() if head.num_rows else pa.array([], pa.string())
    marks = words_of(names)
    hashes = span_hashes(marks.buf, marks.start, marks.end)
    order = np.argsort(hashes)
    known, of_base, of_model = (head.column(c).to_numpy()[order] for c in ("c", "base", "model"))
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], known > 0, of_base, of_model))
    fields = ["key", "held_out"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document (word null), and a row for each of its words that is not in the head."""
        hashes, known, of_base, of_model = shared.value
        for batch in batches:
            n = batch.num_rows
            sums = np.zeros((4, n))
            for at, col in word_parts(batch.column("text")):
                w = words_of(col, lower=True)
                own = span_hashes(w.buf, w.start, w.end)
                doc = at + np.repeat(np.arange(len(col)), np.diff(w.first))
                place = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
                inside = hashes[place] == own if len(hashes) else np.zeros(len(own), bool)
                place, of_doc = place[inside], doc[inside]
                sums[0] += np.bincount(doc, minlength=n)
                for k, values in enumerate((known, of_base, of_model), 1):
                    sums[k] += np.bincount(of_doc, values[place], minlength=n)
                rest = np.flatnonzero(~inside)
                rest = rest[np.lexsort((own[rest], doc[rest]))]
                new = np.ones(len(rest), bool)
                new[1:] = (own[rest][1:] != own[rest][:-1]) | (doc[rest][1:] != doc[rest][:-1])
                first = rest[new]
                times = np.diff(np.append(np.flatnonzero(new), len(rest)))
                for a in range(0, len(first), 1 << 16):
                    some = first[a : a + (1 << 16)]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("rid").take(pa.array(doc[some])), *[pa.nulls(m, batch.column(f).type) for f in fields], *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                        span_strings(w.buf, w.start[some], w.end[some]), pa.array(times[a : a + m], pa.int64())], names=told.fieldNames())
            yield pa.RecordBatch.from_arrays([
                batch.column("rid"), *[batch.column(f) for f in fields], pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]),
                pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=told.fieldNames())

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), *fields, "text")
    told = numbered.select("rid", *fields, *[F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("n_known", "long"), ("base", "double"), ("model", "double"), ("word", "string"), ("times", "long"))]).schema
    told = T.StructType([T.StructField(f.name, f.dataType) for f in told])
    found = staged(numbered.mapInArrow(look_up, told), "looked_up")
    rare = found.filter("word IS NOT NULL").select("rid", "word", "times").join(scored.filter(~frequent).select("word", "c", F.col("base").alias("word_base"), F.col("model").alias("word_model")), "word")
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.col("word_base")).alias("rare_base"), F.sum(F.col("times") * F.col("word_model")).alias("rare_model"))
    whole = found.filter("word IS NULL").drop("word", "times").join(rare, "rid", "left")
    end_base = math.log10((docs_learned + 1) / (n_train + n_kinds + 1))
    return whole.select(
        F.col("key").alias(key), "held_out", (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(docs_learned > 0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(end_base)).alias("base_score"),
        (F.col("model") + F.coalesce("rare_model", F.lit(0.0)) + F.lit(float(vocab.logs[-1]) / lg)).alias("score"),
    )
