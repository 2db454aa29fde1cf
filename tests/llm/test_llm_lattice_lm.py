"""Operator 12 against enumerated segmentations and plain counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tradeweave.llm import lattice_lm, textkernel
from tradeweave.llm.lattice_lm import MARK, PRIOR, Lattice, Vocabulary, lattice_scores, vocabulary
from tradeweave.llm.queries import tokenizer_path
from tradeweave.llm.textkernel import WordCounts, packed, span_strings, word_parts, words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = "piece_bpe_32k.model"


def small():
    pieces = [MARK, MARK + "a", "a", "b", "ab", "ba", "aba", MARK + "ab", "é"]
    weight = np.array([*range(1, len(pieces) + 1), *[0.01] * 256, 2.0])
    return Vocabulary(pieces, np.log(weight / weight.sum()))


def segmentations(vocab, text):
    """Every way through ``text``: (probability, pieces), bytes as their own numbers."""
    if not text:
        yield 1.0, []
        return
    p = np.exp(vocab.logs)
    options = [(len(x), p[i], [i]) for i, x in enumerate(vocab.pieces) if text.startswith(x)]
    spelled = [len(vocab.pieces) + b for b in text[0].encode()]
    for size, weight, what in [*options, (1, math.prod(p[i] for i in spelled), spelled)]:
        for rest, more in segmentations(vocab, text[size:]):
            yield weight * rest, what + more


@pytest.mark.parametrize("word", ["a", "ab", "ababa", "éa", "bxб", "aaaa"])
def test_forward_and_backward_cover_all_segmentations(monkeypatch, word):
    vocab = small()
    lattice = Lattice(vocab)
    every = list(segmentations(vocab, MARK + word))
    whole = sum(p for p, _ in every)
    assert lattice.log_probability(word) == pytest.approx(math.log(whole), rel=1e-12)
    want = np.zeros(len(vocab.logs))
    for p, pieces in every:
        for i in pieces:
            want[i] += 3 * p / whole
    for least in (0, 2):  # in plain numbers, and in log space
        monkeypatch.setattr(lattice_lm, "SMALL", least)
        lattice = Lattice(vocab)
        lattice.expect(word, 3)
        assert np.allclose(want, lattice.expected(), atol=1e-9)


def test_vocabulary_is_a_distribution_and_long_words_do_not_underflow():
    vocab = vocabulary(tokenizer_path(MODEL))
    assert np.exp(vocab.logs).sum() == pytest.approx(1)
    lattice = Lattice(vocab)
    assert -1e7 < lattice.log_probability("䷀" * 100_000) < -1e5
    assert lattice.log_probability("the") > lattice.log_probability("qzx")


def plain(rows, vocab, rounds):
    def tokens(text):
        return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())]

    crc = [None if d is None else zlib.crc32(str(d).encode()) % 7 for d, _ in rows]
    train = [tokens(t) for (_, t), x in zip(rows, crc) if x not in (None, 2)]
    counts = Counter(w for t in train for w in t)
    n, kinds = sum(counts.values()) + len(train), len(counts) + bool(train)
    for _ in range(rounds):
        lattice = Lattice(vocab)
        for w, c in counts.items():
            lattice.expect(w, c)
        found = np.exp(vocab.logs) * PRIOR + lattice.expected()
        found[-1] += len(train)
        vocab = Vocabulary(vocab.pieces, np.log(found / found.sum()))
    lattice = Lattice(vocab)
    out = []
    for (d, t), x in zip(rows, crc):
        w = tokens(t)
        base = sum(math.log10((counts[y] + 1) / (n + kinds + 1)) for y in w) + math.log10((len(train) + 1) / (n + kinds + 1))
        score = (sum(map(lattice.log_probability, w)) + vocab.logs[-1]) / math.log(10)
        out.append((d, x == 2, len(w) + 1, sum(counts[y] > 0 for y in w) + bool(train), n, base, score))
    return out


def same(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, word string, total long, rid long")
    got = lattice_scores(df, tokenizer_path(MODEL), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, **more).collect()
    want = plain(rows, vocabulary(tokenizer_path(MODEL)), more.get("rounds", 2))
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


ROWS = [(i, t) for i, t in enumerate(["The cat sat", "the dog\tsat THE", "", None, " \n ", "größe Größe ÄÖ", "the end </s> <s> ▁▁ ▁", "Ünï " * 50, "cat", "x" * 5000, "Это тест 漢字 🙂"] * 3)]
ROWS += [(4, "the cat sat"), (4, "the cat sat"), (None, "teaches nothing unheard"), (None, None)]


@pytest.mark.parametrize("head", [1 << 20, 6, 1])
def test_scores_of_nulls_repeats_and_rare_words(spark, monkeypatch, head):
    """A small HEAD sends all or nearly all words through the join."""
    monkeypatch.setattr(lattice_lm, "HEAD", head)
    same(spark, ROWS, rounds=1)


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    same(spark, [(i, "some words here") for i in held])


def test_empty_table(spark):
    assert lattice_scores(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(MODEL), F.lit(False)).collect() == []


def test_long_texts_come_in_pieces_of_whole_words():
    text = "ab é" * 1000 + " " + "y" * 3000 + " end"
    col = pa.array(["first", text, None, "last"])
    for size in (7, 64, 1 << 20):
        got = [(at + k, w) for at, some in word_parts(col, size) for v in [words_of(some)] for k in range(len(some)) for w in span_strings(v.buf, v.start, v.end).to_pylist()[v.first[k] : v.first[k + 1]]]
        want = [(k, w) for k, t in enumerate(col.to_pylist()) for w in (t or "").split()]
        assert got == want


def test_counts_are_handed_on_in_time():
    held = WordCounts(2, max_words=2)
    held.add(["a", "b", "a"], packed(np.array([1, 2, 3]), np.array([0, 1, 3])))
    assert held.full
    assert held.taken(["w", "x", "y"]).to_pylist() == [{"w": "a", "x": 4, "y": 3}, {"w": "b", "x": 2, "y": 1}]
    assert not held.full and held.taken(["w", "x", "y"]).num_rows == 0
