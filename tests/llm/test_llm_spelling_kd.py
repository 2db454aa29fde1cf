"""Operator 13 against plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tradeweave.llm import spelling_kd as kd
from tradeweave.llm.spelling_kd import Cell, KdTree, codes_of, letter_counts, run_checksums, spelling_variants
from tradeweave.llm.textkernel import latin_runs_of, span_strings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    form, out = {}, {}
    for w in n:
        others = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form[w] = others[0] if others and n[others[0]] >= 5 * n[w] else None
        out[w] = len(others)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def told(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 3, 4) for r in rows], "doc_id long, text string, word string, n long, size int")
    got = [tuple(r) for r in spelling_variants(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, letters="abeé", words=260, size=(6, 9)):
    rng = random.Random(seed)
    vocab = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(*size))) for _ in range(words)})
    weight = [rng.choice([6, 6, 7, 31, 40, 200, 1100]) for _ in vocab]
    tokens = [w if rng.random() < 0.9 else w.upper() for w, k in zip(vocab, weight) for _ in range(k)]
    tokens += ["zzzzzzz"] * 500 + ["zzzzzzx"] * 60 + ["zzzzzyx"] * 7  # a chain of forms
    rng.shuffle(tokens)
    return [(i, " ".join(tokens[a : a + 40])) for i, a in enumerate(range(0, len(tokens), 40))]


@pytest.mark.parametrize("cell", [4096, 8])
def test_variants_equal_all_pairs(spark, monkeypatch, cell):
    """With small cells most searches cross the borders of the trees' tops."""
    monkeypatch.setattr(kd, "CELL", cell)
    monkeypatch.setattr(kd, "LEAF", 4)
    monkeypatch.setattr(kd, "BLOCK", 16)
    rows = corpus(1)
    want = plain(rows)
    assert told(spark, rows) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1])


def test_nulls_ties_repeats_and_odd_letters(spark):
    rows = [(1, "Straße straßen STRASSE ÀÉÎÕÜ×÷ÿ ßßßßßß abcdeſ") for _ in range(6)]
    rows += [(None, "Straße straßen nobody's strasse kept")] * 30 + [(2, None), (3, ""), (4, "a" * 70 + " " + "a" * 71 + "\t" + "a" * 69 + "b")] * 5
    rows += [(5, "colour color colors cölour"), (5, "colour color colors")] * 8
    assert told(spark, rows) == plain(rows)


def test_deleted_code_points(spark):
    word = next(w for w in (f"deleted{c}{a}{b}" for c in "xyz" for a in "abcdefghijklm" for b in "abcdefghijklmnopqrstuvwxyz") if zlib.crc32(f"7:{w}".encode()) % 199 == 0)
    rows = [(7, word.upper())] * 5 + [(8, f"{word} {word}")] * 20
    got = told(spark, rows)
    assert got == plain(rows) and len(got) == 2 and any(r[1] == word for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "12 34 !! short")]])
def test_nothing_to_group(spark, rows):
    assert told(spark, rows) == set()


def test_long_words_and_long_texts(spark):
    long = "ab" * 20_000
    rows = [(i, f"{long}a {long} " + "letters " * 50_000) for i in (1, 2, 3, 4, 6)]
    assert {(w[:10], len(w), n) for w, _, _, n, _, _ in told(spark, rows)} == {(w[:10], len(w), n) for w, _, _, n, _, _ in plain(rows)}


def test_tree_finds_all_vectors_in_reach():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 4, (500, 5)).astype(np.int32)
    queries = rng.integers(0, 4, (60, 5)).astype(np.int32)
    for tree in (KdTree(points, 6), KdTree(points, 6, tight=False)):
        for add, take in ((1, 1), (1, 0)):
            i, leaf = tree.leaves(queries, add, take)
            found = {(a, int(p)) for a, b in zip(i.tolist(), leaf.tolist()) for p in tree.order[tree.first[b] : tree.last[b]]}
            more = points[None] - queries[:, None]
            want = {tuple(x) for x in np.argwhere((np.maximum(more, 0).sum(2) <= add) & (np.maximum(-more, 0).sum(2) <= take)).tolist()}
            assert want <= found and len(found) < 500 * 60
    assert (KdTree(points, 6).leaf_of(points)[KdTree(points, 6).order[:3]] >= 0).all()


def test_anagrams_are_not_near():
    cell = Cell(["listen", "silent", "tinsel", "listed"], [9, 8, 7, 6])
    i, j = cell.near(codes_of(["listen"]))
    assert [cell.words[k] for k in j] == ["listed"]
    i, j = cell.near(codes_of(["liste"]))
    assert {cell.words[k] for k in j} == {"listen", "listed"}
    assert letter_counts(codes_of(["ßa", "aa"])).sum(1).tolist() == [2, 2]


def test_checksums_and_runs():
    col = pa.array(["Abc, ÀÿZ—ſx ×" + "q" * 200, None, "é"])
    w = latin_runs_of(col)
    runs = span_strings(w.buf, w.start, w.end).to_pylist()
    assert runs == ["abc", "Àÿz", "x", "×" + "q" * 200, "é"]
    before = np.array([zlib.crc32(b"12:")] * len(runs), np.uint32)
    assert run_checksums(w.buf, w.start, w.end, before).tolist() == [zlib.crc32(f"12:{r}".encode()) for r in runs]
