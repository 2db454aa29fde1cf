"""Operator 4 against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tradeweave.llm import jaccard_tree
from tradeweave.llm.components import components
from tradeweave.llm.jaccard_tree import Tree, bands_for, dual_traversal, jaccard_components, overlap_size, prefix_keys, shared_counts, shingle_sets

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def plain_components(ids, texts, size, percent):
    sets = plain_sets(texts, size)
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, x in enumerate(ids):
        least.setdefault(root(i), []).append(x)
    return [(x, len(s), min((y for y in least[root(i)] if y is not None), default=None) if s else x) for i, (x, s) in enumerate(zip(ids, sets))]


def words(rng, n):
    return [rng.choice(["alpha", "Beta", "gamma", "d", "É", "x1"]) + str(rng.randint(0, 500)) for _ in range(n)]


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size,percent,block,exact", [(3, 90, 128, False), (5, 80, 128, False), (3, 90, 8, False), (5, 80, 8, False), (3, 90, 128, True), (5, 80, 8, True)])
def test_components_match_brute_force(spark, monkeypatch, size, percent, block, exact):
    """With small blocks the large groups go through chunks, pivots and the second round."""
    monkeypatch.setattr(jaccard_tree, "BLOCK", block)
    monkeypatch.setattr(jaccard_tree, "DEAL", 4 * block)
    monkeypatch.setattr(jaccard_tree, "CHUNK_BYTES", 1 << 13)
    rng = random.Random(size * percent + block)
    texts = [None, "", "  \n ", "one", "One", "two words", "a b c", "A B C"]
    passage = words(rng, 60)
    for k in (1, 2, 4):
        texts += near_copies(rng, words(rng, 150), 30, k)
    texts += [" ".join(words(rng, 30) + passage + words(rng, 40)) for _ in range(30)]
    chain = words(rng, 120)
    for i in range(12):  # neighbours link, ends do not
        chain = list(chain)
        chain[i * 9] = f"turn{i}"
        texts.append(" ".join(chain))
    texts += [texts[20]] * 5 + [" ".join(words(rng, 3000))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    ids = [3 * i for i in range(len(texts))]
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in zip(ids, texts)], "doc_id long, text string, node string, n int")
    got = jaccard_components(docs, size=size, percent=percent, exact=exact).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(ids, texts, size, percent))
    assert sum(r["first"] for r in got) == len({r["component_id"] for r in got})


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text.upper()), (None, None), (None, "alone here now")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, size=3, percent=90).collect()), key=str)
    assert got == sorted([(5, 7, 5), (5, 7, 5), (-1, 7, 5), (7, 7, 5), (-1, 0, None), (-1, 1, None)], key=str)
    assert jaccard_components(docs.limit(0)).count() == 0


def pairs(a, b):
    return {(x, y) for i, j in dual_traversal(a, b, 90) for x, y in zip(i.tolist(), j.tolist())}


@pytest.mark.parametrize("frontier", [1 << 14, 50])
def test_traversal_keeps_every_linked_pair(monkeypatch, frontier):
    monkeypatch.setattr(jaccard_tree, "FRONTIER", frontier)
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = []
    for _ in range(70):
        s = base[rng.random(len(base)) < rng.choice([0.5, 0.97])]
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 63, rng.integers(0, 15)).astype(np.uint64)])))
    tree = Tree(sets, np.arange(len(sets)), 1024)
    kept = pairs(tree, tree)
    other = Tree(sets[:20], np.arange(100, 120), 1024)
    crossed = pairs(tree, other)
    linked = {(i, j) for j in range(70) for i in range(70) if 190 * overlap_size(sets[i], sets[j]) >= 90 * (len(sets[i]) + len(sets[j]))}
    assert {(i, j) for i, j in linked if i < j} <= kept
    assert {(i, j) for i, j in linked if j < 20} <= crossed
    assert len(kept) < 70 * 69 / 2 * 0.7  # and prunes


def test_shingles_and_bands():
    texts = ["A b  c\nd", "a b", "", None, "a b c a b c", "é É", "x y z w"]
    assert [len(s) for s in shingle_sets(pa.array(texts), 3)] == [len(s) for s in plain_sets(texts, 3)]
    a, b = shingle_sets(pa.array(["a b c", "A  B\tC"]), 3)
    assert a.tolist() == b.tolist()
    assert (1 - 0.9**3) ** bands_for(90) <= 1e-12 and (1 - 0.8**3) ** bands_for(80) <= 1e-12


@pytest.mark.parametrize("chunk_bytes", [400, 5000, 16 << 20])
def test_shared_counts(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(jaccard_tree, "CHUNK_BYTES", chunk_bytes)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(rng.integers(0, 1 << 64, 300, dtype=np.uint64) if k % 3 else np.arange(200, dtype=np.uint64) << np.uint64(55), rng.integers(1, 40))) for k in range(60)]
    got = shared_counts(spark.createDataFrame([(bytes([k]), s.tobytes()) for k, s in enumerate(sets)], "node binary, members binary")).collect()
    want = {bytes([k]): sum(any(x in o for j, o in enumerate(map(set, (t.tolist() for t in sets))) if j != k) for x in s.tolist()) for k, s in enumerate(sets)}
    assert {bytes(r["node"]): r["common"] for r in got} == want
    assert shared_counts(spark.createDataFrame([], "node binary, members binary")).collect() == []


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_linked_sets_share_a_prefix_key(percent):
    rng = random.Random(percent)
    for _ in range(400):
        a = set(rng.sample(range(10_000), rng.randint(1, 60)))
        b = set(rng.sample(sorted(a), max(1, len(a) - rng.randint(0, 8)))) | set(rng.sample(range(10_000), rng.randint(0, 6)))
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = (prefix_keys(np.array(sorted(z), np.uint64), percent) for z in (a, b))
            assert set(x.tolist()) & set(y.tolist())


def test_connected_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, 201), (201, 200), (300, 300)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: m for n, m in label.items() if n != m}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_of_components_plans_its_links_a_few_times(spark, monkeypatch):
    from tradeweave.llm import components as module

    scans, kept = [], module.staged

    def counted(df, name):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return kept(df, name)

    monkeypatch.setattr(module, "staged", counted)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7), (4, 5), (5, 1), (1, 2)], "a int, b int")
    assert sorted(map(tuple, module.components(links).collect())) == [(2, 1), (3, 1), (4, 1), (5, 1), (9, 8)]
    assert len(scans) > 2 and max(scans[1:]) <= 4, scans
