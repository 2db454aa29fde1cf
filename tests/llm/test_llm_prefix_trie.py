"""Operator 11 against tries of rebuilt texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tradeweave.llm import prefix_trie as trie
from tradeweave.llm.prefix_trie import PRIME, inverse, prefix_trie, product, turn_map

SCHEMA = "conv_id long, turn long, role string, text string, conv string, depth int"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            text = text or ""
            own[c].append(((turn is not None, turn or 0, role or "", hashlib.sha256(text.encode()).hexdigest()), (role or "", text)))
    own = {c: [x for _, x in sorted(t, key=lambda y: y[0])] for c, t in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = {}
    for node, who in members.items():
        below = [x for x in members if x[: len(node)] == node]
        childless = [x for x in below if not any(y[:-1] == x for y in members if y)]
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        out[(min(who), len(node))] = (
            min(members[node[:-1]]) if node else None, len(who), sum(1 for x in members if x and x[:-1] == node), len(childless),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest())
    return out


def told(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    got = prefix_trie(df, base=lambda c: c - c % 100, head=lambda c: F.crc32(c.cast("string")) % 6).collect()
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got}
    assert len(found) == len(got)
    return found


def mixed():
    rng = random.Random(5)
    texts = ["hello", "how are you", "größe ü", "", None, "x" * 40]
    rows = []
    for c in [*range(0, 24), *range(100, 116), 305, 306, -7, -203]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, t, ["user", "assistant"][t % 2], rng.choice(texts)))
    rows += [(3, None, "system", "first"), (3, None, None, "first"), (3, 2, "user", "tie"), (3, 2, "user", "other"), (3, 2, "user", "tie"), (None, 1, "user", "nobody")]
    rows += [(c, t, "user", "same") for c in (101, 102, 103) for t in range(20, 24)]
    rng.shuffle(rows)
    return rows


def test_products_are_a_group():
    a, b, c = (turn_map(x, 0) for x in (b"a", b"b", b"c"))
    assert product(product(a, b), c) == product(a, product(b, c)) != product(product(b, a), c)
    assert product(a, inverse(a)) == (1, 0) == product(inverse(a), a)
    assert turn_map(b"a", 0) != turn_map(b"a", 1) and 0 < a[0] < PRIME


def test_trie_of_nulls_ties_repeats_and_absent_bases(spark):
    rows = mixed()
    assert told(spark, rows) == plain(rows)


def test_conversation_over_many_partitions_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 4)
    rows = [(200, t, "user", f"turn {t}") for t in range(400)] + [(c, 0, "user", "turn 0") for c in range(201, 260)] + [(c, 1, "user", "last") for c in range(201, 230)]
    assert told(spark, rows) == plain(rows)


def test_seed_that_confuses_prefixes_is_left(spark, monkeypatch):
    """Under seed 0 all turns get the identity: nodes fail their verification, seed 1 decides."""
    real, seen = trie._running, []

    def confused(turns, seed):
        seen.append(seed)
        run = real(turns, seed)
        return run if seed else run.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(1).cast("long")) for c in ("m", "em")} | {c: F.when(F.col(c).isNotNull(), F.lit(0).cast("long")) for c in ("a", "ea")})

    monkeypatch.setattr(trie, "_running", confused)
    rows = mixed()
    assert told(spark, rows) == plain(rows)
    assert seen == [0, 1]


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversation_gives_no_node(spark, rows):
    assert told(spark, rows) == {}


def test_long_text_counts_code_points(spark):
    rows = [(c, 0, "user", "é" * 2_000_000) for c in (100, 500)] + [(c, 1, "user", "a") for c in (100, 500)]
    got = told(spark, rows)
    assert got == plain(rows)
