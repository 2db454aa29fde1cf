"""Operators 1 to 3 against plain recomputation on small, awkward tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tradeweave.llm.bpe import IdEncoder, stable_cut
from tradeweave.llm.packing import fill_window, pack, plan_windows
from tradeweave.llm.queries import QUERIES
from tradeweave.llm.sharding import sampled_splitters
from tradeweave.llm.token_counts import first_stable, splice_counts, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, shard string"
AWKWARD = [
    (1, "one two three", 1, "x"), (2, None, None, None), (3, "", 2, "y"), (None, "no id", 3, None), (4, "one two three", 1, "x"),
    (4, "one two three", 1, "x"), (5, "word " * 3000, 0, ""), (6, "x" * 9000, 0, ""), (7, "<|endoftext|> a<|endoftext|>", 5, "z"),
    (8, " \n\t  ", 5, "z"), (9, "é à ü ß 日本　語     ok", 5, "z"), (10, "a\n\n\nb  c   d\r\ne", 1, "q"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_librarys(spark, library):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t for _, t, _, _ in AWKWARD]
    for text, ids in zip(texts, IdEncoder.shared(BPE).encode(pa.array(texts, pa.string()))):
        assert ids.tolist() == ids_of(library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\ta é'.1日x　<|endoftext|>", max_size=80))
def test_stable_cuts_may_be_encoded_apart(text):
    library = Tokenizer.from_file(BPE) if not hasattr(test_stable_cuts_may_be_encoded_apart, "lib") else test_stable_cuts_may_be_encoded_apart.lib
    test_stable_cuts_may_be_encoded_apart.lib = library
    raw = text.encode()
    at = [0, *np.flatnonzero(stable_cut(np.frombuffer(raw, np.uint8))).tolist(), len(raw)]
    joined = [i for a, b in zip(at, at[1:]) for i in ids_of(library, raw[a:b].decode())]
    assert joined == ids_of(library, text)


def test_splices():
    assert first_stable(b"ab", b"cd ef", False) == 2
    assert first_stable(b"ab", b"cdef", False) is None
    assert first_stable(b"ab", b"cdef", True) == 4
    assert first_stable(b"ab", b"", True) == 0
    assert splice_counts(np.array([2, 3, 1]), 2, 6) == (2, True)
    assert splice_counts(np.array([2, 3, 1]), 1, 6) == (0, False)
    assert splice_counts(np.array([2]), None, 2) == (0, False)


@pytest.mark.parametrize("chunk,overlap", [(32_768, 256), (64, 8), (7, 2)])
def test_token_counts(awkward, library, chunk, overlap):
    docs = awkward.filter("n != 0 or n is null") if chunk == 7 else awkward
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, BPE, chunk=chunk, overlap=overlap).collect())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(ids_of(library, r["text"]))) for r in docs.collect())
    assert got == want


def test_token_counts_of_a_long_text(spark, library):
    """20 MB in one row, cut in one pass; and no stable cut for long stretches."""
    line = "A line, with 12 numbers and ünïcödé words like 漢字; it's repeated.\n"
    texts = [line * (20_000_000 // len(line.encode())), "x" * 40_000 + "é" * 30_000 + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, BPE).collect()}
    assert got == {i: (len(t.encode()), len(ids_of(library, t))) for i, t in enumerate(texts)}


def test_token_counts_of_no_rows(awkward):
    assert token_counts(awkward.limit(0), BPE).count() == 0


def test_fill_is_the_best_one():
    rng = random.Random(3)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 30), rng.randint(0, 4)), reverse=True)
        counts = [rng.randint(0, 3) for _ in lengths]
        capacity = rng.randint(0, 40)
        used = fill_window(lengths, counts, capacity)
        total = sum(lengths[i] * n for i, n in used.items())
        best = max(s for s in (sum(a * b for a, b in zip(lengths, c)) for c in product(*(range(n + 1) for n in counts))) if s <= capacity)
        assert total == best and all(n <= counts[i] for i, n in used.items())


def test_plan_uses_every_length_once():
    rng = random.Random(4)
    histogram = {rng.randint(1, 99): rng.randint(1, 500) for _ in range(40)}
    used = Counter()
    for repeats, fill in plan_windows(histogram, 100):
        assert sum(a * n for a, n in fill) <= 100
        for a, n in fill:
            used[a] += n * repeats
    assert used == Counter(histogram)


def check_pieces(rows, docs, library, window):
    """Every id in one piece, checksums, gapless sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    left = Counter()
    for doc_id, text in docs:
        own = [*ids_of(library, text), 1]
        for a in range(0, len(own), window):
            part = own[a : a + window]
            left[doc_id, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(own)] += 1
    assert left == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    return len(sequences)


def test_packing(awkward, library):
    rows = pack(awkward, BPE, window=64).collect()
    check_pieces(rows, [(r[0], r[1]) for r in AWKWARD], library, 64)
    by = {(r["doc_id"], r["start"]): r["ids"] for r in rows if r["doc_id"] == 5}
    assert [i for _, ids in sorted(by.items()) for i in ids] == [*ids_of(library, AWKWARD[6][1]), 1]
    assert pack(awkward.limit(0), BPE).count() == 0


def test_packing_query_pads_little(spark, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op3_packing"](spark, SF).collect()
    n = check_pieces(rows, docs, library, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 2


def check_shards(rows, n_shards):
    total = sum(r["size"] for r in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert all(abs(sizes[s] - total / n_shards) <= largest for s in range(n_shards))


def test_sharding_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_sampled_splitters"](spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
    check_shards(rows, 8)
    # equal texts lie together: a checksum is in neighbouring shards only
    shards = defaultdict(set)
    for r in rows:
        shards[r["text_crc32"]].add(r["shard"])
    assert all(max(s) - min(s) == len(s) - 1 for s in shards.values())


def test_sharding_of_a_hot_key(spark):
    """A third of all rows share a key, so their range is overfull and cut again."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id") * 1000).alias("k"), F.col("id").alias("t"), (F.col("id") % 50 + 1).alias("size"), F.lit("a").alias("range"))
    got = sampled_splitters(rows, "k", "t", "size", n_shards=5, range_bytes=100)
    assert got.columns == ["k", "t", "size", "range", "shard", "slot"]
    check_shards(got.collect(), 5)


def test_sharding_awkward(awkward):
    sized = awkward.select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("k"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"))
    rows = sampled_splitters(sized, "k", "doc_id", "size", n_shards=3).collect()
    assert len(rows) == len(AWKWARD)
    check_shards(rows, 3)
    assert sampled_splitters(sized.limit(0), "k", "doc_id", "size").count() == 0
