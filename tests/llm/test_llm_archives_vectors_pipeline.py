"""Operators 8 and 9 and the pipeline against plain recomputation."""

from __future__ import annotations

import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradeweave.llm import ann, warc_zip
from tradeweave.llm.ann import bounds, encode, one_bit_search, rotation
from tradeweave.llm.queries import QUERIES
from tradeweave.llm.warc_zip import DATA, INDEX, parse_record, round_trip, read_records, warc_record, with_record_types, write_archives
from tradeweave.llm.zip_ranges import data_start, members

SF = "/root/testdata/sf0.001"


# archives -------------------------------------------------------------------


def plain_records(pages):
    first = {}
    for i, _, html in pages:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        original = first.get(raw, i) if i is not None else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if original == i else "revisit", None if original == i else original))
    return Counter(out)


@pytest.mark.parametrize("hot", [1000, 1])
def test_round_trip(spark, monkeypatch, hot):
    """With 1 no digest, with 1000 every one goes to all tasks."""
    monkeypatch.setattr(warc_zip, "HOT", hot)
    same, long = "<p>" + "same text " * 20 + "</p>", "é😀" * 300_000
    pages = [(i, f"http://x/{i}", same) for i in range(40, 10, -1)] + [
        (1, None, None), (2, "http://a b\r\nX: y", ""), (3, "u", "short"), (4, "u", "short"), (5, "u", long), (6, None, long), (None, "n", same), (50, "d", same), (50, "d", same),
        (7, "c", "line\r\n\r\nWARC/1.1\r\n\r\n" * 10), (11, "again", same),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, key string")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in round_trip(spark, df).collect())
    assert got == plain_records(pages)
    assert round_trip(spark, df.limit(0)).count() == 0


def test_many_small_archives_and_ranges(spark, scratch):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html"))
    manifest = write_archives(with_record_types(pages), f"file://{scratch}/w", archive_bytes=2000)
    assert manifest.count() > 10 and manifest.agg(F.sum("records")).first()[0] == 300
    got = {r["record_key"]: bytes(r["payload"]).decode() for r in read_records(manifest, f"file://{scratch}/w").collect()}
    assert got == {str(i): str(i) * 50 for i in range(300)}
    # any ZIP reader opens them, and the index points at whole gzip members
    with zipfile.ZipFile(manifest.first()["path"]) as z:
        assert z.namelist() == [DATA, INDEX] and z.testzip() is None


def test_record_round_trip():
    raw = warc_record(7, "http://x/ü", b"pay\r\n\r\nload", "d" * 64, 10, "response", None)
    fields, payload, http = parse_record(raw)
    assert payload == b"pay\r\n\r\nload" and fields["x-record-key"] == "7" and http["content-length"] == "10"


def zip64_archive(data: bytes, name: str = "archive/big") -> bytes:
    """A stored member whose sizes and offsets are only in ZIP64 fields, behind other bytes and before a comment."""
    out = io.BytesIO(b"junk" * 5)
    out.seek(0, 2)
    header = out.tell()
    n, crc = name.encode(), zlib.crc32(data)
    out.write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(n), 20) + n + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data)
    start = out.tell()
    extra = struct.pack("<HHH", 9, 2, 5) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), header)
    out.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + n + extra)
    size, end64 = out.tell() - start, out.tell()
    out.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, size, start))
    out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end64, 1))
    out.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 9) + b"a comment")
    return out.getvalue()


def test_zip64_directory():
    raw = zip64_archive(b"payload bytes")
    file = io.BytesIO(raw)
    (m,) = members(file, len(raw))
    at = data_start(file, m)
    assert raw[at : at + m.size] == b"payload bytes" and m.crc32 == zlib.crc32(b"payload bytes")


def test_zip_errors_and_plain_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"1" * 50)
        z.writestr("b", b"2" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 is no end record here"
    raw = out.getvalue()
    a, b = members(io.BytesIO(raw), len(raw))
    at = data_start(io.BytesIO(raw), a)
    assert raw[at : at + a.size] == b"1" * 50
    with pytest.raises(ValueError):
        data_start(io.BytesIO(raw), b)
    for broken in (b"", b"x" * 100, raw[:-40]):
        with pytest.raises(ValueError):
            members(io.BytesIO(broken), len(broken))


# vectors --------------------------------------------------------------------


def plain_nearest(rows, k):
    out = {}
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, u in {i: v for i, v in ok if i is not None and i % 100 == 0}.items():
        out[q] = sorted((float(np.sqrt(((u - v) ** 2).sum())), i) for i, v in ok if i != q and i is not None)[:k]
    return out


def test_search_is_exact_with_all_clusters(spark, monkeypatch):
    """Small blocks: several of rows and of queries; every vector's bounds hold, so nothing is missed."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 1, 16))]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [float("inf")] + [1.0] * 15), (2400, [None] + [1.0] * 15), (2500, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "r") for i, v in rows], "vec_id long, embedding array<float>, cluster int, rank string")
    got = defaultdict(list)
    for r in one_bit_search(df, df.filter("vec_id % 100 = 0"), probe_share=1.0).orderBy("rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = plain_nearest([r for r in rows if r[0] < 2000], 10)
    assert sorted(got) == sorted(want)
    for q, near in want.items():
        assert [i for _, i in got[q]] == [i for _, i in near]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in near], atol=1e-12)


def test_recall_and_few_rows(spark):
    rows = QUERIES["op9_one_bit_search"](spark, "/root/testdata/sf0.1").collect()
    source = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = plain_nearest(source, 10)
    got = defaultdict(set)
    for r in rows:
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len({i for _, i in near} & got[q]) for q, near in want.items()) >= 0.9 * sum(map(len, want.values()))
    few = spark.createDataFrame([(100 * i, [float(i + 1), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert Counter(r["query_id"] for r in one_bit_search(few, few).collect()) == {0: 3, 100: 3, 200: 3, 300: 3}
    assert one_bit_search(few.limit(0), few).count() == 0
    assert one_bit_search(few, few.limit(0)).count() == 0


def test_every_query_gets_k_rows(spark, monkeypatch):
    """The first step's bound is that of a row itself: it must not lose it to the last bits of a distance."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(3000, 24)).astype(np.float32).astype(float).tolist()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = one_bit_search(rows, rows.filter("vec_id % 4 = 0")).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert len(got) == 750 and {(r["n"], r["last"]) for r in got} == {(10, 10)}


def test_bounds_hold():
    rng = np.random.default_rng(4)
    vectors, queries, centre, turn = rng.normal(0, 1, (500, 64)), rng.normal(0, 1, (40, 64)), rng.normal(0, 0.1, 64), rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes, length, dot = encode(vectors, centre, turn)
    low, high = bounds(codes, length, dot, queries, centre, turn)
    squares = ((queries[:, None] - vectors[None]) ** 2).sum(2)
    assert ((low <= squares) & (squares <= high)).mean() > 0.98
    assert (high - low).mean() < 2 * squares.mean()


# pipeline -------------------------------------------------------------------


def test_stages(spark, monkeypatch):
    """Every stage on all its predecessor kept, against a plain version of what it decides."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "jaccard_join", "secret_scan", "packing"]
    rng = random.Random(3)
    english = ["the", "and", "of", "that", "this", "with", "from", "are", "was", "tion", "andre", "heing", "erst", "ouen", "blees"]

    def sentence(n):
        return " ".join(rng.choice(english) + rng.choice(["", "in", "er", "the"]) for _ in range(n)).capitalize() + "."

    base = [sentence(60) + "\n" + sentence(60) for _ in range(12)]
    near = base[0][:-6] + "changed."
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(i, t, "en", "s", len(t), "a") for i, t in enumerate(base)]
    rows += [(20, base[1], "en", "s", 0, None), (21, near, "en", "s", 0, None), (21, near, "en", "s", 0, None), (22, None, None, None, None, None), (23, "123 456", "en", "s", 7, "z"),
             (24, "\n".join(["Home | News | About | Help | More | Up"] * 9), "en", "s", 0, "z"), (25, base[3] + f'\ntoken = "{key}" is what {sentence(30)}', None, "s", 0, "z"),
             (None, sentence(80), "en", None, None, None), (26, "too short.", "en", "s", 0, "z"),
             (27, "".join(rng.choices("bcdfghjklmnpqrstvwxz ", k=600)) + ".", None, "s", 0, "z"), (28, "Это обычный текст на языке, которого модель не видела. " * 6, None, "s", 0, "z")]
    more = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id >= 100").withColumn("row", F.lit("b"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").unionByName(more)
    columns, state = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, state, SF), name)
        if name != "packing":
            assert out.columns == columns
            kept[name] = [r.asDict() for r in out.collect()]
        state = out
    ids = {name: {r["doc_id"] for r in got} for name, got in kept.items()}
    assert not ids["language_id"] & {22, 23, 27, 28} and set(range(12)) <= ids["language_id"]
    assert {r["lang"] for r in kept["language_id"] if r["doc_id"] == 25} == {"en"}
    assert not ids["quality_rules"] & {24, 26} and set(range(12)) <= ids["quality_rules"] and None in ids["quality_rules"]
    assert all(r["n_chars"] == len(r["text"]) for name in list(kept)[1:] for r in kept[name])

    # near duplicates by all pairs
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}

    before = kept["quality_rules"]
    sets = [shingles(r["text"]) for r in before]
    root = list(range(len(before)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(before)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, r in enumerate(before):
        groups[top(i)].append(-1 if r["doc_id"] is None else r["doc_id"])
    assert sorted(min(g) for g in groups.values()) == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept["jaccard_join"])
    assert not ids["jaccard_join"] & {20, 21}

    after = {r["doc_id"]: r["text"] for r in kept["secret_scan"]}
    assert key not in after[25] and "<SECRET>" in after[25]
    assert len(after) == len(kept["jaccard_join"])
    pieces = state.collect()
    assert {r["doc_id"] for r in pieces} == set(after)
    total = sum(r["length"] for r in pieces)
    assert len({r["sequence_id"] for r in pieces}) <= -(-total // 2048) + 2


def test_run_gives_the_stages_rows(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
