"""Quoted CSV cells over many splits, against the csv module."""

from __future__ import annotations

import csv
import gzip
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from tradeweave.operators.clean import clean_flows
from tradeweave.sources import files as FS
from tradeweave.sources.landing import land_incremental, landed_rows
from tradeweave.sources.records import quote_states
from tradeweave.streaming.landing_stream import start_landing_stream

HEADER = "refYear,reporterCode,reporterISO,partnerCode,partnerISO,cmdCode,cmdDesc,flowCode,primaryValue,netWgt,qty,qtyUnitAbbr"


@pytest.fixture()
def splits(spark):
    """Splits of a few dozen bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with (gzip.open(path, "wt", newline="") if path.endswith(".gz") else open(path, "w", newline="")) as fh:
        fh.write(text)


def parsed(text):
    return [[c or None for c in r] for r in csv.reader(io.StringIO(text)) if any(x.strip() for x in r)]


def random_file(rng, n):
    cells = ["plain", "", "with, comma", 'say ""x""', "two\nlines", "\n", 'end\\', '""', "a\n\n,b\n", "5' 6", "x" * 300, '"", ""\n""']
    line = lambda: ",".join([str(rng.randint(1, 9)), *(f'"{c}"' if ("," in c or '"' in c or "\n" in c or rng.random() < 0.3) else c for c in rng.choices(cells, k=3))])
    return "a,b,c,d\n" + "".join(line() + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_over_many_splits(spark, scratch, splits, seed):
    rng = random.Random(seed)
    texts = [random_file(rng, n) for n in (40, 1, 0, 25)] + ["a,b,c,d\n1,2,3,4\n5,6,7,8\n" * 9, "﻿" + '"a",b,c,d\n9,"q\nr",,\n']
    for i, t in enumerate(texts):
        put(f"{scratch}/in/f{i}.csv" + ".gz" * (i == 3), t)
    got = FS.read_raw(spark, f"{scratch}/in")
    assert got.rdd.getNumPartitions() > 5
    rows = [[r[c] for c in "abcd"] for r in got.orderBy(*FS.INGEST_ORDER).collect()]
    want = [r for t in texts for r in parsed(t.lstrip("﻿")) if r != ["a", "b", "c", "d"]]
    assert sorted(rows, key=str) == sorted(want, key=str)
    one = [[r[c] for c in "abcd"] for r in got.where(F.col("_ing_file").endswith("f0.csv")).orderBy(*FS.INGEST_ORDER).collect()]
    assert one == parsed(texts[0])[1:]  # and in the file's order


def test_states_of_lines(spark):
    lines = {'a,"b': (1, 0), 'a,b': (0, 1), '"a",b': (0, 0), 'x",y': (0, 0), '"': (1, 0), '""': (0, 1), '"""': (1, 0), 'a,5" b,c': (0, 0), 'x","y': (1, 1), '","': (0, 1), "": (0, 1), ',"",': (0, 1), 'z" tail,"': (1, 1)}
    out, inside = quote_states(F.col("v"))
    got = spark.createDataFrame([(k,) for k in lines], "v string").select("v", out, inside).collect()
    assert {r[0]: (int(r[1]), int(r[2])) for r in got} == lines


def test_rows_of_the_clean_come_through(spark, scratch):
    rows = ['2020,376,ISR,156,CHN,84,"Wine, ""fine"", bottled",M,1000,,,', '2020,376,ISR,156,CHN,85,"two\nlines",M,2000,,,', '2020,376,ISR,156,CHN,86,"back\\",M,3000,,,', "2020,376,ISR,156,CHN,87,plain,M,4000,,,"]
    put(f"{scratch}/in/a.csv", "\n".join([HEADER, *rows]) + "\n")
    got = clean_flows(FS.read_raw(spark, f"{scratch}/in"), FS.INGEST_ORDER).collect()
    assert sorted((r["hs_code"], r["trade_value_usd"]) for r in got) == [("84", 1000.0), ("85", 2000.0), ("86", 3000.0), ("87", 4000.0)]
    land_incremental(spark, f"{scratch}/in", f"{scratch}/out")
    assert {r["cmdDesc"] for r in landed_rows(spark, f"{scratch}/out").collect()} == {'Wine, "fine", bottled', "two\nlines", "back\\", "plain"}


def test_bad_files_raise(spark, scratch, splits):
    put(f"{scratch}/open/a.csv", "a,b\n1,2\n" * 20 + '3,"never closed\n' + "4,5\n" * 40)
    with pytest.raises(ValueError, match="ends inside a quoted cell"):
        FS.read_raw(spark, f"{scratch}/open")
    put(f"{scratch}/wide/a.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more cells than its header"):
        FS.read_raw(spark, f"{scratch}/wide").collect()


def test_stream_reads_what_the_batch_reads(spark, scratch):
    put(f"{scratch}/in/y2020.csv.gz", HEADER + '\n2020,376,ISR,156,CHN,84,"a\nb",M,10,,,\n')
    put(f"{scratch}/in/deep/y2021.csv", HEADER + "\n2021,376,ISR,156,CHN,84,d,M,20,,,\n")
    start_landing_stream(spark, f"{scratch}/in", f"{scratch}/table", f"{scratch}/ckpt").awaitTermination()
    assert sorted(r["trade_value_usd"] for r in spark.read.parquet(f"{scratch}/table").collect()) == [10.0, 20.0]
