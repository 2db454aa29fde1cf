"""Incremental load against a full reload."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tradeweave.operators import clean as C
from tradeweave.operators import star as S
from tradeweave.plans import incremental
from tradeweave.plans.cube import trade_cube
from tradeweave.plans.incremental import cube_of, fact_of, load_increment
from tradeweave.sources.files import INGEST_ORDER, read_raw

HEADER = "refYear,reporterCode,reporterISO,partnerCode,partnerISO,cmdCode,cmdDesc,flowCode,primaryValue,netWgt,qty,qtyUnitAbbr"


def put(root, name, rows):
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/{name}", "w") as fh:
        fh.write("\n".join([HEADER, *rows]) + "\n")


def line(rng, year, value=None):
    partner = rng.choice(["156,CHN", "842,USA", "0,WLD", "999,", "842,"])
    return f"{year},376,ISR,{partner},{rng.choice(['84', '7', 'TOTAL', '85', 'X1'])},d,{rng.choice('MXQ')},{value if value is not None else rng.choice(['10', '20.0', '-5', 'n/a', '300'])},5,,kg"


@pytest.fixture()
def dims(spark):
    countries = spark.createDataFrame([("CHN", "China", 156), ("ISR", "Israel", 376), ("USA", "United States", 842)], "iso3 string, name string, un_numeric int")
    chapters = spark.createDataFrame([("07", "Vegetables", 2, "S2"), ("84", "Machinery", 16, "S16"), ("85", "Electrical", 16, "S16")], "chapter_code string, chapter_name string, section_num int, section_name string")
    return S.build_dim_country(countries), S.build_dim_commodity(chapters)


def same_as_reload(spark, landing, out, dims):
    clean = C.clean_flows(read_raw(spark, landing, required=HEADER.split(",")), INGEST_ORDER)
    fact = S.resolve_keys(S.key_order_columns(clean, C.DEFAULT_DEDUP_KEYS), *dims).select(*S.FACT_COLUMNS)
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    got = fact_of(spark, out)
    assert rows(got.select(*S.FACT_COLUMNS)) == rows(fact)
    assert rows(cube_of(spark, out).select(*trade_cube(fact).columns)) == rows(trade_cube(fact))
    for r in got.groupBy(F.coalesce("year", F.lit(0)).alias("y")).agg(F.min("trade_id").alias("a"), F.max("trade_id").alias("b"), F.count_distinct("trade_id").alias("n")).collect():
        assert (r["a"], r["b"]) == (r["y"] * incremental.KEYS_PER_YEAR + 1, r["y"] * incremental.KEYS_PER_YEAR + r["n"])


def files(out):
    return {p: os.path.getmtime(p) for p in glob.glob(f"{out}/fact/year=*/*.parquet")}


def test_only_touched_years_are_rewritten(spark, scratch, dims):
    rng = random.Random(2)
    landing, out = f"{scratch}/in", f"{scratch}/out"
    put(landing, "b.csv", [line(rng, y) for y in (2019, 2020, 2021, "20x0") for _ in range(30)])
    assert load_increment(spark, landing, out, *dims) == [None, 2019, 2020, 2021]
    same_as_reload(spark, landing, out, dims)
    before = files(out)
    # a file that sorts before the one that is there, with other values of the same keys; and a new year
    put(landing, "a.csv", [line(rng, y, 77) for y in (2020, 2022) for _ in range(30)])
    assert load_increment(spark, landing, out, *dims) == [2020, 2022]
    same_as_reload(spark, landing, out, dims)
    after = files(out)
    changed = {os.path.basename(os.path.dirname(p)) for p in before.keys() ^ after.keys()}
    assert changed == {"year=2020", "year=2022"} and all(after[p] == before[p] for p in before.keys() & after.keys())
    assert load_increment(spark, landing, out, *dims) == []


def test_a_stopped_load_is_taken_up(spark, scratch, dims, monkeypatch):
    rng = random.Random(3)
    landing, out = f"{scratch}/in", f"{scratch}/out"
    put(landing, "a.csv", [line(rng, 2020) for _ in range(30)])
    load_increment(spark, landing, out, *dims)
    put(landing, "b.csv", [line(rng, y) for y in (2020, 2021) for _ in range(30)])
    for name in ("_read", "trade_cube"):  # before the tags are written, and before the cube is
        with monkeypatch.context() as m:
            m.setattr(incremental, name, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("stopped")))
            with pytest.raises(RuntimeError, match="stopped"):
                load_increment(spark, landing, out, *dims)
    assert load_increment(spark, landing, out, *dims) == [2020, 2021]
    same_as_reload(spark, landing, out, dims)


def test_a_year_may_lose_its_cube(spark, scratch, dims):
    landing, out = f"{scratch}/in", f"{scratch}/out"
    row = "2020,376,ISR,156,CHN,84,d,M,{},5,,kg"
    put(landing, "b.csv", [row.format(10)])
    load_increment(spark, landing, out, *dims)
    put(landing, "a.csv", [row.format(-1)])
    assert load_increment(spark, landing, out, *dims) == [2020]
    same_as_reload(spark, landing, out, dims)
    assert cube_of(spark, out).count() == 0


def test_a_feed_is_sorted_by_more_tasks_as_it_grows(spark):
    from tradeweave.plans.registry import FILE_ROWS, feed_files

    assert feed_files(spark.range(10)) == 4
    assert feed_files(spark.range(9 * FILE_ROWS + 1)) == 10


def test_landed_files_are_left_out_without_a_shuffle_of_lines(spark, scratch, monkeypatch):
    from tradeweave.sources import landing

    rng, seen = random.Random(4), []
    put(f"{scratch}/in", "a.csv", [line(rng, 2020) for _ in range(2000)])
    landing.land_incremental(spark, f"{scratch}/in", f"{scratch}/out")
    put(f"{scratch}/in", "b.csv", [line(rng, 2021) for _ in range(5)])
    align = landing.align_lines
    monkeypatch.setattr(landing, "align_lines", lambda lines, *a, **k: (seen.append(lines), align(lines, *a, **k))[1])
    # the landed rows are over this size, the list of their files is not
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2500")
    try:
        landing.land_incremental(spark, f"{scratch}/in", f"{scratch}/out")
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(_ing_file" not in plan
    assert landing.landed_rows(spark, f"{scratch}/out").count() == 2005
