"""Quantile sketches and key bitmaps: merged ranges against the flows themselves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tradeweave.operators import quality as QU
from tradeweave.operators import summaries as SU
from tradeweave.params import TradeFilter

FLOW = "year int, flow_code string, trade_value_usd double"


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    # a third of all rows hold one value; a year has only NULLs, a label is missing
    rows = [(rng.choice([2018, 2019, 2020, None]), rng.choice(["Import", "Export", None]), 7.0 if rng.random() < 0.33 else rng.lognormvariate(10, 3)) for _ in range(30000)]
    return spark.createDataFrame(rows + [(2021, "Import", None)] * 3, FLOW).cache()


def test_exact_parts_and_rank_error(values):
    sk = SU.value_sketches(values).cache()
    assert sk.where("year = 2021").count() == 0
    for f, cond in ((TradeFilter(), "true"), (TradeFilter(year_min=2018, year_max=2019, flow="Imports"), "year <= 2019 AND flow_code = 'Import'")):
        rows = values.where(cond)
        got = SU.range_distribution(sk, f).first().asDict()
        want = QU.distribution(rows, "trade_value_usd").first().asDict()
        for c in ("min", "max", "mean", "sum"):
            assert got[c] == pytest.approx(want[c], abs=0.011)
        assert got["n"] == rows.where("trade_value_usd IS NOT NULL").count()
        for name, p in QU.QUANTILES:
            n, below, upto = rows.agg(F.count("trade_value_usd"), F.count_if(F.col("trade_value_usd") < got[name] - 0.01), F.count_if(F.col("trade_value_usd") <= got[name] + 0.01)).first()
            assert below / n - 2 * SU.rank_error() <= p <= upto / n + 2 * SU.rank_error()


def test_merging_in_steps_keeps_the_error(values):
    steps = SU.merge_sketches(SU.merge_sketches(SU.value_sketches(values), ("year",)))
    q = SU.range_distribution(steps.withColumn("flow_code", F.lit("all")), by=("flow_code",))
    ranks = SU.quantile_ranks(values.withColumn("flow_code", F.lit("all")), q)
    assert ranks.count() == 4 and ranks.where(~SU.within(2 * SU.rank_error())).count() == 0
    # a quantile that is off by far is found out
    off = SU.quantile_ranks(values.withColumn("flow_code", F.lit("all")), q.withColumn("p25", F.col("p75")))
    assert off.where(~SU.within(2 * SU.rank_error())).count() == 1


def test_finer_sketches_have_less_error():
    assert SU.rank_error(200) == pytest.approx(0.0133, abs=1e-3) and SU.rank_error(800) < SU.rank_error(400) < SU.rank_error(200)


def test_empty_tables(spark):
    none = spark.createDataFrame([], FLOW)
    assert SU.range_distribution(SU.value_sketches(none)).count() == 0
    keys = spark.createDataFrame([], "year int, flow_direction string, partner_id int")
    b = SU.key_bitmaps(keys, "partner_id")
    assert SU.distinct_in_range(b).first()[0] == 0 and SU.distinct_by_range({"n": b}).count() == 0


def test_distinct_keys_of_any_range(spark):
    rng = random.Random(6)
    # keys on both sides of a bitmap's end, NULL keys and a NULL year, a year without rows
    key = lambda: rng.choice([1, 2, 3, 32767, 32768, 32769, 65536, 65537, 1_000_000, None])
    rows = [(rng.choice([2010, 2011, 2014, None]), rng.choice(["Import", "Re-import", "Export", "X"]), key(), rng.choice([1, 2, None])) for _ in range(120)]
    df = spark.createDataFrame(rows, "year int, flow_direction string, partner_id int, commodity_id int")
    b = SU.key_bitmaps(df, "partner_id")
    got = {(r["year_from"], r["year_to"]): r["n"] for r in SU.distinct_by_range({"n": b}).collect()}
    years = range(2010, 2015)
    want = {(a, z): len({r[2] for r in rows if r[0] is not None and a <= r[0] <= z} - {None}) for a in years for z in years if a <= z}
    assert got == {r: n for r, n in want.items() if n} and (2012, 2013) not in got
    one = SU.distinct_in_range(b, TradeFilter(flow="Imports", year_min=2011)).first()[0]
    assert one == len({r[2] for r in rows if r[0] and r[0] >= 2011 and r[1] in ("Import", "Re-import")} - {None})
    per = SU.chapters_in_range(SU.key_bitmaps(df, "commodity_id", ("year", "flow_direction", "partner_id")), TradeFilter(year_max=2011))
    want = {}
    for y, d, p, c in rows:
        if y is not None and y <= 2011 and d != "X" and c is not None:
            want.setdefault(p, (set(), set()))[d == "Export"].add(c)
    assert {r["partner_id"]: (r["import_chapters"], r["export_chapters"]) for r in per.collect()} == {p: (len(a), len(b)) for p, (a, b) in want.items()}


def test_bitmaps_are_combined_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit(2020).alias("year"), F.lit("Import").alias("flow_direction"), (F.col("id") % 9).alias("partner_id"))
    plan = SU.key_bitmaps(df, "partner_id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan
