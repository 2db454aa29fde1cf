"""Clustered facts: what a scan reads, by its own metrics and by the files' footers."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tradeweave.sources.clustered import write_clustered

PARTNERS, ROWS = 50, 120_000


def scan_metric(df, name):
    """A metric of the one file scan of ``df`` (a plan without shuffles), after it ran."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    return node.metrics().get(name).get().value()


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    # partner 7 has a third of all rows, some rows have no partner, chapter or year
    i = F.col("id")
    partner = F.when(i % 3 == 0, 7).when(i % 1000 == 1, None).otherwise(F.pmod(F.xxhash64(i), F.lit(PARTNERS)))
    df = spark.range(ROWS).select(
        i.alias("trade_id"), F.when(i % 5000 != 2, 2018 + F.pmod(F.xxhash64(i, F.lit(1)), F.lit(2))).cast("int").alias("year"), partner.cast("int").alias("partner_id"),
        F.when(i % 700 != 3, F.pmod(F.xxhash64(i, F.lit(2)), F.lit(97))).cast("int").alias("commodity_id"), F.rand(3).alias("trade_value_usd"))
    root = str(tmp_path_factory.mktemp("clustered"))
    write_clustered(df, f"{root}/a", num_partitions=6, row_group_bytes=64 * 1024)
    df.repartition(6).write.partitionBy("year").option("parquet.block.size", 64 * 1024).parquet(f"{root}/plain")
    schema = df.schema
    return root, df, spark.read.schema(schema).parquet(f"{root}/a"), spark.read.schema(schema).parquet(f"{root}/plain")


def test_no_row_is_lost(facts):
    _root, df, clustered, _plain = facts
    cols = df.columns
    digest = lambda d: d.select(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    assert digest(clustered) == digest(df.select(*cols))


@pytest.mark.parametrize("where", ["partner_id = 13", "partner_id = 7 AND commodity_id = 5"])
def test_a_selection_reads_few_rows(facts, where):
    _root, df, clustered, plain = facts
    read = scan_metric(clustered.where(where).select("trade_value_usd"), "numOutputRows")
    before = scan_metric(plain.where(where).select("trade_value_usd"), "numOutputRows")
    found = df.where(where).count()
    assert found <= read < 0.2 * ROWS and read < 0.3 * before, (found, read, before)


def test_hot_partner_is_split_and_footers_say_ranges(facts):
    root, _df, _clustered, _plain = facts
    files = glob.glob(f"{root}/a/year=2018/*.parquet")
    held = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index("partner_id")
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        ranges = [(s.min, s.max) for s in stats if s.has_min_max]
        assert ranges == sorted(ranges)
        held += any(lo <= 7 <= hi for lo, hi in ranges)
    assert held >= 2  # a third of a year's rows lie in more than one file


def test_empty(spark, scratch):
    write_clustered(spark.createDataFrame([], "trade_id long, year int, partner_id int, commodity_id int"), f"{scratch}/none")
    assert glob.glob(f"{scratch}/none/_SUCCESS")
