"""Incremental load: landed files change only the years they touch (S9 → S11).

The warehouse of one feed lives under one folder:

    landed/rows           raw rows by landing run (``sources.landing``)
    tagged                rows with their tags, by year of the record
    fact, cube            by year
    runs                  the runs whose years have been rewritten

A load lands the new files, appends their tagged rows to the years they name, and
rewrites the facts and the cube of just these years (dynamic partition overwrite) from *all* tagged
rows of the year. A dedup key holds the year, so keep-first in file order over those rows is that of a
full reload, also where a file that lands later sorts before earlier ones. Runs are noted at the
end: one that stops in between is taken up by the next load, which rewrites its years again. Fact keys
count inside a year, so those of other years stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.constants import DEFAULT_DEDUP_KEYS
from tradeweave.functions.exprs import to_int
from tradeweave.operators import clean as C
from tradeweave.operators import star as S
from tradeweave.plans.cube import CUBE_SCHEMA, trade_cube
from tradeweave.session import written
from tradeweave.sources.files import INGEST_ORDER, RAW_FLOW_COLUMNS, path_exists
from tradeweave.sources.landing import RUN, land_incremental, landed_runs

#: Fact keys of a year lie in a range of their own.
KEYS_PER_YEAR = 10**12
YEAR = "_year"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def _overwrite_years(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` has rows of. Large years are split over tasks, small ones share them."""
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _drop_years(spark: SparkSession, path: str, years: Sequence[int]) -> None:
    """Removes the partitions of years that have no rows any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path
    for year in years:
        place = target(f"{path}/year={int(year)}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _touched(tags: DataFrame, years: Sequence[int | None]) -> DataFrame:
    known = [y for y in years if y is not None]
    wanted = F.col(YEAR).isin(known)
    return tags.where(wanted | F.col(YEAR).isNull() if None in years else wanted)


def load_increment(spark: SparkSession, landing: str, path: str, dim_country: DataFrame, dim_commodity: DataFrame,
                   columns: Sequence[str] = RAW_FLOW_COLUMNS, dedup_keys: Sequence[str] = DEFAULT_DEDUP_KEYS) -> list[int | None]:
    """Land the new files under ``landing`` and bring fact and cube under ``path`` up to date. Returns the years rewritten
    (the driver sees years and runs only)."""
    if dedup_keys[0] != "year":
        raise ValueError("the first dedup key must be the year")
    land_incremental(spark, landing, f"{path}/landed", columns)
    rows = landed_runs(spark, f"{path}/landed", columns)
    done = _read(spark, f"{path}/runs", f"{RUN} string")
    new = rows.join(done, RUN, "left_anti")

    # tagged rows of a run that stopped before its end are there already
    tags = C.tag_flows(new).withColumn(YEAR, to_int(F.col("year")))
    schema = tags.schema
    have = _read(spark, f"{path}/tagged", schema)
    have = written(have.join(done, RUN, "left_anti").select(RUN).distinct(), "begun")
    tags.join(have, RUN, "left_anti").hint("rebalance", YEAR).write.mode("append").partitionBy(YEAR).parquet(f"{path}/tagged")
    tags = _read(spark, f"{path}/tagged", schema)

    pending = written(tags.join(done, RUN, "left_anti").select(RUN, YEAR).distinct(), "pending")
    years = sorted((r[YEAR] for r in pending.select(YEAR).distinct().collect()), key=lambda y: (y is not None, y))
    if not years:
        return []
    clean = C.clean_flows(_touched(tags, years).drop(YEAR, RUN), INGEST_ORDER, dedup_keys)
    fact = S.resolve_keys(S.key_order_columns(clean, dedup_keys), dim_country, dim_commodity)
    keyed = written(S.with_fact_key(fact), "keyed")
    first = keyed.groupBy("year").agg(F.min("trade_id").alias("_first"))
    own = keyed.join(F.broadcast(first), keyed["year"].eqNullSafe(first["year"])).drop(first["year"])  # a row per year
    own = own.withColumn("trade_id", F.coalesce("year", F.lit(0)) * F.lit(KEYS_PER_YEAR) + F.col("trade_id") - F.col("_first") + 1).drop("_first")
    _overwrite_years(own, f"{path}/fact", "year")
    # a year whose rows were all rejected has no facts to replace, and had none; its cube may lose its last row
    cubes = written(trade_cube(_touched(fact_of(spark, path).withColumn(YEAR, F.col("year")), years).drop(YEAR)), "cubes")
    _overwrite_years(cubes, f"{path}/cube", "year")
    kept = {r["year"] for r in cubes.select("year").distinct().collect()}
    _drop_years(spark, f"{path}/cube", [y for y in years if y is not None and y not in kept])
    pending.select(RUN).distinct().write.mode("append").parquet(f"{path}/runs")
    return years


def fact_of(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/fact", S.FACT_SCHEMA)


def cube_of(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/cube", CUBE_SCHEMA)
