"""Generated reference tables: HS chapters (S10) and the time dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.constants import (
    DEFAULT_LAST_PERIOD,
    DEFAULT_PERIODS,
    HS_CHAPTER_NAMES,
    HS_SECTIONS,
    UNKNOWN_SECTION,
)


def hs_chapters(spark: SparkSession) -> DataFrame:
    """Raw HS chapter reference: chapters 1..99 with section code and name.

    Chapters outside every section range get ('?', 'Unknown'); chapters
    without a name get ''. Columns: chapter_code, chapter_int, chapter_name,
    section_num, section_name.
    """
    ch = F.col("chapter_int")
    sec_num: Column | None = None
    sec_name: Column | None = None
    for lo, hi, code, name in HS_SECTIONS:
        cond = ch.between(lo, hi)
        sec_num = F.when(cond, code) if sec_num is None else sec_num.when(cond, code)
        sec_name = F.when(cond, name) if sec_name is None else sec_name.when(cond, name)
    names = F.array(*[F.lit(n) for n in HS_CHAPTER_NAMES])
    return (
        spark.range(1, 100, numPartitions=1)
        .select(F.col("id").cast("int").alias("chapter_int"))
        .select(
            F.lpad(ch.cast("string"), 2, "0").alias("chapter_code"),
            ch,
            F.coalesce(F.try_element_at(names, ch), F.lit("")).alias("chapter_name"),
            sec_num.otherwise(UNKNOWN_SECTION[0]).alias("section_num"),
            sec_name.otherwise(UNKNOWN_SECTION[1]).alias("section_name"),
        )
    )


def period_label(year: Column, periods: Sequence[tuple[int, str]], last: str) -> Column:
    out = None
    for upper, label in periods:
        out = F.when(year <= upper, label) if out is None else out.when(year <= upper, label)
    return out.otherwise(last) if out is not None else F.lit(last)


def decade_label(year: Column) -> Column:
    """'2010s' style label of the year's decade."""
    return F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s"))


def with_time_labels(years: DataFrame, periods=DEFAULT_PERIODS, last: str = DEFAULT_LAST_PERIOD) -> DataFrame:
    y = F.col("year")
    return years.select(y.cast("int").alias("year"), decade_label(y).alias("decade"),
                        period_label(y, periods, last).alias("period_label"))


def dim_time(spark: SparkSession, lo: int, hi: int, periods=DEFAULT_PERIODS,
             last: str = DEFAULT_LAST_PERIOD) -> DataFrame:
    """Time dimension for the inclusive year range [lo, hi]."""
    years = spark.range(lo, hi + 1, numPartitions=1).select(F.col("id").alias("year"))
    return with_time_labels(years, periods, last)


def dim_time_of(spark: SparkSession, *tables: DataFrame, years: tuple[int, int] | None = None,
                periods=DEFAULT_PERIODS, last: str = DEFAULT_LAST_PERIOD) -> DataFrame:
    """Time dimension of every year that occurs in the tables' ``year`` column, and of
    the range ``years`` where one is given: no year of the data is left out."""
    found = None
    if years is not None:
        found = spark.range(years[0], years[1] + 1, numPartitions=1).select(F.col("id").cast("int").alias("year"))
    for t in tables:
        own = t.select(F.col("year").cast("int").alias("year")).where(F.col("year").isNotNull()).distinct()
        found = own if found is None else found.unionByName(own)
    return with_time_labels(found.distinct(), periods, last)
