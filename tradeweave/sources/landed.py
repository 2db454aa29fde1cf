"""Raw inputs from landed files (the production counterpart of ``standin``).

Layout under one raw folder (every file CSV with a header, read as text):

    reporter/*.csv      flow records reported by the home country
    mirror/*.csv        flow records reported by partners about the home country
    countries/*.csv     iso3, name, region, income_group, iso2, capital, longitude, latitude, un_numeric
    indicators/*.csv    country_iso3, country_name, indicator, year, value
    hs_chapters/*.csv   chapter_code, chapter_int, chapter_name, section_num, section_name (optional:
                        generated from the fixed section ranges when absent)

Files may lie at any depth of a source's folder, also as ``.csv.gz``. A missing folder
gives an empty frame with the expected columns (and a warning), so the rest of the load still runs — like the analysed pipeline,
which skips missing sources instead of failing; a folder without a file that can be
read raises.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.sources.files import INGEST_ORDER, RAW_FLOW_COLUMNS, path_exists, raw_lines, read_raw, text_schema
from tradeweave.sources.reference import hs_chapters
from tradeweave.sources.standin import RawInputs

log = logging.getLogger(__name__)

COUNTRY_COLUMNS = ("iso3", "name", "region", "income_group", "iso2", "capital", "longitude", "latitude",
                   "un_numeric")
INDICATOR_COLUMNS = ("country_iso3", "country_name", "indicator", "year", "value")
CHAPTER_COLUMNS = ("chapter_code", "chapter_int", "chapter_name", "section_num", "section_name")


def _has_files(spark: SparkSession, path: str) -> bool:
    """Does the folder exist? One that holds no file that ``raw_lines`` reads, at any depth, raises."""
    if not path_exists(spark, path):
        return False
    if not raw_lines(spark, path).inputFiles():
        raise ValueError(f"no .csv or .csv.gz file under {path}")
    return True


def _source(spark: SparkSession, path: str, columns, ordered: bool) -> DataFrame:
    if _has_files(spark, path):
        return read_raw(spark, path, None, with_ingest_order=ordered, required=columns)
    log.warning("source not found: %s — using an empty frame", path)
    empty = spark.createDataFrame([], text_schema(columns))
    if ordered:
        empty = empty.select("*", F.lit(None).cast("string").alias("_ing_file"),
                             F.lit(None).cast("long").alias("_ing_block"), F.lit(None).cast("long").alias("_ing_row"))
    return empty


def landed_inputs(spark: SparkSession, raw_dir: str) -> RawInputs:
    """Raw inputs of a landed folder; flow and indicator rows carry their file order."""
    root = raw_dir.rstrip("/")
    ind = _source(spark, f"{root}/indicators", INDICATOR_COLUMNS, True)
    ind = ind.withColumn("_ing_seq", F.struct(*INGEST_ORDER)).drop(*INGEST_ORDER)
    chapters = (_source(spark, f"{root}/hs_chapters", CHAPTER_COLUMNS, False)
                if _has_files(spark, f"{root}/hs_chapters") else hs_chapters(spark))
    return RawInputs(
        reporter_flows=_source(spark, f"{root}/reporter", RAW_FLOW_COLUMNS, True),
        mirror_flows=_source(spark, f"{root}/mirror", RAW_FLOW_COLUMNS, True),
        country_mapping=_source(spark, f"{root}/countries", COUNTRY_COLUMNS, False),
        hs_chapters=chapters,
        indicators=ind,
        flow_order=INGEST_ORDER,
        indicator_order=("_ing_seq",),
    )
