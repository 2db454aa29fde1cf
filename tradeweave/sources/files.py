"""File sources and sinks.

Raw feeds are read as text, each file by its own header (never by position, never
inferred), with an ingest order made of the file path, the split offset and the row
position, which is what "first in file order" means for keep-first dedup.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradeweave.constants import FLOW_RENAME
from tradeweave.session import written
from tradeweave.sources.records import csv_records

#: Files that are read, at any depth.
CSV_FILES = "*.{csv,csv.gz}"
INGEST_ORDER = ("_ing_file", "_ing_block", "_ing_row")
RAW_FLOW_COLUMNS = tuple(FLOW_RENAME)


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at ``path`` (a glob is allowed)? Asked of the session's file system;
    an error other than absence is raised."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(conf).globStatus(target)
    return found is not None and len(found) > 0


def raw_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files under ``path`` (folders are searched through) with their ingest order."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", CSV_FILES).text(path if isinstance(path, str) else list(path))
    return df.select("value", F.col("_metadata.file_path").alias("_ing_file"),
                     F.col("_metadata.file_block_start").alias("_ing_block"),
                     F.monotonically_increasing_id().alias("_ing_row"))


def align_lines(lines: DataFrame, columns: Sequence[str] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """CSV lines (``value`` and the ingest order) → one text column per header name.

    Every file is read by its own header, whatever the order of its columns; a column that
    a file lacks is NULL there. ``columns`` picks the output columns (else all names that occur,
    in the order of the distinct headers); a file whose header has none of ``required``
    raises. Quoted cells may hold commas, doubled quotes and line breaks (``records``); a backslash is a
    character like others. Missing cells and empty ones are NULL; a record with more cells than its header
    raises. Blank records and further ones equal to a file's header are skipped. The driver sees the distinct headers only.
    """
    records, places = csv_records(lines)
    first = written(records.join(places, ["_ing_file", "_ing_row"], "left_semi").select("_ing_file", F.col("value").alias("_header")), "headers")
    layouts = [r["_header"] for r in first.select("_header").distinct().orderBy("_header").collect()]
    names = {h: [c.strip() for c in next(csv.reader(io.StringIO(h)))] for h in layouts}
    for h, have in names.items():
        if required and not set(required) & set(have):
            raise ValueError(f"unknown file layout: {h!r}")
    wanted = list(columns) if columns is not None else list(dict.fromkeys(c for h in layouts for c in names[h] if c))
    width = max([len(v) for v in names.values()], default=1)
    fields = ", ".join(f"`c{i}` string" for i in range(width + 1))
    rows = records.join(first, "_ing_file").where((F.col("value") != F.col("_header")) & (F.trim("value") != ""))
    rows = rows.withColumn("_cells", F.from_csv("value", F.lit(fields), {"escape": '"', "maxCharsPerColumn": "-1"}))
    if names:
        beyond = F.coalesce(*[F.when(F.col("_header") == h, F.col("_cells")[f"c{len(have)}"]) for h, have in names.items()])
        said = F.concat(F.col("_ing_file"), F.lit(" has a record with more cells than its header: "), F.substring("value", 1, 200))
        rows = rows.where(F.when(beyond.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True))

    def cell(name: str) -> Column:
        out = F.lit(None).cast("string")
        for h, have in names.items():
            if name in have:
                out = F.when(F.col("_header") == h, F.nullif(F.col("_cells")[f"c{have.index(name)}"], F.lit(""))).otherwise(out)
        return out

    return rows.select(*[cell(c).alias(c) for c in wanted], *INGEST_ORDER)


def read_raw(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None,
             with_ingest_order: bool = True, required: Sequence[str] = ()) -> DataFrame:
    """CSV with header, every column read as text, each file by its own header.

    ``columns`` fixes the output columns; without it all names of all headers are there. With
    ``with_ingest_order`` the frame carries ``_ing_file`` / ``_ing_block`` /
    ``_ing_row`` (row position grows along the file inside a split).
    """
    df = align_lines(raw_lines(spark, path), columns, required)
    return df if with_ingest_order else df.drop(*INGEST_ORDER)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """A processed Parquet table."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """S3: CSV with header, no index column, overwrite."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_processed(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, overwrite; facts are written partitioned by year."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report(spark: SparkSession, report: "dict | DataFrame", path: str) -> None:
    """The quality report as one JSON document (a one-row nested frame, or a dict)."""
    if isinstance(report, DataFrame):
        report.coalesce(1).write.mode("overwrite").json(path)
        return
    doc = json.dumps(report, default=str)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A quality report (pretty-printed or single-line JSON) as a one-row nested frame."""
    return spark.read.option("multiLine", True).json(path)
