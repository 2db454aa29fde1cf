"""Incremental landing of raw flow files (S9, batch form).

Landed rows carry the path of their file, and that column is the manifest: files that
already have rows are skipped by an anti-join, new rows are appended in one commit. A
run that stops before the commit leaves nothing behind; one that stops after it has
landed everything. Neither paths nor rows pass through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.session import written
from tradeweave.sources.files import INGEST_ORDER, RAW_FLOW_COLUMNS, align_lines, path_exists, raw_lines, text_schema

#: The landing run that a row came with.
RUN = "_ing_run"


def _rows_path(out: str) -> str:
    return f"{out.rstrip('/')}/rows"


def _landed_schema(columns: Sequence[str]):
    return text_schema(columns).add("_ing_file", "string").add("_ing_block", "long").add("_ing_row", "long").add(RUN, "string")


def land_incremental(spark: SparkSession, landing: str, out: str,
                     columns: Sequence[str] = RAW_FLOW_COLUMNS) -> DataFrame:
    """Append the raw rows of not-yet-landed files under ``landing`` to ``out``.

    Returns the newly landed paths (column ``path``). Columns are taken by the names in
    each file's header; rows keep their ingest order columns, so keep-first
    dedup over ``out`` sees file order.
    """
    lines, rows, run = raw_lines(spark, landing), _rows_path(out), uuid.uuid4().hex
    if path_exists(spark, rows):
        # written, so that the join knows the size of the list and not that of the landed rows: no line is shuffled for it
        done = written(spark.read.schema(_landed_schema(columns)).parquet(rows).select("_ing_file").distinct(), "done")
        lines = lines.join(done, "_ing_file", "left_anti")
    new = align_lines(lines, columns, required=columns).select(*columns, *INGEST_ORDER, F.lit(run).alias(RUN))
    new.write.mode("append").parquet(rows)
    landed = spark.read.schema(_landed_schema(columns)).parquet(rows).where(F.col(RUN) == run)
    return landed.select(F.col("_ing_file").alias("path")).distinct()


def landed_rows(spark: SparkSession, out: str, columns: Sequence[str] = RAW_FLOW_COLUMNS) -> DataFrame:
    return spark.read.schema(_landed_schema(columns)).parquet(_rows_path(out)).drop(RUN)


def landed_runs(spark: SparkSession, out: str, columns: Sequence[str] = RAW_FLOW_COLUMNS) -> DataFrame:
    """Landed rows with the run they came with."""
    return spark.read.schema(_landed_schema(columns)).parquet(_rows_path(out))
