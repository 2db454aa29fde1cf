"""Incremental landing as a Structured Streaming job (S9, streaming form).

A file-source stream over the landing folder tracks processed files in its
checkpoint (exactly-once, restart-safe), so "skip files already landed" is
built in. Each micro-batch is cleaned with the batch operator and merged
into the clean table keep-first: rows whose dedup key already exists in the
table are dropped (earlier batches came first in ingest order), new keys are
appended. The anti-join is null-safe and restricted to the batch's years.
No watermark: annual records carry no event time to bound state by, and the
table itself is the state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradeweave.constants import DEFAULT_DEDUP_KEYS
from tradeweave.operators.clean import clean_flows
from tradeweave.sources.files import CSV_FILES, INGEST_ORDER, RAW_FLOW_COLUMNS, align_lines, path_exists


def merge_keep_first(batch: DataFrame, table: str, keys: Sequence[str] = DEFAULT_DEDUP_KEYS) -> None:
    """Append rows of ``batch`` (already clean) whose keys are not yet in ``table``."""
    spark = batch.sparkSession
    # few files per year: small years share a task, large ones are split over several
    if not path_exists(spark, table):
        batch.hint("rebalance", "year").write.mode("append").partitionBy("year").parquet(table)
        return
    existing = spark.read.schema(batch.schema).parquet(table)
    years = batch.select(F.col("year").alias("_year")).distinct()
    old = existing.join(years, F.col("year").eqNullSafe(F.col("_year")), "left_semi").select(*[F.col(k).alias(f"_old_{k}") for k in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys])
    batch.join(old, cond, "left_anti").hint("rebalance", "year").write.mode("append").partitionBy("year").parquet(table)


def start_landing_stream(spark: SparkSession, landing: str, table: str, checkpoint: str,
                         keys: Sequence[str] = DEFAULT_DEDUP_KEYS, available_now: bool = True) -> StreamingQuery:
    """Stream raw CSV files from ``landing`` into the clean, deduplicated ``table``."""
    raw = (spark.readStream.option("pathGlobFilter", CSV_FILES).option("recursiveFileLookup", True).text(landing)
           .select("value", F.col("_metadata.file_path").alias("_ing_file"),
                   F.col("_metadata.file_block_start").alias("_ing_block")))

    def process(batch: DataFrame, _epoch: int) -> None:
        # whole files per batch: each is read by its own header; row position inside each
        # split, assigned on the static micro-batch
        lines = batch.withColumn("_ing_row", F.monotonically_increasing_id())
        aligned = align_lines(lines, RAW_FLOW_COLUMNS, required=RAW_FLOW_COLUMNS)
        merge_keep_first(clean_flows(aligned, INGEST_ORDER, keys), table, keys)

    w = raw.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
