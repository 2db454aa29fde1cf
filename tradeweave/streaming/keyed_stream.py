"""Landing as a stream whose memory of keys is a state store, not the table.

Two streams over the shared folder ``root``:

1. ``start_cleaning_stream`` reads new files of the landing folder, reads each by its own header, cleans the micro-batch
   (keep-first inside it) and writes it to ``root/batches/batch=<n>``. A batch that is run again replaces its folder.
2. ``start_first_of_key_stream`` reads these batches and keeps, per dedup key, whether it has been seen, in the state store
   (RocksDB: bounded memory, changes written per batch). A key's first row goes to ``root/clean``, partitioned by year; later ones are
   dropped. No batch reads the table, so its cost depends on the batch alone.

Both resume from their checkpoints under ``root``. A batch of the first that was written twice shows its keys twice to the second,
which drops them; the file sink of the second commits a batch once. NULLs in a key are equal to each other. Repeated rows,
ties inside a batch and empty files are settled by the clean, as in the batch form. A key has at most one row per cleaned batch,
so one that a third of all rows share is met here as a few rows only. Annual records have no event time to expire keys by: state
is one flag per key, spread over the shuffle partitions by key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tradeweave.constants import DEFAULT_DEDUP_KEYS
from tradeweave.operators.clean import clean_flows
from tradeweave.sources.files import CSV_FILES, INGEST_ORDER, RAW_FLOW_COLUMNS, align_lines

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH = "batch"


class FirstOfKey(StatefulProcessor):
    """Emits the row of a key's earliest batch, once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "batch bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self._seen.exists():
            return
        first = min(rows, key=lambda r: r[BATCH])
        self._seen.update((first[BATCH],))
        yield first

    def close(self) -> None:
        pass


def first_of_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of every key of a stream whose column ``batch`` orders them (state: a flag per key)."""
    return rows.groupBy(*keys).transformWithState(FirstOfKey(), rows.schema, outputMode="Append", timeMode="None")


def _started(frame, available_now: bool) -> StreamingQuery:
    return (frame.trigger(availableNow=True) if available_now else frame.trigger(processingTime="1 minute")).start()


def start_cleaning_stream(spark: SparkSession, landing: str, root: str, keys: Sequence[str] = DEFAULT_DEDUP_KEYS, available_now: bool = True) -> StreamingQuery:
    """New files of ``landing`` → clean batches under ``root/batches``."""
    lines = (spark.readStream.option("pathGlobFilter", CSV_FILES).option("recursiveFileLookup", True).text(landing)
             .select("value", F.col("_metadata.file_path").alias("_ing_file"), F.col("_metadata.file_block_start").alias("_ing_block")))

    def process(batch: DataFrame, epoch: int) -> None:
        placed = batch.withColumn("_ing_row", F.monotonically_increasing_id())
        aligned = align_lines(placed, RAW_FLOW_COLUMNS, required=RAW_FLOW_COLUMNS)
        clean_flows(aligned, INGEST_ORDER, keys).write.mode("overwrite").parquet(f"{root}/batches/{BATCH}={epoch}")

    return _started(lines.writeStream.foreachBatch(process).option("checkpointLocation", f"{root}/state/cleaning"), available_now)


def start_first_of_key_stream(spark: SparkSession, root: str, schema: StructType, keys: Sequence[str] = DEFAULT_DEDUP_KEYS,
                              available_now: bool = True) -> StreamingQuery:
    """Clean batches of ``root/batches`` → first row per key in ``root/clean``."""
    batches = spark.readStream.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).parquet(f"{root}/batches")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:  # a query takes its settings when it starts
        sink = first_of_key(batches, keys).drop(BATCH).writeStream.format("parquet").outputMode("append").partitionBy("year")
        return _started(sink.option("path", f"{root}/clean").option("checkpointLocation", f"{root}/state/keys"), available_now)
    finally:
        spark.conf.set(provider, before)


def clean_schema(spark: SparkSession) -> StructType:
    """Columns of a cleaned batch."""
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in (*RAW_FLOW_COLUMNS, *INGEST_ORDER)))
    return clean_flows(empty, INGEST_ORDER).schema


def land_by_key(spark: SparkSession, landing: str, root: str, keys: Sequence[str] = DEFAULT_DEDUP_KEYS) -> DataFrame:
    """Everything that has landed so far taken through both streams; the clean table that results."""
    start_cleaning_stream(spark, landing, root, keys).awaitTermination()
    schema = clean_schema(spark)
    start_first_of_key_stream(spark, root, schema, keys).awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/clean")
