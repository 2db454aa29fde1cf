"""Surrogate keys and global ranks without a single-partition window.

``with_dim_key`` numbers a *dimension* (hundreds of rows) with a plain
``row_number()`` window, behind a check of its size. Facts are numbered like this:

1. the input is written once, then range-partitioned on the order columns
   (``repartitionByRange``: Spark's own bounded sampling, one shuffle), sorted inside
   the partitions, and written with the partition's number and the row's place in it;
2. rows (or weights) per partition come from the written table, their prefix sums
   (one row per partition) are joined back.

Keys come from written tables, so they are the same in every pass and retry. There are
several partitions per task slot, and ties of the order columns share a partition.
Used for contiguous fact keys (L2) and exact percentiles (D1, on per-value counts so
duplicate values never pile up in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.session import written

#: Largest dimension that may be numbered by one global window.
DIM_MAX_ROWS = 20_000
#: Range partitions per shuffle partition.
SPREAD = 4
_PART, _POS = "_rk_part", "_rk_pos"


def with_dim_key(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Dimension key 1..N by natural-key order (global window: dimensions only).

    The rows pass a check on the way: a table of over ``DIM_MAX_ROWS`` rows raises
    instead of being sorted by one task.
    """
    limited = df.limit(DIM_MAX_ROWS + 1)
    w = Window.orderBy(*order)
    nth = F.row_number().over(w)
    too_many = F.raise_error(F.lit(f"a dimension has over {DIM_MAX_ROWS} rows")).cast("int")
    return limited.select(F.when(nth <= DIM_MAX_ROWS, nth).otherwise(too_many).cast("int").alias(name), *df.columns)


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ranged(df: DataFrame, order: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """``df`` written in global order (NULLs last) with ``_rk_part`` and ``_rk_pos`` (both from 0)."""
    by = [F.col(c).asc_nulls_last() for c in order]
    spread = written(df, "ranked").repartitionByRange(_partitions(df, num_partitions), *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(spread.withColumns({_PART: F.spark_partition_id(), _POS: place}), "ranked")


def _offsets(totals: DataFrame, base: str, total: str) -> DataFrame:
    """Prefix sums of ``n`` over the partitions: one row per partition."""
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(_PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base),
                         F.sum("n").over(Window.partitionBy()).alias(total))


def cumulative(df: DataFrame, order: Sequence[str], weight: Column | None = None, out: str = "_cum",
               num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over all rows strictly before this one in ``order``
    (0-based start position) and ``_rk_total`` = sum of all weights.

    ``order`` must be a total order over the rows (make it unique).
    """
    w = weight if weight is not None else F.lit(1).cast("long")
    r = ranged(df.withColumn("_rk_w", w), order, num_partitions)
    offsets = _offsets(r.groupBy(_PART).agg(F.sum("_rk_w").alias("n")), "_rk_base", "_rk_total")
    r = r.join(F.broadcast(offsets), _PART)  # one row per range partition
    if weight is None:
        inside = F.col(_POS)
    else:
        run = Window.partitionBy(_PART).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
        inside = F.sum("_rk_w").over(run) - F.col("_rk_w")
    return r.withColumn(out, F.col("_rk_base") + inside).drop(_PART, _POS, "_rk_base")


def with_sequential_key(df: DataFrame, order: Sequence[str], name: str, offset: int = 0,
                        num_partitions: int | None = None) -> DataFrame:
    """Contiguous key offset+1 .. offset+N in ``order`` (scalable ROW_NUMBER)."""
    r = cumulative(df, order, None, "_seq0", num_partitions)
    return r.select((F.lit(offset).cast("long") + F.col("_seq0") + 1).alias(name), *df.columns)
