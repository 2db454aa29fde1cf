"""Facts clustered inside their years (F4, S4): one partner's or chapter's rows lie together.

Files are split by ranges of (year, partner, chapter, key), so each holds a short range of partners and its row groups a
short range of chapters; statistics and Bloom filters of these two columns let a query of one partner or chapter skip the
rest. The key at the end of the range lets a partner with a third of all rows be split over many files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTER_BY = ("partner_id", "commodity_id")
#: Distinct values that a Bloom filter is laid out for (the keyed dimensions are bounded by this).
BLOOM_VALUES = 20_000


def write_clustered(df: DataFrame, path: str, by: Sequence[str] = CLUSTER_BY, partition: str = "year", tie: str = "trade_id",
                    num_partitions: int | None = None, row_group_bytes: int | None = None) -> None:
    """Write ``df`` (overwrite) partitioned by ``partition`` and clustered by ``by``; NULLs come first, and nothing is dropped.

    One shuffle, by Spark's own sampled ranges. ``num_partitions`` is left to the session unless given; small
    ``row_group_bytes`` make finer groups to skip.
    """
    keys = [F.col(c) for c in (partition, *by, tie)]
    spread = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    w = spread.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(partition)
    for c in by:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(BLOOM_VALUES))
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes))
    w.parquet(path)
