"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _rows_of(pairs: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """pairs (u, v) from several columns of each row. A union would plan all that leads to its rows once for each."""
    each = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])
    return pairs.select(F.explode(each).alias("e")).select("e.u", "e.v")


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and its v's; combined before the shuffle, joined back by u."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of ``links`` (a, b) but those that are their own label.

    Each round turns neighbours towards the least one they know; rounds grow with the
    logarithm of the longest path. State is a written table per round.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return df.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    pairs = staged(canonical(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    seen = None
    while True:
        both = _rows_of(pairs, ("u", "v"), ("v", "u"))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        small = _rows_of(_with_least(large), ("v", "m"), ("u", "m"))
        pairs = staged(canonical(small), "links")
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == seen or now[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now
