"""Shards of near equal size by sampled splitters, in DataFrame operations alone.

Size-weighted samples of the group key give quantile boundaries that cut the key's
range; every record falls in one range. Ranges are then measured exactly, and one that
holds too many bytes (a key with very many records, or bad luck of the sample) is cut
again by a second, finer sample of (key, tie) pairs. Each range now fits one task, so
records get their exact place in key order from counts of the ranges before and a
window inside their own, and the shard follows from the bytes before a record:
shards are consecutive key ranges whose sizes differ by less than two records.
Records of a group lie together except where a shard's boundary cuts through it.

Defined results: null text is 0 bytes (size 1) with checksum 0; rows equal in key and tie
(repeated rows) are interchangeable; a null tie sorts first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh_name, staged

N_SHARDS = 8
RANGE_BYTES = 64 << 20
MIN_RANGES = 128
MAX_RANGES = 4096
SAMPLES_PER_RANGE = 64
MAX_PARTS = 1 << 20


def _range_of(bounds: Column, value: Column) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, by halving."""
    low_high = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(bounds) + F.lit(1))).cast("int") + 1)

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        below = F.get(bounds, middle) <= value
        moved = F.struct(F.when(below, middle + 1).otherwise(at["low"]).alias("low"), F.when(below, at["high"]).otherwise(middle).alias("high"))
        return F.when(at["low"] >= at["high"], at).otherwise(moved)

    return F.when(F.size(bounds) == 0, F.lit(0)).otherwise(F.aggregate(steps, low_high, halve, lambda at: at["low"]))


def _drawn(size: Column, every: Column, *key: Column) -> Column:
    """How often a record is drawn if one sample falls on ``every`` bytes: its share, rounded by a keyed hash."""
    share = size / every
    uniform = (F.xxhash64(*key, F.lit(41)).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    return F.floor(share + uniform).cast("long")


def _quantiles(samples: DataFrame, by: list[str], value: str, ranges: Column) -> DataFrame:
    """Per ``by``: sorted array of the sample values at which a further of ``ranges`` equal weights begins."""
    w = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    at = F.floor(F.sum("drawn").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) * ranges / F.sum("drawn").over(whole))
    marked = samples.withColumn("at", at).withColumn("was", F.coalesce(F.lag("at").over(w), F.lit(0)))
    return marked.filter("at > was").groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("bounds"))


def sampled_splitters(records: DataFrame, key: str, tie: str, size: str, n_shards: int = N_SHARDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``records`` with shard (int) and slot (long, gapless from 0 in each shard).

    ``key`` (long) groups records, ``tie`` orders those of a group, ``size`` (long, over 0) is shared out.
    Statistics come from these three columns alone; records themselves are shuffled once, by range.
    Driver and broadcasts see at most ``MAX_RANGES`` ranges and ``MAX_PARTS`` boundaries of parts.
    """
    slim = staged(records.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.col(size).alias("size")), "sizes")
    total = slim.agg(F.sum("size")).first()[0] or 0
    n_ranges = int(min(MAX_RANGES, max(MIN_RANGES, -(-total // range_bytes))))
    target = max(1, total // n_ranges, -(-total // MAX_PARTS))

    every = F.lit(max(1.0, total / (n_ranges * SAMPLES_PER_RANGE)))
    drawn = slim.withColumn("drawn", _drawn(F.col("size"), every, F.col("key"), F.col("tie"))).filter("drawn > 0")
    samples = drawn.groupBy("key").agg(F.sum("drawn").alias("drawn"))
    first = _quantiles(samples.withColumn("one", F.lit(0)), ["one"], "key", F.lit(n_ranges)).first()
    bounds = F.array(*[F.lit(b).cast("long") for b in first["bounds"]]) if first else F.array().cast("array<long>")

    def ranged(df: DataFrame, k: str, to: str) -> DataFrame:
        return df.withColumn(to, _range_of(bounds, F.col(k)))

    in_range = ranged(slim, "key", "range")
    measured = in_range.groupBy("range").agg(F.sum("size").alias("bytes"))
    # ranges that are overfull are cut again, by samples of their own
    overfull = measured.filter(F.col("bytes") > 2 * target).withColumn("parts", F.ceil(F.col("bytes") / target).cast("int"))
    pair = F.struct(F.col("key"), F.xxhash64("tie").alias("h"))
    finer = (
        in_range.join(F.broadcast(overfull), "range")  # at most MAX_RANGES rows
        .withColumn("drawn", _drawn(F.col("size"), F.col("bytes") / (F.col("parts") * SAMPLES_PER_RANGE), F.col("tie"), F.col("key")))
        .filter("drawn > 0").withColumn("pair", pair)
    )
    splits = staged(_quantiles(finer, ["range", "parts"], "pair", F.col("parts")).select("range", F.col("bounds").alias("cuts")), "splits")

    def parted(df: DataFrame, k: str, t: str, to: tuple[str, str]) -> DataFrame:
        """With range and part; the cuts are at most MAX_RANGES rows and MAX_PARTS pairs."""
        df = ranged(df, k, to[0])
        cuts = splits.select(F.col("range").alias(to[0]), F.col("cuts").alias("cuts_of_range"))
        df = df.join(F.broadcast(cuts), to[0], "left")
        part = F.when(F.col("cuts_of_range").isNull(), F.lit(0)).otherwise(_range_of(F.col("cuts_of_range"), F.struct(F.col(k).alias("key"), F.xxhash64(t).alias("h"))))
        return df.withColumn(to[1], part).drop("cuts_of_range")

    sizes = parted(slim, "key", "tie", ("range", "part")).groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # prefix sums in two steps: parts inside a range, then the ranges (at most MAX_RANGES rows)
    inside = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("range", "part", "bytes", "rows", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in ("bytes", "rows")])
    sizes = staged(sizes, "parts")
    tops = sizes.groupBy("range").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).withColumn("one", F.lit(0))
    over = Window.partitionBy("one").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("range", F.coalesce(F.sum("b").over(over), F.lit(0)).alias("b"), F.coalesce(F.sum("r").over(over), F.lit(0)).alias("r"))
    before = sizes.join(F.broadcast(tops), "range").select("range", "part", (F.col("bytes_inside") + F.col("b")).alias("bytes_before"), (F.col("rows_inside") + F.col("r")).alias("rows_before"), "bytes")

    names = {n: fresh_name(records.columns, n) for n in ("range", "part", "bytes_before", "rows_before", "in_bytes", "in_rows", "cuts_of_range")}

    def placed(df: DataFrame, k: str, t: str, s: str, only: DataFrame | None = None) -> DataFrame:
        """With bytes and rows before each record in key order."""
        df = parted(df, k, t, (names["range"], names["part"]))
        at = before if only is None else only
        at = at.select(F.col("range").alias(names["range"]), F.col("part").alias(names["part"]), F.col("bytes_before").alias(names["bytes_before"]), F.col("rows_before").alias(names["rows_before"]))
        df = df.join(F.broadcast(at), [names["range"], names["part"]])  # at most MAX_RANGES + MAX_PARTS rows
        w = Window.partitionBy(names["range"], names["part"]).orderBy(F.col(k), F.xxhash64(t), F.col(t), F.col(s))
        return df.withColumn(names["in_rows"], F.row_number().over(w) - 1 + F.col(names["rows_before"])).withColumn(
            names["in_bytes"], F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(s) + F.col(names["bytes_before"]))

    def shard(column: str) -> Column:
        return F.expr(f"cast((`{column}` * {n_shards}L) div {max(1, total)}L as int)")

    # a shard starts at the first row of a part, or inside a part whose bytes reach into it
    edge = before.withColumn("last", F.col("bytes_before") + F.col("bytes") - 1).filter(shard("bytes_before") != shard("last"))
    inside_edge = placed(slim, "key", "tie", "size", edge).select(shard(names["in_bytes"]).alias("shard"), F.col(names["in_rows"]).alias("row"))
    starts = before.select(shard("bytes_before").alias("shard"), F.col("rows_before").alias("row")).unionByName(inside_edge)
    start = F.lit(0).cast("long")
    for r in starts.groupBy("shard").agg(F.min("row").alias("row")).collect():  # n_shards rows
        start = F.when(F.col("shard") == r["shard"], F.lit(r["row"]).cast("long")).otherwise(start)

    out = placed(records, key, tie, size).withColumn("shard", shard(names["in_bytes"]))
    return out.withColumn("slot", F.col(names["in_rows"]) - start).drop(*names.values())
