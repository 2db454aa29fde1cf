"""CSV records from lines: quoted cells may hold commas, doubled quotes and line breaks (RFC 4180).

Files are read as lines over many splits, so a split may begin inside a quoted cell. What a line does to the
reader is a map of its two states (outside or inside a quoted cell) onto themselves, and such maps compose:

1. One scan counts, per split, the lines that leave a reader open who came to them outside. A file
   without one has only records of one line: its lines are its records, and nothing is shuffled.
2. In the other files a line's state is that of the last line before it that leaves both states alike, turned
   once for each line in between that swaps them. That is a window per split; the splits of a file
   are chained in the same way, by one row each.
3. Records of several lines are put together; all others pass as they are.

A file that ends inside a quoted cell raises, as does a record of over ``MAX_LINES`` lines. The line breaks
inside a cell come back as ``\\n``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.session import written

MAX_LINES = 10_000
#: A cell that is not opened and left open, after doubled quotes have gone: quoted (what follows the quote belongs to it), or plain.
_CELL = r'(?:"[^"]*+"[^,]*+|[^",][^,]*+)?'
_LEFT_OPEN = rf'(?s)^(?:{_CELL},)*+"[^"]*+$'
_STILL_OPEN = r'(?s)^[^"]*+$'
_OPEN_AGAIN = rf'(?s)^[^"]*+"[^,]*+,(?:{_CELL},)*+"[^"]*+$'


def quote_states(line: Column) -> tuple[Column, Column]:
    """Is a reader inside a quoted cell after ``line`` who came to it outside, and one who came to it inside."""
    quotes = F.contains(line, F.lit('"'))
    single = F.replace(line, F.lit('""'), F.lit(""))
    from_outside = quotes & single.rlike(_LEFT_OPEN)
    from_inside = ~quotes | single.rlike(_STILL_OPEN) | single.rlike(_OPEN_AGAIN)
    return from_outside, from_inside


def _chained(df: DataFrame, part: Sequence[str], order: str) -> DataFrame:
    """Adds, for the place before each row, ``known`` (the state that the last row with one left; NULL: none) and ``odd``
    (is the number of swaps since then, or since the beginning, odd). Rows have ``leaves`` (state or NULL) and ``swaps``."""
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_swaps", F.coalesce(F.sum("swaps").over(before), F.lit(0)))
    last = F.last(F.when(F.col("leaves").isNotNull(), F.struct("leaves", "_swaps")), ignorenulls=True).over(before)
    df = df.withColumn("_last", last)
    odd = (F.col("_swaps") - F.coalesce(F.col("_last._swaps"), F.lit(0))) % 2 == 1
    return df.withColumn("known", F.col("_last.leaves")).withColumn("odd", odd).drop("_swaps", "_last")


def _state(known: Column, start: Column, odd: Column) -> Column:
    return F.coalesce(known, start) != odd


def assemble(lines: DataFrame) -> DataFrame:
    """Records of ``lines`` (value, _ing_file, _ing_block, _ing_row), each with the ingest order of its first line."""
    opened, kept = quote_states(F.col("value"))
    split = ["_ing_file", "_ing_block"]
    told = lines.withColumn("_out", opened).withColumn("_in", kept)
    # both states alike: the line decides; swapped: it turns; else it leaves the state as it is
    told = told.withColumn("leaves", F.when(F.col("_out") == F.col("_in"), F.col("_out"))).withColumn("swaps", (F.col("_out") & ~F.col("_in")).cast("int"))
    told = _chained(told, split, "_ing_row")

    # a split as one such row: what it leaves, and where its last record starts, for either state at its beginning
    whole = told.groupBy(*split).agg(F.max(F.struct("_ing_row", "leaves", "swaps", "known", "odd")).alias("end"))
    leaves = F.coalesce(F.col("end.leaves"), F.when(F.col("end.known").isNotNull(), F.col("end.known") != (F.col("end.odd") != (F.col("end.swaps") == 1))))
    swaps = F.when(leaves.isNull(), (F.col("end.odd") != (F.col("end.swaps") == 1)).cast("int")).otherwise(0)
    splits = _chained(whole.select(*split, leaves.alias("leaves"), swaps.alias("swaps")), ["_ing_file"], "_ing_block")
    splits = splits.withColumn("_start", _state(F.col("known"), F.lit(False), F.col("odd")))
    splits = written(splits.withColumn("_end", _state(F.col("leaves"), F.col("_start"), F.col("swaps") == 1)), "splits")
    last_block = splits.groupBy("_ing_file").agg(F.max(F.struct("_ing_block", "_end")).alias("last")).filter("last._end")
    for r in last_block.select("_ing_file").limit(1).collect():
        raise ValueError(f"{r['_ing_file']} ends inside a quoted cell")

    told = told.join(splits.select(*split, "_start"), split)
    inside = _state(F.col("known"), F.col("_start"), F.col("odd"))
    told = told.withColumn("_inside", inside).withColumn("_more", F.when(inside, F.col("_in")).otherwise(F.col("_out")))
    told = told.select("value", *split, "_ing_row", "_inside", "_more")
    single = told.filter("NOT _inside AND NOT _more").select("value", *split, "_ing_row")

    # a record of several lines: from the line that opens it to the one that closes it; its key is its first line
    some = told.filter("_inside OR _more")
    so_far = Window.partitionBy(*split).orderBy("_ing_row").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("_first", F.last(F.when(~F.col("_inside"), F.struct("_ing_block", "_ing_row")), ignorenulls=True).over(so_far))
    ends = some.groupBy(*split).agg(F.max(F.struct("_ing_row", "_first")).alias("end"))
    earlier = F.last("end._first", ignorenulls=True).over(Window.partitionBy("_ing_file").orderBy("_ing_block").rowsBetween(Window.unboundedPreceding, -1))
    some = some.join(ends.select(*split, earlier.alias("_earlier")), split).withColumn("_first", F.coalesce("_first", "_earlier"))
    sized = some.groupBy("_ing_file", "_first").agg(F.count("*").alias("n"))
    few = sized.select("_ing_file", "_first", F.when(F.col("n") > MAX_LINES, F.raise_error(F.format_string("%s has a record of %s lines", "_ing_file", "n")).cast("boolean")).otherwise(True).alias("_ok"))
    some = some.join(few.filter("_ok"), ["_ing_file", "_first"])
    joined = some.groupBy("_ing_file", "_first").agg(F.sort_array(F.collect_list(F.struct("_ing_block", "_ing_row", "value"))).alias("lines"))
    several = joined.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"), "_ing_file", F.col("_first._ing_block").alias("_ing_block"), F.col("_first._ing_row").alias("_ing_row"))
    return single.unionByName(several)


def csv_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, first records' places (_ing_file, _ing_row)) of ``lines`` with their ingest order."""
    lines = lines.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    opened, _ = quote_states(F.col("value"))
    filled = F.when(F.trim("value") != "", F.col("_ing_row"))
    splits = written(lines.groupBy("_ing_file", "_ing_block").agg(F.min(filled).alias("_ing_row"), F.count_if(opened).alias("opened")), "scanned")
    first = splits.groupBy("_ing_file").agg(F.min("_ing_row").alias("_ing_row"), F.sum("opened").alias("opened")).filter("_ing_row IS NOT NULL")
    places = first.select("_ing_file", "_ing_row")
    several = first.filter("opened > 0").select("_ing_file")
    if not several.limit(1).count():
        return lines, places
    return lines.join(several, "_ing_file", "left_anti").unionByName(assemble(lines.join(several, "_ing_file", "left_semi"))), places
