"""Mergeable summaries of the flows: quantile sketches and key bitmaps per year and flow.

Any year range is answered by merging the stored rows of its years, without touching the flows again:

* ``value_sketches`` holds, per year and flow label, the exact count, least, greatest and sum of a value and a KLL sketch
  of it. ``range_distribution`` merges them; its quantiles are approximate with the rank error of ``rank_error``,
  everything else is exact (``quality.distribution`` stays the exact way).
* ``key_bitmaps`` holds the set of a key's numbers as bitmaps (one row per 32 768 numbers), so that distinct counts add
  up over years exactly. ``distinct_in_range`` merges them.

Both are aggregated map-side; a row of either is bounded (a sketch by its ``k``, a bitmap by 4 KB), and their number
grows with years, flows and owners, not with flows. NULL values and NULL keys are in no sketch and no bitmap; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.exprs import is_export, is_import, try_number
from tradeweave.operators.quality import QUANTILES
from tradeweave.operators.star import Star
from tradeweave.params import TradeFilter, positive, where_all

#: Accuracy parameter of the sketches (8 to 65535): items kept grow with it, the rank error falls.
SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """Normalised rank error of a quantile, of the published fit for KLL sketches (99 % confidence)."""
    # fixed values of the published fit
    return 2.296 / k ** 0.9723


# --------------------------------------------------------------------------- quantiles
def value_sketches(flows: DataFrame, col: str = "trade_value_usd", by: Sequence[str] = ("year", "flow_code"), k: int = SKETCH_K) -> DataFrame:
    """Per group of ``by``: n, min, max, sum (exact, as decimal) and sketch of ``col``; groups without a value are left out."""
    v = flows.select(*by, try_number(F.col(col)).alias("_v")).where(F.col("_v").isNotNull())
    return v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"),
                              F.sum(F.col("_v").cast("decimal(24,6)")).alias("sum"), F.expr(f"kll_sketch_agg_double(_v, {int(k)})").alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Rows of ``value_sketches`` merged to the coarser groups ``by`` (same columns)."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"),
                                     F.sum("sum").alias("sum"), F.expr(f"kll_merge_agg_double(sketch, {int(k)})").alias("sketch")).where(F.col("n") > 0)


def range_distribution(sketches: DataFrame, f: TradeFilter = TradeFilter(), by: Sequence[str] = ()) -> DataFrame:
    """D1's columns for a year range from stored sketches (2 dp); p25, median, p75 and p95 within ``rank_error``."""
    m = merge_sketches(where_all(sketches, f.year_pred(), f.flow_pred("flow_code")), by)
    probs = ", ".join(f"{p}D" for _, p in QUANTILES)
    q = m.withColumn("_q", F.expr(f"kll_sketch_get_quantile_double(sketch, array({probs}))"))
    at = {name: F.round(F.col("_q")[i], 2).alias(name) for i, (name, _) in enumerate(QUANTILES)}
    return q.select(*by, F.round("min", 2).alias("min"), at["p25"], at["median"],
                    F.round(F.col("sum").cast("double") / F.col("n"), 2).alias("mean"), at["p75"], at["p95"],
                    F.round("max", 2).alias("max"), F.round(F.col("sum").cast("double"), 2).alias("sum"), "n")


def within(error: float) -> Column:
    """Whether a row of ``quantile_ranks`` holds its probability within ``error``."""
    return (F.col("below") - error <= F.col("p")) & (F.col("p") <= F.col("not_above") + error)


def quantile_ranks(flows: DataFrame, quantiles: DataFrame, col: str = "trade_value_usd", by: str = "flow_code") -> DataFrame:
    """Exact ranks of the sketch's quantiles: per group and probability ``p`` the value, the share of values below it and
    the share not above it. One aggregate over the flows with a conditional count per quantile; ``quantiles`` has a row per
    value of ``by`` and is joined to them."""
    names = [n for n, _ in QUANTILES]
    v = flows.select(F.col(by), try_number(F.col(col)).alias("_v")).where(F.col("_v").isNotNull())
    j = v.join(quantiles.select(by, *[F.col(n).alias(f"_{n}") for n in names]), by)
    counts = [c for n in names for c in (F.count_if(F.col("_v") < F.col(f"_{n}")).alias(f"_lt_{n}"), F.count_if(F.col("_v") <= F.col(f"_{n}")).alias(f"_le_{n}"),
                                         F.first(f"_{n}").alias(f"_{n}"))]
    g = j.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *counts)
    each = F.array(*[F.struct(F.lit(n).alias("quantile"), F.lit(p).alias("p"), F.col(f"_{n}").alias("value"),
                              (F.col(f"_lt_{n}") / F.col("n")).alias("below"), (F.col(f"_le_{n}") / F.col("n")).alias("not_above")) for n, p in QUANTILES])
    return g.select(by, "n", F.explode(each).alias("e")).select(by, "n", "e.*")


# --------------------------------------------------------------------------- distinct keys
def key_bitmaps(rows: DataFrame, key: str, by: Sequence[str] = ("year", "flow_direction")) -> DataFrame:
    """Per group of ``by`` the set of ``key`` (whole numbers, NULL left out) as bitmaps: (by…, bucket, bitmap)."""
    n = F.col(key).cast("long")
    return rows.where(n.isNotNull()).groupBy(*by, F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bitmap"))


def merge_bitmaps(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bitmaps of finer groups united to the groups ``by``."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def distinct_in_range(bitmaps: DataFrame, f: TradeFilter = TradeFilter(), by: Sequence[str] = (), name: str = "n_keys") -> DataFrame:
    """Distinct keys of a year range and flow per group of ``by``, from stored bitmaps."""
    kept = where_all(bitmaps, f.year_pred(), f.flow_pred())
    return merge_bitmaps(kept, by).groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias(name))


def distinct_by_range(bitmaps: dict[str, DataFrame]) -> DataFrame:
    """For every range of years that holds a key: distinct keys, one column per entry of ``bitmaps``. They are united
    per year first; each year's bitmap then goes to the ranges that hold it."""
    def counted(name: str, b: DataFrame) -> DataFrame:
        per_year = merge_bitmaps(b.where(F.col("year").isNotNull()), ("year",))
        everywhere = Window.partitionBy()  # one row per year and bucket
        ends = per_year.withColumns({"_lo": F.min("year").over(everywhere), "_hi": F.max("year").over(everywhere)})
        held = ends.withColumn("year_from", F.explode(F.sequence("_lo", "year"))).withColumn("year_to", F.explode(F.sequence("year", "_hi")))
        return merge_bitmaps(held, ("year_from", "year_to")).groupBy("year_from", "year_to").agg(F.sum(F.bitmap_count("bitmap")).alias(name))

    both = reduce(lambda a, b: a.join(b, ["year_from", "year_to"], "full"), [counted(name, b) for name, b in bitmaps.items()])
    return both.fillna(0, list(bitmaps))


def chapters_in_range(bitmaps: DataFrame, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Per partner the distinct chapters imported and exported in a year range, from the chapters' bitmaps per partner."""
    side = F.when(is_import(), "in").when(is_export(), "out")
    sided = where_all(bitmaps, f.year_pred()).withColumn("side", side).where(F.col("side").isNotNull())
    n = F.bitmap_count("bitmap")
    return merge_bitmaps(sided, ("partner_id", "side")).groupBy("partner_id").agg(
        F.sum(F.when(F.col("side") == "in", n).otherwise(0)).alias("import_chapters"),
        F.sum(F.when(F.col("side") == "out", n).otherwise(0)).alias("export_chapters"))


# --------------------------------------------------------------------------- stored with the warehouse
#: Bitmap tables of the cube: name → (key, groups).
BITMAPS = {
    "partner_bitmaps": ("partner_id", ("year", "flow_direction")),
    "chapter_bitmaps": ("commodity_id", ("year", "flow_direction")),
    "partner_chapter_bitmaps": ("commodity_id", ("year", "flow_direction", "partner_id")),
}
SUMMARY_TABLES = ("value_sketches", *BITMAPS)


def summary(star: Star, name: str) -> DataFrame:
    """A summary table of the warehouse, or its plan where the star was not loaded."""
    if name in star.staging:
        return star.staging[name]
    if name == "value_sketches":
        return value_sketches(star.staging["trade_flows"])
    key, by = BITMAPS[name]
    return key_bitmaps(star.fact_trade.where(positive()), key, by)
