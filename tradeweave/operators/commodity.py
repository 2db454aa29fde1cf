"""Commodity explorer (Q26–Q28, Q30–Q33, Q36).

The dashboard looks at one section (or chapter) at a time; these operators
answer all sections at once, with windows partitioned by section / chapter.
``TradeFilter.section`` / ``chapter`` narrow to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.constants import EMERGING_FLOOR, QUARTILE_LABELS
from tradeweave.functions.exprs import is_export, is_import
from tradeweave.operators.star import Star
from tradeweave.params import TradeFilter, positive, where_all

def _V() -> Column:
    return F.col("trade_value_usd")


def _b(c: Column, dp: int = 3) -> Column:
    return F.round(c / 1e9, dp)


def year_range(star: Star, f: TradeFilter) -> tuple[int, int]:
    """Inclusive year range of the filter; open ends come from the time dimension (tiny)."""
    if f.year_min is not None and f.year_max is not None:
        return f.year_min, f.year_max
    row = star.dim_time.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).first()
    return (f.year_min if f.year_min is not None else row["lo"],
            f.year_max if f.year_max is not None else row["hi"])


def _section_rows(star: Star, f: TradeFilter, *, country: bool = False, flow: bool = True,
                  only_positive: bool = True) -> DataFrame:
    ft = star.fact_trade
    j = ft.join(star.dim("dim_commodity"), "commodity_id")
    if country:
        j = j.join(star.dim("dim_country"), ft.partner_id == F.col("country_id"))
    return where_all(j, positive() if only_positive else None, f.flow_pred() if flow else None, f.year_pred(),
                     F.col("section_name") == f.section if f.section is not None else None,
                     F.col("hs_chapter") == f.chapter if f.chapter is not None else None)


def section_directory(star: Star) -> DataFrame:
    """Q26: sections with their total value (billions, 2 dp)."""
    j = star.dim("dim_commodity").join(star.fact_trade.where(positive()), "commodity_id")
    return j.groupBy("section_name").agg(_b(F.sum(_V()), 2).alias("total_b")).orderBy(F.col("total_b").desc(), "section_name")


def section_kpis(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q27: per section total, chapters, partners, last and prior year values and the
    change between them (prior year counts only inside the range; computed on
    the rounded billions, as displayed)."""
    lo, hi = year_range(star, f)
    rows = _section_rows(star, f.with_(year_min=lo, year_max=hi))
    # distinct counts over one row per (section, chapter, partner, year), not over all facts
    j = rows.groupBy("section_name", "hs_chapter", "partner_id", "year").agg(F.sum(_V()).alias("trade_value_usd"))
    g = j.groupBy("section_name").agg(
        _b(F.sum(_V())).alias("total_b"),
        F.count_distinct("hs_chapter").cast("long").alias("chapter_count"),
        F.count_distinct("partner_id").cast("long").alias("partner_count"),
        _b(F.sum(F.when(F.col("year") == hi, _V()))).alias("curr_yr_b"),
        _b(F.sum(F.when(F.col("year") == hi - 1, _V()))).alias("prev_yr_b"),
    )
    cur, prev = F.coalesce("curr_yr_b", F.lit(0.0)), F.coalesce("prev_yr_b", F.lit(0.0))
    return g.withColumn("yoy_pct", F.when(prev != 0, (cur - prev) / prev * 100))


def section_partners(star: Star, f: TradeFilter = TradeFilter(), n: int = 15) -> DataFrame:
    """Q28: per section the top-n partners by the rounded import + export sum."""
    j = _section_rows(star, f, country=True)
    g = j.groupBy("section_name", "country_name", "iso3_code").agg(
        _b(F.sum(F.when(is_import(), _V()).otherwise(0.0))).alias("imports_b"),
        _b(F.sum(F.when(is_export(), _V()).otherwise(0.0))).alias("exports_b"))
    w = Window.partitionBy("section_name").orderBy((F.col("imports_b") + F.col("exports_b")).desc(),
                                                   "country_name", "iso3_code")
    return g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).orderBy("section_name", "_rn").drop("_rn")


def emerging_periods(lo: int, hi: int, period_len: int | None = None) -> tuple[int, int, int]:
    """(period_len, early_end, recent_start): default length max(1, min(3, span // 2))."""
    pl = period_len if period_len is not None else max(1, min(3, (hi - lo + 1) // 2))
    return pl, lo + pl - 1, hi - pl + 1


def emerging_suppliers(star: Star, f: TradeFilter = TradeFilter(), floor: float = EMERGING_FLOOR, n: int = 10,
                       period_len: int | None = None, positive_only: bool = True,
                       with_region: bool = True) -> DataFrame:
    """Q30 (and Q36 via its parameters): early vs recent period averages per supplier,
    new-entrant flag, growth % (1 dp), growth quartile (NTILE(4), NULLs last),
    recent average above ``floor``; new entrants first, top n per section.

    One scan with two conditional sums replaces the two period scans and their
    FULL OUTER JOIN; suppliers are keyed by country, carrying name/ISO3/region.
    """
    lo, hi = year_range(star, f)
    pl, early_end, recent_start = emerging_periods(lo, hi, period_len)
    y = F.col("year")
    early, recent = y.between(lo, early_end), y.between(recent_start, hi)
    j = _section_rows(star, f.with_(year_min=None, year_max=None), country=True, only_positive=positive_only)
    j = j.where(early | recent)
    keys = ["section_name", "country_id", F.col("country_name").alias("partner"), "iso3_code"]
    if with_region:
        keys.append(F.coalesce("region", F.lit("Other")).alias("region"))
    g = j.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(early, _V())), F.lit(0.0)) / float(pl)).alias("early_avg_usd"),
        (F.coalesce(F.sum(F.when(recent, _V())), F.lit(0.0)) / float(pl)).alias("recent_avg_usd"),
    ).where(F.col("recent_avg_usd") > floor)
    g = g.withColumns({
        "is_new_entrant": F.col("early_avg_usd") == 0,
        "growth_pct": F.when(F.col("early_avg_usd") > 0, F.round(
            (F.col("recent_avg_usd") - F.col("early_avg_usd")) / F.col("early_avg_usd") * 100.0, 1)),
    })
    by_sec = Window.partitionBy("section_name")
    g = g.withColumn("growth_q", F.ntile(4).over(
        by_sec.orderBy(F.col("growth_pct").desc_nulls_last(), "iso3_code", "partner")).cast("long"))
    rank = by_sec.orderBy(F.when(F.col("is_new_entrant"), F.col("recent_avg_usd")).otherwise(0.0).desc(),
                          F.coalesce("growth_pct", F.lit(-9999.0)).desc(), "iso3_code", "partner")
    g = g.withColumn("_rn", F.row_number().over(rank)).where(F.col("_rn") <= n)
    cols = ["section_name", "partner", "iso3_code"] + (["region"] if with_region else []) + [
        "is_new_entrant", F.round(F.col("early_avg_usd") / 1e6, 1).alias("early_avg_m"),
        F.round(F.col("recent_avg_usd") / 1e6, 1).alias("recent_avg_m"), "growth_pct", "growth_q"]
    return g.orderBy("section_name", "_rn").select(*cols)


def emerging_labels(emerging: DataFrame) -> DataFrame:
    """Q31: display labels — growth ('New entrant', '+12.3%', 'N/A') and quartile tier."""
    q = F.col("growth_q")
    tier = None
    for k, label in QUARTILE_LABELS.items():
        tier = F.when(q == k, label) if tier is None else tier.when(q == k, label)
    return emerging.withColumns({
        "growth_label": F.when(F.col("is_new_entrant"), "New entrant")
        .when(F.col("growth_pct").isNotNull(), F.format_string("%+.1f%%", F.col("growth_pct")))
        .otherwise("N/A"),
        "quartile_label": F.when(F.col("is_new_entrant"), "New").when(q.isNotNull(), tier.otherwise("—"))
        .otherwise("—"),
    })


def section_chapters(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q32: chapters of each section with imports, exports, total (billions, 3 dp) and
    rank by the rounded total."""
    j = _section_rows(star, f)
    g = j.groupBy("section_name", "hs_chapter", "description").agg(
        _b(F.sum(F.when(is_import(), _V()).otherwise(0.0))).alias("imports_b"),
        _b(F.sum(F.when(is_export(), _V()).otherwise(0.0))).alias("exports_b"))
    tot = F.col("imports_b") + F.col("exports_b")
    w = Window.partitionBy("section_name").orderBy(tot.desc(), "hs_chapter")
    return g.select("*", F.round(tot, 3).alias("total_b"), F.row_number().over(w).cast("long").alias("rank")) \
        .orderBy("section_name", "rank")


def chapter_partners(star: Star, f: TradeFilter = TradeFilter(), n: int = 5) -> DataFrame:
    """Q33: per chapter the top-n partners (billions, 4 dp)."""
    j = _section_rows(star, f, country=True)
    g = j.groupBy("hs_chapter", "country_name", "iso3_code").agg(
        F.round(F.sum(F.when(is_import(), _V()).otherwise(0.0)) / 1e9, 4).alias("imports_b"),
        F.round(F.sum(F.when(is_export(), _V()).otherwise(0.0)) / 1e9, 4).alias("exports_b"),
        F.round(F.sum(_V()) / 1e9, 4).alias("total_b"))
    w = Window.partitionBy("hs_chapter").orderBy(F.col("total_b").desc(), "country_name", "iso3_code")
    return g.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).orderBy("hs_chapter", "_rn").drop("_rn")
