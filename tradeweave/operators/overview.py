"""Overview: dataset summary, annual balance, KPIs, top partners, rollup, section mix
(Q1–Q10) and the load-time summaries (L12–L15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.exprs import is_export, is_import, pct_change
from tradeweave.operators.star import Star
from tradeweave.params import TradeFilter, positive, where_all

def _V() -> Column:
    return F.col("trade_value_usd")


def _b(c: Column, dp: int = 3) -> Column:
    return F.round(c / 1e9, dp)


def dataset_summary(star: Star) -> DataFrame:
    """Q1: records, distinct partners, year range and total (billions, 1 dp) of positive flows.
    On the base cube the record count is the sum of its per-key counts."""
    ft = star.fact_trade
    records = F.sum("n_records") if "n_records" in ft.columns else F.count(F.lit(1))
    return ft.where(positive()).agg(
        records.alias("trade_records"),
        F.count_distinct("partner_id").cast("long").alias("trading_partners"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        _b(F.sum(_V()), 1).alias("total_trade_b"),
    )


def chapter_count(star: Star) -> DataFrame:
    """Q2: number of chapters in the commodity dimension."""
    return star.dim_commodity.agg(F.count(F.lit(1)).alias("chapters"))


def year_bounds(star: Star) -> DataFrame:
    """Q3: first and last year of the time dimension."""
    return star.dim_time.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))


def has_rows(df: DataFrame) -> bool:
    """Q4: non-empty probe (reads at most one row)."""
    return not df.isEmpty()


def annual_balance(star: Star) -> DataFrame:
    """Q5: imports, exports and active partners per year (flow filter not applied)."""
    return star.fact_trade.where(positive()).groupBy("year").agg(
        F.sum(F.when(is_import(), _V()).otherwise(0.0)).alias("imports_usd"),
        F.sum(F.when(is_export(), _V()).otherwise(0.0)).alias("exports_usd"),
        F.count_distinct("partner_id").cast("long").alias("active_partners"),
    )


def overview_kpis(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q6: totals over the year range, balance, peak active partners, and the
    last year's change against the exact prior calendar year (NULL if that
    year is missing or 0; divided by |prior|)."""
    a = annual_balance(star)
    if f.year_max is not None:
        # only the range and the prior year are read (a filter on the grouping
        # column reaches the scan as a partition filter)
        keep = F.col("year") <= f.year_max
        if f.year_min is not None:
            keep = keep & (F.col("year") >= min(f.year_min, f.year_max - 1))
        a = a.where(keep)
    hi = F.lit(f.year_max) if f.year_max is not None else F.max("year").over(Window.partitionBy())
    a = a.withColumn("_hi", hi)
    in_range = F.lit(True)
    if f.year_min is not None:
        in_range = in_range & (F.col("year") >= f.year_min)
    in_range = in_range & (F.col("year") <= F.col("_hi"))
    cur = F.col("year") == F.col("_hi")
    prev = F.col("year") == F.col("_hi") - 1
    out = a.agg(
        F.coalesce(F.sum(F.when(in_range, F.col("imports_usd"))), F.lit(0.0)).alias("total_imports"),
        F.coalesce(F.sum(F.when(in_range, F.col("exports_usd"))), F.lit(0.0)).alias("total_exports"),
        F.coalesce(F.max(F.when(in_range, F.col("active_partners"))), F.lit(0)).cast("long").alias("total_partners"),
        *[F.max(F.when(cur, F.col(c))).alias(f"_c_{c}") for c in ("imports_usd", "exports_usd", "active_partners")],
        *[F.max(F.when(prev, F.col(c))).alias(f"_p_{c}") for c in ("imports_usd", "exports_usd", "active_partners")],
    )
    return out.select(
        "total_imports", "total_exports",
        (F.col("total_exports") - F.col("total_imports")).alias("trade_balance"),
        "total_partners",
        pct_change(F.col("_c_imports_usd"), F.col("_p_imports_usd"), abs_base=True).alias("imports_yoy_pct"),
        pct_change(F.col("_c_exports_usd"), F.col("_p_exports_usd"), abs_base=True).alias("exports_yoy_pct"),
        pct_change(F.col("_c_active_partners").cast("double"), F.col("_p_active_partners").cast("double"),
                   abs_base=True).alias("partners_yoy_pct"),
    )


def balance_series(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q7: imports, exports and balance per year in billions, over the year range."""
    a = where_all(annual_balance(star), f.year_pred())
    return a.orderBy("year").select("year", (F.col("imports_usd") / 1e9).alias("imports_b"),
                    (F.col("exports_usd") / 1e9).alias("exports_b"),
                    ((F.col("exports_usd") - F.col("imports_usd")) / 1e9).alias("balance_b"))


def _partner_totals(star: Star, f: TradeFilter) -> DataFrame:
    # by id first, then the names
    ft = where_all(star.fact_trade, positive(), f.year_pred(), f.flow_pred())
    totals = ft.groupBy(F.col("partner_id").alias("country_id")).agg(F.sum(_V()).alias("_v"))
    named = totals.join(star.dim("dim_country"), "country_id")
    return named.groupBy("country_name", "region").agg(_b(F.sum("_v")).alias("trade_value_b")) \
        .select("country_name", F.coalesce("region", F.lit("Unknown")).alias("region"), "trade_value_b")


def top_partners(star: Star, f: TradeFilter = TradeFilter(), n: int = 20) -> DataFrame:
    """Q8: top-n partners by value (billions, 3 dp) with region ('Unknown' if missing)."""
    return _partner_totals(star, f).orderBy(F.col("trade_value_b").desc(), "country_name", "region").limit(n)


def partner_rollup(star: Star, f: TradeFilter = TradeFilter(), n: int = 20) -> DataFrame:
    """Q9: treemap totals all → region → country over the top-n partners."""
    top = top_partners(star, f, n)
    r = top.rollup("region", "country_name").agg(F.round(F.sum("trade_value_b"), 3).alias("trade_value_b"),
                                                 F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, "country").when(F.col("_g") == 1, "region").otherwise("all")
    return r.select(level.alias("level"), "region", "country_name", "trade_value_b")


def section_mix(star: Star, f: TradeFilter = TradeFilter(), n: int = 15) -> DataFrame:
    """Q10: imports/exports per section (billions, 3 dp), top-n by the rounded sum.
    The flow option is not applied (only the year range)."""
    ft = star.fact_trade
    j = where_all(ft.join(star.dim("dim_commodity"), "commodity_id"), positive(), f.year_pred())
    s = j.groupBy("section_name").agg(
        _b(F.sum(F.when(is_import(), _V()).otherwise(0.0))).alias("imports_b"),
        _b(F.sum(F.when(is_export(), _V()).otherwise(0.0))).alias("exports_b"),
    ).select(F.coalesce("section_name", F.lit("Unknown")).alias("section_name"), "imports_b", "exports_b")
    return s.orderBy((F.col("imports_b") + F.col("exports_b")).desc(), "section_name").limit(n)


# --------------------------------------------------------------------------- L12–L15
def annual_by_period(star: Star) -> DataFrame:
    """imports/exports/total per year (billions, 3 dp) with the period label."""
    ft = star.fact_trade
    j = ft.join(star.dim("dim_time"), "year").where(positive())
    return j.groupBy("year", "period_label").agg(
        _b(F.sum(F.when(F.col("flow_direction") == "Import", _V()).otherwise(0.0))).alias("imports_b"),
        _b(F.sum(F.when(F.col("flow_direction") == "Export", _V()).otherwise(0.0))).alias("exports_b"),
        _b(F.sum(_V())).alias("total_b"),
    )


def top_partners_dir(star: Star, direction: str, n: int = 5) -> DataFrame:
    """Top-n partners for one flow direction, with the number of years present."""
    col = f"{direction.lower()}_value_b"
    ft = star.fact_trade.where((F.col("flow_direction") == direction) & positive())
    # by id and year first, then the names
    per_year = ft.groupBy(F.col("partner_id").alias("country_id"), "year").agg(F.sum(_V()).alias("_v"))
    totals = per_year.groupBy("country_id").agg(F.sum("_v").alias("_v"), F.count("year").cast("long").alias("years_present"))
    g = totals.join(star.dim("dim_country"), "country_id").select("country_name", "iso3_code", _b(F.col("_v")).alias(col), "years_present")
    return g.orderBy(F.col(col).desc(), "country_name", "iso3_code").limit(n)


def top_chapters(star: Star, n: int = 10) -> DataFrame:
    """Top-n chapters by total value (billions, 3 dp)."""
    j = star.fact_trade.join(star.dim("dim_commodity"), "commodity_id").where(positive())
    g = j.groupBy("hs_chapter", "description").agg(_b(F.sum(_V())).alias("total_b"))
    return g.orderBy(F.col("total_b").desc(), "hs_chapter").limit(n)
