"""Partner deep-dive (Q17–Q23).

The dashboard evaluates these for one selected partner at a time; here every
operator returns all partners at once (``partner_id`` column), windows are
partitioned by partner, and ``TradeFilter.partner_id`` narrows to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.exprs import is_export, is_import
from tradeweave.operators.star import Star
from tradeweave.params import TradeFilter, positive, where_all

def _V() -> Column:
    return F.col("trade_value_usd")


def _partner_pred(f: TradeFilter, col: str = "partner_id") -> Column:
    return F.col(col).isNotNull() if f.partner_id is None else F.col(col) == f.partner_id


def partner_directory(star: Star) -> DataFrame:
    """Q17: partners with region/income defaults and total trade (billions, 2 dp)."""
    ft = star.fact_trade.where(positive())
    # by id first, then the names
    totals = ft.groupBy(F.col("partner_id").alias("country_id")).agg(F.round(F.sum(_V()) / 1e9, 2).alias("total_trade_b"))
    g = star.dim("dim_country").join(totals, "country_id")
    return g.orderBy("country_name").select("country_id", "country_name", "iso3_code",
                    F.coalesce("region", F.lit("Unknown")).alias("region"),
                    F.coalesce("income_group", F.lit("")).alias("income_group"), "total_trade_b")


def _direction() -> Column:
    return F.when(is_import(), "imp").when(is_export(), "exp")


def partner_annual(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q18: per partner and year: imports, exports, balance, total, distinct import /
    export chapters, and change vs the previous *present* year (LAG; 1 dp,
    NULL unless the previous value is positive).

    Distinct chapter counts come from a pre-aggregation to (partner, year,
    chapter, direction) instead of two conditional COUNT DISTINCTs.
    """
    ft = where_all(star.fact_trade, positive(), f.year_pred(), _partner_pred(f))
    pre = ft.groupBy("partner_id", "year", "commodity_id", _direction().alias("_dir")).agg(F.sum(_V()).alias("_v"))
    imp, exp = F.col("_dir") == "imp", F.col("_dir") == "exp"
    a = pre.groupBy("partner_id", "year").agg(
        F.sum(F.when(imp, F.col("_v")).otherwise(0.0)).alias("imports_usd"),
        F.sum(F.when(exp, F.col("_v")).otherwise(0.0)).alias("exports_usd"),
        F.count_if(imp & F.col("commodity_id").isNotNull()).cast("long").alias("import_chapters"),
        F.count_if(exp & F.col("commodity_id").isNotNull()).cast("long").alias("export_chapters"),
    )
    w = Window.partitionBy("partner_id").orderBy(F.col("year").asc_nulls_last())
    pi, pe = F.lag("imports_usd").over(w), F.lag("exports_usd").over(w)
    return a.select(
        "partner_id", "year", "imports_usd", "exports_usd",
        (F.col("exports_usd") - F.col("imports_usd")).alias("balance_usd"),
        (F.col("imports_usd") + F.col("exports_usd")).alias("total_usd"),
        "import_chapters", "export_chapters",
        F.when(pi > 0, F.round((F.col("imports_usd") - pi) / pi * 100, 1)).alias("imports_yoy_pct"),
        F.when(pe > 0, F.round((F.col("exports_usd") - pe) / pe * 100, 1)).alias("exports_yoy_pct"),
    )


def partner_kpis(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q19: per partner totals, balance, and the latest year's change figures."""
    a = partner_annual(star, f)
    return a.groupBy("partner_id").agg(
        F.sum("imports_usd").alias("total_imports"),
        F.sum("exports_usd").alias("total_exports"),
        (F.sum("exports_usd") - F.sum("imports_usd")).alias("trade_balance"),
        (F.sum("imports_usd") + F.sum("exports_usd")).alias("total_trade"),
        F.max("year").alias("latest_year"),
        F.max_by("imports_yoy_pct", "year").alias("latest_imports_yoy_pct"),
        F.max_by("exports_yoy_pct", "year").alias("latest_exports_yoy_pct"),
    )


def macro_latest(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q20: latest macro row (year, GDP, population, per capita) per country."""
    s = where_all(star.fact_country_stats, _partner_pred(f, "country_id"))
    row = F.struct("year", "gdp_usd", "population", "gdp_per_capita")
    return s.groupBy("country_id").agg(F.max_by(row, "year").alias("_r")) \
        .select("country_id", "_r.year", "_r.gdp_usd", "_r.population", "_r.gdp_per_capita")


def partner_top_chapters(star: Star, f: TradeFilter = TradeFilter(), n: int = 15) -> DataFrame:
    """Q21: per partner, the n chapters with the largest total (unrounded ranking)."""
    ft = where_all(star.fact_trade, positive(), f.year_pred(), _partner_pred(f))
    j = ft.join(star.dim("dim_commodity"), "commodity_id")
    g = j.groupBy("partner_id", "hs_chapter", "description", "section_name").agg(
        F.sum(F.when(is_import(), _V()).otherwise(0.0)).alias("imports_usd"),
        F.sum(F.when(is_export(), _V()).otherwise(0.0)).alias("exports_usd"))
    total = F.col("imports_usd") + F.col("exports_usd")
    w = Window.partitionBy("partner_id").orderBy(total.desc(), "hs_chapter")
    r = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return r.select("partner_id", "hs_chapter", "description", "section_name",
                    F.round(F.col("imports_usd") / 1e9, 3).alias("imports_b"),
                    F.round(F.col("exports_usd") / 1e9, 3).alias("exports_b"),
                    F.round(total / 1e9, 3).alias("total_b")).orderBy("partner_id", F.col("total_b").desc(), "hs_chapter")


def partner_share(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q22: partner share (%, 2 dp) of all imports / exports per year, for years the
    partner is present. One scan: per (year, partner) sums, totals by a year window."""
    ft = where_all(star.fact_trade, positive(), f.year_pred())
    g = ft.groupBy("year", "partner_id").agg(
        F.sum(F.when(is_import(), _V()).otherwise(0.0)).alias("_pi"),
        F.sum(F.when(is_export(), _V()).otherwise(0.0)).alias("_pe"))
    by_year = Window.partitionBy("year")
    g = g.withColumns({"_ti": F.sum("_pi").over(by_year), "_te": F.sum("_pe").over(by_year)})
    g = g.where(_partner_pred(f))
    return g.select("partner_id", "year",
                    F.round(F.col("_pi") / F.when(F.col("_ti") != 0, F.col("_ti")) * 100, 2).alias("import_share_pct"),
                    F.round(F.col("_pe") / F.when(F.col("_te") != 0, F.col("_te")) * 100, 2).alias("export_share_pct"))


def mirror_available(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q23: mirror rows available per reporting partner."""
    m = where_all(star.fact_mirror_trade, _partner_pred(f, "reporter_id"))
    return m.groupBy(F.col("reporter_id").alias("partner_id")).agg(F.count(F.lit(1)).alias("mirror_rows"))
