"""Mirror-statistics reconciliation (Q24, Q25, Q34, Q35).

The home side comes from ``fact_trade`` (partner = country P), the mirror
side from ``fact_mirror_trade`` (reporter = P): P's exports are home imports
and vice versa. Both sides are aggregated before they meet, so the join is
between small aggregates, never between facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.constants import MIRROR_CHAPTER_FLOOR, MIRROR_FLAG_PCT
from tradeweave.functions.exprs import is_export, is_import
from tradeweave.operators.star import Star
from tradeweave.params import TradeFilter, positive, where_all

def _V() -> Column:
    return F.col("trade_value_usd")


def _disc(a: Column, b: Column) -> Column:
    """|a - b| / max(a, b) * 100 (1 dp), NULL when both are 0."""
    g = F.greatest(a, b)
    return F.when(g > 0, F.round(F.abs(a - b) / g * 100, 1))


def mirror_by_year(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q24: per partner and mirror year, home vs partner-reported values and the
    import/export discrepancy. Years without mirror data are not shown; the
    year range is not applied."""
    pid = f.partner_id
    home = where_all(star.fact_trade, positive(),
                     F.col("partner_id") == pid if pid is not None else F.col("partner_id").isNotNull())
    home = home.groupBy("partner_id", "year").agg(
        F.sum(F.when(is_import(), _V()).otherwise(0.0)).alias("home_imports_usd"),
        F.sum(F.when(is_export(), _V()).otherwise(0.0)).alias("home_exports_usd"))
    mir = where_all(star.fact_mirror_trade, positive(), F.col("year").isNotNull(),
                    F.col("reporter_id") == pid if pid is not None else F.col("reporter_id").isNotNull())
    mir = mir.groupBy(F.col("reporter_id").alias("partner_id"), "year").agg(
        F.sum(F.when(is_export(), _V()).otherwise(0.0)).alias("ptr_exports_to_home"),
        F.sum(F.when(is_import(), _V()).otherwise(0.0)).alias("ptr_imports_from_home"))
    j = mir.join(home, ["partner_id", "year"], "left")
    hi, pe = F.coalesce("home_imports_usd", F.lit(0.0)), F.coalesce("ptr_exports_to_home", F.lit(0.0))
    he, pi = F.coalesce("home_exports_usd", F.lit(0.0)), F.coalesce("ptr_imports_from_home", F.lit(0.0))
    return j.select("partner_id", "year", hi.alias("home_imports_usd"), pe.alias("ptr_exports_to_home"),
                    he.alias("home_exports_usd"), pi.alias("ptr_imports_from_home"),
                    _disc(hi, pe).alias("import_disc_pct"), _disc(he, pi).alias("export_disc_pct"))


def mirror_flags(star: Star, f: TradeFilter = TradeFilter(), threshold: float = MIRROR_FLAG_PCT) -> DataFrame:
    """Q25: '!' flags on discrepancies above ``threshold`` % and, per partner, the
    number of years flagged on either side."""
    m = mirror_by_year(star, f)
    imp, exp = F.col("import_disc_pct"), F.col("export_disc_pct")
    flagged = (F.coalesce(imp, F.lit(0.0)) > threshold) | (F.coalesce(exp, F.lit(0.0)) > threshold)
    return m.select(
        "partner_id", "year",
        (F.col("home_imports_usd") / 1e9).alias("home_imports_b"),
        (F.col("ptr_exports_to_home") / 1e9).alias("ptr_exports_b"),
        (F.col("home_exports_usd") / 1e9).alias("home_exports_b"),
        (F.col("ptr_imports_from_home") / 1e9).alias("ptr_imports_b"),
        imp, exp,
        F.when(imp > threshold, "!").otherwise("").alias("import_flag"),
        F.when(exp > threshold, "!").otherwise("").alias("export_flag"),
        F.count_if(flagged).over(Window.partitionBy("partner_id")).cast("long").alias("years_flagged"),
    )


def mirror_by_chapter(star: Star, floor: float = MIRROR_CHAPTER_FLOOR, n: int = 10) -> DataFrame:
    """Q34: (year, partner, chapter) inner join of both facts where both the home
    imports and the partner's exports exceed ``floor``; top n by import
    discrepancy (1 dp). Values in millions (2 dp)."""
    com = star.dim("dim_commodity").select("commodity_id", "hs_chapter", "description")
    home = star.fact_trade.where(positive()).join(com, "commodity_id").groupBy(
        "year", "partner_id", "hs_chapter", "description").agg(
        F.sum(F.when(is_import(), _V())).alias("_hi"), F.sum(F.when(is_export(), _V())).alias("_he"))
    mir = star.fact_mirror_trade.where(positive()).join(com.drop("description"), "commodity_id").groupBy(
        "year", F.col("reporter_id").alias("partner_id"), "hs_chapter").agg(
        F.sum(F.when(is_export(), _V())).alias("_pe"), F.sum(F.when(is_import(), _V())).alias("_pi"))
    j = home.join(mir, ["year", "partner_id", "hs_chapter"]) \
        .join(star.dim("dim_country").select("country_id", "country_name"),
              F.col("partner_id") == F.col("country_id"))
    hi, pe = F.coalesce("_hi", F.lit(0.0)), F.coalesce("_pe", F.lit(0.0))
    j = j.where((hi > floor) & (pe > floor))
    g = F.greatest(hi, pe)
    out = j.select(
        F.col("country_name").alias("partner"), "year", "hs_chapter", "description",
        F.round(F.col("_hi") / 1e6, 2).alias("home_imports_m"),
        F.round(F.col("_pe") / 1e6, 2).alias("ptr_exports_m"),
        F.round(F.col("_he") / 1e6, 2).alias("home_exports_m"),
        F.round(F.col("_pi") / 1e6, 2).alias("ptr_imports_m"),
        F.round(F.abs(hi - pe) / F.when(g != 0, g) * 100, 1).alias("import_disc_pct"),
    )
    return out.orderBy(F.col("import_disc_pct").desc_nulls_last(), "partner", "year", "hs_chapter").limit(n)


def interpret_disc(disc: DataFrame) -> DataFrame:
    """Q35: reading of each chapter discrepancy."""
    return disc.withColumn("interpretation", F.when(
        F.col("home_imports_m") < F.col("ptr_exports_m"),
        "Re-export route likely (home imports via intermediary)").otherwise(
        "Home reports more — possible classification gap"))
