"""Supplier concentration: HHI per section-year, trend, matrix, single-source alerts.

Shares are computed after a pre-aggregation to (year, section, partner), so
the window that carries the section-year total only ever sees one row per
partner — a hot partner costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.constants import ALERT_HIGH_SHARE, ALERT_MIN_SHARE, HHI_HIGH, HHI_MODERATE
from tradeweave.operators.star import Star
from tradeweave.params import TradeFilter, positive, where_all


def _section_partner(star: Star, f: TradeFilter, with_country: bool) -> DataFrame:
    ft = star.fact_trade
    j = ft.join(star.dim("dim_commodity"), "commodity_id")
    if with_country:
        j = j.join(star.dim("dim_country"), ft.partner_id == F.col("country_id"))
    j = where_all(j, positive(), f.flow_pred(), f.year_pred(), F.col("section_name").isNotNull(),
                  F.col("section_name") == f.section if f.section is not None else None)
    keys = ["year", "section_name", "partner_id"] + (["country_name"] if with_country else [])
    return j.groupBy(*keys).agg(F.sum("trade_value_usd").alias("trade_value"))


def _with_share(df: DataFrame, *part: str) -> DataFrame:
    w = Window.partitionBy(*part)
    return df.withColumn("share_pct", F.col("trade_value") / F.sum("trade_value").over(w) * 100.0)


def hhi_by_section_year(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q11: HHI (0 dp), supplier count, top share (1 dp) and top supplier per section and year."""
    s = _with_share(_section_partner(star, f, True).withColumnRenamed("country_name", "partner_name"),
                    "year", "section_name")
    return s.groupBy("year", "section_name").agg(
        F.round(F.sum(F.col("share_pct") * F.col("share_pct")), 0).alias("hhi"),
        F.count_distinct("partner_name").cast("long").alias("supplier_count"),
        F.round(F.max("share_pct"), 1).alias("top_share_pct"),
        # rows without a name never win (SQL arg_max skips NULL arguments)
        F.max_by("partner_name", F.when(F.col("partner_name").isNotNull(), F.col("share_pct"))).alias("top_supplier"),
    )


def hhi_matrix(star: Star, f: TradeFilter, years: list[int] | None = None) -> DataFrame:
    """Q12: section × year matrix of HHI (one column per year; those of the time dimension unless given)."""
    h = hhi_by_section_year(star, f)
    if years is None:
        years = [r["year"] for r in star.dim_time.select("year").orderBy("year").collect()]  # one row per year
    return h.groupBy("section_name").pivot("year", years).agg(F.first("hhi"))


def risk_summary(star: Star, f: TradeFilter = TradeFilter(), moderate: float = HHI_MODERATE,
                 high: float = HHI_HIGH) -> DataFrame:
    """Q13: high / moderate / low section counts in the latest year (rounded HHI)."""
    h = hhi_by_section_year(star, f)
    h = h.withColumn("_latest", F.max("year").over(Window.partitionBy())).where(F.col("year") == F.col("_latest"))
    hhi = F.col("hhi")
    return h.groupBy(F.col("year").alias("latest_year")).agg(
        F.count_if(hhi >= high).cast("long").alias("n_high"),
        F.count_if((hhi >= moderate) & (hhi < high)).cast("long").alias("n_moderate"),
        F.count_if(hhi < moderate).cast("long").alias("n_low"),
    )


def _section_hhi(star: Star, f: TradeFilter) -> DataFrame:
    s = _with_share(_section_partner(star, f, False), "year", "section_name")
    return s.groupBy("year", "section_name").agg(F.sum(F.col("share_pct") * F.col("share_pct")).alias("hhi"))


def hhi_trend(star: Star, f: TradeFilter = TradeFilter(), moderate: float = HHI_MODERATE,
              high: float = HHI_HIGH) -> DataFrame:
    """Q14: per year avg/min/max HHI (0 dp), section count, band counts on unrounded HHI.

    No country join: an unresolved partner is one (NULL) share.
    """
    hhi = F.col("hhi")
    return _section_hhi(star, f).groupBy("year").agg(
        F.round(F.avg(hhi), 0).alias("avg_hhi"),
        F.round(F.min(hhi), 0).alias("min_hhi"),
        F.round(F.max(hhi), 0).alias("max_hhi"),
        F.count(F.lit(1)).cast("long").alias("section_count"),
        F.count_if(hhi >= high).cast("long").alias("n_high"),
        F.count_if((hhi >= moderate) & (hhi < high)).cast("long").alias("n_moderate"),
        F.count_if(hhi < moderate).cast("long").alias("n_low"),
    )


def single_source_alerts(star: Star, f: TradeFilter = TradeFilter(), min_share: float = ALERT_MIN_SHARE,
                         high_share: float = ALERT_HIGH_SHARE) -> DataFrame:
    """Q15: chapters whose top supplier holds more than ``min_share`` % (rounded to 1 dp)."""
    ft = star.fact_trade
    j = ft.join(star.dim("dim_commodity"), "commodity_id").join(
        star.dim("dim_country"), ft.partner_id == F.col("country_id"))
    j = where_all(j, positive(), f.flow_pred(), f.year_pred(), F.col("iso3_code").isNotNull())
    cp = j.groupBy("hs_chapter", "description", "section_name",
                   F.col("country_name").alias("supplier"), F.col("iso3_code").alias("supplier_iso3")) \
        .agg(F.sum("trade_value_usd").alias("supplier_value"))
    by_ch = Window.partitionBy("hs_chapter")
    ranked = cp.withColumns({
        "chapter_total": F.sum("supplier_value").over(by_ch),
        "supplier_rank": F.row_number().over(by_ch.orderBy(F.col("supplier_value").desc(), "supplier_iso3",
                                                           "supplier")),
    }).where(F.col("supplier_rank") == 1)
    ranked = ranked.withColumn("share_pct", F.round(F.col("supplier_value") / F.col("chapter_total") * 100.0, 1))
    return ranked.where(F.col("share_pct") > min_share).select(
        F.when(F.col("share_pct") >= high_share, "HIGH").otherwise("MODERATE").alias("risk_level"),
        "hs_chapter", "description", "section_name", "supplier", "supplier_iso3", "share_pct",
        F.round(F.col("supplier_value") / 1e9, 3).alias("supplier_value_b"),
        F.round(F.col("chapter_total") / 1e9, 3).alias("chapter_total_b"),
    ).orderBy(F.col("share_pct").desc(), "hs_chapter")


def alert_counts(alerts: DataFrame, high_share: float = ALERT_HIGH_SHARE) -> DataFrame:
    """Q16: number of alerts, HIGH and MODERATE."""
    return alerts.agg(F.count(F.lit(1)).cast("long").alias("n_alerts"),
                      F.count_if(F.col("share_pct") >= high_share).cast("long").alias("n_high"),
                      F.count_if(F.col("share_pct") < high_share).cast("long").alias("n_moderate"))


def diversification(star: Star, f: TradeFilter = TradeFilter()) -> DataFrame:
    """Q29: per section and year, supplier count (NULL partner not counted) and HHI
    (NULL partner is a share), 0 dp."""
    s = _with_share(_section_partner(star, f, False), "section_name", "year")
    return s.groupBy("section_name", "year").agg(
        F.count_distinct("partner_id").cast("long").alias("supplier_count"),
        F.round(F.sum(F.col("share_pct") * F.col("share_pct")), 0).alias("hhi"),
    )
