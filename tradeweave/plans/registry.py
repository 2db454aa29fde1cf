"""Registered queries: name → (Spark callable, DuckDB oracle SQL or None).

Every callable takes ``(spark, sf_dir)``, builds the stand-in raw inputs of
``sf_dir``, runs the library's own cleaning and star load on them and then
the operator. Test parameters (thresholds, selections) are the ones listed in
``PARAMS``; operator defaults stay the reference values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.constants import HS_SECTIONS
from tradeweave.operators import commodity as COM
from tradeweave.operators import concentration as CON
from tradeweave.operators import mirror as MIR
from tradeweave.operators import overview as OV
from tradeweave.operators import partner as PAR
from tradeweave.params import TradeFilter
from tradeweave.plans import oracle as O
from tradeweave.plans.incremental import fact_of, load_increment
from tradeweave.plans.warehouse import standin_star
from tradeweave.session import ensure_checkpoint_dir, written
from tradeweave.sources.files import RAW_FLOW_COLUMNS, read_raw
from tradeweave.sources.landing import land_incremental, landed_rows
from tradeweave.sources.payloads import flatten_countries, flatten_indicator
from tradeweave.sources.standin import iso3_of

QueryFn = Callable[[SparkSession, str], DataFrame]
StarFn = Callable[["Star"], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}
#: The same queries as functions of an already built (or materialized) star.
ON_STAR: dict[str, StarFn] = {}

IMPORTS = TradeFilter(flow="Imports")
EXPORTS = TradeFilter(flow="Exports")
ALL = TradeFilter()
#: Test parameters for the stand-in data, whose partner shares are near uniform
#: (reference defaults in the operator signatures: HHI 1500/2500, alerts 50/70).
PARAMS = {
    "hhi_bands": (550.0, 720.0),
    "trend_bands": (640.0, 700.0),
    "alert_shares": (9.0, 10.0),
    "kpi_years": (1996, 2000),
}
_klo, _khi = PARAMS["kpi_years"]
RANGE = TradeFilter(year_min=_klo, year_max=_khi)
#: One chapter and partner that the stand-in data have, and that chapter's section.
CHAPTER, PARTNER = "19", 19
SECTION = next(name for low, high, _code, name in HS_SECTIONS if low <= int(CHAPTER) <= high)


def register(name: str, sql: str | None):
    def deco(impl: StarFn) -> StarFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return impl(standin_star(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = impl.__doc__
        REGISTRY[name] = (run, sql)
        ON_STAR[name] = impl
        return impl
    return deco


def both(name: str, impl: Callable[..., DataFrame], sql: Callable[[TradeFilter], str]) -> None:
    """One query over the test years and one over all years (``_all``)."""
    register(name, sql(RANGE))(lambda s: impl(s, RANGE))
    register(f"{name}_all", sql(ALL))(lambda s: impl(s, ALL))


# --------------------------------------------------------------------------- SQL building blocks
def flows_sql(fact: str = "fact_trade", country: str = "partner_id", only_positive: bool = True, name: str = "flows") -> str:
    """Every row of a fact once, with its names and its direction as two booleans."""
    return f"""{name} AS (
    SELECT t.year, t.{country} AS cid, t.commodity_id AS ch_id, t.trade_value_usd AS v, t.flow_direction AS dir,
        t.flow_direction LIKE '%mport' AS inward, t.flow_direction LIKE '%xport' AS outward,
        m.hs_chapter, m.description, m.section_name, n.country_name, n.iso3_code, n.region, n.income_group
    FROM {fact} t LEFT JOIN dim_commodity m USING (commodity_id) LEFT JOIN dim_country n ON n.country_id = t.{country}
    {"WHERE t.trade_value_usd > 0" if only_positive else ""})"""


FLOWS = flows_sql()
IN_USD, OUT_USD = "COALESCE(SUM(v) FILTER (WHERE inward), 0)", "COALESCE(SUM(v) FILTER (WHERE outward), 0)"


def years_sql(f: TradeFilter, column: str = "year") -> str:
    return "TRUE" if f.year_min is None else f"{column} BETWEEN {f.year_min} AND {f.year_max}"


def last_year_sql(f: TradeFilter, of: str) -> str:
    return str(f.year_max) if f.year_max is not None else of


def flow_sql(f: TradeFilter) -> str:
    return {"Imports": "inward", "Exports": "outward", "Both": "TRUE"}[f.flow]


# =========================================================================== concentration
def share_ctes(f: TradeFilter, named: bool) -> tuple[str, ...]:
    """Supplier shares of a section and year, from one grouping and window totals."""
    who = "country_name" if named else "cid"
    known = "AND country_name IS NOT NULL" if named else ""
    return FLOWS, f"""share AS (
    SELECT year, section_name, {who} AS who, SUM(v) / SUM(SUM(v)) OVER (PARTITION BY year, section_name) * 100.0 AS pct
    FROM flows WHERE {flow_sql(f)} AND section_name IS NOT NULL {known}
    GROUP BY year, section_name, {who})"""


def hhi_ctes(f: TradeFilter) -> tuple[str, ...]:
    return *share_ctes(f, True), """concentration AS (
    SELECT year, section_name, ROUND(SUM(pct * pct), 0) AS hhi, COUNT(*) AS supplier_count, ROUND(MAX(pct), 1) AS top_share_pct,
        arg_max(who, pct) AS top_supplier
    FROM share GROUP BY year, section_name)"""


@register("q11_hhi", O.with_base("SELECT * FROM concentration", *hhi_ctes(IMPORTS)))
def q11_hhi(s):
    return CON.hhi_by_section_year(s, IMPORTS)


@register("q11_hhi_exports", O.with_base("SELECT * FROM concentration", *hhi_ctes(EXPORTS)))
def q11_hhi_exports(s):
    """the same for exports."""
    return CON.hhi_by_section_year(s, EXPORTS)


@register("q12_hhi_matrix", O.with_base(
    "SELECT section_name, " + ", ".join(f'ANY_VALUE(hhi) FILTER (WHERE year = {y}) AS "{y}"' for y in range(1995, 2002))
    + " FROM concentration GROUP BY section_name", *hhi_ctes(IMPORTS)))
def q12_hhi_matrix(s):
    """The years are those of the time dimension."""
    return CON.hhi_matrix(s, IMPORTS)


def band_counts_sql(moderate: float, high: float) -> str:
    return (f"COUNT_IF(hhi >= {high}) AS n_high, COUNT_IF(hhi >= {moderate} AND hhi < {high}) AS n_moderate, "
            f"COUNT_IF(hhi < {moderate}) AS n_low")


@register("q13_risk_summary", O.with_base(f"""
SELECT year AS latest_year, {band_counts_sql(*PARAMS["hhi_bands"])}
FROM (SELECT * FROM concentration QUALIFY RANK() OVER (ORDER BY year DESC NULLS LAST) = 1) GROUP BY year""", *hhi_ctes(IMPORTS)))
def q13_risk_summary(s):
    return CON.risk_summary(s, IMPORTS, *PARAMS["hhi_bands"])


@register("q14_hhi_trend", O.with_base(f"""
SELECT year, ROUND(AVG(hhi), 0) AS avg_hhi, ROUND(MIN(hhi), 0) AS min_hhi, ROUND(MAX(hhi), 0) AS max_hhi,
    COUNT(hhi) AS section_count, {band_counts_sql(*PARAMS["trend_bands"])}
FROM (SELECT year, section_name, SUM(pct * pct) AS hhi FROM share GROUP BY year, section_name) GROUP BY year""", *share_ctes(IMPORTS, False)))
def q14_hhi_trend(s):
    return CON.hhi_trend(s, IMPORTS, *PARAMS["trend_bands"])


def alert_ctes(f: TradeFilter) -> tuple[str, ...]:
    least, high = PARAMS["alert_shares"]
    return FLOWS, f"""leader AS (
    SELECT *, SUM(own) OVER (PARTITION BY hs_chapter) AS whole,
        ROW_NUMBER() OVER (PARTITION BY hs_chapter ORDER BY own DESC, supplier_iso3, supplier) AS nth
    FROM (SELECT hs_chapter, description, section_name, country_name AS supplier, iso3_code AS supplier_iso3, SUM(v) AS own
        FROM flows WHERE {flow_sql(f)} AND iso3_code IS NOT NULL AND hs_chapter IS NOT NULL
        GROUP BY hs_chapter, description, section_name, country_name, iso3_code))""", f"""alert AS (
    SELECT CASE WHEN pct >= {high} THEN 'HIGH' ELSE 'MODERATE' END AS risk_level, hs_chapter, description, section_name, supplier, supplier_iso3,
        pct AS share_pct, ROUND(own / 1e9, 3) AS supplier_value_b, ROUND(whole / 1e9, 3) AS chapter_total_b
    FROM (SELECT *, ROUND(own / whole * 100.0, 1) AS pct FROM leader WHERE nth = 1) WHERE pct > {least})"""


@register("q15_alerts", O.with_base("SELECT * FROM alert", *alert_ctes(IMPORTS)))
def q15_alerts(s):
    return CON.single_source_alerts(s, IMPORTS, *PARAMS["alert_shares"])


@register("q16_alert_counts", O.with_base(
    "SELECT COUNT(*) AS n_alerts, COUNT_IF(risk_level = 'HIGH') AS n_high, COUNT_IF(risk_level <> 'HIGH') AS n_moderate FROM alert",
    *alert_ctes(IMPORTS)))
def q16_alert_counts(s):
    return CON.alert_counts(q15_alerts(s), PARAMS["alert_shares"][1])


@register("q29_diversification", O.with_base("""
SELECT section_name, year, COUNT(who) AS supplier_count, ROUND(SUM(pct * pct), 0) AS hhi FROM share GROUP BY section_name, year""",
    *share_ctes(ALL, False)))
def q29_diversification(s):
    return CON.diversification(s, ALL)


# =========================================================================== overview
ANNUAL = f"""annual AS (
    SELECT year, {IN_USD} AS imports_usd, {OUT_USD} AS exports_usd, COUNT(DISTINCT cid) AS active_partners FROM flows GROUP BY year)"""


@register("q1_dataset_summary", O.with_base("""
SELECT COUNT(v) AS trade_records, COUNT(DISTINCT cid) AS trading_partners, MIN(year) AS year_min, MAX(year) AS year_max,
    ROUND(SUM(v) / 1e9, 1) AS total_trade_b FROM flows""", FLOWS))
def q1_dataset_summary(s):
    return OV.dataset_summary(s)


@register("q5_annual_balance", O.with_base("SELECT * FROM annual", FLOWS, ANNUAL))
def q5_annual_balance(s):
    return OV.annual_balance(s)


def _kpi_sql(f: TradeFilter) -> str:
    change = lambda c: f"CASE WHEN was_{c} <> 0 THEN (is_{c} - was_{c}) / ABS(was_{c}) * 100.0 END AS {c}_yoy_pct"
    ends = ", ".join(f"MAX(CAST({col} AS DOUBLE)) FILTER (WHERE back = {back}) AS {pre}_{c}" for pre, back in (("is", 0), ("was", 1))
                     for c, col in (("imports", "imports_usd"), ("exports", "exports_usd"), ("partners", "active_partners")))
    return O.with_base(f"""
SELECT total_imports, total_exports, total_exports - total_imports AS trade_balance, total_partners,
    {change('imports')}, {change('exports')}, {change('partners')}
FROM (
    SELECT COALESCE(SUM(imports_usd) FILTER (WHERE inside), 0) AS total_imports, COALESCE(SUM(exports_usd) FILTER (WHERE inside), 0) AS total_exports,
        COALESCE(MAX(active_partners) FILTER (WHERE inside), 0) AS total_partners, {ends}
    FROM (SELECT *, {last_year_sql(f, "MAX(year) OVER ()")} - year AS back, {years_sql(f)} AND year IS NOT NULL AS inside FROM annual))""", FLOWS, ANNUAL)


both("q6_overview_kpis", OV.overview_kpis, _kpi_sql)
both("q7_balance_series", OV.balance_series, lambda f: O.with_base(f"""
SELECT year, imports_usd / 1e9 AS imports_b, exports_usd / 1e9 AS exports_b, (exports_usd - imports_usd) / 1e9 AS balance_b
FROM annual WHERE {years_sql(f)}""", FLOWS, ANNUAL))


def _leading(f: TradeFilter) -> str:
    return f"""leading_partner AS (
    SELECT * FROM (SELECT country_name, COALESCE(region, 'Unknown') AS region, ROUND(SUM(v) / 1e9, 3) AS trade_value_b
        FROM flows WHERE country_name IS NOT NULL AND {years_sql(f)} GROUP BY country_name, COALESCE(region, 'Unknown'))
    QUALIFY ROW_NUMBER() OVER (ORDER BY trade_value_b DESC, country_name) <= 20)"""


both("q8_top_partners", lambda s, f: OV.top_partners(s, f, 20), lambda f: O.with_base("SELECT * FROM leading_partner", FLOWS, _leading(f)))
both("q9_partner_rollup", lambda s, f: OV.partner_rollup(s, f, 20), lambda f: O.with_base("""
SELECT 'country' AS level, region, country_name, trade_value_b FROM leading_partner
UNION ALL SELECT 'region', region, NULL, ROUND(SUM(trade_value_b), 3) FROM leading_partner GROUP BY region
UNION ALL SELECT 'all', NULL, NULL, ROUND(SUM(trade_value_b), 3) FROM leading_partner""", FLOWS, _leading(f)))
both("q10_section_mix", lambda s, f: OV.section_mix(s, f, 15), lambda f: O.with_base(f"""
SELECT * FROM (SELECT COALESCE(section_name, 'Unknown') AS section_name, ROUND({IN_USD} / 1e9, 3) AS imports_b, ROUND({OUT_USD} / 1e9, 3) AS exports_b
    FROM flows WHERE hs_chapter IS NOT NULL AND {years_sql(f)} GROUP BY COALESCE(section_name, 'Unknown'))
QUALIFY ROW_NUMBER() OVER (ORDER BY imports_b + exports_b DESC, section_name) <= 15""", FLOWS))


@register("l12_annual_by_period", O.with_base("""
SELECT g.*, d.period_label FROM (
    SELECT year, ROUND(COALESCE(SUM(v) FILTER (WHERE dir = 'Import'), 0) / 1e9, 3) AS imports_b,
        ROUND(COALESCE(SUM(v) FILTER (WHERE dir = 'Export'), 0) / 1e9, 3) AS exports_b, ROUND(SUM(v) / 1e9, 3) AS total_b
    FROM flows GROUP BY year) g JOIN dim_time d USING (year)""", FLOWS))
def l12_annual_by_period(s):
    return OV.annual_by_period(s)


def _top_dir_sql(direction: str) -> str:
    col = f"{direction.lower()}_value_b"
    return O.with_base(f"""
SELECT * FROM (
    SELECT country_name, iso3_code, ROUND(SUM(usd) / 1e9, 3) AS {col}, COUNT(year) AS years_present
    FROM (SELECT country_name, iso3_code, year, SUM(v) AS usd FROM flows WHERE dir = '{direction}' AND country_name IS NOT NULL
        GROUP BY country_name, iso3_code, year) GROUP BY country_name, iso3_code)
QUALIFY ROW_NUMBER() OVER (ORDER BY {col} DESC, country_name, iso3_code) <= 5""", FLOWS)


@register("l13_top_import", _top_dir_sql("Import"))
def l13_top_import(s):
    return OV.top_partners_dir(s, "Import", 5)


@register("l14_top_export", _top_dir_sql("Export"))
def l14_top_export(s):
    return OV.top_partners_dir(s, "Export", 5)


@register("l15_top_chapters", O.with_base("""
SELECT * FROM (SELECT hs_chapter, description, ROUND(SUM(v) / 1e9, 3) AS total_b FROM flows WHERE hs_chapter IS NOT NULL GROUP BY hs_chapter, description)
QUALIFY ROW_NUMBER() OVER (ORDER BY total_b DESC, hs_chapter) <= 10""", FLOWS))
def l15_top_chapters(s):
    return OV.top_chapters(s, 10)


# =========================================================================== partner
def one_partner(f: TradeFilter) -> str:
    return "cid IS NOT NULL" if f.partner_id is None else f"cid = {f.partner_id}"


@register("q17_partner_directory", O.with_base("""
SELECT cid AS country_id, ANY_VALUE(country_name) AS country_name, ANY_VALUE(iso3_code) AS iso3_code,
    COALESCE(ANY_VALUE(region), 'Unknown') AS region, COALESCE(ANY_VALUE(income_group), '') AS income_group,
    ROUND(SUM(v) / 1e9, 2) AS total_trade_b
FROM flows WHERE cid IS NOT NULL GROUP BY cid""", FLOWS))
def q17_partner_directory(s):
    return PAR.partner_directory(s)


def partner_year_ctes(f: TradeFilter) -> tuple[str, ...]:
    change = lambda c: (f"CASE WHEN LAG({c}) OVER seq > 0 THEN ROUND(({c} - LAG({c}) OVER seq) / LAG({c}) OVER seq * 100, 1) END")
    return FLOWS, f"""partner_year AS (
    SELECT partner_id, year, i AS imports_usd, e AS exports_usd, e - i AS balance_usd, i + e AS total_usd,
        import_chapters, export_chapters, {change('i')} AS imports_yoy_pct, {change('e')} AS exports_yoy_pct
    FROM (SELECT cid AS partner_id, year, {IN_USD} AS i, {OUT_USD} AS e, COUNT(DISTINCT ch_id) FILTER (WHERE inward) AS import_chapters,
            COUNT(DISTINCT ch_id) FILTER (WHERE outward) AS export_chapters FROM flows WHERE {one_partner(f)} GROUP BY cid, year)
    WINDOW seq AS (PARTITION BY partner_id ORDER BY year NULLS LAST))"""


ONE_PARTNER = TradeFilter(partner_id=PARTNER)


@register("q18_partner_annual", O.with_base("SELECT * FROM partner_year", *partner_year_ctes(ALL)))
def q18_partner_annual(s):
    return PAR.partner_annual(s, ALL)


@register("q18_one_partner", O.with_base("SELECT * FROM partner_year", *partner_year_ctes(ONE_PARTNER)))
def q18_one_partner(s):
    """one partner."""
    return PAR.partner_annual(s, ONE_PARTNER)


@register("q19_partner_kpis", O.with_base("""
SELECT k.*, l.imports_yoy_pct AS latest_imports_yoy_pct, l.exports_yoy_pct AS latest_exports_yoy_pct
FROM (SELECT partner_id, SUM(imports_usd) AS total_imports, SUM(exports_usd) AS total_exports, SUM(exports_usd) - SUM(imports_usd) AS trade_balance,
        SUM(imports_usd) + SUM(exports_usd) AS total_trade, MAX(year) AS latest_year FROM partner_year GROUP BY partner_id) k
LEFT JOIN partner_year l ON l.partner_id = k.partner_id AND l.year = k.latest_year""", *partner_year_ctes(ALL)))
def q19_partner_kpis(s):
    return PAR.partner_kpis(s, ALL)


@register("q20_macro_latest", O.with_base("""
SELECT country_id, year, gdp_usd, population, gdp_per_capita FROM fact_country_stats f
WHERE NOT EXISTS (SELECT 1 FROM fact_country_stats g WHERE g.country_id = f.country_id AND g.year > f.year)"""))
def q20_macro_latest(s):
    return PAR.macro_latest(s, ALL)


@register("q21_partner_top_chapters", O.with_base(f"""
SELECT partner_id, hs_chapter, description, section_name, ROUND(i / 1e9, 3) AS imports_b, ROUND(e / 1e9, 3) AS exports_b, ROUND((i + e) / 1e9, 3) AS total_b
FROM (SELECT cid AS partner_id, hs_chapter, description, section_name, {IN_USD} AS i, {OUT_USD} AS e
    FROM flows WHERE cid IS NOT NULL AND hs_chapter IS NOT NULL GROUP BY cid, hs_chapter, description, section_name)
QUALIFY ROW_NUMBER() OVER (PARTITION BY partner_id ORDER BY i + e DESC, hs_chapter) <= 15""", FLOWS))
def q21_partner_top_chapters(s):
    return PAR.partner_top_chapters(s, ALL, 15)


@register("q22_partner_share", O.with_base(f"""
SELECT * FROM (
    SELECT cid AS partner_id, year, ROUND(i / NULLIF(SUM(i) OVER y, 0) * 100, 2) AS import_share_pct, ROUND(e / NULLIF(SUM(e) OVER y, 0) * 100, 2) AS export_share_pct
    FROM (SELECT cid, year, {IN_USD} AS i, {OUT_USD} AS e FROM flows GROUP BY cid, year) WINDOW y AS (PARTITION BY year))
WHERE partner_id IS NOT NULL""", FLOWS))
def q22_partner_share(s):
    return PAR.partner_share(s, ALL)


@register("q23_mirror_available", O.with_base(
    "SELECT reporter_id AS partner_id, COUNT(reporter_id) AS mirror_rows FROM fact_mirror_trade GROUP BY reporter_id HAVING COUNT(reporter_id) > 0"))
def q23_mirror_available(s):
    return PAR.mirror_available(s, ALL)


# =========================================================================== mirror
MIRRORED = flows_sql("fact_mirror_trade", "reporter_id", name="mirrored")
#: Both sides stacked, the partners' directions turned round: home rows and partner rows of one key meet in one group.
SIDES = """sides AS (
    SELECT cid, year, hs_chapter, description, v, inward, outward, FALSE AS theirs FROM flows
    UNION ALL SELECT cid, year, hs_chapter, description, v, outward, inward, TRUE FROM mirrored)"""


def side_sql(direction: str, theirs: bool) -> str:
    return f"SUM(v) FILTER (WHERE {direction} AND {'' if theirs else 'NOT '}theirs)"


def gap_sql(a: str, b: str) -> str:
    """Difference of two sides as a percentage of the larger."""
    return f"CASE WHEN GREATEST({a}, {b}) > 0 THEN ROUND(ABS({a} - {b}) / GREATEST({a}, {b}) * 100, 1) END"


MIRROR_YEARS = (FLOWS, MIRRORED, SIDES, f"""mirror_year AS (
    SELECT *, {gap_sql('home_imports_usd', 'ptr_exports_to_home')} AS import_disc_pct, {gap_sql('home_exports_usd', 'ptr_imports_from_home')} AS export_disc_pct
    FROM (SELECT cid AS partner_id, year, COALESCE({side_sql('inward', False)}, 0) AS home_imports_usd,
            COALESCE({side_sql('inward', True)}, 0) AS ptr_exports_to_home, COALESCE({side_sql('outward', False)}, 0) AS home_exports_usd,
            COALESCE({side_sql('outward', True)}, 0) AS ptr_imports_from_home
        FROM sides WHERE cid IS NOT NULL AND year IS NOT NULL GROUP BY cid, year HAVING BOOL_OR(theirs)))""")


@register("q24_mirror_by_year", O.with_base("SELECT * FROM mirror_year", *MIRROR_YEARS))
def q24_mirror_by_year(s):
    return MIR.mirror_by_year(s, ALL)


@register("q25_mirror_flags", O.with_base("""
SELECT partner_id, year, home_imports_usd / 1e9 AS home_imports_b, ptr_exports_to_home / 1e9 AS ptr_exports_b,
    home_exports_usd / 1e9 AS home_exports_b, ptr_imports_from_home / 1e9 AS ptr_imports_b, import_disc_pct, export_disc_pct,
    CASE WHEN import_disc_pct > 20 THEN '!' ELSE '' END AS import_flag, CASE WHEN export_disc_pct > 20 THEN '!' ELSE '' END AS export_flag,
    CAST(SUM(CASE WHEN GREATEST(import_disc_pct, export_disc_pct) > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY partner_id) AS BIGINT) AS years_flagged
FROM mirror_year""", *MIRROR_YEARS))
def q25_mirror_flags(s):
    return MIR.mirror_flags(s, ALL)


MIRROR_CHAPTERS = (FLOWS, MIRRORED, SIDES, f"""chapter_side AS (
    SELECT cid, year, hs_chapter, MAX(description) AS description, {side_sql('inward', False)} AS hi, {side_sql('inward', True)} AS pe,
        {side_sql('outward', False)} AS he, {side_sql('outward', True)} AS pi
    FROM sides WHERE year IS NOT NULL AND hs_chapter IS NOT NULL GROUP BY cid, year, hs_chapter)""",
    """widest AS (
    SELECT * FROM (
        SELECT n.country_name AS partner, year, hs_chapter, description, ROUND(hi / 1e6, 2) AS home_imports_m, ROUND(pe / 1e6, 2) AS ptr_exports_m,
            ROUND(he / 1e6, 2) AS home_exports_m, ROUND(pi / 1e6, 2) AS ptr_imports_m, ROUND(ABS(hi - pe) / GREATEST(hi, pe) * 100, 1) AS import_disc_pct
        FROM chapter_side JOIN dim_country n ON n.country_id = cid WHERE hi > 1e6 AND pe > 1e6)
    QUALIFY ROW_NUMBER() OVER (ORDER BY import_disc_pct DESC, partner, year, hs_chapter) <= 10)""")


@register("q34_mirror_by_chapter", O.with_base("SELECT * FROM widest", *MIRROR_CHAPTERS))
def q34_mirror_by_chapter(s):
    return MIR.mirror_by_chapter(s)


@register("q35_disc_interpretation", O.with_base("""
SELECT *, CASE WHEN home_imports_m < ptr_exports_m THEN 'Re-export route likely (home imports via intermediary)'
    ELSE 'Home reports more — possible classification gap' END AS interpretation FROM widest""", *MIRROR_CHAPTERS))
def q35_disc_interpretation(s):
    return MIR.interpret_disc(MIR.mirror_by_chapter(s))


# =========================================================================== commodity
def selected_sql(f: TradeFilter) -> str:
    """Chapter known, years, and the section or chapter that is selected."""
    parts = ["hs_chapter IS NOT NULL", years_sql(f)]
    if f.section is not None:
        parts.append(f"section_name = {O.q(f.section)}")
    if f.chapter is not None:
        parts.append(f"hs_chapter = {O.q(f.chapter)}")
    return " AND ".join(parts)


@register("q26_section_directory", O.with_base(
    "SELECT section_name, ROUND(SUM(v) / 1e9, 2) AS total_b FROM flows WHERE hs_chapter IS NOT NULL GROUP BY section_name", FLOWS))
def q26_section_directory(s):
    return COM.section_directory(s)


def _section_kpi_sql(f: TradeFilter) -> str:
    last = last_year_sql(f, "(SELECT MAX(year) FROM dim_time)")
    return O.with_base(f"""
SELECT section_name, total_b, chapter_count, partner_count, curr_yr_b, prev_yr_b,
    (COALESCE(curr_yr_b, 0) - COALESCE(prev_yr_b, 0)) / NULLIF(COALESCE(prev_yr_b, 0), 0) * 100 AS yoy_pct
FROM (SELECT section_name, ROUND(SUM(v) / 1e9, 3) AS total_b, COUNT(DISTINCT hs_chapter) AS chapter_count, COUNT(DISTINCT cid) AS partner_count,
        ROUND(SUM(v) FILTER (WHERE year = {last}) / 1e9, 3) AS curr_yr_b, ROUND(SUM(v) FILTER (WHERE year = {last} - 1) / 1e9, 3) AS prev_yr_b
    FROM flows WHERE year IS NOT NULL AND {selected_sql(f)} GROUP BY section_name)""", FLOWS)


both("q27_section_kpis", COM.section_kpis, _section_kpi_sql)


def _section_partner_sql(f: TradeFilter) -> str:
    return O.with_base(f"""
SELECT * FROM (SELECT section_name, country_name, iso3_code, ROUND({IN_USD} / 1e9, 3) AS imports_b, ROUND({OUT_USD} / 1e9, 3) AS exports_b
    FROM flows WHERE country_name IS NOT NULL AND {selected_sql(f)} GROUP BY section_name, country_name, iso3_code)
QUALIFY ROW_NUMBER() OVER (PARTITION BY section_name ORDER BY imports_b + exports_b DESC, country_name, iso3_code) <= 15""", FLOWS)


both("q28_section_partners", lambda s, f: COM.section_partners(s, f, 15), _section_partner_sql)
ONE_SECTION = TradeFilter(section=SECTION)


@register("q28_one_section", _section_partner_sql(ONE_SECTION))
def q28_one_section(s):
    """one section."""
    return COM.section_partners(s, ONE_SECTION, 15)


def _emerging(f: TradeFilter, only_positive: bool, with_region: bool, period: int = 3, floor: float = 1e6) -> tuple[str, ...]:
    """Early and recent averages as two filtered sums of one pass."""
    region = "region, " if with_region else ""
    return flows_sql(only_positive=only_positive), f"""supplier AS (
    SELECT * FROM (
        SELECT section_name, country_name AS partner, iso3_code, {region}
            COALESCE(SUM(v) FILTER (WHERE year < since + {period}), 0) / {period}.0 AS early,
            COALESCE(SUM(v) FILTER (WHERE year > until - {period}), 0) / {period}.0 AS recent
        FROM flows CROSS JOIN (SELECT MIN(year) AS since, MAX(year) AS until FROM dim_time) span
        WHERE country_name IS NOT NULL AND hs_chapter IS NOT NULL AND {flow_sql(f)}
        GROUP BY section_name, country_name, {region}iso3_code) WHERE recent > {floor})""", f"""emerging AS (
    SELECT section_name, partner, iso3_code, {"COALESCE(region, 'Other') AS region, " if with_region else ""}early = 0 AS is_new_entrant,
        ROUND(early / 1e6, 1) AS early_avg_m, ROUND(recent / 1e6, 1) AS recent_avg_m, growth_pct,
        NTILE(4) OVER (PARTITION BY section_name ORDER BY growth_pct DESC NULLS LAST, iso3_code, partner) AS growth_q
    FROM (SELECT *, CASE WHEN early > 0 THEN ROUND((recent - early) / early * 100.0, 1) END AS growth_pct FROM supplier)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY section_name ORDER BY CASE WHEN early = 0 THEN recent ELSE 0 END DESC,
        COALESCE(growth_pct, -9999) DESC, iso3_code, partner) <= 10)"""


EMERGING = _emerging(ALL, True, True)


@register("q30_emerging", O.with_base("SELECT * FROM emerging", *EMERGING))
def q30_emerging(s):
    return COM.emerging_suppliers(s, ALL)


@register("q31_emerging_labels", O.with_base("""
SELECT *, CASE WHEN is_new_entrant THEN 'New entrant' ELSE COALESCE(printf('%+.1f%%', growth_pct), 'N/A') END AS growth_label,
    CASE WHEN is_new_entrant THEN 'New'
        ELSE ['Q1 — Top 25%', 'Q2 — Upper 50%', 'Q3 — Lower 50%', 'Q4 — Bottom 25%'][growth_q] END AS quartile_label
FROM emerging""", *EMERGING))
def q31_emerging_labels(s):
    return COM.emerging_labels(COM.emerging_suppliers(s, ALL))


@register("q36_emerging_variant", O.with_base("SELECT * FROM emerging", *_emerging(IMPORTS, False, False)))
def q36_emerging_variant(s):
    return COM.emerging_suppliers(s, IMPORTS, period_len=3, positive_only=False,
                                  with_region=False)


both("q32_section_chapters", COM.section_chapters, lambda f: O.with_base(f"""
SELECT *, ROUND(imports_b + exports_b, 3) AS total_b, ROW_NUMBER() OVER (PARTITION BY section_name ORDER BY imports_b + exports_b DESC, hs_chapter) AS rank
FROM (SELECT section_name, hs_chapter, description, ROUND({IN_USD} / 1e9, 3) AS imports_b, ROUND({OUT_USD} / 1e9, 3) AS exports_b
    FROM flows WHERE {selected_sql(f)} GROUP BY section_name, hs_chapter, description)""", FLOWS))


def _chapter_partner_sql(f: TradeFilter) -> str:
    return O.with_base(f"""
SELECT * FROM (SELECT hs_chapter, country_name, iso3_code, ROUND({IN_USD} / 1e9, 4) AS imports_b, ROUND({OUT_USD} / 1e9, 4) AS exports_b,
        ROUND(SUM(v) / 1e9, 4) AS total_b
    FROM flows WHERE country_name IS NOT NULL AND {selected_sql(f)} GROUP BY hs_chapter, country_name, iso3_code)
QUALIFY ROW_NUMBER() OVER (PARTITION BY hs_chapter ORDER BY total_b DESC, country_name, iso3_code) <= 5""", FLOWS)


both("q33_chapter_partners", lambda s, f: COM.chapter_partners(s, f, 5), _chapter_partner_sql)
ONE_CHAPTER = TradeFilter(chapter=CHAPTER)


@register("q33_one_chapter", _chapter_partner_sql(ONE_CHAPTER))
def q33_one_chapter(s):
    """one chapter."""
    return COM.chapter_partners(s, ONE_CHAPTER, 5)


V = "trade_value_usd"

# =========================================================================== star load
from tradeweave.operators import clean as CL  # noqa: E402
from tradeweave.operators import quality as QU  # noqa: E402
from tradeweave.operators import star as ST  # noqa: E402
from tradeweave.constants import MIRROR_KEY_OFFSET, REFERENCE_DEDUP_KEYS  # noqa: E402

FACT_COLS = ", ".join(ST.FACT_COLUMNS)


@register("l1_dim_country", O.with_base("SELECT * FROM dim_country"))
def l1_dim_country(s):
    return s.dim_country


@register("l2_fact_keys", O.with_base(
    f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY k1 NULLS LAST, k2, k3, k4, k5) AS BIGINT) AS trade_id, {FACT_COLS} FROM fact_trade"))
def l2_fact_keys(s):
    return ST.with_fact_key(s.fact_trade)


@register("l2_mirror_keys", O.with_base(
    f"SELECT CAST({MIRROR_KEY_OFFSET} + ROW_NUMBER() OVER "
    f"(ORDER BY k1 NULLS LAST, k2, k3, k4, k5) AS BIGINT) AS trade_id, {FACT_COLS} FROM fact_mirror_trade"))
def l2_mirror_keys(s):
    return ST.with_mirror_key(s.fact_mirror_trade)


@register("l3_fk_resolution", O.with_base(f"SELECT {FACT_COLS} FROM fact_trade"))
def l3_fk_resolution(s):
    return s.fact_trade.select(*ST.FACT_COLUMNS)


@register("l3_mirror_resolution", O.with_base(f"SELECT {FACT_COLS} FROM fact_mirror_trade"))
def l3_mirror_resolution(s):
    return s.fact_mirror_trade.select(*ST.FACT_COLUMNS)


@register("l4_fk_rates", O.with_base("""
SELECT total_rows, reporter_unresolved, partner_unresolved, commodity_unresolved,
    ROUND(CASE WHEN total_rows > 0 THEN reporter_unresolved * 100.0 / total_rows END, 1) AS reporter_unresolved_pct,
    ROUND(CASE WHEN total_rows > 0 THEN partner_unresolved * 100.0 / total_rows END, 1) AS partner_unresolved_pct,
    ROUND(CASE WHEN total_rows > 0 THEN commodity_unresolved * 100.0 / total_rows END, 1) AS commodity_unresolved_pct
FROM (SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE reporter_id IS NULL) AS reporter_unresolved,
        COUNT(*) FILTER (WHERE partner_id IS NULL) AS partner_unresolved, COUNT(*) FILTER (WHERE commodity_id IS NULL) AS commodity_unresolved
    FROM fact_trade) c"""))
def l4_fk_rates(s):
    return ST.fk_resolution(s.fact_trade)


@register("l5_country_stats", O.with_base("SELECT * FROM fact_country_stats"))
def l5_country_stats(s):
    return s.fact_country_stats


@register("l6_unmatched_keys", O.with_base("""
SELECT COUNT(DISTINCT cs.country_iso3) AS unmatched_iso3
FROM stats_clean cs LEFT JOIN dim_country dc ON upper(trim(cs.country_iso3)) = dc.iso3_code
WHERE dc.country_id IS NULL AND cs.country_iso3 IS NOT NULL"""))
def l6_unmatched_keys(s):
    return ST.unmatched_keys(s.staging["country_stats"], s.dim_country)


#: Stand-in patch lists for L7 (the reference lists name real ISO3 codes).
PATCH_OVERWRITE = {"Middle East & North Africa": ("N04", "N10")}
PATCH_FILL = {"East Asia & Pacific": ("N01", "N02")}


@register("l7_region_patch", O.with_base("""
SELECT country_id, iso3_code, iso2_code, country_name,
    CASE WHEN iso3_code IN ('N04', 'N10') THEN 'Middle East & North Africa'
         WHEN iso3_code IN ('N01', 'N02') AND region IS NULL THEN 'East Asia & Pacific' ELSE region END AS region,
    sub_region, income_group, un_numeric, latitude, longitude
FROM dim_country"""))
def l7_region_patch(s):
    return ST.patch_regions(s.dim_country, PATCH_OVERWRITE, PATCH_FILL)


@register("l8_region_coverage", O.with_base(
    "SELECT COUNT(region) AS region_set, COUNT(*) FILTER (WHERE region IS NULL) AS region_null FROM dim_country"))
def l8_region_coverage(s):
    return ST.region_coverage(s.dim_country)


@register("l9_validation_counts", O.with_base("""
SELECT 'dim_country rows' AS metric, COUNT(*) AS value FROM dim_country
UNION ALL SELECT 'dim_commodity rows', COUNT(*) FROM dim_commodity
UNION ALL SELECT 'dim_time rows', COUNT(*) FROM dim_time
UNION ALL SELECT 'fact_trade rows', COUNT(*) FROM fact_trade
UNION ALL SELECT 'fact_mirror_trade rows', COUNT(*) FROM fact_mirror_trade
UNION ALL SELECT 'fact_country_stats rows', COUNT(*) FROM fact_country_stats
UNION ALL SELECT 'fact_trade distinct years', COUNT(DISTINCT year) FROM fact_trade
UNION ALL SELECT 'fact_trade distinct partners', COUNT(DISTINCT partner_id) FROM fact_trade
UNION ALL SELECT 'fact_trade distinct commodities', COUNT(DISTINCT commodity_id) FROM fact_trade"""))
def l9_validation_counts(s):
    return ST.validation_counts(s)


@register("l10_total_positive", O.with_base(
    f"SELECT SUM({V}) / 1e9 AS total_positive_b FROM fact_trade WHERE {V} > 0"))
def l10_total_positive(s):
    return ST.total_positive(s.fact_trade)


def _orphan_sql(fact: str, col: str, dim: str, dcol: str) -> str:
    return (f"SELECT 'fk {fact}.{col}' AS check_name, COUNT(*) AS violations FROM {fact} f "
            f"WHERE f.{col} IS NOT NULL AND f.{col} NOT IN (SELECT {dcol} FROM {dim})")


def _dup_sql(table: str, keys: str, name: str) -> str:
    return (f"SELECT '{name}' AS check_name, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS violations "
            f"FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {keys} HAVING COUNT(*) > 1) d")


_L11_PARTS = [
    _dup_sql("dim_country", "country_id", "pk dim_country"),
    _dup_sql("dim_commodity", "commodity_id", "pk dim_commodity"),
    _dup_sql("dim_time", "year", "pk dim_time"),
    _dup_sql("fact_country_stats", "country_id, year", "pk fact_country_stats"),
    "SELECT 'not null dim_commodity.hs_chapter' AS check_name, COUNT(*) FILTER (WHERE hs_chapter IS NULL) AS violations "
    "FROM dim_commodity",
]
for _f in ("fact_trade", "fact_mirror_trade"):
    _L11_PARTS += [_orphan_sql(_f, "year", "dim_time", "year"),
                   _orphan_sql(_f, "reporter_id", "dim_country", "country_id"),
                   _orphan_sql(_f, "partner_id", "dim_country", "country_id"),
                   _orphan_sql(_f, "commodity_id", "dim_commodity", "commodity_id")]
_L11_PARTS += [_orphan_sql("fact_country_stats", "country_id", "dim_country", "country_id"),
               _orphan_sql("fact_country_stats", "year", "dim_time", "year"),
               _dup_sql("keyed_trade", "trade_id", "pk fact_trade"),
               _dup_sql("keyed_mirror", "trade_id", "pk fact_mirror_trade")]
_KEYED = [f"{n} AS (SELECT ROW_NUMBER() OVER (ORDER BY k1, k2, k3, k4, k5) AS trade_id FROM {t})"
          for n, t in (("keyed_trade", "fact_trade"), ("keyed_mirror", "fact_mirror_trade"))]


@register("l11_constraints", O.with_base("\nUNION ALL\n".join(_L11_PARTS), *_KEYED))
def l11_constraints(s):
    """A star of lazy plans is written first (the facts with their keys), so that no check cleans the feeds again."""
    if "trade_id" not in s.fact_trade.columns:
        fact, mirror = ST.keyed_facts(s)
        s = replace(s, fact_trade=fact, fact_mirror_trade=mirror, dim_time=written(s.dim_time, "dim_time"),
                    fact_country_stats=written(s.fact_country_stats, "stats"))
    return ST.check_constraints(s, (s.fact_trade, s.fact_mirror_trade))


# =========================================================================== cleaning (C)
def _raw(s):
    """Reporter flows with their tags: as the load wrote them, or tagged on the way."""
    return CL.tagged(s.staging.get("tagged_reporter", s.staging["raw_reporter"]))


CLEAN_COLS = ("year, reporter_code, reporter_iso3, partner_code, partner_iso3, hs_code, commodity_desc, flow_code, "
              "trade_value_usd, net_weight_kg, quantity, qty_unit, flow_direction_simple, valuation")


@register("c15_clean_flows", O.with_base(f"SELECT {CLEAN_COLS} FROM clean_rep"))
def c15_clean_flows(s):
    return s.staging["trade_flows"]


@register("c15_clean_mirror", O.with_base(f"SELECT {CLEAN_COLS} FROM clean_mir"))
def c15_clean_mirror(s):
    return s.staging["mirror_flows"]


@register("c12_dedup_reference_keys", O.with_base(f"SELECT {CLEAN_COLS} FROM clean_rep4"))
def c12_dedup_reference_keys(s):
    from tradeweave.sources.standin import INGEST_ORDER
    return CL.clean_flows(_raw(s), INGEST_ORDER, REFERENCE_DEDUP_KEYS)


@register("c6_invalid_hs", O.with_base("""
SELECT hs_code, COUNT(*) AS rows FROM tag_rep WHERE reject = 'invalid_hs'
GROUP BY hs_code ORDER BY rows DESC, hs_code NULLS LAST LIMIT 5"""))
def c6_invalid_hs(s):
    return CL.invalid_hs_sample(_raw(s), 5)


@register("c8_unknown_flows", O.with_base("""
SELECT flow_code, COUNT(*) AS rows FROM tag_rep
WHERE reject IS NULL AND NOT COALESCE(flow_code IN ('Import', 'Export', 'Re-import', 'Re-export'), FALSE)
GROUP BY flow_code"""))
def c8_unknown_flows(s):
    return CL.unknown_flows(_raw(s))


@register("c11_value_audit", O.with_base("""
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE trade_value_usd IS NULL) AS null_values,
    COUNT(*) FILTER (WHERE trade_value_usd < 0) AS negative_values, COUNT(*) FILTER (WHERE trade_value_usd = 0) AS zero_values
FROM tag_rep WHERE reject IS NULL"""))
def c11_value_audit(s):
    t = _raw(s)
    return CL.value_audit(t.where(t[CL.REJECT].isNull()))


@register("c13_ledger", O.with_base("""
SELECT step_no, step, CAST(rows AS BIGINT) AS rows,
    ROUND(rows / MAX(CASE WHEN step = 'input' THEN rows END) OVER () * 100.0, 2) AS pct_of_input
FROM (
    SELECT 1 AS step_no, 'input' AS step, COUNT(*) AS rows FROM tag_rep
    UNION ALL SELECT 2, 'world_partner', COUNT(*) FILTER (WHERE reject = 'world_partner') FROM tag_rep
    UNION ALL SELECT 3, 'aggregate_hs', COUNT(*) FILTER (WHERE reject = 'aggregate_hs') FROM tag_rep
    UNION ALL SELECT 4, 'invalid_hs', COUNT(*) FILTER (WHERE reject = 'invalid_hs') FROM tag_rep
    UNION ALL SELECT 5, 'duplicate', COUNT(*) FILTER (WHERE reject IS NULL) - (SELECT COUNT(*) FROM clean_rep) FROM tag_rep
    UNION ALL SELECT 6, 'kept', COUNT(*) FROM clean_rep) s"""))
def c13_ledger(s):
    return CL.cleaning_ledger(_raw(s))


_NULL_COLS = ("trade_value_usd", "net_weight_kg", "quantity", "partner_iso3")
NULL_PCT_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, ROUND(AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE) * 100.0, 2) "
    f"AS null_pct FROM clean_rep" for c in _NULL_COLS)


@register("c14_null_pct", O.with_base(NULL_PCT_SQL))
def c14_null_pct(s):
    return CL.null_pct(s.staging["trade_flows"], _NULL_COLS)


@register("c18_pivot_indicators", O.with_base("SELECT * FROM stats_clean"))
def c18_pivot_indicators(s):
    return s.staging["country_stats"]


@register("c21_stats_summary", O.with_base("""
SELECT COUNT(*) AS rows, COUNT(DISTINCT country_iso3) AS countries, MIN(year) AS year_min, MAX(year) AS year_max,
    COUNT(gdp_per_capita) AS per_capita_rows, COUNT(*) FILTER (WHERE gdp_per_capita IS NULL) AS per_capita_null
FROM stats_clean"""))
def c21_stats_summary(s):
    return CL.stats_summary(s.staging["country_stats"])


@register("c23_countries", O.with_base("""
SELECT COUNT(*) AS countries, COUNT(un_numeric) AS with_un_numeric, COUNT(region) AS with_region
FROM cm_raw WHERE name IS NOT NULL AND trim(name) <> ''"""))
def c23_countries(s):
    return CL.country_coverage(s.staging["raw_countries"])


# =========================================================================== quality (D)
DIST_SQL = """
SELECT ROUND(MIN(v), 2) AS min, CAST(ROUND(CAST(quantile_cont(v, 0.25) AS DECIMAL(24, 6)), 2) AS DOUBLE) AS p25, CAST(ROUND(CAST(quantile_cont(v, 0.5) AS DECIMAL(24, 6)), 2) AS DOUBLE) AS median,
    ROUND(CAST(SUM(CAST(v AS DECIMAL(24, 6))) AS DOUBLE) / COUNT(v), 2) AS mean, CAST(ROUND(CAST(quantile_cont(v, 0.75) AS DECIMAL(24, 6)), 2) AS DOUBLE) AS p75, CAST(ROUND(CAST(quantile_cont(v, 0.95) AS DECIMAL(24, 6)), 2) AS DOUBLE) AS p95,
    ROUND(MAX(v), 2) AS max, ROUND(CAST(SUM(CAST(v AS DECIMAL(24, 6))) AS DOUBLE), 2) AS sum
FROM (SELECT CAST({col} AS DOUBLE) AS v FROM {table}) t WHERE v IS NOT NULL"""


@register("d1_distribution", O.with_base(DIST_SQL.format(col="trade_value_usd", table="clean_rep")))
def d1_distribution(s):
    return QU.distribution(s.staging["trade_flows"], "trade_value_usd")


@register("d1_mirror_distribution", O.with_base(DIST_SQL.format(col="trade_value_usd", table="clean_mir")))
def d1_mirror_distribution(s):
    return QU.distribution(s.staging["mirror_flows"], "trade_value_usd")


@register("q37_value_box", O.with_base("""
SELECT min AS lower_fence, p25 AS q1, median, mean, p75 AS q3, p95 AS upper_fence FROM ("""
    + DIST_SQL.format(col="trade_value_usd", table="clean_rep") + ") d"))
def q37_value_box(s):
    return QU.value_box(d1_distribution(s))


@register("d2_flow_report", O.with_base("""
SELECT 'reporter' AS source, COUNT(*) AS total_rows, MIN(year) AS year_min, MAX(year) AS year_max,
    COUNT(DISTINCT partner_code) AS unique_partners, COUNT(DISTINCT hs_code) AS unique_hs_codes FROM clean_rep"""))
def d2_flow_report(s):
    return QU.flow_report(s.staging["trade_flows"], "reporter")


@register("d3_rows_per_year", O.with_base(
    "SELECT year, COUNT(*) AS rows FROM clean_rep WHERE year IS NOT NULL GROUP BY year"))
def d3_rows_per_year(s):
    return QU.rows_per(s.staging["trade_flows"], "year")


@register("d3_flow_distribution", O.with_base(
    "SELECT flow_code, COUNT(*) AS rows FROM clean_rep WHERE flow_code IS NOT NULL GROUP BY flow_code"))
def d3_flow_distribution(s):
    return QU.rows_per(s.staging["trade_flows"], "flow_code")


@register("d4_stats_report", O.with_base("""
SELECT COUNT(*) AS total_rows, COUNT(DISTINCT country_iso3) AS unique_countries, MIN(year) AS year_min,
    MAX(year) AS year_max FROM stats_clean"""))
def d4_stats_report(s):
    return QU.stats_report(s.staging["country_stats"])


@register("d4_gdp_distribution", O.with_base(DIST_SQL.format(col="gdp_usd", table="stats_clean")))
def d4_gdp_distribution(s):
    return QU.distribution(s.staging["country_stats"], "gdp_usd")


@register("d5_ref_report", O.with_base("""
SELECT 'country_mapping' AS source, COUNT(*) AS total_rows,
    'iso3,name,region,income_group,iso2,capital,longitude,latitude,un_numeric' AS columns
FROM cm_raw WHERE name IS NOT NULL AND trim(name) <> ''"""))
def d5_ref_report(s):
    return QU.ref_report(s.staging["countries"], "country_mapping")


@register("d7_null_severity", O.with_base(
    "SELECT *, CASE WHEN null_pct > 20 THEN 'high' WHEN null_pct > 5 THEN 'moderate' ELSE 'low' END AS severity "
    "FROM (" + NULL_PCT_SQL + ") n"))
def d7_null_severity(s):
    return QU.null_severity(c14_null_pct(s))


@register("d8_table_counts", O.with_base("""
SELECT (SELECT COUNT(*) FROM fact_trade) AS fact_trade, (SELECT COUNT(*) FROM fact_mirror_trade) AS fact_mirror,
    (SELECT COUNT(*) FROM fact_country_stats) AS fact_stats, (SELECT COUNT(*) FROM dim_country) AS dim_country,
    (SELECT COUNT(*) FROM dim_commodity) AS dim_commodity, (SELECT COUNT(*) FROM dim_time) AS dim_time"""))
def d8_table_counts(s):
    return QU.table_counts({"fact_trade": s.fact_trade, "fact_mirror": s.fact_mirror_trade,
                            "fact_stats": s.fact_country_stats, "dim_country": s.dim_country,
                            "dim_commodity": s.dim_commodity, "dim_time": s.dim_time})


def report_sql(sources: tuple[str, ...] = ("trade_flows", "mirror_flows", "country_stats", "hs_chapters", "country_mapping")) -> str:
    """Every figure of the report on ``sources``, each from its own aggregate."""
    parts = []

    def one(source: str, part: str, item: str, value: str, table: str) -> None:
        if source in sources:
            parts.append(f"SELECT '{source}' AS source, '{part}' AS part, {item} AS item, CAST({value} AS DOUBLE) AS value FROM {table}")

    def spread(source: str, part: str, column: str, table: str) -> None:
        for stat in ("min", "p25", "median", "mean", "p75", "p95", "max", "sum"):
            one(source, part, f"'{stat}'", stat, "(" + DIST_SQL.format(col=column, table=table) + ")")

    def nulls(source: str, columns: tuple[str, ...], table: str) -> None:
        for c in columns:
            one(source, "null_percentages", f"'{c}'", f"ROUND(COUNT_IF({c} IS NULL) / COUNT(*) * 100.0, 2)", table)

    for source, table in (("trade_flows", "clean_rep"), ("mirror_flows", "clean_mir")):
        one(source, "total_rows", "''", "COUNT(*)", table)
        one(source, "year_range", "'min'", "MIN(year)", table)
        one(source, "year_range", "'max'", "MAX(year)", table)
        one(source, "unique_partners", "''", "COUNT(DISTINCT partner_code)", table)
        one(source, "unique_hs_codes", "''", "COUNT(DISTINCT hs_code)", table)
        one(source, "flow_distribution", "flow_code", "COUNT(*)", f"{table} GROUP BY flow_code")
        one(source, "rows_per_year", "CAST(year AS VARCHAR)", "COUNT(*)", f"{table} WHERE year IS NOT NULL GROUP BY year")
        nulls(source, QU.FLOW_NULL_COLS, table)
        spread(source, "value_distribution", "trade_value_usd", table)
    one("country_stats", "total_rows", "''", "COUNT(*)", "stats_clean")
    one("country_stats", "unique_countries", "''", "COUNT(DISTINCT country_iso3)", "stats_clean")
    one("country_stats", "year_range", "'min'", "MIN(year)", "stats_clean")
    one("country_stats", "year_range", "'max'", "MAX(year)", "stats_clean")
    nulls("country_stats", QU.STATS_NULL_COLS, "stats_clean")
    spread("country_stats", "gdp_distribution", "gdp_usd", "stats_clean")
    one("hs_chapters", "total_rows", "''", "COUNT(*)", "chapters")
    one("country_mapping", "total_rows", "''", "COUNT(*)", "cm_raw WHERE name IS NOT NULL AND trim(name) <> ''")
    return "\nUNION ALL\n".join(parts)


@register("d6_quality_report", O.with_base(report_sql()))
def d6_quality_report(s):
    """The assembled report (with the full D2 and D4 reports), a row per figure."""
    st = s.staging
    return QU.report_lines(QU.quality_report_frame({
        "trade_flows": st["trade_flows"], "mirror_flows": st["mirror_flows"], "country_stats": st["country_stats"],
        "hs_chapters": st["hs_chapters"], "country_mapping": st["countries"]}))


@register("s9_landed_rows", O.with_base("""
SELECT year_txt AS ref_year, flow_raw AS flow_code, COUNT(*) AS rows, COUNT(value_txt) AS with_value,
    COUNT(partner_iso3) AS with_partner, COUNT(DISTINCT hs_raw) AS hs_codes
FROM (SELECT * FROM raw_rep UNION ALL SELECT * FROM raw_mir) GROUP BY year_txt, flow_raw"""))
def s9_landed_rows(s):
    """Both raw feeds rendered as CSV files, their columns in different orders, landed in two runs by header name."""
    raw = [s.staging["raw_reporter"], s.staging["raw_mirror"]]
    spark = raw[0].sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}"
    for i, df in enumerate(raw):
        columns = list(RAW_FLOW_COLUMNS)[::-1] if i else list(RAW_FLOW_COLUMNS)
        df.select(*columns, F.lit("x").alias("extra")).write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(f"{root}/in/feed{i}")
        land_incremental(spark, f"{root}/in", f"{root}/out")
    rows = landed_rows(spark, f"{root}/out")
    return rows.groupBy(F.col("refYear").alias("ref_year"), F.col("flowCode").alias("flow_code")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("primaryValue").alias("with_value"), F.count("partnerISO").alias("with_partner"),
        F.count_distinct("cmdCode").alias("hs_codes"))


#: Rows of a feed that one task sorts into a file.
FILE_ROWS = 1_000_000


def feed_files(feed: DataFrame) -> int:
    """Files of a feed that lands in ingest order: four, and more for a feed that has more rows than those should hold."""
    return max(4, -(-feed.count() // FILE_ROWS))


@register("s11_incremental_load", O.with_base("""
SELECT year, flow_direction, partner_id, COUNT(*) AS rows, SUM(trade_value_usd) AS value, COUNT(net_weight_kg) AS with_weight,
    COUNT(*) FILTER (WHERE trade_value_usd > 0) AS positive
FROM fact_trade GROUP BY year, flow_direction, partner_id"""))
def s11_incremental_load(s):
    """The reporter feed as CSV files that land in three loads, two of them in years loaded before; the fact that results."""
    from tradeweave.sources.standin import INGEST_ORDER

    raw = s.staging["raw_reporter"]
    spark = raw.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/increment-{uuid.uuid4().hex}"
    # all records of one key are in one load; inside it files and rows follow the ingest order
    batch = F.when(F.trim(F.regexp_replace("partnerCode", "[.]0$", "")).try_cast("int") % 3 == 1, 1).when(F.trim(F.regexp_replace("partnerCode", "[.]0$", "")).try_cast("int") % 3 == 2, 2).otherwise(0)
    feed = written(raw.select(*RAW_FLOW_COLUMNS, *INGEST_ORDER, batch.alias("_batch")), "feed")
    for k in range(3):
        batch = feed.where(F.col("_batch") == k)
        part = batch.repartitionByRange(feed_files(batch), *INGEST_ORDER).sortWithinPartitions(*INGEST_ORDER)
        part.select(*RAW_FLOW_COLUMNS).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(f"{root}/in/load{k}")
        load_increment(spark, f"{root}/in", f"{root}/out", s.dim_country, s.dim_commodity)
    value = F.col("trade_value_usd")
    return fact_of(spark, f"{root}/out").groupBy("year", "flow_direction", "partner_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(value).alias("value"), F.count("net_weight_kg").alias("with_weight"), F.count_if(value > 0).alias("positive"))


_DESC_SQL = """CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority || ', "' || o_orderstatus || '", ' || o_custkey WHEN 1 THEN o_orderpriority || chr(10) || o_custkey
        WHEN 2 THEN o_orderpriority || chr(92) WHEN 3 THEN '"' || chr(10) || chr(10) || ',"' || o_custkey WHEN 4 THEN 'a ""quoted"" "' || o_custkey || '"' ELSE o_orderpriority END"""


@register("s1_quoted_records", f"""
SELECT o_orderstatus AS flow_code, CAST(year(o_orderdate) AS VARCHAR) AS ref_year, COUNT(*) AS rows, COUNT(DISTINCT description) AS descriptions,
    CAST(SUM(length(description)) AS BIGINT) AS description_chars, MIN(description) AS least, MAX(description) AS most, MIN(o_orderkey) AS first_key
FROM (SELECT *, {_DESC_SQL} AS description FROM orders) GROUP BY o_orderstatus, year(o_orderdate)""")
def s1_quoted_records(s):
    """Orders rendered as CSV files, plain and compressed, whose cells hold commas, doubled quotes, backslashes and line breaks; read record by record."""
    spark = s.dim_country.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quoted-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{s.source_dir}/orders.parquet")
    feed = orders.select(F.year("o_orderdate").alias("refYear"), F.expr(_DESC_SQL).alias("cmdDesc"), F.col("o_orderstatus").alias("flowCode"), F.col("o_orderkey").alias("key"))
    for name, part, columns in (("none", 0, feed.columns), ("gzip", 1, feed.columns[::-1])):
        feed.where(F.col("key") % 2 == part).select(*columns).write.option("header", True).option("escape", '"').option("quoteAll", True) \
            .option("compression", name).csv(f"{root}/{name}")
    rows = read_raw(spark, root, ["refYear", "cmdDesc", "flowCode", "key"], with_ingest_order=False)
    text = F.col("cmdDesc")
    return rows.groupBy(F.col("flowCode").alias("flow_code"), F.col("refYear").alias("ref_year")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("cmdDesc").alias("descriptions"), F.sum(F.char_length(text)).alias("description_chars"),
        F.min(text).alias("least"), F.max(text).alias("most"), F.min(F.col("key").cast("long")).alias("first_key"))


def _payload_folder(pages: DataFrame, name: str) -> str:
    """One file per API page: ``page`` and its ``records`` (JSON array) in the landed form, and one page that is an error."""
    spark = pages.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    text = F.concat(F.lit('[{"page":'), F.col("page").cast("string"), F.lit("},"), F.col("records"), F.lit("]"))
    bad = spark.range(1).select(F.lit(-1).cast("long").alias("page"), F.lit('{"message":"error"}').alias("value"))
    out = pages.select(F.col("page").cast("long").alias("page"), text.alias("value")).unionByName(bad)
    out.repartition("page").write.partitionBy("page").text(root)
    return root


@register("s7_indicator_payload", O.with_base(f"""
SELECT {O.iso('c_nationkey')} AS country_iso3, n_name AS country_name, CAST(year(o_orderdate) AS VARCHAR) AS year, COUNT(*) AS rows,
    COUNT(*) FILTER (WHERE o_orderkey % 11 <> 0) AS with_value, MAX(o_totalprice) FILTER (WHERE o_orderkey % 11 <> 0) AS highest
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, n_name, year(o_orderdate)"""))
def s7_indicator_payload(s):
    """Orders rendered as pages of an indicator API (a record per order, some without a value), flattened."""
    spark, sf_dir = s.dim_country.sparkSession, s.source_dir
    o, c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    record = F.struct(iso3_of(F.col("c_nationkey")).alias("countryiso3code"), F.struct(F.col("n_name").alias("value")).alias("country"),
                      F.year("o_orderdate").cast("string").alias("date"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("value"))
    pages = rows.groupBy(F.floor(F.col("o_orderkey") / 2000).alias("page")).agg(F.to_json(F.collect_list(record)).alias("records"))
    flat = flatten_indicator(spark, _payload_folder(pages, "indicator"), "NY.GDP.MKTP.CD")
    return flat.groupBy("country_iso3", "country_name", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_value"), F.max("value").alias("highest"))


@register("s8_country_payload", O.with_base("""
SELECT iso3, name, region, income_group, iso2, capital, CAST(longitude AS VARCHAR) AS longitude, CAST(latitude AS VARCHAR) AS latitude,
    CASE iso3 WHEN 'N03' THEN '33' WHEN 'N07' THEN '77' END AS un_numeric FROM cm_raw"""))
def s8_country_payload(s):
    """Nations rendered as pages of a country API, flattened with the numeric-code override."""
    c = s.staging["raw_countries"]
    record = F.struct(
        F.col("iso3").alias("id"), "name", F.struct(F.col("region").alias("value")).alias("region"), F.struct(F.col("income_group").alias("value")).alias("incomeLevel"),
        F.col("iso2").alias("iso2Code"), F.col("capital").alias("capitalCity"), "longitude", "latitude")
    pages = c.groupBy((F.xxhash64("iso3") % 3).alias("page")).agg(F.to_json(F.collect_list(record)).alias("records"))
    return flatten_countries(c.sparkSession, _payload_folder(pages.withColumn("page", F.col("page") + 3), "countries"), {"N03": 33, "N07": 77})


from tradeweave.plans import registry_tables  # noqa: E402,F401  (registers its queries)
