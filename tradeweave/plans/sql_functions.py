"""The dashboard's selections as SQL table functions with bound parameters.

``register_functions`` puts the star's tables behind temp views and creates temporary table functions over
them, so that ``spark.sql("SELECT * FROM tw_section_hhi(:flow, :from, :to)", args=...)`` answers what the DataFrame
operators do. Arguments are values, never text pasted into a statement. They are literals once a call is analysed, so
conditions of parameters that are not given (NULL: all) fold away and year ranges prune partitions.

=====================  ============================================================================  =====
function               parameters (all optional unless marked *)                                     like
=====================  ============================================================================  =====
trade_rows             flow, year_from, year_to, section, chapter, partner                           F1–F4
balance_series         year_from, year_to                                                            Q7
top_partners           flow, year_from, year_to, n (20)                                              Q8
section_hhi            flow, year_from, year_to, section                                             Q11
supplier_alerts        flow, year_from, year_to, min_share (50), high_share (70)                     Q15
partner_annual         partner, year_from, year_to                                                   Q18
section_partners       flow, year_from, year_to, section, n (15)                                     Q28
chapter_partners       flow, year_from, year_to, chapter, n (5)                                      Q33
emerging_suppliers     year_from*, year_to*, flow, section, period (3), floor (1e6), n (10)          Q30
=====================  ============================================================================  =====

``flow`` is Imports, Exports or Both (any other text raises). Temporary views and functions belong to the session;
another star needs another ``prefix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeweave.constants import ALERT_HIGH_SHARE, ALERT_MIN_SHARE, EMERGING_FLOOR, EXPORT_LABELS, IMPORT_LABELS
from tradeweave.operators.star import Star
from tradeweave.plans.warehouse import register_views

PREFIX = "tw_"
_IMPORT = ", ".join(f"'{x}'" for x in IMPORT_LABELS)
_EXPORT = ", ".join(f"'{x}'" for x in EXPORT_LABELS)
_IN = f"COALESCE(SUM(IF(flow_direction IN ({_IMPORT}), trade_value_usd, 0.0D)), 0.0D)"
_OUT = f"COALESCE(SUM(IF(flow_direction IN ({_EXPORT}), trade_value_usd, 0.0D)), 0.0D)"
_YEARS = "year_from INT DEFAULT NULL, year_to INT DEFAULT NULL"
_FLOW_YEARS = f"flow STRING DEFAULT 'Both', {_YEARS}"


def _rows(p: str, fn: str, flow: str = "Both", **selected: str) -> str:
    """A call of ``trade_rows`` that hands on the calling function's parameters."""
    flow = f"{fn}.flow" if flow == "param" else f"'{flow}'"
    more = "".join(f", {k} => {fn}.{v}" for k, v in selected.items())
    return f"{p}trade_rows({flow}, {fn}.year_from, {fn}.year_to{more})"


def _definitions(p: str) -> dict[str, tuple[str, str, str]]:
    """name → (parameters, result columns, query)."""
    out: dict[str, tuple[str, str, str]] = {}

    def define(name: str, params: str, columns: str, body: str) -> None:
        out[name] = (params, columns, body)

    define("trade_rows", f"{_FLOW_YEARS}, section STRING DEFAULT NULL, chapter STRING DEFAULT NULL, partner INT DEFAULT NULL",
           "year INT, flow_direction STRING, partner_id INT, country_name STRING, iso3_code STRING, region STRING, commodity_id INT, "
           "hs_chapter STRING, description STRING, section_name STRING, trade_value_usd DOUBLE", f"""
        SELECT /*+ BROADCAST(m), BROADCAST(c) */ t.year, t.flow_direction, t.partner_id, c.country_name, c.iso3_code, c.region, t.commodity_id,
            m.hs_chapter, m.description, m.section_name, t.trade_value_usd
        FROM {p}fact_trade t LEFT JOIN {p}dim_commodity m ON t.commodity_id = m.commodity_id LEFT JOIN {p}dim_country c ON t.partner_id = c.country_id
        WHERE t.trade_value_usd > 0
            AND CASE trade_rows.flow WHEN 'Imports' THEN t.flow_direction IN ({_IMPORT}) WHEN 'Exports' THEN t.flow_direction IN ({_EXPORT})
                WHEN 'Both' THEN TRUE ELSE raise_error('flow must be Imports, Exports or Both') END
            AND (trade_rows.year_from IS NULL OR t.year >= trade_rows.year_from) AND (trade_rows.year_to IS NULL OR t.year <= trade_rows.year_to)
            AND (trade_rows.section IS NULL OR m.section_name = trade_rows.section)
            AND (trade_rows.chapter IS NULL OR m.hs_chapter = trade_rows.chapter)
            AND (trade_rows.partner IS NULL OR t.partner_id = trade_rows.partner)""".replace("trade_rows.", f"{p}trade_rows."))

    define("balance_series", _YEARS, "year INT, imports_b DOUBLE, exports_b DOUBLE, balance_b DOUBLE", f"""
        SELECT year, {_IN} / 1e9D, {_OUT} / 1e9D, ({_OUT} - {_IN}) / 1e9D FROM {_rows(p, p + 'balance_series')} GROUP BY year""")

    define("top_partners", f"{_FLOW_YEARS}, n INT DEFAULT 20", "country_name STRING, region STRING, trade_value_b DOUBLE", f"""
        SELECT country_name, region, trade_value_b FROM (
            SELECT *, ROW_NUMBER() OVER (ORDER BY trade_value_b DESC, country_name, region) AS place FROM (
                SELECT country_name, COALESCE(region, 'Unknown') AS region, ROUND(SUM(trade_value_usd) / 1e9D, 3) AS trade_value_b
                FROM {_rows(p, p + 'top_partners', 'param')} WHERE country_name IS NOT NULL GROUP BY country_name, COALESCE(region, 'Unknown')))
        WHERE place <= {p}top_partners.n""")

    define("section_hhi", f"{_FLOW_YEARS}, section STRING DEFAULT NULL",
           "year INT, section_name STRING, hhi DOUBLE, supplier_count BIGINT, top_share_pct DOUBLE, top_supplier STRING", f"""
        SELECT year, section_name, ROUND(SUM(pct * pct), 0), COUNT(DISTINCT country_name), ROUND(MAX(pct), 1),
            MAX_BY(country_name, IF(country_name IS NOT NULL, pct, NULL))
        FROM (SELECT year, section_name, country_name, v / SUM(v) OVER (PARTITION BY year, section_name) * 100.0D AS pct FROM (
            SELECT year, section_name, partner_id, country_name, SUM(trade_value_usd) AS v FROM {_rows(p, p + 'section_hhi', 'param', section='section')}
            WHERE section_name IS NOT NULL AND country_name IS NOT NULL GROUP BY year, section_name, partner_id, country_name))
        GROUP BY year, section_name""")

    define("supplier_alerts", f"{_FLOW_YEARS}, min_share DOUBLE DEFAULT {float(ALERT_MIN_SHARE)}D, high_share DOUBLE DEFAULT {float(ALERT_HIGH_SHARE)}D",
           "risk_level STRING, hs_chapter STRING, description STRING, section_name STRING, supplier STRING, supplier_iso3 STRING, share_pct DOUBLE, "
           "supplier_value_b DOUBLE, chapter_total_b DOUBLE", f"""
        SELECT IF(share >= {p}supplier_alerts.high_share, 'HIGH', 'MODERATE'), hs_chapter, description, section_name, country_name, iso3_code, share,
            ROUND(v / 1e9D, 3), ROUND(total / 1e9D, 3)
        FROM (SELECT *, ROUND(v / total * 100.0D, 1) AS share FROM (
            SELECT *, SUM(v) OVER (PARTITION BY hs_chapter) AS total, ROW_NUMBER() OVER (PARTITION BY hs_chapter ORDER BY v DESC, iso3_code, country_name) AS place
            FROM (SELECT hs_chapter, description, section_name, country_name, iso3_code, SUM(trade_value_usd) AS v
                FROM {_rows(p, p + 'supplier_alerts', 'param')} WHERE iso3_code IS NOT NULL AND hs_chapter IS NOT NULL
                GROUP BY hs_chapter, description, section_name, country_name, iso3_code)) WHERE place = 1)
        WHERE share > {p}supplier_alerts.min_share""")

    change = lambda c: f"IF(before_{c} > 0, ROUND(({c}_usd - before_{c}) / before_{c} * 100, 1), NULL)"
    define("partner_annual", f"partner INT DEFAULT NULL, {_YEARS}",
           "partner_id INT, year INT, imports_usd DOUBLE, exports_usd DOUBLE, balance_usd DOUBLE, total_usd DOUBLE, import_chapters BIGINT, "
           "export_chapters BIGINT, imports_yoy_pct DOUBLE, exports_yoy_pct DOUBLE", f"""
        SELECT partner_id, year, imports_usd, exports_usd, exports_usd - imports_usd, imports_usd + exports_usd, import_chapters, export_chapters,
            {change('imports')}, {change('exports')}
        FROM (SELECT *, LAG(imports_usd) OVER (PARTITION BY partner_id ORDER BY year NULLS LAST) AS before_imports,
                LAG(exports_usd) OVER (PARTITION BY partner_id ORDER BY year NULLS LAST) AS before_exports
            FROM (SELECT partner_id, year, SUM(IF(inward, v, 0.0D)) AS imports_usd, SUM(IF(outward, v, 0.0D)) AS exports_usd,
                    COUNT_IF(inward AND commodity_id IS NOT NULL) AS import_chapters, COUNT_IF(outward AND commodity_id IS NOT NULL) AS export_chapters
                FROM (SELECT partner_id, year, commodity_id, flow_direction IN ({_IMPORT}) AS inward, flow_direction IN ({_EXPORT}) AS outward,
                        SUM(trade_value_usd) AS v
                    FROM {_rows(p, p + 'partner_annual', partner='partner')} WHERE partner_id IS NOT NULL
                    GROUP BY partner_id, year, commodity_id, flow_direction IN ({_IMPORT}), flow_direction IN ({_EXPORT}))
                GROUP BY partner_id, year))""")

    define("section_partners", f"{_FLOW_YEARS}, section STRING DEFAULT NULL, n INT DEFAULT 15",
           "section_name STRING, country_name STRING, iso3_code STRING, imports_b DOUBLE, exports_b DOUBLE", f"""
        SELECT section_name, country_name, iso3_code, imports_b, exports_b FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY section_name ORDER BY imports_b + exports_b DESC, country_name, iso3_code) AS place FROM (
                SELECT section_name, country_name, iso3_code, ROUND({_IN} / 1e9D, 3) AS imports_b, ROUND({_OUT} / 1e9D, 3) AS exports_b
                FROM {_rows(p, p + 'section_partners', 'param', section='section')} WHERE section_name IS NOT NULL AND country_name IS NOT NULL
                GROUP BY section_name, country_name, iso3_code))
        WHERE place <= {p}section_partners.n""")

    define("chapter_partners", f"{_FLOW_YEARS}, chapter STRING DEFAULT NULL, n INT DEFAULT 5",
           "hs_chapter STRING, country_name STRING, iso3_code STRING, imports_b DOUBLE, exports_b DOUBLE, total_b DOUBLE", f"""
        SELECT hs_chapter, country_name, iso3_code, imports_b, exports_b, total_b FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY hs_chapter ORDER BY total_b DESC, country_name, iso3_code) AS place FROM (
                SELECT hs_chapter, country_name, iso3_code, ROUND({_IN} / 1e9D, 4) AS imports_b, ROUND({_OUT} / 1e9D, 4) AS exports_b,
                    ROUND(SUM(trade_value_usd) / 1e9D, 4) AS total_b
                FROM {_rows(p, p + 'chapter_partners', 'param', chapter='chapter')} WHERE hs_chapter IS NOT NULL AND country_name IS NOT NULL
                GROUP BY hs_chapter, country_name, iso3_code))
        WHERE place <= {p}chapter_partners.n""")

    e = f"{p}emerging_suppliers"
    define("emerging_suppliers", f"year_from INT, year_to INT, flow STRING DEFAULT 'Imports', section STRING DEFAULT NULL, period INT DEFAULT 3, "
           f"floor DOUBLE DEFAULT {float(EMERGING_FLOOR)}D, n INT DEFAULT 10",
           "section_name STRING, partner STRING, iso3_code STRING, region STRING, is_new_entrant BOOLEAN, early_avg_m DOUBLE, recent_avg_m DOUBLE, "
           "growth_pct DOUBLE, growth_q BIGINT", f"""
        SELECT section_name, country_name, iso3_code, region, is_new, ROUND(early / 1e6D, 1), ROUND(recent / 1e6D, 1), growth, quarter FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY section_name ORDER BY IF(is_new, recent, 0.0D) DESC, COALESCE(growth, -9999.0D) DESC,
                iso3_code, country_name) AS place
            FROM (SELECT *, CAST(NTILE(4) OVER (PARTITION BY section_name ORDER BY growth DESC NULLS LAST, iso3_code, country_name) AS BIGINT) AS quarter
                FROM (SELECT *, early = 0 AS is_new, IF(early > 0, ROUND((recent - early) / early * 100.0D, 1), NULL) AS growth
                    FROM (SELECT * EXCEPT (early_sum, recent_sum), early_sum / {e}.period AS early, recent_sum / {e}.period AS recent
                        FROM (SELECT section_name, partner_id, country_name, iso3_code, region, SUM(IF(in_early, v, 0.0D)) AS early_sum, SUM(IF(in_recent, v, 0.0D)) AS recent_sum
                            FROM (SELECT section_name, partner_id, country_name, iso3_code, COALESCE(region, 'Other') AS region, trade_value_usd AS v,
                                    year < {e}.year_from + {e}.period AS in_early, year > {e}.year_to - {e}.period AS in_recent
                                FROM {_rows(p, e, 'param', section='section')} WHERE section_name IS NOT NULL AND country_name IS NOT NULL)
                            GROUP BY section_name, partner_id, country_name, iso3_code, region))
                    WHERE recent > {e}.floor)))
        WHERE place <= {e}.n""")
    return out


def register_functions(spark: SparkSession, star: Star, prefix: str = PREFIX) -> list[str]:
    """Create the temp views and table functions over ``star``; returns the functions' names."""
    if not prefix.isidentifier():
        raise ValueError(f"no prefix of names: {prefix!r}")
    register_views(star, prefix)
    names = []
    for name, (params, columns, body) in _definitions(prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({params}) RETURNS TABLE({columns}) RETURN {body}")
        names.append(prefix + name)
    return names


def call(spark: SparkSession, function: str, **args) -> DataFrame:
    """``SELECT * FROM function(name => :name, …)`` with the arguments bound as parameters."""
    if not (function.isidentifier() and all(a.isidentifier() for a in args)):
        raise ValueError(f"no name of a function or parameter in {function!r}, {sorted(args)}")
    return spark.sql(f"SELECT * FROM {function}({', '.join(f'{a} => :{a}' for a in args)})", args=args)
