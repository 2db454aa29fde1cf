"""Independent SQL formulation (DuckDB dialect) of the stand-in inputs, the
cleaning, the star load and every registered query.

The SQL reads the driver's pre-registered views (lineitem, orders, ...). It
shares only fixed values (constants) with the Spark code, never logic: dedup
is a ``ROW_NUMBER`` window here and an aggregation there, shares use a
self-join to totals here and a window there, and so on.
"""

from __future__ import annotations

from tradeweave.sources.standin import ODD_VALUES
from tradeweave.constants import (
    AGGREGATE_HS_CODES,
    FLOW_CODE_LABELS,
    FLOW_SIMPLE,
    FLOW_VALUATION,
    HS_CHAPTER_NAMES,
    HS_SECTIONS,
    INDICATOR_AGGREGATE_ISO3,
    INDICATOR_NAMES,
    REGION_FILL_IF_NULL,
    REGION_OVERWRITE,
    WORLD_PARTNER_CODES,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(values) -> str:
    return ", ".join(q(v) for v in values)


def case(expr: str, mapping: dict[str, str]) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def iso(n: str) -> str:
    return f"('N' || lpad(CAST({n} AS VARCHAR), 2, '0'))"


def _flow_sql(mirror: bool) -> str:
    imp, exp, reimp, reexp = ("X", "M", "RX", "RM") if mirror else ("M", "X", "RM", "RX")
    return (f"CASE WHEN l_orderkey % 101 = 0 THEN 'Q' WHEN l_returnflag = 'A' THEN '{imp}' WHEN l_returnflag = 'N' THEN '{exp}' "
            f"WHEN l_linestatus = 'F' THEN '{reimp}' ELSE '{reexp}' END")


def _code(n: str) -> str:
    return (f"CASE l_orderkey % 3 WHEN 1 THEN chr(9) || CAST({n} AS VARCHAR) WHEN 2 THEN CAST({n} AS VARCHAR) || '.0' "
            f"ELSE CAST({n} AS VARCHAR) END")


def _year(day: str) -> str:
    return f"CASE WHEN l_orderkey % 499 = 0 THEN '20x0' ELSE {_code(f'year({day})')} END"


def _value(number: str) -> str:
    text = f"CAST(CAST(floor({number}) AS BIGINT) AS VARCHAR)"
    odd = " ".join(f"WHEN {k} THEN {q(t)}" for k, t in ODD_VALUES.items())
    return f"CASE l_orderkey % 97 WHEN 4 THEN NULL WHEN 7 THEN '-' || {text} {odd} ELSE {text} END"


_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


def stripped(text: str) -> str:
    return f"trim({text}, {_BLANKS})"


def number(text: str) -> str:
    """A finite number or NULL."""
    x = f"TRY_CAST({stripped(text)} AS DOUBLE)"
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def key_text(text: str) -> str:
    """Equal texts for equal numbers."""
    x = number(text)
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE {stripped(text)} END"


_LINES = """
    SELECT l.*, o.o_orderdate, c.c_nationkey, s.s_nationkey, p.p_brand, p.p_type, p.p_size
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN part p ON l.l_partkey = p.p_partkey"""

_HS = ("CASE WHEN p_size = 50 THEN 'TOTAL' WHEN p_size = 49 THEN '99' WHEN p_size = 48 THEN '8471' "
       "WHEN p_size = 47 THEN chr(9) || '47' "
       "ELSE split_part(p_brand, '#', 2) END")
_COMMON_TAIL = """
        p_type AS commodity_desc,
        CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity * p_size END AS net_weight_kg,
        l_quantity AS quantity,
        'kg' AS qty_unit,
        l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4, l_shipdate AS o5,
        l_extendedprice AS o6"""

RAW_REP = f"""raw_rep AS (
    SELECT {_year('l_shipdate')} AS year_txt,
        {_code('c_nationkey')} AS reporter_code_txt,
        CASE WHEN c_nationkey % 3 = 1 THEN ' ' || lower({iso('c_nationkey')}) || ' ' ELSE {iso('c_nationkey')} END
            AS reporter_iso3,
        {_code('s_nationkey')} AS partner_code_txt,
        CASE WHEN s_nationkey % 5 <> 4 THEN {iso('s_nationkey')} END AS partner_iso3,
        {_HS} AS hs_raw,
        {_flow_sql(False)} AS flow_raw,
        {_value('l_extendedprice * (1 - l_discount) * 1000')} AS value_txt,{_COMMON_TAIL}
    FROM ({_LINES}) x)"""

RAW_MIR = f"""raw_mir AS (
    SELECT {_year('o_orderdate')} AS year_txt,
        CASE WHEN s_nationkey = 5 THEN '999' ELSE {_code('s_nationkey')} END AS reporter_code_txt,
        CASE WHEN s_nationkey = 5 THEN 'ZZX' ELSE {iso('s_nationkey')} END AS reporter_iso3,
        {_code('c_nationkey')} AS partner_code_txt,
        {iso('c_nationkey')} AS partner_iso3,
        {_HS} AS hs_raw,
        {_flow_sql(True)} AS flow_raw,
        {_value('l_extendedprice * (1 - l_discount) * (1 + l_tax) * 1000')} AS value_txt,{_COMMON_TAIL}
    FROM ({_LINES}) x)"""


def _tagged(src: str, name: str) -> str:
    return f"""{name} AS (
    SELECT *,
        CASE WHEN COALESCE(partner_key IN ({inlist(WORLD_PARTNER_CODES)}), FALSE) THEN 'world_partner'
             WHEN COALESCE(hs_norm IN ({inlist(AGGREGATE_HS_CODES)}), FALSE) THEN 'aggregate_hs'
             WHEN NOT COALESCE(regexp_matches(hs_code, '^[0-9]{{2}}$'), FALSE) THEN 'invalid_hs'
        END AS reject,
        {case('flow_code', FLOW_SIMPLE)} AS flow_direction_simple,
        {case('flow_code', FLOW_VALUATION)} AS valuation
    FROM (
        SELECT *,
            CASE WHEN regexp_matches(hs_norm, '^[0-9]{{1,2}}$') THEN lpad(hs_norm, 2, '0') ELSE hs_norm END AS hs_code,
            COALESCE({case('trim(flow_raw)', FLOW_CODE_LABELS)}, trim(flow_raw)) AS flow_code
        FROM (SELECT *, upper({stripped('hs_raw')}) AS hs_norm, {key_text('year_txt')} AS year_key,
                {key_text('reporter_code_txt')} AS reporter_key, {key_text('partner_code_txt')} AS partner_key,
                {number('value_txt')} AS trade_value_usd FROM {src}) a
    ) b)"""


def _clean(tagged: str, name: str, keys: str) -> str:
    return f"""{name} AS (
    SELECT TRY_CAST(year_key AS INTEGER) AS year, TRY_CAST(reporter_key AS INTEGER) AS reporter_code, reporter_iso3,
        TRY_CAST(partner_key AS INTEGER) AS partner_code, partner_iso3,
        hs_code, commodity_desc, flow_code, trade_value_usd, net_weight_kg, quantity, qty_unit,
        flow_direction_simple, valuation
    FROM {tagged}
    WHERE reject IS NULL
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY o1, o2, o3, o4, o5, o6) = 1)"""


_DEDUP5 = "year_key, reporter_key, partner_key, hs_code, flow_code"
_DEDUP4 = "year_key, partner_key, hs_code, flow_code"

CM_RAW = f"""cm_raw AS (
    SELECT {iso('n_nationkey')} AS iso3, n_name AS name,
        CASE WHEN n_nationkey NOT IN (1, 2, 8) THEN r_name END AS region,
        ['Low income', 'Lower middle income', 'Upper middle income', 'High income'][n_nationkey % 4 + 1]
            AS income_group,
        'X' || chr(CAST(65 + n_nationkey AS INTEGER)) AS iso2,
        CAST(NULL AS VARCHAR) AS capital,
        n_nationkey * 10 - 120 AS longitude,
        n_regionkey * 15 - 30 AS latitude,
        CASE WHEN n_nationkey % 10 <> 9 THEN CAST(n_nationkey AS VARCHAR) || '.0' END AS un_numeric
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _region_patch() -> str:
    parts = []
    for label, codes in REGION_OVERWRITE.items():
        parts.append(f"WHEN iso3 IN ({inlist(codes)}) THEN {q(label)}")
    for label, codes in REGION_FILL_IF_NULL.items():
        parts.append(f"WHEN iso3 IN ({inlist(codes)}) AND region IS NULL THEN {q(label)}")
    return "CASE " + " ".join(parts) + " ELSE region END"


DIM_COUNTRY = f"""dim_country AS (
    SELECT CAST(row_number() OVER (ORDER BY iso3) AS INTEGER) AS country_id,
        iso3 AS iso3_code, iso2 AS iso2_code, name AS country_name, {_region_patch()} AS region,
        CAST(NULL AS VARCHAR) AS sub_region, income_group,
        CAST(TRY_CAST(un_numeric AS DOUBLE) AS INTEGER) AS un_numeric,
        CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude
    FROM cm_raw
    WHERE iso3 IS NOT NULL AND name IS NOT NULL AND trim(name) <> '')"""


def _sections_case(ch: str, idx: int) -> str:
    whens = " ".join(f"WHEN {ch} BETWEEN {lo} AND {hi} THEN {q(s[idx])}"
                     for lo, hi, *s in HS_SECTIONS)
    return f"CASE {whens} ELSE {q('?' if idx == 0 else 'Unknown')} END"


CHAPTERS = f"""chapters AS (
    SELECT lpad(CAST(ch AS VARCHAR), 2, '0') AS chapter_code, CAST(ch AS INTEGER) AS chapter_int,
        [{inlist(HS_CHAPTER_NAMES)}][ch] AS chapter_name,
        {_sections_case('ch', 0)} AS section_num,
        {_sections_case('ch', 1)} AS section_name
    FROM range(1, 100) t(ch))"""

DIM_COMMODITY = """dim_commodity AS (
    SELECT CAST(row_number() OVER (ORDER BY chapter_code) AS INTEGER) AS commodity_id,
        chapter_code AS hs_chapter, chapter_name AS description, section_num AS section_code, section_name
    FROM chapters WHERE chapter_code IS NOT NULL)"""

DIM_TIME = """dim_time AS (
    SELECT y AS year, CAST(y // 10 * 10 AS VARCHAR) || 's' AS decade,
        CASE WHEN y <= 1997 THEN 'Early 1995-1997' WHEN y <= 1999 THEN 'Middle 1998-1999'
             ELSE 'Late 2000+' END AS period_label
    FROM (SELECT year AS y FROM clean_rep UNION SELECT year FROM clean_mir UNION SELECT year FROM stats_clean) t
    WHERE y IS NOT NULL)"""


def _country_of(iso3: str, code: str) -> str:
    """The country by its ISO3 code, else by its number, each looked up on its own."""
    by_iso = f"(SELECT d.country_id FROM dim_country d WHERE d.iso3_code = upper(trim({iso3})))"
    by_number = f"(SELECT d.country_id FROM dim_country d WHERE d.un_numeric = {code})"
    return f"COALESCE({by_iso}, {by_number})"


def _fact(src: str, name: str) -> str:
    return f"""{name} AS (
    SELECT s.year, {_country_of('s.reporter_iso3', 's.reporter_code')} AS reporter_id,
        {_country_of('s.partner_iso3', 's.partner_code')} AS partner_id,
        (SELECT c.commodity_id FROM dim_commodity c WHERE c.hs_chapter = s.hs_code) AS commodity_id,
        s.flow_direction_simple AS flow_direction, s.trade_value_usd, s.net_weight_kg, s.quantity, s.qty_unit, s.valuation,
        s.year AS k1, s.reporter_code AS k2, s.partner_code AS k3, s.hs_code AS k4, s.flow_code AS k5
    FROM {src} s)"""


_IND_ISO = f"CASE c_nationkey WHEN 0 THEN 'WLD' WHEN 9 THEN 'ZZX' ELSE {iso('c_nationkey')} END"

IND_RAW = f"""ind_raw AS (
    SELECT {_IND_ISO} AS country_iso3, n_name AS country_name, kind.code AS indicator, o_orderkey AS seq,
        CASE WHEN o_orderkey % 53 = 0 THEN '19x5' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year,
        CASE WHEN kind.code = 'SP.POP.TOTL' THEN CASE WHEN o_orderkey % 4 <> 1 THEN CAST(abs(c_acctbal) AS VARCHAR) END
             WHEN o_orderkey % 4 = 1 THEN 'n/a' WHEN o_orderkey % 4 = 2 THEN 'NaN' ELSE CAST(o_totalprice AS VARCHAR) END AS value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    CROSS JOIN (VALUES ('NY.GDP.MKTP.CD'), ('SP.POP.TOTL')) kind(code))"""

IND_LONG = f"""ind_long AS (
    SELECT * FROM (
        SELECT country_iso3, country_name, TRY_CAST(year AS INTEGER) AS year,
            COALESCE({case('indicator', INDICATOR_NAMES)}, indicator) AS indicator, {number('value')} AS value, seq
        FROM ind_raw) parsed
    WHERE value IS NOT NULL AND year IS NOT NULL
      AND NOT COALESCE(country_iso3 IN ({inlist(INDICATOR_AGGREGATE_ISO3)}), FALSE))"""

STATS_CLEAN = """stats_clean AS (
    SELECT *, CASE WHEN population <> 0 THEN gdp_usd / population END AS gdp_per_capita
    FROM (
        SELECT country_iso3, country_name, year,
            arg_min(value, seq) FILTER (WHERE indicator = 'gdp_usd') AS gdp_usd,
            arg_min(value, seq) FILTER (WHERE indicator = 'population') AS population
        FROM ind_long
        WHERE country_iso3 IS NOT NULL AND country_name IS NOT NULL AND year IS NOT NULL
        GROUP BY country_iso3, country_name, year) p)"""

FACT_STATS = """fact_country_stats AS (
    SELECT country_id, year, gdp_usd, population, gdp_per_capita FROM (
        SELECT dc.country_id, cs.year, cs.gdp_usd, cs.population, cs.gdp_per_capita,
            row_number() OVER (PARTITION BY dc.country_id, cs.year
                               ORDER BY cs.country_iso3, cs.country_name) AS rn
        FROM stats_clean cs
        JOIN dim_country dc ON upper(trim(cs.country_iso3)) = dc.iso3_code
        WHERE cs.country_iso3 IS NOT NULL AND cs.year IS NOT NULL) s
    WHERE rn = 1)"""

BASE = [
    RAW_REP, RAW_MIR,
    _tagged("raw_rep", "tag_rep"), _tagged("raw_mir", "tag_mir"),
    _clean("tag_rep", "clean_rep", _DEDUP5), _clean("tag_mir", "clean_mir", _DEDUP5),
    CM_RAW, DIM_COUNTRY, CHAPTERS, DIM_COMMODITY, IND_RAW, IND_LONG, STATS_CLEAN, DIM_TIME,
    _fact("clean_rep", "fact_trade"), _fact("clean_mir", "fact_mirror_trade"), FACT_STATS,
    _clean("tag_rep", "clean_rep4", _DEDUP4),
]


def with_base(body: str, *extra: str) -> str:
    """Full statement: the shared CTEs, any query-specific CTEs, then ``body``."""
    return "WITH " + ",\n".join([*BASE, *extra]) + "\n" + body
