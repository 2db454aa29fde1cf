"""Registered queries of the SQL functions, the stored summaries, and sources and sinks written and read back."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.operators import partner as PAR
from tradeweave.operators import quality as QU
from tradeweave.operators import summaries as SU
from tradeweave.operators.commodity import year_range
from tradeweave.operators.star import Star
from tradeweave.params import TradeFilter
from tradeweave.plans import oracle as O
from tradeweave.plans import sql_functions as SF
from tradeweave.plans.registry import (
    ALL, CHAPTER, FLOWS, PARAMS, PARTNER, RANGE, REGISTRY, SECTION, _payload_folder, feed_files, register, report_sql, years_sql)
from tradeweave.session import ensure_checkpoint_dir, written
from tradeweave.sources import files as FI
from tradeweave.sources import standin
from tradeweave.sources.clustered import write_clustered
from tradeweave.sources.files import RAW_FLOW_COLUMNS
from tradeweave.sources.payloads import flatten_indicator_variant
from tradeweave.sources.standin import iso3_of
from tradeweave.streaming.keyed_stream import land_by_key


def _spark(s: Star) -> SparkSession:
    return s.dim_country.sparkSession


def _folder(s: Star, name: str) -> str:
    return f"{ensure_checkpoint_dir(_spark(s)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def twin(name: str) -> str:
    return REGISTRY[name][1]


# =========================================================================== SQL table functions (F1–F4 as bound parameters)
def _called(s: Star, function: str, **args) -> DataFrame:
    SF.register_functions(_spark(s), s)
    return SF.call(_spark(s), SF.PREFIX + function, **args)


_years = {"year_from": RANGE.year_min, "year_to": RANGE.year_max}
_min_share, _high_share = PARAMS["alert_shares"]
#: query → (function, arguments, query with the same answer)
CALLS = {
    "sql_balance_series": ("balance_series", _years, "q7_balance_series"),
    "sql_top_partners": ("top_partners", _years, "q8_top_partners"),
    "sql_section_hhi": ("section_hhi", {"flow": "Imports"}, "q11_hhi"),
    "sql_supplier_alerts": ("supplier_alerts", {"flow": "Imports", "min_share": _min_share, "high_share": _high_share}, "q15_alerts"),
    "sql_partner_annual": ("partner_annual", {"partner": PARTNER}, "q18_one_partner"),
    "sql_section_partners": ("section_partners", {"section": SECTION}, "q28_one_section"),
    "sql_chapter_partners": ("chapter_partners", {"chapter": CHAPTER}, "q33_one_chapter"),
}
for _name, (_function, _args, _like) in CALLS.items():
    register(_name, twin(_like))(lambda s, function=_function, args=_args: _called(s, function, **args))


@register("sql_emerging_suppliers", twin("q30_emerging"))
def sql_emerging_suppliers(s):
    """All sections over the data's years, in periods of three years."""
    lo, hi = year_range(s, ALL)
    return _called(s, "emerging_suppliers", year_from=lo, year_to=hi, flow="Both")


# =========================================================================== stored summaries
@register("q5_distinct_by_range", O.with_base("""
SELECT CAST(a.y AS INTEGER) AS year_from, CAST(b.y AS INTEGER) AS year_to, COUNT(DISTINCT cid) AS partners, COUNT(DISTINCT ch_id) AS chapters
FROM every a JOIN every b ON a.y <= b.y JOIN flows ON year BETWEEN a.y AND b.y GROUP BY a.y, b.y""", FLOWS,
    "every AS (SELECT unnest(range(MIN(year), MAX(year) + 1)) AS y FROM flows)"))
def q5_distinct_by_range(s):
    """Distinct partners and chapters of every range of years, from bitmaps per year."""
    return SU.distinct_by_range({"partners": SU.summary(s, "partner_bitmaps"), "chapters": SU.summary(s, "chapter_bitmaps")})


@register("q18_chapters_in_range", O.with_base(f"""
SELECT cid AS partner_id, COUNT(DISTINCT ch_id) FILTER (WHERE inward) AS import_chapters, COUNT(DISTINCT ch_id) FILTER (WHERE outward) AS export_chapters
FROM flows WHERE {years_sql(RANGE)} AND (inward OR outward) AND ch_id IS NOT NULL GROUP BY cid""", FLOWS))
def q18_chapters_in_range(s):
    """Distinct chapters of every partner in a range of years, from bitmaps per year and partner."""
    return SU.chapters_in_range(SU.summary(s, "partner_chapter_bitmaps"), RANGE)


@register("d1_sketch_ranks", O.with_base("""
SELECT flow_code, n, quantile, p, TRUE AS within_error
FROM (SELECT flow_code, COUNT(trade_value_usd) AS n FROM clean_rep WHERE flow_code IS NOT NULL AND trade_value_usd IS NOT NULL GROUP BY flow_code)
CROSS JOIN (VALUES ('p25', CAST(0.25 AS DOUBLE)), ('median', 0.5), ('p75', 0.75), ('p95', 0.95)) q(quantile, p)"""))
def d1_sketch_ranks(s):
    """Quantiles per flow label from the years' merged sketches, their exact ranks counted in the flows: within twice the
    stated error (which holds for 99 % of all quantiles)."""
    q = SU.range_distribution(SU.summary(s, "value_sketches"), by=("flow_code",))
    ranks = SU.quantile_ranks(s.staging["trade_flows"], q)
    return ranks.select("flow_code", "n", "quantile", "p", SU.within(2 * SU.rank_error()).alias("within_error"))


# =========================================================================== sources and sinks, written and read back
@register("f4_clustered_partner", twin("q18_one_partner"))
def f4_clustered_partner(s):
    """The fact written clustered by partner and chapter; one partner's years read from it."""
    path = _folder(s, "clustered")
    # the stand-in fact has no key yet: equal rows may lie anywhere
    write_clustered(s.fact_trade, path, tie="trade_value_usd")
    fact = _spark(s).read.schema(s.fact_trade.schema).parquet(path)
    return PAR.partner_annual(replace(s, fact_trade=fact), TradeFilter(partner_id=PARTNER))


def _fact_figures(fact: DataFrame) -> DataFrame:
    value = F.col("trade_value_usd")
    return fact.groupBy("year", "flow_direction", "partner_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(value).alias("value"), F.count("net_weight_kg").alias("with_weight"), F.count_if(value > 0).alias("positive"))


@register("s4_fact_parquet", twin("s11_incremental_load"))
def s4_fact_parquet(s):
    """The fact written by year and read back."""
    path = _folder(s, "processed")
    FI.write_processed(s.fact_trade, path, ["year"])
    return _fact_figures(FI.read_processed(_spark(s), path))


@register("s3_fact_csv", twin("s11_incremental_load"))
def s3_fact_csv(s):
    """The fact written as CSV and read as text by its header."""
    path = _folder(s, "exported")
    columns = ["year", "flow_direction", "partner_id", "trade_value_usd", "net_weight_kg"]
    FI.write_csv(s.fact_trade.select(*columns), path)
    text = FI.read_raw(_spark(s), path, columns, with_ingest_order=False)
    return _fact_figures(text.select(F.col("year").cast("int"), "flow_direction", F.col("partner_id").cast("int"),
                                     F.col("trade_value_usd").cast("double"), F.col("net_weight_kg").cast("double")))


@register("s5_report_json", O.with_base(report_sql(("country_stats", "hs_chapters", "country_mapping"))))
def s5_report_json(s):
    """The report on statistics and references written as JSON and read back, a row per figure."""
    path, st = _folder(s, "report"), s.staging
    FI.write_report(_spark(s), QU.quality_report_frame({"country_stats": st["country_stats"], "hs_chapters": st["hs_chapters"], "country_mapping": st["countries"]}), path)
    return QU.report_lines(FI.read_report(_spark(s), path))


@register("s7_variant_payload", f"""
SELECT {O.iso('c_nationkey')} AS country_iso3, CAST(year(o_orderdate) AS VARCHAR) AS year, COUNT(*) AS rows,
    COUNT(*) FILTER (WHERE o_orderkey % 11 <> 0) AS with_value, MAX(o_totalprice) FILTER (WHERE o_orderkey % 11 <> 0) AS highest,
    COUNT(*) FILTER (WHERE o_orderkey % 22 = 11) AS odd_values, COUNT(*) FILTER (WHERE o_orderkey % 3 = 0) AS with_status,
    MAX(o_orderstatus) FILTER (WHERE o_orderkey % 3 = 0) AS last_status, CAST(SUM(o_custkey) AS BIGINT) AS customers
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate)""")
def s7_variant_payload(s):
    """Orders rendered as pages of an indicator API: some values are texts or NULL, some records have fields that no one declared."""
    spark = _spark(s)
    o, c = (spark.read.parquet(f"{s.source_dir}/{t}.parquet") for t in ("orders", "customer"))
    key = F.col("o_orderkey")
    value = F.when(key % 22 == 11, F.lit('"n/a"')).when(key % 11 == 0, F.lit("null")).otherwise(F.col("o_totalprice").cast("string"))
    status = F.when(key % 3 == 0, F.concat(F.lit(',"obs_status":"'), "o_orderstatus", F.lit('"'))).otherwise("")
    record = F.format_string('{"countryiso3code":"%s","country":{"id":"x","value":"y"},"date":"%s","value":%s,"source":{"customer":%s}%s}',
                             iso3_of(F.col("c_nationkey")), F.year("o_orderdate").cast("string"), value, F.col("o_custkey").cast("string"), status)
    pages = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.floor(key / 2000).alias("page")).agg(
        F.concat(F.lit("["), F.concat_ws(",", F.collect_list(record)), F.lit("]")).alias("records"))
    rows = flatten_indicator_variant(spark, _payload_folder(pages, "variants"), "NY.GDP.MKTP.CD").select(
        "country_iso3", "year", "value", F.expr("try_variant_get(rest['value'], '$', 'string')").alias("odd"),
        F.expr("try_variant_get(rest['obs_status'], '$', 'string')").alias("status"), F.expr("try_variant_get(rest['source'], '$.customer', 'bigint')").alias("customer"))
    return rows.groupBy("country_iso3", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_value"), F.max("value").alias("highest"), F.count("odd").alias("odd_values"),
        F.count("status").alias("with_status"), F.max("status").alias("last_status"), F.sum("customer").alias("customers"))


@register("s9_keyed_stream", O.with_base("""
SELECT year, flow_code, COUNT(*) AS rows, SUM(trade_value_usd) AS value, COUNT(DISTINCT partner_code) AS partners, COUNT(DISTINCT hs_code) AS chapters
FROM clean_rep GROUP BY year, flow_code"""))
def s9_keyed_stream(s):
    """The reporter feed as CSV files landed in two runs of the keyed stream; the second holds records of its own and, again,
    a part of those of the first."""
    raw = s.staging["raw_reporter"]
    root = _folder(s, "keyed")
    # all records of one partner are new in one run; inside it files and rows follow the ingest order
    second = F.coalesce(F.trim(F.regexp_replace("partnerCode", "[.]0$", "")).try_cast("int") % 2 == 1, F.lit(False))
    feed = written(raw.select(*RAW_FLOW_COLUMNS, *standin.INGEST_ORDER, second.alias("_second")), "feed")
    again = F.pmod(F.xxhash64(*standin.INGEST_ORDER), F.lit(5)) == 0
    for k, part in enumerate((feed.where(~F.col("_second")), feed.where(F.col("_second") | again))):
        ordered = part.repartitionByRange(feed_files(part), *standin.INGEST_ORDER).sortWithinPartitions(*standin.INGEST_ORDER)
        ordered.select(*RAW_FLOW_COLUMNS).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(f"{root}/in/run{k}")
        clean = land_by_key(_spark(s), f"{root}/in", f"{root}/out")
    return clean.groupBy("year", "flow_code").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("trade_value_usd").alias("value"), F.count_distinct("partner_code").alias("partners"), F.count_distinct("hs_code").alias("chapters"))
