"""Data-quality report.

Exact percentiles (D1) do not collect values into one task: distinct values
are ranked with ``keys.cumulative`` (range partitions written once) and
the values at the needed ranks are interpolated linearly between the two
neighbouring ranks (lo + (hi - lo) * fraction), like the reference.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.constants import NULL_RATE_HIGH, NULL_RATE_MODERATE
from tradeweave.functions.exprs import band, try_number
from tradeweave.operators.clean import null_pct
from tradeweave.operators.keys import cumulative
from tradeweave.session import written

QUANTILES = (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))


def distribution(df: DataFrame, col: str, exact: bool = True, num_partitions: int | None = None) -> DataFrame:
    """Min, p25, median, mean, p75, p95, max, sum of ``col`` (2 dp); NULL and
    unparseable values dropped. ``exact=False`` uses ``percentile_approx``.

    Exact mode counts rows per distinct value (combined map-side, so a value
    held by a third of the rows is one row), ranks the distinct values with
    ``keys.cumulative`` and reads the values covering the wanted ranks.
    """
    v = df.select(try_number(F.col(col)).alias("v")).where(F.col("v").isNotNull())
    if not exact:
        probs = [p for _, p in QUANTILES]
        a = v.agg(F.min("v").alias("min"), F.percentile_approx("v", probs, 100000).alias("_q"),
                  F.avg("v").alias("mean"), F.max("v").alias("max"), F.sum("v").alias("sum"))
        return a.select(F.round("min", 2).alias("min"),
                        *[F.round(F.col("_q")[i], 2).alias(n) for i, (n, _) in enumerate(QUANTILES)],
                        F.round("mean", 2).alias("mean"), F.round("max", 2).alias("max"),
                        F.round("sum", 2).alias("sum"))
    per_value = v.groupBy("v").agg(F.count(F.lit(1)).alias("_c"))
    r = cumulative(per_value, ["v"], F.col("_c"), "_start", num_partitions)
    start, total = F.col("_start"), F.col("_rk_total")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < start + F.col("_c")), F.col("v")))

    def pos(p: float) -> Column:
        return (total - 1) * F.lit(p)

    aggs = [at(F.lit(0)).alias("min"), at(total - 1).alias("max"),
            F.sum(F.col("v").cast("decimal(24,6)") * F.col("_c")).cast("double").alias("sum"), F.max(total).alias("_n")]
    for name, p in QUANTILES:
        lo, hi = at(F.floor(pos(p))), at(F.ceil(pos(p)))
        aggs.append((lo + (hi - lo) * F.max(pos(p) - F.floor(pos(p)))).alias(name))
    a = r.agg(*aggs)

    def cents(name: str) -> Column:
        # half a cent up, whatever the last bit of the interpolated double says
        return F.round(F.col(name).cast("decimal(24,6)"), 2).cast("double").alias(name)

    return a.select(F.round("min", 2).alias("min"),
                    *[cents(n) for n, _ in QUANTILES[:2]],
                    F.round(F.col("sum") / F.col("_n"), 2).alias("mean"),
                    *[cents(n) for n, _ in QUANTILES[2:]],
                    F.round("max", 2).alias("max"), F.round("sum", 2).alias("sum"))


def value_box(dist: DataFrame) -> DataFrame:
    """Q37: box statistics for the value distribution (fences at min and p95)."""
    return dist.select(F.col("min").alias("lower_fence"), F.col("p25").alias("q1"), "median", "mean",
                       F.col("p75").alias("q3"), F.col("p95").alias("upper_fence"))


def flow_report(flows: DataFrame, label: str) -> DataFrame:
    """D2 (flat): rows, year range, distinct partner and HS codes of a clean flow table."""
    # distinct counts over one row per (year, partner, chapter), not over all flows
    keys = flows.groupBy("year", "partner_code", "hs_code").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.lit(label).alias("source"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.count_distinct("partner_code").cast("long").alias("unique_partners"),
        F.count_distinct("hs_code").cast("long").alias("unique_hs_codes"),
    )


def rows_per(df: DataFrame, col: str) -> DataFrame:
    """D3: rows per value of ``col`` (NULL excluded)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("rows"))


def stats_report(stats: DataFrame) -> DataFrame:
    """D4 (flat): rows, distinct countries and year range of the country stats."""
    return stats.agg(F.count(F.lit(1)).alias("total_rows"),
                     F.count_distinct("country_iso3").cast("long").alias("unique_countries"),
                     F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def ref_report(df: DataFrame, label: str) -> DataFrame:
    """Rows and column list of a reference table."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.lit(label).alias("source"), "total_rows", F.lit(",".join(df.columns)).alias("columns"))


def null_severity(nulls: DataFrame) -> DataFrame:
    """Band per null rate: > 20 high, > 5 moderate, else low."""
    bands = [(NULL_RATE_HIGH, "high"), (NULL_RATE_MODERATE, "moderate")]
    return nulls.withColumn("severity", band(F.col("null_pct"), bands, "low", strict=True))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row with the row count of every warehouse table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
             for name, df in tables.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy().pivot("table_name", list(tables)).agg(F.first("rows"))


# --------------------------------------------------------------------------- D6
FLOW_NULL_COLS = ("trade_value_usd", "net_weight_kg", "quantity", "partner_iso3")
STATS_NULL_COLS = ("gdp_usd", "population", "gdp_per_capita")


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row frames with disjoint columns into one row (union + first
    non-NULL per column: no join between them)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in u.columns])


def _as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    # bounded: one entry per flow label / year / column
    return df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))
                  .alias(name))


def flow_report_frame(flows: DataFrame, label: str) -> DataFrame:
    """D2 (nested, one row): the full flow-table report as Spark structs and maps. Its five
    parts read the flows' columns from a table written once, so the flows are cleaned once."""
    used = dict.fromkeys(("year", "partner_code", "hs_code", "flow_code", "trade_value_usd", *FLOW_NULL_COLS))
    flows = written(flows.select(*[c for c in used if c in flows.columns]), "reported")
    flat = flow_report(flows, label).select(
        "source", "total_rows", F.array("year_min", "year_max").alias("year_range"), "unique_partners",
        "unique_hs_codes")
    dist = distribution(flows, "trade_value_usd")
    return one_row(
        flat,
        _as_map(rows_per(flows, "flow_code"), "flow_code", "rows", "flow_distribution"),
        _as_map(null_pct(flows, FLOW_NULL_COLS), "column_name", "null_pct", "null_percentages"),
        dist.select(F.struct(*dist.columns).alias("value_distribution")),
        _as_map(rows_per(flows, "year"), "year", "rows", "rows_per_year"),
    )


def stats_report_frame(stats: DataFrame) -> DataFrame:
    """D4 (nested, one row), from statistics written once."""
    used = dict.fromkeys(("country_iso3", "year", "gdp_usd", *STATS_NULL_COLS))
    stats = written(stats.select(*[c for c in used if c in stats.columns]), "reported")
    flat = stats_report(stats).select("total_rows", "unique_countries",
                                      F.array("year_min", "year_max").alias("year_range"))
    dist = distribution(stats, "gdp_usd")
    return one_row(flat, _as_map(null_pct(stats, STATS_NULL_COLS), "column_name", "null_pct", "null_percentages"),
                   dist.select(F.struct(*dist.columns).alias("gdp_distribution")))


def quality_report_frame(sources: Mapping[str, DataFrame]) -> DataFrame:
    """One-row nested report keyed by source (missing sources omitted), ready
    for the JSON sink. Every part is a distributed aggregate."""
    parts = []
    for key, label in (("trade_flows", "reporter"), ("mirror_flows", "mirror")):
        if sources.get(key) is not None:
            r = flow_report_frame(sources[key], label)
            parts.append(r.select(F.struct(*r.columns).alias(key)))
    if sources.get("country_stats") is not None:
        r = stats_report_frame(sources["country_stats"])
        parts.append(r.select(F.struct(*r.columns).alias("country_stats")))
    for key in ("hs_chapters", "country_mapping"):
        df = sources.get(key)
        if df is not None:
            cols = F.array(*[F.lit(c) for c in df.columns])
            parts.append(df.agg(F.struct(F.count(F.lit(1)).alias("total_rows"), cols.alias("columns")).alias(key)))
    src = one_row(*parts)
    return src.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("generated_at"),
                      F.struct(*src.columns).alias("sources"))


def report_lines(report: DataFrame) -> DataFrame:
    """D6 as rows (source, part, item, value): one per figure of the nested report."""
    def entry(source: str, part: str, item: Column, value: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), F.lit(part).alias("part"), item.cast("string").alias("item"), value.cast("double").alias("value"))

    def of_map(source: str, part: str):
        return lambda e: entry(source, part, e["key"], e["value"])

    arrays = []
    for source in report.schema["sources"].dataType.fields:
        for field in source.dataType.fields:
            c = F.col(f"sources.{source.name}.{field.name}")
            kind = field.dataType.typeName()
            if kind == "map":
                arrays.append(F.transform(F.map_entries(c), of_map(source.name, field.name)))
            elif kind == "struct":
                arrays.append(F.array(*[entry(source.name, field.name, F.lit(f.name), c[f.name]) for f in field.dataType.fields]))
            elif kind == "array" and field.name == "year_range":
                arrays.append(F.array(*[entry(source.name, field.name, F.lit(n), c[i]) for i, n in enumerate(("min", "max"))]))
            elif kind in ("long", "integer", "double"):
                arrays.append(F.array(entry(source.name, field.name, F.lit(""), c)))
    return report.select(F.explode(F.concat(*arrays)).alias("e")).select("e.*")


def quality_report(sources: Mapping[str, DataFrame]) -> dict:
    """D6 as a Python dict (the one report row, converted on the driver)."""
    return json.loads(quality_report_frame(sources).toJSON().first())


def report_frame(spark: SparkSession, report: dict) -> DataFrame:
    """A report dict back as a one-row DataFrame of nested structs."""
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(report, default=str)]))
