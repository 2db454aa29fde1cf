"""Star-schema load and referential checks.

Keyed dimensions (countries, chapters) are bounded by their numbering and joined by
broadcast; facts are never globally sorted: the optional
contiguous key (``keyed_facts``) comes from the range partitions of ``keys``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.constants import MIRROR_KEY_OFFSET, REGION_FILL_IF_NULL, REGION_OVERWRITE
from tradeweave.functions.exprs import norm_code, strip, to_int, try_number
from tradeweave.operators.keys import with_dim_key, with_sequential_key

FACT_COLUMNS = ("year", "reporter_id", "partner_id", "commodity_id", "flow_direction",
                "trade_value_usd", "net_weight_kg", "quantity", "qty_unit", "valuation")
#: Declared schema of a loaded fact (read back with it: no inference, and an
#: empty year-partitioned fact still has a schema).
FACT_SCHEMA = ("trade_id bigint, year int, reporter_id int, partner_id int, commodity_id int, "
               "flow_direction string, trade_value_usd double, net_weight_kg double, quantity double, "
               "qty_unit string, valuation string")


@dataclass
class Star:
    """The warehouse: three dimensions, three facts, plus the staging tables."""

    dim_country: DataFrame
    dim_commodity: DataFrame
    dim_time: DataFrame
    fact_trade: DataFrame
    fact_mirror_trade: DataFrame
    fact_country_stats: DataFrame
    staging: dict[str, DataFrame] = field(default_factory=dict)
    #: Folder of the tables that the stand-in inputs are shaped from ('' for landed inputs).
    source_dir: str = ""

    def dim(self, name: str) -> DataFrame:
        """Dimension to join. The keyed ones have at most ``DIM_MAX_ROWS`` rows (their numbering
        raises beyond), so they are broadcast; the time dimension is left to Spark."""
        return getattr(self, name) if name == "dim_time" else F.broadcast(getattr(self, name))

    def tables(self) -> dict[str, DataFrame]:
        return {"dim_country": self.dim_country, "dim_commodity": self.dim_commodity,
                "dim_time": self.dim_time, "fact_trade": self.fact_trade,
                "fact_mirror_trade": self.fact_mirror_trade, "fact_country_stats": self.fact_country_stats}


def _col(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


# --------------------------------------------------------------------------- L1 + L7
def build_dim_country(countries: DataFrame) -> DataFrame:
    """L1: country dimension keyed by ISO3 order; rows without ISO3 or name dropped."""
    c = countries.where(F.col("iso3").isNotNull() & F.col("name").isNotNull() & (strip("name") != ""))
    c = c.select(
        F.col("iso3").alias("iso3_code"),
        _col(c, "iso2").alias("iso2_code"),
        F.col("name").alias("country_name"),
        _col(c, "region").alias("region"),
        F.lit(None).cast("string").alias("sub_region"),
        _col(c, "income_group").alias("income_group"),
        to_int(_col(c, "un_numeric")).alias("un_numeric"),
        try_number(_col(c, "latitude")).alias("latitude"),
        try_number(_col(c, "longitude")).alias("longitude"),
    )
    return with_dim_key(c, ["iso3_code"], "country_id")


def build_dim_commodity(chapters: DataFrame) -> DataFrame:
    """L1: commodity dimension keyed by chapter-code order."""
    c = chapters.where(F.col("chapter_code").isNotNull()).select(
        F.col("chapter_code").alias("hs_chapter"),
        F.col("chapter_name").alias("description"),
        F.col("section_num").cast("string").alias("section_code"),
        F.col("section_name"),
    )
    return with_dim_key(c, ["hs_chapter"], "commodity_id")


def patch_regions(dim: DataFrame, overwrite: Mapping[str, Sequence[str]] = REGION_OVERWRITE,
                  fill_if_null: Mapping[str, Sequence[str]] = REGION_FILL_IF_NULL) -> DataFrame:
    """Listed countries get a region unconditionally; others only when NULL."""
    iso, region = F.col("iso3_code"), F.col("region")
    expr = None
    for label, codes in overwrite.items():
        cond = iso.isin(*codes)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    for label, codes in fill_if_null.items():
        cond = iso.isin(*codes) & region.isNull()
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return dim if expr is None else dim.withColumn("region", expr.otherwise(region))


def region_coverage(dim: DataFrame) -> DataFrame:
    """Countries with and without a region."""
    return dim.agg(F.count("region").alias("region_set"),
                   F.count_if(F.col("region").isNull()).alias("region_null"))


# --------------------------------------------------------------------------- L3
def resolve_keys(flows: DataFrame, dim_country: DataFrame, dim_commodity: DataFrame) -> DataFrame:
    """L3: two-stage country resolution and chapter lookup → fact rows.

    Reporter and partner: ISO3 (upper/trim) first; the numeric-code lookup
    only applies when the ISO3 lookup missed; otherwise NULL. Commodity by
    the zero-padded chapter. Five left joins against broadcast dimensions.
    """
    iso_keys = dim_country.select("iso3_code", "country_id")
    num_keys = dim_country.where(F.col("un_numeric").isNotNull()).select("un_numeric", "country_id")
    f = flows
    for role in ("reporter", "partner"):
        iso_col = norm_code(_col(flows, f"{role}_iso3"))
        code_col = _col(flows, f"{role}_code", "int").cast("int")
        f = f.withColumns({f"_{role}_iso": iso_col, f"_{role}_num": code_col})
        iso_dim = iso_keys.select(F.col("iso3_code").alias(f"_{role}_iso_k"),
                                  F.col("country_id").alias(f"_{role}_by_iso"))
        num_dim = num_keys.select(F.col("un_numeric").alias(f"_{role}_num_k"),
                                  F.col("country_id").alias(f"_{role}_by_num"))
        f = f.join(F.broadcast(iso_dim), F.col(f"_{role}_iso") == F.col(f"_{role}_iso_k"), "left")
        f = f.join(F.broadcast(num_dim),
                   (F.col(f"_{role}_num") == F.col(f"_{role}_num_k")) & F.col(f"_{role}_by_iso").isNull(), "left")
    com = dim_commodity.select(F.col("hs_chapter").alias("_hs_k"), F.col("commodity_id"))
    f = f.join(F.broadcast(com),
               F.lpad(strip(_col(flows, "hs_code")), 2, "0") == F.col("_hs_k"), "left")
    return f.select(
        F.col("year").cast("int").alias("year"),
        F.coalesce("_reporter_by_iso", "_reporter_by_num").alias("reporter_id"),
        F.coalesce("_partner_by_iso", "_partner_by_num").alias("partner_id"),
        F.col("commodity_id"),
        _col(flows, "flow_direction_simple").alias("flow_direction"),
        _col(flows, "trade_value_usd", "double").cast("double").alias("trade_value_usd"),
        _col(flows, "net_weight_kg", "double").cast("double").alias("net_weight_kg"),
        try_number(_col(flows, "quantity")).alias("quantity"),
        _col(flows, "qty_unit").alias("qty_unit"),
        _col(flows, "valuation").alias("valuation"),
        *[F.col(c) for c in flows.columns if c.startswith("_key_")],
    )


def key_order_columns(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Carry the clean-flow business key as hidden ``_key_*`` columns for fact keying."""
    return flows.withColumns({f"_key_{k}": F.col(k) for k in keys if k in flows.columns})


# --------------------------------------------------------------------------- L2
def with_fact_key(fact: DataFrame, offset: int = 0, num_partitions: int | None = None) -> DataFrame:
    """L2: trade_id = offset + position in business-key order (no global window)."""
    if "trade_id" in fact.columns:  # re-keying a loaded fact keeps its existing order
        fact = fact.withColumnRenamed("trade_id", "_key_trade_id")
    order = [c for c in fact.columns if c.startswith("_key_")] or [
        "year", "reporter_id", "partner_id", "commodity_id", "flow_direction", "trade_value_usd"]
    # texts that are no number share the key NULL: the other columns settle the order of those
    order += [c for c in FACT_COLUMNS if c not in order]
    keyed = with_sequential_key(fact, order, "trade_id", offset, num_partitions)
    return keyed.select("trade_id", *[c for c in FACT_COLUMNS])


def with_mirror_key(mirror: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """The mirror fact's keys: its own table, its own key space from a fixed offset on."""
    return with_fact_key(mirror, MIRROR_KEY_OFFSET, num_partitions)


def keyed_facts(star: Star, num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both facts with contiguous keys."""
    return with_fact_key(star.fact_trade, 0, num_partitions), with_mirror_key(star.fact_mirror_trade, num_partitions)


# --------------------------------------------------------------------------- L4
def fk_resolution(fact: DataFrame) -> DataFrame:
    """L4: unresolved reporter / partner / commodity counts and percentages (1 dp)."""
    n = F.count(F.lit(1))
    out = fact.agg(n.alias("total_rows"),
                   F.count_if(F.col("reporter_id").isNull()).alias("reporter_unresolved"),
                   F.count_if(F.col("partner_id").isNull()).alias("partner_unresolved"),
                   F.count_if(F.col("commodity_id").isNull()).alias("commodity_unresolved"))
    return out.withColumns({
        f"{k}_unresolved_pct": F.round(F.when(F.col("total_rows") > 0,
                                              F.col(f"{k}_unresolved") * 100.0 / F.col("total_rows")), 1)
        for k in ("reporter", "partner", "commodity")
    })


# --------------------------------------------------------------------------- L5/L6
def load_country_stats(stats: DataFrame, dim_country: DataFrame, dim_time: DataFrame) -> DataFrame:
    """Stats joined to the country and time dimensions; the first row per
    (country_id, year) in (iso3, name) order wins, later conflicts are ignored."""
    s = stats.where(F.col("country_iso3").isNotNull() & F.col("year").isNotNull())
    dc = dim_country.select(F.col("iso3_code").alias("_iso_k"), "country_id")
    dt = dim_time.select(F.col("year").alias("_year_k"))
    j = (s.join(F.broadcast(dc), norm_code("country_iso3") == F.col("_iso_k"))
          .join(dt, F.col("year") == F.col("_year_k")))
    row = F.struct(try_number(F.col("gdp_usd")).alias("gdp_usd"),
                   try_number(F.col("population")).alias("population"),
                   try_number(F.col("gdp_per_capita")).alias("gdp_per_capita"))
    first = j.groupBy("country_id", F.col("year").cast("int").alias("year")).agg(
        F.min_by(row, F.struct("country_iso3", "country_name")).alias("_r"))
    return first.select("country_id", "year", "_r.gdp_usd", "_r.population", "_r.gdp_per_capita")


def unmatched_keys(stats: DataFrame, dim_country: DataFrame) -> DataFrame:
    """Distinct stats ISO3 codes with no country in the dimension."""
    dc = dim_country.select(F.col("iso3_code").alias("_iso_k"))
    miss = stats.where(F.col("country_iso3").isNotNull()).join(
        F.broadcast(dc), norm_code("country_iso3") == F.col("_iso_k"), "left_anti")
    return miss.agg(F.count_distinct("country_iso3").alias("unmatched_iso3"))


# --------------------------------------------------------------------------- L9–L11
def validation_counts(star: Star) -> DataFrame:
    """Row counts of the six tables and distinct years/partners/commodities, as (metric, value)."""
    parts = [df.agg(F.count(F.lit(1)).cast("long").alias("value")).select(F.lit(f"{name} rows").alias("metric"), "value")
             for name, df in star.tables().items()]
    # one pass over the fact; the sets are those of dimension keys, so bounded and small
    ft = star.fact_trade.groupBy("year", "partner_id", "commodity_id").agg(F.count(F.lit(1)).alias("n"))
    sets = ft.agg(*[F.collect_set(c).alias(c) for c in ("year", "partner_id", "commodity_id")])
    parts.append(sets.select(
        F.size("year").cast("long").alias("y"), F.size("partner_id").cast("long").alias("p"),
        F.size("commodity_id").cast("long").alias("c"),
    ).select(F.explode(F.array(
        F.struct(F.lit("fact_trade distinct years").alias("metric"), F.col("y").alias("value")),
        F.struct(F.lit("fact_trade distinct partners").alias("metric"), F.col("p").alias("value")),
        F.struct(F.lit("fact_trade distinct commodities").alias("metric"), F.col("c").alias("value")),
    )).alias("m")).select("m.metric", "m.value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def total_positive(fact: DataFrame) -> DataFrame:
    """Total positive trade value in billions."""
    return fact.where(F.col("trade_value_usd") > 0).agg(
        (F.sum("trade_value_usd") / 1e9).alias("total_positive_b"))


def _dup_count(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return (df.groupBy(*keys).count().where(F.col("count") > 1)
              .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations"))
              .select(F.lit(name).alias("check_name"), "violations"))


def _fk_pass(fact: DataFrame, fname: str, fks: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """All FK checks of one fact in one scan: left joins against the (broadcast)
    dimension keys, then one aggregate counting non-NULL keys without a match."""
    j = fact.select(*[c for c, _, _ in fks])
    for i, (col, dim, dcol) in enumerate(fks):
        keys = dim.select(F.col(dcol).alias(f"_fk{i}"), F.lit(True).alias(f"_hit{i}")).distinct()
        j = j.join(keys, F.col(col) == F.col(f"_fk{i}"), "left")
    counts = j.agg(*[F.count_if(F.col(col).isNotNull() & F.col(f"_hit{i}").isNull()).cast("long").alias(f"c{i}")
                     for i, (col, _, _) in enumerate(fks)])
    entries = F.array(*[F.struct(F.lit(f"fk {fname}.{col}").alias("check_name"), F.col(f"c{i}").alias("violations"))
                        for i, (col, _, _) in enumerate(fks)])
    return counts.select(F.explode(entries).alias("e")).select("e.check_name", "e.violations")


def check_constraints(star: Star, keyed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The declared PK / FK / NOT NULL constraints as a (check_name, violations) table.

    Each fact is scanned once for all its foreign keys; primary keys of the
    facts are checked only when keyed facts are given.
    """
    parts = [
        _dup_count(star.dim_country, ["country_id"], "pk dim_country"),
        _dup_count(star.dim_commodity, ["commodity_id"], "pk dim_commodity"),
        _dup_count(star.dim_time, ["year"], "pk dim_time"),
        _dup_count(star.fact_country_stats, ["country_id", "year"], "pk fact_country_stats"),
        star.dim_commodity.agg(F.count_if(F.col("hs_chapter").isNull()).cast("long").alias("violations"))
        .select(F.lit("not null dim_commodity.hs_chapter").alias("check_name"), "violations"),
    ]
    for fname in ("fact_trade", "fact_mirror_trade"):
        parts.append(_fk_pass(getattr(star, fname), fname, [
            ("year", star.dim_time, "year"),
            ("reporter_id", star.dim_country, "country_id"),
            ("partner_id", star.dim_country, "country_id"),
            ("commodity_id", star.dim_commodity, "commodity_id"),
        ]))
    parts.append(_fk_pass(star.fact_country_stats, "fact_country_stats", [
        ("country_id", star.dim_country, "country_id"), ("year", star.dim_time, "year")]))
    if keyed is not None:
        parts += [_dup_count(keyed[0], ["trade_id"], "pk fact_trade"),
                  _dup_count(keyed[1], ["trade_id"], "pk fact_mirror_trade")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
