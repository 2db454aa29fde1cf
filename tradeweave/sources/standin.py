"""Stand-in raw inputs built from the driver's TPC-H-like tables.

The trade pipeline expects landed raw files: annual flow records (all text),
a mirror feed reported by partner countries, a country reference and a long
indicator feed. The driver ships none of those, so this module shapes its
tables into rows of exactly those schemas and nothing more: no cleaning, no
dedup, no key resolution, no aggregation happens here.

Mapping (one raw flow record per line item):

* reporter = the ordering customer's nation, partner = the supplier's nation;
  a nation's ISO3 code is ``N`` + two digits, its numeric code the key;
* year = ship year; HS chapter = the part brand number, with part sizes 50,
  49 and 48 standing for the dirty codes ``TOTAL``, ``99`` and ``8471``;
* flow code from (return flag, line status): A→M, N→X, R/F→RM, R/O→RX;
* value = whole USD: the discounted price read in thousands; the mirror feed (reported by
  the supplier nation, order year) adds tax and swaps the direction;
* partner ISO3 is missing for nations ≡ 4 (mod 5) and reporter ISO3 is
  lower-case and padded for nations ≡ 1 (mod 3), so both key-resolution
  stages and code normalisation have work to do; nation 5 reports its mirror
  flows under an ISO3 and a number that no country has;
* dirt that landed files carry: values ``n/a``, ``NaN``, ``Infinity``, NULL, zero and
  negative, an unknown flow, codes with a tab or as ``12.0``, a year that is none,
  indicators whose first value or year does not parse, an aggregate and an unknown
  ISO3, countries without a region. Every source row is there; only cells are shaped;
* ingest order = (order key, line number, part, supplier, ship date, price),
  unique at every scale.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.sources.reference import hs_chapters

INGEST_ORDER = ("_ing_orderkey", "_ing_linenumber", "_ing_partkey", "_ing_suppkey", "_ing_shipdate", "_ing_price")

#: Cells that are no plain positive number, by ``order key % 97``.
ODD_VALUES = {0: "n/a", 1: "NaN", 2: "0", 3: "Infinity", 5: " 12.5 ", 6: "1e400"}


@dataclass(frozen=True)
class RawInputs:
    """Landed raw inputs of one pipeline run."""

    reporter_flows: DataFrame
    mirror_flows: DataFrame
    country_mapping: DataFrame
    hs_chapters: DataFrame
    indicators: DataFrame
    flow_order: tuple[str, ...] = INGEST_ORDER
    indicator_order: tuple[str, ...] = ("_ing_seq",)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def iso3_of(nation: Column) -> Column:
    return F.concat(F.lit("N"), F.lpad(nation.cast("string"), 2, "0"))


def _flow_code(returnflag: Column, linestatus: Column, mirror: bool) -> Column:
    imp, exp, reimp, reexp = ("X", "M", "RX", "RM") if mirror else ("M", "X", "RM", "RX")
    return (F.when(F.col("l_orderkey") % 101 == 0, "Q").when(returnflag == "A", imp).when(returnflag == "N", exp)
            .when(linestatus == "F", reimp).otherwise(reexp))


def _number_text(n: Column) -> Column:
    """The same number as plain text, with a tab in front, or as a decimal."""
    t, k = n.cast("string"), F.col("l_orderkey") % 3
    return F.when(k == 1, F.concat(F.lit("\t"), t)).when(k == 2, F.concat(t, F.lit(".0"))).otherwise(t)


def _year_text(day: Column) -> Column:
    year = F.year(day)
    return F.when(F.col("l_orderkey") % 499 == 0, "20x0").otherwise(_number_text(year))


def _value_text(value: Column) -> Column:
    key = F.col("l_orderkey") % 97
    out = F.when(key == 4, F.lit(None).cast("string")).when(key == 7, F.concat(F.lit("-"), value.cast("string")))
    for k, text in ODD_VALUES.items():
        out = out.when(key == k, text)
    return out.otherwise(value.cast("string"))


def _hs_code(brand: Column, size: Column) -> Column:
    return (F.when(size == 50, "TOTAL").when(size == 49, "99").when(size == 48, "8471")
            .when(size == 47, F.lpad(size.cast("string"), 3, "\t"))
            .otherwise(F.substring_index(brand, "#", -1)))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    # customers join the orders, not the lines, of which there are several for each order
    return (li.join(o.join(c, o.o_custkey == c.c_custkey), li.l_orderkey == o.o_orderkey)
              .join(s, li.l_suppkey == s.s_suppkey)
              .join(p, li.l_partkey == p.p_partkey))


def _ingest_cols() -> list[Column]:
    return [F.col("l_orderkey").alias("_ing_orderkey"), F.col("l_linenumber").alias("_ing_linenumber"),
            F.col("l_partkey").alias("_ing_partkey"), F.col("l_suppkey").alias("_ing_suppkey"),
            F.col("l_shipdate").alias("_ing_shipdate"), F.col("l_extendedprice").alias("_ing_price")]


def _common(lines: DataFrame) -> list[Column]:
    return [
        _hs_code(F.col("p_brand"), F.col("p_size")).alias("cmdCode"),
        F.col("p_type").alias("cmdDesc"),
        F.when(F.col("l_linenumber") % 5 != 0, (F.col("l_quantity") * F.col("p_size")).cast("string")).alias("netWgt"),
        F.col("l_quantity").cast("string").alias("qty"),
        F.lit("kg").alias("qtyUnitAbbr"),
    ]


def reporter_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw annual flow records as reported by the home (customer) nation."""
    lines = _lines(spark, sf_dir)
    rep, par = F.col("c_nationkey"), F.col("s_nationkey")
    rep_iso = F.when(rep % 3 == 1, F.concat(F.lit(" "), F.lower(iso3_of(rep)), F.lit(" "))).otherwise(iso3_of(rep))
    return lines.select(
        _year_text(F.col("l_shipdate")).alias("refYear"),
        _number_text(rep).alias("reporterCode"),
        rep_iso.alias("reporterISO"),
        _number_text(par).alias("partnerCode"),
        F.when(par % 5 != 4, iso3_of(par)).alias("partnerISO"),
        *_common(lines)[:2],
        _flow_code(F.col("l_returnflag"), F.col("l_linestatus"), mirror=False).alias("flowCode"),
        _value_text(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 1000)).alias("primaryValue"),
        *_common(lines)[2:],
        *_ingest_cols(),
    )


def mirror_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw flow records as reported by the partner (supplier) nation about the home nation."""
    lines = _lines(spark, sf_dir)
    rep, par = F.col("s_nationkey"), F.col("c_nationkey")
    return lines.select(
        _year_text(F.col("o_orderdate")).alias("refYear"),
        F.when(rep == 5, "999").otherwise(_number_text(rep)).alias("reporterCode"),
        F.when(rep == 5, "ZZX").otherwise(iso3_of(rep)).alias("reporterISO"),
        _number_text(par).alias("partnerCode"),
        iso3_of(par).alias("partnerISO"),
        *_common(lines)[:2],
        _flow_code(F.col("l_returnflag"), F.col("l_linestatus"), mirror=True).alias("flowCode"),
        _value_text(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * 1000))
        .alias("primaryValue"),
        *_common(lines)[2:],
        *_ingest_cols(),
    )


def country_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw country reference (text columns), one row per nation."""
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    income = F.element_at(F.array(F.lit("Low income"), F.lit("Lower middle income"),
                                  F.lit("Upper middle income"), F.lit("High income")), (k % 4 + 1).cast("int"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        iso3_of(k).alias("iso3"),
        F.col("n_name").alias("name"),
        F.when(~k.isin(1, 2, 8), F.col("r_name")).alias("region"),
        income.alias("income_group"),
        F.concat(F.lit("X"), F.chr(65 + k)).alias("iso2"),
        F.lit(None).cast("string").alias("capital"),
        (k * 10 - 120).cast("string").alias("longitude"),
        (F.col("n_regionkey") * 15 - 30).cast("string").alias("latitude"),
        F.when(k % 10 != 9, F.concat(k.cast("string"), F.lit(".0"))).alias("un_numeric"),
    )


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw long indicator feed: one GDP and one population record per order.

    Nation 0 reports under the world aggregate code ``WLD``. Several records
    per (country, year, indicator) exist; the pipeline keeps the first.
    """
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey))
    k = F.col("c_nationkey")
    iso = F.when(k == 0, F.lit("WLD")).when(k == 9, F.lit("ZZX")).otherwise(iso3_of(k))
    odd = F.col("o_orderkey") % 4
    year = F.when(F.col("o_orderkey") % 53 == 0, "19x5").otherwise(F.year("o_orderdate").cast("string"))
    common = [iso.alias("country_iso3"), F.col("n_name").alias("country_name")]
    gdp = base.select(*common, F.lit("NY.GDP.MKTP.CD").alias("indicator"),
                      year.alias("year"),
                      F.when(odd == 1, "n/a").when(odd == 2, "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("value"),
                      F.col("o_orderkey").alias("_ing_seq"))
    pop = base.select(*common, F.lit("SP.POP.TOTL").alias("indicator"),
                      year.alias("year"),
                      F.when(odd != 1, F.abs(F.col("c_acctbal")).cast("string")).alias("value"),
                      F.col("o_orderkey").alias("_ing_seq"))
    return gdp.unionByName(pop)


def load_raw_inputs(spark: SparkSession, sf_dir: str) -> RawInputs:
    return RawInputs(
        reporter_flows=reporter_flows(spark, sf_dir),
        mirror_flows=mirror_flows(spark, sf_dir),
        country_mapping=country_mapping(spark, sf_dir),
        hs_chapters=hs_chapters(spark),
        indicators=indicators(spark, sf_dir),
    )
