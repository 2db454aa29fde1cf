"""Landed-file pipeline and the command line (real CSV feeds, not the stand-in)."""

from __future__ import annotations

import gzip
import os

import pytest

from conftest import rows
from tradeweave.__main__ import main
from tradeweave.sources.landed import landed_inputs
from tradeweave.plans.warehouse import read_star, register_views
from tradeweave.operators import overview as OV

FLOW_HEADER = ("refYear,reporterCode,reporterISO,partnerCode,partnerISO,cmdCode,cmdDesc,flowCode,primaryValue,"
               "netWgt,qty,qtyUnitAbbr,extraCol")


def _write(path, header, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(header + "\n" + "\n".join(lines) + "\n")


def test_cli_loads_landed_files(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "wh")
    _write(os.path.join(raw, "reporter", "y2020.csv"), FLOW_HEADER, [
        "2020,376,ISR,156,CHN,84,Machinery,M,1000,5,1,kg,a",
        "2020,376,ISR,156,CHN,84,Machinery,M,9999,5,1,kg,b",      # duplicate: first wins
        "2020,376,ISR,0,WLD,84,Machinery,M,5,,,kg,c",             # world partner: dropped
        "2020,376,ISR,842,ZZX,7,Vegetables,X,300,,,kg,d",         # partner by numeric fallback
        "2020,376,ISR,156,CHN,TOTAL,All,M,7,,,kg,e",              # aggregate: dropped
    ])
    _write(os.path.join(raw, "mirror", "m2020.csv"), FLOW_HEADER, ["2020,156,CHN,376,ISR,84,Machinery,X,800,,,kg,x"])
    _write(os.path.join(raw, "countries", "c.csv"), "iso3,name,region,income_group,iso2,capital,longitude,latitude,"
           "un_numeric", ["CHN,China,East Asia & Pacific,Upper middle income,CN,Beijing,116.3,39.9,156.0",
                          "ISR,Israel,,High income,IL,Jerusalem,35.2,31.8,376.0",
                          "USA,United States,North America,High income,US,Washington,-77.0,38.9,842.0"])
    _write(os.path.join(raw, "indicators", "gdp.csv"), "country_iso3,country_name,indicator,year,value",
           ["CHN,China,NY.GDP.MKTP.CD,2020,100", "CHN,China,SP.POP.TOTL,2020,4", "WLD,World,NY.GDP.MKTP.CD,2020,9"])
    assert main(["load", raw, out, "--first-year", "2019", "--last-year", "2021"], spark=spark) == 0
    wh = read_star(spark, out)
    f = {x["flow_direction"]: x for x in rows(wh.fact_trade)}
    ids = {x["iso3_code"]: x["country_id"] for x in rows(wh.dim_country)}
    assert f["Import"]["trade_value_usd"] == 1000.0 and f["Import"]["partner_id"] == ids["CHN"]
    assert f["Export"]["partner_id"] == ids["USA"] and f["Import"]["reporter_id"] == ids["ISR"]
    assert {x["region"] for x in rows(wh.dim_country) if x["iso3_code"] == "ISR"} == {"Middle East & North Africa"}
    assert rows(wh.fact_country_stats)[0]["gdp_per_capita"] == 25.0
    rep = spark.read.option("multiLine", True).json(os.path.join(out, "quality_report")).first()
    assert rep.sources.trade_flows.total_rows == 2 and rep.sources.mirror_flows.total_rows == 1
    register_views(wh, "t_")
    q1 = spark.sql("SELECT COUNT(*) AS trade_records, ROUND(SUM(trade_value_usd) / 1e9, 1) AS total_trade_b "
                   "FROM t_fact_trade WHERE trade_value_usd > 0").first()
    assert q1.trade_records == OV.dataset_summary(wh).first().trade_records


def test_missing_sources_are_skipped(spark, scratch):
    raw, out = os.path.join(scratch, "raw2"), os.path.join(scratch, "wh2")
    _write(os.path.join(raw, "reporter", "y.csv"), FLOW_HEADER, ["2021,376,ISR,156,CHN,84,M,M,10,,,kg,a"])
    _write(os.path.join(raw, "countries", "c.csv"), "iso3,name,region,income_group,iso2,capital,longitude,latitude,"
           "un_numeric", ["CHN,China,,,,,,,156"])
    assert main(["load", raw, out], spark=spark) == 0
    wh = read_star(spark, out)
    assert wh.fact_trade.count() == 1 and wh.fact_mirror_trade.count() == 0 and wh.fact_country_stats.count() == 0


def test_files_at_any_depth_and_packed_are_read(spark, scratch):
    line = "2014,376,ISR,156,CHN,84,Machinery,M,1000,5,1,kg,a"
    _write(os.path.join(scratch, "reporter", "2014", "01", "x.csv"), FLOW_HEADER, [line])
    os.makedirs(os.path.join(scratch, "mirror", "2014"))
    with gzip.open(os.path.join(scratch, "mirror", "2014", "m.csv.gz"), "wt") as fh:
        fh.write(f"{FLOW_HEADER}\n{line}\n{line}\n")
    raw = landed_inputs(spark, scratch)
    assert (raw.reporter_flows.count(), raw.mirror_flows.count(), raw.country_mapping.count()) == (1, 2, 0)
    _write(os.path.join(scratch, "countries", "c.txt"), "iso3,name", ["CHN,China"])
    with pytest.raises(ValueError, match="countries"):
        landed_inputs(spark, scratch)
