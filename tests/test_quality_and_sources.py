"""Quality report (D1–D8), file/payload sources (S1–S8), incremental landing."""

from __future__ import annotations

import json
import os
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from conftest import rows
from tradeweave.operators import quality as Q
from tradeweave.sources import files as FS
from tradeweave.sources import payloads as P
from tradeweave.sources.landing import land_incremental, landed_rows
from tradeweave.streaming.landing_stream import merge_keep_first, start_landing_stream


def r2(x: float) -> float:
    """Half-up rounding of the shortest decimal form — the engine's rule."""
    return float(Decimal(repr(float(x))).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


@pytest.mark.parametrize("values", [
    [1000.0, 19000.0, 184000.0, 3.5, 7.25, 7.25, 7.25, 1e9],
    [5.0],
    [0.0] * 50 + [1.0, 2.0, 3.0],          # a hot value held by most rows
])
def test_distribution_matches_linear_percentiles(spark, values):
    df = spark.createDataFrame([(str(v),) for v in values] + [("n/a",), (None,)], "v string")
    d = Q.distribution(df, "v", num_partitions=3).first()
    a = np.array(values)
    for name, p in Q.QUANTILES:
        assert d[name] == r2(np.quantile(a, p)), name
    assert (d["min"], d["max"], d["sum"], d["mean"]) == (min(values), max(values), r2(a.sum()), r2(a.mean()))


def test_distribution_empty_and_approx(spark):
    empty = spark.createDataFrame([("x",)], "v string")
    assert all(v is None for v in Q.distribution(empty, "v").first().asDict().values()
               if v is not None and not isinstance(v, float)) or Q.distribution(empty, "v").first().min is None
    df = spark.createDataFrame([(float(i),) for i in range(1, 1001)], "v double")
    approx = Q.distribution(df, "v", exact=False).first()
    assert abs(approx.median - 500.5) <= 1.0 and approx.sum == 500500.0


def test_reports_and_severity(spark):
    flows = spark.createDataFrame([(2020, 1, "01", "Import", 1.0, None, 2.0, "A"), (2021, 2, "02", "Export", 3.0,
                                   None, None, None)], "year int, partner_code int, hs_code string, flow_code string, "
                                  "trade_value_usd double, net_weight_kg double, quantity double, partner_iso3 string")
    fr = Q.flow_report(flows, "reporter").first()
    assert (fr.total_rows, fr.year_min, fr.year_max, fr.unique_partners, fr.unique_hs_codes) == (2, 2020, 2021, 2, 2)
    sev = {x["column_name"]: x["severity"] for x in rows(Q.null_severity(
        spark.createDataFrame([("a", 25.0), ("b", 5.0), ("c", 5.01)], "column_name string, null_pct double")))}
    assert sev == {"a": "high", "b": "low", "c": "moderate"}
    counts = Q.table_counts({"x": flows, "y": flows.limit(1)}).first()
    assert (counts.x, counts.y) == (2, 1)
    ref = Q.ref_report(flows, "t").first()
    assert ref.total_rows == 2 and ref.columns.startswith("year,partner_code")


def test_quality_report_structure_and_json_round_trip(spark, scratch):
    flows = spark.createDataFrame([(2020, 1, "01", "Import", 1.0, None, 2.0, "A")],
                                  "year int, partner_code int, hs_code string, flow_code string, trade_value_usd double, "
                                  "net_weight_kg double, quantity double, partner_iso3 string")
    stats = spark.createDataFrame([("AAA", 2020, 1.0, 2.0, 0.5)],
                                  "country_iso3 string, year int, gdp_usd double, population double, "
                                  "gdp_per_capita double")
    rep = Q.quality_report({"trade_flows": flows, "mirror_flows": flows, "country_stats": stats,
                            "hs_chapters": flows, "country_mapping": stats})
    assert set(rep) == {"generated_at", "sources"}
    assert set(rep["sources"]["trade_flows"]) == {"source", "total_rows", "year_range", "unique_partners",
                                                  "unique_hs_codes", "flow_distribution", "null_percentages",
                                                  "value_distribution", "rows_per_year"}
    assert set(rep["sources"]["country_stats"]) == {"total_rows", "unique_countries", "year_range",
                                                    "null_percentages", "gdp_distribution"}
    assert set(rep["sources"]["value_distribution"] if False else rep["sources"]["trade_flows"]
               ["value_distribution"]) == {"min", "p25", "median", "mean", "p75", "p95", "max", "sum"}
    assert rep["sources"]["trade_flows"]["rows_per_year"] == {"2020": 1}
    assert rep["sources"]["hs_chapters"]["columns"][0] == "year"
    path = os.path.join(scratch, "report")
    FS.write_report(spark, rep, path)
    back = FS.read_report(spark, path).first()
    assert back.sources.trade_flows.total_rows == 1
    assert Q.report_frame(spark, rep).first().sources.country_stats.unique_countries == 1


def test_read_raw_text_schema_and_ingest_order(spark, scratch):
    p = os.path.join(scratch, "raw")
    os.makedirs(p)
    with open(os.path.join(p, "y2020.csv"), "w") as fh:
        fh.write("refYear,partnerCode,cmdCode,primaryValue,extra\n2020,0,07,12.5,a\n2020,156,84,n/a,b\n")
    df = FS.read_raw(spark, p)
    assert all(t == "string" for _, t in df.dtypes if not _.startswith("_ing"))
    got = rows(df, ["_ing_row"])
    assert [x["partnerCode"] for x in got] == ["0", "156"] and got[0]["_ing_block"] == 0
    fixed = FS.read_raw(spark, p, ["refYear", "partnerCode"], with_ingest_order=False)
    assert fixed.columns == ["refYear", "partnerCode"]
    FS.write_csv(df.drop("_ing_file", "_ing_block", "_ing_row"), os.path.join(scratch, "out_csv"))
    FS.write_processed(df, os.path.join(scratch, "out_pq"), ["refYear"])
    assert FS.read_processed(spark, os.path.join(scratch, "out_pq")).count() == 2


def _page(records, page=1, pages=1):
    return json.dumps([{"page": page, "pages": pages}, records])


def test_flatten_indicator_and_countries(spark, scratch):
    ind = os.path.join(scratch, "ind")
    os.makedirs(ind)
    recs = [{"countryiso3code": "ISR", "country": {"value": "Israel"}, "date": "2020", "value": 4.0e11},
            {"countryiso3code": "", "country": {"value": "World"}, "date": "2020", "value": None},
            {"countryiso3code": "USA", "date": "2021", "value": 2.0}]
    open(os.path.join(ind, "p1.json"), "w").write(_page(recs[:2], 1, 2))
    open(os.path.join(ind, "p2.json"), "w").write(_page(recs[2:], 2, 2))
    open(os.path.join(ind, "bad.json"), "w").write(json.dumps({"message": "error"}))
    open(os.path.join(ind, "empty.json"), "w").write(_page(None))
    out = rows(P.flatten_indicator(spark, ind, "NY.GDP.MKTP.CD"), ["country_iso3"])
    assert [(x["country_iso3"], x["country_name"], x["year"], x["value"]) for x in out] == [
        ("", "World", "2020", None), ("ISR", "Israel", "2020", 4.0e11), ("USA", None, "2021", 2.0)]
    cty = os.path.join(scratch, "cty")
    os.makedirs(cty)
    open(os.path.join(cty, "p1.json"), "w").write(_page([
        {"id": "USA", "name": "United States", "region": {"value": "North America"},
         "incomeLevel": {"value": "High income"}, "iso2Code": "US", "capitalCity": "Washington D.C.",
         "longitude": "-77.032", "latitude": "38.8895"},
        {"id": "XKX", "name": "Kosovo", "iso2Code": "XK", "capitalCity": "", "longitude": "", "latitude": ""}]))
    c = {x["iso3"]: x for x in rows(P.flatten_countries(spark, cty))}
    assert (c["USA"]["un_numeric"], c["USA"]["region"]) == ("842", "North America")
    assert (c["XKX"]["un_numeric"], c["XKX"]["region"]) == (None, None)


def _csv(path, lines):
    with open(path, "w") as fh:
        fh.write("refYear,reporterCode,reporterISO,partnerCode,partnerISO,cmdCode,cmdDesc,flowCode,primaryValue,"
                 "netWgt,qty,qtyUnitAbbr\n")
        fh.write("\n".join(lines) + "\n")


def test_land_incremental_skips_landed_files(spark, scratch):
    land, out = os.path.join(scratch, "landing"), os.path.join(scratch, "landed")
    os.makedirs(land)
    _csv(os.path.join(land, "y2020.csv"), ["2020,376,ISR,156,CHN,84,d,M,10,,,"])
    assert land_incremental(spark, land, out).count() == 1
    assert land_incremental(spark, land, out).count() == 0
    _csv(os.path.join(land, "y2021.csv"), ["2021,376,ISR,156,CHN,84,d,M,20,,,"])
    assert [os.path.basename(x["path"]) for x in land_incremental(spark, land, out).collect()] == ["y2021.csv"]
    assert landed_rows(spark, out).count() == 2


def _other_order(path, lines):
    """Columns in another order, with one more, without the last two."""
    with open(path, "w") as fh:
        fh.write("typeCode,flowCode,refYear,partnerCode,reporterCode,reporterISO,partnerISO,cmdDesc,cmdCode,primaryValue\n")
        fh.write("\n".join(lines) + "\n")


def test_columns_are_taken_by_header_name(spark, scratch):
    land, out = os.path.join(scratch, "mixed"), os.path.join(scratch, "mixed_out")
    os.makedirs(land)
    _csv(os.path.join(land, "a.csv"), ["2020,376,ISR,156,CHN,84,\"d, e\",M,10,,,"])
    _other_order(os.path.join(land, "b.csv"), ["C,X,2021,842,376,ISR,USA,d,07,20"])
    for df in (FS.read_raw(spark, land), (land_incremental(spark, land, out), landed_rows(spark, out))[1]):
        got = {x["refYear"]: x for x in rows(df)}
        assert (got["2020"]["reporterISO"], got["2020"]["cmdDesc"], got["2020"]["flowCode"]) == ("ISR", "d, e", "M")
        assert (got["2021"]["reporterISO"], got["2021"]["cmdCode"], got["2021"]["flowCode"], got["2021"]["qty"]) == ("ISR", "07", "X", None)
    _csv(os.path.join(land, "a2.csv"), ["2022,376,ISR,156,CHN,84,d,M,10,,,"])
    table = os.path.join(scratch, "mixed_table")
    start_landing_stream(spark, land, table, os.path.join(scratch, "mixed_ckpt")).awaitTermination()
    got = {x["year"]: (x["hs_code"], x["flow_code"], x["partner_iso3"]) for x in spark.read.parquet(table).collect()}
    assert got == {2020: ("84", "Import", "CHN"), 2021: ("07", "Export", "USA"), 2022: ("84", "Import", "CHN")}
    with open(os.path.join(land, "odd.csv"), "w") as fh:
        fh.write("foo,bar\n1,2\n")
    with pytest.raises(ValueError, match="unknown file layout"):
        land_incremental(spark, land, out)


def test_landing_that_stops_before_its_commit_lands_all_later(spark, scratch, monkeypatch):
    land, out = os.path.join(scratch, "crash"), os.path.join(scratch, "crash_out")
    os.makedirs(land)
    _csv(os.path.join(land, "a.csv"), ["2020,376,ISR,156,CHN,84,d,M,10,,,"])
    land_incremental(spark, land, out)
    _csv(os.path.join(land, "b.csv"), ["2021,376,ISR,156,CHN,84,d,M,10,,,"])
    with monkeypatch.context() as m:
        m.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            land_incremental(spark, land, out)
    assert landed_rows(spark, out).count() == 1
    assert land_incremental(spark, land, out).count() == 1
    assert landed_rows(spark, out).count() == 2


def test_merge_of_rows_without_a_year_is_repeatable(spark, scratch):
    table = os.path.join(scratch, "nulls")
    batch = spark.createDataFrame([(None, 1, 2, "84", "Import", 5.0), (2020, 1, 2, "84", "Import", 6.0)],
                                  "year int, reporter_code int, partner_code int, hs_code string, flow_code string, trade_value_usd double")
    for _ in range(2):
        merge_keep_first(batch, table)
    assert spark.read.parquet(table).count() == 2


def test_paths_are_looked_up_in_the_sessions_file_system(spark, scratch):
    open(os.path.join(scratch, "x.csv"), "w").write("a\n1\n")
    assert FS.path_exists(spark, f"{scratch}/*.csv") and FS.path_exists(spark, f"file://{scratch}/*.csv")
    assert not FS.path_exists(spark, f"{scratch}/none/*.csv")


def test_streaming_landing_keep_first_across_batches(spark, scratch):
    land = os.path.join(scratch, "stream_in")
    table, ckpt = os.path.join(scratch, "clean_table"), os.path.join(scratch, "stream_ckpt")
    os.makedirs(land)
    _csv(os.path.join(land, "a.csv"), ["2020,376,ISR,156,CHN,84,d,M,10,,,", "2020,376,ISR,156,CHN,84,d,M,11,,,",
                                       "2020,376,ISR,0,WLD,84,d,M,5,,,"])
    start_landing_stream(spark, land, table, ckpt).awaitTermination()
    _csv(os.path.join(land, "b.csv"), ["2020,376,ISR,156,CHN,84,d,M,99,,,", "2020,376,ISR,156,CHN,85,d,X,7,,,"])
    start_landing_stream(spark, land, table, ckpt).awaitTermination()
    got = {(x["hs_code"], x["flow_code"]): x["trade_value_usd"] for x in spark.read.parquet(table).collect()}
    assert got == {("84", "Import"): 10.0, ("85", "Export"): 7.0}
    start_landing_stream(spark, land, table, ckpt).awaitTermination()   # restart: nothing new
    assert spark.read.parquet(table).count() == 2


def test_report_parts_read_a_written_table_not_the_cleaning(spark):
    from tradeweave.operators import clean as C
    from tradeweave.operators import quality as Q

    raw = spark.createDataFrame([("2020", "1", "2", "84", "M", "5", None, "1", "CHN", n) for n in range(3)],
                                "refYear string, reporterCode string, partnerCode string, cmdCode string, flowCode string, primaryValue string, "
                                "netWgt string, qty string, partnerISO string, seq long")
    report = Q.flow_report_frame(C.clean_flows(raw, ["seq"]), "reporter")
    assert "row_number" not in report._jdf.queryExecution().optimizedPlan().toString()
    got = report.first()
    assert (got["total_rows"], got["rows_per_year"], got["flow_distribution"]) == (1, {"2020": 1}, {"Import": 1})
