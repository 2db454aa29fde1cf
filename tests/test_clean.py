"""Cleaning rules C1–C15 on hand-written raw rows (all text, like the CSV feed)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from conftest import SF_SMOKE, rows
from tradeweave.constants import REFERENCE_DEDUP_KEYS
from tradeweave.functions import exprs as E
from tradeweave.functions.exprs import to_int, try_number
from tradeweave.operators import clean as C
from tradeweave.sources.standin import _lines

COLS = ["refYear", "reporterCode", "reporterISO", "partnerCode", "partnerISO", "cmdCode", "cmdDesc",
        "flowCode", "primaryValue", "netWgt", "qty", "qtyUnitAbbr", "extraCol", "seq"]


def raw(spark, data):
    return spark.createDataFrame(data, ",".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in COLS))


def r(seq, year="2020", rep="376", rep_iso="ISR", par="156", par_iso="CHN", hs="84", flow="M", value="1000",
      wgt="5", qty="7", unit="KG"):
    return (year, rep, rep_iso, par, par_iso, hs, "desc", flow, value, wgt, qty, unit, "x", seq)


def test_rename_keeps_unmapped_columns(spark):
    df = C.rename_present(raw(spark, [r(1)]))
    assert "extraCol" in df.columns and "year" in df.columns and "refYear" not in df.columns


def test_rename_skips_missing(spark):
    df = raw(spark, [r(1)]).drop("qty")
    out = C.rename_present(df)
    assert "quantity" not in out.columns and "net_weight_kg" in out.columns


def test_world_partners_dropped_null_kept(spark):
    data = [r(1, par="0"), r(2, par="W00"), r(3, par="WLD"), r(4, par=" 0 "), r(5, par=None), r(6, par="156")]
    out = C.clean_flows(raw(spark, data), ["seq"])
    assert sorted(x["partner_code"] is None for x in rows(out)) == [False, True]


def test_hs_codes_padded_aggregates_and_invalid_dropped(spark):
    data = [r(1, hs="7"), r(2, hs="TOTAL"), r(3, hs="AG2"), r(4, hs="total"), r(5, hs="99"), r(6, hs="8471"),
            r(7, hs="X1"), r(8, hs=None), r(9, hs=" 9 "), r(10, hs="84")]
    out = rows(C.clean_flows(raw(spark, data), ["seq"]), ["hs_code"])
    assert [x["hs_code"] for x in out] == ["07", "09", "84"]


def test_invalid_hs_sample_counts(spark):
    data = [r(1, hs="8471"), r(2, hs="8471", par="1"), r(3, hs="X1"), r(4, hs=None)]
    out = rows(C.invalid_hs_sample(raw(spark, data)), ["hs_code"])
    assert {x["hs_code"]: x["rows"] for x in out} == {"8471": 2, "X1": 1, None: 1}


def test_flow_mapping_unknown_passes_through(spark):
    data = [r(1, flow="M"), r(2, flow="X", par="1"), r(3, flow="RM", par="2"), r(4, flow="RX", par="3"),
            r(5, flow=" Q ", par="4"), r(6, flow=None, par="5")]
    out = {x["partner_code"]: x for x in rows(C.clean_flows(raw(spark, data), ["seq"]))}
    assert (out[156]["flow_code"], out[156]["flow_direction_simple"], out[156]["valuation"]) == ("Import", "Import", "CIF")
    assert (out[3]["flow_code"], out[3]["flow_direction_simple"], out[3]["valuation"]) == ("Re-export", "Export", "FOB")
    assert (out[4]["flow_code"], out[4]["flow_direction_simple"], out[4]["valuation"]) == ("Q", None, None)
    assert out[5]["flow_code"] is None
    unknown = rows(C.unknown_flows(raw(spark, data)), ["flow_code"])
    assert [(x["flow_code"], x["rows"]) for x in unknown] == [("Q", 1), (None, 1)]


def test_values_coerced_and_kept(spark):
    data = [r(1, value="0"), r(2, value="-300", par="1"), r(3, value="n/a", par="2"), r(4, value="1250000.5", par="3")]
    out = {x["partner_code"]: x["trade_value_usd"] for x in rows(C.clean_flows(raw(spark, data), ["seq"]))}
    assert out == {156: 0.0, 1: -300.0, 2: None, 3: 1250000.5}
    audit = C.value_audit(raw(spark, data).withColumnRenamed("primaryValue", "trade_value_usd")).first()
    assert (audit.rows, audit.null_values, audit.negative_values, audit.zero_values) == (4, 1, 1, 1)


def test_dedup_keeps_first_in_ingest_order(spark):
    data = [r(2, value="222"), r(1, value="111"), r(3, value="333", rep="999")]
    out = rows(C.clean_flows(raw(spark, data), ["seq"]), ["reporter_code"])
    # default keys include the reporter: two groups
    assert [(x["reporter_code"], x["trade_value_usd"]) for x in out] == [(376, 111.0), (999, 333.0)]
    ref = rows(C.clean_flows(raw(spark, data), ["seq"], REFERENCE_DEDUP_KEYS))
    # reference keys omit the reporter: one group, first wins
    assert [x["trade_value_usd"] for x in ref] == [111.0]


def test_dedup_null_keys_compare_equal(spark):
    data = [r(2, par=None, value="2"), r(1, par=None, value="1")]
    out = rows(C.clean_flows(raw(spark, data), ["seq"]))
    assert [x["trade_value_usd"] for x in out] == [1.0]


def test_dedup_compares_numbers_and_keeps_other_text_apart(spark):
    # '2020', '2020.0' and a tab are one key; text that is no number is a value of its own
    data = [r(1, year="2020"), r(2, year="2020.0"), r(3, year="\t2020 "), r(4, year="20x0"), r(5, year="20y0")]
    out = rows(C.clean_flows(raw(spark, data), ["seq"]))
    assert sorted((x["year"] is None, x["year"]) for x in out) == [(False, 2020), (True, None), (True, None)]


def test_odd_cells_become_null_and_never_raise(spark):
    texts = ["NaN", "nan", "Infinity", "-Infinity", "1e10", "99999999999", "1e400", "n/a", "", None, "\t842", " 842.0 ", "-3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows(df.select("i", E.to_int("t").alias("n"), E.try_number("t").alias("x"), E.numeric_text("t").alias("k")), ["i"])
    assert [x["n"] for x in got] == [None] * 10 + [842, 842, -3]
    assert [x["x"] for x in got] == [None] * 4 + [1e10, 99999999999.0] + [None] * 4 + [842.0, 842.0, -3.0]
    assert [x["k"] for x in got][-3:] == ["842", "842", "-3"]


def test_nan_does_not_reach_totals(spark):
    data = [r(1, value="NaN", par="1"), r(2, value="5"), r(3, value="Infinity", par="250")]
    values = [x["trade_value_usd"] for x in rows(C.clean_flows(raw(spark, data), ["seq"]))]
    assert sorted(values, key=lambda v: (v is None, v)) == [5.0, None, None]


def test_first_parseable_indicator_wins(spark):
    long = spark.createDataFrame([("AAA", "A", "NY.GDP.MKTP.CD", "2020", v, i) for i, v in enumerate(["n/a", None, "NaN", "5", "7"])],
                                 "country_iso3 string, country_name string, indicator string, year string, value string, _ing_seq long")
    assert [x["gdp_usd"] for x in rows(C.clean_country_stats(long))] == [5.0]


def test_numeric_coercions(spark):
    data = [r(1, wgt="abc", qty=None, rep="376.0")]
    x = rows(C.clean_flows(raw(spark, data), ["seq"]))[0]
    assert x["net_weight_kg"] is None and x["quantity"] is None and x["reporter_code"] == 376
    assert "seq" not in x and "extraCol" in x


def test_ledger_accounts_for_every_row(spark):
    data = [r(1, par="0"), r(2, hs="TOTAL"), r(3, hs="8471"), r(4), r(5), r(6, par="1")]
    led = {x["step"]: x for x in rows(C.cleaning_ledger(raw(spark, data)))}
    assert {k: v["rows"] for k, v in led.items()} == {
        "input": 6, "world_partner": 1, "aggregate_hs": 1, "invalid_hs": 1, "duplicate": 1, "kept": 2}
    assert led["kept"]["pct_of_input"] == 33.33
    assert sum(led[k]["rows"] for k in led if k != "input") == led["input"]["rows"]


def test_null_pct_long_form(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, "a"), (4.0, "b")], "a double, b string")
    out = {x["column_name"]: x["null_pct"] for x in rows(C.null_pct(df, ["a", "b", "missing"]))}
    assert out == {"a": 25.0, "b": 50.0}


def test_missing_dedup_column_skips_dedup(spark):
    data = [r(1), r(2)]
    out = C.clean_flows(raw(spark, data).drop("flowCode"), ["seq"])
    assert out.count() == 2


def test_clean_plan_has_single_aggregation_shuffle(spark):
    out = C.clean_flows(raw(spark, [r(1), r(2)]), ["seq"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stepwise_operators_compose_like_clean_flows(spark):
    data = [r(1, hs="7"), r(2, hs="TOTAL"), r(3, hs="99"), r(4, hs="8471"), r(5, par="0")]
    df = C.rename_present(raw(spark, data))
    step = C.keep_valid_hs(C.drop_aggregates(C.drop_world(df)))
    assert [x["hs_code"] for x in rows(step)] == ["07"]


def test_hot_key_dedup_is_combined_map_side(spark):
    # one dedup key holds a third of all rows; the rest are distinct
    hot = [r(i, value=str(i)) for i in range(1000, 1600)]
    cold = [r(i, par=str(i), value=str(i)) for i in range(2000, 3200)]
    df = raw(spark, hot + cold).repartition(6)
    out = C.clean_flows(df, ["seq"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    # every map task keeps one row a key before the shuffle
    assert re.search(r"WindowGroupLimit .*Partial", plan)
    got = {x["partner_code"]: x["trade_value_usd"] for x in out.collect()}
    assert len(got) == 1 + len(cold) and got[156] == 1000.0


def test_years_are_those_of_the_clean_flows_without_a_window(spark):
    data = [r(1, year="2020"), r(2, year="2020.0"), r(3, year="n/a"), r(4, year=None), r(5, year="2021", par="0"),
            r(6, year="2022", hs="TOTAL"), r(7, year="2023", hs="X"), r(8, year=" 2024 "), r(9, year="2024")]
    df = raw(spark, data)
    years = C.flow_years(df)
    assert "Window" not in years._jdf.queryExecution().optimizedPlan().toString()
    assert {x["year"] for x in rows(years)} == {x["year"] for x in rows(C.clean_flows(df, ["seq"]))} == {2020, 2024, None}
    assert {x["year"] for x in rows(C.flow_years(C.tag_flows(df)))} == {2020, 2024, None}
    assert C.flow_years(df, dedup_keys=("partner_code",)) is None


def test_indicators_are_hashed_not_sorted_and_a_null_place_is_first(spark):
    data = [("A", "a", 2000, "gdp_usd", 2.0, 2), ("A", "a", 2000, "gdp_usd", 1.0, 1), ("B", "b", 2000, "gdp_usd", 3.0, 1),
            ("B", "b", 2000, "gdp_usd", 4.0, None), ("B", "b", 2000, "population", 5.0, 3)]
    df = spark.createDataFrame(data, "country_iso3 string, country_name string, year int, indicator string, value double, seq long")
    wide = C.pivot_indicators(df, ["seq"])
    assert "SortAggregate" not in wide._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["country_iso3"], x["gdp_usd"], x["population"]) for x in rows(wide)) == [("A", 1.0, None), ("B", 4.0, 5.0)]


def test_stats_years_are_those_of_the_clean_stats(spark):
    data = [("A", "a", "NY.GDP.MKTP.CD", "2000", "1", 1), ("A", "a", "NY.GDP.MKTP.CD", "2001", "n/a", 2), ("WLD", "w", "NY.GDP.MKTP.CD", "2002", "1", 3),
            ("B", None, "NY.GDP.MKTP.CD", "2003", "1", 4), ("B", "b", "OTHER", "2004", "1", 5)]
    df = spark.createDataFrame(data, "country_iso3 string, country_name string, indicator string, year string, value string, _ing_seq long")
    assert {x["year"] for x in rows(C.stats_years(df))} == {x["year"] for x in rows(C.clean_country_stats(df))} == {2000, 2004}


def test_numeric_text_of_odd_cells(spark):
    cells = ["842", "842.0", "0842", "\t842", "", " ", "+7", "-7", "0", "000", "1a", "1.5", None, "12 ", "٣"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(E.numeric_text("c").alias("n"), E.is_digits(E.strip("c")).alias("d")).collect()
    assert [g["n"] for g in got] == ["842", "842", "842", "842", "", "", "7", "-7", "0", "0", "1a", "1.5", None, "12", "٣"]
    assert [g["d"] for g in got] == [True, False, True, True, True, True, False, False, True, True, False, False, None, True, False]


# --------------------------------------------------------------------------- parsed once per filter
def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_code_is_a_chapter_where_its_padded_form_is_valid(spark):
    codes = ["1", "01", "99", "12", "100", "", "A", "1A", "1 ", "12\n", "١", "١2", None]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = df.select("c", C.is_chapter(F.col("c")).alias("one"), C.is_valid_hs(C.pad_code(F.col("c"))).alias("two")).collect()
    assert all(r.one == r.two for r in got) and [r.c for r in got if r.one] == ["1", "01", "99", "12"]


def test_filters_hold_the_parse_of_a_cell_once(spark):
    df = spark.createDataFrame([("842.0", " x ", "1")], "year string, hs_code string, partner_code string")
    years = _optimized(df.select(to_int(F.col("year")).alias("y")).where("y > 1000"))
    assert years.split("Filter")[1].split("\n")[0].count("trim(") == 1, years
    kept = _optimized(C.tag_flows(df).where(F.col(C.REJECT).isNull()))
    assert kept.split("Filter")[1].split("\n")[0].count("upper(") <= 2, kept


def test_ints_and_numbers_that_are_none(spark):
    texts = ["842.0", "NaN", "Infinity", "-Infinity", "1e400", "3000000000", "-7.9", "\t12 ", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(to_int(F.col("t")).alias("i"), try_number(F.col("t")).alias("n")).collect()
    assert [r.i for r in got] == [842, None, None, None, None, None, -7, 12, None, None, None]
    assert [r.n for r in got] == [842.0, None, None, None, None, 3e9, -7.9, 12.0, None, None, None]


def test_first_rows_are_sorted_by_a_hash_of_their_keys(spark):
    data = [("a", None, 2), ("a", None, 1), (None, "b", 3), (None, "b", 0), ("b", None, 5), ("", "b", 4)]
    df = spark.createDataFrame(data, "k1 string, k2 string, n int")
    out = C.dedup_first(df, ["k1", "k2"], ["n"])
    assert out.columns == df.columns
    assert sorted(out.collect(), key=lambda r: r.n) == [(None, "b", 0), ("a", None, 1), ("", "b", 4), ("b", None, 5)]
    assert "xxhash64" in _optimized(out)


def test_customers_join_orders_before_the_lines(spark):
    plan = _optimized(_lines(spark, SF_SMOKE))
    joins = [x for x in plan.split("\n") if "Join Inner" in x]
    depth = {k: next(x.index("Join") for x in joins if k in x) for k in ("o_custkey", "l_orderkey")}
    assert depth["o_custkey"] > depth["l_orderkey"], plan
