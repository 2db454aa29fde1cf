"""Reference tables, indicator cleaning, star load (S10, S12, C16–C23, L1–L11) and keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from conftest import rows
from tradeweave.operators import clean as C
from tradeweave.operators import keys as K
from tradeweave.operators import star as S
from tradeweave.sources import reference as R


def test_hs_chapters_sections(spark):
    ch = {x["chapter_int"]: x for x in rows(R.hs_chapters(spark))}
    assert len(ch) == 99
    assert (ch[1]["chapter_code"], ch[1]["section_num"]) == ("01", "I")
    assert (ch[15]["section_num"], ch[77]["chapter_name"]) == ("III", "Reserved")
    assert ch[93]["section_name"] == "Arms & Ammunition"
    assert {ch[98]["section_num"], ch[99]["section_num"]} == {"SPECIAL"}
    assert len({x["section_num"] for x in ch.values()}) == 22


def test_dim_time_labels(spark):
    t = {x["year"]: x for x in rows(R.dim_time(spark, 2014, 2024))}
    assert (t[2019]["period_label"], t[2020]["period_label"], t[2022]["period_label"]) == (
        "Pre-COVID 2014-2019", "COVID era 2020-2021", "Post-COVID 2022+")
    assert (t[2019]["decade"], t[2020]["decade"]) == ("2010s", "2020s")
    assert len(t) == 11


def test_clean_chapters_rebuilds_codes(spark):
    df = spark.createDataFrame([("1", "1", "a", "I", "x"), ("x", None, "b", "I", "x"), ("7", "7.0", "c", "II", "y")],
                               "chapter_code string, chapter_int string, chapter_name string, section_num string, "
                               "section_name string")
    out = {x["chapter_name"]: x["chapter_code"] for x in rows(C.clean_chapters(df))}
    assert out == {"a": "01", "b": None, "c": "07"}
    assert C.chapter_summary(C.clean_chapters(df)).first().sections == 2


def countries(spark):
    return spark.createDataFrame([
        ("USA", "United States", "North America", "High income", "US", "842.0", "-77.0", "38.9"),
        ("NAM", "Namibia", "Sub-Saharan Africa", "Upper middle income", "NA", None, "17.1", "-22.6"),
        ("ISR", "Israel", "Europe & Central Asia", "High income", "IL", "376", "35.2", "31.8"),
        ("HKG", "Hong Kong", None, "High income", "HK", "344", "114.1", "22.3"),
        ("MAC", "Macao", "East Asia & Pacific x", "High income", "MO", None, "bad", "22.2"),
        ("BLK", "  ", None, None, None, None, None, None),
        ("NUL", None, None, None, None, None, None, None),
    ], "iso3 string, name string, region string, income_group string, iso2 string, un_numeric string, "
       "longitude string, latitude string")


def test_dim_country_keys_types_and_cleaning(spark):
    d = {x["iso3_code"]: x for x in rows(S.build_dim_country(C.clean_countries(countries(spark))))}
    assert sorted(d) == ["HKG", "ISR", "MAC", "NAM", "USA"]
    assert [d[k]["country_id"] for k in sorted(d)] == [1, 2, 3, 4, 5]
    assert d["USA"]["un_numeric"] == 842 and d["NAM"]["iso2_code"] == "NA"
    assert d["MAC"]["longitude"] is None and d["ISR"]["latitude"] == 31.8
    cov = C.country_coverage(countries(spark)).first()
    assert (cov.countries, cov.with_un_numeric, cov.with_region) == (5, 3, 4)


def test_region_patch_overwrite_and_fill(spark):
    dim = S.build_dim_country(C.clean_countries(countries(spark)))
    out = {x["iso3_code"]: x["region"] for x in rows(S.patch_regions(dim))}
    assert out["ISR"] == "Middle East & North Africa"          # overwritten
    assert out["HKG"] == "East Asia & Pacific"                 # NULL filled
    assert out["MAC"] == "East Asia & Pacific x"               # kept: not NULL
    cov = S.region_coverage(S.patch_regions(dim)).first()
    assert (cov.region_set, cov.region_null) == (5, 0)


def test_two_stage_resolution(spark):
    dim = S.build_dim_country(C.clean_countries(countries(spark)))
    com = S.build_dim_commodity(C.clean_chapters(R.hs_chapters(spark)))
    flows = spark.createDataFrame([
        (2020, 376, " isr ", 842, "USA", "84", "Import", 10.0),    # both by ISO3
        (2020, 376, "ISR", 842, "ZZX", "7", "Export", 20.0),       # partner: ISO3 misses → numeric 842
        (2020, 376, "ISR", 999, "ZZX", "85", "Import", 30.0),      # partner unresolved
        (2020, 376, "ISR", 344, "NAM", "93", "Import", 40.0),      # ISO3 wins over numeric (344=HKG)
        (2020, 376, "ISR", None, None, "99", "Import", 50.0),      # commodity 99 exists in the dim
    ], "year int, reporter_code int, reporter_iso3 string, partner_code int, partner_iso3 string, "
       "hs_code string, flow_direction_simple string, trade_value_usd double")
    f = rows(S.resolve_keys(flows, dim, com), ["trade_value_usd"])
    ids = {x["iso3_code"]: x["country_id"] for x in rows(dim)}
    assert [x["reporter_id"] for x in f] == [ids["ISR"]] * 5
    assert [x["partner_id"] for x in f] == [ids["USA"], ids["USA"], None, ids["NAM"], None]
    assert [x["commodity_id"] for x in f] == [84, 7, 85, 93, 99]
    rates = S.fk_resolution(S.resolve_keys(flows, dim, com)).first()
    assert (rates.partner_unresolved, rates.partner_unresolved_pct) == (2, 40.0)


def test_country_stats_first_wins_and_unmatched(spark):
    dim = S.build_dim_country(C.clean_countries(countries(spark)))
    dt = R.dim_time(spark, 2014, 2024)
    stats = spark.createDataFrame([
        ("USA", "United States", 2020, 1.0, 2.0, 0.5),
        ("usa", "USA again", 2020, 9.0, 9.0, 1.0),     # same (country, year) after upper → ignored
        ("USA", "United States", 2030, 1.0, 1.0, 1.0),  # year outside dim_time → dropped
        ("ZZZ", "Nowhere", 2020, 1.0, 1.0, 1.0),        # unmatched ISO3
    ], "country_iso3 string, country_name string, year int, gdp_usd double, population double, gdp_per_capita double")
    out = rows(S.load_country_stats(stats, dim, dt))
    assert [(x["year"], x["gdp_usd"]) for x in out] == [(2020, 1.0)]
    assert S.unmatched_keys(stats, dim).first().unmatched_iso3 == 1


def test_indicator_cleaning_pivot_first_and_ratio(spark):
    long = spark.createDataFrame([
        ("AAA", "A", "NY.GDP.MKTP.CD", "2020", "100.0", 2),
        ("AAA", "A", "NY.GDP.MKTP.CD", "2020", "999.0", 1),   # earlier in ingest order → wins
        ("AAA", "A", "SP.POP.TOTL", "2020", "4", 3),
        ("AAA", "A", "SP.POP.TOTL", "2021", "0", 4),          # population 0 → ratio NULL
        ("AAA", "A", "NY.GDP.MKTP.CD", "2021", "50", 5),
        ("BBB", "B", "NY.GDP.MKTP.CD", "2020", None, 6),      # NULL value dropped
        ("BBB", "B", "NY.GDP.MKTP.CD", "20x0", "1", 7),       # bad year dropped
        ("WLD", "World", "NY.GDP.MKTP.CD", "2020", "1", 8),   # aggregate dropped
        (None, "C", "NY.GDP.MKTP.CD", "2020", "1", 9),        # NULL index dropped
        ("DDD", "D", "SP.POP.TOTL", "2020.0", "10", 10),      # only one indicator → NULL ratio
        ("DDD", "D", "XX.UNKNOWN", "2020", "10", 11),         # unknown indicator: not a pivot column
    ], "country_iso3 string, country_name string, indicator string, year string, value string, _ing_seq long")
    out = {(x["country_iso3"], x["year"]): x for x in rows(C.clean_country_stats(long))}
    assert sorted(out) == [("AAA", 2020), ("AAA", 2021), ("DDD", 2020)]
    assert out[("AAA", 2020)]["gdp_usd"] == 999.0 and out[("AAA", 2020)]["gdp_per_capita"] == 999.0 / 4
    assert out[("AAA", 2021)]["gdp_per_capita"] is None
    assert out[("DDD", 2020)]["gdp_usd"] is None and out[("DDD", 2020)]["gdp_per_capita"] is None
    s = C.stats_summary(C.clean_country_stats(long)).first()
    assert (s.rows, s.countries, s.year_min, s.year_max, s.per_capita_rows) == (3, 2, 2020, 2021, 1)


def test_sequential_key_contiguous_deterministic(spark):
    random.seed(3)
    data = [(random.randint(0, 50), random.randint(0, 10**6), i) for i in range(5000)]
    data.append((None, 1, 99999))
    df = spark.createDataFrame(data, "a int, b long, c long").repartition(7)
    k = K.with_sequential_key(df, ["a", "b", "c"], "id", offset=100, num_partitions=6)
    got = rows(k, ["id"])
    assert [x["id"] for x in got] == list(range(101, 101 + len(data)))
    expect = sorted(data, key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2]))
    assert [(x["a"], x["b"], x["c"]) for x in got] == expect
    again = {(x["a"], x["b"], x["c"]): x["id"] for x in k.collect()}
    assert again == {(x["a"], x["b"], x["c"]): x["id"] for x in got}


def test_cumulative_weights(spark):
    df = spark.createDataFrame([(5.0, 3), (1.0, 1), (2.0, 10)], "v double, w long")
    out = rows(K.cumulative(df, ["v"], F.col("w"), "start", 2), ["v"])
    assert [(x["v"], x["start"], x["_rk_total"]) for x in out] == [(1.0, 0, 14), (2.0, 1, 14), (5.0, 11, 14)]


def test_keys_are_the_same_when_read_again(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(300)], "a int, b int").repartition(5)
    k = K.with_sequential_key(df, ["a", "b"], "id")
    assert sorted(map(tuple, k.collect())) == sorted(map(tuple, k.repartition(3).collect()))
    assert K.with_sequential_key(df.limit(0), ["a", "b"], "id").count() == 0


def test_time_dimension_has_every_year_of_the_data(spark):
    a = spark.createDataFrame([(1990,), (None,), (2035,)], "year int")
    got = [x["year"] for x in rows(R.dim_time_of(spark, a, years=(2014, 2015)), ["year"])]
    assert got == [1990, 2014, 2015, 2035]


def test_constraints_do_not_clean_the_feeds_again(spark):
    from conftest import SF_SMOKE
    from tradeweave.plans.registry import ON_STAR
    from tradeweave.plans.warehouse import standin_star

    checks = ON_STAR["l11_constraints"](standin_star(spark, SF_SMOKE))
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
    assert checks.count() == 17
