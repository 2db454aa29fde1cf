"""Analytical operators on a small hand-built star (expected values computed by hand)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tradeweave.operators import clean as C
from tradeweave.operators import commodity as COM
from tradeweave.operators import concentration as CON
from tradeweave.operators import mirror as MIR
from tradeweave.operators import overview as OV
from tradeweave.operators import partner as PAR
from tradeweave.operators import star as S
from tradeweave.params import TradeFilter
from tradeweave.sources import reference as R

IMP, EXP = "Import", "Export"
# (year, reporter, partner, chapter, direction, value)
TRADE = [
    (2020, 1, 2, 93, IMP, 500.0),                      # arms: a single supplier → HHI 10000
    (2020, 1, 2, 84, IMP, 100.0), (2020, 1, 3, 84, IMP, 100.0),
    (2020, 1, 4, 85, IMP, 100.0), (2020, 1, 5, 85, IMP, 100.0),   # machinery: 4 equal → HHI 2500
    (2021, 1, 2, 6, IMP, 5004.0), (2021, 1, 3, 6, IMP, 4996.0),   # 50.04 % → 50.0, not flagged
    (2021, 1, 4, 7, IMP, 700.0), (2021, 1, 5, 7, IMP, 300.0),     # exactly 70 % → HIGH
    (2021, 1, None, 8, IMP, 1000.0), (2021, 1, 2, 8, IMP, 1000.0),  # unresolved partner
    (2021, 1, 3, 8, IMP, 0.0), (2021, 1, 4, 8, IMP, -50.0),       # zero and negative: excluded
    (2022, 1, 6, 9, IMP, 600.0), (2022, 1, 2, 9, IMP, 400.0),     # 60 % → MODERATE; 6 is new
    (2019, 1, 2, 6, IMP, 1000.0),                                 # early-period presence of 2
    (2019, 1, 6, 27, EXP, 100.0), (2021, 1, 6, 27, EXP, 150.0),   # partner 6 misses 2020 (LAG)
    (2023, 1, 2, 27, EXP, 10.0),
]
# mirror: reporter = partner country, partner = home
MIRROR = [
    (2020, 2, 1, 93, EXP, 400.0),       # vs home imports 600 from partner 2 in 2020 → 33.3 %
    (2020, 2, 1, 84, IMP, 70.0),        # partner imports only: chapter has a NULL export side
    (2019, 3, 1, 6, EXP, 100.0),        # mirror-only year for partner 3 (home has none)
]


def _fact(spark, data):
    df = spark.createDataFrame(data, "year int, reporter_id int, partner_id int, commodity_id int, "
                                     "flow_direction string, trade_value_usd double")
    return df.withColumns({"net_weight_kg": F.lit(None).cast("double"), "quantity": F.lit(None).cast("double"),
                           "qty_unit": F.lit(None).cast("string"), "valuation": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def star(spark):
    countries = spark.createDataFrame([
        ("HOM", "Home", "R0"), ("AAA", "Alpha", "R1"), ("BBB", "Beta", "R1"), ("CCC", "Gamma", "R2"),
        ("DDD", "Delta", None), ("EEE", "Epsilon", "R2")], "iso3 string, name string, region string")
    dim_country = S.build_dim_country(countries)   # ids follow ISO3 order: AAA=1 ... HOM=6
    ids = {x["iso3_code"]: x["country_id"] for x in dim_country.collect()}
    remap = {1: ids["HOM"], 2: ids["AAA"], 3: ids["BBB"], 4: ids["CCC"], 5: ids["DDD"], 6: ids["EEE"], None: None}
    fix = lambda data: [(y, remap[r], remap[p], c, d, v) for y, r, p, c, d, v in data]
    dim_commodity = S.build_dim_commodity(C.clean_chapters(R.hs_chapters(spark)))
    st = S.Star(dim_country, dim_commodity, R.dim_time(spark, 2019, 2023), _fact(spark, fix(TRADE)),
                _fact(spark, fix(MIRROR)),
                spark.createDataFrame([(ids["AAA"], 2020, 10.0, 2.0, 5.0), (ids["AAA"], 2022, 30.0, 3.0, 10.0)],
                                      "country_id int, year int, gdp_usd double, population double, "
                                      "gdp_per_capita double"))
    st.ids = ids
    return st


IMPORTS = TradeFilter(flow="Imports")


def test_hhi_extremes(star):
    h = {(x["section_name"], x["year"]): x for x in rows(CON.hhi_by_section_year(star, IMPORTS))}
    arms = h[("Arms & Ammunition", 2020)]
    assert (arms["hhi"], arms["supplier_count"], arms["top_share_pct"], arms["top_supplier"]) == (10000.0, 1, 100.0,
                                                                                                  "Alpha")
    assert h[("Machinery & Electrical Equipment", 2020)]["hhi"] == 2500.0
    veg = h[("Vegetable Products", 2021)]       # NULL partner excluded (inner join to countries)
    tot = 6004 + 4996 + 700 + 300
    assert veg["hhi"] == round(sum((v / tot * 100) ** 2 for v in (6004, 4996, 700, 300)))
    assert veg["supplier_count"] == 4


def test_risk_bands_threshold_inclusive(star):
    r = rows(CON.risk_summary(star, IMPORTS.with_(year_max=2020)))
    assert r == [{"latest_year": 2020, "n_high": 2, "n_moderate": 0, "n_low": 0}]


def test_trend_counts_null_partner_as_share(star):
    t = {x["year"]: x for x in rows(CON.hhi_trend(star, IMPORTS))}
    tot = 6004 + 4996 + 700 + 300 + 1000
    veg = sum((v / tot * 100) ** 2 for v in (6004, 4996, 700, 300, 1000))
    assert t[2021]["avg_hhi"] == round(veg) and t[2021]["section_count"] == 1


def test_alerts_rounding_and_bands(star):
    f = IMPORTS.with_(year_min=2020, year_max=2022)
    a = {x["hs_chapter"]: x for x in rows(CON.single_source_alerts(star, f))}
    assert "06" not in a and "84" not in a             # 50.04 → 50.0 is not above 50; ties at 50
    assert (a["07"]["share_pct"], a["07"]["risk_level"]) == (70.0, "HIGH")
    assert (a["09"]["share_pct"], a["09"]["risk_level"], a["09"]["supplier"]) == (60.0, "MODERATE", "Epsilon")
    assert (a["93"]["share_pct"], a["08"]["share_pct"]) == (100.0, 100.0)
    c = CON.alert_counts(CON.single_source_alerts(star, f)).first()
    assert (c.n_alerts, c.n_high, c.n_moderate) == (4, 3, 1)


def test_diversification(star):
    d = {(x["section_name"], x["year"]): x for x in rows(CON.diversification(star))}
    assert d[("Vegetable Products", 2021)]["supplier_count"] == 4   # NULL partner not counted


def test_annual_and_kpis_exact_prior_year(star):
    k = OV.overview_kpis(star, TradeFilter(year_min=2019, year_max=2021)).first()
    imp20, imp21 = 900.0, 5004 + 4996 + 700 + 300 + 1000 + 1000.0
    assert k.total_imports == 1000.0 + imp20 + imp21 and k.total_exports == 250.0
    assert k.imports_yoy_pct == pytest.approx((imp21 - imp20) / imp20 * 100)
    assert k.exports_yoy_pct is None                  # prior year exports are 0
    k2 = OV.overview_kpis(star, TradeFilter(year_max=2019)).first()
    assert k2.imports_yoy_pct is None                 # 2018 missing


def test_partner_annual_lag_skips_missing_year(star):
    eps = star.ids["EEE"]
    a = {x["year"]: x for x in rows(PAR.partner_annual(star, TradeFilter(partner_id=eps)))}
    assert sorted(a) == [2019, 2021, 2022]
    assert a[2021]["exports_yoy_pct"] == 50.0         # against 2019, the previous present year
    assert a[2022]["exports_yoy_pct"] == -100.0 and a[2022]["import_chapters"] == 1
    k = PAR.partner_kpis(star, TradeFilter(partner_id=eps)).first()
    assert (k.latest_year, k.latest_exports_yoy_pct, k.total_trade) == (2022, -100.0, 850.0)


def test_partner_share_and_top_chapters(star):
    alpha = star.ids["AAA"]
    s = {x["year"]: x for x in rows(PAR.partner_share(star, TradeFilter(partner_id=alpha)))}
    assert s[2020]["import_share_pct"] == round(600 / 900 * 100, 2)
    assert s[2023]["export_share_pct"] == 100.0 and s[2023]["import_share_pct"] is None
    top = rows(PAR.partner_top_chapters(star, TradeFilter(partner_id=alpha), 2))
    assert [x["hs_chapter"] for x in sorted(top, key=lambda x: -x["total_b"])] == ["06", "08"]


def test_macro_latest(star):
    m = rows(PAR.macro_latest(star))
    assert [(x["year"], x["gdp_per_capita"]) for x in m] == [(2022, 10.0)]


def test_mirror_by_year_left_semantics(star):
    m = {(x["partner_id"], x["year"]): x for x in rows(MIR.mirror_by_year(star))}
    alpha, beta = star.ids["AAA"], star.ids["BBB"]
    assert sorted(m) == sorted([(alpha, 2020), (beta, 2019)])   # home-only years are not shown
    assert (m[(alpha, 2020)]["home_imports_usd"], m[(alpha, 2020)]["import_disc_pct"]) == (600.0, 33.3)
    assert m[(beta, 2019)]["import_disc_pct"] == 100.0           # mirror-only year
    f = {(x["partner_id"], x["year"]): x for x in rows(MIR.mirror_flags(star))}
    assert f[(alpha, 2020)]["import_flag"] == "!" and f[(alpha, 2020)]["years_flagged"] == 1


def test_mirror_by_chapter_inner_and_floor(star):
    d = rows(MIR.mirror_by_chapter(star, floor=0.0))
    assert [(x["hs_chapter"], x["import_disc_pct"]) for x in d] == [("93", 20.0)]
    assert rows(MIR.mirror_by_chapter(star, floor=450.0)) == []
    i = MIR.interpret_disc(MIR.mirror_by_chapter(star, floor=0.0)).first()
    assert i.interpretation.startswith("Home reports more")


def test_emerging_new_entrant_first(star):
    e = rows(COM.emerging_suppliers(star, TradeFilter(section="Vegetable Products"), floor=0.0))
    # span 5 → periods of 2 years: 2019–2020 vs 2022–2023
    assert [x["partner"] for x in e] == ["Epsilon", "Alpha"]
    eps, alpha = e
    assert (eps["is_new_entrant"], eps["growth_pct"], eps["recent_avg_m"]) == (True, None, 0.0)
    assert (alpha["is_new_entrant"], alpha["growth_pct"]) == (False, -60.0)
    assert (alpha["growth_q"], eps["growth_q"]) == (1, 2)        # NULL growth sorts last
    lab = {x["partner"]: x for x in rows(COM.emerging_labels(COM.emerging_suppliers(
        star, TradeFilter(section="Vegetable Products"), floor=0.0)))}
    assert (lab["Epsilon"]["growth_label"], lab["Epsilon"]["quartile_label"]) == ("New entrant", "New")
    assert (lab["Alpha"]["growth_label"], lab["Alpha"]["quartile_label"]) == ("-60.0%", "Q1 — Top 25%")


def test_section_kpis_prior_year_inside_range(star):
    k = {x["section_name"]: x for x in rows(COM.section_kpis(star, TradeFilter(year_min=2021, year_max=2022)))}
    veg = k["Vegetable Products"]
    assert (veg["curr_yr_b"], veg["prev_yr_b"]) == (0.0, 0.0) and veg["yoy_pct"] is None
    k2 = {x["section_name"]: x for x in rows(COM.section_kpis(star, TradeFilter(year_min=2022, year_max=2022)))}
    assert k2["Vegetable Products"]["prev_yr_b"] is None      # 2021 lies outside the range


def test_rollup_totals_equal_leaves(star):
    r = rows(OV.partner_rollup(star, TradeFilter()))
    leaves = sum(x["trade_value_b"] for x in r if x["level"] == "country")
    assert [x["trade_value_b"] for x in r if x["level"] == "all"] == [round(leaves, 3)]
    regions = {x["region"] for x in r if x["level"] == "region"}
    assert "Unknown" in regions


def test_summary_and_ranks(star):
    s = OV.dataset_summary(star).first()
    assert (s.trade_records, s.trading_partners, s.year_min, s.year_max) == (17, 5, 2019, 2023)
    ch = rows(COM.section_chapters(star, TradeFilter(section="Vegetable Products")))
    assert [x["rank"] for x in sorted(ch, key=lambda x: x["rank"])] == [1, 2, 3, 4]
    assert len(rows(COM.chapter_partners(star, TradeFilter(), n=1))) == 8


def test_dimension_probes(star):
    assert OV.chapter_count(star).first().chapters == 99
    yb = OV.year_bounds(star).first()
    assert (yb.lo, yb.hi) == (2019, 2023)
    assert OV.has_rows(star.fact_trade) and not OV.has_rows(star.fact_trade.limit(0))


def test_hot_partner_shares_stay_exact(spark, star):
    # a partner holding a third of all rows: shares are computed on aggregates
    from tradeweave.operators import concentration as CON2
    extra = [(2020, 1, 2, 84, IMP, 1.0)] * 3000
    hot = S.Star(star.dim_country, star.dim_commodity, star.dim_time,
                 star.fact_trade.unionByName(_fact(spark, [(y, star.ids["HOM"], star.ids["AAA"], c, d, v)
                                                            for y, _r, _p, c, d, v in extra])),
                 star.fact_mirror_trade, star.fact_country_stats)
    h = {(x["section_name"], x["year"]): x for x in rows(CON2.hhi_by_section_year(hot, IMPORTS))}
    m = h[("Machinery & Electrical Equipment", 2020)]
    tot = 3100 + 300.0
    assert m["top_share_pct"] == round(3100 / tot * 100, 1) and m["top_supplier"] == "Alpha"


@pytest.mark.parametrize("op,col", [
    (COM.section_kpis, "section_name"), (COM.section_partners, "section_name"),
    (COM.section_chapters, "section_name"), (CON.diversification, "section_name"),
])
def test_one_section_equals_all_sections_restricted(star, op, col):
    f = TradeFilter(year_min=2019, year_max=2023)
    sec = "Vegetable Products"
    one = sorted(map(str, rows(op(star, f.with_(section=sec)))))
    allr = sorted(map(str, rows(op(star, f).where(F.col(col) == sec))))
    assert one == allr and one


def test_emerging_one_section_equals_all(star):
    f = TradeFilter(year_min=2019, year_max=2023)
    one = rows(COM.emerging_suppliers(star, f.with_(section="Vegetable Products"), floor=0.0))
    allr = rows(COM.emerging_suppliers(star, f, floor=0.0).where(F.col("section_name") == "Vegetable Products"))
    assert sorted(map(str, one)) == sorted(map(str, allr))


@pytest.mark.parametrize("op", [PAR.partner_annual, PAR.partner_top_chapters, PAR.partner_share, MIR.mirror_by_year])
def test_one_partner_equals_all_partners_restricted(star, op):
    pid = star.ids["AAA"]
    one = sorted(map(str, rows(op(star, TradeFilter(partner_id=pid)))))
    allr = sorted(map(str, rows(op(star, TradeFilter()).where(F.col("partner_id") == pid))))
    assert one == allr and one


def test_export_flow_filter(star):
    h = rows(CON.hhi_by_section_year(star, TradeFilter(flow="Exports")))
    assert {(x["section_name"], x["year"]) for x in h} == {("Mineral Products", 2019), ("Mineral Products", 2021),
                                                          ("Mineral Products", 2023)}
