"""SQL table functions against the DataFrame operators, over one loaded warehouse."""

from __future__ import annotations

import re

import pytest

from conftest import SF_SMOKE
from tradeweave.operators import commodity as COM
from tradeweave.operators import concentration as CON
from tradeweave.operators import overview as OV
from tradeweave.operators import partner as PAR
from tradeweave.params import TradeFilter
from tradeweave.plans.sql_functions import call, register_functions
from tradeweave.plans.warehouse import STANDIN_CONFIG, load_warehouse
from tradeweave.sources.standin import load_raw_inputs


@pytest.fixture(scope="module")
def wh(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("functions") / "wh")
    star = load_warehouse(spark, load_raw_inputs(spark, SF_SMOKE), path, STANDIN_CONFIG)
    register_functions(spark, star)
    return star


def same(got, want):
    assert got.columns == want.columns
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    rows = text(got)
    assert rows and rows == text(want)


YEARS = {"year_from": 1996, "year_to": 1999}
F_YEARS = TradeFilter(year_min=1996, year_max=1999)
SECTION = "Live Animals & Animal Products"


@pytest.mark.parametrize("flow", ["Imports", "Exports", "Both"])
def test_flow_and_years(spark, wh, flow):
    f = F_YEARS.with_(flow=flow)
    same(call(spark, "tw_top_partners", flow=flow, n=4, **YEARS), OV.top_partners(wh, f, 4))
    same(call(spark, "tw_section_hhi", flow=flow, **YEARS), CON.hhi_by_section_year(wh, f))
    same(call(spark, "tw_supplier_alerts", flow=flow, min_share=5.0, high_share=14.0, **YEARS), CON.single_source_alerts(wh, f, 5.0, 14.0))


def test_selections(spark, wh):
    same(call(spark, "tw_balance_series", year_from=1997), OV.balance_series(wh, TradeFilter(year_min=1997)))
    same(call(spark, "tw_partner_annual", partner=19), PAR.partner_annual(wh, TradeFilter(partner_id=19)))
    same(call(spark, "tw_partner_annual"), PAR.partner_annual(wh))
    same(call(spark, "tw_section_partners", section=SECTION, n=3), COM.section_partners(wh, TradeFilter(section=SECTION), 3))
    same(call(spark, "tw_chapter_partners", chapter="19", year_to=1999), COM.chapter_partners(wh, TradeFilter(chapter="19", year_max=1999)))


@pytest.mark.parametrize("section", [None, SECTION])
def test_emerging(spark, wh, section):
    args = {"section": section} if section else {}
    f = TradeFilter(flow="Imports", year_min=1995, year_max=2000, section=section)
    same(call(spark, "tw_emerging_suppliers", year_from=1995, year_to=2000, period=2, floor=2e6, n=4, **args), COM.emerging_suppliers(wh, f, 2e6, 4, 2))


def test_arguments_are_values(spark, wh):
    assert call(spark, "tw_chapter_partners", chapter="19' OR '1'='1").count() == 0
    assert call(spark, "tw_trade_rows", section=SECTION, year_from=1996, year_to=1996).where("section_name <> 'x'").count() > 0
    with pytest.raises(ValueError):
        call(spark, "tw_trade_rows(); DROP")
    with pytest.raises(Exception, match="flow must be"):
        call(spark, "tw_trade_rows", flow="import").collect()


def test_years_prune_and_absent_parameters_fold_away(spark, wh):
    plan = call(spark, "tw_balance_series", **YEARS)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*1996[^\]]*1999", plan), plan
    plan = call(spark, "tw_trade_rows")._jdf.queryExecution().executedPlan().toString()
    assert "raise_error" not in plan and "PartitionFilters: []" in plan, plan


def test_another_star_under_another_prefix(spark, wh):
    from dataclasses import replace

    register_functions(spark, replace(wh, fact_trade=wh.fact_trade.limit(0)), "none_")
    assert call(spark, "none_section_hhi").count() == 0 and call(spark, "none_emerging_suppliers", year_from=1, year_to=2).count() == 0
    assert call(spark, "tw_section_hhi").count() > 0
