"""Physical-plan properties on a loaded warehouse (the scale-relevant shape of the plans)."""

from __future__ import annotations

import re

import pytest

from conftest import SF_SMOKE
from tradeweave.plans.registry import ON_STAR
from tradeweave.plans.warehouse import STANDIN_CONFIG, load_warehouse
from tradeweave.sources.standin import load_raw_inputs


@pytest.fixture(scope="module")
def wh(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "wh")
    return load_warehouse(spark, load_raw_inputs(spark, SF_SMOKE), path, STANDIN_CONFIG)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q11_hhi", "q22_partner_share", "q30_emerging", "q29_diversification"])
def test_single_fact_scan(wh, name):
    p = plan(ON_STAR[name](wh))
    assert p.count("fact_trade") >= 1
    assert len(re.findall(r"/fact_trade[,\]]", p)) == 1, p


@pytest.mark.parametrize("name", ["q15_alerts", "q21_partner_top_chapters", "q28_section_partners"])
def test_rank_filters_use_window_group_limit(wh, name):
    assert "WindowGroupLimit" in plan(ON_STAR[name](wh))


@pytest.mark.parametrize("name", ["q7_balance_series", "q8_top_partners", "q27_section_kpis", "q30_emerging"])
def test_year_ranges_prune_partitions(wh, name):
    p = plan(ON_STAR[name](wh))
    assert re.search(r"PartitionFilters: \[[^\]]*year", p), p


def test_dimension_joins_are_broadcast(wh):
    for name in ("q11_hhi", "q15_alerts", "q28_section_partners", "q33_chapter_partners"):
        p = plan(ON_STAR[name](wh))
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p, name


def test_scans_read_only_needed_columns(wh):
    p = plan(ON_STAR["q5_annual_balance"](wh))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", p).group(1)
    assert "net_weight_kg" not in schema and "trade_value_usd" in schema


def test_a_session_with_sparks_default_gets_compiled_methods(spark):
    from tradeweave.session import COMPILED_METHOD, keep_methods_compiled

    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        for had, wanted in (("65535", COMPILED_METHOD), ("4000", "4000")):
            spark.conf.set(key, had)
            keep_methods_compiled(spark)
            assert spark.conf.get(key) == wanted
    finally:
        spark.conf.set(key, before)
