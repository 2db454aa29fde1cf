"""Indicator and country pages with odd cells, unknown fields and broken pages."""

from __future__ import annotations

import json
import os

from tradeweave.sources.payloads import flatten_countries, flatten_indicator, flatten_indicator_variant


def put(root, **pages):
    os.makedirs(root, exist_ok=True)
    for name, page in pages.items():
        with open(f"{root}/{name}.json", "w") as fh:
            fh.write(page if isinstance(page, str) else json.dumps(page))
    return root


GOOD = {"countryiso3code": "CHN", "country": {"id": "CN", "value": "China"}, "date": "2020", "value": 5.5}


def test_an_odd_cell_costs_that_cell_only(spark, scratch):
    odd = {"countryiso3code": "USA", "country": "plain", "date": 2021, "value": "n/a"}
    path = put(scratch + "/p", a=[{"page": 1}, [GOOD, odd, 7, None, [1]]], b={"message": "error"}, c=[{"page": 2}, None], d="no json", e=[1, 2, 3], f="")
    rows = {r["country_iso3"]: r for r in flatten_indicator_variant(spark, path, "X").selectExpr("*", "transform_values(rest, (k, v) -> to_json(v)) AS texts").collect()}
    assert sorted(rows) == ["CHN", "USA"]
    assert (rows["CHN"]["country_name"], rows["CHN"]["year"], rows["CHN"]["value"], rows["CHN"]["texts"]) == ("China", "2020", 5.5, {})
    assert (rows["USA"]["country_name"], rows["USA"]["year"], rows["USA"]["value"]) == (None, "2021", None)
    assert rows["USA"]["texts"] == {"country": '"plain"', "value": '"n/a"'}
    plain = flatten_indicator(spark, path, "X")
    assert plain.columns == ["country_iso3", "country_name", "indicator", "year", "value"] and plain.count() == 2


def test_fields_that_no_one_declared_survive(spark, scratch):
    path = put(scratch + "/p", a=[{}, [{**GOOD, "unit": {"scale": [1, {"x": None}]}, "obs_status": "E"}, {**GOOD, "value": None}]])
    texts = [r[0] for r in flatten_indicator_variant(spark, path, "X").orderBy("value", ascending=False).selectExpr("transform_values(rest, (k, v) -> to_json(v))").collect()]
    assert texts == [{"unit": '{"scale":[1,{"x":null}]}', "obs_status": '"E"'}, {}]


def test_countries(spark, scratch):
    path = put(scratch + "/p", a=[{}, [{"id": "CHN", "name": "China", "region": {"value": "Asia"}, "incomeLevel": 3, "iso2Code": "CN", "capitalCity": None, "longitude": 116.3, "latitude": "40"}]])
    r = flatten_countries(spark, path, {"CHN": 156}).first().asDict()
    assert r == {"iso3": "CHN", "name": "China", "region": "Asia", "income_group": None, "iso2": "CN", "capital": None, "longitude": "116.3", "latitude": "40", "un_numeric": "156"}
