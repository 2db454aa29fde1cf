"""Landed paged JSON payloads.

Each landed file holds one API page: ``[{"page": 1, "pages": n}, [record, ...]]``.
Files are read whole (one row per page, a page is bounded), parsed into variants
and exploded, so a cell of an odd type costs that cell only, not its page. A payload that is
not a two-element list is skipped; a page whose data is NULL yields no rows.
``flatten_indicator_variant`` keeps, besides the known fields, whatever else a record holds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.constants import ISO3_UN_NUMERIC

#: Known fields of an indicator record: output column → (path, type).
INDICATOR_FIELDS = {"country_iso3": ("countryiso3code", "string"), "country_name": ("country.value", "string"),
                    "year": ("date", "string"), "value": ("value", "double")}
COUNTRY_FIELDS = {"iso3": "id", "name": "name", "region": "region.value", "income_group": "incomeLevel.value", "iso2": "iso2Code",
                  "capital": "capitalCity", "longitude": "longitude", "latitude": "latitude"}


def variant_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the landed pages as one variant ``r``, whatever its fields. Pages that are no JSON, or no
    two-element list whose second is a list, are skipped, and so are elements that are no objects."""
    pages = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("page"))
    both = pages.select(F.expr("try_cast(page AS ARRAY<VARIANT>)").alias("p")).where(F.size("p") == 2)
    records = both.select(F.explode(F.expr("try_cast(p[1] AS ARRAY<VARIANT>)")).alias("r"))
    return records.where(F.schema_of_variant("r").startswith("OBJECT"))


def flatten_indicator_variant(spark: SparkSession, path: str, indicator: str) -> DataFrame:
    """S7 with nothing lost: (country_iso3, country_name, indicator, year, value) and ``rest``, a map from field name to variant of all
    fields that are not known, and of known ones whose cell does not have the field's type (the column is NULL then)."""
    r = variant_records(spark, path)
    typed = {name: F.expr(f"try_variant_get(r, '$.{at}', '{kind}')") for name, (at, kind) in INDICATOR_FIELDS.items()}
    flat = r.select("r", *[c.alias(name) for name, c in typed.items()])
    # a known field stays in ``rest`` where its cell is there but not as the declared type
    lost = [F.when(F.col(name).isNull() & F.expr(f"NOT coalesce(is_variant_null(try_variant_get(r, '$.{at.split('.')[0]}', 'variant')), true)"),
                   F.lit(at.split(".")[0])) for name, (at, _kind) in INDICATOR_FIELDS.items()]
    known = F.array(*[F.lit(at.split(".")[0]) for at, _kind in INDICATOR_FIELDS.values()])
    fields = F.expr("cast(r AS MAP<STRING, VARIANT>)")
    flat = flat.withColumns({"_lost": F.array_compact(F.array(*lost)), "_fields": fields})
    rest = F.map_filter("_fields", lambda k, _v: ~F.array_contains(known, k) | F.array_contains(F.col("_lost"), k))
    return flat.select("country_iso3", "country_name", F.lit(indicator).alias("indicator"), "year", "value", rest.alias("rest"))


def flatten_indicator(spark: SparkSession, path: str, indicator: str) -> DataFrame:
    """(country_iso3, country_name, indicator, year, value) rows of one indicator."""
    return flatten_indicator_variant(spark, path, indicator).drop("rest")


def flatten_countries(spark: SparkSession, path: str, overrides: Mapping[str, int] = ISO3_UN_NUMERIC) -> DataFrame:
    """Country metadata rows with the numeric-code override attached."""
    r = variant_records(spark, path)
    codes = F.create_map(*[x for k, v in overrides.items() for x in (F.lit(k), F.lit(v))])
    flat = r.select(*[F.expr(f"try_variant_get(r, '$.{at}', 'string')").alias(name) for name, at in COUNTRY_FIELDS.items()])
    return flat.withColumn("un_numeric", F.try_element_at(codes, F.col("iso3")).cast("string"))
