"""Base cube: positive flows rolled up to (year, flow_direction, partner_id, commodity_id).

All F1-filtered analytical operators are rollups of it — sums are additive,
distinct counts are over cube keys, and the record count is ``sum(n_records)``
— so dashboards can serve them from the cube instead of the fact. The fact's
reporter grain, weights and quantities are not in the cube, so the load-time
checks (L2–L4, L9–L11) and the no-F1 variant Q36 stay on the fact.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.operators.star import Star
from tradeweave.params import positive

CUBE_KEYS = ("year", "flow_direction", "partner_id", "commodity_id")
CUBE_SCHEMA = "year int, flow_direction string, partner_id int, commodity_id int, trade_value_usd double, n_records bigint"

#: Registered queries whose answer is the same on the cube as on the fact.
CUBE_QUERIES = tuple(
    f"q{n}" for n in (1, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 21, 22, 24, 25, 26, 27, 28, 29,
                      30, 31, 32, 33, 34, 35)) + ("l12", "l13", "l14", "l15")


def trade_cube(fact: DataFrame) -> DataFrame:
    """Sum of positive values and record count per cube key (one aggregation,
    combined map-side)."""
    return fact.where(positive()).groupBy(*CUBE_KEYS).agg(
        F.sum("trade_value_usd").alias("trade_value_usd"), F.count(F.lit(1)).alias("n_records"))


def with_cube(star: Star, cube: DataFrame | None = None) -> Star:
    """The same star with ``fact_trade`` replaced by the cube."""
    return replace(star, fact_trade=cube if cube is not None else trade_cube(star.fact_trade))


def serves_from_cube(query_name: str) -> bool:
    return query_name.split("_")[0] in CUBE_QUERIES
