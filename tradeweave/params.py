"""The shared predicate set of every analytical query."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.constants import EXPORT_LABELS, IMPORT_LABELS

FLOW_OPTIONS = {"Imports": IMPORT_LABELS, "Exports": EXPORT_LABELS, "Both": None}


@dataclass(frozen=True)
class TradeFilter:
    """flow: Imports / Exports / Both; inclusive year range; optional selections.

    ``section`` / ``chapter`` / ``partner_id`` of None mean "all", and the
    operators then return one group per section / chapter / partner.
    """

    flow: str = "Both"
    year_min: int | None = None
    year_max: int | None = None
    section: str | None = None
    chapter: str | None = None
    partner_id: int | None = None

    def with_(self, **kw) -> TradeFilter:
        return replace(self, **kw)

    def flow_pred(self, col: str = "flow_direction") -> Column | None:
        labels = FLOW_OPTIONS[self.flow]
        return None if labels is None else F.col(col).isin(*labels)

    def year_pred(self, col: str = "year") -> Column | None:
        preds = []
        if self.year_min is not None:
            preds.append(F.col(col) >= self.year_min)
        if self.year_max is not None:
            preds.append(F.col(col) <= self.year_max)
        return _and(preds)


def _and(preds: list[Column]) -> Column | None:
    out = None
    for p in preds:
        out = p if out is None else out & p
    return out


def where_all(df: DataFrame, *preds: Column | None) -> DataFrame:
    p = _and([x for x in preds if x is not None])
    return df if p is None else df.where(p)


def positive(col: str = "trade_value_usd") -> Column:
    """strictly positive value (NULL excluded)."""
    return F.col(col) > 0
