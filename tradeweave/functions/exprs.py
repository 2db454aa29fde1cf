"""Reusable column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradeweave.constants import EXPORT_LABELS, IMPORT_LABELS


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space as text files carry it; plain ``trim`` takes blanks only.
WHITE_SPACE = " \t\n\r\x0b\f\u00a0"


def strip(c: Column | str) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(_c(c).cast("string"), F.lit(WHITE_SPACE))


def norm_code(c: Column | str) -> Column:
    """String, stripped, upper-cased code."""
    return F.upper(strip(c))


def numeric_text(c: Column | str) -> Column:
    """One text per whole number: ``842``, ``842.0``, ``0842`` and ``\\t842`` become ``842``; other text is only stripped."""
    return F.regexp_replace(strip(c), r"^\+?0*([0-9]+)(?:\.0*)?$", "$1")


def is_digits(c: Column) -> Column:
    """True for text of decimal digits only, and for empty text."""
    return F.btrim(c, F.lit("0123456789")) == ""


def pad_code(c: Column | str) -> Column:
    """Zero-pad a one- or two-digit numeric code to two characters."""
    c = _c(c)
    return F.when((F.char_length(c) == 1) & is_digits(c), F.concat(F.lit("0"), c)).otherwise(c)


def case_map(c: Column | str, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Lookup through a small fixed mapping; unknown keys give ``default`` (NULL). The key is evaluated once."""
    if not mapping:
        return default if default is not None else F.lit(None).cast("string")
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), _c(c))
    return F.coalesce(out, default) if default is not None else out


def is_import(c: Column | str = "flow_direction") -> Column:
    return _c(c).isin(*IMPORT_LABELS)


def is_export(c: Column | str = "flow_direction") -> Column:
    return _c(c).isin(*EXPORT_LABELS)


def try_number(c: Column | str) -> Column:
    """Text → double; text that is no finite number (``n/a``, ``NaN``, ``Infinity``) becomes NULL, never an error."""
    n = strip(c).try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)  # NaN is above infinity


def to_int(c: Column | str) -> Column:
    """Text or number → int via double, so '842.0' becomes 842; a number that no int holds (NaN, infinity) becomes NULL.
    The text stands in it once, as Spark copies the whole of it into every condition on the result."""
    return strip(c).try_cast("double").try_cast("int")


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (no ANSI error, no infinity)."""
    return F.when(den != 0, num / den)


def pct_change(cur: Column, prev: Column, *, abs_base: bool = False) -> Column:
    """(cur - prev) / prev * 100, NULL when prev is NULL or 0."""
    base = F.abs(prev) if abs_base else prev
    return F.when(prev != 0, (cur - prev) / base * 100.0)


def band(value: Column, bounds: Sequence[tuple[float, str]], otherwise: str, *, strict: bool = False) -> Column:
    """Label by descending thresholds: first (bound, label) with value >= bound (or > if strict)."""
    out = None
    for bound, label in bounds:
        cond = value > bound if strict else value >= bound
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(otherwise)
