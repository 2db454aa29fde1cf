"""Column-expression helpers (all built-in Spark functions, no UDFs)."""

from tradeweave.functions.exprs import (  # noqa: F401
    band,
    case_map,
    is_export,
    is_import,
    norm_code,
    pad_code,
    pct_change,
    safe_div,
    to_int,
    try_number,
)
