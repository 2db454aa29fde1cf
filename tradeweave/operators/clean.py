"""Cleaning of raw flow records, indicator feeds and reference tables.

All operators are ``DataFrame -> DataFrame`` and lazy. Steps guard on column
presence at plan-build time, like the analysed pipeline guards on its frame.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.constants import (
    AGGREGATE_HS_CODES,
    DEFAULT_DEDUP_KEYS,
    FLOW_CODE_LABELS,
    FLOW_RENAME,
    FLOW_SIMPLE,
    FLOW_VALUATION,
    INDICATOR_AGGREGATE_ISO3,
    INDICATOR_NAMES,
    WORLD_PARTNER_CODES,
)
from tradeweave.functions.exprs import case_map, is_digits, norm_code, numeric_text, pad_code, safe_div, strip, to_int, try_number

REJECT = "_reject"
#: Columns whose text is brought to one form per number before keys are compared.
NUMERIC_KEYS = ("year", "reporter_code", "partner_code")
LEDGER_STEPS = ("input", "world_partner", "aggregate_hs", "invalid_hs", "duplicate", "kept")


# --------------------------------------------------------------------------- C1
def rename_present(df: DataFrame, mapping: Mapping[str, str] = FLOW_RENAME) -> DataFrame:
    """Rename only the mapped columns that exist; other columns are kept."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


# --------------------------------------------------------------------------- C2–C6
def is_world_partner(code: Column, codes: Sequence[str] = WORLD_PARTNER_CODES) -> Column:
    """True for world/undisclosed partner codes; a NULL code is not one."""
    return F.coalesce(numeric_text(code).isin(*codes), F.lit(False))


def is_aggregate_hs(code: Column, tokens: Sequence[str] = AGGREGATE_HS_CODES) -> Column:
    return F.coalesce(code.isin(*tokens), F.lit(False))


def is_valid_hs(code: Column) -> Column:
    """Two digits."""
    return F.coalesce((F.char_length(code) == 2) & is_digits(code), F.lit(False))


def is_chapter(code: Column) -> Column:
    """Whether the padded code is valid, asked of the unpadded one: Spark copies the whole parse of a code into
    every place where a filter names it, so it stands here once."""
    return F.coalesce(code.rlike(r"\A[0-9]{1,2}\z"), F.lit(False))


def drop_world(df: DataFrame, codes: Sequence[str] = WORLD_PARTNER_CODES) -> DataFrame:
    if "partner_code" not in df.columns:
        return df
    return df.where(~is_world_partner(F.col("partner_code"), codes))


def normalise_hs(df: DataFrame) -> DataFrame:
    """Trim/upper the HS code, then zero-pad one- and two-digit codes.

    Aggregate tokens are tested on the unpadded code (so ``9`` is not the
    aggregate ``99``); use :func:`tag_flows` to get both.
    """
    if "hs_code" not in df.columns:
        return df
    return df.withColumn("hs_code", pad_code(norm_code(F.col("hs_code"))))


def drop_aggregates(df: DataFrame, tokens: Sequence[str] = AGGREGATE_HS_CODES) -> DataFrame:
    """C4: drop commodity aggregate tokens, tested on the trimmed, upper-cased,
    still unpadded code (so the token ``99`` never matches a padded ``9``)."""
    if "hs_code" not in df.columns:
        return df
    return df.where(~is_aggregate_hs(norm_code(F.col("hs_code")), tokens))


def keep_valid_hs(df: DataFrame) -> DataFrame:
    """C5+C6: zero-pad and keep only two-digit chapter codes."""
    if "hs_code" not in df.columns:
        return df
    return normalise_hs(df).where(is_valid_hs(F.col("hs_code")))


def invalid_hs_sample(raw: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent invalid HS codes that reach the validity check."""
    t = tagged(raw)
    return (t.where(F.col(REJECT) == "invalid_hs").groupBy("hs_code")
             .agg(F.count(F.lit(1)).alias("rows"))
             .orderBy(F.col("rows").desc(), F.col("hs_code").asc_nulls_last()).limit(n))


# --------------------------------------------------------------------------- C7–C9
def map_flow(df: DataFrame) -> DataFrame:
    """Flow code → label (unknown codes pass through), simple direction, valuation."""
    if "flow_code" not in df.columns:
        return df
    code = strip("flow_code")

    def of_code(by_label: Mapping[str, str]) -> dict[str, str]:
        """By code or by label, as either may stand in the cell."""
        return dict(by_label) | {c: by_label[label] for c, label in FLOW_CODE_LABELS.items() if label in by_label}

    return df.withColumns({
        "flow_code": case_map(code, FLOW_CODE_LABELS, code),
        "flow_direction_simple": case_map(code, of_code(FLOW_SIMPLE)),
        "valuation": case_map(code, of_code(FLOW_VALUATION)),
    })


def unknown_flows(raw: DataFrame) -> DataFrame:
    """Rows per flow label that is not one of the four known labels."""
    t = tagged(raw).where(F.col(REJECT).isNull())
    known = F.coalesce(F.col("flow_code").isin(*FLOW_CODE_LABELS.values()), F.lit(False))
    return t.where(~known).groupBy("flow_code").agg(F.count(F.lit(1)).alias("rows"))


# --------------------------------------------------------------------------- C10–C11
def coerce_numeric(df: DataFrame, doubles: Iterable[str] = (), ints: Iterable[str] = ()) -> DataFrame:
    """Text → number; text that does not parse becomes NULL."""
    cols = {c: try_number(F.col(c)) for c in doubles if c in df.columns}
    cols.update({c: to_int(F.col(c)) for c in ints if c in df.columns})
    return df.withColumns(cols) if cols else df


def value_audit(df: DataFrame, col: str = "trade_value_usd") -> DataFrame:
    """C11: NULL / negative / zero counts of the value column (rows are kept)."""
    v = try_number(F.col(col))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(v.isNull()).alias("null_values"),
        F.count_if(v < 0).alias("negative_values"),
        F.count_if(v == 0).alias("zero_values"),
    )


# --------------------------------------------------------------------------- C12
def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row (by ``order``) of every ``keys`` group; NULL keys compare equal.

    Spark limits each group to its first row in every map task before the shuffle
    (the rank is filtered to 1), so a hot key never lands whole in one task. A hash of the
    keys leads them in the sorts: rows of different keys are told apart by that number, not by the texts.
    """
    first = Window.partitionBy("_hash_of_keys", *keys).orderBy(*order)
    ranked = df.withColumn("_hash_of_keys", F.xxhash64(*keys)).withColumn("_nth", F.row_number().over(first))
    return ranked.where(F.col("_nth") == 1).drop("_nth", "_hash_of_keys")


# --------------------------------------------------------------------------- C13/C15
def tag_flows(raw: DataFrame) -> DataFrame:
    """Rename, normalise and tag every raw row with the first rule that rejects it.

    ``_reject`` is one of world_partner / aggregate_hs / invalid_hs, or NULL
    for rows that survive the filters. Years and country codes get one text per
    number, so ``842`` and ``842.0`` are one key; other text is a value of its own.
    """
    df = rename_present(raw)
    df = df.withColumns({c: numeric_text(c) for c in NUMERIC_KEYS if c in df.columns})
    reason: Column | None = None
    if "partner_code" in df.columns:
        # the code already has one text per number
        reason = F.when(F.coalesce(F.col("partner_code").isin(*WORLD_PARTNER_CODES), F.lit(False)), "world_partner")
    if "hs_code" in df.columns:
        df = df.withColumn("hs_code", norm_code(F.col("hs_code")))
        agg = is_aggregate_hs(F.col("hs_code"))
        bad = ~is_chapter(F.col("hs_code"))
        reason = F.when(agg, "aggregate_hs") if reason is None else reason.when(agg, "aggregate_hs")
        reason = reason.when(bad, "invalid_hs")
    df = map_flow(df).withColumn(REJECT, reason if reason is not None else F.lit(None).cast("string"))
    return df.withColumn("hs_code", pad_code(F.col("hs_code"))) if "hs_code" in df.columns else df


def tagged(flows: DataFrame) -> DataFrame:
    """``flows`` with their tags: a table that was written with them passes as it is."""
    return flows if REJECT in flows.columns else tag_flows(flows)


def _dedup_keys_present(df: DataFrame, keys: Sequence[str]) -> bool:
    return all(k in df.columns for k in keys)


def clean_flows(raw: DataFrame, order: Sequence[str],
                dedup_keys: Sequence[str] = DEFAULT_DEDUP_KEYS) -> DataFrame:
    """Full clean of a raw (or tagged) flow table, one lazy plan.

    Order of steps: rename → world filter → HS normalise / aggregate drop /
    validity → flow mapping → value coercion → keep-first dedup on the key
    texts (one text per number) → numeric coercion of the remaining columns. ``order`` names the
    ingest-order columns (dropped from the output).
    """
    df = tagged(raw).where(F.col(REJECT).isNull()).drop(REJECT)
    df = coerce_numeric(df, doubles=["trade_value_usd"])
    if _dedup_keys_present(df, dedup_keys):
        df = dedup_first(df, dedup_keys, order)
    df = coerce_numeric(df, doubles=["net_weight_kg", "quantity"],
                        ints=["year", "reporter_code", "partner_code"])
    return df.drop(*[c for c in order if c in df.columns])


def flow_years(raw: DataFrame, dedup_keys: Sequence[str] = DEFAULT_DEDUP_KEYS) -> DataFrame | None:
    """Every ``year`` of the clean flows, once. A dedup key that holds the year's text drops no year,
    so the kept rows need not be found; None for other keys. Rows that are not tagged yet are brought to their distinct
    cells first: only those are parsed."""
    df = rename_present(raw)
    if "year" not in df.columns or (_dedup_keys_present(df, dedup_keys) and "year" not in dedup_keys):
        return None
    t = df if REJECT in df.columns else tag_flows(df.select(*[c for c in ("year", "partner_code", "hs_code") if c in df.columns]).distinct())
    return t.where(F.col(REJECT).isNull()).select("year").distinct().select(to_int(F.col("year")).alias("year"))


def cleaning_ledger(raw: DataFrame, dedup_keys: Sequence[str] = DEFAULT_DEDUP_KEYS) -> DataFrame:
    """Rows per cleaning outcome, every step listed (step_no, step, rows, pct_of_input).

    One pass: rows are counted per (reason, dedup key) — combined map-side —
    then folded into one row and unfolded into the fixed list of steps.
    """
    t = tagged(raw)
    keys = list(dedup_keys) if _dedup_keys_present(t, dedup_keys) else []
    r, n = F.col(REJECT), F.col("n")
    # rejected rows need no keys: they fold into one group per reason
    t = t.withColumns({k: F.when(r.isNull(), F.col(k)) for k in keys}) if keys else t
    per_key = t.groupBy(REJECT, *keys).agg(F.count(F.lit(1)).alias("n"))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    one = per_key.agg(
        total(n).alias("input"),
        *[total(F.when(r == reason, n)).alias(reason) for reason in ("world_partner", "aggregate_hs", "invalid_hs")],
        total(F.when(r.isNull(), n - 1) if keys else F.lit(0)).alias("duplicate"),
        (F.count_if(r.isNull()).cast("long") if keys else total(F.when(r.isNull(), n))).alias("kept"),
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(s).alias("step"), F.col(s).alias("rows"))
                      for i, s in enumerate(LEDGER_STEPS)])
    out = one.select("input", F.explode(steps).alias("e"))
    return out.select("e.step_no", "e.step", "e.rows",
                      F.round(F.col("e.rows") / F.when(F.col("input") != 0, F.col("input")) * 100.0, 2)
                      .alias("pct_of_input"))


# --------------------------------------------------------------------------- C14
def null_pct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Percentage of NULLs per column, 2 dp, as (column_name, null_pct) rows."""
    present = [c for c in cols if c in df.columns]
    wide = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")) * 100.0, 2).alias(c) for c in present])
    return wide.unpivot([], present, "column_name", "null_pct")


# --------------------------------------------------------------------------- C16–C21
def union_indicators(*frames: DataFrame) -> DataFrame:
    """Concatenate long indicator frames; drop values and years that do not parse, so that
    the first *parseable* value of a group is the first one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out = out.withColumn("value", try_number("value")).where(F.col("value").isNotNull())
    return out.withColumn("year", to_int(F.col("year"))).where(F.col("year").isNotNull())


def map_indicators(df: DataFrame, names: Mapping[str, str] = INDICATOR_NAMES,
                   aggregates: Sequence[str] = INDICATOR_AGGREGATE_ISO3) -> DataFrame:
    """C17: friendly indicator names (unknown pass through); drop aggregate ISO3s."""
    df = df.withColumn("indicator", F.coalesce(case_map(F.col("indicator"), names), F.col("indicator")))
    return df.where(~F.coalesce(F.col("country_iso3").isin(*aggregates), F.lit(False)))


def pivot_indicators(df: DataFrame, order: Sequence[str], columns: Sequence[str] = ("gdp_usd", "population"),
                     index: Sequence[str] = ("country_iso3", "country_name", "year")) -> DataFrame:
    """Long → wide, first value per indicator in ingest order.

    Rows with a NULL index value are dropped. Every name in ``columns``
    becomes a column even if no row carries it (C19). Written as one
    aggregation with ``min_by`` per indicator, so hot keys combine map-side. One
    order column is compared as it is (NULL first): its buffers have a fixed width, so
    the rows are hashed, where a struct's would be sorted.
    """
    keyed = df
    for c in index:
        keyed = keyed.where(F.col(c).isNotNull())
    value = F.col("value").try_cast("double")

    def first(name: str) -> Column:
        own = F.col("indicator") == name
        if len(order) > 1:
            return F.min_by(value, F.when(own, F.struct(*order)))
        seq = F.col(order[0])
        unplaced = own & seq.isNull()
        return F.when(F.count_if(unplaced) > 0, F.min(F.when(unplaced, value))).otherwise(F.min_by(value, F.when(own, seq)))

    return keyed.groupBy(*index).agg(*[first(name).alias(name) for name in columns])


def gdp_per_capita(df: DataFrame) -> DataFrame:
    """C20: gdp_usd / population; NULL when population is 0 or either side missing."""
    return df.withColumn("gdp_per_capita", safe_div(F.col("gdp_usd"), F.col("population")))


def stats_years(*indicator_frames: DataFrame) -> DataFrame:
    """Every ``year`` of the clean country statistics, without their figures."""
    long = map_indicators(union_indicators(*indicator_frames))
    return long.where(F.col("country_iso3").isNotNull() & F.col("country_name").isNotNull()).select("year").distinct()


def clean_country_stats(*indicator_frames: DataFrame, order: Sequence[str] = ("_ing_seq",)) -> DataFrame:
    """C16→C20 as one plan: union, filter, map, pivot, per-capita ratio."""
    long = map_indicators(union_indicators(*indicator_frames))
    return gdp_per_capita(pivot_indicators(long, order))


def stats_summary(stats: DataFrame) -> DataFrame:
    """Rows, distinct countries, year range, per-capita coverage."""
    return stats.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("country_iso3").alias("countries"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.count("gdp_per_capita").alias("per_capita_rows"),
        F.count_if(F.col("gdp_per_capita").isNull()).alias("per_capita_null"),
    )


# --------------------------------------------------------------------------- C22–C23
def clean_chapters(df: DataFrame) -> DataFrame:
    """Rebuild the zero-padded chapter code from the chapter number."""
    n = to_int(F.col("chapter_int"))
    return df.withColumns({"chapter_int": n,
                           "chapter_code": F.when(n.isNotNull(), F.lpad(n.cast("string"), 2, "0"))})


def chapter_summary(chapters: DataFrame) -> DataFrame:
    return chapters.agg(F.count(F.lit(1)).alias("chapters"), F.count_distinct("section_num").alias("sections"))


def clean_countries(df: DataFrame) -> DataFrame:
    """Drop countries with a NULL or blank name."""
    return df.where(F.col("name").isNotNull() & (strip("name") != ""))


def country_coverage(raw: DataFrame) -> DataFrame:
    c = clean_countries(raw)
    return c.agg(F.count(F.lit(1)).alias("countries"),
                 F.count("un_numeric").alias("with_un_numeric"),
                 F.count("region").alias("with_region"))
