"""End-to-end batch plan: raw inputs → clean tables → star schema.

``build_star`` composes one lazy plan per table. ``load_warehouse`` writes
the warehouse (facts partitioned by year, with contiguous keys) into a shared
folder and ``read_star`` serves queries from it, which is how the analytical
queries run in production: the load happens once, queries prune by year.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from tradeweave.constants import (
    DEFAULT_DEDUP_KEYS,
    DEFAULT_LAST_PERIOD,
    DEFAULT_PERIODS,
    DEFAULT_YEAR_RANGE,
    REGION_FILL_IF_NULL,
    REGION_OVERWRITE,
)
from tradeweave.operators import clean as C
from tradeweave.operators import star as S
from tradeweave.operators import summaries as SU
from tradeweave.plans.cube import CUBE_SCHEMA, trade_cube
from tradeweave.session import keep_methods_compiled
from tradeweave.sources import reference as R
from tradeweave.sources import standin
from tradeweave.sources.clustered import write_clustered


@dataclass(frozen=True)
class PipelineConfig:
    dedup_keys: tuple[str, ...] = DEFAULT_DEDUP_KEYS
    #: Years the time dimension holds besides those of the data.
    years: tuple[int, int] | None = DEFAULT_YEAR_RANGE
    periods: tuple[tuple[int, str], ...] = DEFAULT_PERIODS
    last_period: str = DEFAULT_LAST_PERIOD
    region_overwrite: Mapping[str, Sequence[str]] = field(default_factory=lambda: REGION_OVERWRITE)
    region_fill: Mapping[str, Sequence[str]] = field(default_factory=lambda: REGION_FILL_IF_NULL)


#: Configuration for the stand-in inputs: the years of the data, in three periods;
#: everything else keeps the reference defaults.
STANDIN_CONFIG = PipelineConfig(
    years=None,
    periods=((1997, "Early 1995-1997"), (1999, "Middle 1998-1999")),
    last_period="Late 2000+",
)


def clean_stage(raw: standin.RawInputs, cfg: PipelineConfig = PipelineConfig()) -> dict[str, DataFrame]:
    """The clean staging tables (one lazy plan each)."""
    return {
        "trade_flows": C.clean_flows(raw.reporter_flows, raw.flow_order, cfg.dedup_keys),
        "mirror_flows": C.clean_flows(raw.mirror_flows, raw.flow_order, cfg.dedup_keys),
        "country_stats": C.clean_country_stats(raw.indicators, order=raw.indicator_order),
        "hs_chapters": C.clean_chapters(raw.hs_chapters),
        "countries": C.clean_countries(raw.country_mapping),
    }


def year_tables(raw: standin.RawInputs, stage: dict[str, DataFrame], cfg: PipelineConfig = PipelineConfig()) -> list[DataFrame]:
    """The years of the clean flows, mirror flows and statistics, found without cleaning them whole."""
    flows = {"trade_flows": raw.reporter_flows, "mirror_flows": raw.mirror_flows}
    found = [C.flow_years(df, cfg.dedup_keys) for df in flows.values()]
    return [stage[name] if df is None else df for name, df in zip(flows, found)] + [C.stats_years(raw.indicators)]


def star_from_stage(spark: SparkSession, stage: dict[str, DataFrame], cfg: PipelineConfig = PipelineConfig(),
                    raw: standin.RawInputs | None = None, years: Sequence[DataFrame] | None = None) -> S.Star:
    """Dimensions, key resolution and facts over clean staging tables. ``years`` are tables with their years, where
    those come cheaper than from the staging tables."""
    dim_country = S.patch_regions(S.build_dim_country(stage["countries"]), cfg.region_overwrite, cfg.region_fill)
    dim_commodity = S.build_dim_commodity(stage["hs_chapters"])
    dim_time = R.dim_time_of(spark, *(years or (stage["trade_flows"], stage["mirror_flows"], stage["country_stats"])),
                             years=cfg.years, periods=cfg.periods, last=cfg.last_period)

    def fact(flows: DataFrame) -> DataFrame:
        keyed = S.key_order_columns(flows, cfg.dedup_keys)
        return S.resolve_keys(keyed, dim_country, dim_commodity)

    stats = S.load_country_stats(stage["country_stats"], dim_country, dim_time)
    staging = dict(stage)
    if raw is not None:
        staging.update({"raw_reporter": raw.reporter_flows, "raw_mirror": raw.mirror_flows,
                        "raw_countries": raw.country_mapping, "raw_indicators": raw.indicators,
                        "raw_chapters": raw.hs_chapters})
    return S.Star(dim_country=dim_country, dim_commodity=dim_commodity, dim_time=dim_time,
                  fact_trade=fact(stage["trade_flows"]), fact_mirror_trade=fact(stage["mirror_flows"]),
                  fact_country_stats=stats, staging=staging)


def build_star(spark: SparkSession, raw: standin.RawInputs, cfg: PipelineConfig = PipelineConfig()) -> S.Star:
    """Whole pipeline as lazy plans: raw inputs → clean staging → star."""
    stage = clean_stage(raw, cfg)
    return star_from_stage(spark, stage, cfg, raw, year_tables(raw, stage, cfg))


#: Plans per session, gone with the session object.
_STARS: WeakKeyDictionary[SparkSession, dict[str, S.Star]] = WeakKeyDictionary()


def standin_star(spark: SparkSession, sf_dir: str) -> S.Star:
    """Star over the stand-in inputs of ``sf_dir``, as lazy plans (analysed once per session)."""
    keep_methods_compiled(spark)
    stars, key = _STARS.setdefault(spark, {}), sf_dir.rstrip("/")
    if key not in stars:
        stars[key] = replace(build_star(spark, standin.load_raw_inputs(spark, sf_dir), STANDIN_CONFIG), source_dir=key)
    return stars[key]


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir`` (None when unset)."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


TAGGED_TABLES = ("tagged_reporter", "tagged_mirror")
STAGING_TABLES = ("trade_flows", "mirror_flows", "country_stats", "hs_chapters", "countries")


def load_warehouse(spark: SparkSession, raw: standin.RawInputs, path: str, cfg: PipelineConfig = PipelineConfig(),
                   num_partitions: int | None = None, times: dict[str, float] | None = None) -> S.Star:
    """Batch load into ``path`` (a shared folder): clean staging tables are written
    first, so key resolution, fact keys and the fact writes all start from
    Parquet instead of recomputing the cleaning; facts are partitioned by year. ``times``
    gets the seconds of every step."""
    def timed(step: str, write: Callable[[], None]) -> None:
        began = time.time()
        write()
        if times is not None:
            times[step] = round(time.time() - began, 3)

    # the raw flows are parsed and tagged once; the clean and its reports (C6, C8, C11, C13) read these tables
    sources = dict(zip(TAGGED_TABLES, (raw.reporter_flows, raw.mirror_flows)))
    for name, df in sources.items():
        timed(f"load/{name}", lambda df=df, name=name: C.tag_flows(df).write.mode("overwrite").parquet(f"{path}/staging/{name}"))
    tagged = {name: spark.read.parquet(f"{path}/staging/{name}") for name in sources}
    from_tags = replace(raw, reporter_flows=tagged["tagged_reporter"], mirror_flows=tagged["tagged_mirror"])
    for name, df in clean_stage(from_tags, cfg).items():
        timed(f"load/clean_{name}", lambda df=df, name=name: df.write.mode("overwrite").parquet(f"{path}/staging/{name}"))
    stage = {name: spark.read.parquet(f"{path}/staging/{name}") for name in STAGING_TABLES}
    star = star_from_stage(spark, stage, cfg, raw)
    for name, df in (("dim_country", star.dim_country), ("dim_commodity", star.dim_commodity),
                     ("dim_time", star.dim_time), ("fact_country_stats", star.fact_country_stats)):
        timed(f"load/{name}", lambda df=df, name=name: df.write.mode("overwrite").parquet(f"{path}/{name}"))
    # clustered by partner and chapter inside a year: a query of one partner skips the other row groups
    timed("load/fact_trade", lambda: write_clustered(S.with_fact_key(star.fact_trade, 0, num_partitions), f"{path}/fact_trade", num_partitions=num_partitions))
    fact = spark.read.schema(S.FACT_SCHEMA).parquet(f"{path}/fact_trade")
    timed("load/fact_mirror_trade", lambda: write_clustered(S.with_mirror_key(star.fact_mirror_trade, num_partitions), f"{path}/fact_mirror_trade",
                                                            num_partitions=num_partitions))
    # the cube is small: one file per year
    timed("load/trade_cube", lambda: trade_cube(fact).repartition("year")
          .write.mode("overwrite").partitionBy("year").parquet(f"{path}/trade_cube"))
    # mergeable summaries: quantile sketches of the clean flows, bitmaps of the cube's keys
    cube = spark.read.schema(CUBE_SCHEMA).parquet(f"{path}/trade_cube")
    summaries = {"value_sketches": SU.value_sketches(stage["trade_flows"]), **{n: SU.key_bitmaps(cube, key, by) for n, (key, by) in SU.BITMAPS.items()}}
    for name, df in summaries.items():
        timed(f"load/{name}", lambda df=df, name=name: df.write.mode("overwrite").parquet(f"{path}/{name}"))
    return read_star(spark, path, {k: v for k, v in star.staging.items() if k.startswith("raw_")})


def read_star(spark: SparkSession, path: str, raw: dict[str, DataFrame] | None = None) -> S.Star:
    """Star served from a loaded warehouse; ``raw`` adds the raw inputs for the
    cleaning reports (they are never materialized)."""
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    def fact(name: str) -> DataFrame:
        return spark.read.schema(S.FACT_SCHEMA).parquet(f"{path}/{name}")

    dims = {k: t(k) for k in ("dim_country", "dim_commodity", "dim_time")}
    staging = {name: t(f"staging/{name}") for name in (*STAGING_TABLES, *TAGGED_TABLES)}
    staging.update({name: t(name) for name in SU.SUMMARY_TABLES})
    staging.update(raw or {})
    return S.Star(dims["dim_country"], dims["dim_commodity"], dims["dim_time"], fact("fact_trade"),
                  fact("fact_mirror_trade"), t("fact_country_stats"), staging=staging)


def register_views(star: S.Star, prefix: str = "") -> list[str]:
    """Expose the warehouse tables as temp views (``fact_trade``, ``dim_country``, …)
    so SQL written against the star schema runs on Spark SQL."""
    names = []
    for name, df in star.tables().items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
