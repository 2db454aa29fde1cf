"""Helpers shared by the operators: tables, staging in the shared folder, worker settings."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeweave.session import ensure_checkpoint_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def python_ready(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Let Python workers import this package, and keep Arrow batches of long texts small.

    A cluster that ships the package itself (``--py-files``) is not affected; the
    batch size is only lowered from Spark's default, never from a user's setting.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(batch_rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` (a scratch folder only where it is unset)."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def fresh_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or with underscores in front until no column has that name (case-insensitive)."""
    have = {c.lower() for c in columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
