"""Local SparkSession for tests and the bench (a cluster passes its own session)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a method beyond which the JVM interprets it instead of compiling it.
COMPILED_METHOD = "8000"
_LIMIT, _SPARK_DEFAULT = "spark.sql.codegen.hugeMethodLimit", "65535"


def keep_methods_compiled(spark: SparkSession) -> None:
    """Where the session has Spark's default, operators whose fused code the JVM would only interpret run one by
    one (the parse of the flows is such code); a limit that was set stays. No result depends on it."""
    if spark.conf.get(_LIMIT, _SPARK_DEFAULT) == _SPARK_DEFAULT:
        spark.conf.set(_LIMIT, COMPILED_METHOD)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tradeweave") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # generated methods beyond this are not compiled by the JVM but interpreted; Spark then runs the operators one by one
        .config(_LIMIT, COMPILED_METHOD)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster's ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a scratch folder; on a cluster that is
    an error, because other executors could not read what one of them wrote.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tradeweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
        spark.sparkContext.setCheckpointDir(current)
    return current


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
