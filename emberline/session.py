"""Session helpers: test session, shared folder, cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("emberline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or one inside the warehouse where that is unset."""
    key = "spark.checkpoint.dir"
    named = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it from there: cut lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.held_path = path
    return held


def let_go(*held: DataFrame) -> None:
    """Empty tables of :func:`hold` that nothing reads any more: what was made of them must be written itself."""
    for df in held:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(df.held_path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
