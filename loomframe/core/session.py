"""Session creation, the shared scratch folder and written intermediates."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

def build_session(cpus: int | str = "*", app: str = "loomframe", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    atexit.register(delete_scratch, spark)
    return spark


def delete_scratch(spark: SparkSession) -> None:
    """Delete what a session of ``build_session`` has written to the shared folder."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomframe/{spark.sparkContext.applicationId}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A session that names none uses a folder beside its warehouse, which all
    executors share too.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomframe/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, freezes the row layout and
    gives Catalyst the true size, so that a join against the result is
    broadcast only when the files are under ``autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition input that comes in fewer pieces than there are cores.

    A table of few, large row groups would leave costly expressions to a few
    tasks. An input with enough pieces is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
