"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "tablemill", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.scheduler.mode", "FAIR")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a machine-local
    folder would be lost with its machine, so the setting is required there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablemill-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_home(spark: SparkSession) -> str:
    """This application's part of the scratch folder."""
    return f"{scratch_root(spark)}/tablemill-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the scratch folder."""
    return f"{scratch_home(spark)}/{label}-{uuid.uuid4().hex}"


def release_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote there; call it when no result is still to be read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_home(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def one_row(spark: SparkSession, **values) -> DataFrame:
    """One row of constants or column expressions, made without a Python worker."""
    return spark.range(0, 1, 1, 1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts the lineage and pins values that must not be computed twice (partition numbers). The
    written table outlives any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
