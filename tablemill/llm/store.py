"""Intermediate tables in the shared folder, and what several operators do with rows."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import time

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.session import scratch_path

ROW = "_op_row"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Workspace:
    """Tables that one run of an operator writes to the shared folder (``spark.checkpoint.dir``).

    A session that leaves the rows of an Arrow batch at their default gets batches of a thousand from here on.
    Each is written whole before it is read, so a lost executor costs a task, not the lineage, and
    can be dropped as soon as later tables no longer need it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.home = scratch_path(spark, label)
        # rows hold texts: a batch of the default number of them would take tens of megabytes, several times over
        if spark.conf.get(BATCH) == "10000":
            spark.conf.set(BATCH, "1000")
        self.made = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.home}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def folder(self, path: str) -> None:
        """Make a folder for files that tasks write."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables nothing will read again."""
        for table in tables:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(table._workspace_path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        tidy(self.spark)

    def release(self) -> None:
        """Delete all tables; nothing that is still to run may read them."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.home)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        tidy(self.spark)


def tidy(spark: SparkSession) -> None:
    """Shuffle files go when the driver's objects for them are collected; do not wait for chance.

    The events of the last job still name its plan for a moment after it ends.
    """
    gc.collect()
    time.sleep(0.7)
    spark.sparkContext._jvm.System.gc()


_kept: dict[tuple, object] = {}  # of one Python worker, which Spark uses again for other operators' tasks


def kept(owner: str, make, *key):
    """``make(*key)``, kept between the tasks of a worker until a task of another operator begins there."""
    alone(owner)
    if (owner, make, key) not in _kept:
        _kept[owner, make, key] = make(*key)
    return _kept[owner, make, key]


def alone(owner: str) -> None:
    """Let go of what other operators keep in this worker."""
    others = [k for k in _kept if k[0] != owner]
    for key in others:
        del _kept[key]
    if others:
        give_back()


def give_back() -> None:
    """Free memory goes back to the system; the allocators would hold it for the worker's life."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def lean(owner: str, run):
    """A function of batches, ``run``, whose tasks begin and end without memory that they do not need."""

    @functools.wraps(run)
    def go(batches):
        alone(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def numbered(docs: DataFrame, work: Workspace) -> DataFrame:
    """``docs`` behind a row number that is the same on every read, however many cores read it.

    A table of Parquet files is numbered by file and place in the file, which do not depend on how Spark
    splits it, and is not written again; the one thing that is broadcast has a row per file. Any other
    frame is written to ``work`` first. The number of a row is below 2**63 for 2**24 files of 2**39 rows.
    """
    if not _of_files(docs):
        docs = work.write(docs)
    spark, place = docs.sparkSession, "_op_file"
    files = sorted(re.sub("^file:///", "file:/", f) for f in docs.inputFiles())  # as the metadata column has it
    kinds = f"{place} string, _op_at long"
    listed = spark.createDataFrame(pd.DataFrame({place: files, "_op_at": range(len(files))}), kinds) if files else spark.createDataFrame([], kinds)
    own = docs.select("*", F.col("_metadata.file_path").alias(place), F.col("_metadata.row_index").alias("_op_index"))
    lost = F.raise_error(F.lit("a row of a file that is not listed")).cast("long")
    number = (F.coalesce("_op_at", lost) * (1 << 39) + F.col("_op_index")).alias(ROW)
    return own.join(F.broadcast(listed), place, "left").select(number, *[F.col(f"`{c}`") for c in docs.columns])


def _of_files(docs: DataFrame) -> bool:
    """Whether each row is one row of a Parquet file, chosen and projected at most."""
    try:
        docs.select("_metadata.row_index").schema
    except AnalysisException:
        return False
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1:
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().head()
    return plan.children().isEmpty()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
