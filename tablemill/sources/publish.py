"""Folders that appear whole, and under one name only once."""

from __future__ import annotations

import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame

_TURN = threading.Lock()


def publish(df: DataFrame, folder: str) -> bool:
    """Write ``df`` as the Parquet folder ``folder``; False, with nothing written, where that exists.

    The rows are written under a hidden name and the folder is renamed, so readers see all of it or
    nothing, and of several writers one wins. The file system must rename atomically and refuse
    an existing target, as HDFS does. On a local one check and rename are two steps, so writers of one
    process take turns.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parent, name = folder.rstrip("/").rsplit("/", 1)
    hidden = f"{parent}/_new-{uuid.uuid4().hex}"
    source, target = jvm.org.apache.hadoop.fs.Path(hidden), jvm.org.apache.hadoop.fs.Path(f"{parent}/{name}")
    df.write.parquet(hidden)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        source.getFileSystem(conf).makeQualified(source).toUri(), conf
    )
    no_options = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0
    )
    with _TURN:
        try:
            files.rename(source, target, no_options)
            return True
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
    files.delete(source, True)
    return False
