"""Lineage cuts and size-checked broadcasts through tables in the shared folder.

A staged table has a known file size, so Catalyst broadcasts it only when that
size is below ``spark.sql.autoBroadcastJoinThreshold``; nothing here forces a
broadcast. Staged tables survive the loss of an executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_local_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a private one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dir


def stage(df: DataFrame, name: str = "table", partition_by: Sequence[str] = (), guards: Mapping[str, Column] | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader on it.

    ``guards`` name what no row may be; ``rows`` is how many rows there must be. Both are counted by the job that writes,
    and looked at before the table is handed out: a violation deletes it and is an error.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/driftpool-{name}-{uuid.uuid4().hex}"
    watch = Observation() if guards or rows is not None else None
    if watch:
        counts = [F.count_if(F.coalesce(bad, F.lit(True))).alias(what) for what, bad in (guards or {}).items()]
        df = df.observe(watch, F.count("*").alias("number of rows"), *counts)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    register(path)
    if watch:
        found = watch.get
        wrong = {what: found[what] for what in guards or {} if found[what]}
        if rows is not None and found["number of rows"] != rows:
            wrong[f"number of rows is not {rows}"] = found["number of rows"]
        if wrong:
            _written.pop()
            _delete(spark, path)
            raise ValueError(f"{name}: {wrong}")
    return spark.read.schema(df.schema).parquet(path)


def register(path: str) -> None:
    """Let ``release`` delete a table that was written elsewhere."""
    _written.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> int:
    """Delete the tables this process staged; results that still read them must be done. Returns how many."""
    count = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return count
