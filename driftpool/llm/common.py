"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftpool.functions.staging import register, shared_dir

#: Bytes of Arrow data handed to Python at once; bounds a worker's memory when texts are long.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/driftpool-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    register(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened by ``_`` in front until ``df`` has no such column (in upper or lower case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def whole_text() -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col("text"), F.lit(""))


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and whole ``text`` only, so that no other column can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def in_order(docs: DataFrame, ascending: bool = True) -> DataFrame:
    """Texts sorted by ``doc_id`` over all partitions, ties by the text's hash; a repeated id may span partitions."""
    keys = [F.col("doc_id"), F.xxhash64("text")]
    keys = [k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys]
    return texts(docs).repartitionByRange(*keys).sortWithinPartitions(*keys)
