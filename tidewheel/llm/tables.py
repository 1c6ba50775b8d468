"""Durable intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.sizes import broadcast_if_small

__all__ = ["aside", "broadcast_if_small", "discard", "durable", "shared_folder", "whole_text"]

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame, *, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back, so that lost executors lose nothing. Returns its path too.

    What the write shuffled is deleted as soon as the table stands, so intermediate files don't pile up.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidewheel-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by ``durable`` that no result reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def aside(df: DataFrame, names: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of ``names`` out of the way of an operator's own, and what names them back afterwards."""
    moved = {c: f"{c}_{uuid.uuid4().hex}" for c in df.columns if c in names}
    return df.withColumnsRenamed(moved), lambda out: out.withColumnsRenamed({new: old for old, new in moved.items()})


def whole_text(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))
