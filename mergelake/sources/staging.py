"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, a local session gets a temporary folder, and a cluster is
    refused, as its machines don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return (folder or tempfile.mkdtemp(prefix="mergelake-")).rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staging(spark: SparkSession) -> Callable[[str, DataFrame], DataFrame]:
    """A function that writes a named frame once to the shared folder and rereads it: cuts its plan, and survives lost executors."""
    folder = shared_folder(spark)

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(path := f"{folder}/{name}-{uuid.uuid4().hex}")
        return spark.read.schema(df.schema).parquet(path)

    return stage
