"""Tables as Parquet files below one folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster (spark.checkpoint.dir); a temporary one only in local sessions without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file://" + tempfile.mkdtemp(prefix="spark-regtext-")
    return f"{base.rstrip('/')}/regtext-{uuid.uuid4().hex[:12]}-{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written in the shared folder and read back: what it was made from is read once, and losing an executor costs nothing."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """A column name that clashes with none of the given ones."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name
