"""A folder for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; where none is named (tests), a local one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows written to a new path and read again, which cuts their lineage."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
