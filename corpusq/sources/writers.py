"""Writers; none replaces what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Line-delimited JSON, in one folder for each value of a column."""
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).json(path)


def examples(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").parquet(path)


def csv(rows: DataFrame, path: str, *order: str) -> None:
    """CSV with a header, sorted across files."""
    (rows.orderBy(*order) if order else rows).write.mode("errorifexists").option("header", True).csv(path)


def vector_pages(rows: DataFrame, path: str, page_size: int) -> None:
    """Vectors by page number, for reads that prune to the pages they need."""
    rows.withColumn("page", F.floor(F.col("id") / page_size)).repartition("page").write.mode("errorifexists").partitionBy("page").parquet(path)


def read_through(spark, path: str, make) -> DataFrame:
    """The table at a path, made and written on first use."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
