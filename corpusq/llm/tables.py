"""Tables written between steps, and connected components over them.

Intermediate tables are Parquet files in the folder that the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests on one machine) a
folder of this process is used.  A written table cuts the lineage, so a lost
executor costs the tasks that it ran and nothing before them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The run's own folder below spark.checkpoint.dir."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="corpusq-")
        _own[app] = f"{top.rstrip('/')}/corpusq-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete the run's tables when the driver ends in good order."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; the folder is the cluster's to clear
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """Connected components of an edge list, as (node, component) with the smallest node of each.

    Alternating large-star and small-star rounds.  A round exchanges the edges by
    node, takes each node's smallest neighbour by partial aggregation and rewires
    the edges to it; rounds end when the edges no longer change.  Nodes without
    edges don't appear; null ends and self loops are ignored; an empty list gives
    an empty result.
    """
    a, b = F.col(low).cast("long"), F.col(high).cast("long")
    edges = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                              F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        # every node below one smallest neighbour, and the edges as they were: stars
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
