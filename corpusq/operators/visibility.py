"""What may be seen from where: earlier rows of the same file and rows of its dependencies.

The file is an equi-join key with the position as a residual predicate, so these are
hash or sort-merge joins and never nested loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible(queries: DataFrame, items: DataFrame, dependencies: DataFrame, inclusive: bool = False) -> DataFrame:
    """Items before the query in its file, and all items of the files it depends on.

    queries: query, file, at; items: item, file, at; dependencies: file,
    depends_on.  Dependencies without items are skipped.
    """
    i = items.select("item", F.col("file").alias("item_file"), F.col("at").alias("item_at"))
    before = (F.col("item_at") <= F.col("at")) if inclusive else (F.col("item_at") < F.col("at"))
    own = queries.join(i, (F.col("file") == F.col("item_file")) & before)
    other = queries.join(dependencies, "file").join(i, F.col("depends_on") == F.col("item_file"))
    keep = ["query", "item"]
    return own.select(*keep, F.lit(True).alias("in_file")).unionByName(other.select(*keep, F.lit(False).alias("in_file")))


def dependencies(links: DataFrame) -> DataFrame:
    """Distinct other files of (file, pos, target), in order of first appearance."""
    first = links.where("file <> target").groupBy("file", "target").agg(F.min("pos").alias("pos"))
    return first.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("targets"))


def overlaps(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Half-open intervals [start, end) of one key that overlap."""
    y = b.select(*on, F.col("id").alias("other"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(y, on).where((F.col("start") < F.col("e2")) & (F.col("s2") < F.col("end"))).select(*on, "id", "other")


def nth_aligned(a: DataFrame, b: DataFrame, key: list[str], order_a: str, order_b: str) -> DataFrame:
    """The n-th row of a key on one side with the n-th on the other."""
    x = a.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(order_a)))
    y = b.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(order_b)))
    return x.join(y, [*key, "nth"])


def either_or(wanted: DataFrame, stored: DataFrame, key: str, value: str, computed) -> DataFrame:
    """A stored value where there is one, else one computed in place."""
    return wanted.join(stored.select(key, F.col(value).alias("_stored")), key, "left").withColumn(value, F.coalesce("_stored", computed)).drop("_stored")
