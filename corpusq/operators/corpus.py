"""Corpora: key-value tables, duplicates, leak-free splits and reproducible samples.

Nothing is random: order and choice come from hashes, so every run and every
partitioning gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*parts: Column | str) -> Column:
    """A reproducible random order: the first digits of an MD5."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def first_per(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_report(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct ones, and how many would be dropped."""
    return rows.groupBy(*keys).agg(F.count("*").alias("c")).agg(
        F.sum("c").alias("rows"), F.count("*").alias("distinct_rows"), (F.sum("c") - F.count("*")).alias("dropped"))


def find(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The id of each wanted key, null if absent; null parts of keys match."""
    same = F.lit(True)
    for k in keys:
        same = same & wanted[k].eqNullSafe(stored[k])
    return wanted.join(stored, same, "left").select(*[wanted[k] for k in keys], stored["id"])


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and the new keys, numbered after the largest id in key order.

    Numbers within the new keys come from one window; they are the distinct absent
    keys only.
    """
    absent = new.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = absent.withColumn("nth", F.row_number().over(Window.orderBy(*keys))).crossJoin(F.broadcast(top))
    return stored.select("id", *keys).unionByName(numbered.select((F.col("top") + F.col("nth")).alias("id"), *keys))


def split_random(rows: DataFrame, key: str, train: float, val: float) -> DataFrame:
    """floor(train * n) rows in hash order, then floor(val * n), the rest test."""
    # 4096 intervals of the hash are counted; a row's place is what lies before its interval and its rank within it
    hashed = rows.withColumn("_h", hash_order(key)).withColumn("_c", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_c").agg(F.count("*").alias("_m"))
    ahead = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_c", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_s"), F.sum("_m").over(Window.partitionBy()).alias("n"))
    within = F.row_number().over(Window.partitionBy("_c").orderBy("_h", key))
    placed = hashed.withColumn("_r", within).join(F.broadcast(starts), "_c").withColumn("_i", F.col("_s") + F.col("_r")).drop("_h", "_c", "_s", "_r")
    a, b = F.floor(F.lit(train) * F.col("n")), F.floor(F.lit(train) * F.col("n")) + F.floor(F.lit(val) * F.col("n"))
    return placed.withColumn("split", F.when(F.col("_i") <= a, "train").when(F.col("_i") <= b, "val").otherwise("test")).drop("_i", "n")


def split_predefined(files: DataFrame, texts: DataFrame, test: Column, val: Column) -> DataFrame:
    """Test over validation over training; a lower file that shares a text with a higher one is dropped.

    files: file and the columns of the conditions; texts: (file, text).
    """
    of = files.withColumn("split", F.when(test, "test").when(val, "val").otherwise("train"))
    level = texts.join(of.select("file", F.when(F.col("split") == "test", 2).when(F.col("split") == "val", 1).otherwise(0).alias("level")), "file")

    def leaking(rows: DataFrame, above: DataFrame) -> DataFrame:
        return rows.join(above.select("text").distinct(), "text", "left_semi").select("file").distinct()

    top = level.where("level = 2")
    val_texts = level.where("level = 1")
    val_bad = leaking(val_texts, top)
    val_good = val_texts.join(val_bad, "file", "left_anti")
    train_bad = leaking(level.where("level = 0"), top.unionByName(val_good))
    return of.join(val_bad.unionByName(train_bad), "file", "left_anti").select("file", "split")


def sample_per_group(rows: DataFrame, group: str, order: Column, quota: int) -> DataFrame:
    """Up to quota rows of each group in an order."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")


def negatives(candidates: DataFrame, query: str, inside: str, total: int, in_file: int) -> DataFrame:
    """Fixed numbers of negatives inside and outside the file; a short class passes its rest to the other; none if both are short."""
    n_in = F.sum(F.col(inside).cast("int")).over(Window.partitionBy(query))
    n_all = F.count("*").over(Window.partitionBy(query))
    rows = candidates.withColumn("_in", n_in).withColumn("_all", n_all).where(F.col("_all") >= total)
    take_in = F.greatest(F.least(F.col("_in"), F.lit(in_file)), F.lit(total) - (F.col("_all") - F.col("_in")))
    nth = F.row_number().over(Window.partitionBy(query, inside).orderBy(hash_order(query, "doc"), "doc"))
    picked = rows.withColumn("_take", F.when(F.col(inside), take_in).otherwise(F.lit(total) - take_in)).withColumn("_n", nth)
    return picked.where(F.col("_n") <= F.col("_take")).drop("_in", "_all", "_take", "_n")


def fifo(events: DataFrame, queue: str, order: list[str], put: Column, get: Column) -> DataFrame:
    """Which item each `get` of a queue takes: the first not taken yet, null if the queue is empty then.

    The length of a queue is what came in less what was asked for, raised by the
    lowest point that this balance has had below zero; so gets that succeed, and
    their numbers, follow from running sums, and no worker waits for a lock.
    """
    w = Window.partitionBy(queue).orderBy(*order)
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_put", put.cast("int")).withColumn("_get", get.cast("int")).withColumn("_b", F.sum(F.col("_put") - F.col("_get")).over(so_far))
    low = F.least(F.lit(0), F.coalesce(F.min("_b").over(before), F.lit(0)))
    rows = rows.withColumn("_ok", (F.col("_get") == 1) & (F.coalesce(F.lag("_b").over(w), F.lit(0)) - low > 0))
    rows = rows.withColumn("_n", F.when(F.col("_ok"), F.sum(F.col("_ok").cast("int")).over(so_far)))
    item = rows.withColumn("_k", F.sum("_put").over(so_far)).where("_put = 1").select(queue, F.col("_k").alias("_n"), F.struct(*order).alias("item"))
    return rows.where("_get = 1").join(item, [queue, "_n"], "left").drop("_put", "_get", "_b", "_ok", "_n")


def resumed(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is expected and not yet there."""
    return expected.join(done.select(key), key, "left_anti")


def merged(sources: list[DataFrame], key: str) -> DataFrame:
    """Key-value tables merged, later ones over earlier ones."""
    rows = None
    for i, source in enumerate(sources):
        part = source.withColumn("_p", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return first_per(rows, [key], F.desc("_p")).drop("_p")


def inverted(rows: DataFrame, key: Column, value: str, cap: int | None = None) -> DataFrame:
    """{key: sorted distinct values}, of the array of keys of each row."""
    names = F.array_sort(F.collect_set(value))
    return rows.select(F.explode(key).alias("key"), value).groupBy("key").agg((F.slice(names, 1, cap) if cap else names).alias("values"))


def type_filter(rows: DataFrame, kind: str, path: str, general: list[str], stdlib: list[str], other: list[str], mark: str) -> DataFrame:
    """Without the general types and those excluded for rows inside or outside the standard library."""
    std = F.instr(F.col(path), mark) > 0
    return rows.where(~F.col(kind).isin(general)).where(F.when(std, ~F.col(kind).isin(stdlib)).otherwise(~F.col(kind).isin(other)))
