"""Sharding by histogram sort, in DataFrame operations only.

A row's key is the hash of its text (k1, 63 bits) and, within equal texts, the hash
of its id and text (k2, 63 bits).  Equal texts are therefore neighbours, and a text
with very many copies still has keys to cut between.  Bytes below candidate
boundaries are counted exactly over all partitions, level by level, until each
splitter is within the tolerance; then rows are exchanged once, by key interval.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.tables import read_table, text_or_empty, written

KEY_BITS, TOP_BITS, STEP_BITS = 63, 15, 12
#: Part of a shard's even share by which a splitter may be off.
TOLERANCE = 0.01
#: Rows that one key interval (a sort within one task) should not exceed; more where the whole table
#: has over CELL_ROWS * MOST_CELLS rows, which bounds the number of intervals that are cut.
CELL_ROWS, MOST_CELLS = 4096, 1 << 17


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text has no bytes), text_crc32 (null text as empty), k1 and k2."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty()).cast("long").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text_or_empty()), 1).alias("k1"),
        F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id"), text_or_empty()), 1).alias("k2"),
    )


def _digit(level: int) -> Column:
    """The first bits of a key: `level` bits of k1, or all of k1 and the bits beyond 63 of k2 (k1 is then fixed)."""
    return F.shiftright("k1", KEY_BITS - level) if level <= KEY_BITS else F.shiftright("k2", 2 * KEY_BITS - level)


def _levels() -> list[int]:
    """Numbers of key bits that the levels count by; one of them ends with k1."""
    first = [*range(TOP_BITS, KEY_BITS, STEP_BITS), KEY_BITS]
    return first + [*range(KEY_BITS + STEP_BITS, 2 * KEY_BITS, STEP_BITS), 2 * KEY_BITS]


def splitters(keyed: DataFrame, top: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The shards - 1 smallest keys (k1, k2) of the shards 1, 2, ...

    The driver holds one histogram of 2**15 intervals, then 2**12 for each
    splitter that is still open, whatever the number of rows.
    """
    levels = _levels()
    cells = sorted((r["digit"], r["size"]) for r in top.select("digit", "size").collect())
    total = sum(s for _, s in cells)
    if not total:
        return []
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    # a splitter's open interval: the k1 it lies in, once known, its cells, and the bytes below them
    open_at: dict[int, tuple[int | None, list, int]] = {s: (None, cells, 0) for s in range(1, shards)}
    for at, level in enumerate(levels):
        again: dict[int, tuple[int | None, int, int]] = {}
        for s, (k1, inside, below) in open_at.items():
            goal = total * s / shards
            edges, bytes_below = [], []
            for digit, size in inside:
                edges.append(digit)
                bytes_below.append(below)
                below += size
            edges.append(inside[-1][0] + 1)
            bytes_below.append(below)
            i = min(max(bisect.bisect_right(bytes_below, goal) - 1, 0), len(inside) - 1)
            near = min((i, i + 1), key=lambda j: abs(bytes_below[j] - goal))
            if abs(bytes_below[near] - goal) <= slack or level == levels[-1]:
                found[s] = (edges[near] << (KEY_BITS - level), 0) if level <= KEY_BITS else (k1, edges[near] << (2 * KEY_BITS - level))
            else:
                again[s] = (edges[i] if level == KEY_BITS else k1, edges[i], bytes_below[i])
        if not again:
            break
        finer = levels[at + 1]
        if level < KEY_BITS:
            chosen, wanted = F.shiftright("k1", KEY_BITS - level), {d for _, d, _ in again.values()}
            rows = keyed.where(chosen.isin(sorted(wanted))).select(F.lit(0).cast("long").alias("of"), _digit(finer).alias("digit"), "size")
        else:
            here = F.lit(False)
            for k1, d in sorted({(k1, d) for k1, d, _ in again.values()}):
                here = here | ((F.col("k1") == k1) & (F.lit(level == KEY_BITS) | (_digit(level) == d)))
            rows = keyed.where(here).select(F.col("k1").alias("of"), _digit(finer).alias("digit"), "size")
        counted = sorted((r["of"], r["digit"], r["size"]) for r in rows.groupBy("of", "digit").agg(F.sum("size").alias("size")).collect())
        step = finer - max(level, KEY_BITS) if level >= KEY_BITS else finer - level
        open_at = {}
        for s, (k1, d, below) in again.items():
            of = 0 if level < KEY_BITS else k1
            open_at[s] = (k1, [(c, z) for o, c, z in counted if o == of and (level == KEY_BITS or c >> step == d)], below)
    return [found[s] for s in range(1, shards)]


def _cells(keyed: DataFrame, top: DataFrame) -> DataFrame:
    """keyed with its key interval (c1, c2): bits of k1, more of them and then of k2 where more rows share them.

    Both lists of intervals to cut are broadcast; each has MOST_CELLS rows at most.
    """
    most = F.greatest(F.lit(CELL_ROWS), F.call_function("div", F.sum("n").over(Window.partitionBy()), F.lit(MOST_CELLS)))
    rows = top.withColumn("most", most)
    more = F.least(F.lit(KEY_BITS - TOP_BITS), F.ceil(F.log2(F.col("n") / F.col("most"))).cast("int") + 1)
    heavy = written(rows.where("n > most").select("digit", more.alias("bits"), "most"), "heavy")
    finer = keyed.withColumn("digit", F.shiftright("k1", KEY_BITS - TOP_BITS)).join(F.broadcast(heavy), "digit", "left").withColumn(
        "drop", F.lit(KEY_BITS - TOP_BITS) - F.coalesce("bits", F.lit(0))).withColumn(
        "c1", F.call_function("shiftleft", F.call_function("shiftright", F.col("k1"), F.col("drop")), F.col("drop")))
    hot = finer.where("bits IS NOT NULL").groupBy("c1").agg(F.count("*").alias("n"), F.first("most").alias("most"), F.min("k1").alias("low"), F.max("k1").alias("high"))
    # an interval of one text is cut by k2
    copies = written(hot.where("n > most AND low = high").select(
        F.col("low").alias("k1"), F.least(F.lit(KEY_BITS), F.ceil(F.log2(F.col("n") / F.col("most"))).cast("int") + 1).alias("id_bits")), "copies")
    rest = F.lit(KEY_BITS) - F.col("id_bits")
    return finer.drop("digit", "bits", "most", "drop").join(F.broadcast(copies), "k1", "left").withColumn(
        "c2", F.coalesce(F.call_function("shiftleft", F.call_function("shiftright", F.col("k2"), rest), rest), F.lit(0))).drop("id_bits")


def shard(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Deal all documents into shards of near equal bytes, in key order.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard
    (null under this law).  slot counts from 0 without gaps within a shard and
    follows the key; equal texts stand together, and share a shard unless a cut
    within them is needed to meet the tolerance.

    Nulls and edge cases: a null text has size 1 and the checksum of no bytes; a
    null doc_id is hashed like any other value; repeated rows each get a slot;
    very long texts are read for their size and hashes only; an empty table gives
    an empty result; other columns are ignored.
    """
    keyed = written(sized(docs), "keyed")
    shift = KEY_BITS - TOP_BITS
    top = written(keyed.groupBy(F.shiftright("k1", shift).alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("n")), "histogram")
    number = F.lit(0)
    for k1, k2 in splitters(keyed, top, shards, tolerance):
        number = number + ((F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))).cast("int")
    placed = written(_cells(keyed, top).withColumn("shard", number), "placed")
    counted = placed.groupBy("shard", "c1", "c2").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("c1", "c2").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        F.col("shard").alias("s"), F.col("c1").alias("x"), F.col("c2").alias("y"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard", "c1", "c2").orderBy("k1", "k2", "doc_id", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(starts, (F.col("shard") == F.col("s")) & (F.col("c1") == F.col("x")) & (F.col("c2") == F.col("y")))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                (F.col("ahead") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    return shard(read_table(spark, sf_dir, "documents"), 8)
