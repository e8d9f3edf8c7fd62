"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: the first scatters a text's shingles
over a ring of 2**20 places; the second numbers the places, and coordinate k is
the smallest number met when the ring is shifted by k.  Runs of coordinates form
bands; texts that share a band are candidates, and links are confirmed on the
full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.shingles import U, distinct, mix, shingle_runs
from corpusq.llm.tables import components, written

RING_BITS = 20
BANDS, ROWS = 36, 5  # a pair at 0.8 shares no band with probability (1 - 0.8**5)**36 = 6e-7
SEED = 20240611
#: Shingles of one block in the exact comparison of a bucket's remaining members.
BLOCK_SHINGLES = 1_000_000
#: Documents of one such block.
BLOCK_DOCS = 1024
#: Candidate ids are broadcast up to this number (8 bytes each), else joined by exchange.
BROADCAST_IDS = 1_000_000
#: What tells classes, the sets of shingles that are equal, apart.
CLASS = ["n_shingles", "print1", "print2"]


def ring(coordinates: int, seed: int = SEED) -> np.ndarray:
    """Row p holds the numbers of the places p, p+1, ... in the second permutation."""
    numbers = np.random.default_rng(seed).permutation(1 << RING_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([numbers, numbers[: coordinates - 1]]), coordinates)


def places(hashes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The first permutation: a shingle's place on the ring."""
    return (mix(hashes ^ U(seed)) >> U(64 - RING_BITS)).astype(np.int64)


def signature(hashes: np.ndarray, shifted: np.ndarray, seed: int = SEED) -> np.ndarray:
    at = places(hashes, seed)
    best = shifted[at[:512]].min(axis=0)
    for i in range(512, len(at), 512):
        np.minimum(best, shifted[at[i : i + 512]].min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of a signature, different in each band."""
    cells = sig.astype(U).reshape(-1, rows)
    key = np.arange(1, len(cells) + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for i in range(rows):
        key = mix(key ^ cells[:, i]) * U(0x2545F4914F6CDD1D)
    return key.view(np.int64)


def prints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of hashes; with the size of a set they stand for it."""
    return mix(hashes ^ U(0x1234567)).sum(), mix(hashes + U(0x9E3779B97F4A7C15)).sum()


def _signed(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    shifted = ring(bands * rows)
    for batch in batches:
        n = batch.num_rows
        size = np.zeros(n, np.int64)
        sums = np.zeros((2, n), U)
        keys: list[np.ndarray] = []
        for row, run in shingle_runs(batch.column("text"), k):
            s = distinct(run)
            size[row] = len(s)
            if len(s):
                sums[:, row] = prints(s)
                keys.append(band_keys(signature(s, shifted), rows))
        ends = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(size), pa.array(sums[0].view(np.int64)),
             pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "text_hash", "n_shingles", "print1", "print2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        found = [distinct(run) for _, run in shingle_runs(batch.column("text"), k)]
        size = np.array([len(s) for s in found], np.int64)
        sums = np.array([prints(s) for s in found], U).reshape(n, 2).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        flat = np.concatenate(found).view(np.int64) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(size), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=[*CLASS, "shingles"])


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between members of two blocks of one bucket (or of one block) that have other labels.

    A pair is compared in the first band that it shares only.  Of the links
    found, those that join two labels not joined before in this task are kept.
    """
    out: tuple[list[int], list[int]] = ([], [])
    table = table.combine_chunks()
    label, size, side = (table[c].to_numpy() for c in ("label", "n_shingles", "side"))
    keys = np.stack(table["bands"].to_numpy(zero_copy_only=False))
    band = int(np.flatnonzero((keys == table["key"][0].as_py()).all(axis=0))[0])
    lists = table["shingles"].combine_chunks()
    flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(int(flat.max()) + 1 if len(flat) else 1, dtype=np.int32)
    one = not side.any()
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    if len(right):
        cells = np.concatenate([flat[ends[j] : ends[j + 1]] for j in right])
        cut = np.concatenate([[0], np.cumsum(size[right])[:-1]])
    parent = {int(x): int(x) for x in label}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at, i in enumerate(left):
        ok = (label[right] != label[i]) & (percent * np.maximum(size[right], size[i]) <= 100 * np.minimum(size[right], size[i]))
        if one:
            ok[: at + 1] = False
        if ok.any() and band:
            ok &= (keys[right, :band] != keys[i, :band]).all(axis=1)
        if not ok.any():
            continue
        own = flat[ends[i] : ends[i + 1]]
        marked[own] = 1
        common = np.add.reduceat(marked[cells], cut)
        marked[own] = 0
        ok &= 100 * common >= percent * (size[right] + size[i] - common)
        for j in right[ok]:
            x, y = top(int(label[i])), top(int(label[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out[0].append(int(label[i]))
                out[1].append(int(label[j]))
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of documents whose sets of k-word shingles have a Jaccard similarity of percent / 100 or more.

    Returns doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the row's
    text) and component (a number for each component, null where there is no doc_id
    or no shingle), one row for each row of docs (doc_id and text are read, other
    columns ignored).  Equal sets are one class; classes are linked by shared bands
    and full sets, components by those links, and a component's component_id is the
    smallest doc_id in it.

    Nulls and edge cases: null, empty or blank text has no shingles and is linked
    with nothing; a text with fewer than k words is one shingle; a row without
    doc_id is not compared (component_id null, kept true); repeated rows share
    their component; rows of one doc_id with other texts are compared each by its
    own text; an empty table gives an empty result.
    """
    def sign(batches):
        return _signed(batches, k, bands, rows)

    def collect(batches):
        return _sets(batches, k)

    def compare(table):
        return _block_links(table, percent)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        sign, "doc_id long, text_hash long, n_shingles long, print1 long, print2 long, bands array<long>"), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # numbered as they are written, so a class keeps its number
    classes = written(
        full.groupBy(*CLASS).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
        .withColumn("class", F.monotonically_increasing_id()), "classes")
    banded = classes.select("class", "n_shingles", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(
        F.min("class").alias("pivot"), F.max("class").alias("other"), F.count("*").alias("n"), F.sum("n_shingles").alias("total")
    ).where("pivot != other").drop("other")
    members = written(banded.join(shared, "key"), "members")
    met = written(classes.join(members.select("class").distinct(), "class", "left_semi").select("class", "rep", *CLASS), "met")
    ids = met.select(F.col("rep").alias("doc_id")).distinct()
    few = met.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    schema = "n_shingles long, print1 long, print2 long, shingles array<long>"
    sets = written(
        chosen.mapInArrow(collect, schema).dropDuplicates(CLASS).join(met.drop("rep"), CLASS).select("class", "shingles"), "sets")

    pairs = members.where("class != pivot").select("class", "pivot").distinct()
    one = sets.select("class", F.col("shingles").alias("s1"))
    two = sets.select(F.col("class").alias("pivot"), F.col("shingles").alias("s2"))
    small, large = F.least(F.size("s1"), F.size("s2")), F.greatest(F.size("s1"), F.size("s2"))
    common = F.when(100 * small >= percent * large, F.size(F.array_intersect("s1", "s2"))).otherwise(0)
    linked = (
        pairs.join(one, "class").join(two, "pivot")
        .select(F.col("class").alias("a"), F.col("pivot").alias("b"), common.alias("c"), (small + large).alias("t"))
        .where(100 * F.col("c") >= percent * (F.col("t") - F.col("c"))).select("a", "b")
    )
    first = components(linked)

    label = F.coalesce("component", "class")
    labelled = members.join(first, F.col("node") == F.col("class"), "left").withColumn("label", label).drop("node", "component")
    torn = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_DOCS)).cast("int")
    open_members = written(labelled.join(torn, "key", "left_semi").withColumn("blocks", blocks), "open")
    place = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    spread = (
        open_members.withColumn("place", place)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "class", "label", "n_shingles", F.least("place", "o").alias("i"), F.greatest("place", "o").alias("j"),
                (F.col("place") > F.col("o")).cast("int").alias("side"))
    )
    more = written(
        spread.join(classes.select("class", "bands"), "class").join(sets, "class")
        .groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "links")
    second = components(more)
    merged = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("final")), "component", "left").select(
        "node", F.coalesce("final", "component").alias("component"))
    alone = second.join(first.select("node"), "node", "left_anti")
    reached = written(merged.unionByName(alone), "reached")
    lowest = reached.join(classes.select(F.col("class").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("lowest"))

    of_class = classes.join(reached.join(lowest, "component"), F.col("class") == F.col("node"), "left").select(
        *CLASS, F.coalesce("component", "class").alias("component"), F.coalesce("lowest", "rep").alias("lowest"))
    smallest = F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id"))
    return (
        signed.drop("bands").join(of_class, CLASS, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), smallest).alias("component_id"), "text_hash",
                F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op1_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of documents: sets of 2-word shingles, 80 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80).drop("text_hash", "component")
