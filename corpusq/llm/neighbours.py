"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table's hash of a vector is the cell of M Gaussian projections on a grid of
width W.  A query visits cells in falling order of the estimated chance that a
near neighbour lies there (the product over projections of the normal mass of the
cell, for a difference of the fitted neighbour distance), until the chances sum to
the wanted part.  Members of visited cells are ranked by exact distance within the
cell, in blocks, and the tables' lists are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.shingles import U, mix
from corpusq.llm.tables import read_table, written
from corpusq.llm.vectors import lengths, matrix, usable

TABLES = 3
#: Part of the neighbours that the visited cells of one table hold, as estimated: 1 - (1 - 0.65)**3 = 0.957 in all.
MASS = 0.65
#: The grid's width in fitted neighbour distances.
WIDTH = 2.0
#: Rows that a cell should hold; more rows get more projections.
CELL_ROWS = 200
#: The neighbour distance is fitted on so many rows at most, the smallest by hash of vec_id.
SAMPLE = 2000
#: Members and queries of a cell that meet in one task; more of either are split.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
SEED = 5


def fit(rows: DataFrame, k: int) -> tuple[float, int]:
    """Neighbour distance (median distance to the k-th neighbour within the sample) and projections per table."""
    n = rows.count()
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r[0]), []).append(r[0])
    x = np.array(max(by_length.values(), key=len, default=[[0.0]]), dtype=float)
    square = (x * x).sum(axis=1)
    gap = np.maximum(square[:, None] + square - 2 * x @ x.T, 0)
    np.fill_diagonal(gap, np.inf)
    distance = float(np.sqrt(np.median(np.sort(gap, axis=1)[:, min(k, len(x)) - 1]))) if len(x) > 1 else 1.0
    return (distance if np.isfinite(distance) and distance > 0 else 1.0), int(np.clip(round(np.log(max(n, 2) / CELL_ROWS) / np.log(2.5)), 2, 24))


def projections(dims: int, m: int, width: float, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, table, dims])
    return rng.standard_normal((dims, m)), rng.uniform(0, width, m)


def cell_key(cells: np.ndarray, table: int, dims: int) -> np.ndarray:
    key = np.full(len(cells), U((table + 1) * 0x9E3779B97F4A7C15 % 2**64) ^ U(dims))
    for i in range(cells.shape[1]):
        key = mix(key ^ cells[:, i].astype(np.int64).view(U)) * U(0x2545F4914F6CDD1D)
    return key.view(np.int64)


def probes(x: np.ndarray, width: float, distance: float, mass: float) -> np.ndarray:
    """The cells to visit for one query's projections, in falling order of estimated success."""
    slot = np.floor(x / width).astype(np.int64)
    choices: list[list[tuple[float, int]]] = []
    for xi, s in zip(x.tolist(), slot.tolist(), strict=True):
        ranked = []
        for d in range(-3, 4):
            low, high = ((s + d) * width - xi) / distance, ((s + d + 1) * width - xi) / distance
            ranked.append(((erf(high / sqrt(2)) - erf(low / sqrt(2))) / 2, d))
        ranked.sort(reverse=True)
        choices.append([c for c in ranked if c[0] > 1e-9])
    # best-first over rank vectors; each vector has one parent: its last raised place lowered
    start = (0,) * len(choices)
    chance = float(np.prod([c[0][0] for c in choices]))
    heap, out, got = [(-chance, start, 0)], [], 0.0
    while heap and got < mass:
        p, ranks, last = heapq.heappop(heap)
        got -= p
        out.append([s + c[r][1] for s, c, r in zip(slot.tolist(), choices, ranks, strict=True)])
        for i in range(last, len(choices)):
            r = ranks[i] + 1
            if r < len(choices[i]):
                heapq.heappush(heap, (p * choices[i][r][0] / choices[i][r - 1][0], ranks[:i] + (r,) + ranks[i + 1 :], i))
    return np.array(out, dtype=np.int64)


def _hashed(batches: Iterator[pa.RecordBatch], m: int, width: float, tables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = lengths(batch.column("embedding"))
        for dims in np.unique(size):
            rows = batch.filter(pa.array(size == dims))
            x = matrix(rows.column("embedding"))
            for t in range(tables):
                a, b = projections(int(dims), m, width, t)
                key = cell_key(np.floor((x @ a + b) / width), t, int(dims))
                yield pa.RecordBatch.from_arrays([pa.array(key), *rows.columns], names=["key", *rows.schema.names])


def _probed(batches: Iterator[pa.RecordBatch], m: int, width: float, distance: float, tables: int, mass: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = lengths(batch.column("embedding"))
        for dims in np.unique(size):
            rows = batch.filter(pa.array(size == dims))
            x = matrix(rows.column("embedding"))
            for t in range(tables):
                a, b = projections(int(dims), m, width, t)
                found = [cell_key(probes(v, width, distance, mass), t, int(dims)) for v in x @ a + b]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                taken = rows.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *taken.columns], names=["key", *taken.schema.names])


_FOUND = "query_id long, vec_id long, score double"


def _nearest(queries: pa.Table, members: pa.Table, k: int) -> pa.Table:
    """Each query's k nearest members of a block, by exact distance, ties to smaller ids."""
    out: list[tuple[int, int, float]] = []
    if queries.num_rows and members.num_rows:
        x = matrix(members["embedding"])
        ids = members["ids"].to_pylist()
        square = (x * x).sum(axis=1)
        q = matrix(queries["embedding"])
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            near = square - 2 * (part @ x.T) + (part * part).sum(axis=1)[:, None]
            for query, v, d in zip(queries["vec_id"][at : at + 256].to_pylist(), part, near, strict=True):
                # a class may be the query's own only, so one more than k
                bound = np.partition(d, k)[k] if len(d) > k else np.inf
                best = np.flatnonzero(d <= bound + 1e-9 * (1 + abs(bound)))
                exact = np.sqrt(((x[best] - v) ** 2).sum(axis=1))
                found = sorted((s, i) for s, b in zip(exact.tolist(), best.tolist(), strict=True) for i in ids[b] if i != query)
                out += [(query, i, s) for s, i in found[:k]]
    columns = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, tables: int = TABLES, mass: float = MASS) -> DataFrame:
    """The k nearest found of every query (rows whose vec_id is divisible by `every`) among all other rows.

    Returns query_id, rank (from 1), vec_id and score (Euclidean distance in
    double precision).  Equal vectors are indexed once, with their k + 1 smallest
    ids, which is all that a list of k can need.  A query whose cells hold fewer
    than k others is compared with all rows, in blocks.

    Nulls and edge cases: rows that `vectors.usable` leaves out are neither
    queries nor candidates; vectors of different lengths are never compared;
    repeated rows of one vec_id are one candidate, with the smallest components;
    empty tables give an empty result; columns other than vec_id and embedding are ignored.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    classes = written(_classes(rows, k), "vectors")
    queries = written(rows.where(F.col("vec_id") % every == 0), "queries")
    distance, m = fit(classes.select(F.col("ids")[0].alias("vec_id"), "embedding"), k)
    width = WIDTH * distance

    def hashed(batches):
        return _hashed(batches, m, width, tables)

    def probed(batches):
        return _probed(batches, m, width, distance, tables, mass)

    def closest(left, right):
        return _nearest(left, right, k)

    asked = written(queries.mapInArrow(probed, "key long, vec_id long, embedding array<double>"), "probes")
    index = written(
        classes.mapInArrow(hashed, "key long, ids array<long>, embedding array<double>")
        .join(asked.select("key").distinct(), "key", "left_semi"), "index")
    def parts(rows, size, name):
        return rows.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    # both sides of a hot cell are split: each block of members meets each block of queries
    sizes = written(parts(index, BLOCK_ROWS, "m").join(parts(asked, BLOCK_QUERIES, "n"), "key"), "cells")
    members = index.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), "m").cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("m", "n")
    spread = asked.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("vec_id"), "n").cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).drop("m", "n")
    found = spread.groupBy("key", "block", "part").cogroup(members.groupBy("key", "block", "part")).applyInArrow(closest, _FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    lists = written(
        found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "lists")

    short = queries.join(lists.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    whole = None
    if not short.isEmpty():
        def blocks(rows, size, name):
            return rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size).cast("int")).alias(name))

        grid = blocks(classes, BLOCK_ROWS, "m").crossJoin(blocks(short, BLOCK_QUERIES, "n"))
        everyone = classes.crossJoin(grid).select(
            "ids", "embedding", F.size("embedding").alias("dims"), F.pmod(F.xxhash64(F.col("ids")[0]), "m").cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
        again = short.crossJoin(grid).select(
            "vec_id", "embedding", F.size("embedding").alias("dims"), F.pmod(F.xxhash64("vec_id"), "n").cast("int").alias("part"),
            F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("block"))
        keys = ["dims", "block", "part"]
        whole = (
            again.groupBy(*keys).cogroup(everyone.groupBy(*keys)).applyInArrow(closest, _FOUND)
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    out = lists
    if whole is not None:
        out = lists.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids, kept small while they are merged."""
    order = Window.partitionBy("embedding", "part").orderBy("vec_id")
    parts = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    few = parts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return few.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids")).select("ids", "embedding")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector."""
    return nearest(read_table(spark, sf_dir, "embeddings"), 10, 100)
