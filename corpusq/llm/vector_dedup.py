"""Near-duplicate vectors by tiled comparison in PCA order.

Unit vectors are turned onto the principal axes of all rows, strongest first.
Within a label, cells of the first axes, no narrower than a link can be long, are
filled into blocks in order, so a block covers a small box of the leading axes.
Boxes that are farther apart than a link is long never meet: only the other pairs
of blocks are shipped.  Such a pair accumulates the products of leading axes
first: the rest of a product is at most the product of the two suffix norms, so
pairs that cannot reach the threshold leave early.  Those left are compared
exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.tables import components, read_table, written
from corpusq.llm.vectors import lengths, matrix, usable

#: Rows of a block: at least the first number; for larger labels a BLOCKS-th part, up to the second.
BLOCK_ROWS, MOST_ROWS, BLOCKS = 1024, 16_384, 64
#: Leading axes that make cells, and those that a block's box has sides on.
CELL_AXES, BOX_AXES = 4, 8
#: Rows of one block in a product within a task.
TILE = 2048
#: Leading axes after which the bound is tested.
STAGES = (8, 24)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = lengths(batch.column("embedding"))
        for dims in np.unique(size):
            x = matrix(batch.filter(pa.array(size == dims)).column("embedding"))
            x = x / np.linalg.norm(x, axis=1)[:, None]
            i, j = np.triu_indices(int(dims))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dims, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array((x.T @ x)[i, j])], names=["dims", "i", "j", "s"])


def axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, strongest first) of the unit vectors, for each length.

    Sums of products come from all rows; the driver holds dims * (dims + 1) / 2
    numbers for each length.
    """
    sums = rows.select("embedding").mapInArrow(_moments, "dims int, i int, j int, s double").groupBy("dims", "i", "j").agg(F.sum("s").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for dims in {r["dims"] for r in sums}:
        c = np.zeros((dims, dims))
        for r in sums:
            if r["dims"] == dims:
                c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["s"]
        out[dims] = np.linalg.eigh(c)[1][:, ::-1].copy()
    return out


def _turned(batches: Iterator[pa.RecordBatch], basis: dict[int, np.ndarray], width: float) -> Iterator[pa.RecordBatch]:
    """Rows with their number of axes, cell and leading coordinates (0 beyond the last axis)."""
    for batch in batches:
        size = lengths(batch.column("embedding"))
        for dims in np.unique(size):
            rows = batch.filter(pa.array(size == dims))
            x = matrix(rows.column("embedding"))
            lead = np.zeros((len(x), BOX_AXES))
            turned = (x / np.linalg.norm(x, axis=1)[:, None]) @ basis[int(dims)][:, :BOX_AXES]
            lead[:, : turned.shape[1]] = turned
            cell = np.floor(lead[:, :CELL_AXES] / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.full(len(x), dims, np.int32)), pa.array(list(cell), pa.list_(pa.int32())), pa.array(list(lead), pa.list_(pa.float64()))],
                names=[*rows.schema.names, "dims", "cell", "lead"])


def close_pairs(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b with cosine >= threshold."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    x, y = (a / na[:, None]) @ basis, (b / nb[:, None]) @ basis
    # rounding moves a product by less than 1e-9
    slack = threshold - 1e-9
    stages = [s for s in STAGES if s < x.shape[1]] or [x.shape[1]]
    k = stages[0]
    rest = [np.sqrt(np.maximum((v[:, k:] ** 2).sum(axis=1), 0)) for v in (x, y)]
    part = x[:, :k] @ y[:, :k].T
    i, j = np.nonzero(part + np.outer(*rest) >= slack)
    part = part[i, j]
    for more in stages[1:]:
        part = part + np.einsum("ij,ij->i", x[i, k:more], y[j, k:more])
        k = more
        rest = [np.sqrt(np.maximum((v[:, k:] ** 2).sum(axis=1), 0)) for v in (x, y)]
        stay = part + rest[0][i] * rest[1][j] >= slack
        i, j, part = i[stay], j[stay], part[stay]
    keep = np.concatenate([
        np.einsum("ij,ij->i", a[i[s : s + 65536]], b[j[s : s + 65536]]) / (na[i[s : s + 65536]] * nb[j[s : s + 65536]]) >= threshold
        for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
    return i[keep], j[keep]


def _compared(table: pa.Table, basis: dict[int, np.ndarray], threshold: float) -> pa.Table:
    """Links of two blocks (or of one): how many each row has, and those that join parts not joined before."""
    x = matrix(table["embedding"])
    ids, side, copies = (table[c].to_numpy() for c in ("vec_id", "side", "copies"))
    left = np.flatnonzero(side == 0)
    one = len(left) == len(ids)
    right = left if one else np.flatnonzero(side == 1)
    n_links = np.zeros(len(ids), np.int64)
    joined: list[tuple[int, int]] = []
    parent = np.arange(len(ids))

    def top(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return int(v)

    for at, to in itertools.product(range(0, len(left), TILE), range(0, len(right), TILE)):
        if one and to < at:
            continue
        i, j = close_pairs(x[left[at : at + TILE]], x[right[to : to + TILE]], basis[x.shape[1]], threshold)
        i, j = left[at : at + TILE][i], right[to : to + TILE][j]
        if one:
            i, j = i[i < j], j[i < j]
        np.add.at(n_links, i, copies[j])
        np.add.at(n_links, j, copies[i])
        for u, v in zip(i.tolist(), j.tolist(), strict=True):
            p, q = top(u), top(v)
            if p != q:
                parent[q] = p
                joined.append((u, v))
    linked = np.flatnonzero(n_links)
    a = np.concatenate([ids[linked], ids[[p for p, _ in joined]]]) if len(linked) else np.zeros(0, np.int64)
    return pa.table({
        "vec_id": pa.array(a.astype(np.int64)),
        "n": pa.array(np.concatenate([n_links[linked], np.zeros(len(joined), np.int64)])),
        "other": pa.array([None] * len(linked) + [int(ids[q]) for _, q in joined], pa.int64()),
    })


def _blocked(placed: DataFrame) -> DataFrame:
    """placed with its block within label and dims: cells in order, filled up to a size; larger cells cut by a hash of the id."""
    group = ["label", "dims"]
    cells = placed.groupBy(*group, "cell").agg(F.count("*").alias("n"))
    all_rows = F.sum("n").over(Window.partitionBy(*group))
    size = F.greatest(F.lit(BLOCK_ROWS), F.least(F.lit(MOST_ROWS), F.ceil(all_rows / BLOCKS)))
    in_order = Window.partitionBy(*group).orderBy("cell")
    pieces = F.ceil(F.col("n") / F.col("size")).cast("long")
    # a cell of more than one piece stands alone; the others share blocks by what lies before them
    numbered = (
        cells.withColumn("size", size).withColumn("pieces", pieces).withColumn("alone", F.col("pieces") > 1)
        .withColumn("break", F.when(F.col("alone") | F.coalesce(F.lag("alone").over(in_order), F.lit(True)), 1).otherwise(0))
        .withColumn("run", F.sum("break").over(in_order)))
    in_run = Window.partitionBy(*group, "run").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.call_function("div", F.coalesce(F.sum("n").over(in_run), F.lit(0)), F.col("size").cast("long"))
    first = F.struct("run", ahead.alias("of"), F.lit(0).cast("long").alias("piece"))
    numbered = numbered.withColumn("first", first).select(*group, "cell", "pieces", "first")
    block = F.struct(F.col("first.run").alias("run"), F.col("first.of").alias("of"), F.pmod(F.xxhash64("vec_id"), F.col("pieces")).alias("piece"))
    return placed.join(numbered, [*group, "cell"]).withColumn("block", block).drop("cell", "pieces", "first")


def tiles(blocked: DataFrame, longest: float) -> DataFrame:
    """The pairs of blocks (x, y) of one label and length that a link can join, as label, dims, block, x, y and side.

    A block is a row with its box here; vectors follow the pairs that are left.
    """
    box = [f(F.col("lead")[i]).alias(f"{n}{i}") for i in range(BOX_AXES) for f, n in ((F.min, "low"), (F.max, "high"))]
    boxes = written(blocked.groupBy("label", "dims", "block").agg(*box), "boxes")
    other = boxes.select("label", "dims", F.col("block").alias("y"), *[F.col(f"{n}{i}").alias(f"{n}{i}_") for i in range(BOX_AXES) for n in ("low", "high")])
    apart = F.lit(0.0)
    for i in range(BOX_AXES):
        gap = F.greatest(F.lit(0.0), F.col(f"low{i}") - F.col(f"high{i}_"), F.col(f"low{i}_") - F.col(f"high{i}"))
        apart = apart + gap * gap
    pairs = written(
        boxes.withColumnRenamed("block", "x").join(other, ["label", "dims"]).where((F.col("x") <= F.col("y")) & (apart <= longest * longest))
        .select("label", "dims", "x", "y"), "tiles")
    left = pairs.select("label", "dims", F.col("x").alias("block"), "x", "y", F.lit(0).alias("side"))
    return left.unionByName(pairs.where("x != y").select("label", "dims", F.col("y").alias("block"), "x", "y", F.lit(1).alias("side")))


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Links between vectors of one label with a cosine of at least threshold.

    Returns vec_id, n_links, component_id and kept, one row for each row of
    vectors.  Equal vectors of a label are compared once and counted as often as
    they stand.

    Nulls and edge cases: rows with a null label and those that
    `vectors.usable` leaves out link with nothing (n_links 0, component_id =
    vec_id); a null vec_id has component null and is kept; vectors of different
    lengths are never linked; repeated rows of one vec_id are one vector (the
    one with the smallest label and components); an empty table gives an empty result; columns other
    than vec_id, label and embedding are ignored.
    """
    rows = usable(vectors.where(F.col("label").isNotNull()), F.col("label").cast("string").alias("label"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    members = written(rows, "members")
    classes = written(members.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "classes")
    basis = axes(classes)
    longest = float(np.sqrt(max(2 * (1 - threshold), 0))) + 1e-6

    def turned(batches):
        return _turned(batches, basis, longest)

    def compared(table):
        return _compared(table, basis, threshold)

    placed = written(classes.select("label", "vec_id", "copies", "embedding").mapInArrow(
        turned, "label string, vec_id long, copies long, embedding array<double>, dims int, cell array<int>, lead array<double>"), "placed")
    blocked = written(_blocked(placed), "blocked")
    near = tiles(blocked, longest)
    found = written(
        blocked.drop("lead").join(near, ["label", "dims", "block"])
        .select("label", "dims", "x", "y", "side", "vec_id", "copies", "embedding")
        .groupBy("label", "dims", "x", "y").applyInArrow(compared, "vec_id long, n long, other long"), "found")
    reached = components(found.where("other IS NOT NULL"), "vec_id", "other")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n")).select(F.col("vec_id").alias("rep"), "n")
    of_class = (
        classes.select("label", "embedding", F.col("vec_id").alias("rep"), "copies")
        .join(counts, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left")
        .select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = members.join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op9_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at a cosine of 0.98."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"), 0.98)
