"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are projected on the leading principal directions of the corpus and
ordered by their grid cells of width epsilon, the Euclidean distance that the
cosine threshold allows.  The ordered sequence is cut into blocks; a pair of blocks
is joined unless the boxes of their projections are farther apart than epsilon, in
which case no pair of theirs can link.  Inside a task both blocks are halved
recursively in the same way before vectors are compared; the leading directions
are compared first, and what remains by cosines in double precision.

Equal vectors are one class with a count, and a task returns link counts and a
spanning forest of its links, never pairs.  A hot cell fills many blocks, since the
order continues by class inside a cell.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths don't link; rows without an id are left out;
a repeated id counts once for each distinct vector; an empty table gives no rows;
columns besides ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import components, cut_lineage, drop_written

LEADING, GRID, BLOCK, LEAF = 16, 6, 2048, 256


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe against overflow of squares."""
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def principal_directions(classes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading directions from sums over all vectors, added up by Spark."""

    def moments(batches):
        total, square, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column(0)))
                total += x.sum(0)
                square += x.T @ x
                n += len(x)
        values = np.concatenate([[n], total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "value"])

    got = classes.select("x").mapInArrow(moments, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    values = np.zeros(1 + width + width * width)
    values[got["at"].to_numpy(np.int64)] = got["value"].to_numpy(float)
    n = max(values[0], 1)
    mean = values[1 : 1 + width] / n
    spread = values[1 + width :].reshape(width, width) / n - np.outer(mean, mean)
    _, directions = np.linalg.eigh(spread)
    return mean, directions[:, ::-1][:, : min(LEADING, width)]


def _gap(low_a, high_a, low_b, high_b) -> float:
    """Squared distance of two boxes."""
    apart = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float((apart * apart).sum())


def _join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, epsilon: float, cosine: float, same: bool):
    """Places (i, j) of linked rows; ``same``: only i < j.  Intervals of the two sequences are halved until they are far apart or short."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    reach = (epsilon + 1e-9) ** 2
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if same and j1 <= i0:
            continue
        x, y = pa_[i0:i1], pb[j0:j1]
        if _gap(x.min(0), x.max(0), y.min(0), y.max(0)) > reach:
            continue
        if max(i1 - i0, j1 - j0) > LEAF:
            cut = lambda s, e: [(s, (s + e) // 2), ((s + e) // 2, e)] if e - s > LEAF else [(s, e)]
            stack += [(*p, *q) for p in cut(i0, i1) for q in cut(j0, j1)]
            continue
        # the squared distance of the projections bounds that of the vectors
        near = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T) <= reach + 1e-6
        i, j = np.nonzero(near)
        i, j = i + i0, j + j0
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            if len(i) * 4 > (i1 - i0) * (j1 - j0):
                keep = (a[i0:i1] @ b[j0:j1].T)[i - i0, j - j0] >= cosine
            else:
                keep = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
            found.append((i[keep], j[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each reaches by the links, by label spreading; only nodes that are no root."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def embedding_links(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    good = F.exists(x, lambda v: v != 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"), F.coalesce(good, F.lit(False)).alias("good")).filter("vec_id IS NOT NULL")
    # -0.0 and 0.0 are one value
    keyed = rows.filter("good").withColumn("x", F.transform("x", lambda v: v + F.lit(0.0))).withColumn("key", F.sha2(F.concat_ws(",", F.transform("x", lambda v: v.cast("string"))), 256))
    members = cut_lineage(keyed.select("vec_id", "key", F.size("x").alias("width")), "vector-keys")
    classes = members.groupBy("key", "width").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    held = keyed.select(F.col("vec_id").alias("rep"), "key", "x").join(classes, ["key", "rep"]).dropDuplicates(["key"])
    held = cut_lineage(held.select("rep", "copies", "width", "x"), "vector-classes")
    widths = [r["width"] for r in held.select("width").distinct().collect()]
    parts, written = [], []
    for width in sorted(widths):
        mine = held.filter(F.col("width") == width).select("rep", "copies", "x")
        part, blocks = _links_of(mine, width, cosine, block)
        parts.append(part)
        written.append(blocks)
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = parts[0]
    for part in parts[1:]:
        links = links.unionByName(part)
    links = cut_lineage(links, "vector-links")
    drop_written(spark, *written)
    joined = components(links.filter("root IS NOT NULL").select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    per_class = (
        classes.join(counts, classes["rep"] == counts["node"], "left").drop("node")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    named = members.select("vec_id", "key").join(per_class, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links_of(classes: DataFrame, width: int, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, n, root): links that a class gets from one pair of blocks, and a smaller node it reaches there."""
    epsilon = float(np.sqrt(2 * (1 - cosine)))
    mean, directions = principal_directions(classes, width)
    grid = min(GRID, directions.shape[1])

    def order(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                cells = np.floor((unit(x) - mean) @ directions[:, :grid] / epsilon).astype(np.int64) + 64
                packed = [r.tobytes() for r in x.astype("<f8")]
                code = np.zeros(len(x), np.int64)
                for d in range(grid):
                    code = code * 128 + np.clip(cells[:, d], 0, 127)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(code)], ["rep", "copies", "x", "cell"])

    ordered = classes.mapInArrow(order, "rep bigint, copies bigint, x binary, cell bigint")
    ranges = ordered.repartitionByRange("cell", "rep").sortWithinPartitions("cell", "rep")

    def cut(batches):
        """Blocks of the ordered sequence; a block is named by its smallest class."""
        reps, copies, xs = [], [], []

        def emit():
            x = np.frombuffer(b"".join(xs), "<f8").reshape(len(xs), width)
            p = (unit(x) - mean) @ directions
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([min(reps)]), pa.array([np.array(reps, "<i8").tobytes()], pa.binary()), pa.array([np.array(copies, "<i8").tobytes()], pa.binary()),
                    pa.array([b"".join(xs)], pa.binary()), pa.array([p.min(0).tolist()], pa.list_(pa.float64())), pa.array([p.max(0).tolist()], pa.list_(pa.float64())),
                ],
                ["block", "reps", "copies", "x", "low", "high"],
            )
            reps.clear(), copies.clear(), xs.clear()
            return out

        for batch in batches:
            for r, c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                reps.append(r)
                copies.append(c)
                xs.append(x)
                if len(xs) == block:
                    yield emit()
        if xs:
            yield emit()

    schema = "block bigint, reps binary, copies binary, x binary, low array<double>, high array<double>"
    blocks = cut_lineage(ranges.mapInArrow(cut, schema), "blocks")
    # blocks meet over the cells of the first direction that their boxes, widened by epsilon, touch
    cell = lambda v: F.floor(v / epsilon)
    boxes = blocks.select("block", "low", "high")
    left = boxes.select("block", "low", "high", F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("c"))
    right = boxes.select(
        F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"),
        F.explode(F.sequence(cell(F.col("low")[0] - epsilon), cell(F.col("high")[0] + epsilon))).alias("c"),
    )
    apart = F.aggregate(
        F.zip_with(
            F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b),
            lambda a, b: F.greatest(a, b, F.lit(0.0)),
        ),
        F.lit(0.0), lambda s, v: s + v * v,
    )
    pairs = left.join(right, "c").filter("block <= other").filter(apart <= (epsilon + 1e-9) ** 2).select("block", "other").distinct()
    other = blocks.select(F.col("block").alias("other"), F.col("reps").alias("reps2"), F.col("copies").alias("copies2"), F.col("x").alias("x2"))
    both = pairs.join(blocks.select("block", "reps", "copies", "x"), "block").join(other, "other").select("block", "other", "reps", "copies", "x", "reps2", "copies2", "x2")

    def links(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                at = lambda name, kind: np.frombuffer(batch.column(batch.schema.get_field_index(name))[k].as_buffer(), kind)  # noqa: B023, E731
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                a = unit(at("x", "<f8").reshape(-1, width))
                b = a if same else unit(at("x2", "<f8").reshape(-1, width))
                p = (a - mean) @ directions
                i, j = _join(a, b, p, p if same else (b - mean) @ directions, epsilon, cosine, same)
                reps, copies = at("reps", "<i8"), at("copies", "<i8")
                if not same:
                    reps, copies, j = np.concatenate([reps, at("reps2", "<i8")]), np.concatenate([copies, at("copies2", "<i8")]), j + len(reps)
                n = np.bincount(i, copies[j], len(reps)).astype(np.int64) + np.bincount(j, copies[i], len(reps)).astype(np.int64)
                moved, root = _forest(i, j, len(reps))
                roots = np.full(len(reps), -1, np.int64)
                roots[moved] = root
                held = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[held]), pa.array(n[held]), pa.array(reps[np.maximum(roots[held], 0)], mask=roots[held] < 0)], ["node", "n", "root"]
                )

    return both.mapInArrow(links, "node bigint, n bigint, root bigint"), blocks
