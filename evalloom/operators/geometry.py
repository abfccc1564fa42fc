"""Geometry of support grids, point sets and shapes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.functions.geometry import angle_bucket
from evalloom.plans.scan import neighbour, percentiles
from evalloom.session import broadcast_if_small, cut_lineage

# ---------------------------------------------------------------------------
# grids: one row per scene, the g x g cells as an array
# ---------------------------------------------------------------------------


def component_labels(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Smallest connected cell index per cell for a stack of grids, -1 off the mask.

    Cells connect over their sides, with ``diagonal`` over corners too.  All grids of a batch relax together until no label moves.
    """
    n, h, w = mask.shape
    far = h * w
    label = np.where(mask, np.arange(far).reshape(1, h, w), far)
    while True:
        low = label.copy()
        low[:, 1:] = np.minimum(low[:, 1:], label[:, :-1])
        low[:, :-1] = np.minimum(low[:, :-1], label[:, 1:])
        low[:, :, 1:] = np.minimum(low[:, :, 1:], label[:, :, :-1])
        low[:, :, :-1] = np.minimum(low[:, :, :-1], label[:, :, 1:])
        if diagonal:
            low[:, 1:, 1:] = np.minimum(low[:, 1:, 1:], label[:, :-1, :-1])
            low[:, 1:, :-1] = np.minimum(low[:, 1:, :-1], label[:, :-1, 1:])
            low[:, :-1, 1:] = np.minimum(low[:, :-1, 1:], label[:, 1:, :-1])
            low[:, :-1, :-1] = np.minimum(low[:, :-1, :-1], label[:, 1:, 1:])
        low = np.where(mask, low, far)
        if np.array_equal(low, label):
            return np.where(mask, label, -1)
        label = low


_GEOMETRY = T.StructType(
    [
        T.StructField("fraction", T.DoubleType()),
        T.StructField("span", T.DoubleType()),
        T.StructField("components", T.LongType()),
        T.StructField("elongation", T.DoubleType()),
        T.StructField("fill", T.DoubleType()),
    ]
)


def _stack(values: pd.Series) -> np.ndarray:
    grid = np.stack([np.asarray(v, dtype=float) for v in values])
    side = math.isqrt(grid.shape[1])
    return grid.reshape(len(values), side, side)


def _in_slices(kernel: Callable, *columns: pd.Series, rows: int = 512):
    """A kernel over a few rows at a time, so its working memory does not follow the size of an Arrow batch."""
    parts = [kernel(*[c.iloc[at : at + rows] for c in columns]) for at in range(0, max(1, len(columns[0])), rows)]
    return pd.concat(parts, ignore_index=True)


@F.pandas_udf(_GEOMETRY)
def _support_geometry(cells: pd.Series) -> pd.DataFrame:
    return _in_slices(_geometry_of_masks, cells)


def _geometry_of_masks(cells: pd.Series) -> pd.DataFrame:
    mask = _stack(cells) > 0
    n, g, _ = mask.shape
    flat = mask.reshape(n, -1)
    count = flat.sum(axis=1)
    ys, xs = np.divmod(np.arange(g * g), g)
    safe = np.maximum(count, 1)
    my, mx = (flat * ys).sum(axis=1) / safe, (flat * xs).sum(axis=1) / safe
    dy, dx = ys - my[:, None], xs - mx[:, None]
    cyy = (flat * dy * dy).sum(axis=1) / safe
    cxx = (flat * dx * dx).sum(axis=1) / safe
    cxy = (flat * dy * dx).sum(axis=1) / safe
    spread = np.sqrt(((cyy - cxx) / 2) ** 2 + cxy**2)
    middle = (cyy + cxx) / 2
    elongation = np.where(count > 1, np.minimum(20.0, (middle + spread + 0.05) / (middle - spread + 0.05)), 1.0)
    squared = (ys[:, None] - ys[None, :]) ** 2 + (xs[:, None] - xs[None, :]) ** 2
    span = np.zeros(n)
    # distances from large to small: the first one present in a grid is its span
    for d in sorted(np.unique(squared), reverse=True):
        a, b = np.nonzero(np.triu(squared == d))
        hit = (flat[:, a] & flat[:, b]).any(axis=1) & (span == 0)
        span[hit] = math.sqrt(d) / (math.sqrt(2.0) * (g - 1))
    labels = component_labels(mask).reshape(n, -1)
    components = (labels == np.arange(g * g)).sum(axis=1)
    top = np.where(flat, ys, g).min(axis=1)
    bottom = np.where(flat, ys, -1).max(axis=1)
    left = np.where(flat, xs, g).min(axis=1)
    right = np.where(flat, xs, -1).max(axis=1)
    area = np.maximum((bottom - top + 1) * (right - left + 1), 1)
    return pd.DataFrame(
        {
            "fraction": count / (g * g),
            "span": np.minimum(1.0, span),
            "components": components,
            "elongation": elongation,
            "fill": np.where(count > 0, count / area, 0.0),
        }
    )


def support(impact: Column, error: Column) -> Column:
    """A cell supports the decision when its removal changed it or made the scorer fail."""
    return F.zip_with(impact, error, lambda a, b: F.least(a + b, F.lit(1.0)))


def support_geometry(grids: DataFrame, mask: str) -> DataFrame:
    return grids.withColumn("__g", _support_geometry(F.col(mask))).select(*grids.columns, "__g.*")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _centre(values: pd.Series, cells: pd.Series) -> pd.Series:
    return _in_slices(_centred, values, cells)


def _centred(values: pd.Series, cells: pd.Series) -> pd.Series:
    data, mask = _stack(values), _stack(cells) > 0
    n, g, _ = mask.shape
    out = np.zeros_like(data)
    for i in range(n):
        ys, xs = np.nonzero(mask[i])
        if not len(ys):
            out[i] = data[i]
            continue
        dy = int(np.rint((g - 1) / 2 - ys.mean()))
        dx = int(np.rint((g - 1) / 2 - xs.mean()))
        src = data[i, max(0, -dy) : g - max(0, dy), max(0, -dx) : g - max(0, dx)]
        out[i, max(0, dy) : max(0, dy) + src.shape[0], max(0, dx) : max(0, dx) + src.shape[1]] = src
    return pd.Series(list(out.reshape(n, -1)))


def centre_grid(grids: DataFrame, value: str, mask: str, name: str) -> DataFrame:
    """Shift a grid so that the centroid of its support lies in the middle, without wrap."""
    return grids.withColumn(name, _centre(F.col(value), F.col(mask)))


def descriptor_v1(fraction: Column, span: Column, components: Column, elongation: Column) -> tuple[Column, Column]:
    extent = F.when(fraction >= 0.55, "global").when((fraction >= 0.25) | (span >= 0.65), "long_range").otherwise("local")
    topology = (
        F.when(fraction >= 0.60, "diffuse")
        .when(components >= 2, "multipart")
        .when((elongation >= 2.75) | ((span >= 0.60) & (fraction <= 0.50)), "elongated")
        .otherwise("compact")
    )
    return extent, topology


def descriptor_robust(span: Column, components: Column, elongation: Column, fill: Column) -> tuple[Column, Column]:
    scale = F.when(span < 0.30, "focal").when(span < 0.65, "regional").otherwise("distributed")
    shape = (
        F.when(components >= 2, "multipart")
        .when((elongation >= 2.75) | ((fill <= 0.55) & (span > 0.0)), "pathlike")
        .otherwise("compact")
    )
    return scale, shape


def normalised_geometry(components: Column, elongation: Column) -> tuple[Column, Column]:
    """Components over 8 and log elongation over log 20, both capped at 1."""
    return (
        F.least(F.lit(1.0), components / 8.0),
        F.least(F.lit(1.0), F.log2(F.greatest(F.lit(1.0), elongation)) / F.lit(math.log2(20.0))),
    )


GEOMETRY_FIELDS = ("fraction", "span", "parts", "stretch", "fill")
# Order of the descriptor shares inside a behavioural vector.
SCALE_ORDER = ("focal", "regional", "distributed")
SHAPE_ORDER = ("compact", "pathlike", "multipart")
# end of fixed values


def scene_profiles(grids: DataFrame) -> DataFrame:
    """Geometry, descriptor and centred maps per scene."""
    masked = grids.withColumn("mask", support(F.col("impact"), F.col("error")))
    # asked for together, so one Python worker for each task runs all kernels
    drawn = masked.select(
        "*", _support_geometry(F.col("mask")).alias("__g"), _centre(F.col("mask"), F.col("mask")).alias("impact_map"),
        _centre(F.col("error"), F.col("mask")).alias("error_map"),
    )
    measured = drawn.select(*masked.columns, "__g.*", "impact_map", "error_map")
    parts, stretch = normalised_geometry(F.col("components"), F.col("elongation"))
    measured = measured.withColumn("parts", parts).withColumn("stretch", stretch)
    # the thresholds look at what the normalised values say, as the aggregate does
    rounded_parts = F.rint(F.col("parts") * 8.0)
    stretched = F.pow(F.lit(2.0), F.col("stretch") * F.lit(math.log2(20.0)))
    scale, shape = descriptor_robust(F.col("span"), rounded_parts, stretched, F.col("fill"))
    active = F.col("fraction") > 0
    return measured.withColumn("scale", F.when(active, scale)).withColumn("shape", F.when(active, shape))


def robust_profile(scenes: DataFrame, candidate: str) -> DataFrame:
    """Median and interquartile range per component, descriptor of the medians, shares, stability.

    Each geometry value of a g x g grid comes from a small finite set, so the
    exact percentile buffers stay small whatever the number of scenes.
    """
    quartiles = [
        F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{name}") for name in GEOMETRY_FIELDS
    ]
    shares = [F.avg(F.when(F.col("scale") == s, 1.0).otherwise(0.0)).alias(f"share_{s}") for s in SCALE_ORDER]
    shares += [F.avg(F.when(F.col("shape") == s, 1.0).otherwise(0.0)).alias(f"share_{s}") for s in SHAPE_ORDER]
    pairs = F.count(F.lit(1))
    base = scenes.groupBy(candidate).agg(
        pairs.alias("scenes"),
        (F.count("scale") / pairs).alias("nonempty_fraction"),
        *quartiles,
        *shares,
        F.avg(F.aggregate("error", F.lit(0.0), lambda a, x: a + x) / F.size("error")).alias("error_fraction"),
    )
    median = lambda n: F.col(f"q_{n}")[1]
    scale, shape = descriptor_robust(
        median("span"),
        F.rint(median("parts") * 8.0),
        F.pow(F.lit(2.0), median("stretch") * F.lit(math.log2(20.0))),
        median("fill"),
    )
    described = base.withColumn("scale", scale).withColumn("shape", shape)
    agreement = (
        scenes.filter("scale IS NOT NULL")
        .groupBy(candidate, F.col("scale"), F.col("shape"))
        .agg(F.count(F.lit(1)).alias("__agree"))
    )
    out = described.join(agreement, [candidate, "scale", "shape"], "left")
    return out.withColumn("stability", F.coalesce("__agree", F.lit(0)) / F.col("scenes")).drop("__agree")


def mean_grid(scenes: DataFrame, candidate: str, grid: str, name: str) -> DataFrame:
    """Cell-wise mean over scenes as one array of the grid's fixed size."""
    cells = (
        scenes.select(candidate, F.posexplode(grid).alias("pos", "value"))
        .groupBy(candidate, "pos")
        .agg(F.avg("value").alias("mean"))
    )
    listed = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return cells.groupBy(candidate).agg(F.transform(listed, lambda c: c["mean"]).alias(name))


def attest(grids: DataFrame, candidate: str) -> DataFrame:
    """Descriptor, stability and behavioural vector per candidate from its scene grids."""
    # the scorer and the kernels run once: everything below reads their written result
    scenes = cut_lineage(scene_profiles(grids), "scenes")
    profile = robust_profile(scenes, candidate)
    impact = mean_grid(scenes, candidate, "impact_map", "impact_mean")
    error = mean_grid(scenes, candidate, "error_map", "error_mean")
    joined = profile.join(impact, candidate).join(error, candidate)
    medians = F.array(*[F.col(f"q_{n}")[1] for n in GEOMETRY_FIELDS])
    ranges = F.array(*[F.col(f"q_{n}")[2] - F.col(f"q_{n}")[0] for n in GEOMETRY_FIELDS])
    shares = F.array(*[F.col(f"share_{s}") for s in (*SCALE_ORDER, *SHAPE_ORDER)])
    seen = [c for c in ("foreground", "edges", "entropy") if c in grids.columns]
    for c in seen:
        medians_of = percentiles(scenes.select(candidate, c), [candidate], c, {f"visual_{c}": 0.5}, F.floor(F.col(c) * 256))
        joined = joined.join(medians_of, candidate)
    visual = F.array(*[F.col(f"visual_{c}") if c in seen else F.lit(0.0) for c in ("foreground", "edges", "entropy")])
    vector = F.concat("impact_mean", "error_mean", medians, ranges, shares, visual, F.array("stability", "error_fraction"))
    return joined.select(
        candidate,
        "scenes",
        "scale",
        "shape",
        "stability",
        "nonempty_fraction",
        "error_fraction",
        F.when(F.col("nonempty_fraction") < 2.0 / 3.0, "incomplete").otherwise("complete").alias("status"),
        (F.col("error_fraction") > 0.5).alias("warned"),
        vector.alias("vector"),
    )


def descriptor_occupancy(rows: DataFrame) -> DataFrame:
    """Scenes per descriptor pair with subtotals, empty scenes apart."""
    return (
        rows.withColumn("described", F.col("scale").isNotNull())
        .rollup("described", "scale", "shape")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
        .select("described", "scale", "shape", "n", F.col("level").cast("bigint").alias("level"))
    )


def component_table(grids: DataFrame, ident: str, mask: str, *, minimum: int = 1, diagonal: bool = False) -> DataFrame:
    """One row per component, 4-connected or with ``diagonal`` 8-connected: size, box and centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            labels = component_labels(_stack(batch[mask]) > 0, diagonal)
            at, ys, xs = np.nonzero(labels >= 0)
            cells = pd.DataFrame({ident: batch[ident].to_numpy()[at], "component": labels[at, ys, xs], "y": ys, "x": xs})
            yield cells.groupby([ident, "component"], as_index=False).agg(
                size=("y", "size"), y0=("y", "min"), y1=("y", "max"), x0=("x", "min"), x1=("x", "max"), cy=("y", "mean"), cx=("x", "mean")
            )

    kind = grids.schema[ident].dataType.simpleString()
    schema = f"{ident} {kind}, component bigint, size bigint, y0 bigint, y1 bigint, x0 bigint, x1 bigint, cy double, cx double"
    return grids.select(ident, mask).mapInPandas(run, schema).filter(F.col("size") >= minimum)


def block_majority(bits: Column, side: int, block: int) -> Column:
    """Majority bit of each block of a square bit grid, row by row."""
    per = side // block
    out = []
    for by in range(per):
        for bx in range(per):
            cells = [bits[(by * block + dy) * side + bx * block + dx] for dy in range(block) for dx in range(block)]
            total = cells[0]
            for cell in cells[1:]:
                total = total + cell
            out.append(F.when(total > block * block // 2, 1).otherwise(0))
    return F.array(*out)


def template_overlap(field: Column, template: str) -> Column:
    """Share of a template's on-cells that are on in the field."""
    on = [i for i, c in enumerate(template) if c == "#"]
    total = F.lit(0)
    for i in on:
        total = total + field[i]
    return total / max(1, len(on))


# ---------------------------------------------------------------------------
# point sets: plain aggregates, so a hot scene is combined map-side
# ---------------------------------------------------------------------------


def _circle(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Algebraic least squares from central moments."""
    z = F.col(x) * F.col(x) + F.col(y) * F.col(y)
    m = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        F.avg(z).alias("mz"),
        F.var_pop(x).alias("cxx"),
        F.var_pop(y).alias("cyy"),
        F.covar_pop(x, y).alias("cxy"),
        F.covar_pop(F.col(x), z).alias("cxz"),
        F.covar_pop(F.col(y), z).alias("cyz"),
    )
    det = F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    a = F.try_divide(F.col("cxz") * F.col("cyy") - F.col("cyz") * F.col("cxy"), det)
    b = F.try_divide(F.col("cyz") * F.col("cxx") - F.col("cxz") * F.col("cxy"), det)
    c = F.col("mz") - a * F.col("mx") - b * F.col("my")
    cx, cy = a / 2, b / 2
    return m.select(*keys, "n", cx.alias("cx"), cy.alias("cy"), F.sqrt(F.greatest(c + cx * cx + cy * cy, F.lit(0.0))).alias("r"))


def circle_fit(points: DataFrame, keys: list[str], x: str, y: str, *, minimum: int = 12, residual: float = 2.0) -> DataFrame:
    """Circle per group with one refit on the inliers, arc coverage in 5 degree bins, rms residual.

    Groups with fewer than ``minimum`` points come out without a circle.
    """
    first = _circle(points, keys, x, y)
    gap = lambda: F.abs(F.hypot(F.col(x) - F.col("cx"), F.col(y) - F.col("cy")) - F.col("r"))
    near = points.join(first, keys).filter(gap() <= residual).select(*keys, x, y)
    second = _circle(near, keys, x, y).withColumnsRenamed({"n": "n2", "cx": "cx2", "cy": "cy2", "r": "r2"})
    both = first.join(second, keys, "left")
    refit = F.coalesce((F.col("n2") >= minimum) & (F.col("n2") < F.col("n")), F.lit(False))
    fits = both.select(
        *keys,
        "n",
        refit.alias("refit"),
        *[F.when(refit, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("cx", "cy", "r")],
        *[F.col(c).alias(f"{c}_first") for c in ("cx", "cy", "r")],
    )
    first_gap = F.abs(F.hypot(F.col(x) - F.col("cx_first"), F.col(y) - F.col("cy_first")) - F.col("r_first"))
    used = points.join(fits, keys).filter(~F.col("refit") | (first_gap <= residual))
    arc_bin = F.floor(F.degrees(F.atan2(F.col(y) - F.col("cy"), F.col(x) - F.col("cx"))) / 5)
    quality = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("used"),
        (F.size(F.collect_set(arc_bin)) * 5).cast("bigint").alias("arc_deg"),
        F.sqrt(F.avg(gap() * gap())).alias("rms"),
    )
    enough = F.col("n") >= minimum
    out = fits.join(quality, keys)
    return out.select(*keys, "n", "refit", *[F.when(enough, F.col(c)).alias(c) for c in ("cx", "cy", "r", "used", "arc_deg", "rms")])


def principal_axis(points: DataFrame, keys: list[str], x: str, y: str, *, minimum: int = 1) -> DataFrame:
    """Main direction in [0, 180) and its class; one point has direction 0."""
    m = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.var_pop(x).alias("cxx"), F.var_pop(y).alias("cyy"), F.covar_pop(x, y).alias("cxy")
    )
    # products of rounded moments: a direction of exactly 0 must not come out as just below 180
    twist = F.round(2 * F.col("cxy"), 9)
    degrees = F.pmod(F.degrees(F.atan2(twist, F.round(F.col("cxx") - F.col("cyy"), 9))) / 2 + F.lit(0.0), F.lit(180.0))
    out = m.filter(F.col("points") >= minimum).withColumn("angle", degrees)
    return out.select(*keys, "points", "angle", angle_bucket(F.col("angle")).alias("axis"))


AXES = ("horizontal", "rising", "vertical", "falling")


def orientation_vote(axes: DataFrame, group: str, minimum: int) -> DataFrame:
    """Majority class of a group's components, ties in class order, abstaining when too few."""
    counts = axes.groupBy(group).agg(
        F.count(F.lit(1)).alias("components"), *[F.count_if(F.col("axis") == a).alias(f"n_{a}") for a in AXES]
    )
    top = F.greatest(*[F.col(f"n_{a}") for a in AXES])
    vote = F.when(F.col("components") < minimum, "ABSTAIN")
    for a in AXES:
        vote = vote.when(F.col(f"n_{a}") == top, a)
    return counts.select(group, "components", vote.alias("vote"))


def radial_majority(points: DataFrame, keys: list[str], x: str, y: str, centre: tuple[float, float], radius: float) -> DataFrame:
    """core when at least as many points lie inside the radius as outside, else rim."""
    inside = F.hypot(F.col(x) - centre[0], F.col(y) - centre[1]) <= radius
    return (
        points.groupBy(*keys)
        .agg(F.count_if(inside).alias("inner"), F.count_if(~inside).alias("outer"))
        .withColumn("regime", F.when(F.col("inner") >= F.col("outer"), "core").otherwise("rim"))
    )


def common_circle_score(fits: DataFrame, scene: str) -> DataFrame:
    """Agreement of exactly three fitted circles: yes, no, or an abstention with its reason.

    The count is checked first, so only scenes of three rows are ever gathered.
    """
    sizes = fits.groupBy(scene).agg(F.count(F.lit(1)).alias("fragments"))
    three = fits.join(sizes.filter("fragments = 3"), scene)
    packed = three.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct("r", "x", "y"))).alias("c"))
    c = F.col("c")
    gap = lambda i, j: F.hypot(c[i]["x"] - c[j]["x"], c[i]["y"] - c[j]["y"])
    middle = c[1]["r"]
    score = F.greatest(gap(0, 1), gap(0, 2), gap(1, 2)) / middle + 0.35 * ((c[2]["r"] - c[0]["r"]) / middle)
    scored = packed.select(scene, F.round(score, 9).alias("score"))
    out = sizes.join(scored, scene, "left")
    answer = (
        F.when(F.col("fragments") != 3, "wrong_count")
        .when(F.col("score") <= 0.70, "yes")
        .when(F.col("score") >= 1.10, "no")
        .otherwise("ambiguous")
    )
    return out.select(scene, "fragments", "score", answer.alias("answer"))


def min_pairwise_gap(shapes: DataFrame, scene: str, ident: str, *, small: int = 32) -> DataFrame:
    """Smallest centre distance minus both radii per scene.

    A scene of at most ``small`` shapes compares its few pairs, all scenes of an
    Arrow batch together.  In a larger one
    any two shapes give an upper bound, and neighbours in x order inside a coarse
    strip give a good one; the closest pair lies within that bound plus twice the
    largest radius, so shapes only meet those of the cells of that size around
    them.
    """
    kind = shapes.schema[scene].dataType.simpleString()
    place = [F.col(c).cast("double").alias(c) for c in "xyr"]
    ordered = shapes.select(F.col(scene).alias("scene"), F.col(ident).alias("i"), *place).repartition("scene").sortWithinPartitions("scene")
    sizes = ordered.mapInArrow(partial(_gap_batches, small=small), f"scene {kind}, shapes bigint, gap double").withColumnRenamed("scene", scene)
    sizes = cut_lineage(sizes, "scenes")
    large = F.col("shapes") > small

    gap = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) - F.col("ar") - F.col("br")
    a_side = lambda df, *more: df.select(scene, F.col(ident).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("r").alias("ar"), *more)
    b_side = lambda df, *more: df.select(scene, F.col(ident).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("r").alias("br"), *more)
    # few scenes are large, so their rows are found without dealing out all others
    many = shapes.select(scene, ident, "x", "y", "r").join(broadcast_if_small(sizes.filter(large).select(scene)), scene)
    chain = neighbour(many, [scene], ["x", "y", ident], F.floor(F.col("x")), ["x", "y", "r", ident])
    step = F.hypot(F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y")) - F.col("r") - F.col("prev_r")
    # the order may repeat an id; only pairs of different ids count
    different = F.col(f"prev_{ident}") != F.col(ident)
    bound = chain.groupBy(scene).agg(F.min(F.when(different, step)).alias("bound"), F.max("r").alias("rmax"))
    reach = F.greatest(F.col("bound") + 2 * F.col("rmax"), F.lit(1e-6))
    placed = (
        many.join(bound, scene).filter("bound IS NOT NULL").withColumn("cell", reach)
        .withColumn("gx", F.floor(F.col("x") / F.col("cell"))).withColumn("gy", F.floor(F.col("y") / F.col("cell")))
    )
    # half of the eight neighbours is enough: the other half sees the pair from the other side
    ahead = F.array(*[F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near_many = (
        a_side(placed, F.inline(ahead)).join(b_side(placed, "gx", "gy"), [scene, "gx", "gy"]).filter("a <> b")
        .groupBy(scene).agg(F.min(gap).alias("gap"))
    )
    found = sizes.filter(large).select(scene, "shapes").join(near_many, scene, "left")
    return sizes.filter(~large).unionByName(found)


def _match_scene(fits: list, truths: list) -> tuple[int, float | None, float | None]:
    free = np.asarray(fits, dtype=float).reshape(-1, 3)
    open_ = np.ones(len(free), dtype=bool)
    worst_c = worst_r = None
    matched = 0
    for x, y, r in truths[: len(free)]:
        gaps = np.where(open_, np.hypot(free[:, 0] - x, free[:, 1] - y), np.inf)
        best = int(gaps.argmin())
        open_[best] = False
        matched += 1
        worst_c = max(worst_c or 0.0, float(gaps[best]))
        worst_r = max(worst_r or 0.0, abs(float(free[best, 2]) - r))
    return matched, worst_c, worst_r


def _in_scene_order(rows: pa.Table, order: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[pa.Array]]:
    """Scenes of rows that lie scene by scene, where each begins and ends, and the columns of ``order`` sorted by them within each scene.

    Missing values come first, as in Spark.
    """
    scenes = rows.column("scene").combine_chunks()
    codes = _codes(scenes)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    ends = np.append(first[1:], len(codes))
    columns = [rows.column(c).combine_chunks() for c in order]
    keys = [np.repeat(np.arange(len(first)), ends - first)]
    for column in columns:
        ranked = column if pa.types.is_floating(column.type) or pa.types.is_integer(column.type) else pc.rank(column, tiebreaker="min", null_placement="at_start")
        keys += [] if not column.null_count else [column.is_valid().to_numpy(zero_copy_only=False)]
        keys.append(ranked.fill_null(0).to_numpy(zero_copy_only=False))
    at = pa.array(np.lexsort(keys[::-1]))
    return scenes.take(pa.array(first)), first, ends, [c.take(at) for c in columns]


def _places(x: pa.Array, y: pa.Array, r: pa.Array) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in (x, y, r)], axis=1)


def _match_scenes(rows: pa.Table, small: int) -> pa.RecordBatch:
    """``_match_scene`` for whole scenes in a row: those of at most ``small`` fits take their turns together."""
    scenes, first, ends, (side, _, *xyr) = _in_scene_order(rows, ["side", "i", "x", "y", "r"])
    shapes = _places(*xyr)
    true_at = first + np.add.reduceat(side.to_numpy() == 0, first)
    n_fits = true_at - first
    matched = np.minimum(n_fits, ends - true_at)
    worst = np.zeros((len(first), 2))
    for at in np.flatnonzero(n_fits > small):
        found = _match_scene(shapes[first[at] : true_at[at]], shapes[true_at[at] : ends[at]])
        worst[at] = [value or 0.0 for value in found[1:]]
    few = np.flatnonzero((n_fits <= small) & (matched > 0))
    place = np.arange(n_fits[few].max(initial=0))
    open_ = place < n_fits[few, None]
    free = shapes[np.where(open_, first[few, None] + place, 0)]
    for turn in range(matched[few].max(initial=0)):
        going = np.flatnonzero(matched[few] > turn)
        shape = shapes[true_at[few[going]] + turn]
        gaps = np.where(open_[going], np.hypot(free[going, :, 0] - shape[:, None, 0], free[going, :, 1] - shape[:, None, 1]), np.inf)
        best = gaps.argmin(axis=1)
        open_[going, best] = False
        errors = np.stack([gaps[np.arange(len(going)), best], np.abs(free[going, best, 2] - shape[:, 2])], axis=1)
        held = worst[few[going]]
        worst[few[going]] = np.where(errors > held, errors, held)
    errors = [pa.array(worst[:, c], mask=matched == 0) for c in (0, 1)]
    return pa.RecordBatch.from_arrays([scenes, pa.array(matched), *errors], ["scene", "matched", "max_centre_error", "max_radius_error"])


def _gaps(rows: pa.Table, left_out: int, small: int) -> pa.RecordBatch:
    """Shapes and smallest gap of whole scenes in a row; a scene of more than ``small`` shapes is only counted, the last one with ``left_out`` more rows."""
    scenes, first, ends, (ident, *xyr) = _in_scene_order(rows, ["i", "x", "y", "r"])
    shapes, i = _places(*xyr), _codes(ident)
    known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (ident, *xyr)])
    until = np.repeat(np.where(ends - first <= small, ends, first), ends - first)
    scene = np.repeat(np.arange(len(first)), ends - first)
    gap, found = np.full(len(first), np.nan), np.zeros(len(first), dtype=bool)
    for far in range(1, min(small, int((ends - first).max()))):
        a = np.flatnonzero(np.arange(len(i)) + far < until)
        a = a[known[a] & known[a + far] & (i[a] != i[a + far])]
        b = a + far
        np.fmin.at(gap, scene[a], np.hypot(shapes[a, 0] - shapes[b, 0], shapes[a, 1] - shapes[b, 1]) - shapes[a, 2] - shapes[b, 2])
        found[scene[a]] = True
    size = ends - first
    size[-1] += left_out
    return pa.RecordBatch.from_arrays([scenes, pa.array(size), pa.array(gap, mask=~found)], ["scene", "shapes", "gap"])


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are; missing ones equal each other."""
    return values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _whole_scenes(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[pa.Table, int]]:
    """Tables of whole scenes from rows that lie scene by scene; only the last scene of a batch may go on in the next.

    Of a scene with more than ``most`` rows the later batches are counted only; their rows come as the second value.
    """
    held: list[pa.RecordBatch] = []
    left_out = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        last_of = [held[-1].column("scene").slice(held[-1].num_rows - 1)] if held else []
        codes = _codes(pa.concat_arrays([*last_of, batch.column("scene")]))
        begins = np.flatnonzero(codes[1:] != codes[:-1]) + 1 - len(last_of)
        if left_out and len(begins):  # the counted scene ends here
            left_out += int(begins[0])
            yield pa.Table.from_batches(held), left_out
            held, left_out, batch, begins = [], 0, batch.slice(begins[0]), begins[1:] - begins[0]
        if len(begins):
            yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])]), 0
            held, batch = [], batch.slice(begins[-1])
        if most is None or sum(b.num_rows for b in held) <= most:
            held.append(batch)
        else:
            left_out += batch.num_rows
    if held:
        yield pa.Table.from_batches(held), left_out


def _match_batches(batches: Iterator[pa.RecordBatch], small: int = 32) -> Iterator[pa.RecordBatch]:
    for rows, _ in _whole_scenes(batches):
        yield _match_scenes(rows, small)


def _gap_batches(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    for rows, left_out in _whole_scenes(batches, small):
        yield _gaps(rows, left_out, small)


def greedy_match(truth: DataFrame, found: DataFrame, scene: str) -> DataFrame:
    """Each true shape, in order, takes its nearest unused fit; counts and largest errors per scene.

    The choice is serial by definition and a scene is one picture.  Both sides
    are streamed in scene order, many scenes to a task, one scene in memory.
    """
    place = [F.col(c).cast("double").alias(c) for c in "xyr"]
    key = F.col(scene).cast("bigint").alias("scene")
    fits = found.select(key, F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("i"), *place)
    shapes = truth.select(key, F.lit(1).alias("side"), F.col("i").cast("bigint").alias("i"), *place)
    ordered = fits.unionByName(shapes).repartition("scene").sortWithinPartitions("scene")
    schema = "scene bigint, matched bigint, max_centre_error double, max_radius_error double"
    return ordered.mapInArrow(_match_batches, schema).withColumnRenamed("scene", scene)
