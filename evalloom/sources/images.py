"""Raster images: scanning, profiles, palette labels, ablation and scoring.

An image is one row of Spark's image source; its pixels never leave that row.
The kernels are small numpy functions that Spark maps over partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_STRUCT = "struct<height:int,width:int,nChannels:int,data:binary>"
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "webp": "52494646"}


def real_format(content: Column) -> Column:
    """Image type by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(head.startswith(MAGIC["png"]), "png")
    for kind in ("jpeg", "gif", "webp"):
        out = out.when(head.startswith(MAGIC[kind]), kind)
    return out


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """Digest, real type, whether it matches the file name, and the decoded size of every image below a root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = F.when(named == "jpg", "jpeg").otherwise(named)
    digests = raw.select(
        "path", F.sha2("content", 256).alias("sha256"), real_format(F.col("content")).alias("format"), named.alias("named")
    )
    decoded = (
        spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
        .select(F.regexp_replace("image.origin", "^file:/+", "/").alias("at"), "image.height", "image.width")
    )
    joined = digests.withColumn("at", F.regexp_replace("path", "^file:/+", "/")).join(decoded, "at", "left")
    return joined.select(
        "path", "sha256", "format", "height", "width",
        F.coalesce(F.col("format") == F.col("named"), F.lit(False)).alias("type_matches"),
        F.coalesce(F.col("height") > 0, F.lit(False)).alias("decodes"),
    )


def to_array(image) -> np.ndarray:
    """H x W x 3 array in RGB order of one image struct (stored as BGR)."""
    data = np.frombuffer(image["data"], dtype=np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    if image["nChannels"] == 1:
        return np.repeat(data, 3, axis=2)
    return data[:, :, 2::-1]


def border_colour(pixels: np.ndarray) -> np.ndarray:
    """Median colour of a border three pixels wide, fractions cut off.

    A pixel weighs one for each of the four sides it is near, so corners weigh two.
    """
    near_side = lambda n: (np.arange(n) < 3).astype(int) + (np.arange(n) >= n - 3)
    weight = near_side(pixels.shape[0])[:, None] + near_side(pixels.shape[1])[None, :]
    weighed = np.repeat(pixels.reshape(-1, pixels.shape[2]), weight.ravel(), axis=0)
    return np.median(weighed, axis=0).astype(np.uint8)


def shares(pixels: np.ndarray) -> tuple[float, float, float]:
    """Foreground share, edge share and colour entropy.

    Foreground: farther than 24 from the border colour.  Edges: steps of mean
    brightness above 18 between neighbours, across and down.  Entropy: of colours
    in eight steps a channel, over the nine bits that they take.
    """
    exact = pixels.astype(np.float32)
    away = exact - border_colour(pixels)
    foreground = np.einsum("yxc,yxc->yx", away, away) > np.float32(24 * 24)
    brightness = exact.mean(axis=2)
    jumps = [np.abs(np.diff(brightness, axis=axis)) > 18 for axis in (0, 1)]
    pairs = sum(j.size for j in jumps)
    coarse = (pixels >> 5).reshape(-1, 3) @ np.array([64, 8, 1])
    p = np.unique(coarse, return_counts=True)[1] / len(coarse)
    bits = -float(np.dot(p, np.log2(p)))
    return float(foreground.mean()), sum(int(j.sum()) for j in jumps) / pairs if pairs else 0.0, min(1.0, bits / 9)


def _map_images(images: DataFrame, ident: str, kernel: Callable[[np.ndarray], list[tuple]], columns: str) -> DataFrame:
    names = [ident, *[c.strip().split()[0] for c in columns.split(",")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a few pictures at a time: the results of a whole Arrow batch are never held as Python objects
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                rows = [
                    (key, *row) for key, image in zip(some[ident], some["image"], strict=True) for row in kernel(to_array(image))
                ]
                yield pd.DataFrame(rows, columns=names)

    kind = images.schema[ident].dataType.simpleString()
    return images.select(ident, "image").mapInPandas(run, f"{ident} {kind}, {columns}")


def image_profile(images: DataFrame, ident: str) -> DataFrame:
    return _map_images(images, ident, lambda p: [shares(p)], "foreground double, edges double, entropy double")


def palette_label(images: DataFrame, ident: str, palette: list[tuple[int, int, int]]) -> DataFrame:
    """Pixels per nearest palette colour, the first one on a tie."""
    colours = np.asarray(palette, dtype=np.float32)

    def kernel(pixels: np.ndarray) -> list[tuple]:
        far = np.linalg.norm(pixels[:, :, None, :].astype(np.float32) - colours, axis=3)
        counts = np.bincount(far.argmin(axis=2).ravel(), minlength=len(colours))
        return [(i, int(n)) for i, n in enumerate(counts)]

    return _map_images(images, ident, kernel, "label int, pixels bigint")


def block_masks(height: int, width: int, grid: int, overlap: int | None) -> np.ndarray:
    """One mask a block of the grid, row by row, widened on all sides by 1/overlap of the block's size when given."""

    def bands(length: int) -> np.ndarray:
        edge = np.arange(grid + 1) * length // grid
        size = np.diff(edge)
        halo = -(-size // overlap) if overlap else 0 * size
        at = np.arange(length)[None, :]
        return (at >= (edge[:-1] - halo)[:, None]) & (at < (edge[1:] + halo)[:, None])

    return (bands(height)[:, None, :, None] & bands(width)[None, :, None, :]).reshape(grid * grid, height, width)


def ablation_impact(
    images: DataFrame, ident: str, scorer: Callable[[np.ndarray], str], *, grid: int = 8, overlap: int | None = 4
) -> DataFrame:
    """Per image, which grid blocks change the scorer's answer, or make it fail, when painted over.

    A picture that the scorer cannot answer as it is keeps its row: no decision, the
    failure's message, and every block in error.
    """

    def answer(pixels: np.ndarray) -> tuple[str | None, str | None]:
        try:
            return str(scorer(pixels)), None
        except Exception as failure:
            return None, str(failure)

    def kernel(pixels: np.ndarray) -> list[tuple]:
        decision, failure = answer(pixels)
        impact, error = np.zeros(grid * grid), np.ones(grid * grid)
        if failure is None:
            paint = border_colour(pixels)
            painted = [answer(np.where(m[:, :, None], paint, pixels))[0] for m in block_masks(*pixels.shape[:2], grid, overlap)]
            error = np.array([float(a is None) for a in painted])
            impact = np.array([float(a is not None and a != decision) for a in painted])
        return [(decision, failure, impact.tolist(), error.tolist(), *shares(pixels))]

    columns = "decision string, failure string, impact array<double>, error array<double>, foreground double, edges double, entropy double"
    return _map_images(images, ident, kernel, columns)


def image_decision(images: DataFrame, ident: str, scorer: Callable[[np.ndarray], str]) -> DataFrame:
    """The scorer's answer per image; a failure is kept as its message."""

    def kernel(pixels: np.ndarray) -> list[tuple]:
        try:
            return [(str(scorer(pixels)), None)]
        except Exception as failure:
            return [(None, str(failure))]

    return _map_images(images, ident, kernel, "decision string, failure string")


def run_scorer(plan: DataFrame, score: Callable[[str, list[str]], tuple[str, float]], key: str = "sample_key") -> DataFrame:
    """Responses of a user scorer ``(question, candidates) -> (answer, confidence)`` over a plan, as raw JSON content."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, question, candidates in zip(batch[key], batch["question"], batch["candidates"], strict=True):
                try:
                    answer, confidence = score(question, list(candidates))
                    out.append((k, json.dumps({"answer": answer, "confidence": confidence}), None))
                except Exception as failure:
                    out.append((k, None, str(failure)[:4000]))
            yield pd.DataFrame(out, columns=[key, "content", "error"])

    kind = plan.schema[key].dataType.simpleString()
    return plan.select(key, "question", "candidates").mapInPandas(run, f"{key} {kind}, content string, error string")


def first_choice(question: str, candidates: list[str]) -> tuple[str, float]:
    """Offline stand-in: always the first choice at even confidence."""
    return candidates[0], 0.5
