"""4-connected components: labels, areas, boxes, moments, round ones, and pictures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import planes
from rasterloom.operators.frames import PIXELS_RGB, map_rows

#: Smallest area (exclusive) and largest deviation of round components.
MIN_AREA, ROUNDNESS = 30, 0.02


def labels(images: DataFrame) -> DataFrame:
    """image_id, y, x, label of the pixels that aren't 0, numbered from 1 by their components' first pixels."""

    def number(plane: np.ndarray) -> dict[str, np.ndarray]:
        found = planes.label_components(plane > 0)
        y, x = np.nonzero(found)
        return {"y": y.astype(np.int32), "x": x.astype(np.int32), "label": found[y, x]}

    return map_rows(images, number, "y int, x int, label int")


def components(labelled: DataFrame) -> DataFrame:
    """Area, box, raw moments, centroid and central moments of each label; sums are exact integers before they are divided."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    sums = labelled.groupBy("image_id", "label").agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    n = F.col("area")
    return sums.select(
        "image_id", "label", "area", "min_x", "min_y", "max_x", "max_y",
        n.cast("double").alias("m00"), F.col("sx").cast("double").alias("m10"), F.col("sy").cast("double").alias("m01"),
        (F.col("sx") / n).alias("centroid_x"), (F.col("sy") / n).alias("centroid_y"),
        (F.col("sxx") - F.col("sx").cast("double") * F.col("sx") / n).alias("mu20"),
        (F.col("syy") - F.col("sy").cast("double") * F.col("sy") / n).alias("mu02"),
        (F.col("sxy") - F.col("sx").cast("double") * F.col("sy") / n).alias("mu11"),
    )


def round_components(found: DataFrame, *, min_area: int = MIN_AREA, max_deviation: float = ROUNDNESS) -> DataFrame:
    """Components larger than min_area whose second moments are nearly a disc's, with roundness_kr2 and roundness_deviation."""
    kr2 = 2 * math.pi * (F.col("mu20") + F.col("mu02")) / (F.col("area").cast("double") * F.col("area"))
    scored = found.withColumn("roundness_kr2", kr2).withColumn("roundness_deviation", F.abs(F.col("roundness_kr2") - 1))
    return scored.where((F.col("area") > min_area) & (F.col("roundness_deviation") <= max_deviation))


def label_greys(labelled: DataFrame) -> DataFrame:
    """image_id, y, x, v of labelled pixels; others are 0 and not listed."""
    return labelled.select("image_id", "y", "x", (F.col("label").cast("long") * 37 % 255 + 1).cast("smallint").alias("v"))


def label_colours(labelled: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """pixels_rgb of labelled pixels; with a selection (image_id, label), other components are grey."""
    colours = F.array(*[F.array(*[F.lit(int(c)) for c in colour]) for colour in planes.PALETTE])
    colour = F.get(colours, (F.col("label") - 1) % len(planes.PALETTE))
    rows = labelled
    if selected is not None:
        rows = rows.join(selected.select("image_id", "label", F.lit(True).alias("chosen")), ["image_id", "label"], "left")
        colour = F.when(F.col("chosen"), colour).otherwise(F.array(*[F.lit(c) for c in planes.OTHER_LABEL]))
    painted = rows.select("image_id", "y", "x", colour.alias("c"))
    return painted.select("image_id", "y", "x", *[F.get("c", k).cast("smallint").alias(n) for k, n in enumerate("rgb")])


def label_pictures(images: DataFrame, selected: dict | None = None) -> DataFrame:
    """pixels_rgb of whole planes, background included."""

    def paint(plane: np.ndarray) -> dict[str, np.ndarray]:
        rgb = planes.label_colours(planes.label_components(plane > 0), selected)
        y, x = np.divmod(np.arange(plane.size, dtype=np.int32), plane.shape[1])
        flat = rgb.reshape(-1, 3).astype(np.int16)
        return {"y": y, "x": x, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]}

    return map_rows(images, paint, PIXELS_RGB.partition(", ")[2])
