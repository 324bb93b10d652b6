"""Gray-level co-occurrence: ordered pairs of a pixel and the one (dr, dc) away, counted by value."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.frames import map_rows


def cooccurrence(pixels: DataFrame, dr: int, dc: int) -> DataFrame:
    """image_id, dr, dc, first, second, cnt of pixels. Within a row it looks ahead in a window, else it joins on places."""
    if dr == 0:
        row = Window.partitionBy("image_id", "y").orderBy("x")
        pairs = pixels.select("image_id", F.col("v").alias("first"), F.lead("v", dc).over(row).alias("second")).where("second is not null")
    else:
        there = pixels.select("image_id", (F.col("y") - dr).alias("y"), (F.col("x") - dc).alias("x"), F.col("v").alias("second"))
        pairs = pixels.withColumnRenamed("v", "first").join(there, ["image_id", "y", "x"])
    counted = pairs.groupBy("image_id", "first", "second").agg(F.count("*").alias("cnt"))
    return counted.select("image_id", F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), "first", "second", "cnt")


def cooccurrence_of_images(images: DataFrame, dr: int, dc: int) -> DataFrame:
    """The same of whole planes, without a shuffle."""

    def count(plane: np.ndarray) -> dict[str, np.ndarray]:
        h, w = plane.shape
        y0, y1, x0, x1 = max(0, -dr), min(h, h - dr), max(0, -dc), min(w, w - dc)
        if y0 >= y1 or x0 >= x1:
            cells = np.zeros(0, np.int64)
            counts = cells
        else:
            pairs = plane[y0:y1, x0:x1].astype(np.int64) << 8 | plane[y0 + dr : y1 + dr, x0 + dc : x1 + dc]
            counts = np.bincount(pairs.ravel(), minlength=1 << 16)
            cells = np.flatnonzero(counts)
            counts = counts[cells]
        n = len(cells)
        return {"dr": np.full(n, dr, np.int32), "dc": np.full(n, dc, np.int32), "first": (cells >> 8).astype(np.int16), "second": (cells & 255).astype(np.int16), "cnt": counts}

    return map_rows(images, count, "dr int, dc int, first smallint, second smallint, cnt long")


def probabilities(glcm: DataFrame) -> DataFrame:
    """glcm with total_pairs and p."""
    whole = F.sum("cnt").over(Window.partitionBy("image_id", "dr", "dc"))
    return glcm.withColumn("total_pairs", whole).withColumn("p", F.col("cnt") / F.col("total_pairs"))


def energy(glcm: DataFrame) -> DataFrame:
    """Sum of squared probabilities."""
    sums = glcm.groupBy("image_id", "dr", "dc").agg(F.sum("cnt").alias("total_pairs"), F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("squares"))
    return sums.select("image_id", "dr", "dc", "total_pairs", (F.col("squares") / F.col("total_pairs") / F.col("total_pairs")).alias("energy"))


def rendered(glcm: DataFrame) -> DataFrame:
    """pixels of 256 x 256: y is the first value, x the second, darker for more pairs."""
    each = glcm.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("first").cast("int") * 256 + F.col("second")).alias("k"), "cnt"))).alias("m"), F.max("cnt").alias("top"))
    dense = each.select("image_id", "top", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(65535)), lambda k: F.lit(0))).alias("k", "zero"))
    found = glcm.groupBy("image_id", (F.col("first").cast("int") * 256 + F.col("second")).alias("k")).agg(F.sum("cnt").alias("cnt"))
    cells = dense.select("image_id", "top", "k").join(found, ["image_id", "k"], "left")
    shade = 255 - F.round(F.coalesce("cnt", F.lit(0)) / F.col("top") * 255)
    return cells.select("image_id", F.expr("cast(k div 256 as int)").alias("y"), (F.col("k") % 256).cast("int").alias("x"), shade.cast("smallint").alias("v"))
