"""Mean squared error and peak signal-to-noise ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def psnr_db(mse: Column) -> Column:
    """Infinity for equal images."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(255 / F.sqrt(mse)))


def quality(original: DataFrame, distorted: DataFrame) -> DataFrame:
    """image_id, width, height, mse, psnr_db of pixels joined by image and place; images of other sizes raise an error."""
    other = distorted.select("image_id", "y", "x", F.col("v").alias("w"))
    pairs = original.join(other, ["image_id", "y", "x"], "full")
    off = F.col("v").cast("int") - F.col("w")
    found = pairs.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sum((off * off).cast("long")).alias("s"), F.count("*").alias("n"), F.count(off).alias("both"))
    mse = F.when(F.col("n") == F.col("both"), F.col("s") / F.col("n")).otherwise(F.raise_error(F.concat(F.lit("images of different sizes: "), "image_id")).cast("double"))
    return found.select("image_id", "width", "height", mse.alias("mse")).withColumn("psnr_db", psnr_db(F.col("mse")))


def quality_of_images(original: DataFrame, distorted: DataFrame) -> DataFrame:
    """The same of whole planes, joined by image: one row an image is shuffled, not one a pixel."""
    import numpy as np
    import pyarrow as pa

    names = ("image_id", "width", "height", "pixels")
    other = distorted.select(F.col("image_id"), *[F.col(c).alias(f"other_{c}") for c in names[1:]])
    pairs = original.select(*names).join(other, "image_id")

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if (row["width"], row["height"]) != (row["other_width"], row["other_height"]):
                    raise ValueError(f"images of different sizes: {row['image_id']}")
                off = np.frombuffer(row["pixels"], np.uint8).astype(np.int32) - np.frombuffer(row["other_pixels"], np.uint8)
                yield pa.record_batch({"image_id": [row["image_id"]], "width": pa.array([row["width"]], pa.int32()), "height": pa.array([row["height"]], pa.int32()), "mse": [float((off * off).sum(dtype=np.int64) / off.size)]})

    return pairs.mapInArrow(compare, "image_id string, width int, height int, mse double").withColumn("psnr_db", psnr_db(F.col("mse")))
