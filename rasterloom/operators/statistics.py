"""Brightness histograms and what follows from them, over pixels, in Catalyst expressions.

Only the histogram looks at pixels (with partial counts before its shuffle); everything else works on 256 rows an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _image():
    return Window.partitionBy("image_id")


def _upto():
    """All bins up to the present one."""
    return _image().orderBy("bin")


def sparse_histogram(pixels: DataFrame) -> DataFrame:
    """image_id, bin, cnt for the bins that occur."""
    return pixels.groupBy("image_id", F.col("v").alias("bin")).agg(F.count("*").alias("cnt"))


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, bin, cnt for all 256 bins of each image."""
    counts = F.map_from_entries(F.collect_list(F.struct("bin", "cnt")))
    each = sparse_histogram(pixels).groupBy("image_id").agg(counts.alias("counts"))
    dense = each.select("image_id", "counts", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("b"))
    return dense.select("image_id", F.col("b").cast("smallint").alias("bin"), F.coalesce(F.element_at("counts", F.col("b").cast("smallint")), F.lit(0)).alias("cnt"))


def nearest_rank(share: float, upto: Column, total: Column) -> Column:
    """The first bin whose running count reaches the rank."""
    return F.min(F.when(upto >= F.greatest(F.lit(1), F.ceil(total * share)), F.col("bin"))).cast("double")


def from_histogram(counts: DataFrame) -> DataFrame:
    """mean, variance (of the population), q1, q2, q3, entropy, energy, skewness and excess kurtosis, a row an image.

    Skewness and kurtosis are 0 where the variance is.
    """
    rows = counts.where("cnt > 0").select("image_id", "bin", "cnt", F.sum("cnt").over(_image()).alias("n"), F.sum(F.col("bin") * F.col("cnt")).over(_image()).alias("s"), F.sum("cnt").over(_upto()).alias("upto"))
    off, p = F.col("bin") - F.col("s") / F.col("n"), F.col("cnt") / F.col("n")
    rows = rows.select("image_id", "bin", "n", "upto", (F.col("s") / F.col("n")).alias("mean"), p.alias("p"), off.alias("off"))
    power = lambda k: F.sum(F.pow("off", F.lit(k)) * F.col("p"))
    found = rows.groupBy("image_id").agg(
        F.max("n").alias("pixels"),
        F.max("mean").alias("mean"),
        power(2).alias("variance"),
        *[nearest_rank(k / 4, F.col("upto"), F.col("n")).alias(f"q{k}") for k in (1, 2, 3)],
        (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
        F.sum(F.col("p") * F.col("p")).alias("energy"),
        power(3).alias("m3"),
        power(4).alias("m4"),
    )
    flat = F.col("variance") == 0
    return found.select(
        "image_id", "pixels", "mean", "variance", "q1", "q2", "q3", "entropy", "energy",
        F.when(flat, 0.0).otherwise(F.col("m3") / F.pow("variance", F.lit(1.5))).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.col("m4") / F.pow("variance", F.lit(2.0)) - 3.0).alias("kurtosis"),
    )


def statistics(pixels: DataFrame) -> DataFrame:
    return from_histogram(sparse_histogram(pixels))


def otsu(pixels: DataFrame) -> DataFrame:
    """The threshold of the largest variance between the classes (the smallest on ties), and both classes' figures.

    An image of one value has threshold 0, no second class and no variance.
    """
    rows = sparse_histogram(pixels)
    s = F.col("bin") * F.col("cnt")
    rows = rows.select(
        "image_id", F.col("bin").cast("int").alias("bin"), "cnt",
        F.sum("cnt").over(_upto()).alias("n0"), F.sum(s).over(_upto()).alias("s0"), F.sum(s * F.col("bin")).over(_upto()).alias("t0"),
        F.sum("cnt").over(_image()).alias("n"), F.sum(s).over(_image()).alias("s"), F.sum(s * F.col("bin")).over(_image()).alias("t"),
    )
    rows = rows.withColumn("n1", F.col("n") - F.col("n0"))
    p0, p1 = F.col("n0") / F.col("n"), F.col("n1") / F.col("n")
    mean0, mean1 = F.col("s0") / F.col("n0"), F.try_divide(F.col("s") - F.col("s0"), F.col("n1"))
    rows = rows.withColumns({"p0": p0, "p1": p1, "mean0": mean0, "mean1": F.coalesce(mean1, F.lit(0.0))})
    between = F.when(F.col("n1") > 0, F.col("p0") * F.col("p1") * (F.col("mean0") - F.col("mean1")) * (F.col("mean0") - F.col("mean1"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("between_var", between)
    # only bins that occur can begin a new maximum; one class only counts where there is no other choice
    best = rows.groupBy("image_id").agg(F.max_by(F.struct(*rows.columns[1:]), F.struct((F.col("n1") > 0).alias("two"), "between_var", -F.col("bin"))).alias("b")).select("image_id", "b.*")
    var0 = F.col("t0") / F.col("n0") - F.col("mean0") * F.col("mean0")
    var1 = F.coalesce(F.try_divide(F.col("t") - F.col("t0"), F.col("n1")), F.lit(0.0)) - F.col("mean1") * F.col("mean1")
    one = F.col("n1") == 0
    return best.select(
        "image_id",
        F.when(one, 0).otherwise(F.col("bin")).cast("smallint").alias("threshold"),
        "n0", "n1", "p0", "p1", "mean0", "mean1",
        F.when(one, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("p0") * var0 + F.col("p1") * var1)).alias("within_var"),
        "between_var",
    )


def binarize(pixels: DataFrame, threshold: Column | int) -> DataFrame:
    """0 up to the threshold, 255 above."""
    return pixels.withColumn("v", F.when(F.col("v") <= threshold, 0).otherwise(255).cast("smallint"))


def otsu_binarize(pixels: DataFrame) -> DataFrame:
    """pixels by their own image's threshold."""
    found = otsu(pixels).select("image_id", "threshold")
    return binarize(pixels.join(found, "image_id"), F.col("threshold")).select("image_id", "y", "x", "v")


def histogram_images(counts: DataFrame, *, width: int = 512, height: int = 256) -> DataFrame:
    """images of dense or sparse histograms: black bars on white."""
    import numpy as np
    import pandas as pd

    from rasterloom.functions.planes import histogram_image
    from rasterloom.operators.frames import IMAGES

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros(256, np.int64)
        dense[pdf["bin"].to_numpy()] = pdf["cnt"].to_numpy()
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "width": [width], "height": [height], "pixels": [histogram_image(dense, width, height).tobytes()]})

    return counts.select("image_id", "bin", "cnt").groupBy("image_id").applyInPandas(draw, IMAGES)
