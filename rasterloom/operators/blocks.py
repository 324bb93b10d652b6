"""Blocks of scanned pages: features, classes, image regions, and the halftone restoration that builds on them.

Features are sums over pixels in Catalyst; a page's grid of blocks, thousands of times smaller than the page, is then merged
in one task a page.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import kernels, planes
from rasterloom.operators.frames import IMAGES, PIXELS_RGB, planes_of

#: Fixed limits of pixel kinds: raw white, dark and midtone, and the same after a block's range is stretched.
WHITE, DARK, MIDTONE = 245, 128, (64, 245)
STRETCHED_WHITE, STRETCHED_DARK, STRETCHED_MIDTONE = 205, 85, (80, 205)
#: Share of nonwhite pixels below which a block is background.
BLANK = 0.015

FEATURES = ("white_ratio", "dark_ratio", "nonwhite_ratio", "midtone_ratio", "normalized_white_ratio", "normalized_dark_ratio", "normalized_midtone_ratio", "text_projection_score", "mean", "variance")
BLOCKS = "image_id string, row int, col int, x int, y int, width int, height int, class string, image_region_id int, image_neighbor_count int, " + ", ".join(f"{f} double" for f in FEATURES)
REGIONS = "image_id string, id int, block_count int, x int, y int, width int, height int"


@dataclass(frozen=True)
class PageOptions:
    block_size: int = 56
    min_region_blocks: int = 12
    min_neighbors: int = 1
    padding: float = 0.20
    blur_size: int = 11
    blur_sigma: float = 1.8
    sharpen_amount: float = 0.35

    def __post_init__(self):
        if self.block_size < 1 or self.min_region_blocks < 0 or self.min_neighbors < 0:
            raise ValueError("block sizes and counts must be positive")
        if not (np.isfinite(self.sharpen_amount) and self.sharpen_amount >= 0 and np.isfinite(self.padding) and self.padding >= 0):
            raise ValueError("amount and padding must be finite and not negative")
        kernels.gaussian(self.blur_size, self.blur_sigma)


def text_like(c) -> Column:
    """Stretched contrast of print: light ground, few dark pixels, dark pixels in rows."""
    return (c("normalized_white_ratio") >= 0.45) & c("normalized_dark_ratio").between(0.02, 0.45) & (c("normalized_midtone_ratio") <= 0.45) & (c("text_projection_score") >= 0.22)


def block_class(c=F.col) -> Column:
    """background, text or image by a block's features; text rules come before the image rule."""
    raw_text = (c("white_ratio") >= 0.70) & (c("nonwhite_ratio") >= BLANK) & (c("midtone_ratio") < 0.20) & (c("dark_ratio") < 0.30)
    dense_text = (
        c("white_ratio").between(0.50, 0.72) & (c("nonwhite_ratio") <= 0.55) & (c("dark_ratio") <= 0.35) & (c("midtone_ratio") <= 0.30) & (c("normalized_white_ratio") >= 0.60)
        & (c("normalized_dark_ratio") <= 0.34) & (c("normalized_midtone_ratio") <= 0.18) & (c("text_projection_score") >= 0.06)
    )
    image = (c("white_ratio") < 0.70) | (c("nonwhite_ratio") >= 0.45) | (c("midtone_ratio") >= 0.20) | (c("dark_ratio") >= 0.14)
    return F.when(c("nonwhite_ratio") < BLANK, "background").when(raw_text | text_like(c) | dense_text, "text").when(image, "image").otherwise("background")


def is_protected(c=F.col) -> Column:
    """Text, or a histogram like text's: restoration keeps off such blocks."""
    raw = (c("white_ratio") >= 0.65) & c("nonwhite_ratio").between(BLANK, 0.35) & (c("midtone_ratio") <= 0.25) & (c("dark_ratio") <= 0.35)
    return (c("class") == "text") | raw | text_like(c)


def features(pixels: DataFrame, block_size: int = 56) -> DataFrame:
    """image_id, row, col, x, y, width, height and FEATURES of each block, partial ones at the right and below included."""
    if block_size < 1:
        raise ValueError("the block size must be positive")
    placed = pixels.select("image_id", "y", "x", F.col("v").cast("int").alias("v"), F.expr(f"cast(y div {block_size} as int)").alias("row"), F.expr(f"cast(x div {block_size} as int)").alias("col"))
    block = ["image_id", "row", "col"]
    v = F.col("v")
    raw = placed.groupBy(*block).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
        F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(v * v).alias("t"),
        F.count_if(v >= WHITE).alias("white"), F.count_if(v <= DARK).alias("dark"), F.count_if((v >= MIDTONE[0]) & (v < MIDTONE[1])).alias("midtone"),
    )
    # values repeat within a line of a block: counting them first leaves less to stretch than the pixels
    counted = placed.groupBy(*block, "y", "v").agg(F.count("*").alias("k"))
    ranged = counted.join(raw.select(*block, "low", "high"), block)
    stretched = ranged.withColumn("w", F.expr("CASE WHEN high > low THEN ((v - low) * 255 + (high - low) div 2) div (high - low) ELSE v END"))
    w = F.col("w")
    amount = lambda there: F.sum(F.when(there, F.col("k")).otherwise(0))
    lines = stretched.groupBy(*block, "y").agg(amount(w >= STRETCHED_WHITE).alias("white"), amount(w <= STRETCHED_DARK).alias("dark"), amount((w >= STRETCHED_MIDTONE[0]) & (w < STRETCHED_MIDTONE[1])).alias("midtone"), F.sum("k").alias("width"))
    share = F.col("dark") / F.col("width")
    active = F.col("dark") >= F.greatest(F.lit(1.0), F.col("width") * F.lit(0.08))
    per = lines.groupBy(*block).agg(F.sum("white").alias("nw"), F.sum("dark").alias("nd"), F.sum("midtone").alias("nm"), F.avg(share).alias("a1"), F.avg(share * share).alias("a2"), F.avg(active.cast("int")).alias("active"))
    spread = F.greatest(F.lit(0.0), F.col("a2") - F.col("a1") * F.col("a1"))
    score = F.when((F.col("active") < 0.08) | (F.col("active") > 0.90), 0.0).otherwise(F.sqrt(spread) * (1 - F.abs(F.col("active") - 0.45)))
    n = F.col("n")
    return raw.join(per, block).select(
        *block, "x", "y", "width", "height",
        (F.col("white") / n).alias("white_ratio"), (F.col("dark") / n).alias("dark_ratio"), ((n - F.col("white")) / n).alias("nonwhite_ratio"), (F.col("midtone") / n).alias("midtone_ratio"),
        (F.col("nw") / n).alias("normalized_white_ratio"), (F.col("nd") / n).alias("normalized_dark_ratio"), (F.col("nm") / n).alias("normalized_midtone_ratio"),
        score.alias("text_projection_score"), (F.col("s") / n).alias("mean"), (F.col("t") / n - (F.col("s") / n) * (F.col("s") / n)).alias("variance"),
    )


def classify(pixels: DataFrame, block_size: int = 56) -> DataFrame:
    """features with class, before blocks are merged."""
    return features(pixels, block_size).withColumn("class", block_class())


def merge(classified: DataFrame, min_region_blocks: int = 12, min_neighbors: int = 1) -> DataFrame:
    """BLOCKS: image blocks numbered by region; regions too small or without a supported block fall back to their ground."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"]).reset_index(drop=True)
        shape = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        if len(pdf) != shape[0] * shape[1]:
            raise ValueError("the grid of blocks has gaps")
        image = (pdf["class"] == "image").to_numpy().reshape(shape)
        framed = np.pad(image, 1).astype(int)
        around = np.where(image, framed[:-2, 1:-1] + framed[2:, 1:-1] + framed[1:-1, :-2] + framed[1:-1, 2:], 0)
        labels = planes.label_components(image)
        size = np.bincount(labels.ravel())
        supported = np.zeros(len(size), bool)
        np.logical_or.at(supported, labels[image & (around >= min_neighbors)], True)
        kept = (size >= min_region_blocks) & supported
        kept[0] = False
        number = np.where(kept, np.cumsum(kept) - 1, -1)[labels]
        dropped = (image & (number < 0)).ravel()
        pdf["class"] = np.where(dropped, np.where(pdf["nonwhite_ratio"] < BLANK, "background", "text"), pdf["class"])
        pdf["image_region_id"] = number.ravel().astype(np.int32)
        pdf["image_neighbor_count"] = np.where(number < 0, 0, around).ravel().astype(np.int32)
        return pdf[[f.split()[0] for f in BLOCKS.split(", ")]]

    return classified.groupBy("image_id").applyInPandas(run, BLOCKS)


def regions(blocks: DataFrame) -> DataFrame:
    """REGIONS: how many blocks each image region has and the box around them."""
    inside = blocks.where("image_region_id >= 0").groupBy("image_id", F.col("image_region_id").alias("id"))
    found = inside.agg(F.count("*").cast("int").alias("block_count"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"))
    return found.select("image_id", "id", "block_count", "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"))


def class_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("image_id", "class").agg(F.count("*").alias("blocks"))


def processing_regions(blocks: DataFrame, options: PageOptions = PageOptions()) -> DataFrame:
    """REGIONS to be restored: the box of a region's unprotected image blocks, padded, but kept off protected blocks beside it.

    A region without such blocks has width and height 0. A protected block of partial height below (there are such only in a
    page's last row of blocks) pulls the bottom up by the padding besides.
    """
    page = Window.partitionBy("image_id")
    marked = blocks.withColumn("protected", is_protected()).withColumn("page_w", F.max(F.col("x") + F.col("width")).over(page)).withColumn("page_h", F.max(F.col("y") + F.col("height")).over(page))
    pad = int(np.floor(options.block_size * options.padding + 0.5))
    free = (F.col("class") == "image") & ~F.col("protected")
    own = marked.where("image_region_id >= 0").groupBy("image_id", F.col("image_region_id").alias("id")).agg(
        F.count_if(free).cast("int").alias("block_count"), F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"),
        F.min(F.when(free, F.col("x"))).alias("x0"), F.min(F.when(free, F.col("y"))).alias("y0"),
        F.max(F.when(free, F.col("x") + F.col("width"))).alias("x1"), F.max(F.when(free, F.col("y") + F.col("height"))).alias("y1"),
    )
    padded = own.withColumns({"left": F.greatest(F.col("x0") - pad, F.lit(0)), "top": F.greatest(F.col("y0") - pad, F.lit(0)), "right": F.least("page_w", F.col("x1") + pad), "bottom": F.least("page_h", F.col("y1") + pad)})
    walls = marked.where("protected").select("image_id", F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("x") + F.col("width")).alias("br"), (F.col("y") + F.col("height")).alias("bb"), (F.col("height") < options.block_size).alias("partial"))
    # only protected blocks that overlap the padded box on either axis matter
    near = padded.join(walls, "image_id", "left")
    over_x = (F.col("x0") < F.col("br")) & (F.col("bx") < F.col("x1"))
    over_y = (F.col("y0") < F.col("bb")) & (F.col("by") < F.col("y1"))
    below = over_x & (F.col("by") >= F.col("y1")) & (F.col("by") < F.col("bottom"))
    fixed = ["image_id", "id", "block_count", "left", "top", "right", "bottom"]
    pulled = near.groupBy(*fixed).agg(
        F.max(F.when(over_x & (F.col("bb") <= F.col("y0")), F.col("bb"))).alias("t"),
        F.max(F.when(over_y & (F.col("br") <= F.col("x0")), F.col("br"))).alias("l"),
        F.min(F.when(over_y & (F.col("bx") >= F.col("x1")), F.col("bx"))).alias("r"),
        F.min(F.when(below & ~F.col("partial"), F.col("by"))).alias("full"),
        F.min(F.when(below & F.col("partial"), F.when(F.col("by") > pad, F.col("by") - pad).otherwise(F.col("by")))).alias("part"),
    )
    left, top = F.greatest("left", F.coalesce("l", "left")), F.greatest("top", F.coalesce("t", "top"))
    right, bottom = F.least("right", F.coalesce("r", "right")), F.coalesce("full", "part", "bottom")
    some = F.col("block_count") > 0
    zero = F.lit(0)
    return pulled.select(
        "image_id", "id", "block_count",
        *[F.when(some, c).otherwise(zero).cast("int").alias(n) for n, c in (("x", left), ("y", top), ("width", right - left), ("height", bottom - top))],
    )


def _masked(images: DataFrame, boxes: DataFrame, function, schema: str) -> DataFrame:
    """A function of plane and mask (the union of an image's boxes), for each image; images without boxes have an empty mask."""
    each = boxes.where("width > 0 and height > 0").groupBy("image_id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("boxes"))
    rows = images.select("image_id", "width", "height", "pixels").join(each, "image_id", "left")

    full = T.StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in batches:
            for (name, plane), boxed in zip(planes_of(batch), batch.column("boxes"), strict=True):
                mask = np.zeros(plane.shape, bool)
                for b in boxed.as_py() or []:
                    mask[b["y"] : b["y"] + b["height"], b["x"] : b["x"] + b["width"]] = True
                made = function(plane, mask)
                n = len(next(iter(made.values())))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), *[pa.array(made[f.name], f.type) for f in list(arrow)[1:]]], schema=arrow)

    return rows.mapInArrow(run, full)


def restore(images: DataFrame, boxes: DataFrame, options: PageOptions = PageOptions()) -> DataFrame:
    """images blurred and sharpened within the boxes; other pixels stay."""
    kernel = kernels.gaussian(options.blur_size, options.blur_sigma)

    def run(plane: np.ndarray, mask: np.ndarray) -> dict:
        out = planes.masked_sharpen(planes.masked_blur(plane, mask, kernel), mask, options.sharpen_amount)
        return {"width": [plane.shape[1]], "height": [plane.shape[0]], "pixels": [np.ascontiguousarray(out).tobytes()]}

    return _masked(images, boxes, run, IMAGES)


def overlays(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """pixels_rgb of images with the boxes blended in red: image blocks, or what is restored."""

    def run(plane: np.ndarray, mask: np.ndarray) -> dict:
        rgb = planes.overlay(plane, mask).reshape(-1, 3).astype(np.int16)
        y, x = np.divmod(np.arange(plane.size, dtype=np.int32), plane.shape[1])
        return {"y": y, "x": x, "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]}

    return _masked(images, boxes, run, PIXELS_RGB)


def image_blocks(blocks: DataFrame) -> DataFrame:
    """The boxes of blocks of class image."""
    return blocks.where(F.col("class") == "image").select("image_id", "x", "y", "width", "height")
