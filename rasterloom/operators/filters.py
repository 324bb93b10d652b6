"""Noise, linear and rank filters, and geometry, on whole planes; and the same neighbourhoods over pixels.

The plane forms need no shuffle. The pixel forms (`*_pixels`) send each pixel to the windows that it is in and add up; they
take images larger than a task's memory, at the price of a shuffle of one partial sum a pixel and map task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import kernels, planes
from rasterloom.operators.frames import clamp, deal_out, lines_to_pixels, map_lines, map_planes, map_rows, plane_rows


def gaussian_noise(images: DataFrame, variance: float, seed: int = 1) -> DataFrame:
    return map_planes(images, lambda p: planes.gaussian_noise(p, variance, seed))


def impulse_noise(images: DataFrame, probability: float, seed: int = 1) -> DataFrame:
    return map_planes(images, lambda p: planes.impulse_noise(p, probability, seed))


def response(images: DataFrame, kernel) -> DataFrame:
    """image_id, y, x, r: the signed response."""
    kernel = kernels.as_kernel(kernel)
    return map_rows(images, lambda p: plane_rows(planes.correlate(p, kernel), "r"), "y int, x int, r double")


def convolve(images: DataFrame, kernel) -> DataFrame:
    kernel = kernels.as_kernel(kernel)
    return map_planes(images, lambda p: planes.to_pixels(planes.correlate(p, kernel)))


def low_pass(images: DataFrame, size: int) -> DataFrame:
    return convolve(images, kernels.average(size))


def threshold_low_pass(images: DataFrame, size: int, threshold: float) -> DataFrame:
    kernel = kernels.average(size)
    return map_planes(images, lambda p: planes.threshold_low_pass(p, kernel, threshold))


def sharpen(images: DataFrame, size: int = 5, amount: float = 1.0) -> DataFrame:
    return convolve(images, kernels.sharpening(size, amount))


def magnitude(images: DataFrame, kernel) -> DataFrame:
    kernel = kernels.as_kernel(kernel)
    return map_planes(images, lambda p: planes.magnitude(planes.correlate(p, kernel)))


def laplacian(images: DataFrame, size: int = 3, neighbours: str = "four") -> DataFrame:
    return magnitude(images, kernels.laplacian(size, neighbours))


def laplacian_of_gaussian(images: DataFrame, size: int, sigma: float) -> DataFrame:
    return magnitude(images, kernels.laplacian_of_gaussian(size, sigma))


def zero_crossing(images: DataFrame, size: int, sigma: float, threshold: float | None = None) -> DataFrame:
    """Edges of the Laplacian of Gaussian; the threshold follows from each image's responses if none is given."""
    kernel = kernels.laplacian_of_gaussian(size, sigma)

    def edges(plane: np.ndarray) -> np.ndarray:
        found = planes.correlate(plane, kernel)
        return planes.zero_crossings(found, planes.zero_crossing_threshold(found) if threshold is None else threshold)

    return map_planes(images, edges)


def zero_crossing_report(images: DataFrame, size: int, sigma: float) -> DataFrame:
    """threshold, edge_width, edge_height, edge_pixels of each image."""
    kernel = kernels.laplacian_of_gaussian(size, sigma)

    def count(plane: np.ndarray) -> dict[str, np.ndarray]:
        found = planes.correlate(plane, kernel)
        limit = planes.zero_crossing_threshold(found)
        edges = planes.zero_crossings(found, limit)
        return {"threshold": np.array([limit]), "edge_width": np.array([edges.shape[1]], np.int32), "edge_height": np.array([edges.shape[0]], np.int32), "edge_pixels": np.array([np.count_nonzero(edges)])}

    return map_rows(images, count, "threshold double, edge_width int, edge_height int, edge_pixels long")


def rank_filter(images: DataFrame, aperture, rank: str | int) -> DataFrame:
    mask = kernels.as_aperture(aperture)
    number = kernels.rank_number(rank, int(mask.sum()))
    return map_planes(images, lambda p: planes.rank_filter(p, mask, number))


def trimmed_mean(images: DataFrame, aperture, trimmed: int) -> DataFrame:
    mask = kernels.as_aperture(aperture)
    return map_planes(images, lambda p: planes.trimmed_mean(p, mask, trimmed))


def morphology(images: DataFrame, aperture, operation: str) -> DataFrame:
    mask = kernels.as_aperture(aperture)
    if operation not in kernels.MORPHOLOGY:
        raise ValueError(f"no morphological operation: {operation!r}")
    name = kernels.MORPHOLOGY[operation]
    return map_planes(images, lambda p: planes.morphology(p, mask, name))


def rotate(images: DataFrame, degrees: float, method: str = "bilinear", background: int = 0) -> DataFrame:
    planes.rotated_box(1, 1, degrees)  # so that a bad angle fails here

    def turn(plane: np.ndarray) -> np.ndarray:
        height, width = planes.rotated_box(*plane.shape, degrees)[2:]
        if height * width > MOST_BYTES:
            raise ValueError(f"the turned canvas of {width} x {height} is larger than a value may be: take rotate_to_pixels")
        return planes.rotate(plane, degrees, method, background)

    return map_planes(images, turn)


#: Bytes of the largest plane that a row holds.
MOST_BYTES = (1 << 31) - 16


def rotate_to_pixels(images: DataFrame, degrees: float, method: str = "bilinear", background: int = 0) -> DataFrame:
    """pixels of the turned images. No task holds a canvas, which for a long narrow image has the square of its length."""
    planes.rotated_box(1, 1, degrees)
    lines = map_lines(images, lambda p: (planes.rotated_box(*p.shape, degrees)[3], planes.rotated_lines(p, degrees, method, background)))
    return lines_to_pixels(lines, background)


def crop_or_pad(images: DataFrame, height: int, width: int, background: int = 0) -> DataFrame:
    return map_planes(images, lambda p: planes.crop_or_pad(p, height, width, background))


def crop_border(images: DataFrame, height: int, width: int) -> DataFrame:
    """The middle of each image without a border: smaller by what a window of this size drops."""
    return map_planes(images, lambda p: planes.crop_or_pad(p, p.shape[0] - height + 1, p.shape[1] - width + 1))


def _windows(pixels: DataFrame, cells: list[tuple[int, int, float]], height: int, width: int) -> DataFrame:
    """A row for each pixel and window that it is in: image_id, y, x (of the window), w, v; windows are cut to valid ones."""
    taps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in cells])
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    sized = pixels.join(F.broadcast(size) if _few(size) else size, "image_id")
    spread = sized.select("image_id", "y", "x", "v", "width", "height", F.explode(taps).alias("t"))
    spread = spread.select("image_id", (F.col("y") - F.col("t.dy")).alias("y"), (F.col("x") - F.col("t.dx")).alias("x"), F.col("t.w").alias("w"), "v", "width", "height")
    return spread.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") <= F.col("height") - height) & (F.col("x") <= F.col("width") - width))


#: Images up to which the table of their sizes is broadcast.
BROADCAST_IMAGES = 100_000


def _few(sizes: DataFrame) -> bool:
    return sizes.limit(BROADCAST_IMAGES + 1).count() <= BROADCAST_IMAGES


def response_pixels(pixels: DataFrame, kernel) -> DataFrame:
    """image_id, y, x, r of pixels."""
    kernel = kernels.as_kernel(kernel)
    cells = [(dy, dx, kernel[dy, dx]) for dy in range(kernel.shape[0]) for dx in range(kernel.shape[1])]
    return _windows(pixels, cells, *kernel.shape).groupBy("image_id", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("r"))


def convolve_pixels(pixels: DataFrame, kernel) -> DataFrame:
    return response_pixels(pixels, kernel).select("image_id", "y", "x", clamp(F.col("r")).alias("v"))


def extreme_pixels(pixels: DataFrame, aperture, operation: str) -> DataFrame:
    """Erosion or dilation of pixels."""
    mask = kernels.as_aperture(aperture)
    pick: Column = {"erosion": F.min("v"), "dilation": F.max("v")}[kernels.MORPHOLOGY[operation]]
    cells = [(int(dy), int(dx), 0.0) for dy, dx in np.argwhere(mask)]
    return _windows(pixels, cells, *mask.shape).groupBy("image_id", "y", "x").agg(pick.cast("smallint").alias("v"))


def zero_crossing_threshold(responses: DataFrame) -> DataFrame:
    """image_id, threshold of a table of responses."""
    return responses.groupBy("image_id").agg((3 * F.sum(F.abs("r")) / (4 * F.count("*"))).alias("threshold"))


def zero_crossings_pixels(responses: DataFrame, thresholds: DataFrame) -> DataFrame:
    """pixels of the edges: looks one row and one column to each side."""
    rows = Window.partitionBy("image_id", "y").orderBy("x")
    columns = Window.partitionBy("image_id", "x").orderBy("y")
    near = responses.withColumns({"west": F.lag("r").over(rows), "east": F.lead("r").over(rows)}).withColumns({"north": F.lag("r").over(columns), "south": F.lead("r").over(columns)})
    limited = near.join(thresholds, "image_id")
    crosses = lambda n: (F.signum("r") * F.signum(n) < 0) & (F.abs(F.col("r") - F.col(n)) >= F.col("threshold"))
    edge = F.coalesce(crosses("west"), F.lit(False)) | F.coalesce(crosses("east"), F.lit(False)) | F.coalesce(crosses("north"), F.lit(False)) | F.coalesce(crosses("south"), F.lit(False))
    return limited.select("image_id", "y", "x", F.when(edge, 255).otherwise(0).cast("smallint").alias("v"))


def rotate_pixels(pixels: DataFrame, degrees: float, method: str = "bilinear", background: int = 0) -> DataFrame:
    """pixels turned about their image's centre: each place of the output asks for the 1, 4 or 16 source pixels around it.

    A place whose source lies outside, and taps outside, are background. The sizes of the output are worked out per image.
    Only places over the image ask; the canvas of a long narrow image has the square of its length, and isn't shuffled.
    """
    planes.rotated_box(1, 1, degrees)
    if method not in ("nearest", "bilinear", "bicubic"):
        raise ValueError("the method must be nearest, bilinear or bicubic")
    turn = math.radians(degrees)
    c, s = F.lit(math.cos(turn)), F.lit(math.sin(turn))
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    half_w, half_h = F.col("w") / 2, F.col("h") / 2
    xs = [a * half_w * c + b * half_h * s for a in (-1, 1) for b in (-1, 1)]
    ys = [-(a * half_w) * s + b * half_h * c for a in (-1, 1) for b in (-1, 1)]
    box = size.select("image_id", "w", "h", F.least(*xs).alias("left"), F.least(*ys).alias("top"), *[F.greatest(F.lit(1), F.ceil(F.greatest(*v) - F.least(*v) - 1e-9)).cast("int").alias(n) for n, v in (("ow", xs), ("oh", ys))])
    lines = box.select("*", F.explode(F.sequence(F.lit(0), F.col("oh") - 1)).alias("y"))
    near, far = zip(*planes.turned_limits(math.cos(turn), math.sin(turn), F.col("top") + F.col("y") + 0.5, F.col("h"), F.col("w")), strict=True)
    on_canvas = lambda v: F.greatest(F.lit(0), F.least(F.col("ow"), v)).cast("int")
    first, last = F.floor(F.greatest(F.lit(-math.inf), *near) - F.col("left") - 0.5), F.ceil(F.least(F.lit(math.inf), *far) - F.col("left") + 0.5)
    # lines are dealt out before they are spread, so that one image's places don't begin in one task
    dealt = deal_out(lines.select("*", on_canvas(first).alias("first"), on_canvas(last).alias("last")), "image_id", "y")
    tx, ty = F.col("left") + F.col("x") + 0.5, F.col("top") + F.col("y") + 0.5
    sx, sy = tx * c - ty * s + F.col("w") / 2 - 0.5, tx * s + ty * c + F.col("h") / 2 - 0.5
    if method == "nearest":
        sx, sy = F.floor(sx + 0.5), F.floor(sy + 0.5)
    over = (F.col("x") >= F.col("first")) & (F.col("x") < F.col("last")) & (sx >= 0) & (sy >= 0) & (sx <= F.col("w") - 1) & (sy <= F.col("h") - 1)
    beside = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("ow") - 1)).alias("x")).where(~over).select("image_id", "y", "x", F.lit(background).cast("smallint").alias("v"))
    grid = dealt.where("first < last").select("*", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("x")).where(over)
    at = grid.select("image_id", "y", "x", sx.alias("sx"), sy.alias("sy"))
    source = pixels.select("image_id", F.col("y").alias("row"), F.col("x").alias("col"), F.col("v").cast("int").alias("v"))
    if method == "nearest":
        asked = at.select("image_id", "y", "x", F.col("sy").cast("int").alias("row"), F.col("sx").cast("int").alias("col"))
        return asked.join(source, ["image_id", "row", "col"], "left").select("image_id", "y", "x", F.coalesce("v", F.lit(background)).cast("smallint").alias("v")).unionAll(beside)
    reach = range(0, 2) if method == "bilinear" else range(-1, 3)

    def weights(t: Column) -> list[Column]:
        if method == "bilinear":
            return [1 - t, t]
        return [-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]

    across, down = weights(F.col("sx") - F.floor("sx")), weights(F.col("sy") - F.floor("sy"))
    taps = F.array(*[F.struct((F.floor("sy") + b).cast("int").alias("row"), (F.floor("sx") + a).cast("int").alias("col"), (across[i] * down[j]).alias("weight")) for j, b in enumerate(reach) for i, a in enumerate(reach)])
    asked = at.select("image_id", "y", "x", F.explode(taps).alias("t")).select("image_id", "y", "x", "t.*")
    met = asked.join(source, ["image_id", "row", "col"], "left")
    total = F.sum(F.col("weight") * F.coalesce("v", F.lit(background)))
    # sums of products in any order: what only their last bits differ in is one value before it is rounded
    return met.groupBy("image_id", "y", "x").agg(total.alias("v")).select("image_id", "y", "x", clamp(F.round("v", 9)).alias("v")).unionAll(beside)


def count_edges(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.count_if(F.col("v") != 0).alias("edge_pixels"))
