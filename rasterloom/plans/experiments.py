"""Composite reports: denoising by linear and rank filters, rotation there and back, and page restoration."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import kernels, planes
from rasterloom.operators import blocks, filters, quality
from rasterloom.operators.frames import map_rows, to_pixels
from rasterloom.sources import sinks

Plane = Callable[[np.ndarray], np.ndarray]


def noise(kind: str, amount: float, seed: int = 1) -> Plane:
    """gaussian (amount: variance) or impulse (amount: probability), as a function of a plane."""
    if kind not in ("gaussian", "impulse"):
        raise ValueError(f"no noise kind: {kind!r}")
    made = planes.gaussian_noise if kind == "gaussian" else planes.impulse_noise
    return lambda plane: made(plane, amount, seed)


def add_noise(images: DataFrame, kind: str, amount: float, seed: int = 1) -> DataFrame:
    return filters.gaussian_noise(images, amount, seed) if kind == "gaussian" else filters.impulse_noise(images, amount, seed) if kind == "impulse" else noise(kind, amount)


def _scores(images: DataFrame, noisy: Plane, height: int, width: int, made: dict[str, Plane]) -> DataFrame:
    """Original and compared sizes, and <name>_mse and <name>_psnr_db of the noisy plane and of what each function makes of it.

    All are compared over the filters' valid size, the original and the noisy plane being cut to it. A plane's noise is drawn
    once, and all its figures are made in one go: no shuffle.
    """

    def compare(plane: np.ndarray) -> dict:
        drawn = noisy(plane)
        inside = slice(height // 2, height // 2 + plane.shape[0] - height + 1), slice(width // 2, width // 2 + plane.shape[1] - width + 1)
        inner = plane[inside].astype(np.int32)
        out = {"original_width": [plane.shape[1]], "original_height": [plane.shape[0]], "width": [inner.shape[1]], "height": [inner.shape[0]]}
        for name, other in {"noisy": drawn[inside], **{n: f(drawn) for n, f in made.items()}}.items():
            off = inner - other
            out[f"{name}_mse"] = [float((off * off).sum(dtype=np.int64) / off.size)]
        return out

    names = ["noisy", *made]
    found = map_rows(images, compare, "original_width int, original_height int, width int, height int, " + ", ".join(f"{n}_mse double" for n in names))
    return found.withColumns({f"{n}_psnr_db": quality.psnr_db(F.col(f"{n}_mse")) for n in names})


def low_pass_scores(images: DataFrame, noisy: Plane, size: int, threshold: float | None = None) -> DataFrame:
    kernel = kernels.average(size)
    return _scores(images, noisy, size, size, {"filtered": (lambda p: planes.to_pixels(planes.correlate(p, kernel))) if threshold is None else (lambda p: planes.threshold_low_pass(p, kernel, threshold))})


def rank_scores(images: DataFrame, noisy: Plane, aperture, trimmed: int) -> DataFrame:
    mask = kernels.as_aperture(aperture)
    middle = kernels.rank_number("median", int(mask.sum()))
    return _scores(images, noisy, *mask.shape, {"median": lambda p: planes.rank_filter(p, mask, middle), "trimmed_mean": lambda p: planes.trimmed_mean(p, mask, trimmed)})


def low_pass_report(images: DataFrame, kind: str, amount: float, size: int, *, threshold: float | None = None, seed: int = 1) -> DataFrame:
    """Noisy and smoothed images against the original, all cut to the smoothed size."""
    return low_pass_scores(images, noise(kind, amount, seed), size, threshold)


def rank_report(images: DataFrame, kind: str, amount: float, aperture, trimmed: int, *, seed: int = 1) -> DataFrame:
    """Noisy images, their medians and trimmed means against the original, all cut to the filters' size."""
    return rank_scores(images, noise(kind, amount, seed), aperture, trimmed)


def rotation_report(images: DataFrame, degrees: float, *, timed: bool = False) -> DataFrame:
    """For each method: sizes after turning, and the error after turning back, cut to the original size.

    With timed, each method's two turns run by themselves and their seconds over all images are added.
    """
    out = None
    for method in ("nearest", "bilinear", "bicubic"):

        def compare(plane: np.ndarray, method=method) -> dict:
            begun = time.perf_counter()
            there = planes.rotate(plane, degrees, method)
            turned = time.perf_counter()
            back = planes.rotate(there, -degrees, method)
            ended = time.perf_counter()
            off = planes.crop_or_pad(back, *plane.shape).astype(np.int32) - plane
            made = {"method": [method], "rotated_width": [there.shape[1]], "rotated_height": [there.shape[0]], "mse": [float((off * off).sum() / off.size)]}
            return made | ({"rotation_ms": [1e3 * (turned - begun)], "inverse_rotation_ms": [1e3 * (ended - turned)]} if timed else {})

        schema = "method string, rotated_width int, rotated_height int, mse double" + ", rotation_ms double, inverse_rotation_ms double" * timed
        found = map_rows(images, compare, schema).withColumn("angle", F.lit(float(degrees))).withColumn("psnr_db", quality.psnr_db(F.col("mse")))
        out = found if out is None else out.unionByName(found)
    return out


def rotation_rows(images: DataFrame, degrees: float, *, timed: bool = False) -> DataFrame:
    """image_id, width, height and methods (nearest, bilinear, bicubic): a row an image; times are 0 unless timed."""
    found = rotation_report(images, degrees, timed=timed)
    found = found if timed else found.withColumns({"rotation_ms": F.lit(0.0), "inverse_rotation_ms": F.lit(0.0)})
    order = F.array_position(F.array(F.lit("nearest"), F.lit("bilinear"), F.lit("bicubic")), F.col("method")).alias("k")
    gathered = found.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in found.columns if c != "image_id"]))).alias("methods"))
    return images.select("image_id", "width", "height").join(gathered, "image_id")


def page_rows(images: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """image_id, width, height, counts, regions and blocks of page(): a row an image."""
    counts, regions, each = (sinks.nested(x, n) for x, n in ((blocks.class_counts(found["blocks"]), "counts"), (found["regions"], "regions"), (found["blocks"], "blocks")))
    return images.select("image_id", "width", "height").join(counts, "image_id").join(regions, "image_id", "left").join(each, "image_id")


def page(images: DataFrame, options: blocks.PageOptions = blocks.PageOptions()) -> dict[str, DataFrame]:
    """blocks, regions, boxes (what is restored) and restored images of scanned pages."""
    found = blocks.merge(blocks.classify(to_pixels(images), options.block_size), options.min_region_blocks, options.min_neighbors)
    boxes = blocks.processing_regions(found, options)
    return {"blocks": found, "regions": blocks.regions(found), "boxes": boxes, "restored": blocks.restore(images, boxes, options)}
