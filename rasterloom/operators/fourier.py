"""Fourier transforms of signals and planes, and their pictures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import planes
from rasterloom.operators.frames import IMAGES, map_planes, map_rows

#: Samples up to which the transform may be written as a join.
MOST_DFT = 64


def _samples(table: pa.Table) -> np.ndarray:
    return table.column("value").to_numpy().astype(float)[np.argsort(table.column("idx").to_numpy(), kind="stable")]


def signal_spectrum(signals: DataFrame) -> DataFrame:
    """signal_id, k, re, im: the transform of each signal, zero-padded to a power of two."""

    def transform(table: pa.Table) -> pa.Table:
        found = planes.fft_signal(_samples(table))
        return pa.table({"signal_id": pa.array([table.column("signal_id")[0].as_py()] * len(found)), "k": np.arange(len(found), dtype=np.int32), "re": found.real, "im": found.imag})

    return signals.select("signal_id", "idx", "value").groupBy("signal_id").applyInArrow(transform, "signal_id string, k int, re double, im double")


def signal_dft(signals: DataFrame, n: int) -> DataFrame:
    """The same of signals of at most n <= 64 samples as sums of SQL: each sample goes to the n bins."""
    if not 0 < n <= MOST_DFT or n & (n - 1):
        raise ValueError(f"n must be a power of two up to {MOST_DFT}")
    spread = signals.select("signal_id", "idx", "value", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    turn = 2 * F.pi() * ((F.col("k") * F.col("idx")) % n) / n
    return spread.groupBy("signal_id", "k").agg(F.sum(F.col("value") * F.cos(turn)).alias("re"), F.sum(-F.col("value") * F.sin(turn)).alias("im"))


def log_amplitudes(spectrum: DataFrame, n: int) -> DataFrame:
    """signal_id, k (shifted so that frequency zero is in the middle), amplitude."""
    return spectrum.select("signal_id", F.expr(f"cast((k + {n} div 2) % {n} as int)").alias("k"), F.log1p(F.hypot("re", "im")).alias("amplitude"))


def image_spectrum(images: DataFrame) -> DataFrame:
    """image_id, v (row), u (column), re, im of each image, zero-padded to a square."""

    def transform(plane: np.ndarray) -> dict[str, np.ndarray]:
        found = planes.fft_plane(plane)
        v, u = np.divmod(np.arange(found.size, dtype=np.int32), found.shape[1])
        return {"v": v, "u": u, "re": found.real.ravel(), "im": found.imag.ravel()}

    return map_rows(images, transform, "v int, u int, re double, im double")


def image_spectrum_pixels(pixels: DataFrame, size: int) -> DataFrame:
    """The same of pixels, for images up to size (a power of two) in width and height: rows first, then columns.

    A task holds one row or one column at a time, so an image may be larger than any task's memory.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("the size must be a power of two")

    def rows(table: pa.Table) -> pa.Table:
        line = np.zeros(size)
        line[table.column("x").to_numpy()] = table.column("v").to_numpy()
        found = np.fft.fft(line)
        name, y = table.column("image_id")[0].as_py(), table.column("y")[0].as_py()
        return pa.table({"image_id": pa.array([name] * size), "y": pa.array(np.full(size, y, np.int32)), "u": np.arange(size, dtype=np.int32), "re": found.real, "im": found.imag})

    def columns(table: pa.Table) -> pa.Table:
        line = np.zeros(size, complex)
        line[table.column("y").to_numpy()] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        found = np.fft.fft(line)
        name, u = table.column("image_id")[0].as_py(), table.column("u")[0].as_py()
        return pa.table({"image_id": pa.array([name] * size), "v": np.arange(size, dtype=np.int32), "u": pa.array(np.full(size, u, np.int32)), "re": found.real, "im": found.imag})

    lines = pixels.select("image_id", "y", "x", "v").groupBy("image_id", "y").applyInArrow(rows, "image_id string, y int, u int, re double, im double")
    return lines.groupBy("image_id", "u").applyInArrow(columns, "image_id string, v int, u int, re double, im double")


def image_spectrum_images(images: DataFrame) -> DataFrame:
    """images of the shifted log amplitudes."""
    return map_planes(images, planes.plane_spectrum_image)


def _drawn(signals: DataFrame, draw, width: int, height: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return pa.table({"image_id": pa.array([table.column("signal_id")[0].as_py()]), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "pixels": pa.array([draw(_samples(table), width, height).tobytes()], pa.binary())})

    if width < 1 or height < 1:
        raise ValueError("a picture needs a size")
    return signals.select("signal_id", "idx", "value").groupBy("signal_id").applyInArrow(run, IMAGES)


def signal_plots(signals: DataFrame, *, width: int = 512, height: int = 256) -> DataFrame:
    return _drawn(signals, planes.signal_plot, width, height)


def signal_spectrum_images(signals: DataFrame, *, width: int = 512, height: int = 256) -> DataFrame:
    return _drawn(signals, planes.signal_spectrum_image, width, height)
