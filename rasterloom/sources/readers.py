"""Image folders, and the text formats of signals, kernels and apertures, as DataFrames or parameters."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.kernels import as_aperture, as_kernel
from rasterloom.operators.frames import IMAGES, PIXELS_RGB
from rasterloom.sources.formats import FormatError, decode_gray, decode_rgb


#: Endings of what the JVM decodes; everything else is decoded here, by its first bytes.
JVM_ENDINGS = r"\.(jpe?g|jfif)$"
_JVM_GLOB = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[jJ][fF][iI][fF]}"


def _named(name: str, decode: Callable[[bytes], np.ndarray], data: bytes) -> np.ndarray:
    try:
        return decode(data)
    except FormatError as e:
        raise FormatError(f"{name}: {e}") from None


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Gray images, one row a file, named by path: PNM, PNG, BMP and TIFF decoded here, JPEG by Spark's own reader.

    Every file of a folder counts; one that can't be decoded is an error when it is read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plane = _named(name, decode_gray, data)
                yield pa.record_batch({"image_id": [name], "width": pa.array([plane.shape[1]], pa.int32()), "height": pa.array([plane.shape[0]], pa.int32()), "pixels": [plane.tobytes()]})

    ours = files.where(~F.lower(F.col("path")).rlike(JVM_ENDINGS)).mapInArrow(run, IMAGES)
    return ours.unionByName(read_jvm_images(spark, path))


def read_jvm_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JPEG files as gray images, decoded by the JVM."""
    files = spark.read.format("image").option("pathGlobFilter", _JVM_GLOB).load(path).select("image.*")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["height"] < 1 or row["width"] < 1:
                    raise FormatError(f"{row['origin']}: the image can't be decoded")
                planes = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"]).astype(np.uint32)
                gray = planes[..., 0] if planes.shape[2] == 1 else (114 * planes[..., 0] + 587 * planes[..., 1] + 299 * planes[..., 2] + 500) // 1000
                yield pa.record_batch({"image_id": [row["origin"]], "width": pa.array([row["width"]], pa.int32()), "height": pa.array([row["height"]], pa.int32()), "pixels": [gray.astype(np.uint8).tobytes()]})

    return files.mapInArrow(run, IMAGES)


def read_rgb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """pixels_rgb of PNM, PNG, BMP and uncompressed TIFF files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rgb = _named(name, decode_rgb, data)
                y, x = np.divmod(np.arange(rgb.shape[0] * rgb.shape[1], dtype=np.int32), rgb.shape[1])
                flat = rgb.reshape(-1, 3).astype(np.int16)
                yield pa.record_batch({"image_id": pa.array([name] * len(x)), "y": y, "x": x, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return files.mapInArrow(run, PIXELS_RGB)


def gray_of(pixels_rgb: DataFrame) -> DataFrame:
    """pixels of pixels_rgb, by the integer luma."""
    return pixels_rgb.select("image_id", "y", "x", F.expr("cast((299 * r + 587 * g + 114 * b + 500) div 1000 as smallint)").alias("v"))


def read_signals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Signals, one a file: numbers apart by blanks, commas or semicolons; a line counts up to its first bad word.

    A file without a sample raises an error when it is read.
    """
    return signals_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("signal_id"), "value"))


def signals_of(files: DataFrame) -> DataFrame:
    """Signals of (signal_id, value), the value being a file's text."""
    line = F.explode(F.transform(F.split("value", "\n"), lambda s, i: F.struct(i.alias("line"), F.split(F.trim(F.translate(s, ",;\t\r", "    ")), " +").alias("words"))))
    rows = files.select("signal_id", line.alias("l")).select("signal_id", "l.line", "l.words")
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    bad = F.array_position(F.transform("words", lambda w: w.rlike(number)), F.lit(False))
    good = F.when(bad == 0, F.col("words")).otherwise(F.slice("words", F.lit(1), F.greatest(bad - 1, F.lit(0)).cast("int")))
    values = rows.groupBy("signal_id").agg(F.sort_array(F.collect_list(F.struct("line", good.alias("words")))).alias("lines"))
    flat = values.select("signal_id", F.flatten(F.transform("lines", lambda s: s["words"])).alias("words"))
    flat = flat.select("signal_id", F.when(F.size("words") > 0, F.col("words")).otherwise(F.raise_error(F.concat(F.lit("no samples in "), "signal_id"))).alias("words"))
    return flat.select("signal_id", F.posexplode("words").alias("idx", "word")).select("signal_id", "idx", F.col("word").cast("double").alias("value"))


def _grid(text: str) -> list[list[float]]:
    rows = [line.replace(",", " ").replace(";", " ").split() for line in text.splitlines()]
    grid = [[float(word) for word in row] for row in rows if row]
    if not grid or len({len(row) for row in grid}) != 1:
        raise ValueError("a matrix needs rows of one length")
    if not all(math.isfinite(v) for row in grid for v in row):
        raise ValueError("a matrix needs finite numbers")
    return grid


def parse_kernel(text: str) -> np.ndarray:
    """A kernel from rows of numbers; anything else in the text is an error."""
    return as_kernel(_grid(text))


def parse_aperture(text: str) -> np.ndarray:
    """An aperture from rows of 0 and 1."""
    return as_aperture(np.array(_grid(text)))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, by Spark's readers."""
    return spark.read.text(path, wholetext=True).first().value
