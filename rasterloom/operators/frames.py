"""Tables of images: whole planes (one row an image) and pixels (one row a pixel), and functions applied to each plane.

Whole planes are taken one row at a time without a shuffle; the memory of a task is bounded by its largest image.
Pixels are for relational operators; an image may then be larger than any task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = "image_id string, width int, height int, pixels binary"
PIXELS = "image_id string, y int, x int, v smallint"
#: Lines of images: `line` holds the values from x = first on, everything else up to the width is one background.
LINES = "image_id string, y int, width int, first int, line array<smallint>"
PIXELS_RGB = "image_id string, y int, x int, r smallint, g smallint, b smallint"


def to_images(pixels: DataFrame) -> DataFrame:
    """images of pixels; every pixel of the rectangle from (0, 0) must be there once."""

    def build(table: pa.Table) -> pa.Table:
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        name, width, height = table.column("image_id")[0], int(x.max()) + 1, int(y.max()) + 1
        at = y.astype(np.int64) * width + x
        if len(at) != width * height or np.bincount(at, minlength=width * height).max() > 1:
            raise ValueError(f"image {name}: not every pixel is there once")
        plane = np.empty(width * height, np.uint8)
        plane[at] = v
        return pa.table({"image_id": pa.array([name.as_py()]), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "pixels": pa.array([plane.tobytes()], pa.binary())})

    return pixels.select("image_id", "y", "x", "v").groupBy("image_id").applyInArrow(build, IMAGES)


def planes_of(batch: pa.RecordBatch) -> Iterable[tuple[str, np.ndarray]]:
    """Name and plane of each row of a batch of images."""
    names, widths, heights = (batch.column(c).to_pylist() for c in ("image_id", "width", "height"))
    for name, width, height, data in zip(names, widths, heights, batch.column("pixels"), strict=True):
        yield name, np.frombuffer(data.as_buffer(), np.uint8).reshape(height, width)


#: What is gathered from small images before it is handed on: bytes of planes, or rows.
_GATHER_BYTES, _GATHER_ROWS = 4 << 20, 1 << 16


def map_planes(images: DataFrame, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """images whose planes the function made of the images' planes."""

    def run(batches):
        held: list[tuple[str, int, int, bytes]] = []

        def hand_on() -> pa.RecordBatch:
            names, widths, heights, data = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(widths, pa.int32()), pa.array(heights, pa.int32()), pa.array(data, pa.binary())], ["image_id", "width", "height", "pixels"])

        size = 0
        for batch in batches:
            for name, plane in planes_of(batch):
                out = np.ascontiguousarray(function(plane), np.uint8)
                held.append((name, out.shape[1], out.shape[0], out.tobytes()))
                size += out.size
                if size >= _GATHER_BYTES:
                    yield hand_on()
                    size = 0
        if held:
            yield hand_on()

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, IMAGES)


def map_rows(images: DataFrame, function: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """image_id and the columns of the schema: the function gives a dict of equally long arrays for each plane."""
    full = T.StructType.fromDDL(f"image_id string, {schema}")
    names = full.names[1:]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        held: list[tuple[str, int, dict]] = []

        def hand_on() -> pa.RecordBatch:
            ids = pa.array([name for name, _, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [n for _, n, _ in held])))
            columns = [pa.array(np.concatenate([np.asarray(made[c]) for _, _, made in held]), arrow.field(c).type) for c in names]
            held.clear()
            return pa.RecordBatch.from_arrays([ids, *columns], schema=arrow)

        rows = 0
        for batch in batches:
            for name, plane in planes_of(batch):
                made = function(plane)
                held.append((name, len(made[names[0]]), made))
                rows += held[-1][1] + 1
                if rows >= _GATHER_ROWS:
                    yield hand_on()
                    rows = 0
        if held:
            yield hand_on()

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, full)


def to_pixels(images: DataFrame) -> DataFrame:
    """pixels of images."""

    def spread(plane: np.ndarray) -> dict[str, np.ndarray]:
        y, x = np.divmod(np.arange(plane.size, dtype=np.int32), plane.shape[1])
        return {"y": y, "x": x, "v": plane.ravel().astype(np.int16)}

    return map_rows(images, spread, "y int, x int, v smallint")


def map_lines(images: DataFrame, function: Callable[[np.ndarray], tuple[int, Iterable[tuple[np.ndarray, ...]]]]) -> DataFrame:
    """lines: the function gives a width and bands of (y, first x, number of values; values one after the other) for each plane."""

    def run(batches):
        held: list[tuple] = []

        def hand_on() -> pa.RecordBatch:
            y, width, first, count, values = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
            ids = pa.array([h[0] for h in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(h[1]) for h in held])))
            held.clear()
            line = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(values, pa.int16()))
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int32()) for c in (y, width, first)), line], ["image_id", "y", "width", "first", "line"])

        cells = 0
        for batch in batches:
            for name, plane in planes_of(batch):
                width, bands = function(plane)
                for y, first, count, values in bands:
                    held.append((name, y, np.full(len(y), width), first, count, values))
                    cells += len(y) + len(values)
                    if cells >= _GATHER_ROWS:
                        yield hand_on()
                        cells = 0
        if held:
            yield hand_on()

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, LINES)


def deal_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that become many more, over all tasks: with a number given, small partitions aren't put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def lines_to_pixels(lines: DataFrame, background: int = 0) -> DataFrame:
    """pixels of lines. Only lines are shuffled; places are made behind it."""
    places = deal_out(lines, "image_id", "y").select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return places.select("image_id", "y", "x", F.coalesce(F.get("line", F.col("x") - F.col("first")), F.lit(background)).cast("smallint").alias("v"))


def plane_rows(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Columns y, x and the named values of a plane of any numbers."""
    y, x = np.divmod(np.arange(values.size, dtype=np.int32), values.shape[1])
    return {"y": y, "x": x, name: values.ravel()}


def info(images: DataFrame) -> DataFrame:
    """What a file scan tells: path, width, height, channels and type."""
    return images.select(F.col("image_id").alias("path"), "width", "height", F.lit(1).alias("channels"), F.lit("uint8").alias("type"))


def clamp(value):
    """A column rounded half away from zero and cut to 0..255, as a pixel."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.round(value))).cast("smallint")
