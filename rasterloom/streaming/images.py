"""Image operators over a stream of files: each file is a row, and operators on whole planes keep no state."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rasterloom.operators.frames import IMAGES
from rasterloom.sources.formats import FormatError, decode_gray

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_images(spark: SparkSession, folder: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """images of the PGM, PNG and TIFF files that appear in a folder; files that can't be decoded are left out."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.{pgm,png,tif,tiff}").load(folder)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    plane = decode_gray(data)
                except FormatError:
                    continue
                yield pa.record_batch({"image_id": [name], "width": pa.array([plane.shape[1]], pa.int32()), "height": pa.array([plane.shape[0]], pa.int32()), "pixels": [plane.tobytes()]})

    return files.select("path", "content").mapInArrow(run, IMAGES)


def write_stream(images: DataFrame, operator: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Run an operator on all files that are there, and write its rows as Parquet; a restart goes on where it stopped."""
    return operator(images).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
