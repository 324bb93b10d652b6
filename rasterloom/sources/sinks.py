"""Images as files' bytes, by file ending, and rows of one image gathered for a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.frames import planes_of
from rasterloom.sources.formats import encoder


def image_files(images: DataFrame, ending: str = "png") -> DataFrame:
    """image_id and file: each plane as a file of this ending."""
    encode = encoder(ending)

    def run(batches):
        for batch in batches:
            for name, plane in planes_of(batch):
                yield pa.record_batch({"image_id": [name], "file": pa.array([encode(plane)], pa.binary())})

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, "image_id string, file binary")


def image_files_rgb(pixels_rgb: DataFrame, ending: str = "png") -> DataFrame:
    """image_id and file of complete pixels_rgb; an image is put together in one task."""
    encode = encoder(ending)

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        out[y, x] = np.stack([table.column(c).to_numpy() for c in "rgb"], axis=1)
        return pa.table({"image_id": pa.array([table.column("image_id")[0].as_py()]), "file": pa.array([encode(out)], pa.binary())})

    return pixels_rgb.groupBy("image_id").applyInArrow(run, "image_id string, file binary")


def nested(rows: DataFrame, name: str) -> DataFrame:
    """One row an image, with an array of the rows' other columns."""
    rest = [c for c in rows.columns if c != "image_id"]
    return rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
