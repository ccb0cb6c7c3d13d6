"""Images as long tables of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = "origin string, y int, x int, channel int, value double"


def read_image_grid(spark: SparkSession, path: str, *, skip_broken: bool = False) -> DataFrame:
    """Decode all images under ``path`` (in the JVM) into RGB cells: origin, y, x, channel (0 red, 1 green, 2 blue).

    A file that can't be decoded stops the read with its name, unless ``skip_broken`` is set.
    """
    images = spark.read.format("image").option("dropInvalid", skip_broken).load(path)
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(
        _cells, CELLS
    )


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes come as blue, green, red(, alpha) per pixel; one output frame per image keeps memory to one image."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.height < 0:
                raise ValueError(f"{r.origin} is no image that can be decoded")
            grid = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
            rgb = np.repeat(grid, 3, axis=2) if r.nChannels == 1 else grid[:, :, 2::-1]
            y, x, c = np.indices(rgb.shape)
            yield pd.DataFrame(
                {"origin": r.origin, "y": y.ravel(), "x": x.ravel(), "channel": c.ravel(), "value": rgb.astype(float).ravel()}
            )
