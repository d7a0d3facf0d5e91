"""Image files as rows of pixels, with a row for each file that can't be used."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: images under so many pixels in height or width are not judged.
LEAST_SIDE = 8


def _rgb(data: pa.Array, channels: pa.Array) -> pa.Array:
    """Rows of blue, green, red (and alpha), or grey, as red, green, blue."""
    out = []
    for d, n in zip(data, channels, strict=True):
        if not d.is_valid or n.as_py() not in (1, 3, 4):
            out.append(None)
            continue
        a = np.frombuffer(d.as_buffer(), np.uint8).reshape(-1, n.as_py())
        out.append((np.repeat(a, 3, axis=1) if n.as_py() == 1 else a[:, 2::-1]).ravel().astype(np.int32))
    return pa.array(out, pa.list_(pa.int32()))


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, h, w, rgb array<int> (row by row), error: `unreadable` or `too_small` (then without pixels), else null. Files are decoded by Spark's image source, as many a task as their size allows."""
    files = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("image.*")

    @F.arrow_udf("array<int>")
    def rgb(data: pa.Array, channels: pa.Array) -> pa.Array:
        return _rgb(data, channels)

    error = F.when((F.col("height") < 1) | (F.col("width") < 1), "unreadable").when((F.col("height") < LEAST_SIDE) | (F.col("width") < LEAST_SIDE), "too_small")
    judged = files.withColumn("error", error)
    ok = F.col("error").isNull()
    return judged.select(F.col("origin").alias("path"), F.when(F.col("height") > 0, F.col("height")).alias("h"), F.when(F.col("width") > 0, F.col("width")).alias("w"), rgb(F.when(ok, F.col("data")), "nChannels").alias("rgb"), "error")
