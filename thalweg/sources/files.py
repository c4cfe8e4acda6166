"""Files of networks and rasters, read and written through Spark's own paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions.grid import GridSpec
from thalweg.operators.network import FlowNetwork


def read_nextxy(spark: SparkSession, path: str, nrow: int, ncol: int, bounds: tuple[float, float, float, float]) -> tuple[DataFrame, GridSpec]:
    """(row, col, nextx, nexty) of a raw little-endian file of int32: all x, then all y,
    row by row; bounds are (west, south, east, north)."""
    grid = GridSpec.from_bounds(nrow, ncol, *bounds)

    def decode(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                both = np.frombuffer(content, "<i4")
                if len(both) != 2 * nrow * ncol:
                    raise ValueError("the file has another number of cells")
                x, y = both.reshape(2, -1)
                for lo in range(0, nrow * ncol, 1 << 20):
                    at = np.arange(lo, min(lo + (1 << 20), nrow * ncol))
                    yield pa.RecordBatch.from_arrays([pa.array((at // ncol).astype(np.int32)), pa.array((at % ncol).astype(np.int32)), pa.array(x[at]), pa.array(y[at])], ["row", "col", "nextx", "nexty"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "row int, col int, nextx int, nexty int"), grid


def read_ascii(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """((row, col, value), rows, columns) of a text raster: lines of numbers, one row each."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("row", "line"))
    cells = lines.select("row", F.posexplode(F.split(F.trim("line"), r"[\s,]+")).alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("value"))
    size = cells.agg(F.max("row"), F.max("col")).first()
    return cells, size[0] + 1, size[1] + 1


def save(net: FlowNetwork, path: str) -> None:
    """Write a network as Parquet, with its grid beside it."""
    net.cells.write.mode("overwrite").parquet(f"{path}/cells")
    text = net.grid.to_json() if net.grid is not None else "null"
    net.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/grid")


def load(spark: SparkSession, path: str) -> FlowNetwork:
    text = spark.read.text(f"{path}/grid").first()["value"]
    return FlowNetwork(spark.read.parquet(f"{path}/cells"), None if text == "null" else GridSpec.from_json(text))


def write_features(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line."""
    features.write.mode("overwrite").json(path)
