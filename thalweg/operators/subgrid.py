"""Unit catchments of coarse cells and rivers between their outlet pixels.

Outlets are tables (cell, pixel); results are keyed by cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators.basins import label_down
from thalweg.operators.network import FlowNetwork
from thalweg.operators.windows import weighted_mean
from thalweg.plans import saved


def catchments(net: FlowNetwork, outlets: DataFrame) -> DataFrame:
    """(idx, cell): each pixel with the cell of the next outlet downstream."""
    return label_down(net, outlets.select(F.col("pixel").alias("idx"), "cell"), "cell")


def catchment_area(net: FlowNetwork, outlets: DataFrame, unit: str = "cell") -> DataFrame:
    """(cell, area) that drains to each outlet and to none before it."""
    return catchments(net, outlets).join(net.areas(unit), "idx").groupBy("cell").agg(F.sum("area").alias("area"))


def catchment_volume(net: FlowNetwork, outlets: DataFrame, hand: DataFrame, depths: list[float], unit: str = "m2") -> DataFrame:
    """(cell, depth, volume): what a flood of each depth above the drain holds."""
    if any(a >= b for a, b in zip(depths, depths[1:], strict=False)):
        raise ValueError("depths must increase")
    pixels = catchments(net, outlets).join(net.areas(unit), "idx").join(hand.select("idx", "hand"), "idx")
    sums = [F.sum(F.col("area") * F.greatest(F.lit(0.0), F.lit(float(d)) - F.col("hand"))).alias(f"v{i}") for i, d in enumerate(depths)]
    pairs = F.array(*[F.struct(F.lit(float(d)).alias("depth"), F.col(f"v{i}").alias("volume")) for i, d in enumerate(depths)])
    return pixels.groupBy("cell").agg(*sums).select("cell", F.explode(pairs).alias("p")).select("cell", "p.depth", "p.volume")


def _directed(net: FlowNetwork, direction: str, mask: DataFrame | None, uparea: DataFrame | None) -> FlowNetwork:
    """The network in the given direction, ended where the next pixel is outside the mask."""
    if direction not in ("up", "down"):
        raise ValueError("direction is up or down")
    way = net._reversed(uparea) if direction == "up" else net
    if mask is None:
        return way
    inside = mask.select(F.col("idx").alias("idx_ds"), F.lit(True).alias("_in")).distinct()
    return FlowNetwork(saved(way.cells.join(inside, "idx_ds", "left").select("idx", F.when(F.col("_in"), F.col("idx_ds")).otherwise(F.col("idx")).alias("idx_ds")), "masked"), net.grid)


def members(net: FlowNetwork, outlets: DataFrame, direction: str = "up", mask: DataFrame | None = None, uparea: DataFrame | None = None, with_stop: bool = False, max_len: int | None = None) -> DataFrame:
    """(cell, pos, idx): the pixels from each outlet to before the next one (with it
    if ``with_stop``), a pit, a headwater, or the end of the mask."""
    way = _directed(net, direction, mask, uparea)
    stop = outlets.select(F.col("pixel").alias("idx")).distinct()
    start = outlets.join(way.cells.select(F.col("idx").alias("pixel"), "idx_ds"), "pixel")
    on = start.where("pixel <> idx_ds")
    below = way.path(on.select(F.col("idx_ds").alias("idx")).distinct(), stop)
    if not with_stop:
        below = below.join(stop, "idx", "left_anti")
    rest = on.select("cell", F.col("idx_ds").alias("start")).join(below, "start").select("cell", (F.col("pos") + 1).alias("pos"), "idx")
    out = start.select("cell", F.lit(0).cast("long").alias("pos"), F.col("pixel").alias("idx")).unionByName(rest)
    return out if max_len is None else out.where(F.col("pos") < max_len)


def river_length(net: FlowNetwork, outlets: DataFrame, direction: str = "up", unit: str = "cell", mask: DataFrame | None = None, uparea: DataFrame | None = None) -> DataFrame:
    """(cell, length) from each outlet to the next one, that included."""
    way = _directed(net, direction, mask, uparea)
    dist = saved(net.stream_distance(unit=unit), "distance")
    stop = outlets.select(F.col("pixel").alias("idx")).distinct()
    to = way.snap(way.cells.join(stop, "idx", "left_semi").select(F.col("idx_ds").alias("idx")), stop).select(F.col("idx").alias("idx_ds"), "terminal")
    ends = outlets.join(way.cells.select(F.col("idx").alias("pixel"), "idx_ds"), "pixel").join(to, "idx_ds")
    a = dist.select(F.col("idx").alias("pixel"), F.col("dist").alias("d0"))
    b = dist.select(F.col("idx").alias("terminal"), F.col("dist").alias("d1"))
    return ends.join(a, "pixel").join(b, "terminal").select("cell", F.abs(F.col("d1") - F.col("d0")).alias("length"))


def river_average(net: FlowNetwork, outlets: DataFrame, values: DataFrame, weights: DataFrame | None = None, value: str = "value", **kw) -> DataFrame:
    """(cell, value): weighted mean over the pixels up to the next outlet, that excluded."""
    rows = members(net, outlets, **kw).join(values.select("idx", F.col(value).cast("double").alias("value")), "idx")
    rows = rows.withColumn("weight", F.lit(1.0)) if weights is None else rows.join(weights.select("idx", F.col("weight").cast("double")), "idx")
    return rows.groupBy("cell").agg(weighted_mean(F.col("value"), F.col("weight")).alias("value"))


def river_median(net: FlowNetwork, outlets: DataFrame, values: DataFrame, value: str = "value", **kw) -> DataFrame:
    rows = members(net, outlets, **kw).join(values.select("idx", F.col(value).cast("double").alias("value")), "idx")
    return rows.groupBy("cell").agg(F.median("value").alias("value"))


def river_slope(net: FlowNetwork, outlets: DataFrame, elevation: DataFrame, method: str = "mean", direction: str = "up", unit: str = "m", length: float | None = None, mask: DataFrame | None = None, uparea: DataFrame | None = None) -> DataFrame:
    """(cell, slope): absolute slope over the pixels up to the next outlet, between
    their ends ('mean') or by least squares ('lstsq'); 0 for a single pixel.  With
    direction 'both', over ``length`` along the main stem around the outlet."""
    if method not in ("mean", "lstsq"):
        raise ValueError("method is mean or lstsq")
    dist = saved(net.stream_distance(unit=unit), "distance")
    z = elevation.select("idx", F.col("elev").cast("double").alias("elev"))
    if direction == "both":
        rows = _around(net, outlets, dist, 1000.0 if length is None else float(length), unit, mask, uparea)
    else:
        rows = members(net, outlets, direction, mask, uparea)
    rows = rows.join(dist.select("idx", F.col("dist").cast("double").alias("dist")), "idx").join(z, "idx")
    ends = (F.max_by("elev", "pos") - F.min_by("elev", "pos")) / (F.max_by("dist", "pos") - F.min_by("dist", "pos"))
    how = F.regr_slope("elev", "dist") if method == "lstsq" else ends
    return rows.groupBy("cell").agg(F.when(F.count("*") > 1, F.abs(how)).otherwise(F.lit(0.0)).alias("slope"))


def _around(net, outlets, dist, length, unit, mask, uparea) -> DataFrame:
    """(cell, pos, idx): down from the outlet by half the length, then up the main stem over all of it."""
    half = length / 2
    # paths go as far as the pixels looked for can be: a step beyond the length, and one to spare for rounding
    step = net.edges(unit).agg(F.max("length")).first()[0] or 0.0
    d = dist.select("idx", F.col("dist").cast("double").alias("d"))
    down = _directed(net, "down", mask, None)
    far = down.path(outlets.select(F.col("pixel").alias("idx")).distinct(), unit=unit, max_length=half + 2 * step).join(d, "idx")
    own = outlets.join(d.select(F.col("idx").alias("pixel"), F.col("d").alias("d0")), "pixel").select("cell", F.col("pixel").alias("start"), "d0")
    low = own.join(far, "start")
    # the first pixel at or beyond the half length, or the last one there is
    first = low.groupBy("cell", "d0").agg(F.min(F.when(F.col("d") <= F.col("d0") - half, F.struct("pos", "idx"))).alias("p"), F.max(F.struct("pos", "idx")).alias("q"))
    first = saved(first.select("cell", "d0", F.coalesce("p", "q")["idx"].alias("start")), "lowest")
    up = _directed(net, "up", mask, uparea).path(first.select(F.col("start").alias("idx")).distinct(), unit=unit, max_length=length + 4 * step).join(d, "idx")
    rows = first.join(up, "start")
    end = rows.where(F.col("d") >= F.col("d0") + half).groupBy("cell").agg(F.min("pos").alias("last"))
    return rows.join(end, "cell", "left").where("last is null or pos <= last").select("cell", "pos", "idx")
