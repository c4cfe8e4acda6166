"""Moving windows along the network, and small averages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.operators.network import FlowNetwork
from thalweg.plans import saved


def window_members(net: FlowNetwork, n: int, order: DataFrame | None = None, uparea: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(idx, slot, member): up to n cells downstream (slots 1..n), the cell (0), and n
    cells up the main stem (-1..-n).  With ``order`` (idx, order) the way down ends
    where the order becomes larger."""
    own = net.cells.select("idx") if starts is None else starts.select("idx")
    own = own.select("idx", F.lit(0).alias("slot"), F.col("idx").alias("member"))
    up = saved(net.main_upstream(uparea).where("idx_us is not null").select(F.col("idx").alias("member"), F.col("idx_us").alias("next")), "main-up")
    down = net.cells.where("idx <> idx_ds")
    if order is not None:
        there = order.select(F.col("idx").alias("idx_ds"), F.col("order").alias("o_ds"))
        down = down.join(order.select("idx", "order"), "idx").join(there, "idx_ds").where("o_ds <= order")
    down = saved(down.select(F.col("idx").alias("member"), F.col("idx_ds").alias("next")), "main-down")
    parts = [own]
    for sign, steps in ((1, down), (-1, up)):
        last = own
        for _ in range(n):
            last = last.join(steps, "member").select("idx", (F.col("slot") + sign).alias("slot"), F.col("next").alias("member"))
            parts.append(last)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weighted_mean(value: Column, weight: Column) -> Column:
    """Of values that are neither NULL nor NaN; NULL if the weights sum to 0."""
    known = value.isNotNull() & ~F.isnan(value.cast("double"))
    return F.sum(F.when(known, value * weight)) / F.nullif(F.sum(F.when(known, weight)), F.lit(0))


def moving_average(net: FlowNetwork, values: DataFrame, n: int, value: str = "value", weights: DataFrame | None = None, order: DataFrame | None = None, uparea: DataFrame | None = None) -> DataFrame:
    """(idx, value): weighted mean over the window of n cells either way; NULL stays NULL."""
    return _windowed(net, values, n, value, weights, order, uparea, lambda: weighted_mean(F.col("value"), F.col("weight")))


def moving_median(net: FlowNetwork, values: DataFrame, n: int, value: str = "value", order: DataFrame | None = None, uparea: DataFrame | None = None) -> DataFrame:
    return _windowed(net, values, n, value, None, order, uparea, lambda: F.median("value"))


def _windowed(net, values, n, value, weights, order, uparea, how) -> DataFrame:
    known = values.where(F.col(value).isNotNull()).select("idx", F.col(value).cast("double").alias("value"))
    members = window_members(net, n, order, uparea, starts=net.cells.join(known, "idx", "left_semi"))
    v = known.withColumnRenamed("idx", "member")
    if weights is not None:
        v = v.join(weights.select(F.col("idx").alias("member"), F.col("weight").cast("double")), "member")
    else:
        v = v.withColumn("weight", F.lit(1.0))
    out = members.join(v, "member").groupBy("idx").agg(how().alias("value"))
    return net.cells.select("idx").join(out, "idx", "left")


def least_squares(x: Column, y: Column) -> tuple[Column, Column]:
    """(slope, intercept) aggregates."""
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def smooth_lengths(net: FlowNetwork, lengths: DataFrame, least: float, max_window: int = 10, uparea: DataFrame | None = None) -> DataFrame:
    """(idx, length): where a length is below ``least``, the mean over the smallest
    window (of growing ones below half of ``max_window``) that exceeds it, or the
    largest mean, replaces all lengths of the window.  Cells are taken in order of
    idx and read what earlier ones wrote; windows stay in a basin, which is one task."""
    half = max_window // 2
    slots = window_members(net, half, None, uparea).groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("slot", "member"))).alias("w"))
    pit = net._ranked.where("terminal is not null").select("idx", "terminal")
    cells = slots.join(pit, "idx").join(lengths.select("idx", F.col("length").cast("double").alias("length")), "idx", "left")
    cells = cells.select("terminal", "idx", F.transform("w", lambda x: x["slot"]).alias("slots"), F.transform("w", lambda x: x["member"]).alias("members"), "length")

    def smooth(table: pa.Table) -> pa.Table:
        idx = table.column("idx").to_numpy()
        value = dict(zip(idx.tolist(), table.column("length").to_pylist(), strict=True))
        window = {i: dict(zip(s, m, strict=True)) for i, s, m in zip(idx.tolist(), table.column("slots").to_pylist(), table.column("members").to_pylist(), strict=True)}
        for i in np.sort(idx).tolist():
            now = value[i]
            if now is None or now >= least:
                continue
            best, who = now, []
            for reach in range(1, half):
                held = [window[i][s] for s in range(-reach, reach + 1) if s in window[i]]
                held = [m for m in held if value.get(m) is not None]
                mean = sum(value[m] for m in held) / len(held)
                if mean > best:
                    best, who = mean, held
                if best > least:
                    break
            for m in who:
                value[m] = best
        return pa.table({"idx": idx, "length": pa.array([value[i] for i in idx.tolist()], pa.float64())})

    return cells.groupBy("terminal").applyInArrow(smooth, "idx long, length double")
