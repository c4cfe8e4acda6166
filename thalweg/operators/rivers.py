"""Rivers: estuaries and bankfull depth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators.network import FlowNetwork
from thalweg.plans import ascend, saved

GRAVITY = 9.81


def classify_estuaries(net: FlowNetwork, elevation: DataFrame, width: DataFrame, distance: DataFrame | None = None, min_convergence: float = 1e-2, max_elevation: float = 0.0) -> DataFrame:
    """(idx, estuary): 1 from low pits up as long as rivers get narrower fast enough
    (or not at all at the mouth), 2 where that ends, else 0."""
    distance = net.stream_distance(unit="m" if net.grid is not None else "cell") if distance is None else distance
    v = elevation.select("idx", "elev").join(width.select("idx", "width"), "idx").join(distance.select("idx", F.col("dist").cast("double").alias("dist")), "idx")
    both = saved(net.with_downstream(v, "elev", "width", "dist"), "estuary")
    dx, dw = F.col("dist") - F.col("dist_ds"), F.col("width_ds") - F.col("width")
    on = ((F.col("dist_ds") == 0) & (dw <= 0)) | ((dx > 0) & (dw / dx > min_convergence))
    edge = both.select("idx", "idx_ds", (~F.coalesce(on, F.lit(False))).cast("int").alias("bad"))
    seeds = both.where((F.col("idx") == F.col("idx_ds")) & (F.col("elev") <= max_elevation)).select(F.col("idx").alias("terminal"))
    part = saved(ascend(edge, {"bad": "max"}, None, net.block).join(seeds, "terminal", "left_semi").where("bad <= 0").select("idx"), "estuary-cells")
    fails = edge.where("bad = 1 and idx <> idx_ds").select(F.col("idx_ds").alias("idx")).distinct().withColumn("_end", F.lit(True))
    marked = part.join(fails, "idx", "left").select("idx", F.when(F.col("_end"), 2).otherwise(1).alias("estuary"))
    return net.cells.select("idx").join(marked, "idx", "left").select("idx", F.coalesce("estuary", F.lit(0)).alias("estuary"))


def river_depth(net: FlowNetwork, rivers: DataFrame, method: str = "manning", min_depth: float = 1.0, min_slope: float = 1e-5, **kw) -> DataFrame:
    """(idx, depth) from (idx, q, width, manning and slope or zs, dist).

    Manning's equation for a wide channel; slopes come from surface levels where
    steps are 1 m or longer and from downstream elsewhere.  ``method='gvf'`` refines
    the depth for gradually varying flow.
    """
    if method not in ("manning", "gvf"):
        raise ValueError("method is manning or gvf")
    if "slope" not in rivers.columns:
        both = net.with_downstream(rivers.select("idx", "zs", "dist"), "zs", "dist")
        dx = F.col("dist") - F.col("dist_ds")
        raw = both.select("idx", F.when(dx >= 1, (F.col("zs") - F.col("zs_ds")) / F.greatest(F.lit(1.0), dx)).alias("value"))
        rivers = rivers.join(net.fill_nodata(raw).withColumnRenamed("value", "slope"), "idx", "left")
    n = F.col("manning") if "manning" in rivers.columns else F.lit(0.03)
    slope = F.greatest(F.lit(float(min_slope)), F.coalesce("slope", F.lit(float(min_slope))))
    depth = F.greatest(F.lit(float(min_depth)), F.pow(n * F.col("q") / (F.sqrt(slope) * F.col("width")), F.lit(0.6)))
    first = net.cells.select("idx").join(rivers, "idx").withColumn("manning", n).withColumn("depth", depth)
    if method == "manning":
        return first.select("idx", "depth")
    return gradually_varying(net, saved(first, "depth"), min_depth, min_slope, **kw)


def dormand_prince(f, x1: float, y: float, rtol: float = 1e-3, atol: float = 1e-6) -> float | None:
    """y at x1 from y at 0 by an adaptive 5(4) Runge-Kutta pair; None if steps get too small."""
    # The Dormand-Prince tableau.
    nodes = [1 / 5, 3 / 10, 4 / 5, 8 / 9, 1.0]
    rows = [
        [1 / 5],
        [3 / 40, 9 / 40],
        [44 / 45, -56 / 15, 32 / 9],
        [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729],
        [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656],
    ]
    fifth = [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84]
    error = [-71 / 57600, 0, 71 / 16695, -71 / 1920, 17253 / 339200, -22 / 525, 1 / 40]
    if x1 <= 0:
        return y
    x, k0 = 0.0, f(0.0, y)
    scale = atol + abs(y) * rtol
    h = min(x1, 0.01 * max(abs(y) / scale, 1e-5) / max(abs(k0) / scale, 1e-5))
    while x < x1:
        h = min(h, x1 - x)
        if h < 1e-12 * max(1.0, x1):
            return None
        k = [k0]
        for c, row in zip(nodes, rows, strict=True):
            k.append(f(x + c * h, y + h * sum(a * b for a, b in zip(row, k, strict=True))))
        new = y + h * sum(a * b for a, b in zip(fifth, k, strict=True))
        k.append(f(x + h, new))
        err = abs(h * sum(a * b for a, b in zip(error, k, strict=True))) / (atol + rtol * max(abs(y), abs(new)))
        if not np.isfinite(err):
            h *= 0.2
            continue
        if err <= 1:
            x, y, k0 = x + h, new, k[-1]
        h *= min(10.0, max(0.2, 0.9 * err**-0.2)) if err > 0 else 10.0
    return y


def gradually_varying(net: FlowNetwork, rivers: DataFrame, min_depth: float = 1.0, min_slope: float = 1e-5, eps: float = 0.1, rounds: int = 2) -> DataFrame:
    """(idx, depth) from (idx, zs, dist, q, width, manning, depth): the depth upstream
    of each cell integrated from the one downstream; a cell keeps its depth where the
    result isn't plausible.  Each cell reads the one below, so a basin is one task."""
    pit = net._ranked.where("terminal is not null").select("idx", "terminal", F.col("rank").cast("long").alias("rank"))
    names = ["zs", "dist", "q", "width", "manning", "depth"]
    cells = net.with_values(rivers.select("idx", *[F.col(c).cast("double").alias(c) for c in names])).join(pit, "idx")

    def solve(table: pa.Table) -> pa.Table:
        idx, ds, rank = (table.column(c).to_numpy() for c in ("idx", "idx_ds", "rank"))
        zs, dist, q, width, manning, depth = (table.column(c).to_numpy() for c in names)
        depth = depth.copy()
        at = {int(i): k for k, i in enumerate(idx)}
        bed = zs - depth
        for _ in range(rounds):
            for k in np.lexsort((idx, rank)):
                d = at[int(ds[k])]
                if d == k or not (q[k] > 0 and width[k] > 0):
                    continue
                dx = dist[k] - dist[d]
                s0 = max(min_slope, (bed[k] - bed[d]) / dx)

                def rate(_x, h, q=q[k], w=width[k], n=manning[k], s0=s0):
                    h = max(h, eps)
                    area = w * h
                    friction = (n * q / area) ** 2 * (area / (2 * h + w)) ** (-4 / 3)
                    froude = q / (w * np.sqrt(GRAVITY * h))
                    return -(s0 - friction) / (1 - froude**2)

                with np.errstate(all="ignore"):
                    h = dormand_prince(rate, float(dx), float(depth[d]))
                if h is not None and h >= 0 and abs(h - depth[d]) <= abs(dx):
                    depth[k] = max(min_depth, h)
            bed = zs - depth
        return pa.table({"idx": idx, "depth": depth})

    return cells.select("terminal", "idx", "idx_ds", "rank", *names).groupBy("terminal").applyInArrow(solve, "idx long, depth double")
