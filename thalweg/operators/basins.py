"""Basins, subbasins and region statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thalweg.functions.grid import GridSpec
from thalweg.operators import network
from thalweg.operators.network import FlowNetwork
from thalweg.operators.streams import classic_order
from thalweg.plans import ascend, saved


def basins(net: FlowNetwork, outlets: DataFrame | None = None, streams: DataFrame | None = None) -> DataFrame:
    """(idx, basin): every cell with the label of the next outlet downstream.

    ``outlets`` has idx (or x and y) and, if it has labels of its own, id (never 0); without it
    pits are outlets.  Labels default to 1, 2, ... in order of idx.  With
    ``streams`` (idx) outlets are first moved down to a stream.
    """
    outlets = net.pits() if outlets is None else net.points(outlets)
    if "id" not in outlets.columns:
        outlets = numbered(outlets.select("idx").distinct(), "idx")
    elif not outlets.where("id = 0 or id is null").isEmpty():
        raise ValueError("outlet ids must not be 0")
    if streams is not None:
        moved = net.snap(outlets, streams).select("idx", "terminal")
        outlets = outlets.join(moved, "idx").groupBy(F.col("terminal").alias("idx")).agg(F.min("id").alias("id"))
    return label_down(net, outlets.select("idx", F.col("id").alias("basin")), "basin")


def numbered(rows: DataFrame, by: str, name: str = "id") -> DataFrame:
    """Rows with 1, 2, ... in order of a column: positions inside ranges of it plus
    the ranges' counts, so no task sorts everything."""
    rows = rows.withColumn("_range", F.floor(F.col(by) / 65536))
    n = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return rows.withColumn("_at", at).join(n, "_range").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_range", "_n", "_before", "_at")


def label_down(net: FlowNetwork, labels: DataFrame, name: str) -> DataFrame:
    """(idx, name): the label of the next labelled cell downstream, the cell itself
    included; cells without one are left out."""
    marked = net.with_values(labels.select("idx", name))
    to = ascend(marked.select("idx", "idx_ds", name), {}, F.col(name).isNotNull(), net.block)
    return to.join(labels.select(F.col("idx").alias("terminal"), name), "terminal").select("idx", name)


def interbasin(net: FlowNetwork, region: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """(idx): the part of ``region`` below which the path doesn't leave and enter it
    again; with ``streams`` only in basins that have a stream cell."""
    inside = net.cells.join(region.select("idx", F.lit(True).alias("r")).distinct(), "idx", "left").select("idx", F.coalesce("r", F.lit(False)).alias("r"))
    bad = net.with_downstream(inside, "r").select("idx", (~F.col("r") & F.col("r_ds")).cast("int").alias("bad"))
    paths = net.ascend(bad, {"bad": "max"}).where("terminal is not null")
    out = paths.where("bad <= 0").join(inside.where("r"), "idx", "left_semi").select("idx", "terminal")
    if streams is not None:
        held = paths.join(streams.select("idx"), "idx", "left_semi").select("terminal").distinct()
        out = out.join(held, "terminal", "left_semi")
    return out.select("idx")


def _outlets_to_basins(net: FlowNetwork, outlets: DataFrame) -> DataFrame:
    """Outlets numbered from down- to upstream (rank, then idx), and their basins."""
    ids = network.numbered(outlets.join(net.rank(), "idx"), "rank", "pos").select("idx", (F.col("pos") + 1).cast("long").alias("basin"))
    return label_down(net, saved(ids, "outlets"), "basin")


def subbasins_streamorder(net: FlowNetwork, order: DataFrame, min_order: int = -2, mask: DataFrame | None = None) -> DataFrame:
    """(idx, basin): a subbasin at each cell of order ``min_order`` or more (counted
    from the largest one if negative) whose downstream cell has another order, and at pits."""
    if min_order < 0:
        min_order = order.agg(F.max("order")).first()[0] + min_order
    both = net.with_downstream(order, "order").where((F.col("order") >= min_order) & ((F.col("order") != F.col("order_ds")) | (F.col("idx") == F.col("idx_ds"))))
    if mask is not None:
        both = both.join(mask.select("idx"), "idx", "left_semi")
    return _outlets_to_basins(net, both.select("idx"))


def subbasins_pfafstetter(net: FlowNetwork, depth: int = 1, uparea: DataFrame | None = None, upa_min: float = 0.0) -> DataFrame:
    """(idx, basin): Pfafstetter digits to ``depth`` levels.

    Per level, every branch (a stem with one code) takes its four largest
    tributaries; in order from down- to upstream they get even digits and the
    stretches of the stem between them odd ones (9 levels of the classic scheme,
    counted from 1).  Branches are rows of one table, levels one pass each.
    """
    uparea = saved((net.upstream_area() if uparea is None else uparea).select("idx", "uparea"), "uparea")
    mask = uparea.where(F.col("uparea") > upa_min).select("idx") if upa_min > 0 else None
    order = saved(classic_order(net, mask, uparea).where((F.col("order") > 0) & (F.col("order") <= depth + 1)), "order")
    # stems: the cells of one order from its outlet up; pos by uparea of the stem cell
    ordered = net.cells.join(order, "idx").join(order.select(F.col("idx").alias("idx_ds"), F.col("order").alias("o_ds")), "idx_ds", "left")
    start = (F.col("idx") == F.col("idx_ds")) | F.col("o_ds").isNull() | (F.col("order") > F.col("o_ds"))
    cells = saved(ordered.withColumn("start", start).join(uparea, "idx"), "stem-cells")
    steps = cells.withColumn("steps", F.lit(1))
    stem = saved(ascend(steps.select("idx", "idx_ds", "steps", "start"), {"steps": "sum"}, F.col("start"), net.block).select("idx", F.col("terminal").alias("stem"), F.col("steps").alias("pos")), "stems")
    # a tributary is a stem that joins another one at some position
    tribs = cells.where("start and idx <> idx_ds").select("idx", F.col("idx_ds").alias("at"), "uparea")
    at = stem.select(F.col("idx").alias("at"), F.col("stem").alias("into"), F.col("pos").alias("at_pos"))
    tribs = saved(tribs.join(at, "at"), "tributaries")
    pits = net.pits().join(stem.select("idx"), "idx", "left_semi")
    # branches: (stem, from position, code)
    branch = pits.select(F.col("idx").alias("stem"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("code"))
    for level in range(1, depth + 1):
        span = branch.withColumn("hi", F.coalesce(F.lead("lo").over(Window.partitionBy("stem").orderBy("lo")), F.lit(1 << 60)))
        mine = tribs.join(span, (F.col("into") == F.col("stem")) & (F.col("at_pos") >= F.col("lo")) & (F.col("at_pos") < F.col("hi")))
        mine = mine.join(branch.select(F.col("stem").alias("idx")).distinct(), "idx", "left_anti")
        top = mine.withColumn("k", F.row_number().over(Window.partitionBy("stem", "lo").orderBy(F.desc("uparea"), "idx"))).where("k <= 4")
        top = top.withColumn("i", F.row_number().over(Window.partitionBy("stem", "lo").orderBy("at_pos", F.desc("uparea"), "idx")))
        top = saved(top.select("stem", "lo", "code", "idx", "at_pos", "i"), "largest")
        own = branch.select("stem", "lo", (F.col("code") * 10 + 1).alias("code"))
        sub = top.select(F.col("idx").alias("stem"), F.lit(0).cast("long").alias("lo"), (F.col("code") * 10 + 2 * F.col("i")).cast("long").alias("code"))
        # two tributaries at one cell share the stretch above it, which takes the first one's digit
        inter = top.groupBy("stem", "code", "at_pos").agg(F.min("i").alias("i")).select("stem", (F.col("at_pos") + 1).alias("lo"), (F.col("code") * 10 + 2 * F.col("i") + 1).cast("long").alias("code"))
        branch = saved(own.unionByName(sub).unionByName(inter), "branches")
    span = branch.withColumn("hi", F.coalesce(F.lead("lo").over(Window.partitionBy("stem").orderBy("lo")), F.lit(1 << 60)))
    coded = stem.join(span, "stem").where("pos >= lo and pos < hi").select("idx", F.col("code").alias("basin"))
    return label_down(net, saved(coded, "coded"), "basin")


def subbasins_area(net: FlowNetwork, area_min: float, uparea: DataFrame | None = None) -> DataFrame:
    """(idx, basin): subbasins of at least ``area_min``, cut off greedily from each
    outlet upstream.  What is left over at a confluence depends on the tributaries
    taken before, so a basin is walked by one task; basins are independent."""
    uparea = net.upstream_area() if uparea is None else uparea
    main = net.main_upstream(uparea).select(F.col("idx").alias("idx_ds"), F.col("idx_us").alias("main"))
    pit = net._ranked.where("terminal is not null").select("idx", "terminal", F.col("rank").cast("long").alias("rank"))
    cells = net.with_values(uparea.select("idx", F.col("uparea").cast("double").alias("uparea"))).join(main, "idx_ds", "left").join(pit, "idx")
    limit = float(area_min)

    def walk(table: pa.Table) -> pa.Table:
        idx, ds, rank = (table.column(c).to_numpy() for c in ("idx", "idx_ds", "rank"))
        area, main = table.column("uparea").to_numpy(), table.column("main").fill_null(-1).to_numpy()
        at = {int(i): k for k, i in enumerate(idx)}
        left = area.copy()
        outlet = np.zeros(len(idx), bool)
        for k in np.lexsort((idx, rank)):
            down = at[int(ds[k])]
            if down == k:
                outlet[k] = True
                continue
            here, total = area[k], left[down]
            if here <= limit or total - here <= limit:
                left[k] = total
                continue
            side = main[k] != idx[k]
            if side or area[down] - here <= limit:
                outlet[k], left[k] = True, here
            if side:
                left[down] = total - here
                left[at[int(main[k])]] = left[down]
        return pa.table({"idx": idx[outlet]})

    found = cells.select("terminal", "idx", "idx_ds", "rank", "uparea", "main").groupBy("terminal").applyInArrow(walk, "idx long")
    return _outlets_to_basins(net, saved(found, "subbasin-outlets"))


# --- regions: (idx, region) tables, 0 and NULL are background
def _regions(regions: DataFrame) -> DataFrame:
    return regions.where("region > 0")


def region_sum(regions: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    return _regions(regions).join(values.select("idx", F.col(value).alias("value")), "idx").groupBy("region").agg(F.sum("value").alias("value"))


def region_area(regions: DataFrame, grid: GridSpec, unit: str = "m2") -> DataFrame:
    return _regions(regions).groupBy("region").agg(F.sum(grid.area("idx", unit)).alias("area"))


def region_slices(regions: DataFrame, grid: GridSpec) -> DataFrame:
    """(region, row_min, row_max, col_min, col_max), ends included."""
    return _regions(regions).groupBy("region").agg(
        F.min(grid.row()).alias("row_min"), F.max(grid.row()).alias("row_max"), F.min(grid.col()).alias("col_min"), F.max(grid.col()).alias("col_max")
    )


def region_bounds(regions: DataFrame, grid: GridSpec) -> DataFrame:
    """(region, xmin, ymin, xmax, ymax), with the total as region NULL."""
    a, _, c, _, e, f = grid.transform
    x, y = grid.col() * a + c, grid.row() * e + f
    corner = lambda v, d, how: how(F.least(v, v + d)) if how is F.min else how(F.greatest(v, v + d))
    return _regions(regions).rollup("region").agg(
        corner(x, a, F.min).alias("xmin"), corner(y, e, F.min).alias("ymin"), corner(x, a, F.max).alias("xmax"), corner(y, e, F.max).alias("ymax")
    )


def region_outlets(net: FlowNetwork, regions: DataFrame) -> DataFrame:
    """(region, idx): cells whose downstream cell is in another region or none, and pits."""
    both = net.with_downstream(_regions(regions), "region").where("region is not null")
    return both.where((F.col("idx") == F.col("idx_ds")) | ~F.col("region").eqNullSafe(F.col("region_ds"))).select("region", "idx")


def region_dissolve(regions: DataFrame, labels: DataFrame, grid: GridSpec, at: DataFrame | None = None) -> DataFrame:
    """(idx, region): the regions of ``labels`` (region) take the label of the nearest
    other region, by distance at their nearest cell, or at the cells ``at`` (region, idx)."""
    from thalweg.operators.elevation import spread

    some = labels.select("region").distinct()
    kept = _regions(regions).join(some, "region", "left_anti")
    every = grid.cells(regions.sparkSession).select("idx")
    near = spread(every.join(kept.select("idx", F.col("region").cast("double").alias("value")), "idx", "left"), grid)
    if at is None:
        at = _regions(regions).join(some, "region", "left_semi").select("region", "idx")
    new = at.join(near, "idx").groupBy("region").agg(F.min_by("value", F.struct("dist", "idx")).cast("long").alias("_new"))
    out = regions.join(new, "region", "left")
    return out.select("idx", F.coalesce("_new", "region").alias("region"))


def basin_bounds(net: FlowNetwork, labels: DataFrame | None = None) -> DataFrame:
    labels = basins(net) if labels is None else labels
    return region_bounds(labels.select("idx", F.col("basin").alias("region")), net.grid)


def basin_outlets(net: FlowNetwork, labels: DataFrame | None = None) -> DataFrame:
    labels = basins(net) if labels is None else labels
    return region_outlets(net, labels.select("idx", F.col("basin").alias("region")))
