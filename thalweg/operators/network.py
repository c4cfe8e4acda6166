"""Flow networks: cells with one downstream cell each, as immutable DataFrames."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.functions import encodings
from thalweg.functions.grid import GridSpec
from thalweg.plans import ascend, descend, saved

#: Cells of one rank are numbered by stretches of so many ids.
STRETCH = 1 << 20


def numbered(cells: DataFrame, by: str, name: str) -> DataFrame:
    """``cells`` (idx, by, ...) with their place in the order of (by, idx), from 0 on.  Only
    counts by stretch are in one window."""
    part = cells.withColumn("_s", F.floor(F.col("idx") / STRETCH))
    sizes = part.groupBy(by, "_s").agg(F.count("*").alias("_n"))
    outer = sizes.groupBy(by).agg(F.sum("_n").alias("_m"))
    outer = outer.select(F.col(by), F.coalesce(F.sum("_m").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = sizes.select(by, "_s", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_i"))
    before = inner.join(outer, by).select(by, "_s", (F.col("_o") + F.col("_i")).alias("_before"))
    at = F.row_number().over(Window.partitionBy(by, "_s").orderBy("idx")) - 1
    return part.withColumn("_at", at).join(before, [by, "_s"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_s", "_at", "_before")


FLOW_ERROR = "downstream and upstream are 'down' and 'up'"


class FlowNetwork:
    """A network (idx, idx_ds), with a grid or without.

    Pits point to themselves; cells that aren't in the table don't exist.  Results
    are DataFrames keyed by ``idx``; ranks and the like are computed once per
    network, and changes (pits added, loops repaired) make another network.
    """

    def __init__(self, cells: DataFrame, grid: GridSpec | None = None) -> None:
        self.cells = cells.where("idx_ds is not null").select(F.col("idx").cast("long"), F.col("idx_ds").cast("long"))
        self.grid = grid
        self.spark: SparkSession = cells.sparkSession

    # --- construction
    @classmethod
    def from_dataframe(cls, nodes: DataFrame, id_col: str = "id", ds_col: str = "ds") -> FlowNetwork:
        """A network from a node table; a downstream id that no node has makes a pit."""
        nodes = nodes.select(F.col(id_col).cast("long").alias("idx"), F.col(ds_col).cast("long").alias("_to"))
        known = nodes.select(F.col("idx").alias("_to"), F.lit(True).alias("_is"))
        return cls(saved(nodes.join(known, "_to", "left").select("idx", F.when(F.col("_is"), F.col("_to")).otherwise(F.col("idx")).alias("idx_ds")), "network"))

    @classmethod
    def from_array(cls, codes: DataFrame, grid: GridSpec, ftype: str = "infer", check: bool = True, mask: DataFrame | None = None) -> FlowNetwork:
        """A network from a raster of codes (row, col, code or nextx, nexty).  Cells
        that aren't in ``mask`` (idx) are missing."""
        if ftype == "infer":
            ftype = encodings.infer(codes)
        elif check and not encodings.is_valid(codes, ftype):
            raise ValueError(f"the flow directions are not valid {ftype}")
        if mask is not None:
            codes = codes.withColumn("_i", grid.idx()).join(mask.select(F.col("idx").alias("_i")), "_i", "left_semi").drop("_i")
        decoded = saved(encodings.decode(codes, grid, ftype), "network")
        out = cls(decoded, grid)
        out._explicit = decoded.where("explicit").select("idx")
        if out.pits().isEmpty():
            raise ValueError("the network has no pits")
        return out

    @classmethod
    def from_elevation(cls, elevation: DataFrame, grid: GridSpec, **kw) -> FlowNetwork:
        """A network from (idx, elev) through depression filling."""
        from thalweg.operators.elevation import fill_depressions

        filled = saved(fill_depressions(elevation, grid, **kw), "filled")
        return cls.from_array(filled.select(grid.row().alias("row"), grid.col().alias("col"), "code"), grid, "d8", check=False)

    def _like(self, cells: DataFrame) -> FlowNetwork:
        return FlowNetwork(saved(cells, "network"), self.grid)

    def set_transform(self, transform: tuple[float, ...], latlon: bool = False) -> FlowNetwork:
        """The same cells on a grid of another transform (six numbers)."""
        if self.grid is None:
            raise ValueError("a network without a grid has no transform")
        return FlowNetwork(self.cells, replace(self.grid, transform=tuple(transform), latlon=latlon))

    def points(self, at: DataFrame) -> DataFrame:
        """``at`` (idx, ...), or with the cells at its coordinates if it is (x, y, ...)."""
        if "idx" in at.columns:
            return at
        if self.grid is None or not {"x", "y"} <= set(at.columns):
            raise ValueError("points are given by idx, or by x and y on a grid")
        return at.withColumn("idx", self.grid.index("x", "y"))

    def as_dict(self) -> dict:
        """Grid, cells, order and pits by name."""
        g = self.grid
        return {
            "shape": (g.nrow, g.ncol) if g else None, "transform": g.transform if g else None, "latlon": g.latlon if g else None,
            "nnodes": self.n_nodes(), "idxs_ds": self.cells, "idxs_seq": self.order(), "idxs_pit": self.pits(),
        }

    def __getitem__(self, name: str):
        return self.as_dict()[name]

    def __str__(self) -> str:
        return f"FlowNetwork({'without a grid' if self.grid is None else self.grid})"

    # --- plumbing
    @property
    def block(self) -> Column | None:
        return self.grid.block() if self.grid is not None else None

    def ascend(self, values: DataFrame | None = None, ops: dict[str, str] | None = None, stop: Column | None = None) -> DataFrame:
        """``plans.ascend`` over the cells with the columns of ``values`` (idx, ...)."""
        return ascend(self.with_values(values), ops, stop, self.block)

    def descend(self, values: DataFrame, ops: dict[str, str]) -> DataFrame:
        return descend(self.with_values(values), ops, self.block)

    def with_values(self, values: DataFrame | None) -> DataFrame:
        return self.cells if values is None else self.cells.join(values, "idx", "left")

    def with_downstream(self, values: DataFrame, *names: str) -> DataFrame:
        """Cells with columns of ``values`` and the downstream cell's as ``<name>_ds``."""
        there = values.select(F.col("idx").alias("idx_ds"), *[F.col(c).alias(f"{c}_ds") for c in names])
        return self.with_values(values.select("idx", *names)).join(there, "idx_ds", "left")

    def edges(self, unit: str = "cell") -> DataFrame:
        """(idx, length) of each cell's step downstream; 0 at pits."""
        step = F.lit(1.0) if unit == "cell" or self.grid is None else self.grid.distance("idx", "idx_ds")
        return self.cells.select("idx", F.when(F.col("idx") == F.col("idx_ds"), F.lit(0.0)).otherwise(step).alias("length"))

    def areas(self, unit: str = "cell") -> DataFrame:
        """(idx, area) of each cell; 1 without a grid."""
        area = self.grid.area("idx", unit) if self.grid is not None else F.lit(1.0)
        return self.cells.select("idx", area.alias("area"))

    # --- properties
    @cached_property
    def _ranked(self) -> DataFrame:
        return ascend(self.cells.withColumn("rank", F.lit(1)), {"rank": "sum"}, None, self.block)

    def rank(self) -> DataFrame:
        """(idx, rank): steps to the pit; -1 in loops and above them."""
        return self._ranked.select("idx", F.when(F.col("terminal").isNull(), F.lit(-1)).otherwise(F.col("rank")).cast("int").alias("rank"))

    def order(self) -> DataFrame:
        """(idx, rank, pos): an order from down- to upstream, ties by idx.  Positions
        come from counts by rank and stretch of idx, and places within one of these."""
        return numbered(self.rank().where("rank >= 0"), "rank", "pos")

    def is_valid(self) -> bool:
        return self._ranked.where("terminal is null").isEmpty()

    def n_nodes(self) -> int:
        """Number of cells that reach a pit."""
        return self._ranked.where("terminal is not null").count()

    def pits(self) -> DataFrame:
        return self.cells.where("idx = idx_ds").select("idx")

    def outlets(self) -> DataFrame:
        """Pits that the raster states as such; pits where flow leaves the domain aren't among them."""
        return getattr(self, "_explicit", self.pits())

    def loops(self) -> DataFrame:
        return self._ranked.where("terminal is null").select("idx")

    def repair_loops(self) -> FlowNetwork:
        """Every cell that reaches no pit becomes one."""
        return self._like(self.cells.join(self._ranked, "idx").select("idx", F.when(F.col("terminal").isNull(), F.col("idx")).otherwise(F.col("idx_ds")).alias("idx_ds")))

    def add_pits(self, at: DataFrame, streams: DataFrame | None = None) -> FlowNetwork:
        """With the cells ``at`` (idx) as pits, or the first cells of ``streams`` (idx) below them."""
        if streams is not None:
            at = self.snap(at, streams).select("terminal").where("terminal is not null").toDF("idx")
        at = self.points(at)
        new = at.select("idx", F.lit(True).alias("_pit")).distinct()
        return self._like(self.cells.join(new, "idx", "left").select("idx", F.when(F.col("_pit"), F.col("idx")).otherwise(F.col("idx_ds")).alias("idx_ds")))

    def upstream_count(self, mask: DataFrame | None = None) -> DataFrame:
        """(idx, n): direct upstream cells, those in ``mask`` (idx) only."""
        from_ = self.cells if mask is None else self.cells.join(mask.select("idx"), "idx", "left_semi")
        n = from_.where("idx <> idx_ds").groupBy(F.col("idx_ds").alias("idx")).agg(F.count("*").cast("int").alias("n"))
        return self.cells.select("idx").join(n, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n"))

    def upstream_matrix(self) -> DataFrame:
        """(idx, upstream): the direct upstream cells, ascending."""
        up = self.cells.where("idx <> idx_ds").groupBy(F.col("idx_ds").alias("idx")).agg(F.sort_array(F.collect_list("idx")).alias("upstream"))
        return self.cells.select("idx").join(up, "idx", "left").select("idx", F.coalesce("upstream", F.array().cast("array<bigint>")).alias("upstream"))

    def headwaters(self, mask: DataFrame | None = None) -> DataFrame:
        return self.upstream_count(mask).where("n = 0").select("idx")

    def confluences(self, mask: DataFrame | None = None) -> DataFrame:
        return self.upstream_count(mask).where("n > 1").select("idx")

    def main_upstream(self, uparea: DataFrame | None = None, least: float = 0.0) -> DataFrame:
        """(idx, idx_us): the upstream cell with the largest uparea, which must exceed
        ``least``; of equal ones the smallest index; NULL at headwaters."""
        uparea = self.upstream_area() if uparea is None else uparea
        up = self.with_values(uparea.select("idx", "uparea")).where((F.col("idx") != F.col("idx_ds")) & (F.col("uparea") > least))
        best = up.groupBy(F.col("idx_ds").alias("idx")).agg(F.max_by("idx", F.struct("uparea", -F.col("idx"))).alias("idx_us"))
        return self.cells.select("idx").join(best, "idx", "left")

    def tuples(self, mask: DataFrame) -> DataFrame:
        return self.cells.join(mask.select("idx"), "idx", "left_semi")

    # --- tracing
    def snap(self, starts: DataFrame, stop: DataFrame | None = None, unit: str = "cell", max_length: float | None = None, direction: str = "down", uparea: DataFrame | None = None) -> DataFrame:
        """(idx, terminal, dist): where the path from each start ends: at a pit or
        headwater, at the first cell of ``stop`` (idx; starts count), or before
        ``max_length`` would be exceeded.  Starts are (idx) or (x, y)."""
        starts = self.points(starts)
        net = self._reversed(uparea) if direction == "up" else self
        if max_length is not None:
            return net._capped(starts, stop, unit, float(max_length), direction, self).groupBy("start").agg(F.max_by("idx", "pos").alias("terminal"), F.max("dist").alias("dist")).withColumnRenamed("start", "idx")
        length = self._lengths(net, unit)
        cells, at = net._stopped(length, stop)
        out = ascend(cells, {"length": "sum"}, at, self.block)
        return starts.select("idx").distinct().join(out, "idx").select("idx", "terminal", F.col("length").alias("dist"))

    def path(self, starts: DataFrame, stop: DataFrame | None = None, unit: str = "cell", max_length: float | None = None, direction: str = "down", uparea: DataFrame | None = None) -> DataFrame:
        """(start, pos, idx, dist) of the cells on the path from each start; see ``snap``."""
        starts = self.points(starts)
        net = self._reversed(uparea) if direction == "up" else self
        return net._capped(starts, stop, unit, max_length, direction, self)

    def _reversed(self, uparea: DataFrame | None) -> FlowNetwork:
        """The main upstream cell as the next one; headwaters are the ends."""
        up = self.main_upstream(uparea).select("idx", F.coalesce("idx_us", "idx").alias("idx_ds"))
        return FlowNetwork(saved(up, "upwards"), self.grid)

    def _lengths(self, net: FlowNetwork, unit: str) -> DataFrame:
        return net.edges(unit)

    def _stopped(self, values: DataFrame, stop: DataFrame | None) -> tuple[DataFrame, Column | None]:
        cells = self.with_values(values)
        if stop is None:
            return cells, None
        return cells.join(stop.select("idx", F.lit(True).alias("_stop")).distinct(), "idx", "left"), F.col("_stop")

    def _capped(self, starts: DataFrame, stop: DataFrame | None, unit: str, max_length: float | None, direction: str, origin: FlowNetwork) -> DataFrame:
        """Paths written out, by doubling: a path of 2^k cells is joined to the path
        of 2^k cells from its end, so a path of n cells takes log n joins over the
        table of steps; only cells that starts lead to are in it."""
        cells, at = self._stopped(self.edges(unit), stop)
        ends = F.col("idx") == F.col("idx_ds")
        ends = ends if at is None else ends | F.coalesce(at, F.lit(False))
        steps = saved(cells.select("idx", F.when(~ends, F.col("idx_ds")).alias("to"), "length"), "steps")
        # levels[k]: (idx, to, length) of 2^k steps; found: (start, pos, idx, dist) of the first 2^k cells
        found = saved(starts.select("idx").distinct().join(steps.select("idx"), "idx").select(F.col("idx").alias("start"), F.lit(0).cast("long").alias("pos"), "idx", F.lit(0.0).alias("dist")), "path")
        jump, reach = steps.where("to is not null"), 1
        while True:
            ahead = found.join(jump, "idx").select("start", (F.col("pos") + reach).alias("pos"), F.col("to").alias("idx"), (F.col("dist") + F.col("length")).alias("dist"))
            if max_length is not None:
                ahead = ahead.where(F.col("dist") <= max_length)
            ahead = saved(ahead, "path")
            if ahead.isEmpty():
                return found
            found = saved(found.unionByName(ahead), "path")
            further = jump.select(F.col("idx").alias("to"), F.col("to").alias("_t"), F.col("length").alias("_l"))
            jump = saved(jump.join(further, "to").select("idx", F.col("_t").alias("to"), (F.col("length") + F.col("_l")).alias("length")), "jump")
            reach *= 2

    def inflow(self, region: DataFrame) -> DataFrame:
        """(idx): cells outside ``region`` (idx) that drain into it and have no such cell upstream."""
        entry = self._crossing(region, into=True).select("idx", F.lit(1).alias("here"))
        marked = self.cells.select("idx").join(entry, "idx", "left").select("idx", F.coalesce("here", F.lit(0)).alias("here"))
        above = self.descend(marked, {"here": "sum"}).withColumnRenamed("here", "n")
        return entry.join(above, "idx").where("n = 1").select("idx")

    def outflow(self, region: DataFrame) -> DataFrame:
        """(idx): cells of ``region`` that drain out of it, or are pits, and have no such cell downstream."""
        leave = self._crossing(region, into=False).select("idx", F.lit(1).alias("here"))
        marked = self.cells.select("idx").join(leave, "idx", "left").select("idx", F.coalesce("here", F.lit(0)).alias("here"))
        below = self.ascend(marked, {"here": "sum"}).join(marked.select(F.col("idx").alias("terminal"), F.col("here").alias("at_end")), "terminal")
        own = below.where("idx <> terminal").select("idx", (F.col("here") + F.col("at_end")).alias("n")).unionByName(below.where("idx = terminal").select("idx", F.col("at_end").alias("n")))
        return leave.join(own, "idx").where("n = 1").select("idx")

    def _crossing(self, region: DataFrame, into: bool) -> DataFrame:
        inside = self.cells.join(region.select("idx", F.lit(True).alias("here")).distinct(), "idx", "left").select("idx", F.coalesce("here", F.lit(False)).alias("here"))
        both = self.with_downstream(inside, "here")
        if into:
            return both.where(~F.col("here") & F.col("here_ds"))
        return both.where(F.col("here") & (~F.col("here_ds") | (F.col("idx") == F.col("idx_ds"))))

    # --- accumulation
    def accumulate(self, values: DataFrame, value: str = "value", direction: str = "up") -> DataFrame:
        """(idx, value): sums over everything upstream ('up') or the path downstream
        ('down'), the cell included.  NULL is a barrier: sums neither cross it nor are given there."""
        known = self.with_values(values.select("idx", F.col(value).alias("value")))
        there = known.select(F.col("idx").alias("idx_ds"), F.col("value").isNotNull().alias("_known"))
        cut = known.where("value is not null").join(there, "idx_ds", "left")
        cut = cut.select("idx", F.when(F.col("_known"), F.col("idx_ds")).otherwise(F.col("idx")).alias("idx_ds"), "value")
        if direction == "up":
            out = descend(cut, {"value": "sum"}, self.block)
        elif direction == "down":
            paths = ascend(cut, {"value": "sum"}, None, self.block)
            ends = cut.select(F.col("idx").alias("terminal"), F.col("value").alias("_end"))
            out = paths.join(ends, "terminal").select("idx", (F.col("value") + F.col("_end")).alias("value"))
        else:
            raise ValueError(FLOW_ERROR)
        return self.cells.select("idx").join(out, "idx", "left")

    def upstream_area(self, unit: str = "cell") -> DataFrame:
        """(idx, uparea) of all cells that reach a pit."""
        out = self.descend(self.areas(unit), {"area": "sum"})
        kind = "long" if unit == "cell" else "double"
        return out.select("idx", F.col("area").cast(kind).alias("uparea"))

    def stream_distance(self, mask: DataFrame | None = None, unit: str = "cell") -> DataFrame:
        """(idx, dist) to the pit or the next cell of ``mask`` (idx), where it is 0."""
        cells, at = self._stopped(self.edges(unit), mask)
        out = ascend(cells, {"length": "sum"}, at, self.block).where("terminal is not null")
        return out.select("idx", F.col("length").cast("long" if unit == "cell" else "double").alias("dist"))

    def fill_nodata(self, values: DataFrame, value: str = "value", direction: str = "up", how: str = "max") -> DataFrame:
        """(idx, value): NULLs filled from the nearest valid cell downstream ('up'), or
        by the max, min or sum of the nearest valid ones upstream ('down')."""
        known = self.with_values(values.select("idx", F.col(value).alias("value")))
        if direction == "up":
            to = ascend(known.select("idx", "idx_ds", "value"), {}, F.col("value").isNotNull(), self.block)
            source = known.select(F.col("idx").alias("terminal"), "value")
            return self.cells.select("idx").join(to.join(source, "terminal", "left").select("idx", "value"), "idx", "left")
        if direction != "down":
            raise ValueError(FLOW_ERROR)
        if how not in ("max", "min", "sum"):
            raise ValueError("how must be max, min or sum")
        there = known.select(F.col("idx").alias("idx_ds"), F.col("value").isNotNull().alias("_known"))
        cut = known.join(there, "idx_ds", "left").select("idx", F.when(F.col("_known"), F.col("idx")).otherwise(F.col("idx_ds")).alias("idx_ds"), "value", F.col("value").isNotNull().cast("int").alias("_n"))
        got = descend(cut, {"value": how, "_n": "sum"}, self.block).select("idx", F.when(F.col("_n") > 0, F.col("value")).alias("_filled"))
        return known.join(got, "idx", "left").select("idx", F.coalesce("value", "_filled").alias("value"))

    # --- one step
    def downstream(self, values: DataFrame, value: str = "value") -> DataFrame:
        """(idx, value) of the next cell downstream, a pit's own."""
        return self.with_downstream(values.select("idx", F.col(value).alias("v")), "v").select("idx", F.col("v_ds").alias("value"))

    def upstream_sum(self, values: DataFrame, value: str = "value") -> DataFrame:
        """(idx, value): the sum over direct upstream cells, 0 if there are none; NULLs
        don't count, and cells that are NULL themselves stay so."""
        known = self.with_values(values.select("idx", F.col(value).alias("value")))
        sums = known.where("idx <> idx_ds and value is not null").groupBy(F.col("idx_ds").alias("idx")).agg(F.sum("value").alias("total"))
        return known.join(sums, "idx", "left").select("idx", F.when(F.col("value").isNotNull(), F.coalesce("total", F.lit(0))).alias("value"))

    # --- export
    def to_array(self, ftype: str = "d8") -> DataFrame:
        if self.grid is None:
            raise ValueError("a network without a grid has no raster form")
        return encodings.encode(self.cells, self.grid, ftype)

    def depth(self) -> int:
        return max(1, math.ceil(math.log2(1 + (self.rank().agg(F.max("rank")).first()[0] or 0))))
