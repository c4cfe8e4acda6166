"""Depression filling on tiles: spill levels, flats, flow directions.

A cell's spill level is the least height that water must reach to leave over a start
cell (by default the edge of the valid area): the bottleneck of the best path to one.
Inside a tile levels come from merging areas over their lowest rims, all areas at
once, which takes as many passes as areas can halve.  Tiles exchange the levels on
their rims until none sinks.

Every cell drains to its lowest neighbour on the filled surface.  On flats water goes
the shortest way (in cells) to one that has a lower neighbour, or, where there is
none, to the flat's first start cell; these distances are found in the same way.
Ties go to the smaller distance, then to cells that aren't starts, then by row and column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.functions.encodings import D8_STEPS
from thalweg.functions.grid import NEIGHBOURS, GridSpec
from thalweg.plans import saved

#: D8 code of a cell whose water goes by (row step, column step).
CODE = {step: code for code, step in D8_STEPS.items()}
MISSING = 247
#: Where nothing leads to, and the root of cells beside lower ones.
FAR, EXIT = np.iinfo(np.int64).max, -1


def steps_of(connectivity: int) -> list[tuple[int, int]]:
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    return [s for s in NEIGHBOURS if connectivity == 8 or 0 in s]


def shifted(a: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
    """Each cell's neighbour by (dr, dc); ``fill`` off the array."""
    out = np.full_like(a, fill)
    n, m = a.shape
    out[max(0, -dr) : n - max(0, dr), max(0, -dc) : m - max(0, dc)] = a[max(0, dr) : n - max(0, -dr), max(0, dc) : m - max(0, -dc)]
    return out


def _links(steps, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of neighbouring cells that are both ok, each pair once."""
    at = np.arange(ok.size).reshape(ok.shape)
    left, right = [], []
    for dr, dc in steps:
        if (dr, dc) > (0, 0):
            other = shifted(at, dr, dc, -1)
            both = ok & (other >= 0)
            both[both] = ok.ravel()[other[both]]
            left.append(at[both])
            right.append(other[both])
    return np.concatenate(left), np.concatenate(right)


def spill_levels(z: np.ndarray, start: np.ndarray, steps) -> np.ndarray:
    """Levels of the cells of a tile, given at which level each has a way out by itself
    (infinite if it has none; at least its height).  NaN heights are missing cells.

    Areas begin as cells.  In each round every area rises to its lowest rim and joins
    the area behind it; what joins the outside is done.  A rim belongs to both areas,
    so rims don't rise along a chain of joins, and each area's own rim is its level.
    """
    valid = ~np.isnan(z)
    height = np.where(valid, z, np.inf).ravel()
    a, b = _links(steps, valid)
    rim = np.maximum(height[a], height[b])
    n = z.size
    # number n is the outside
    out = np.flatnonzero(np.isfinite(start.ravel()) & valid.ravel())
    a, b = np.concatenate((a, out)), np.concatenate((b, np.full(len(out), n)))
    rim = np.concatenate((rim, start.ravel()[out]))
    level = np.append(height, -np.inf)
    area = np.arange(n + 1)
    order = np.argsort(rim, kind="stable")
    a, b, rim = a[order], b[order], rim[order]  # so that the first link of an area is its lowest
    while len(a):
        least = np.full(n + 1, len(a))
        k = np.arange(len(a))
        np.minimum.at(least, a, k)
        np.minimum.at(least, b, k)
        least[n] = len(a)
        who = np.flatnonzero(least < len(a))
        if not len(who):
            break
        link = least[who]
        to = a[link] + b[link] - who
        rise = np.full(n + 1, -np.inf)
        rise[who] = rim[link]
        live = area != n
        level[live] = np.maximum(level[live], rise[area[live]])
        root = np.arange(n + 1)
        root[who] = to
        # two areas that join each other: the first one of them stands for both
        pair = who[root[to] == who]
        root[pair[pair < root[pair]]] = pair[pair < root[pair]]
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
        area = root[area]
        a, b = root[a], root[b]
        on = a != b
        a, b, rim = a[on], b[on], rim[on]
    level = level[:n].reshape(z.shape)
    return np.where(valid & (area[:n].reshape(z.shape) == n), level, np.inf)


def flat_distances(w: np.ndarray, root: np.ndarray, far: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """(root, distance) over cells of one level that touch: the smallest root among them,
    and the distance to the nearest cell known to have it, its own distance included."""
    root, far = root.ravel().copy(), far.ravel().copy()
    level = w.ravel()
    a, b = _links(steps, np.isfinite(w))
    same = level[a] == level[b]
    a, b = a[same], b[same]
    flat = np.arange(len(level))
    while True:
        u, v = flat[a], flat[b]
        if (u == v).all():
            break
        np.minimum.at(flat, np.maximum(u, v), np.minimum(u, v))
        while (flat[flat] != flat).any():
            flat = flat[flat]
    best = np.full(len(level), FAR)
    np.minimum.at(best, flat, root)
    best = best[flat]
    source = (root == best) & (best < FAR)
    far = np.where(source, far, FAR)
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    begin = np.searchsorted(a, np.arange(len(level) + 1))
    waiting = np.flatnonzero(source)
    waiting = waiting[np.argsort(far[waiting], kind="stable")]
    place, front, d = 0, np.zeros(0, np.int64), 0
    while place < len(waiting) or len(front):
        if not len(front):
            d = far[waiting[place]]
        until = int(np.searchsorted(far[waiting[place:]], d, "right")) + place if place < len(waiting) else place
        front = np.unique(np.concatenate((front, waiting[place:until])))
        front = front[far[front] == d]
        place = until
        # the neighbours of the front, one step further
        count = begin[front + 1] - begin[front]
        at = np.arange(count.sum()) + np.repeat(begin[front] - np.cumsum(count) + count, count)
        near = b[at]
        near = np.unique(near[far[near] > d + 1])
        far[near] = d + 1
        front, d = near, d + 1
        # sources that were overtaken are in the front by their new distance
        if place < len(waiting):
            rest = waiting[place:]
            waiting, place = rest[far[rest] >= d][np.argsort(far[rest][far[rest] >= d], kind="stable")], 0
    return best.reshape(w.shape), np.where(far == FAR, FAR, far).reshape(w.shape)


def directions(w: np.ndarray, root: np.ndarray, far: np.ndarray, start: np.ndarray, number: np.ndarray, steps) -> np.ndarray:
    """D8 codes: each cell's way to its lowest neighbour, ties by distance on flats, then
    cells that aren't starts, then number; 0 where it stays and for cells out of reach."""
    code = np.zeros(w.shape, np.int64)
    key = [w.copy(), far.copy(), start.astype(np.int64), number.copy()]
    best = [np.full(w.shape, np.inf), np.full(w.shape, FAR), np.full(w.shape, FAR), np.full(w.shape, FAR)]
    for dr, dc in steps:
        other = [shifted(k, dr, dc, fill) for k, fill in zip(key, (np.inf, FAR, FAR, FAR), strict=True)]
        lower = np.zeros(w.shape, bool)
        equal = np.ones(w.shape, bool)
        for mine, theirs in zip(best, other, strict=True):
            lower |= equal & (theirs < mine)
            equal &= theirs == mine
        lower &= (other[0] < w) | ((other[0] == w) & (other[1] < far))
        for mine, theirs in zip(best, other, strict=True):
            mine[lower] = theirs[lower]
        code[lower] = CODE[dr, dc]
    code[~np.isfinite(w) | ((root == number) & (far == 0))] = 0
    return code


def beside_lower(w: np.ndarray, steps) -> np.ndarray:
    """Whether a cell has a lower neighbour."""
    out = np.zeros(w.shape, bool)
    for dr, dc in steps:
        out |= shifted(w, dr, dc, np.inf) < w
    return out


class Tiles:
    """Cells (idx, ...) of a grid by tiles with a rim of one cell around them."""

    def __init__(self, grid: GridSpec) -> None:
        self.grid, self.across = grid, -(-grid.ncol // grid.tile)

    def sent(self, cells: DataFrame) -> DataFrame:
        """Cells with each tile ``to`` that reads them."""
        g = self.grid
        tile = lambda dr, dc: (F.floor((g.row() + dr) / g.tile) * self.across + F.floor((g.col() + dc) / g.tile)).cast("long")
        ring = [F.when(g.inside(g.row() + dr, g.col() + dc), tile(dr, dc)) for dr, dc in [(0, 0), *NEIGHBOURS]]
        r, c = g.row() % g.tile, g.col() % g.tile
        rim = (r == 0) | (c == 0) | (r == g.tile - 1) | (c == g.tile - 1)
        return cells.withColumn("to", F.explode(F.when(rim, F.array_distinct(F.array(*ring))).otherwise(F.array(tile(0, 0))))).where("to is not null")

    def seen(self, idx: np.ndarray) -> np.ndarray:
        """Whether cells are beside another tile."""
        g = self.grid
        r, c = idx // g.ncol, idx % g.ncol
        return ((r % g.tile == 0) & (r > 0)) | ((c % g.tile == 0) & (c > 0)) | ((r % g.tile == g.tile - 1) & (r < g.nrow - 1)) | ((c % g.tile == g.tile - 1) & (c < g.ncol - 1))

    def box(self, table: pa.Table, *columns: tuple[str, object, object]):
        """Arrays of (column, type, fill) over a tile and its rim, the cells' places in
        them, which of the rows are the tile's own, and the numbers of all places."""
        g = self.grid
        to = table.column("to")[0].as_py()
        r0, c0 = to // self.across * g.tile, to % self.across * g.tile
        shape = min(g.tile, g.nrow - r0) + 2, min(g.tile, g.ncol - c0) + 2
        idx = table.column("idx").to_numpy()
        r, c = idx // g.ncol - r0 + 1, idx % g.ncol - c0 + 1
        own = (r > 0) & (c > 0) & (r < shape[0] - 1) & (c < shape[1] - 1)
        arrays = []
        for name, kind, fill in columns:
            a = np.full(shape, fill, kind)
            a[r, c] = table.column(name).to_numpy()
            arrays.append(a)
        number = (np.arange(shape[0])[:, None] + r0 - 1) * g.ncol + np.arange(shape[1])[None, :] + c0 - 1
        return arrays, (r, c), own, number

    def settle(self, cells: DataFrame, relax, schema: str, tag: str) -> DataFrame:
        """Apply ``relax`` to all tiles until no row that another tile sees comes back as moved."""
        while True:
            after = saved(self.sent(cells).groupBy("to").applyInArrow(relax, f"{schema}, moved boolean"), tag)
            if after.where("moved").isEmpty():
                return after.drop("moved")
            cells = after.drop("moved")


def at_edge(cells: DataFrame, grid: GridSpec, connectivity: int = 8) -> DataFrame:
    """Valid cells (idx, z) with ``start``: whether a neighbour is missing or off the grid."""
    steps, tiles = steps_of(connectivity), Tiles(grid)

    def mark(table: pa.Table) -> pa.Table:
        (z,), at, own, number = tiles.box(table, ("z", float, np.nan))
        open_side = np.zeros(z.shape, bool)
        for dr, dc in steps:
            open_side |= np.isnan(shifted(z, dr, dc, np.nan))
        r, c = at[0][own], at[1][own]
        return pa.table({"idx": number[r, c], "z": z[r, c], "start": open_side[r, c]})

    return tiles.sent(cells).groupBy("to").applyInArrow(mark, "idx long, z double, start boolean")


def levels(marked: DataFrame, grid: GridSpec, connectivity: int = 8) -> DataFrame:
    """(idx, z, w, start) from valid cells (idx, z, start); w is infinite for cells that
    no start leads to."""
    steps, tiles = steps_of(connectivity), Tiles(grid)
    now = marked.withColumn("w", F.when(F.col("start"), F.col("z")).otherwise(F.lit(float("inf"))))

    def relax(table: pa.Table) -> pa.Table:
        (z, w, start), at, own, _ = tiles.box(table, ("z", float, np.nan), ("w", float, np.inf), ("start", bool, False))
        ways = w.copy()  # what is known already is a way out, on the rim from outside the tile
        found = np.minimum(spill_levels(z, ways, steps), w)
        idx = table.column("idx").to_numpy()[own]
        r, c = at[0][own], at[1][own]
        return pa.table({"idx": idx, "z": z[r, c], "start": start[r, c], "w": found[r, c], "moved": (found[r, c] < w[r, c]) & tiles.seen(idx)})

    return tiles.settle(now.select("idx", "z", "start", "w"), relax, "idx long, z double, start boolean, w double", "levels")


def drained(surface: DataFrame, grid: GridSpec, connectivity: int = 8) -> DataFrame:
    """(idx, z, w, start, code) of a surface (idx, z, w, start)."""
    steps, tiles = steps_of(connectivity), Tiles(grid)

    def begin(table: pa.Table) -> pa.Table:
        (z, w, start), at, own, number = tiles.box(table, ("z", float, np.nan), ("w", float, np.inf), ("start", bool, False))
        leaves = beside_lower(w, steps)
        root = np.where(leaves, EXIT, np.where(start, number, FAR))
        r, c = at[0][own], at[1][own]
        return pa.table({"idx": number[r, c], "z": z[r, c], "w": w[r, c], "start": start[r, c], "root": root[r, c], "far": np.where(root < FAR, 0, FAR)[r, c]})

    schema = "idx long, z double, w double, start boolean, root long, far long"
    now = saved(tiles.sent(surface.select("idx", "z", "w", "start")).groupBy("to").applyInArrow(begin, schema), "flats")

    def relax(table: pa.Table) -> pa.Table:
        (z, w, start, root, far), at, own, number = tiles.box(table, ("z", float, np.nan), ("w", float, np.inf), ("start", bool, False), ("root", np.int64, FAR), ("far", np.int64, FAR))
        new_root, new_far = flat_distances(w, root, far, steps)
        r, c = at[0][own], at[1][own]
        moved = (new_root != root) | (new_far != far)
        return pa.table({"idx": number[r, c], "z": z[r, c], "w": w[r, c], "start": start[r, c], "root": new_root[r, c], "far": new_far[r, c], "moved": moved[r, c] & tiles.seen(number[r, c])})

    now = tiles.settle(now, relax, schema, "flats")

    def point(table: pa.Table) -> pa.Table:
        (z, w, start, root, far), at, own, number = tiles.box(table, ("z", float, np.nan), ("w", float, np.inf), ("start", bool, False), ("root", np.int64, FAR), ("far", np.int64, FAR))
        code = directions(w, root, far, start, number, steps)
        r, c = at[0][own], at[1][own]
        return pa.table({"idx": number[r, c], "z": z[r, c], "w": w[r, c], "start": start[r, c], "code": code[r, c].astype(np.int16)})

    return tiles.sent(now).groupBy("to").applyInArrow(point, "idx long, z double, w double, start boolean, code short")


def _valid(elevation: DataFrame) -> DataFrame:
    return elevation.where("elev is not null and not isnan(elev)").select(F.col("idx").cast("long"), F.col("elev").cast("double").alias("z"))


def _bottoms(surface: DataFrame, grid: GridSpec, max_depth: float, connectivity: int) -> DataFrame:
    """(idx) of the lowest cell of what drains together out of depressions of
    ``max_depth`` or more."""
    from thalweg.operators.network import FlowNetwork

    done = saved(drained(surface, grid, connectivity), "drained")
    move = F.create_map(*[F.lit(x) for (dr, dc), code in CODE.items() for x in (code, dr * grid.ncol + dc)])
    net = FlowNetwork(done.select("idx", (F.col("idx") + F.coalesce(F.element_at(move, F.col("code").cast("int")), F.lit(0))).alias("idx_ds")), grid)
    dry = done.where("w = z or w = double('inf')").select("idx", F.lit(True).alias("_dry"))
    ends = net.ascend(dry, {}, F.col("_dry")).where("terminal is not null").select("idx", "terminal")
    wet = done.where("w > z and w < double('inf')").join(ends, "idx")
    lowest = wet.groupBy("terminal").agg(F.min(F.struct("z", "idx")).alias("o"), F.max(F.col("w") - F.col("z")).alias("depth"))
    return lowest.where(F.col("depth") >= max_depth).select("o.idx")


def fill_depressions(elevation: DataFrame, grid: GridSpec, outlets: str = "edge", pits: DataFrame | None = None, max_depth: float = -1.0, elv_max: float | None = None, connectivity: int = 8) -> DataFrame:
    """(idx, elev, code) of every grid cell: filled elevations and D8 codes.

    Water leaves over ``pits`` (idx) or the edge of the valid area (up to ``elv_max``),
    with ``outlets="min"`` over the lowest of these cells only.  With ``max_depth`` >= 0,
    depressions of that depth or more stay and drain to their lowest cell.
    """
    flagged = lambda c, starts: c.drop("start").join(starts.select("idx", F.lit(True).alias("start")).distinct(), "idx", "left").withColumn("start", F.coalesce("start", F.lit(False)))
    if pits is None:
        cells = at_edge(_valid(elevation), grid, connectivity)
        if elv_max is not None:
            cells = cells.withColumn("start", F.col("start") & (F.col("z") <= elv_max))
        cells = saved(cells, "cells")
        if cells.where("start").isEmpty():
            raise ValueError("there is no cell to start from")
    else:
        cells = saved(flagged(_valid(elevation), pits.select(F.col("idx").cast("long"))), "cells")
    if outlets == "min":
        cells = saved(flagged(cells, cells.where("start").agg(F.min(F.struct("z", "idx")).alias("o")).where("o is not null").select("o.idx")), "cells")
    while True:
        surface = levels(cells, grid, connectivity)
        if max_depth < 0:
            break
        more = saved(_bottoms(surface, grid, max_depth, connectivity), "bottoms")
        if more.isEmpty():
            break
        cells = saved(flagged(cells, cells.where("start").select("idx").unionByName(more)), "cells")
    filled = drained(surface, grid, connectivity)
    everywhere = F.when(F.col("w") == float("inf"), F.col("z")).otherwise(F.col("w"))
    every = grid.cells(elevation.sparkSession).select("idx").join(filled.select("idx", everywhere.alias("elev"), "code"), "idx", "left")
    return every.select("idx", "elev", F.coalesce("code", F.lit(MISSING).cast("short")).alias("code"))


def filled_surface(elevation: DataFrame, grid: GridSpec, connectivity: int = 8) -> DataFrame:
    """(idx, elev): the lowest level at which water leaves each cell over the edge of
    the valid area."""
    return levels(saved(at_edge(_valid(elevation), grid, connectivity), "cells"), grid, connectivity).select("idx", F.col("w").alias("elev"))
