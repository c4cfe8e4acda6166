"""Coarser networks from fine ones, and how well they are connected.

A coarse cell is ``factor`` by ``factor`` pixels of the fine grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.grid import GridSpec
from thalweg.operators.network import FlowNetwork
from thalweg.plans import ascend, saved

METHODS = ("ihu", "eam_plus", "eam", "dmm")
#: Rounds of moving outlets.
MAX_ROUNDS = 50


def coarse_cell(fine: GridSpec, factor: int, idx="idx") -> Column:
    return (F.floor(fine.row(idx) / factor) * fine.scaled(factor).ncol + F.floor(fine.col(idx) / factor)).cast("long")


def on_edge(fine: GridSpec, factor: int, idx="idx") -> Column:
    """Whether a pixel touches the border of its coarse cell."""
    r, c = fine.row(idx) % factor, fine.col(idx) % factor
    return (r == 0) | (c == 0) | (r == factor - 1) | (c == factor - 1)


def in_effective_area(fine: GridSpec, factor: int, idx="idx", ratio: float = 0.5) -> Column:
    """Whether a pixel lies in the star around the centre of its coarse cell."""
    mid = factor / 2.0 - 0.5
    r, c = F.abs(fine.row(idx) % factor - mid), F.abs(fine.col(idx) % factor - mid)
    return (F.sqrt(r) + F.sqrt(c) <= (factor * ratio) ** 0.5) | (r <= 0.5) | (c <= 0.5)


def adjacent(a: Column, b: Column, ncol: int) -> Column:
    return (F.abs(F.floor(a / ncol) - F.floor(b / ncol)) <= 1) & (F.abs(a % ncol - b % ncol) <= 1)


def representatives(net: FlowNetwork, factor: int, uparea: DataFrame, area: Column) -> DataFrame:
    """(cell, pixel): of each coarse cell the pixel with the largest uparea among pits
    and those of ``area``; of equal ones the first."""
    at = net.with_values(uparea.select("idx", "uparea")).where((area | (F.col("idx") == F.col("idx_ds"))) & (F.col("uparea") > 0))
    return at.groupBy(coarse_cell(net.grid, factor).alias("cell")).agg(F.max_by("idx", F.struct("uparea", -F.col("idx"))).alias("pixel"))


def _from(pixels: DataFrame, net: FlowNetwork, stop: Column, name: str) -> DataFrame:
    """``pixels`` (cell, pixel) with the first pixel strictly below at which ``stop``
    holds or the path ends, as ``name``."""
    to = ascend(net.cells, {}, stop, net.block)
    first = net.cells.select(F.col("idx").alias("pixel"), F.col("idx_ds").alias("_first"))
    return pixels.join(first, "pixel").join(to.select(F.col("idx").alias("_first"), F.col("terminal").alias(name)), "_first").drop("_first")


def outlet_pixels(net: FlowNetwork, factor: int, uparea: DataFrame | None = None, method: str = "eam_plus", ratio: float = 0.5) -> DataFrame:
    """(cell, pixel): where each coarse cell is drained.  For eam_plus and ihu the last pixel
    in the cell on the path from its representative one, else that one itself."""
    uparea = net.upstream_area() if uparea is None else uparea
    if method == "dmm":
        return representatives(net, factor, uparea, on_edge(net.grid, factor))
    rep = representatives(net, factor, uparea, in_effective_area(net.grid, factor, "idx", ratio))
    if method == "eam":
        return rep
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    leaves = coarse_cell(net.grid, factor) != coarse_cell(net.grid, factor, "idx_ds")
    last = ascend(net.cells, {}, leaves, net.block)
    return rep.join(last.select(F.col("idx").alias("pixel"), "terminal"), "pixel").select("cell", F.col("terminal").alias("pixel"))


def _dmm_next(net: FlowNetwork, factor: int, out: DataFrame) -> DataFrame:
    """From each exit pixel down to where the path leaves the cell shifted by half a
    cell towards it; paths are lengthened by doubling until they get there."""
    g = net.grid
    half = factor / 2.0
    centre = lambda at: (F.floor(at / factor) + F.floor(at % factor / half)) * factor - 0.5
    out = saved(out.withColumns({"r0": centre(g.row("pixel")), "c0": centre(g.col("pixel"))}), "exits")
    todo, jump, reach, done = out.select("cell", "pixel", "r0", "c0", F.lit(0).cast("long").alias("pos"), F.col("pixel").alias("idx")), net.cells.where("idx <> idx_ds"), 1, None
    last = net.cells.withColumn("to_cell", coarse_cell(g, factor, "idx_ds"))
    paths = saved(todo, "dmm")
    while True:
        at = paths.join(last, "idx")
        beyond = (F.abs(g.row() - F.col("r0")) > half) | (F.abs(g.col() - F.col("c0")) > half)
        stops = at.where((F.col("idx") == F.col("idx_ds")) | ((F.col("to_cell") != F.col("cell")) & beyond))
        found = saved(stops.groupBy("cell").agg(F.min_by("idx", "pos").alias("at")), "dmm-found")
        done = found if done is None else done.unionByName(found)
        rest = paths.join(found, "cell", "left_anti")
        if rest.isEmpty():
            return done.select("cell", coarse_cell(g, factor, "at").alias("cell_ds"))
        ahead = rest.join(jump, "idx").select("cell", "pixel", "r0", "c0", (F.col("pos") + reach).alias("pos"), F.col("idx_ds").alias("idx"))
        paths = saved(rest.unionByName(ahead), "dmm")
        jump = saved(jump.join(jump.select(F.col("idx").alias("idx_ds"), F.col("idx_ds").alias("_to")), "idx_ds").select("idx", F.col("_to").alias("idx_ds")), "jump")
        reach *= 2


def _eam_next(net: FlowNetwork, factor: int, out: DataFrame, ratio: float) -> DataFrame:
    """The first effective area below that belongs to another cell."""
    g = net.grid
    inside = in_effective_area(g, factor, "idx", ratio)
    here = net.cells.where(inside | (F.col("idx") == F.col("idx_ds"))).select(F.lit(0).cast("long").alias("cell"), F.col("idx").alias("pixel"))
    # from one effective pixel to the next: a network of its own, whose ends are the steps into another cell
    chain = saved(_from(here, net, inside, "next").where("next is not null").select(F.col("pixel").alias("idx"), F.col("next").alias("idx_ds")), "effective")
    crossing = coarse_cell(g, factor) != coarse_cell(g, factor, "idx_ds")
    last = ascend(chain, {}, crossing, net.block).join(chain.select(F.col("idx").alias("terminal"), F.col("idx_ds").alias("_over")), "terminal")
    first = _from(out, net, inside, "first")
    both = first.join(last.select(F.col("idx").alias("first"), "_over"), "first", "left")
    there = F.when(coarse_cell(g, factor, "first") != F.col("cell"), F.col("first")).otherwise(F.coalesce("_over", "first"))
    return both.select("cell", coarse_cell(g, factor, there).alias("cell_ds"))


def _plus_next(net: FlowNetwork, factor: int, out: DataFrame, ratio: float) -> DataFrame:
    """The cell of the next outlet pixel below if it is adjacent, else of the first effective area."""
    g, ncol = net.grid, net.grid.scaled(factor).ncol
    marked = net.cells.join(out.select(F.col("pixel").alias("idx"), F.lit(True).alias("_out")), "idx", "left")
    to = ascend(marked, {}, F.col("_out"), net.block)
    first = net.cells.select(F.col("idx").alias("pixel"), F.col("idx_ds").alias("_first"))
    hit = out.join(first, "pixel").join(to.select(F.col("idx").alias("_first"), F.col("terminal").alias("outlet")), "_first").drop("_first")
    both = hit.join(_from(out, net, in_effective_area(g, factor, "idx", ratio), "passed").select("cell", "passed"), "cell")
    there = coarse_cell(g, factor, "outlet")
    return both.select("cell", F.when(adjacent(F.col("cell"), there, ncol), there).otherwise(coarse_cell(g, factor, "passed")).alias("cell_ds"))


def relocate(net: FlowNetwork, factor: int, out: DataFrame, uparea: DataFrame) -> DataFrame:
    """Outlet pixels (cell, pixel) moved until no single move makes fewer cells miss.

    Outlets are pixels where a path leaves its cell; between them paths are followed
    from one such pixel to the next.  A cell misses if the next outlet below its own is
    not in a cell beside it.  For each of them the moves are: a cell on its way gets its
    outlet on the way, or the cell itself another one of its pixels.  A move concerns
    the cell that is moved, those that drain to it and those whose way passes the new
    outlet; from these follows how many cells less miss.  In each round the best move
    of every neighbourhood is made, or the best of all if that doesn't help; of equal
    ones that to the larger upstream area.
    """
    g, ncol = net.grid, net.grid.scaled(factor).ncol
    at = lambda c: coarse_cell(g, factor, c)
    leaves = at("idx") != at("idx_ds")
    ends = ascend(net.cells, {}, leaves, net.block)
    node = net.cells.where(leaves | (F.col("idx") == F.col("idx_ds"))).withColumnRenamed("idx_ds", "_first")
    node = node.join(ends.select(F.col("idx").alias("_first"), "terminal"), "_first").join(uparea.select("idx", "uparea"), "idx")
    node = saved(node.select("idx", F.when(F.col("_first") == F.col("idx"), F.col("idx")).otherwise(F.coalesce("terminal", "idx")).alias("idx_ds"), at("idx").alias("home"), "uparea"), "nodes")
    ways = FlowNetwork(node)
    beside = lambda a, b: adjacent(F.col(a), F.col(b), ncol)

    def followed(out: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(idx, next, hit): the next outlet below every pixel, or where its path ends if
        there is none; and (cell, pixel, next, hit, misses) of the cells."""
        chosen = out.select(F.col("pixel").alias("idx"), F.lit(True).alias("_out"))
        to = ways.ascend(chosen, {}, F.col("_out"))
        there = to.select(F.col("idx").alias("idx_ds"), "terminal")
        below = node.join(there, "idx_ds").join(chosen.select(F.col("idx").alias("terminal"), "_out"), "terminal", "left")
        below = saved(below.select("idx", F.col("terminal").alias("next"), F.coalesce("_out", F.lit(False)).alias("hit")), "below")
        cells = out.join(below.withColumnRenamed("idx", "pixel"), "pixel")
        misses = (F.col("pixel") != F.col("next")) & ~(F.col("hit") & adjacent(F.col("cell"), at("next"), ncol))
        return below, saved(cells.select("cell", "pixel", "next", "hit", misses.alias("misses")), "cells")

    def moves(below: DataFrame, cells: DataFrame) -> DataFrame:
        """(moved, pixel, gain, uparea, near): moves that make fewer cells miss, with the
        cells that they concern."""
        ahead = cells.where("pixel <> next").join(node.select(F.col("idx").alias("pixel"), F.col("idx_ds").alias("start")), "pixel").select("cell", "start")
        stops = cells.select(F.col("pixel").alias("idx"))
        path = ways.path(ahead.select(F.col("start").alias("idx")).distinct(), stops)
        path = ahead.join(path, "start").join(stops, "idx", "left_anti").select(F.col("cell").alias("user"), "idx")
        path = saved(path, "passed")  # (user, idx): what lies between a cell's outlet and the next one
        homes = node.select("idx", F.col("home").alias("moved"), "uparea")
        wrong = cells.where("misses").select(F.col("cell").alias("user"))
        along = path.join(wrong, "user", "left_semi").select("idx").distinct().join(homes, "idx")
        inside = homes.join(wrong.withColumnRenamed("user", "moved"), "moved", "left_semi")
        tried = along.unionByName(inside).distinct().join(stops, "idx", "left_anti")
        old = cells.select(F.col("cell").alias("moved"), F.col("pixel").alias("old"), F.col("next").alias("past"), F.col("hit").alias("past_hit"), F.col("misses").alias("missed"))
        tried = tried.join(old, "moved").join(below.select("idx", F.col("next").alias("then"), F.col("hit").alias("then_hit")), "idx")
        on_way = path.select(F.col("user").alias("moved"), "idx", F.lit(True).alias("under"))
        tried = saved(tried.join(on_way, ["moved", "idx"], "left").withColumn("under", F.coalesce("under", F.lit(False))), "tried")
        # the moved cell: below its new outlet, past its old one
        behind = F.col("then") == F.col("old")
        own_next, own_hit = F.when(behind, F.col("past")).otherwise(F.col("then")), F.when(behind, F.col("past_hit") & (F.col("past") != F.col("old"))).otherwise(F.col("then_hit"))
        own = tried.select("moved", "idx", F.col("moved").alias("user"), F.col("missed").alias("was"), ((F.col("idx") != own_next) & ~(own_hit & adjacent(F.col("moved"), at(own_next), ncol))).alias("is"))
        passing = path.select("user", "idx", F.lit(True).alias("passes"))
        # cells that drained to the old outlet
        drained = tried.join(cells.select(F.col("cell").alias("user"), F.col("next").alias("old"), F.col("hit").alias("_hit"), F.col("misses").alias("was"), F.col("pixel").alias("own")), "old").where("_hit and user <> moved")
        drained = drained.join(passing, ["user", "idx"], "left")
        meets = F.coalesce(F.col("passes"), F.lit(False)) | F.col("under")
        on = F.col("past_hit") & (F.col("past") != F.col("old")) & adjacent(F.col("user"), at("past"), ncol)
        drained = drained.select("moved", "idx", "user", "was", F.when(meets, ~beside("user", "moved")).otherwise(~on).alias("is"))
        # cells on whose way the new outlet lies
        passed = tried.join(passing, "idx").where("user <> moved").join(cells.select(F.col("cell").alias("user"), F.col("next").alias("_next"), F.col("misses").alias("was")), "user").where("_next <> old")
        passed = passed.select("moved", "idx", "user", "was", (~beside("user", "moved")).alias("is"))
        every = saved(own.unionByName(drained).unionByName(passed), "concerned")
        gain = every.groupBy("moved", "idx").agg((F.sum(F.col("was").cast("int")) - F.sum(F.col("is").cast("int"))).alias("gain"), F.collect_set("user").alias("users"))
        good = gain.where("gain > 0").join(tried, ["moved", "idx"])
        near = F.array_distinct(F.concat("users", F.array("moved", at("past"), at("then"))))
        return good.select("moved", F.col("idx").alias("pixel"), "gain", "uparea", near.alias("near"))

    below, cells = followed(out)
    missing = cells.where("misses").count()
    for _ in range(MAX_ROUNDS):
        if not missing:
            break
        good = saved(moves(below, cells), "moves")
        rank = F.struct((-F.col("gain")).alias("g"), (-F.col("uparea")).alias("a"), "moved", "pixel")
        ranked = good.withColumn("rank", rank)
        best = ranked.select(F.explode("near").alias("c"), "rank").groupBy("c").agg(F.min("rank").alias("first"))
        beaten = ranked.select("moved", "pixel", "rank", F.explode("near").alias("c")).join(best, "c").where("rank <> first").select("moved", "pixel").distinct()
        accepted = saved(ranked.join(beaten, ["moved", "pixel"], "left_anti").select(F.col("moved").alias("cell"), F.col("pixel").alias("_new"), "rank"), "accepted")
        n = accepted.count()
        for part in [accepted, accepted.orderBy("rank").limit(1)][: min(n, 2)]:
            new = saved(out.join(part.select("cell", "_new"), "cell", "left").select("cell", F.coalesce("_new", "pixel").alias("pixel")), "outlets")
            below_new, cells_new = followed(new)
            left = cells_new.where("misses").count()
            if left < missing:
                break
        if not n or left >= missing:
            break
        out, below, cells, missing = new, below_new, cells_new, left
    return out


def upscale(net: FlowNetwork, factor: int, method: str = "ihu", uparea: DataFrame | None = None, ratio: float = 0.5) -> tuple[FlowNetwork, DataFrame]:
    """The coarse network and its outlet pixels (cell, pixel)."""
    if net.grid is None:
        raise ValueError("upscaling takes a network on a grid")
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if factor < 2:
        raise ValueError("the factor is 2 or more")
    uparea = saved(net.upstream_area() if uparea is None else uparea, "uparea")
    out = saved(outlet_pixels(net, factor, uparea, method, ratio), "outlets")
    if method == "ihu":
        out = relocate(net, factor, out, uparea)
    if method == "dmm":
        cells = _dmm_next(net, factor, out)
    elif method == "eam":
        cells = _eam_next(net, factor, out, ratio)
    else:
        cells = _plus_next(net, factor, out, ratio)
    coarse = FlowNetwork(saved(cells.select(F.col("cell").alias("idx"), F.col("cell_ds").alias("idx_ds")), "coarse"), net.grid.scaled(factor))
    return coarse, out


def upscale_error(net: FlowNetwork, coarse: FlowNetwork, outlets: DataFrame) -> DataFrame:
    """(cell, connected): 1 if the next outlet pixel below a cell's outlet is that of
    its downstream cell, else 0; -1 for cells without outlet or downstream cell."""
    marked = net.cells.join(outlets.select(F.col("pixel").alias("idx"), F.lit(True).alias("_out")), "idx", "left")
    to = ascend(marked, {}, F.col("_out"), net.block)
    first = net.cells.select(F.col("idx").alias("pixel"), F.col("idx_ds").alias("_first"))
    hit = outlets.join(first, "pixel").join(to.select(F.col("idx").alias("_first"), "terminal"), "_first").select("cell", "terminal")
    want = outlets.select(F.col("cell").alias("idx_ds"), F.col("pixel").alias("_want"))
    both = coarse.cells.join(want, "idx_ds", "left").join(hit.withColumnRenamed("cell", "idx"), "idx", "full")
    known = F.col("terminal").isNotNull() & F.col("idx_ds").isNotNull()
    return both.select(F.col("idx").alias("cell"), F.when(~known, -1).when(F.col("terminal").eqNullSafe(F.col("_want")), 1).otherwise(0).alias("connected"))


def upscale_check(net: FlowNetwork, coarse: FlowNetwork, outlets: DataFrame, min_length: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cell, valid, short) of the coarse cells, and (idx, stream) of the pixels.

    A cell is valid if the next outlet pixel below its own (or the pit that the path
    ends at) is that of its downstream cell, and then short if it is ``min_length``
    pixels away or less.  Pixels have their cell's number at outlets, -1 on the paths
    between them, else -9.
    """
    marked = saved(net.cells.join(outlets.select(F.col("pixel").alias("idx"), "cell"), "idx", "left"), "marked")
    to = ascend(marked.select("idx", "idx_ds", F.col("cell").alias("_cell"), F.lit(1).alias("steps")), {"steps": "sum"}, F.col("_cell").isNotNull(), net.block)
    own = outlets.select("cell", F.col("pixel").alias("idx")).join(net.cells, "idx").select("cell", F.col("idx").alias("pixel"), F.col("idx_ds").alias("idx"))
    hit = own.join(to, "idx").select("cell", "terminal", F.when(F.col("pixel") == F.col("idx"), F.lit(1)).otherwise(F.col("steps") + 1).alias("away"))
    want = outlets.select(F.col("cell").alias("idx_ds"), F.col("pixel").alias("want"))
    both = coarse.cells.join(want, "idx_ds", "left").join(hit.withColumnRenamed("cell", "idx"), "idx", "left")
    valid = F.col("terminal").eqNullSafe(F.col("want")) & F.col("terminal").isNotNull()
    cells = both.select(F.col("idx").alias("cell"), valid.alias("valid"), (valid & (F.col("away") <= min_length)).alias("short"))
    above = net.descend(marked.select("idx", F.col("cell").isNotNull().cast("int").alias("n")), {"n": "sum"})
    stream = F.when(F.col("cell").isNotNull(), F.col("cell")).when((F.col("n") > 0) & (F.col("idx") != F.col("idx_ds")), F.lit(-1)).otherwise(F.lit(-9))
    return cells, marked.join(above.select("idx", "n"), "idx", "left").select("idx", stream.cast("long").alias("stream"))
