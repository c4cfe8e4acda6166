"""Stream orders, segments and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators.network import FlowNetwork
from thalweg.plans import ascend, descend, saved


def _masked(net: FlowNetwork, mask: DataFrame | None) -> DataFrame:
    """Cells of the mask that reach a pit; where flow leaves the mask it ends."""
    cells = net.cells.join(net.rank().where("rank >= 0").select("idx"), "idx", "left_semi")
    if mask is None:
        return cells
    inside = mask.select("idx").distinct()
    there = inside.select(F.col("idx").alias("idx_ds"), F.lit(True).alias("_in"))
    return cells.join(inside, "idx", "left_semi").join(there, "idx_ds", "left").select("idx", F.when(F.col("_in"), F.col("idx_ds")).otherwise(F.col("idx")).alias("idx_ds"))


def strahler_order(net: FlowNetwork, mask: DataFrame | None = None) -> DataFrame:
    """(idx, order): Strahler order, 0 outside the mask.

    By peeling: cells of order above s are those downstream of a cell at which
    two branches of order s meet, so there is one upstream fold per order, each over
    what the one before left: a network that shrinks by about three quarters.
    """
    cells, peeled = saved(_masked(net, mask), "strahler"), []
    while not cells.isEmpty():
        peeled.append(cells.select("idx"))
        meets = cells.where("idx <> idx_ds").groupBy(F.col("idx_ds").alias("idx")).agg(F.count("*").alias("n")).where("n > 1")
        marked = cells.join(meets.select("idx", F.lit(1).alias("up")), "idx", "left")
        above = descend(marked, {"up": "max"}, net.block).where("up = 1").select("idx")
        cells = saved(cells.join(above, "idx", "left_semi"), "peel")
    ones = peeled[0].select("idx", F.lit(1).alias("s"))
    for p in peeled[1:]:
        ones = ones.unionByName(p.select("idx", F.lit(1).alias("s")))
    order = ones.groupBy("idx").agg(F.sum("s").cast("int").alias("order"))
    return net.cells.select("idx").join(order, "idx", "left").select("idx", F.coalesce("order", F.lit(0)).alias("order"))


def classic_order(net: FlowNetwork, mask: DataFrame | None = None, uparea: DataFrame | None = None) -> DataFrame:
    """(idx, order): 1 on main stems from pits, one more on each tributary; 0 where
    the mask ends before a pit, and outside it."""
    inside = net.cells if mask is None else net.cells.join(mask.select("idx").distinct(), "idx", "left_semi")
    n = net.upstream_count(mask).select(F.col("idx").alias("idx_ds"), "n")
    main = net.main_upstream(uparea).select(F.col("idx").alias("idx_ds"), "idx_us")
    edges = inside.join(n, "idx_ds", "left").join(main, "idx_ds", "left")
    side = (F.col("idx") != F.col("idx_ds")) & (F.col("n") > 1) & ~F.col("idx").eqNullSafe(F.col("idx_us"))
    marked = net.cells.join(edges.select("idx", side.cast("int").alias("order"), F.lit(True).alias("_in")), "idx", "left")
    ends = saved(marked, "classic")
    out = ascend(ends, {"order": "sum"}, F.col("_in").isNull(), net.block)
    pits = ends.select(F.col("idx").alias("terminal"), (F.col("_in") & (F.col("idx") == F.col("idx_ds"))).cast("int").alias("_base"))
    order = out.join(pits, "terminal").join(inside.select("idx"), "idx", "left_semi").select("idx", (F.col("order") + F.coalesce("_base", F.lit(0))).cast("int").alias("order"))
    return net.cells.select("idx").join(order, "idx", "left").select("idx", F.coalesce("order", F.lit(0)).alias("order"))


def stream_order(net: FlowNetwork, kind: str = "strahler", mask: DataFrame | None = None, uparea: DataFrame | None = None) -> DataFrame:
    if kind == "strahler":
        return strahler_order(net, mask)
    if kind == "classic":
        return classic_order(net, mask, uparea)
    raise ValueError("kind is strahler or classic")


def segments(net: FlowNetwork, mask: DataFrame | None = None, max_len: int = 0) -> DataFrame:
    """(seg, part, pos, idx): the network of the mask cut at confluences.

    A segment runs from a headwater or confluence (``seg``) downstream to the next
    confluence or pit, that cell included; there is also one of two equal cells at
    each pit.  With ``max_len`` longer ones are divided into parts of about that
    many cells, which share their end points.
    """
    n = saved(net.upstream_count(mask), "upstream-count")
    inside = net.rank().where("rank >= 0").select("idx")
    if mask is not None:
        inside = inside.join(mask.select("idx").distinct(), "idx", "left_semi")
    heads = n.where("n <> 1").join(inside, "idx", "left_semi").select("idx")
    # a head that is a confluence doesn't end its own segment: paths start one cell below it
    first = net.cells.join(heads, "idx", "left_semi")
    stops = n.where("n > 1").select("idx")
    below = net.path(first.where("idx <> idx_ds").select(F.col("idx_ds").alias("idx")).distinct(), stops)
    members = first.where("idx <> idx_ds").select(F.col("idx").alias("seg"), F.col("idx_ds").alias("start")).join(below, "start").select("seg", (F.col("pos") + 1).alias("pos"), "idx")
    members = members.unionByName(first.select(F.col("idx").alias("seg"), F.lit(0).cast("long").alias("pos"), "idx"))
    at_pit = members.join(net.pits(), "idx", "left_semi").select("idx").distinct()
    pits = at_pit.select(F.col("idx").alias("seg"), F.lit(-1).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("pos"), "idx")
    sizes = members.groupBy("seg").agg(F.count("*").alias("l"))
    members = members.join(sizes.where("l > 1"), "seg")
    if max_len <= 0:
        return members.select("seg", F.lit(0).alias("part"), "pos", "idx").unionByName(pits)
    # part i of k takes n cells from i n on and the next one; the last takes the rest
    k = F.when(F.col("l") / max_len > 1.5, F.bround(F.col("l") / max_len)).otherwise(1).cast("long")
    cut = members.withColumn("k", F.when(F.col("l") > max_len, k).otherwise(1)).withColumn("n", F.bround(F.col("l") / F.col("k")).cast("long"))
    own = F.least(F.floor(F.col("pos") / F.col("n")), F.col("k") - 1)
    shared = (F.col("pos") % F.col("n") == 0) & (F.col("pos") > 0) & (F.floor(F.col("pos") / F.col("n")) < F.col("k"))
    parts = F.when(shared, F.array(own, own - 1)).otherwise(F.array(own))
    cut = cut.select("seg", F.explode(parts).alias("part"), "pos", "idx", "n")
    return cut.select("seg", F.col("part").cast("int").alias("part"), (F.col("pos") - F.col("part") * F.col("n")).alias("pos"), "idx").unionByName(pits)


def outlet_segments(net: FlowNetwork, outlets: DataFrame, mask: DataFrame | None = None, max_len: int = 0, direction: str = "down", uparea: DataFrame | None = None) -> DataFrame:
    """(seg, part, pos, idx): from each outlet (idx, or x and y) along the path down- or
    main upstream to the next outlet, that one included, as long as cells are in
    ``mask`` and no longer than ``max_len`` cells.  Positions run downstream; paths that
    end at a pit have one more part, of two equal cells."""
    if direction not in ("up", "down"):
        raise ValueError("direction is 'up' or 'down'")
    way = (net if direction == "down" else net._reversed(uparea)).cells
    if mask is not None:
        inside = mask.select(F.col("idx").alias("idx_ds"), F.lit(True).alias("_in")).distinct()
        way = way.join(inside, "idx_ds", "left").select("idx", F.when(F.col("_in"), F.col("idx_ds")).otherwise(F.col("idx")).alias("idx_ds"))
    way = FlowNetwork(saved(way, "way"), net.grid)
    outlets = saved(net.points(outlets).select("idx").distinct(), "outlets")
    first = way.cells.join(outlets, "idx")
    on = first.where("idx <> idx_ds")
    ahead = way.path(on.select(F.col("idx_ds").alias("idx")).distinct(), outlets)
    members = on.select(F.col("idx").alias("seg"), F.col("idx_ds").alias("start")).join(ahead, "start").select("seg", (F.col("pos") + 1).alias("pos"), "idx")
    members = members.unionByName(first.select(F.col("idx").alias("seg"), F.lit(0).cast("long").alias("pos"), "idx"))
    if max_len > 0:
        members = members.where(F.col("pos") < max_len)
    members = saved(members, "segments")
    size = members.groupBy("seg").agg(F.max("pos").alias("last"), F.max_by("idx", "pos").alias("end"))
    lines = members.join(size.where("last > 0"), "seg").select("seg", F.lit(0).alias("part"), (F.col("pos") if direction == "down" else F.col("last") - F.col("pos")).alias("pos"), "idx")
    if direction == "up":
        return lines
    at_pit = size.join(net.pits().withColumnRenamed("idx", "end"), "end", "left_semi")
    passed = at_pit.join(outlets.withColumnRenamed("idx", "end"), "end", "left_anti").unionByName(at_pit.where("seg = end"))
    return lines.unionByName(passed.select("seg", F.lit(-1).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("pos"), F.col("end").alias("idx")))


def features(net: FlowNetwork, lines: DataFrame, key: list[str], coordinates: DataFrame | None = None, maps: DataFrame | None = None) -> DataFrame:
    """(type, geometry, properties) structs, one LineString per key of ``lines``
    (key..., pos, idx) with two points or more.  Properties are idx and idx_ds of
    the first and last cell, whether the line ends in two equal cells (as at pits), and the columns of ``maps``
    (idx, ...) at the first cell."""
    if coordinates is None:
        if net.grid is None:
            raise ValueError("coordinates are needed without a grid")
        x, y = net.grid.xy("idx")
        points = lines.withColumns({"x": x, "y": y})
    else:
        points = lines.join(coordinates.select("idx", "x", "y"), "idx")
    group = points.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "idx", "x", "y"))).alias("p")).where(F.size("p") > 1)
    line = group.select(
        F.transform("p", lambda q: F.array(q["x"], q["y"])).alias("coordinates"),
        F.element_at("p", 1)["idx"].alias("idx"),
        F.element_at("p", -1)["idx"].alias("idx_ds"),
        (F.element_at("p", -1)["idx"] == F.element_at("p", -2)["idx"]).alias("pit"),
    )
    extra = [] if maps is None else [c for c in maps.columns if c != "idx"]
    if extra:
        line = line.join(maps, "idx", "left")
    return line.select(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"),
        F.struct("idx", "idx_ds", "pit", *extra).alias("properties"),
    )


def vectorize(net: FlowNetwork, mask: DataFrame | None = None, direction: str = "down", **kw) -> DataFrame:
    """One line of two points per cell (of the mask), to its next cell downstream or main upstream."""
    cells = net.cells
    if direction == "up":
        cells = net.main_upstream().where("idx_us is not null").select("idx", F.col("idx_us").alias("idx_ds"))
    if mask is not None:
        cells = cells.join(mask.select("idx"), "idx", "left_semi")
    lines = cells.select(F.col("idx").alias("seg"), F.posexplode(F.array("idx", "idx_ds")).alias("pos", "idx"))
    return features(net, lines, ["seg"], **kw)
