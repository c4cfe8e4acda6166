"""Queries of the network operators over the driver's tables, and their SQL.

Networks are derived from table columns by integer arithmetic (see ``n1`` ... ``n4``),
so that both engines see the same cells.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import encodings
from thalweg.functions.grid import GridSpec, edge_cells
from thalweg.operators import FlowNetwork, basins, elevation, rivers, streams, subgrid, upscale, windows
from thalweg.plans import saved
from thalweg.plans.store import shared_dir
from thalweg.sources import load, save

NCOL = 100
GEO = (0.25, 0.0, -10.0, 0.0, -0.05, 60.0)


# --- networks
def _grid(orders: DataFrame, latlon: bool = False) -> GridSpec:
    nrow = (orders.agg(F.max("o_orderkey")).first()[0] or 0) // NCOL + 1
    return GridSpec(nrow, NCOL, GEO, True) if latlon else GridSpec(nrow, NCOL)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_totalprice")


def codes(spark: SparkSession, d: str) -> tuple[DataFrame, GridSpec]:
    """A raster of D8 codes: row, col, code."""
    o = _orders(spark, d)
    steps = F.element_at(F.array(*[F.lit(c) for c in (1, 2, 4, 8, 2, 4, 1, 4)]), (F.col("cents") % 8 + 1).cast("int"))
    code = F.when(F.col("cents") % 53 == 0, 247).when(F.col("cents") % 97 == 0, 16).otherwise(steps)
    return o.select(F.floor(F.col("o_orderkey") / NCOL).cast("int").alias("row"), (F.col("o_orderkey") % NCOL).cast("int").alias("col"), code.alias("code")), _grid(o)


def n1(spark: SparkSession, d: str, latlon: bool = False) -> FlowNetwork:
    c, g = codes(spark, d)
    return FlowNetwork.from_array(c, GridSpec(g.nrow, g.ncol, GEO, True) if latlon else g, "d8")


def heights(spark: SparkSession, d: str) -> tuple[DataFrame, GridSpec]:
    o = _orders(spark, d)
    return o.select(F.col("o_orderkey").alias("idx"), F.col("cents").cast("double").alias("elev")), _grid(o)


def n2(spark: SparkSession, d: str) -> tuple[FlowNetwork, DataFrame]:
    """Each cell drains to its lowest neighbour if that is lower."""
    from thalweg.functions.grid import NEIGHBOURS, with_neighbours

    z, g = heights(spark, d)
    pair = z.select("idx", F.struct("elev", "idx").alias("p"))
    near = with_neighbours(pair, g, "p")
    low = F.least(*[F.col(f"n{k}") for k in range(len(NEIGHBOURS))])
    cells = near.select("idx", F.when(low["elev"] < F.col("p.elev"), low["idx"]).otherwise(F.col("idx")).alias("idx_ds"))
    return FlowNetwork(saved(cells, "n2"), g), z


def n3(spark: SparkSession, d: str) -> FlowNetwork:
    p = spark.read.parquet(f"{d}/part.parquet")
    to = F.col("p_partkey") - 1 - F.col("p_size") % 4
    pit = (F.col("p_partkey") % 250 == 0) | (to < 0)
    return FlowNetwork.from_dataframe(p.select(F.col("p_partkey").alias("id"), F.when(pit, F.lit(-1)).otherwise(to).alias("ds")))


def n4(spark: SparkSession, d: str) -> tuple[FlowNetwork, DataFrame]:
    e = spark.read.parquet(f"{d}/events.parquet")
    to = F.col("event_id") - 1 - F.col("user_id") % 3
    pit = (F.col("event_id") % 500 == 0) | (to < 0)
    net = FlowNetwork.from_dataframe(e.select(F.col("event_id").alias("id"), F.when(pit, F.col("event_id")).otherwise(to).alias("ds")))
    return net, e.select(F.col("event_id").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("value"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("long").alias("value"))


N1 = """
c0 AS (SELECT o_orderkey AS idx, o_orderkey // 100 AS r, o_orderkey % 100 AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
c1 AS (SELECT idx, r, c, CASE WHEN cents % 53 = 0 THEN 247 WHEN cents % 97 = 0 THEN 16 ELSE [1,2,4,8,2,4,1,4][CAST(cents % 8 + 1 AS INT)] END AS code FROM c0),
c2 AS (SELECT idx, r + CASE WHEN code IN (2,4,8) THEN 1 ELSE 0 END AS tr, c + CASE WHEN code IN (1,2) THEN 1 WHEN code IN (8,16) THEN -1 ELSE 0 END AS tc FROM c1 WHERE code <> 247),
net AS (SELECT c2.idx, coalesce(t.idx, c2.idx) AS ds FROM c2 LEFT JOIN (SELECT * FROM c1 WHERE code <> 247) t ON t.r = c2.tr AND t.c = c2.tc)
"""
N2 = """
z AS (SELECT o_orderkey AS idx, o_orderkey // 100 AS r, o_orderkey % 100 AS c, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS elev FROM orders),
low AS (SELECT a.idx, min({'e': b.elev, 'i': b.idx}) AS m FROM z a JOIN z b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.idx <> b.idx
        AND b.idx BETWEEN a.idx - 101 AND a.idx + 101 GROUP BY a.idx),
net AS (SELECT z.idx, CASE WHEN m.e < z.elev THEN m.i ELSE z.idx END AS ds FROM z LEFT JOIN low USING (idx))
"""
N3 = "net AS (SELECT p_partkey AS idx, CASE WHEN p_partkey % 250 = 0 OR p_partkey - 1 - p_size % 4 < 0 THEN p_partkey ELSE p_partkey - 1 - p_size % 4 END AS ds FROM part), val AS (SELECT p_partkey AS idx, CAST(p_size AS BIGINT) AS value FROM part)"
N4 = "net AS (SELECT event_id AS idx, CASE WHEN event_id % 500 = 0 OR event_id - 1 - user_id % 3 < 0 THEN event_id ELSE event_id - 1 - user_id % 3 END AS ds FROM events), val AS (SELECT event_id AS idx, CAST(round(value * 100) AS BIGINT) AS value FROM events)"
#: Walks up from the pits: cells of loops are never reached.
RANK = "r(idx, pit, rank) AS (SELECT idx, idx, 0 FROM net WHERE idx = ds UNION ALL SELECT n.idx, r.pit, r.rank + 1 FROM net n JOIN r ON n.ds = r.idx AND n.idx <> n.ds)"
#: (ancestor, descendant) pairs of the cells that reach a pit.
PAIRS = "p(anc, des) AS (SELECT idx, idx FROM r UNION ALL SELECT n.ds, p.des FROM p JOIN net n ON n.idx = p.anc AND n.idx <> n.ds)"
AREA = "area AS (SELECT anc AS idx, count(*) AS uparea FROM p GROUP BY anc)"
MAIN = "main AS (SELECT ds AS idx, max({'a': uparea, 'i': -net.idx}) AS m FROM net JOIN area USING (idx) WHERE net.idx <> ds GROUP BY ds)"


def _sql(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__.removeprefix("q_")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


# --- construction and encodings
@query(_sql(N1, select="SELECT idx, ds AS idx_ds FROM net"))
def q_from_array_d8(spark, d):
    return n1(spark, d).cells


@query(_sql(N1, select="SELECT idx, CASE WHEN ds % 100 = 3 THEN idx ELSE ds END AS idx_ds FROM net WHERE idx % 100 <> 3"))
def q_from_array_masked(spark, d):
    c, g = codes(spark, d)
    mask = g.cells(spark).where("col <> 3").select("idx")
    return FlowNetwork.from_array(c, g, "infer", mask=mask).cells


@query(_sql(N3, select="SELECT idx, ds AS idx_ds FROM net"))
def q_from_dataframe(spark, d):
    return n3(spark, d).cells


LDD_CODE = "CASE code WHEN 247 THEN 255 WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 8 THEN 1 WHEN 16 THEN 4 END"


@query(_sql(N1, select=f"SELECT r AS \"row\", c AS col, {LDD_CODE} AS code FROM c1"))
def q_d8_to_ldd(spark, d):
    c, _ = codes(spark, d)
    return c.select("row", "col", encodings.convert(F.col("code"), "d8", "ldd").alias("code"))


@query(_sql(N1, select="SELECT c1.r AS \"row\", c1.c AS col, CASE WHEN net.idx IS NULL THEN 255 WHEN net.idx = ds THEN 5 ELSE 5 + (ds % 100 - net.idx % 100) - 3 * (ds // 100 - net.idx // 100) END AS code FROM c1 LEFT JOIN net USING (idx)"))
def q_to_array_ldd(spark, d):
    return n1(spark, d).to_array("ldd")


@query(_sql(N1, select="SELECT c1.r AS \"row\", c1.c AS col, CASE WHEN net.idx IS NULL THEN -9999 WHEN net.idx = ds THEN -9 ELSE ds % 100 + 1 END AS nextx, CASE WHEN net.idx IS NULL THEN -9999 WHEN net.idx = ds THEN -9 ELSE ds // 100 + 1 END AS nexty FROM c1 LEFT JOIN net USING (idx)"))
def q_to_array_nextxy(spark, d):
    return n1(spark, d).to_array("nextxy")


D8_OF = "CASE WHEN net.idx IS NULL THEN 247 WHEN net.idx = ds THEN 0 WHEN ds - net.idx = 1 THEN 1 WHEN ds - net.idx = 101 THEN 2 WHEN ds - net.idx = 100 THEN 4 WHEN ds - net.idx = 99 THEN 8 WHEN ds - net.idx = -1 THEN 16 END"


@query(_sql(N1, select=f"SELECT c1.r AS \"row\", c1.c AS col, {D8_OF} AS code FROM c1 LEFT JOIN net USING (idx)"))
def q_to_array_d8(spark, d):
    return n1(spark, d).to_array("d8")


@query(_sql(N1, select=f"SELECT c1.r AS \"row\", c1.c AS col, {D8_OF} AS code FROM c1 LEFT JOIN net USING (idx)"))
def q_ldd_to_d8(spark, d):
    return n1(spark, d).to_array("ldd").select("row", "col", encodings.convert(F.col("code"), "ldd", "d8").alias("code"))


@query(_sql(N1, select="SELECT idx, ds AS idx_ds FROM net"))
def q_from_array_ldd(spark, d):
    """Encoded and decoded, the encoding inferred."""
    net = n1(spark, d)
    return FlowNetwork.from_array(saved(net.to_array("ldd"), "ldd"), net.grid, "infer").cells


@query(_sql(N1, select="SELECT idx, ds AS idx_ds FROM net"))
def q_from_array_nextxy(spark, d):
    net = n1(spark, d)
    return FlowNetwork.from_array(saved(net.to_array("nextxy"), "nextxy"), net.grid, "infer").cells


@query(_sql(N1, select="SELECT idx, ds AS idx_ds FROM net"))
def q_save_load(spark, d):
    """A network written with its grid and read again."""
    net = n1(spark, d, latlon=True)
    path = f"{shared_dir(spark)}/thalweg-{spark.sparkContext.applicationId}/saved-{uuid.uuid4().hex}"
    save(net, path)
    again = load(spark, path)
    if again.grid != net.grid:
        raise ValueError("the grid isn't the one that was saved")
    return again.cells


@query("SELECT code, code IN (0, 255) AS pit_d8, code = 247 AS missing_d8, code IN (0, 1, 2, 4, 8, 16, 32, 64, 128, 247, 255) AS valid_d8, code = 5 AS pit_ldd, code = 255 AS missing_ldd, code BETWEEN 1 AND 9 OR code = 255 AS valid_ldd FROM (SELECT CAST(unnest(range(256)) AS INT) AS code)")
def q_code_kinds(spark, d):
    """What each code is in the two local encodings."""
    c = F.col("code")
    out = spark.range(256).select(F.col("id").cast("int").alias("code"))
    kinds = [x for f in ("d8", "ldd") for x in (encodings.is_pit(c, f).alias(f"pit_{f}"), encodings.is_nodata(c, f).alias(f"missing_{f}"), c.isin(*encodings.encoding(f).codes).alias(f"valid_{f}"))]
    return out.select("code", *kinds)


# --- network properties
@query(_sql(N1, RANK, select="SELECT net.idx, coalesce(rank, -1) AS rank FROM net LEFT JOIN r USING (idx)"))
def q_rank(spark, d):
    return n1(spark, d).rank()


@query(_sql(N1, RANK, select="SELECT idx FROM net WHERE idx NOT IN (SELECT idx FROM r)"))
def q_loop_indices(spark, d):
    return n1(spark, d).loops()


@query(_sql(N1, select="SELECT idx FROM net WHERE idx = ds"))
def q_pit_indices(spark, d):
    return n1(spark, d).pits()


@query(_sql(N1, RANK, select="SELECT net.idx, CASE WHEN r.idx IS NULL THEN net.idx ELSE ds END AS idx_ds FROM net LEFT JOIN r USING (idx)"))
def q_repair_loops(spark, d):
    return n1(spark, d).repair_loops().cells


@query(_sql(N3, RANK, "s(idx, cur, done) AS (SELECT net.idx, net.idx, net.idx % 40 = 7 OR net.idx = ds FROM net WHERE net.idx % 150 = 5 UNION ALL SELECT s.idx, n.ds, n.ds % 40 = 7 OR m.ds = n.ds FROM s JOIN net n ON n.idx = s.cur JOIN net m ON m.idx = n.ds WHERE NOT s.done)", select="SELECT idx, CASE WHEN idx IN (SELECT cur FROM s WHERE done) THEN idx ELSE ds END AS idx_ds FROM net"))
def q_add_pits_snapped(spark, d):
    net = n3(spark, d)
    return net.add_pits(net.cells.where("idx % 150 = 5").select("idx"), net.cells.where("idx % 40 = 7").select("idx")).cells


@query(_sql(N1, RANK, select="SELECT idx, rank, row_number() OVER (ORDER BY rank, idx) - 1 AS pos FROM r"))
def q_order_cells(spark, d):
    return n1(spark, d).order()


@query(_sql(N1, select="SELECT a.idx, count(b.idx) AS n FROM net a LEFT JOIN net b ON b.ds = a.idx AND b.idx <> a.idx GROUP BY a.idx"))
def q_upstream_count(spark, d):
    return n1(spark, d).upstream_count()


@query(_sql(N1, select="SELECT idx FROM net WHERE idx NOT IN (SELECT ds FROM net WHERE idx <> ds)"))
def q_headwater_indices(spark, d):
    return n1(spark, d).headwaters()


@query(_sql(N1, select="SELECT ds AS idx FROM net WHERE idx <> ds GROUP BY ds HAVING count(*) > 1"))
def q_confluence_indices(spark, d):
    return n1(spark, d).confluences()


@query(_sql(N3, RANK, PAIRS, AREA, MAIN, select="SELECT net.idx, -m.i AS idx_us FROM net LEFT JOIN main USING (idx)"))
def q_main_upstream(spark, d):
    return n3(spark, d).main_upstream()


@query(_sql(N1, RANK, select="SELECT NOT EXISTS (SELECT 1 FROM net WHERE idx NOT IN (SELECT idx FROM r)) AS valid, (SELECT count(*) FROM r) AS nodes, (SELECT count(*) FROM net WHERE idx = ds) AS pits, (SELECT max(rank) FROM r) AS deepest"))
def q_network_counts(spark, d):
    net = n1(spark, d)
    one = net.rank().agg(F.max("rank").alias("deepest"))
    return one.select(F.lit(net.is_valid()).alias("valid"), F.lit(net.n_nodes()).cast("long").alias("nodes"), F.lit(net.pits().count()).cast("long").alias("pits"), "deepest")


@query(_sql(N1, select="SELECT c0.idx, net.idx IS NOT NULL AS present FROM c0 LEFT JOIN net USING (idx)"))
def q_mask(spark, d):
    """Which cells of the raster are cells of the network."""
    net = n1(spark, d)
    every = _orders(spark, d).select(F.col("o_orderkey").alias("idx"))
    return every.join(net.cells.select("idx", F.lit(True).alias("present")), "idx", "left").select("idx", F.coalesce("present", F.lit(False)).alias("present"))


@query(_sql(N1, select="SELECT ds AS idx, row_number() OVER (PARTITION BY ds ORDER BY idx) - 1 AS k, idx AS upstream FROM net WHERE idx <> ds"))
def q_upstream_matrix(spark, d):
    return n1(spark, d).upstream_matrix().select("idx", F.posexplode("upstream").alias("k", "upstream")).select("idx", F.col("k").cast("long").alias("k"), "upstream")


@query(_sql(N1, select="SELECT idx, ds AS idx_ds FROM net WHERE idx % 3 = 1"))
def q_flwdir_tuples(spark, d):
    net = n1(spark, d)
    return net.tuples(net.cells.where("idx % 3 = 1").select("idx"))


NEAR_CODE = "CASE WHEN net.idx = ds THEN 0 WHEN ds // 100 = net.idx // 100 OR ds % 100 = net.idx % 100 THEN 1 ELSE 2 END"


@query(_sql(N1, select=f"SELECT net.idx, {NEAR_CODE} AS kind FROM net"))
def q_step_kinds(spark, d):
    """Whether steps stay, go straight or diagonally, from neighbours' places."""
    net = n1(spark, d)
    g = net.grid
    far = F.abs(g.row() - g.row("idx_ds")) + F.abs(g.col() - g.col("idx_ds"))
    return net.cells.select("idx", far.cast("int").alias("kind"))


# --- tracing
@query(_sql(N3, "s(start, pos, idx, dist) AS (SELECT idx, 0, idx, CAST(0 AS DOUBLE) FROM net WHERE idx % 37 = 4 UNION ALL SELECT start, pos + 1, n.ds, dist + 1 FROM s JOIN net n USING (idx) WHERE n.idx <> n.ds AND pos < 25)", select="SELECT start, CAST(pos AS BIGINT) AS pos, idx, CAST(dist AS DOUBLE) AS dist FROM s"))
def q_path_capped(spark, d):
    net = n3(spark, d)
    return net.path(net.cells.where("idx % 37 = 4").select("idx"), max_length=25)


@query(_sql(N3, "s(idx, cur, dist, done) AS (SELECT idx, idx, 0, idx % 40 = 7 OR idx = ds FROM net WHERE idx % 11 = 3 UNION ALL SELECT s.idx, n.ds, dist + 1, n.ds % 40 = 7 OR m.ds = n.ds FROM s JOIN net n ON n.idx = s.cur JOIN net m ON m.idx = n.ds WHERE NOT s.done)", select="SELECT idx, cur AS terminal, CAST(dist AS DOUBLE) AS dist FROM s WHERE done"))
def q_snap(spark, d):
    net = n3(spark, d)
    return net.snap(net.cells.where("idx % 11 = 3").select("idx"), net.cells.where("idx % 40 = 7").select("idx"))


@query(_sql(N3, "s(start, pos, idx) AS (SELECT idx, 0, idx FROM net WHERE idx NOT IN (SELECT ds FROM net WHERE idx <> ds) UNION ALL SELECT start, pos + 1, n.ds FROM s JOIN net n USING (idx) WHERE n.idx <> n.ds)", select="SELECT start, CAST(pos AS BIGINT) AS pos, idx, CAST(pos AS DOUBLE) AS dist FROM s"))
def q_path(spark, d):
    """Whole paths from all headwaters."""
    net = n3(spark, d)
    return net.path(net.headwaters())


@query(_sql(N3, RANK, select="SELECT idx, pit AS terminal, CAST(rank AS DOUBLE) AS dist FROM r"))
def q_snap_all(spark, d):
    """Where the path from every cell ends."""
    net = n3(spark, d)
    return net.snap(net.cells.select("idx"))


@query(_sql(N1, RANK, select="SELECT idx, pit AS terminal, CAST(rank AS DOUBLE) AS dist FROM r"))
def q_snap_xy(spark, d):
    """From coordinates: the centres of all cells."""
    net = n1(spark, d, latlon=True)
    x, y = net.grid.xy("idx")
    return net.snap(net.repair_loops().cells.join(net.loops(), "idx", "left_anti").select(x.alias("x"), y.alias("y")))


REGION = "idx % 250 BETWEEN 60 AND 140"


@query(_sql(N3, RANK, PAIRS, f"i AS (SELECT idx FROM net WHERE {REGION})", "e AS (SELECT net.idx FROM net JOIN i ON i.idx = net.ds WHERE net.idx NOT IN (SELECT idx FROM i))", select="SELECT idx FROM e WHERE idx NOT IN (SELECT anc FROM p WHERE des IN (SELECT idx FROM e) AND anc <> des)"))
def q_inflow_idxs(spark, d):
    net = n3(spark, d)
    return net.inflow(net.cells.where(REGION).select("idx"))


@query(_sql(N3, RANK, PAIRS, f"i AS (SELECT idx FROM net WHERE {REGION})", "e AS (SELECT idx FROM net WHERE idx IN (SELECT idx FROM i) AND (ds = idx OR ds NOT IN (SELECT idx FROM i)))", select="SELECT idx FROM e WHERE idx NOT IN (SELECT des FROM p WHERE anc IN (SELECT idx FROM e) AND anc <> des)"))
def q_outflow_idxs(spark, d):
    net = n3(spark, d)
    return net.outflow(net.cells.where(REGION).select("idx"))


# --- neighbours and windows
@query(_sql(N4, select="SELECT net.idx, v.value FROM net JOIN val v ON v.idx = net.ds"))
def q_downstream(spark, d):
    net, v = n4(spark, d)
    return net.downstream(v)


@query(_sql(N4, "k AS (SELECT idx, CASE WHEN idx % 10 = 3 THEN NULL ELSE value END AS value FROM val)", "s AS (SELECT ds AS idx, sum(value) AS t FROM net JOIN k USING (idx) WHERE net.idx <> ds GROUP BY ds)", select="SELECT net.idx, CAST(CASE WHEN k.value IS NOT NULL THEN coalesce(s.t, 0) END AS BIGINT) AS value FROM net JOIN k USING (idx) LEFT JOIN s USING (idx)"))
def q_upstream_sum(spark, d):
    net, v = n4(spark, d)
    return net.upstream_sum(v.select("idx", F.when(F.col("idx") % 10 != 3, F.col("value")).alias("value")))


WINDOW = "down(idx, k, m) AS (SELECT idx, 0, idx FROM net UNION ALL SELECT down.idx, k + 1, n.ds FROM down JOIN net n ON n.idx = down.m WHERE n.idx <> n.ds AND k < 3), up(idx, k, m) AS (SELECT idx, 0, idx FROM net UNION ALL SELECT up.idx, k + 1, -main.m.i FROM up JOIN main ON main.idx = up.m WHERE k < 3), w AS (SELECT idx, m FROM down UNION ALL SELECT idx, m FROM up WHERE k > 0)"


@query(_sql(N3, RANK, PAIRS, AREA, MAIN, WINDOW, select="SELECT w.idx, round(sum(v.value) / count(*), 6) AS value FROM w JOIN val v ON v.idx = w.m GROUP BY w.idx"))
def q_moving_average(spark, d):
    return windows.moving_average(n3(spark, d), parts(spark, d), 3).select("idx", F.round("value", 6).alias("value"))


@query(_sql(N3, RANK, PAIRS, AREA, MAIN, WINDOW, select="SELECT w.idx, CAST(median(v.value) AS DOUBLE) AS value FROM w JOIN val v ON v.idx = w.m GROUP BY w.idx"))
def q_moving_median(spark, d):
    return windows.moving_median(n3(spark, d), parts(spark, d), 3)


@query()
def q_smooth_rivlen(spark, d):
    return windows.smooth_lengths(n3(spark, d), parts(spark, d).withColumnRenamed("value", "length"), 12.0)


@query(_sql(N3, "s(idx, cur, v) AS (SELECT net.idx, net.idx, CASE WHEN net.idx % 9 < 5 THEN value END FROM net JOIN val USING (idx) UNION ALL SELECT s.idx, n.ds, CASE WHEN n.ds % 9 < 5 THEN val.value END FROM s JOIN net n ON n.idx = s.cur JOIN val ON val.idx = n.ds WHERE s.v IS NULL AND n.idx <> n.ds)", select="SELECT idx, max(v) AS value FROM s GROUP BY idx"))
def q_fillnodata_up(spark, d):
    return n3(spark, d).fill_nodata(_gaps(spark, d))


def _gaps(spark, d):
    return parts(spark, d).select("idx", F.when(F.col("idx") % 9 < 5, F.col("value")).alias("value"))


FILL = "s(idx, v) AS (SELECT net.ds, value FROM net JOIN val USING (idx) WHERE net.idx % 9 < 5 AND net.idx <> net.ds UNION ALL SELECT n.ds, s.v FROM s JOIN net n USING (idx) WHERE s.idx % 9 >= 5 AND n.idx <> n.ds)"


@query(_sql(N3, FILL, "f AS (SELECT idx, max(v) AS v FROM s GROUP BY idx)", select="SELECT net.idx, CASE WHEN net.idx % 9 < 5 THEN value ELSE f.v END AS value FROM net JOIN val USING (idx) LEFT JOIN f USING (idx)"))
def q_fillnodata_down(spark, d):
    return n3(spark, d).fill_nodata(_gaps(spark, d), direction="down")


# --- accumulation
@query(_sql(N1, RANK, PAIRS, select="SELECT anc AS idx, count(*) AS uparea FROM p GROUP BY anc"))
def q_upstream_area(spark, d):
    return n1(spark, d).upstream_area()


@query(_sql(N4, "k AS (SELECT idx, value FROM val WHERE idx % 23 <> 7)", "b AS (SELECT net.idx, ds, net.idx = ds OR ds % 23 = 7 AS stop, value FROM net JOIN k USING (idx))", "p(anc, v, stop) AS (SELECT idx, value, stop FROM b UNION ALL SELECT b.ds, p.v, c.stop FROM p JOIN b ON b.idx = p.anc JOIN b c ON c.idx = b.ds WHERE NOT p.stop)", select="SELECT net.idx, CAST(s.value AS BIGINT) AS value FROM net LEFT JOIN (SELECT anc AS idx, sum(v) AS value FROM p GROUP BY anc) s USING (idx)"))
def q_accuflux_up(spark, d):
    net, v = n4(spark, d)
    return net.accumulate(v.where("idx % 23 <> 7"))


@query(_sql(N3, RANK, PAIRS, select="SELECT des AS idx, CAST(sum(value) AS BIGINT) AS value FROM p JOIN val ON val.idx = p.anc GROUP BY des"))
def q_accuflux_down(spark, d):
    return n3(spark, d).accumulate(parts(spark, d), direction="down")


@query(_sql(N1, "s(idx, dist) AS (SELECT idx, 0 FROM net WHERE idx = ds OR idx % 29 = 4 UNION ALL SELECT n.idx, dist + 1 FROM net n JOIN s ON n.ds = s.idx AND n.idx <> n.ds WHERE n.idx % 29 <> 4)", select="SELECT idx, CAST(dist AS BIGINT) AS dist FROM s"))
def q_stream_distance(spark, d):
    net = n1(spark, d)
    return net.stream_distance(net.cells.where("idx % 29 = 4").select("idx"))


def _tiled(spark, d) -> FlowNetwork:
    """The raster's network in tiles so small that paths cross several."""
    net = n1(spark, d)
    return FlowNetwork(net.cells, GridSpec(net.grid.nrow, net.grid.ncol, tile=16))


@query(_sql(N1, RANK, PAIRS, select="SELECT anc AS idx, count(*) AS uparea FROM p GROUP BY anc"))
def q_upstream_area_tiles(spark, d):
    return _tiled(spark, d).upstream_area()


@query(_sql(N1, RANK, select="SELECT net.idx, coalesce(rank, -1) AS rank FROM net LEFT JOIN r USING (idx)"))
def q_rank_tiles(spark, d):
    return _tiled(spark, d).rank()


# --- streams
def _strahler_sql(levels: int = 9) -> str:
    ctes = ["a1 AS (SELECT idx FROM r)"]
    for s in range(1, levels):
        ctes.append(f"b{s} AS (SELECT ds AS idx FROM net JOIN a{s} USING (idx) WHERE net.idx <> ds GROUP BY ds HAVING count(*) > 1), a{s + 1} AS (SELECT DISTINCT p.anc AS idx FROM p JOIN b{s} ON b{s}.idx = p.des)")
    union = " UNION ALL ".join(f"SELECT idx FROM a{s}" for s in range(1, levels + 1))
    return _sql(N3, RANK, PAIRS, *ctes, select=f"SELECT idx, CAST(count(*) AS INT) AS \"order\" FROM ({union}) GROUP BY idx")


@query(_strahler_sql())
def q_stream_order_strahler(spark, d):
    return streams.stream_order(n3(spark, d))


CLASSIC = "up AS (SELECT ds AS idx, count(*) AS n FROM net WHERE idx <> ds GROUP BY ds), o(idx, ord) AS (SELECT idx, 1 FROM net WHERE idx = ds UNION ALL SELECT n.idx, o.ord + CASE WHEN up.n > 1 AND -main.m.i <> n.idx THEN 1 ELSE 0 END FROM net n JOIN o ON o.idx = n.ds AND n.idx <> n.ds JOIN up ON up.idx = n.ds JOIN main ON main.idx = n.ds)"


@query(_sql(N3, RANK, PAIRS, AREA, MAIN, CLASSIC, select="SELECT idx, ord AS \"order\" FROM o"))
def q_stream_order_classic(spark, d):
    return streams.stream_order(n3(spark, d), "classic")


SEGMENT = "up AS (SELECT a.idx, count(b.idx) AS n FROM net a LEFT JOIN net b ON b.ds = a.idx AND b.idx <> a.idx GROUP BY a.idx), s(seg, pos, idx) AS (SELECT net.idx, 0, net.idx FROM net JOIN up USING (idx) WHERE n <> 1 UNION ALL SELECT seg, pos + 1, m.ds FROM s JOIN net m USING (idx) JOIN up u USING (idx) WHERE m.ds <> m.idx AND (pos = 0 OR u.n <= 1))"


@query(_sql(N3, SEGMENT, "l AS (SELECT seg FROM s GROUP BY seg HAVING count(*) > 1)", select="SELECT seg, 0 AS part, CAST(pos AS BIGINT) AS pos, idx FROM s WHERE seg IN (SELECT seg FROM l) UNION ALL SELECT DISTINCT s.idx, -1, x.k, s.idx FROM s JOIN net n ON n.idx = s.idx AND n.ds = n.idx, (VALUES (0::BIGINT), (1::BIGINT)) x(k)"))
def q_streams(spark, d):
    return streams.segments(n3(spark, d))


@query(_sql(N3, SEGMENT, "l AS (SELECT seg, count(*) AS l FROM s GROUP BY seg HAVING count(*) > 1)",
            "k AS (SELECT seg, l, CASE WHEN l > 4 AND l / 4.0 > 1.5 THEN CAST(round_even(l / 4.0, 0) AS BIGINT) ELSE 1 END AS k FROM l)", "m AS (SELECT seg, k, CAST(round_even(l / CAST(k AS DOUBLE), 0) AS BIGINT) AS n FROM k)",
            "a AS (SELECT seg, k, n, pos, idx, least(pos // n, k - 1) AS own FROM s JOIN m USING (seg))",
            select="SELECT seg, CAST(own AS INT) AS part, CAST(pos - own * n AS BIGINT) AS pos, idx FROM a UNION ALL SELECT seg, CAST(own - 1 AS INT), CAST(pos - (own - 1) * n AS BIGINT), idx FROM a WHERE pos % n = 0 AND pos > 0 AND pos // n < k UNION ALL SELECT DISTINCT s.idx, -1, x.k, s.idx FROM s JOIN net n ON n.idx = s.idx AND n.ds = n.idx, (VALUES (0::BIGINT), (1::BIGINT)) x(k)"))
def q_streams_split(spark, d):
    return streams.segments(n3(spark, d), max_len=4)


@query(_sql(N1, select="SELECT count(*) AS n, sum(CASE WHEN idx = ds THEN 1 ELSE 0 END) AS pits, CAST(round(sum(idx % 100 + 0.5)) AS BIGINT) AS xs, CAST(round(sum(-(ds // 100) - 0.5)) AS BIGINT) AS ys FROM net"))
def q_vectorize(spark, d):
    f = streams.vectorize(n1(spark, d))
    x, y = F.col("geometry.coordinates")[0][0], F.col("geometry.coordinates")[1][1]
    return f.agg(F.count("*").alias("n"), F.sum(F.col("properties.pit").cast("int")).alias("pits"), F.round(F.sum(x)).cast("long").alias("xs"), F.round(F.sum(y)).cast("long").alias("ys"))


OUTLET_SEGMENT = "s(seg, pos, idx, done) AS (SELECT idx, 0, idx, false FROM net WHERE idx % 45 = 9 UNION ALL SELECT seg, pos + 1, n.ds, n.ds % 45 = 9 FROM s JOIN net n USING (idx) WHERE NOT done AND n.ds <> n.idx)"


@query(_sql(N3, OUTLET_SEGMENT, "l AS (SELECT seg FROM s GROUP BY seg HAVING count(*) > 1)", select="SELECT seg, 0 AS part, CAST(pos AS BIGINT) AS pos, idx FROM s WHERE seg IN (SELECT seg FROM l) UNION ALL SELECT seg, -1, x.k, s.idx FROM s JOIN net n ON n.idx = s.idx AND n.ds = n.idx, (VALUES (0::BIGINT), (1::BIGINT)) x(k) WHERE NOT done"))
def q_streams_outlets(spark, d):
    net = n3(spark, d)
    return streams.outlet_segments(net, net.cells.where("idx % 45 = 9").select("idx"))


UP_SEGMENT = "s(seg, pos, idx, done) AS (SELECT idx, 0, idx, false FROM net WHERE idx % 45 = 9 UNION ALL SELECT seg, pos + 1, -main.m.i, -main.m.i % 45 = 9 FROM s JOIN main USING (idx) WHERE NOT done)"


@query(_sql(N3, RANK, PAIRS, AREA, MAIN, UP_SEGMENT, "l AS (SELECT seg, max(pos) AS last FROM s GROUP BY seg HAVING count(*) > 1)", select="SELECT seg, 0 AS part, CAST(last - pos AS BIGINT) AS pos, idx FROM s JOIN l USING (seg)"))
def q_streams_outlets_up(spark, d):
    net = n3(spark, d)
    return streams.outlet_segments(net, net.cells.where("idx % 45 = 9").select("idx"), direction="up")


# --- basins and regions
@query(_sql(N1, RANK, "o AS (SELECT idx, row_number() OVER (ORDER BY idx) AS b FROM net WHERE idx = ds)", select="SELECT r.idx, o.b AS basin FROM r JOIN o ON o.idx = r.pit"))
def q_basins(spark, d):
    return basins.basins(n1(spark, d))


@query(_sql(N3, "s(idx, basin) AS (SELECT idx, idx + 1000 FROM net WHERE idx % 60 = 0 UNION ALL SELECT n.idx, s.basin FROM net n JOIN s ON n.ds = s.idx AND n.idx <> n.ds WHERE n.idx % 60 <> 0)", select="SELECT idx, basin FROM s"))
def q_basins_outlets(spark, d):
    net = n3(spark, d)
    return basins.basins(net, net.cells.where("idx % 60 = 0").select("idx", (F.col("idx") + 1000).alias("id")))


@query(_sql(N3, f"s(idx, bad) AS (SELECT idx, false FROM net WHERE idx = ds UNION ALL SELECT n.idx, s.bad OR (NOT (n.{REGION}) AND n.ds % 250 BETWEEN 60 AND 140) FROM net n JOIN s ON n.ds = s.idx AND n.idx <> n.ds)", select=f"SELECT idx FROM s WHERE NOT bad AND {REGION}"))
def q_interbasin_mask(spark, d):
    net = n3(spark, d)
    return basins.interbasin(net, net.cells.where(REGION).select("idx"))


def _streamorder_sql() -> str:
    order = _strahler_sql().removeprefix("WITH RECURSIVE ")
    ctes, _, last = order.rpartition("\nSELECT")
    return "WITH RECURSIVE " + ctes + ",\n" + f"""so AS (SELECT {last}),
sub AS (SELECT net.idx FROM net JOIN so USING (idx) JOIN so b ON b.idx = net.ds WHERE so."order" >= (SELECT max("order") - 2 FROM so) AND (so."order" <> b."order" OR net.idx = ds)),
ids AS (SELECT idx, row_number() OVER (ORDER BY rank, idx) AS basin FROM sub JOIN r USING (idx)),
t(idx, basin) AS (SELECT idx, basin FROM ids UNION ALL SELECT n.idx, t.basin FROM net n JOIN t ON n.ds = t.idx AND n.idx <> n.ds WHERE n.idx NOT IN (SELECT idx FROM ids))
SELECT idx, basin FROM t"""


@query(_streamorder_sql())
def q_subbasins_streamorder(spark, d):
    net = n3(spark, d)
    return basins.subbasins_streamorder(net, streams.stream_order(net))


@query()
def q_subbasins_pfafstetter(spark, d):
    return basins.subbasins_pfafstetter(n3(spark, d), 2)


@query()
def q_subbasins_area(spark, d):
    return basins.subbasins_area(n3(spark, d), 40)


def _regions(net: FlowNetwork) -> DataFrame:
    return net.cells.select("idx", (F.col("idx") % 7 + F.floor(F.col("idx") / 1000)).cast("long").alias("region"))


REG = "reg AS (SELECT idx, ds, idx % 7 + idx // 1000 AS region FROM net)"


@query(_sql(N4, REG, select="SELECT region, CAST(sum(value) AS BIGINT) AS value FROM reg JOIN val USING (idx) WHERE region > 0 GROUP BY region"))
def q_region_sum(spark, d):
    net, v = n4(spark, d)
    return basins.region_sum(_regions(net), v)


AREA_SQL = "6371e3 * 6371e3 * radians(0.25) * (sin(radians(60 - 0.05 * (idx // 100 + 0.5) + 0.025)) - sin(radians(60 - 0.05 * (idx // 100 + 0.5) - 0.025)))"


@query(_sql(N1, REG, select=f"SELECT region, round(sum({AREA_SQL}) / 1e6, 4) AS area FROM reg WHERE region > 0 GROUP BY region"))
def q_region_area(spark, d):
    net = n1(spark, d, latlon=True)
    return basins.region_area(_regions(net), net.grid, "km2").select("region", F.round("area", 4).alias("area"))


@query(_sql(N1, REG, select="SELECT region, min(idx // 100) AS row_min, max(idx // 100) AS row_max, min(idx % 100) AS col_min, max(idx % 100) AS col_max FROM reg WHERE region > 0 GROUP BY region"))
def q_region_slices(spark, d):
    net = n1(spark, d)
    return basins.region_slices(_regions(net), net.grid)


@query(_sql(N1, REG, select="SELECT region, round(min(-10 + 0.25 * (idx % 100)), 6) AS xmin, round(min(60 - 0.05 * (idx // 100 + 1)), 6) AS ymin, round(max(-10 + 0.25 * (idx % 100 + 1)), 6) AS xmax, round(max(60 - 0.05 * (idx // 100)), 6) AS ymax FROM reg WHERE region > 0 GROUP BY ROLLUP (region)"))
def q_region_bounds(spark, d):
    net = n1(spark, d, latlon=True)
    out = basins.region_bounds(_regions(net), net.grid)
    return out.select("region", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(_sql(N1, REG, select="SELECT a.region, a.idx FROM reg a LEFT JOIN reg b ON b.idx = a.ds AND b.region > 0 WHERE a.region > 0 AND (a.idx = a.ds OR b.region IS DISTINCT FROM a.region)"))
def q_region_outlets(spark, d):
    net = n1(spark, d)
    return basins.region_outlets(net, _regions(net))


@query(_sql(N1, "reg AS (SELECT idx, idx // 100 // 25 * 4 + idx % 100 // 25 + 1 AS region FROM net)",
            "pair AS (SELECT a.region, b.region AS other, a.idx AS i, b.idx AS j FROM reg a JOIN reg b ON b.idx IN (a.idx - 100, a.idx + 100) OR (b.idx IN (a.idx - 1, a.idx + 1) AND b.idx // 100 = a.idx // 100) WHERE a.region IN (2, 5) AND b.region NOT IN (2, 5))",
            "new AS (SELECT region, min({'i': i, 'j': j, 'o': other}).o AS other FROM pair GROUP BY region)", select="SELECT idx, CAST(coalesce(other, region) AS BIGINT) AS region FROM reg LEFT JOIN new USING (region)"))
def q_region_dissolve(spark, d):
    """The dissolved regions touch others, so the nearest cells are one step away."""
    net = n1(spark, d)
    regions = net.cells.select("idx", (F.floor(net.grid.row() / 25) * 4 + F.floor(net.grid.col() / 25) + 1).cast("long").alias("region"))
    return basins.region_dissolve(regions, spark.createDataFrame([(2,), (5,)], "region long"), net.grid)


BASIN = "b AS (SELECT r.idx, o.b AS region FROM r JOIN (SELECT idx, row_number() OVER (ORDER BY idx) AS b FROM net WHERE idx = ds) o ON o.idx = r.pit)"


@query(_sql(N1, RANK, BASIN, select="SELECT region, CAST(round(min(-10 + 0.25 * (idx % 100)), 6) AS DOUBLE) AS xmin, CAST(round(min(60 - 0.05 * (idx // 100 + 1)), 6) AS DOUBLE) AS ymin, CAST(round(max(-10 + 0.25 * (idx % 100 + 1)), 6) AS DOUBLE) AS xmax, CAST(round(max(60 - 0.05 * (idx // 100)), 6) AS DOUBLE) AS ymax FROM b GROUP BY ROLLUP (region)"))
def q_basin_bounds(spark, d):
    out = basins.basin_bounds(n1(spark, d, latlon=True))
    return out.select("region", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query(_sql(N1, RANK, BASIN, select="SELECT region, idx FROM b JOIN net USING (idx) WHERE idx = ds"))
def q_basin_outlets(spark, d):
    return basins.basin_outlets(n1(spark, d))


# --- elevation
@query(_sql(N2, "s(idx, drain) AS (SELECT idx, idx FROM net WHERE idx = ds OR idx % 31 = 2 UNION ALL SELECT n.idx, s.drain FROM net n JOIN s ON n.ds = s.idx AND n.idx <> n.ds WHERE n.idx % 31 <> 2)", select="SELECT s.idx, a.elev - b.elev AS hand FROM s JOIN z a ON a.idx = s.idx JOIN z b ON b.idx = s.drain"))
def q_hand(spark, d):
    net, z = n2(spark, d)
    return elevation.hand(net, net.cells.where("idx % 31 = 2").select("idx"), z)


@query(_sql(N2, RANK, PAIRS, AREA, "f(idx, fl, dz, dh) AS (SELECT r.idx, CASE WHEN uparea >= 6 THEN 1 ELSE 0 END, elev, uparea * 30000.0 FROM r JOIN area USING (idx) JOIN z USING (idx) WHERE r.idx = r.pit UNION ALL SELECT n.idx, CASE WHEN uparea >= 6 THEN 1 WHEN f.fl = 1 AND z.elev - f.dz <= f.dh THEN 1 ELSE 0 END, CASE WHEN uparea >= 6 THEN z.elev ELSE f.dz END, CASE WHEN uparea >= 6 THEN uparea * 30000.0 ELSE f.dh END FROM net n JOIN f ON f.idx = n.ds AND n.idx <> n.ds JOIN area ON area.idx = n.idx JOIN z ON z.idx = n.idx)", select="SELECT idx, fl AS floodplain FROM f"))
def q_floodplains(spark, d):
    net, z = n2(spark, d)
    area = net.upstream_area().select("idx", (F.col("uparea") * 30000.0).alias("uparea"))
    return elevation.floodplains(net, z, area, upa_min=6 * 30000.0, b=1.0)


def _near(dr: int, dc: int) -> str:
    return f"coalesce((SELECT elev FROM z b WHERE b.r = z.r + {dr} AND b.c = z.c + {dc}), elev)"


@query("WITH z AS (SELECT o_orderkey AS idx, o_orderkey // 100 AS r, o_orderkey % 100 AS c, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS elev FROM orders), "
       "w AS (SELECT a.idx, sum(coalesce(b.elev, a.elev) * x.dc * (2 - abs(x.dr))) AS gx, sum(coalesce(b.elev, a.elev) * x.dr * (2 - abs(x.dc))) AS gy FROM z a "
       "CROSS JOIN (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) x(dr, dc) LEFT JOIN z b ON b.r = a.r + x.dr AND b.c = a.c + x.dc GROUP BY a.idx) "
       "SELECT idx, round(sqrt(gx * gx + gy * gy) / 8, 3) AS slope FROM w")
def q_slope(spark, d):
    z, g = heights(spark, d)
    return elevation.slope(z, g).select("idx", F.round("slope", 3).alias("slope"))


FLOODED = """
WITH RECURSIVE z AS (SELECT o_orderkey AS idx, o_orderkey // 100 AS r, o_orderkey % 100 AS c, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS elev FROM orders),
e AS MATERIALIZED (SELECT a.idx AS a, b.idx AS b, b.elev FROM z a JOIN z b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.idx <> b.idx AND b.idx BETWEEN a.idx - 101 AND a.idx + 101),
st AS MATERIALIZED (SELECT z.idx, z.elev FROM z LEFT JOIN e ON e.a = z.idx GROUP BY z.idx, z.elev HAVING count(e.b) < 8),
w(idx, elev) USING KEY (idx) AS (
  SELECT idx, elev FROM st
  UNION
  SELECT e.b, min(greatest(w.elev, e.elev)) FROM w JOIN e ON e.a = w.idx LEFT JOIN recurring.w AS k ON k.idx = e.b
  WHERE k.idx IS NULL OR greatest(w.elev, e.elev) < k.elev GROUP BY e.b),
n AS MATERIALIZED (SELECT e.a, e.b, x.elev AS wa, y.elev AS wb, st.idx IS NOT NULL AS sb FROM e JOIN w x ON x.idx = e.a JOIN w y ON y.idx = e.b LEFT JOIN st ON st.idx = e.b),
f(idx, d) USING KEY (idx) AS (
  SELECT DISTINCT a, 0 FROM n WHERE wb < wa
  UNION
  SELECT n.b, min(f.d + 1) FROM f JOIN n ON n.a = f.idx AND n.wa = n.wb LEFT JOIN recurring.f AS k ON k.idx = n.b WHERE k.idx IS NULL OR f.d + 1 < k.d GROUP BY n.b),
own AS MATERIALIZED (SELECT idx FROM st WHERE idx NOT IN (SELECT idx FROM f)),
g(idx, d) USING KEY (idx) AS (
  SELECT idx, 0 FROM own
  UNION
  SELECT n.b, min(g.d + 1) FROM g JOIN n ON n.a = g.idx AND n.wa = n.wb LEFT JOIN recurring.g AS k ON k.idx = n.b WHERE k.idx IS NULL OR g.d + 1 < k.d GROUP BY n.b),
far AS MATERIALIZED (SELECT idx, d FROM f UNION ALL SELECT idx, d FROM g),
way AS (SELECT n.a AS idx, min({'w': wb, 'd': y.d, 's': CASE WHEN sb THEN 1 ELSE 0 END, 'b': n.b}).b AS ds
        FROM n JOIN far x ON x.idx = n.a JOIN far y ON y.idx = n.b WHERE wb < wa OR (wb = wa AND y.d < x.d) GROUP BY n.a),
net AS (SELECT w.idx, w.elev, CASE WHEN own.idx IS NOT NULL THEN w.idx ELSE coalesce(way.ds, w.idx) END AS ds FROM w LEFT JOIN way USING (idx) LEFT JOIN own USING (idx))
"""


@query(FLOODED + "SELECT i.idx, net.elev, CASE WHEN net.idx IS NULL THEN 247 WHEN ds = net.idx THEN 0 ELSE CASE ds - net.idx WHEN 1 THEN 1 WHEN 101 THEN 2 WHEN 100 THEN 4 WHEN 99 THEN 8 WHEN -1 THEN 16 WHEN -101 THEN 32 WHEN -100 THEN 64 WHEN -99 THEN 128 END END AS code FROM (SELECT unnest(range(max(idx) // 100 * 100 + 100)) AS idx FROM z) i LEFT JOIN net USING (idx)")
def q_fill_depressions(spark, d):
    z, g = heights(spark, d)
    return elevation.fill_depressions(z, g)


KEYED = """
WITH RECURSIVE z AS (SELECT o_orderkey AS idx, o_orderkey // 100 AS r, o_orderkey % 100 AS c, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS elev FROM orders),
e AS MATERIALIZED (SELECT a.idx AS a, b.idx AS b, b.elev FROM z a JOIN z b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.idx <> b.idx AND b.idx BETWEEN a.idx - 101 AND a.idx + 101),
w(idx, elev) USING KEY (idx) AS (
  SELECT z.idx, z.elev FROM z LEFT JOIN e ON e.a = z.idx GROUP BY z.idx, z.elev HAVING count(e.b) < 8
  UNION
  SELECT e.b, min(greatest(w.elev, e.elev)) FROM w JOIN e ON e.a = w.idx LEFT JOIN recurring.w AS k ON k.idx = e.b
  WHERE k.idx IS NULL OR greatest(w.elev, e.elev) < k.elev GROUP BY e.b)
SELECT idx, elev FROM w
"""


@query(KEYED)
def q_filled_surface(spark, d):
    z, g = heights(spark, d)
    return elevation.filled_surface(z, g)


@query(FLOODED + "SELECT idx, ds AS idx_ds FROM net")
def q_from_dem(spark, d):
    z, g = heights(spark, d)
    return FlowNetwork.from_elevation(z, g).cells


@query()
def q_dem_adjust(spark, d):
    net = n3(spark, d)
    return elevation.adjust_elevation(net, parts(spark, d).withColumnRenamed("value", "elev"))


@query()
def q_dem_dig_d4(spark, d):
    net = n1(spark, d)
    z, _ = heights(spark, d)
    return elevation.dig_4connectivity(net, z)


SPREAD = """,
e AS MATERIALIZED (SELECT a.idx AS a, b.idx AS b, sqrt(pow(a.idx // 100 - b.idx // 100, 2) + pow(a.idx % 100 - b.idx % 100, 2)) AS step
      FROM net a JOIN net b ON b.idx BETWEEN a.idx - 101 AND a.idx + 101 AND a.idx <> b.idx AND abs(a.idx // 100 - b.idx // 100) <= 1 AND abs(a.idx % 100 - b.idx % 100) <= 1),
w(idx, dist) USING KEY (idx) AS (
  SELECT idx, CAST(0 AS DOUBLE) FROM net WHERE idx % 97 = 5
  UNION
  SELECT e.b, min(w.dist + e.step) FROM w JOIN e ON e.a = w.idx LEFT JOIN recurring.w AS k ON k.idx = e.b
  WHERE k.idx IS NULL OR w.dist + e.step < k.dist - 1e-9 GROUP BY e.b)
"""


@query("WITH RECURSIVE " + N1 + SPREAD + "SELECT idx, round(dist, 6) AS dist FROM w")
def q_spread2d(spark, d):
    """Distances; which of two equally near sources a cell takes isn't compared."""
    net = n1(spark, d)
    out = elevation.spread(net.cells.select("idx", F.when(F.col("idx") % 97 == 5, F.col("idx") + 1.0).alias("value")), net.grid)
    return out.select("idx", F.round("dist", 6).alias("dist"))


@query("WITH o AS (SELECT o_orderkey AS idx, o_orderkey // 100 AS r, o_orderkey % 100 AS c FROM orders WHERE o_orderkey % 13 <> 4) "
       "SELECT a.idx FROM o a LEFT JOIN o b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND b.idx BETWEEN a.idx - 101 AND a.idx + 101 GROUP BY a.idx HAVING count(b.idx) < 9")
def q_get_edge(spark, d):
    z, g = heights(spark, d)
    return edge_cells(z.where("idx % 13 <> 4"), g)


@query("SELECT p_size AS size, round(regr_slope(p_retailprice, p_partkey), 6) AS slope, round(regr_intercept(p_retailprice, p_partkey), 4) AS intercept FROM part GROUP BY p_size HAVING count(*) > 2")
def q_lstsq(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    slope, start = windows.least_squares(F.col("p_partkey"), F.col("p_retailprice"))
    out = p.groupBy(F.col("p_size").alias("size")).agg(slope.alias("slope"), start.alias("intercept"), F.count("*").alias("n")).where("n > 2")
    return out.select("size", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


# --- rivers
@query(_sql(N3, "s(idx, dist) AS (SELECT idx, 0 FROM net WHERE idx = ds UNION ALL SELECT n.idx, dist + 1 FROM net n JOIN s ON n.ds = s.idx AND n.idx <> n.ds)", "v AS (SELECT s.idx, ds, dist, value FROM s JOIN net USING (idx) JOIN val USING (idx))", "e AS (SELECT a.idx, a.ds, a.idx <> a.ds AND ((b.dist = 0 AND b.value - a.value <= 0) OR b.value - a.value > 0.01) AS ok FROM v a JOIN v b ON b.idx = a.ds)", "t(idx) AS (SELECT idx FROM v WHERE idx = ds AND value <= 30 UNION ALL SELECT e.idx FROM e JOIN t ON t.idx = e.ds WHERE ok)", select="SELECT net.idx, CASE WHEN t.idx IS NULL THEN 0 WHEN EXISTS (SELECT 1 FROM e WHERE e.ds = net.idx AND e.idx <> e.ds AND NOT ok) THEN 2 ELSE 1 END AS estuary FROM net LEFT JOIN t USING (idx)"))
def q_classify_estuaries(spark, d):
    net, v = n3(spark, d), parts(spark, d)
    return rivers.classify_estuaries(net, v.select("idx", F.col("value").alias("elev")), v.select("idx", F.col("value").alias("width")), max_elevation=30.0)


def _river(spark, d):
    v = parts(spark, d)
    return v.select("idx", (F.col("value") * 3.0).alias("q"), (F.col("value") + 10.0).alias("width"), F.lit(0.03).alias("manning"), ((F.col("value") % 5 + 1) / 1000.0).alias("slope"))


@query("SELECT p_partkey AS idx, round(greatest(1.0, pow(0.03 * p_size * 3.0 / (sqrt((p_size % 5 + 1) / 1000.0) * (p_size + 10.0)), 0.6)), 6) AS depth FROM part")
def q_river_depth(spark, d):
    return rivers.river_depth(n3(spark, d), _river(spark, d)).select("idx", F.round("depth", 6).alias("depth"))


@query()
def q_river_depth_gvf(spark, d):
    net = n3(spark, d)
    dist = net.stream_distance().select("idx", (F.col("dist") * 500.0).alias("dist"))
    r = _river(spark, d).drop("slope").join(dist, "idx").withColumn("zs", F.col("dist") * 0.001 + 5)
    return rivers.river_depth(net, r, "gvf")


# --- upscaling and unit catchments
FACTOR = 10


def _scaled(spark, d, method):
    net = n1(spark, d).repair_loops()
    return net, *upscale.upscale(net, FACTOR, method)


N1_REPAIRED = N1.replace("net AS", "net0 AS") + """,
k0(idx) AS (SELECT idx FROM net0 WHERE idx = ds UNION ALL SELECT n.idx FROM net0 n JOIN k0 ON n.ds = k0.idx AND n.idx <> n.ds),
net AS (SELECT net0.idx, CASE WHEN k0.idx IS NULL THEN net0.idx ELSE ds END AS ds FROM net0 LEFT JOIN k0 USING (idx)),
px AS (SELECT idx, ds, idx // 1000 * 10 + idx % 100 // 10 AS cell, ds // 1000 * 10 + ds % 100 // 10 AS cell_ds, idx // 100 AS r, idx % 100 AS c,
       idx // 100 % 10 IN (0, 9) OR idx % 10 IN (0, 9) AS edge,
       sqrt(abs(idx // 100 % 10 - 4.5)) + sqrt(abs(idx % 10 - 4.5)) <= sqrt(5.0) OR abs(idx // 100 % 10 - 4.5) <= 0.5 OR abs(idx % 10 - 4.5) <= 0.5 AS inside FROM net)"""


def _rep(area: str) -> str:
    return f"rep AS (SELECT cell, -max({{'a': uparea, 'i': -idx}}).i AS pixel FROM px JOIN area USING (idx) WHERE {area} OR idx = ds GROUP BY cell)"


DMM = """ex AS (SELECT rep.cell, pixel, (floor(r / 10.0) + floor(r % 10 / 5.0)) * 10 - 0.5 AS r0, (floor(c / 10.0) + floor(c % 10 / 5.0)) * 10 - 0.5 AS c0 FROM rep JOIN px ON px.idx = pixel),
w(cell, r0, c0, idx, done) AS (
  SELECT ex.cell, r0, c0, px.idx, px.idx = px.ds OR (px.cell_ds <> ex.cell AND (abs(r - r0) > 5 OR abs(c - c0) > 5)) FROM ex JOIN px ON px.idx = pixel
  UNION ALL
  SELECT w.cell, r0, c0, n.idx, n.idx = n.ds OR (n.cell_ds <> w.cell AND (abs(n.r - r0) > 5 OR abs(n.c - c0) > 5)) FROM w JOIN px p ON p.idx = w.idx JOIN px n ON n.idx = p.ds WHERE NOT done)"""
EAM = """w(cell, idx, done) AS (
  SELECT rep.cell, n.idx, (n.inside AND n.cell <> rep.cell) OR n.idx = n.ds FROM rep JOIN px p ON p.idx = pixel JOIN px n ON n.idx = p.ds
  UNION ALL
  SELECT w.cell, n.idx, (n.inside AND n.cell <> w.cell) OR n.idx = n.ds FROM w JOIN px p ON p.idx = w.idx JOIN px n ON n.idx = p.ds WHERE NOT done)"""
PLUS = """last(cell, idx, done) AS (
  SELECT rep.cell, p.idx, p.cell <> p.cell_ds OR p.idx = p.ds FROM rep JOIN px p ON p.idx = pixel
  UNION ALL
  SELECT l.cell, n.idx, n.cell <> n.cell_ds OR n.idx = n.ds FROM last l JOIN px p ON p.idx = l.idx JOIN px n ON n.idx = p.ds WHERE NOT done),
out AS (SELECT cell, idx AS pixel FROM last WHERE done),
w(cell, idx, passed, done) AS (
  SELECT o.cell, n.idx, CASE WHEN n.inside OR n.idx = n.ds THEN n.idx END, n.idx IN (SELECT pixel FROM out) OR n.idx = n.ds FROM out o JOIN px p ON p.idx = o.pixel JOIN px n ON n.idx = p.ds
  UNION ALL
  SELECT w.cell, n.idx, coalesce(w.passed, CASE WHEN n.inside OR n.idx = n.ds THEN n.idx END), n.idx IN (SELECT pixel FROM out) OR n.idx = n.ds FROM w JOIN px p ON p.idx = w.idx JOIN px n ON n.idx = p.ds WHERE NOT done),
far(cell, idx, passed) AS (
  SELECT cell, idx, passed FROM w WHERE done
  UNION ALL
  SELECT f.cell, n.idx, CASE WHEN n.inside OR n.idx = n.ds THEN n.idx END FROM far f JOIN px p ON p.idx = f.idx JOIN px n ON n.idx = p.ds WHERE f.passed IS NULL),
nxt AS (SELECT w.cell, a.cell AS there, a.idx AS outlet, f.passed FROM w JOIN px a ON a.idx = w.idx JOIN far f ON f.cell = w.cell AND f.passed IS NOT NULL WHERE w.done),
coarse AS (SELECT nxt.cell, CASE WHEN abs(nxt.cell // 10 - there // 10) <= 1 AND abs(nxt.cell % 10 - there % 10) <= 1 THEN there ELSE p.cell END AS ds, outlet FROM nxt JOIN px p ON p.idx = passed)"""


@query(_sql(N1_REPAIRED, RANK, PAIRS, AREA, _rep("edge"), DMM, select="SELECT w.cell AS idx, px.cell AS idx_ds FROM w JOIN px ON px.idx = w.idx WHERE done"))
def q_upscale_dmm(spark, d):
    return _scaled(spark, d, "dmm")[1].cells


@query(_sql(N1_REPAIRED, RANK, PAIRS, AREA, _rep("inside"), EAM, select="SELECT w.cell AS idx, px.cell AS idx_ds FROM w JOIN px ON px.idx = w.idx WHERE done"))
def q_upscale_eam(spark, d):
    return _scaled(spark, d, "eam")[1].cells


@query(_sql(N1_REPAIRED, RANK, PAIRS, AREA, _rep("inside"), PLUS, select="SELECT cell AS idx, ds AS idx_ds FROM coarse"))
def q_upscale_eam_plus(spark, d):
    return _scaled(spark, d, "eam_plus")[1].cells


@query()
def q_upscale_ihu(spark, d):
    return _scaled(spark, d, "ihu")[1].cells


@query(_sql(N1_REPAIRED, RANK, PAIRS, AREA, _rep("inside"), PLUS, select="SELECT coarse.cell, CASE WHEN outlet = o.pixel THEN 1 ELSE 0 END AS connected FROM coarse LEFT JOIN out o ON o.cell = coarse.ds"))
def q_upscale_error(spark, d):
    return upscale.upscale_error(*_scaled(spark, d, "eam_plus"))


@query("WITH o AS (SELECT o_orderkey AS idx, o_orderkey // 100 AS r, o_orderkey % 100 AS c FROM orders) SELECT idx, CAST(r // 10 * 10 + c // 10 AS BIGINT) AS cell, r % 10 IN (0, 9) OR c % 10 IN (0, 9) AS edge, sqrt(abs(r % 10 - 4.5)) + sqrt(abs(c % 10 - 4.5)) <= sqrt(5.0) OR abs(r % 10 - 4.5) <= 0.5 OR abs(c % 10 - 4.5) <= 0.5 AS inside FROM o")
def q_coarse_cells(spark, d):
    """The coarse cell of every pixel, and whether it is on its border and in its effective area."""
    o = _orders(spark, d)
    g = _grid(o)
    return o.select(F.col("o_orderkey").alias("idx")).select("idx", upscale.coarse_cell(g, 10).alias("cell"), upscale.on_edge(g, 10).alias("edge"), upscale.in_effective_area(g, 10).alias("inside"))


@query(_sql(N3, "o AS (SELECT idx FROM net WHERE idx % 45 = 9)", "k AS (SELECT idx, CASE WHEN idx > 45 THEN idx - 45 ELSE idx END AS cds FROM o)",
            "t(cell, idx, away, done) AS (SELECT o.idx, n.ds, 1, n.ds % 45 = 9 OR n.ds = n.idx FROM o JOIN net n USING (idx) UNION ALL SELECT cell, n.ds, CASE WHEN n.ds = n.idx THEN away ELSE away + 1 END, n.ds % 45 = 9 OR n.ds = n.idx FROM t JOIN net n USING (idx) WHERE NOT done)",
            select="SELECT k.idx AS cell, t.idx = k.cds AS valid, t.idx = k.cds AND away <= 18 AS short FROM k JOIN t ON t.cell = k.idx AND t.done"))
def q_upscale_check(spark, d):
    net = n3(spark, d)
    out = _outlets(net)
    coarse = FlowNetwork(out.select(F.col("cell").alias("idx"), F.when(F.col("cell") > 45, F.col("cell") - 45).otherwise(F.col("cell")).alias("idx_ds")))
    return upscale.upscale_check(net, coarse, out, 18)[0]


@query(_sql(N3, RANK, PAIRS, select="SELECT net.idx, CAST(CASE WHEN net.idx % 45 = 9 THEN net.idx WHEN net.idx <> ds AND net.idx IN (SELECT anc FROM p WHERE des % 45 = 9) THEN -1 ELSE -9 END AS BIGINT) AS stream FROM net"))
def q_upscale_streams(spark, d):
    net = n3(spark, d)
    out = _outlets(net)
    return upscale.upscale_check(net, net, out)[1]


def _outlets(net: FlowNetwork) -> DataFrame:
    return net.cells.where("idx % 45 = 9").select(F.col("idx").alias("cell"), F.col("idx").alias("pixel"))


OUT = "s(idx, cell) AS (SELECT idx, idx FROM net WHERE idx % 45 = 9 UNION ALL SELECT n.idx, s.cell FROM net n JOIN s ON n.ds = s.idx AND n.idx <> n.ds WHERE n.idx % 45 <> 9)"


@query(_sql(N3, OUT, select="SELECT cell, CAST(count(*) AS DOUBLE) AS area FROM s GROUP BY cell"))
def q_ucat_area(spark, d):
    net = n3(spark, d)
    return subgrid.catchment_area(net, _outlets(net))


@query(_sql(N3, OUT, select="SELECT cell, CAST(x.d AS DOUBLE) AS depth, CAST(sum(greatest(0.0, x.d - value)) AS DOUBLE) AS volume FROM s JOIN val USING (idx) CROSS JOIN (VALUES (5.0), (20.0)) x(d) GROUP BY cell, x.d"))
def q_ucat_volume(spark, d):
    net = n3(spark, d)
    return subgrid.catchment_volume(net, _outlets(net), parts(spark, d).select("idx", F.col("value").alias("hand")), [5.0, 20.0])


DOWN = "t(cell, pos, idx) AS (SELECT idx, 0, idx FROM net WHERE idx % 45 = 9 UNION ALL SELECT cell, pos + 1, n.ds FROM t JOIN net n USING (idx) WHERE n.ds <> n.idx AND (pos = 0 OR n.idx % 45 <> 9))"


@query(_sql(N3, DOWN, select="SELECT cell, CAST(max(pos) AS BIGINT) AS length FROM t GROUP BY cell"))
def q_subgrid_rivlen(spark, d):
    net = n3(spark, d)
    return subgrid.river_length(net, _outlets(net), "down")


@query(_sql(N3, DOWN, select="SELECT cell, round(avg(value), 6) AS value FROM t JOIN val USING (idx) WHERE pos = 0 OR idx % 45 <> 9 GROUP BY cell"))
def q_subgrid_rivavg(spark, d):
    net = n3(spark, d)
    return subgrid.river_average(net, _outlets(net), parts(spark, d), direction="down").select("cell", F.round("value", 6).alias("value"))


@query(_sql(N3, DOWN, select="SELECT cell, CAST(median(value) AS DOUBLE) AS value FROM t JOIN val USING (idx) WHERE pos = 0 OR idx % 45 <> 9 GROUP BY cell"))
def q_subgrid_rivmed(spark, d):
    net = n3(spark, d)
    return subgrid.river_median(net, _outlets(net), parts(spark, d), direction="down")


@query(_sql(N3, DOWN, "m AS (SELECT * FROM t JOIN val USING (idx) WHERE pos = 0 OR idx % 45 <> 9)", select="SELECT cell, round(CASE WHEN count(*) > 1 THEN abs((max_by(value, pos) - min_by(value, pos)) / CAST(max(pos) AS DOUBLE)) ELSE 0 END, 6) AS slope FROM m GROUP BY cell"))
def q_subgrid_rivslp(spark, d):
    net = n3(spark, d)
    z = parts(spark, d).select("idx", F.col("value").alias("elev"))
    return subgrid.river_slope(net, _outlets(net), z, direction="down", unit="cell").select("cell", F.round("slope", 6).alias("slope"))


AROUND = """o AS (SELECT idx AS cell, rank AS d0 FROM r WHERE idx % 45 = 9),
dn(cell, d0, idx, done) AS (
  SELECT cell, d0, cell, net.idx = net.ds FROM o JOIN net ON net.idx = cell
  UNION ALL
  SELECT cell, d0, n.ds, k.rank <= d0 - 5 OR m.ds = n.ds FROM dn JOIN net n USING (idx) JOIN net m ON m.idx = n.ds JOIN r k ON k.idx = n.ds WHERE NOT done),
ab(cell, d0, idx, done) AS (
  SELECT cell, d0, dn.idx, r.rank >= d0 + 5 FROM dn JOIN r USING (idx) WHERE dn.done
  UNION ALL
  SELECT cell, d0, -main.m.i, k.rank >= d0 + 5 FROM ab JOIN main ON main.idx = ab.idx JOIN r k ON k.idx = -main.m.i WHERE NOT ab.done)"""


@query(_sql(N3, RANK, PAIRS, AREA, MAIN, AROUND, select="SELECT cell, round(CASE WHEN count(*) > 1 THEN abs(regr_slope(value, rank)) ELSE 0 END, 6) AS slope FROM ab JOIN r USING (idx) JOIN val USING (idx) GROUP BY cell"))
def q_subgrid_rivslp_fixed(spark, d):
    net = n3(spark, d)
    z = parts(spark, d).select("idx", F.col("value").alias("elev"))
    return subgrid.river_slope(net, _outlets(net), z, "lstsq", "both", unit="cell", length=10).select("cell", F.round("slope", 6).alias("slope"))


# --- grids
@query("SELECT o_orderkey AS idx, round(-10 + 0.25 * (o_orderkey % 100 + 0.5), 6) AS x, round(60 - 0.05 * (o_orderkey // 100 + 0.5), 6) AS y, o_orderkey AS back FROM orders")
def q_coordinates(spark, d):
    o = _orders(spark, d)
    g = _grid(o, latlon=True)
    x, y = g.xy("o_orderkey")
    return o.select(F.col("o_orderkey").alias("idx"), x.alias("x"), y.alias("y")).select("idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), g.index("x", "y").alias("back"))


@query(f"SELECT idx, round({AREA_SQL} / 1e6, 6) AS area FROM (SELECT o_orderkey AS idx FROM orders)")
def q_area_grid(spark, d):
    o = _orders(spark, d)
    g = _grid(o, latlon=True)
    return o.select(F.col("o_orderkey").alias("idx"), F.round(g.area("o_orderkey", "km2"), 6).alias("area"))


LAT = "radians(60 - 0.05 * (idx // 100 + ds // 100) / 2.0)"


@query(_sql(N1, "m AS (SELECT idx, ds, " + LAT + " AS p FROM net)", select="SELECT idx, round(CASE WHEN idx = ds THEN 0 ELSE sqrt(pow(abs(idx // 100 - ds // 100) * 0.05 * (111132.92 - 559.82 * cos(2 * p) + 1.175 * cos(4 * p) - 0.0023 * cos(6 * p)), 2) + pow(abs(idx % 100 - ds % 100) * 0.25 * (111412.84 * cos(p) - 93.5 * cos(3 * p) + 0.118 * cos(5 * p)), 2)) END, 3) AS length FROM m"))
def q_distance(spark, d):
    return n1(spark, d, latlon=True).edges("m").select("idx", F.round("length", 3).alias("length"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Basins of the grid by size: label, cells, largest upstream area."""
    net = n1(spark, d)
    both = basins.basins(net).join(net.upstream_area(), "idx")
    return both.groupBy("basin").agg(F.count("*").alias("cells"), F.max("uparea").alias("largest"))


@query(_sql(N1, RANK, PAIRS, AREA, "o AS (SELECT idx, row_number() OVER (ORDER BY idx) AS b FROM net WHERE idx = ds)", select="SELECT o.b AS basin, count(*) AS cells, max(uparea) AS largest FROM r JOIN o ON o.idx = r.pit JOIN area ON area.idx = r.idx GROUP BY o.b"))
def q_basin_summary(spark, d):
    return flagship(spark, d)
