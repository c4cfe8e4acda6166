"""Networks against a sequential model on random forests with loops."""

import random

import pytest
from pyspark.sql import functions as F

from thalweg.functions.grid import GridSpec
from thalweg.operators import FlowNetwork
from thalweg.operators.basins import basins
from thalweg.operators.streams import segments, stream_order
from thalweg.plans import contract, saved


def forest(n, seed, loops=True):
    r = random.Random(seed)
    down = {i: (i if i % 17 == 0 else r.randrange(max(0, i - 9), i)) for i in range(n)}
    if loops:
        down[n - 1], down[n - 2] = n - 2, n - 1
    return down


def walk(down, i, stop=lambda _: False):
    path, seen = [i], {i}
    while not stop(path[-1]) and down[path[-1]] != path[-1]:
        path.append(down[path[-1]])
        if path[-1] in seen:
            return None
        seen.add(path[-1])
    return path


def table(spark, down):
    return spark.createDataFrame(sorted(down.items()), "idx long, idx_ds long")


def as_dict(df, *names):
    rows = df.select(*names).collect()
    return {r[0]: (r[1] if len(names) == 2 else tuple(r[1:])) for r in rows}


@pytest.fixture(params=[1 << 22, 16], ids=["one block", "many blocks"])
def blocks(request, monkeypatch):
    monkeypatch.setattr(contract, "BLOCK_CELLS", request.param)


@pytest.mark.parametrize("shrink", [0.5, -1.0], ids=["contracted", "joined"])
def test_folds(spark, blocks, shrink, monkeypatch):
    monkeypatch.setattr(contract, "SHRINK", shrink)
    down = forest(150, 3)
    net = FlowNetwork(table(spark, down))
    rank = as_dict(net.rank(), "idx", "rank")
    paths = {i: walk(down, i) for i in down}
    assert rank == {i: (len(p) - 1 if p else -1) for i, p in paths.items()}
    value = spark.createDataFrame([(i, float(i % 7)) for i in down], "idx long, value double")
    up = as_dict(net.accumulate(value), "idx", "value")
    want = {i: sum(float(j % 7) for j, p in paths.items() if p and i in p) for i, p in paths.items() if p}
    assert {i: v for i, v in up.items() if v is not None} == pytest.approx(want)
    lower = as_dict(net.accumulate(value, direction="down"), "idx", "value")
    assert {i: v for i, v in lower.items() if v is not None} == pytest.approx({i: sum(float(j % 7) for j in p) for i, p in paths.items() if p})


def test_labels_and_orders(spark, blocks):
    down = forest(120, 5, loops=False)
    net = FlowNetwork(table(spark, down))
    pits = sorted(i for i in down if down[i] == i)
    got = as_dict(basins(net), "idx", "basin")
    assert got == {i: pits.index(walk(down, i)[-1]) + 1 for i in down}
    kids = {i: [j for j in down if down[j] == i and j != i] for i in down}

    def strahler(i):
        below = sorted((strahler(k) for k in kids[i]), reverse=True)
        return 1 if not below else below[0] + (len(below) > 1 and below[0] == below[1])

    assert as_dict(stream_order(net), "idx", "order") == {i: strahler(i) for i in down}
    area = {i: sum(i in walk(down, j) for j in down) for i in down}
    assert as_dict(net.upstream_area(), "idx", "uparea") == area
    main = {i: min((-area[k], k) for k in kids[i])[1] if kids[i] else None for i in down}
    assert as_dict(net.main_upstream(), "idx", "idx_us") == main

    def classic(i):
        if down[i] == i:
            return 1
        d = down[i]
        return classic(d) + (len(kids[d]) > 1 and main[d] != i)

    assert as_dict(stream_order(net, "classic"), "idx", "order") == {i: classic(i) for i in down}
    seg = segments(net).where("part = 0").groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("pos", "idx"))).alias("p"))
    for r in seg.collect():
        path = [x["idx"] for x in r["p"]]
        assert path[0] == r["seg"] and len(kids[path[0]]) != 1
        assert all(down[a] == b for a, b in zip(path, path[1:], strict=False))
        assert all(len(kids[x]) == 1 for x in path[1:-1])
        assert len(kids[path[-1]]) > 1 or down[path[-1]] == path[-1]


def test_barriers_filling_and_paths(spark, blocks):
    down = forest(100, 9, loops=False)
    net = FlowNetwork(table(spark, down))
    v = {i: (None if i % 5 == 2 else i % 11) for i in down}
    values = spark.createDataFrame(sorted(v.items()), "idx long, value long")

    def reaches(j, i):
        p = walk(down, j)
        return i in p and all(v[k] is not None for k in p[: p.index(i) + 1])

    assert as_dict(net.accumulate(values), "idx", "value") == {i: None if v[i] is None else sum(v[j] for j in down if reaches(j, i)) for i in down}
    nearest = {i: next((v[k] for k in walk(down, i) if v[k] is not None), None) for i in down}
    assert as_dict(net.fill_nodata(values), "idx", "value") == nearest

    def sources(i):
        out = []
        for j in down:
            if j != i and v[j] is not None and i in (p := walk(down, j)) and all(v[k] is None for k in p[1 : p.index(i) + 1]):
                out.append(v[j])
        return out

    want = {i: v[i] if v[i] is not None else (max(s) if (s := sources(i)) else None) for i in down}
    assert as_dict(net.fill_nodata(values, direction="down"), "idx", "value") == want
    starts = spark.createDataFrame([(i,) for i in range(0, 100, 7)], "idx long")
    rows = net.path(starts, max_length=4).collect()
    for s in range(0, 100, 7):
        assert [r["idx"] for r in sorted(rows, key=lambda r: r["pos"]) if r["start"] == s] == walk(down, s)[:5]
    ends = as_dict(net.snap(starts, max_length=4), "idx", "terminal")
    assert ends == {s: walk(down, s)[:5][-1] for s in range(0, 100, 7)}
    region = spark.createDataFrame([(i,) for i in range(30, 70)], "idx long")
    inside = set(range(30, 70))
    entry = {i for i in down if i not in inside and down[i] in inside}
    assert {r[0] for r in net.inflow(region).collect()} == {i for i in entry if not any(j != i and i in walk(down, j) for j in entry)}
    leave = {i for i in inside if down[i] not in inside or down[i] == i}
    assert {r[0] for r in net.outflow(region).collect()} == {i for i in leave if not any(j != i and j in walk(down, i) for j in leave)}


def test_vector_network(spark):
    ids = [13924, 15144, 10043, 432, 7684, 6379, 6401, 3650, 2725, 95, 147, 7777]
    ds = [15442, 13924, 13924, 10043, 10043, 7684, 7684, 6401, 6401, 2725, 2725, 7777]
    net = FlowNetwork.from_dataframe(spark.createDataFrame(list(zip(ids, ds, strict=True)), "id long, ds long"))
    assert as_dict(net.rank(), "idx", "rank") == dict(zip(ids, [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 0], strict=True))
    assert {r[0] for r in net.pits().collect()} == {13924, 7777}


def test_loops_and_pits(spark):
    net = FlowNetwork(table(spark, {0: 0, 1: 0, 2: 3, 3: 2, 4: 3}))
    assert not net.is_valid() and {r[0] for r in net.loops().collect()} == {2, 3, 4}
    fixed = net.repair_loops()
    assert fixed.is_valid() and {r[0] for r in fixed.pits().collect()} == {0, 2, 3, 4}
    more = net.add_pits(spark.createDataFrame([(3,)], "idx long"))
    assert as_dict(more.rank(), "idx", "rank") == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}


@pytest.mark.parametrize("ftype", ["d8", "ldd", "nextxy"])
def test_encodings_round_trip(spark, ftype):
    stars = {"d8": [2, 4, 8, 1, 0, 16, 128, 64, 32], "ldd": [3, 2, 1, 6, 5, 4, 9, 8, 7]}
    grid = GridSpec(3, 3)
    if ftype == "nextxy":
        rows = [(i // 3, i % 3, *((-9, -9) if i == 4 else (2, 2))) for i in range(9)]
        codes = spark.createDataFrame(rows, "row int, col int, nextx int, nexty int")
    else:
        codes = spark.createDataFrame([(i // 3, i % 3, c) for i, c in enumerate(stars[ftype])], "row int, col int, code int")
    net = FlowNetwork.from_array(codes, grid)
    assert as_dict(net.cells, "idx", "idx_ds") == dict.fromkeys(range(9), 4)
    back = net.to_array(ftype)
    names = codes.columns
    assert sorted(map(tuple, back.select(*names).collect())) == sorted(map(tuple, codes.collect()))


def test_large_tables_are_not_broadcast(spark):
    """Tables of a megabyte and more of files are shuffled, not sent over the driver."""
    a, b = (saved(spark.range(400_000).selectExpr("id as idx", f"hash(id, {k}) as v{k}"), "wide") for k in (1, 2))
    assert "BroadcastHashJoin" not in a.join(b, "idx")._jdf.queryExecution().sparkPlan().toString()
    few = saved(spark.range(10).withColumnRenamed("id", "idx"), "few")
    assert "BroadcastHashJoin" in a.join(few, "idx")._jdf.queryExecution().sparkPlan().toString()
