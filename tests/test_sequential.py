"""Order-dependent operators against plain loops over small networks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions.grid import GridSpec
from thalweg.operators import FlowNetwork, basins, elevation, rivers, subgrid, windows
from thalweg.operators.elevation import adjust_profile


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(11)
    ds = {i: i if i % 40 == 0 else i - 1 - r.randrange(min(3, i % 40)) for i in range(160)}
    net = FlowNetwork(spark.createDataFrame(sorted(ds.items()), "idx long, idx_ds long"))
    z = {i: float(r.randint(1, 60)) for i in ds}
    rank, order = {}, sorted(ds, key=lambda i: i)
    for i in order:
        rank[i] = 0 if ds[i] == i else rank[ds[i]] + 1
    return net, ds, rank, z


def table(spark, values, name):
    return spark.createDataFrame(sorted(values.items()), f"idx long, {name} double")


def test_adjusted_elevations(spark, case):
    net, ds, rank, z = case
    want, done = dict(z), set()
    for i in sorted(ds, key=lambda i: (-rank[i], -i)):  # longest paths first
        if i in done:
            continue
        path = [i]
        while path[-1] not in done and ds[path[-1]] != path[-1]:
            path.append(ds[path[-1]])
        for k, v in zip(path, adjust_profile(np.array([want[k] for k in path])), strict=True):
            want[k] = float(v)
        done.update(path)
    got = {x["idx"]: x["elev"] for x in elevation.adjust_elevation(net, table(spark, z, "elev")).collect()}
    assert got == want and all(got[i] >= got[ds[i]] for i in ds)


def test_smoothed_lengths(spark, case):
    net, ds, _, z = case
    up: dict[int, list[int]] = {}
    size = {i: 1 for i in ds}
    for i in sorted(ds, reverse=True):
        if ds[i] != i:
            size[ds[i]] += size[i]
            up.setdefault(ds[i], []).append(i)
    main = {i: max(c, key=lambda k: (size[k], -k)) for i, c in up.items()}
    want = dict(z)
    for i in sorted(ds):
        if want[i] >= 25:
            continue
        best, held = want[i], []
        for reach in range(1, 4):
            window, a, b = [i], i, i
            for _ in range(reach):
                if a is not None and ds[a] != a:
                    a = ds[a]
                    window.append(a)
                else:
                    a = None
                b = main.get(b) if b is not None else None
                if b is not None:
                    window.append(b)
            mean = sum(want[k] for k in window) / len(window)
            if mean > best:
                best, held = mean, window
            if best > 25:
                break
        for k in held:
            want[k] = best
    got = {x["idx"]: x["length"] for x in windows.smooth_lengths(net, table(spark, z, "length"), 25.0, 8).collect()}
    assert got == pytest.approx(want)


def test_subbasins_by_area(spark, case):
    """Every subbasin's outlet drains what the next ones above don't, and none is small
    unless it is what a larger one left over."""
    net, ds, rank, _ = case
    got = {x["idx"]: x["basin"] for x in basins.subbasins_area(net, 6).collect()}
    assert set(got) == set(ds)
    outlets = [i for i in ds if ds[i] == i or got[ds[i]] != got[i]]
    assert len(outlets) == len(set(got.values()))  # connected, one outlet each
    numbered = sorted(outlets, key=lambda i: (rank[i], i))
    assert [got[i] for i in numbered] == list(range(1, len(outlets) + 1))
    size = {b: sum(v == b for v in got.values()) for b in set(got.values())}
    assert all(size[got[i]] > 6 for i in outlets if ds[i] != i and not any(ds[k] in ds and got[k] != got[i] and got[ds[k]] == got[i] for k in ds))


def test_gradually_varying_depth(spark, case):
    """Against small fixed steps of the classical fourth-order scheme."""
    net, ds, rank, _ = case
    q, w, n = 40.0, 25.0, 0.03
    rows = [(i, 5 + rank[i] * 0.5, rank[i] * 500.0, q, w, n) for i in ds]
    river = spark.createDataFrame(rows, "idx long, zs double, dist double, q double, width double, manning double")
    got = {x["idx"]: x["depth"] for x in rivers.river_depth(net, river, "gvf").collect()}
    first = {x["idx"]: x["depth"] for x in rivers.river_depth(net, river.withColumn("slope", F.when(F.col("dist") > 0, 0.001).otherwise(1e-5))).collect()}
    depth = {i: first[i] for i in ds}

    def rate(h, s0):
        h = max(h, 0.1)
        area = w * h
        friction = (n * q / area) ** 2 * (area / (2 * h + w)) ** (-4 / 3)
        return -(s0 - friction) / (1 - (q / (w * np.sqrt(9.81 * h))) ** 2)

    bed = {i: 5 + rank[i] * 0.5 - depth[i] for i in ds}
    for _ in range(2):
        for i in sorted(ds, key=lambda i: (rank[i], i)):
            if ds[i] == i:
                continue
            h, s0, step = depth[ds[i]], max(1e-5, (bed[i] - bed[ds[i]]) / 500.0), 5.0
            for _ in range(100):
                a = rate(h, s0)
                b = rate(h + step / 2 * a, s0)
                c = rate(h + step / 2 * b, s0)
                d = rate(h + step * c, s0)
                h += step / 6 * (a + 2 * b + 2 * c + d)
            depth[i] = max(1.0, h)
        bed = {i: 5 + rank[i] * 0.5 - depth[i] for i in ds}
    assert got == pytest.approx(depth, rel=5e-3)


def test_dug_straight_ways(spark):
    r = np.random.default_rng(4)
    rows, cols = 9, 11
    grid = GridSpec(rows, cols)
    z = {i: float(v) for i, v in enumerate(r.permutation(rows * cols).astype(float))}
    ds = {}
    for i in z:
        near = [(i // cols + a) * cols + i % cols + b for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= i // cols + a < rows and 0 <= i % cols + b < cols]
        ds[i] = min(near, key=z.get)
    net = FlowNetwork(spark.createDataFrame(sorted(ds.items()), "idx long, idx_ds long"), grid)
    rank = {i: 0 for i in z}
    for i in z:
        k = i
        while ds[k] != k:
            rank[i], k = rank[i] + 1, ds[k]
    want = dict(z)
    for i in sorted(z, key=lambda i: (-rank[i], -i)):
        to = ds[i]
        (r0, c0), (r1, c1) = divmod(i, cols), divmod(to, cols)
        if r0 != r1 and c0 != c1:
            beside = min(sorted((r0 * cols + c1, r1 * cols + c0)), key=lambda k: want[k])
            want[beside] = min(want[beside] - 1e-3, want[i])
        if ds[to] == to and 0 < r1 < rows - 1 and 0 < c1 < cols - 1:
            for k in (to - cols, to - 1, to + 1, to + cols):
                if k != i:
                    want[k] = min(want[k], want[to])
    got = {x["idx"]: x["elev"] for x in elevation.dig_4connectivity(net, table(spark, z, "elev")).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_dug_straight_ways_by_tiles(spark, tile):
    """Tiles of any size give the heights of the plain loop, and more than one task has them."""
    r = np.random.default_rng(tile)
    rows, cols = 34, 29
    grid = GridSpec(rows, cols, tile=tile)
    z = {i: float(v) for i, v in enumerate(r.integers(0, 60, rows * cols)) if r.random() > 0.03}
    ds = {}
    for i in z:
        near = [(i // cols + a) * cols + i % cols + b for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= i // cols + a < rows and 0 <= i % cols + b < cols]
        # long ways as well, which go on over the borders of tiles
        ahead = [k for k in near if k // cols > i // cols and k in z]
        ds[i] = r.choice(ahead) if ahead and r.random() < 0.9 else min((k for k in near if k in z), key=lambda k: (z[k], k))
    ds = {i: int(to) if to // cols > i // cols or (z[to], to) < (z[i], i) else i for i, to in ds.items()}
    on = {i for i in z if i % 11}
    net = FlowNetwork(spark.createDataFrame(sorted(ds.items()), "idx long, idx_ds long"), grid)
    rank = {}
    for i in z:
        way = [i]
        while ds[way[-1]] != way[-1] and ds[way[-1]] not in way:
            way.append(ds[way[-1]])
        rank[i] = len(way) - 1 if ds[way[-1]] == way[-1] else -1
    gone = {i for i in z if i % 37 == 5}
    want = {i: v for i, v in z.items() if i not in gone}
    for i in sorted(want, key=lambda i: (-rank[i], -i)):
        if rank[i] < 0 or i not in on:
            continue
        (r0, c0), (r1, c1) = divmod(i, cols), divmod(ds[i], cols)
        if r0 != r1 and c0 != c1:
            beside = [k for k in sorted((r0 * cols + c1, r1 * cols + c0)) if k in want]
            if not beside:
                continue
            low = min(beside, key=lambda k: want[k])
            want[low] = min(want[low] - 1e-3, want[i])
        if ds[ds[i]] == ds[i] and ds[i] in want and 0 < r1 < rows - 1 and 0 < c1 < cols - 1:
            around = [ds[i] + k for k in (-cols, -1, 1, cols)]
            for k in around if all(k in want for k in around) else []:
                if k != i:
                    want[k] = min(want[k], want[ds[i]])
    heights = table(spark, {i: v for i, v in z.items() if i not in gone}, "elev")
    out = elevation.dig_4connectivity(net, heights, spark.createDataFrame([(i,) for i in on], "idx long"))
    assert {x["idx"]: x["elev"] for x in out.collect()} == want
    assert tile > rows or out.select(F.spark_partition_id()).distinct().count() > 1


def test_points_and_grids(spark):
    grid = GridSpec(4, 5, (0.5, 0.0, 10.0, 0.0, -0.5, 50.0), True)
    net = FlowNetwork(spark.createDataFrame([(i, i if i % 5 == 0 else i - 1) for i in range(20)], "idx long, idx_ds long"), grid)
    x, y = grid.xy("idx")
    some = net.cells.where("idx in (3, 9, 17)")
    at = some.select(x.alias("x"), y.alias("y"))
    by_idx, by_xy = (sorted(map(str, net.snap(p).collect())) for p in (some.select("idx"), at))
    assert by_idx == by_xy and len(by_idx) == 3
    assert sorted(map(str, net.path(at).collect())) == sorted(map(str, net.path(some.select("idx")).collect()))
    assert {r["idx"] for r in net.add_pits(at).pits().collect()} == {0, 5, 10, 15, 3, 9, 17}
    assert sorted(map(str, basins.basins(net, at).collect())) == sorted(map(str, basins.basins(net, some.select("idx")).collect()))
    with pytest.raises(ValueError):
        net.snap(at.select("x"))
    moved = net.set_transform((1.0, 0.0, 0.0, 0.0, -1.0, 0.0))
    assert moved.grid.bounds == (0.0, -4.0, 5.0, 0.0) and not moved.grid.latlon and net.grid.latlon
    assert net["shape"] == (4, 5) and net["nnodes"] == 20 and {r["idx"] for r in net["idxs_pit"].collect()} == {0, 5, 10, 15} and "4" in str(net)
    with pytest.raises(ValueError):
        FlowNetwork(net.cells).set_transform((1.0, 0.0, 0.0, 0.0, -1.0, 0.0))


def test_segments_between_outlets(spark):
    from thalweg.operators.streams import outlet_segments

    net = FlowNetwork(spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 2), (7, 6)], "idx long, idx_ds long"))
    lines = lambda d: {k: [c for _, c in sorted(v)] for k, v in _by_line(d).items()}
    out = spark.createDataFrame([(5,), (2,), (7,)], "idx long")
    assert lines(outlet_segments(net, out)) == {(5, 0): [5, 4, 3, 2], (7, 0): [7, 6, 2], (2, 0): [2, 1, 0], (2, -1): [0, 0]}
    assert lines(outlet_segments(net, out, max_len=2)) == {(5, 0): [5, 4], (7, 0): [7, 6], (2, 0): [2, 1]}
    inside = net.cells.where("idx <> 3").select("idx")
    assert lines(outlet_segments(net, out, inside)) == {(5, 0): [5, 4], (7, 0): [7, 6, 2], (2, 0): [2, 1, 0], (2, -1): [0, 0]}
    assert lines(outlet_segments(net, spark.createDataFrame([(0,), (3,)], "idx long"), direction="up")) == {(0, 0): [3, 2, 1, 0], (3, 0): [5, 4, 3]}


def _by_line(lines):
    out: dict = {}
    for r in lines.collect():
        out.setdefault((r["seg"], r["part"]), []).append((r["pos"], r["idx"]))
    return out


def test_slopes_of_fixed_length_follow_short_paths(spark, monkeypatch):
    """A long river with many outlets: only the pixels around each are walked."""
    n, walked, path = 600, [], FlowNetwork.path

    def counted(self, *args, **kw):
        walked.append(path(self, *args, **kw))
        return walked[-1]

    monkeypatch.setattr(FlowNetwork, "path", counted)
    net = FlowNetwork(spark.createDataFrame([(i, max(0, i - 1)) for i in range(n)], "idx long, idx_ds long"))
    z = {i: float((i * 7919) % 101) for i in range(n)}
    at = [i for i in range(n) if i % 12 == 5]
    outlets = spark.createDataFrame([(i, i) for i in at], "cell long, pixel long")
    got = {x["cell"]: x["slope"] for x in subgrid.river_slope(net, outlets, table(spark, z, "elev"), "lstsq", "both", unit="cell", length=9).collect()}
    want = {}
    for i in at:
        x = np.arange(max(0, i - 5), min(n - 1, i + 5) + 1)
        want[i] = abs(np.polyfit(x, [z[k] for k in x], 1)[0])
    assert got == pytest.approx(want)
    assert sum(x.count() for x in walked) < 25 * len(at)
