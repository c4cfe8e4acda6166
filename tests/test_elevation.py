"""Published examples for depressions and profiles, and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions.grid import GridSpec
from thalweg.operators import depressions
from thalweg.operators.elevation import adjust_profile, fill_depressions, filled_surface, slope, spread

# The published example (F5 in FIXTURES.md).
DEM = np.array(
    [
        [15, 15, 14, 15, 12, 6, 12],
        [14, 13, 10, 12, 15, 17, 15],
        [15, 15, 9, 11, 8, 15, 15],
        [16, 17, 8, 16, 15, 7, 5],
        [19, 18, 19, 18, 17, 15, 14],
    ],
    float,
)
CODES = [
    [2, 2, 4, 8, 1, 0, 16],
    [1, 1, 2, 2, 128, 64, 32],
    [128, 128, 1, 1, 2, 2, 4],
    [128, 128, 128, 128, 1, 1, 0],
    [64, 128, 64, 32, 128, 128, 64],
]


def filled(spark, z, tile=2048, **options):
    grid = GridSpec(*z.shape, tile=tile)
    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z.ravel()) if not np.isnan(v)], "idx long, elev double")
    rows = fill_depressions(cells, grid, **options).orderBy("idx").collect()
    level = np.array([np.nan if r["elev"] is None else r["elev"] for r in rows]).reshape(z.shape)
    return level, np.array([r["code"] for r in rows]).reshape(z.shape)


def test_depressions(spark):
    level, codes = filled(spark, DEM)
    want = DEM.copy()
    want[1:4, 2] = 11
    assert (level == want).all() and codes.tolist() == CODES
    level, codes = filled(spark, DEM, tile=3)
    assert (level == want).all() and codes.tolist() == CODES
    lone, _ = filled(spark, DEM, outlets="min")
    want[0, 5] = 12
    assert (lone == want).all()
    kept, codes = filled(spark, DEM, max_depth=2, tile=3)
    assert (kept == DEM).all() and codes[3, 2] == 0
    four, codes4 = filled(spark, DEM, connectivity=4)
    assert four.tolist() == [[15, 15, 14, 15, 12, 6, 12], [14, 14, 14, 14, 15, 17, 15], [15, 15, 14, 14, 14, 15, 15], [16, 17, 14, 16, 15, 7, 5], [19, 18, 19, 18, 17, 15, 14]]
    assert set(np.unique(codes4)) <= {0, 1, 4, 16, 64}
    holes = DEM.copy()
    holes[3, 5:] = np.nan
    _, codes = filled(spark, holes)
    assert (codes[3, 5:] == 247).all() and codes[2, 4] == 0


def lowest_ways_out(z, start, steps):
    """Spill levels by relaxing cells one at a time."""
    w = np.where(start, z, np.inf)
    moved = True
    while moved:
        moved = False
        for r, c in np.argwhere(~np.isnan(z)):
            for dr, dc in steps:
                a, b = r + dr, c + dc
                if 0 <= a < z.shape[0] and 0 <= b < z.shape[1] and not np.isnan(z[a, b]) and max(w[a, b], z[r, c]) < w[r, c]:
                    w[r, c], moved = max(w[a, b], z[r, c]), True
    return w


def test_levels_flats_and_codes():
    """In this process: levels by definition; codes never lead up, and end at start cells."""
    r = np.random.default_rng(0)
    step = {code: s for s, code in depressions.CODE.items()}
    for _ in range(60):
        z = r.integers(0, r.integers(2, 30), (r.integers(2, 14), r.integers(2, 14))).astype(float)
        z[r.random(z.shape) < 0.1] = np.nan
        start = ~np.isnan(z) & (r.random(z.shape) < 0.1)
        steps = depressions.steps_of(int(r.choice([4, 8])))
        w = depressions.spill_levels(z, np.where(start, z, np.inf), steps)
        assert np.array_equal(w, lowest_ways_out(z, start, steps))
        number = np.arange(z.size).reshape(z.shape)
        root = np.where(depressions.beside_lower(w, steps), depressions.EXIT, np.where(start, number, depressions.FAR))
        root, far = depressions.flat_distances(w, root, np.where(root < depressions.FAR, 0, depressions.FAR), steps)
        code = depressions.directions(w, root, far, start, number, steps)
        for at in map(tuple, np.argwhere(np.isfinite(w))):
            for _ in range(z.size):
                if not code[at]:
                    break
                to = at[0] + step[code[at]][0], at[1] + step[code[at]][1]
                assert w[to] <= w[at]
                at = to
            assert start[at] and not code[at]


def test_distributed_surface(spark):
    r = np.random.default_rng(1)
    z = r.random((14, 17)).round(2)
    grid = GridSpec(14, 17, tile=5)
    z.flat[[i for i in range(z.size) if i % 31 == 30]] = np.nan
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z.ravel()) if not np.isnan(v)], "idx long, elev double")
    inner = ~np.isnan(np.pad(z, 1, constant_values=np.nan))
    whole = np.ones(z.shape, bool)
    for dr in (0, 1, 2):
        for dc in (0, 1, 2):
            whole &= inner[dr : dr + 14, dc : dc + 17]
    want = lowest_ways_out(z, ~whole & ~np.isnan(z), depressions.steps_of(8))
    got = {x["idx"]: x["elev"] for x in filled_surface(table, grid).collect()}
    assert got == {i: v for i, v in enumerate(want.ravel()) if not np.isnan(z.flat[i])}
    one, many = filled(spark, z), filled(spark, z, tile=5)
    assert np.array_equal(one[0], many[0], equal_nan=True) and np.array_equal(one[1], many[1])


# The published profiles (F6 in FIXTURES.md).
@pytest.mark.parametrize(
    "before, after",
    [
        ("8 7 6 5 5 6 5 4", "8 7 6 5 5 5 5 4"),
        ("8 7 6 5 6 6 5 4", "8 7 6 6 6 6 5 4"),
        ("8 7 6 5 6 7 5 4", "8 7 6 6 6 6 5 4"),
        ("84 19 5 26 34 4", "84 26 26 26 26 4"),
        ("46 26 5 20 23 21 5", "46 26 21 21 21 21 5"),
        ("8 7 6 6 6 6 5 7", "8 7 7 7 7 7 7 7"),
        ("5 41 15", "15 15 15"),
        ("60 13 54 37 49 27 22 19 42 33 40 36 7 32 8 8 2 1", "60 54 54 37 37 27 22 19 19 19 19 19 8 8 8 8 2 1"),
    ],
)
def test_profiles(before, after):
    got = adjust_profile(np.array([int(x) for x in before.split()]))
    assert got.tolist() == [int(x) for x in after.split()]


def test_slope_and_spread(spark):
    grid = GridSpec(5, 5)
    flat = spark.createDataFrame([(i, float(i % 5) * 2) for i in range(25)], "idx long, elev double")
    got = {r["idx"]: r["slope"] for r in slope(flat, grid).collect()}
    assert got[12] == pytest.approx(2.0) and got[10] == pytest.approx(1.0)
    seeds = spark.createDataFrame([(i, 12.0 if i == 12 else None) for i in range(25)], "idx long, value double")
    out = spread(seeds, grid).agg(F.min("value"), F.max("value"), F.max("dist"), F.count("*")).first()
    assert tuple(out) == (12.0, 12.0, pytest.approx(2 * 2**0.5), 25)


def test_constants(spark):
    globe = GridSpec(180, 360, (1.0, 0.0, -180.0, 0.0, -1.0, 90.0), True)
    r = globe.cells(spark)
    total = r.agg(F.sum(globe.area()).alias("a")).first()["a"]
    assert total == pytest.approx(4 * np.pi * 6371e3**2)
    near = r.where("row = 90 and col = 0").select(globe.dx(F.lit(89.5)).alias("dx")).first()["dx"]
    assert near * 360 == pytest.approx(40075004.88, abs=1)
    one = spark.range(1).select(globe.area(F.lit(32400)).alias("a")).first()["a"]
    assert one == pytest.approx(6371e3**2 * np.radians(1) * np.sin(np.radians(1)), rel=1e-6)
