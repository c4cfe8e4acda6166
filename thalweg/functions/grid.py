"""Regular grids: a small driver-side description, and column expressions on it.

Cells are numbered row by row: ``idx = row * ncol + col``.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metres; the sphere of equal-area cell sizes.
EARTH_RADIUS = 6371e3
#: Square metres (or cells) of an area unit.
AREA_UNITS = {"m2": 1.0, "ha": 1e4, "km2": 1e6, "cell": 1.0}
IDENTITY = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
#: The eight neighbours as (row step, column step).
NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
#: Cells of a block's side.
TILE = 2048
# Cosine series of metres per degree, (multiple of the latitude, coefficient).
DEGREE_Y = [(0, 111132.92), (2, -559.82), (4, 1.175), (6, -0.0023)]
DEGREE_X = [(1, 111412.84), (3, -93.5), (5, 0.118)]


@dataclass(frozen=True)
class GridSpec:
    """Shape and affine transform (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""

    nrow: int
    ncol: int
    transform: tuple[float, ...] = IDENTITY
    latlon: bool = False
    tile: int = TILE

    def __post_init__(self) -> None:
        if len(self.transform) != 6:
            raise ValueError("transform takes six numbers")
        if self.nrow < 1 or self.ncol < 1:
            raise ValueError("a grid has at least one row and one column")

    @classmethod
    def from_origin(cls, nrow: int, ncol: int, west: float, north: float, xsize: float, ysize: float, latlon: bool = False) -> GridSpec:
        return cls(nrow, ncol, (xsize, 0.0, west, 0.0, -ysize, north), latlon)

    @classmethod
    def from_bounds(cls, nrow: int, ncol: int, west: float, south: float, east: float, north: float, latlon: bool = False) -> GridSpec:
        return cls.from_origin(nrow, ncol, west, north, (east - west) / ncol, (north - south) / nrow, latlon)

    @property
    def n(self) -> int:
        return self.nrow * self.ncol

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """(xmin, ymin, xmax, ymax)."""
        a, _, c, _, e, f = self.transform
        xs, ys = sorted((c, c + a * self.ncol)), sorted((f, f + e * self.nrow))
        return xs[0], ys[0], xs[1], ys[1]

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """(xmin, xmax, ymin, ymax), as map plots take it."""
        x0, y0, x1, y1 = self.bounds
        return x0, x1, y0, y1

    def scaled(self, factor: int) -> GridSpec:
        a, b, c, d, e, f = self.transform
        return GridSpec(-(-self.nrow // factor), -(-self.ncol // factor), (a * factor, b, c, d, e * factor, f), self.latlon, self.tile)

    def axes(self) -> tuple[list[float], list[float]]:
        """Cell centres along a row and along a column."""
        a, _, c, _, e, f = self.transform
        return [c + (i + 0.5) * a for i in range(self.ncol)], [f + (i + 0.5) * e for i in range(self.nrow)]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> GridSpec:
        d = json.loads(text)
        return cls(d["nrow"], d["ncol"], tuple(d["transform"]), d["latlon"], d.get("tile", TILE))

    # --- columns
    def row(self, idx="idx") -> Column:
        return F.floor(_c(idx) / self.ncol).cast("long")

    def col(self, idx="idx") -> Column:
        return F.pmod(_c(idx), F.lit(self.ncol)).cast("long")

    def idx(self, row="row", col="col") -> Column:
        return (_c(row).cast("long") * self.ncol + _c(col).cast("long")).cast("long")

    def inside(self, row, col) -> Column:
        return (row >= 0) & (row < self.nrow) & (col >= 0) & (col < self.ncol)

    def block(self, idx="idx") -> Column:
        """Tiles of ``tile`` by ``tile`` cells."""
        across = -(-self.ncol // self.tile)
        return (F.floor(self.row(idx) / self.tile) * across + F.floor(self.col(idx) / self.tile)).cast("long")

    def xy(self, idx="idx", offset: str = "center") -> tuple[Column, Column]:
        """Coordinates of cells; NULL stays NULL and cells off the grid raise."""
        at = {"center": (0.5, 0.5), "ul": (0.0, 0.0), "ur": (0.0, 1.0), "ll": (1.0, 0.0), "lr": (1.0, 1.0)}
        if offset not in at:
            raise ValueError(f"offset must be one of {sorted(at)}")
        dr, dc = at[offset]
        a, b, c, d, e, f = self.transform
        i = F.when(_c(idx).isNull() | _c(idx).between(0, self.n - 1), _c(idx)).otherwise(F.raise_error(F.lit("cell index outside the grid")).cast("long"))
        r, k = self.row(i) + dr, self.col(i) + dc
        return k * a + r * b + c, k * d + r * e + f

    def index(self, x="x", y="y", rounding: str = "floor", precision: float = 1e-9, strict: bool = True) -> Column:
        """Cells of coordinates.  Off the grid: an error, or NULL unless strict."""
        how = {"floor": F.floor, "ceil": F.ceil, "round": F.round}
        if rounding not in how:
            raise ValueError(f"rounding must be one of {sorted(how)}")
        a, b, c, d, e, f = self.transform
        det = a * e - b * d
        eps = -precision if rounding == "ceil" else precision
        u, v = _c(x) - c, _c(y) - f
        col = how[rounding]((u * e - v * b) / det + eps).cast("long")
        row = how[rounding]((v * a - u * d) / det + eps).cast("long")
        off = F.raise_error(F.lit("coordinates outside the grid")).cast("long") if strict else F.lit(None).cast("long")
        known = _c(x).isNotNull() & _c(y).isNotNull()
        return F.when(known & self.inside(row, col), self.idx(row, col)).when(known, off)

    def latitude(self, row: Column) -> Column:
        return F.lit(self.transform[5]) + (row + 0.5) * self.transform[4]

    def dx(self, row: Column) -> Column:
        """Width of cells in metres (degrees grids) or map units."""
        xres = abs(self.transform[0])
        return metres_per_degree_x(self.latitude(row)) * xres if self.latlon else F.lit(float(xres))

    def dy(self, row: Column) -> Column:
        yres = abs(self.transform[4])
        return metres_per_degree_y(self.latitude(row)) * yres if self.latlon else F.lit(float(yres))

    def area(self, idx="idx", unit: str = "m2") -> Column:
        """Cell areas: on the sphere for degrees, else the product of the sides."""
        if unit not in AREA_UNITS:
            raise ValueError(f"unit must be one of {sorted(AREA_UNITS)}")
        if unit == "cell":
            return F.lit(1.0)
        xres, yres = abs(self.transform[0]), abs(self.transform[4])
        if not self.latlon:
            return F.lit(xres * yres / AREA_UNITS[unit])
        return cell_area(self.latitude(self.row(idx)), xres, yres) / AREA_UNITS[unit]

    def distance(self, a="idx", b="idx_ds") -> Column:
        """Length of a step between two cells; in degrees at the mean of their rows' upper edges."""
        ra, rb = self.row(a), self.row(b)
        drow, dcol = F.abs(ra - rb).cast("double"), F.abs(self.col(a) - self.col(b)).cast("double")
        xres, yres = abs(self.transform[0]), abs(self.transform[4])
        if not self.latlon:
            return F.hypot(drow * yres, dcol * xres)
        lat = F.lit(self.transform[5]) + (ra + rb) / 2.0 * self.transform[4]
        return F.hypot(drow * yres * metres_per_degree_y(lat), dcol * xres * metres_per_degree_x(lat))

    def cells(self, spark: SparkSession) -> DataFrame:
        """(idx, row, col) of every cell."""
        return spark.range(self.n).select(F.col("id").alias("idx"), self.row("id").alias("row"), self.col("id").alias("col"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def metres_per_degree_y(lat: Column) -> Column:
    phi = F.radians(lat)
    return sum((F.cos(phi * n) * k for n, k in DEGREE_Y[1:]), F.lit(DEGREE_Y[0][1]))


def metres_per_degree_x(lat: Column) -> Column:
    phi = F.radians(lat)
    return sum((F.cos(phi * n) * k for n, k in DEGREE_X[1:]), F.cos(phi) * DEGREE_X[0][1])


def cell_area(lat: Column, xres: float, yres: float) -> Column:
    """Area of a cell around a latitude on the sphere, in square metres."""
    half = abs(yres) / 2
    return EARTH_RADIUS**2 * math.radians(abs(xres)) * (F.sin(F.radians(lat + half)) - F.sin(F.radians(lat - half)))


def with_neighbours(cells: DataFrame, grid: GridSpec, value: str, offsets=NEIGHBOURS) -> DataFrame:
    """``cells`` (idx, value, ...) with the values of neighbours as columns n0, n1, ...
    in the order of ``offsets``: every value is sent to its neighbours and
    gathered once, with one shuffle for all of them."""
    row, col = grid.row(), grid.col()
    sent = cells.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (row - dr).alias("r"), (col - dc).alias("c")) for k, (dr, dc) in enumerate(offsets)])).alias("t"), F.col(value).alias("_v")
    )
    sent = sent.where(grid.inside(F.col("t.r"), F.col("t.c"))).select(grid.idx(F.col("t.r"), F.col("t.c")).alias("idx"), "t.k", "_v")
    wide = sent.groupBy("idx").agg(*[F.max(F.when(F.col("k") == k, F.col("_v"))).alias(f"n{k}") for k in range(len(offsets))])
    return cells.join(wide, "idx", "left")


def edge_cells(cells: DataFrame, grid: GridSpec, connectivity: int = 8) -> DataFrame:
    """(idx) of the cells in ``cells`` on the grid's border or beside a cell that isn't in it."""
    offsets = NEIGHBOURS if connectivity == 8 else [o for o in NEIGHBOURS if 0 in o]
    marked = with_neighbours(cells.select("idx", F.lit(1).alias("_one")), grid, "_one", offsets)
    return marked.where(sum(F.coalesce(f"n{k}", F.lit(0)) for k in range(len(offsets))) < len(offsets)).select("idx")
