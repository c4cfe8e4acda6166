"""Flow-direction encodings as tables of codes, and expressions that decode them.

An encoding is a registry entry: code of each step, of pits and of missing cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.functions.grid import GridSpec

# Codes of the steps to the eight neighbours, pits and missing cells.
D8_STEPS = {32: (-1, -1), 64: (-1, 0), 128: (-1, 1), 16: (0, -1), 1: (0, 1), 8: (1, -1), 4: (1, 0), 2: (1, 1)}
LDD_STEPS = {7: (-1, -1), 8: (-1, 0), 9: (-1, 1), 4: (0, -1), 6: (0, 1), 1: (1, -1), 2: (1, 0), 3: (1, 1)}


@dataclass(frozen=True)
class Encoding:
    name: str
    steps: dict[int, tuple[int, int]]
    pits: tuple[int, ...]
    nodata: int

    @property
    def codes(self) -> list[int]:
        return [*self.steps, *self.pits, self.nodata]


ENCODINGS = {"d8": Encoding("d8", D8_STEPS, (0, 255), 247), "ldd": Encoding("ldd", LDD_STEPS, (5,), 255)}
NEXTXY_NODATA, NEXTXY_PITS = -9999, (-9, -10)


def encoding(ftype: str) -> Encoding:
    if ftype not in ENCODINGS:
        raise ValueError(f"unknown encoding {ftype!r}; known are {sorted([*ENCODINGS, 'nextxy'])}")
    return ENCODINGS[ftype]


def step(code: Column, ftype: str) -> tuple[Column, Column]:
    """Row and column step of a code; 0, 0 for pits, NULL for missing and unknown codes."""
    e = encoding(ftype)
    pairs = [*e.steps.items(), *((p, (0, 0)) for p in e.pits)]
    table = lambda i: F.create_map(*[F.lit(x) for c, s in pairs for x in (c, s[i])])
    return table(0)[code.cast("int")], table(1)[code.cast("int")]


def is_pit(code: Column, ftype: str) -> Column:
    return code.isin(*encoding(ftype).pits)


def is_nodata(code: Column, ftype: str) -> Column:
    return code == encoding(ftype).nodata


def is_valid(codes: DataFrame, ftype: str) -> bool:
    """Whether all codes of (code) or (nextx, nexty) belong to the encoding."""
    if ftype == "nextxy":
        if not {"nextx", "nexty"} <= set(codes.columns):
            return False
        special = F.col("nextx").isin(NEXTXY_NODATA, *NEXTXY_PITS)
        return codes.where(F.when(special, F.col("nextx") != F.col("nexty")).otherwise((F.col("nextx") < 0) | (F.col("nexty") < 0))).isEmpty()
    return "code" in codes.columns and codes.where(~F.col("code").isin(encoding(ftype).codes) | F.col("code").isNull()).isEmpty()


def infer(codes: DataFrame) -> str:
    """The first of d8, ldd and nextxy that all codes belong to."""
    if "code" in codes.columns:
        found = {r["code"] for r in codes.select("code").distinct().limit(32).collect()}
        for name, e in ENCODINGS.items():
            if found <= set(e.codes):
                return name
    elif is_valid(codes, "nextxy"):
        return "nextxy"
    raise ValueError("the flow directions are of no known encoding")


def decode(codes: DataFrame, grid: GridSpec, ftype: str) -> DataFrame:
    """(idx, idx_ds) from (row, col, code) or (row, col, nextx, nexty); missing cells
    are left out.  A cell is a pit if its code says so or its target is off the
    grid or missing; ``explicit`` tells which pits the code states."""
    if ftype == "nextxy":
        pit = F.col("nextx").isin(*NEXTXY_PITS)
        here = codes.where(F.col("nextx") != NEXTXY_NODATA)
        row, col = F.col("nexty").cast("long") - 1, F.col("nextx").cast("long") - 1
    else:
        here = codes.where(~is_nodata(F.col("code"), ftype))
        pit = is_pit(F.col("code"), ftype)
        dr, dc = step(F.col("code"), ftype)
        row, col = F.col("row").cast("long") + dr, F.col("col").cast("long") + dc
    aimed = here.select(grid.idx().alias("idx"), pit.alias("explicit"), F.when(~pit & grid.inside(row, col), grid.idx(row, col)).alias("_to"))
    there = aimed.select(F.col("idx").alias("_to"), F.lit(True).alias("_is"))
    return aimed.join(there, "_to", "left").select("idx", F.when(F.col("_is"), F.col("_to")).otherwise(F.col("idx")).alias("idx_ds"), "explicit")


def encode(cells: DataFrame, grid: GridSpec, ftype: str) -> DataFrame:
    """(row, col, code) or (row, col, nextx, nexty) of every grid cell from (idx, idx_ds).
    Steps beyond the eight neighbours raise, except for nextxy."""
    every = grid.cells(cells.sparkSession)
    full = every.join(cells.select("idx", "idx_ds"), "idx", "left")
    if ftype == "nextxy":
        special = F.when(F.col("idx_ds").isNull(), F.lit(NEXTXY_NODATA)).when(F.col("idx") == F.col("idx_ds"), F.lit(NEXTXY_PITS[0]))
        return full.select("row", "col", special.otherwise(grid.col("idx_ds") + 1).cast("int").alias("nextx"), special.otherwise(grid.row("idx_ds") + 1).cast("int").alias("nexty"))
    e = encoding(ftype)
    dr, dc = grid.row("idx_ds") - F.col("row"), grid.col("idx_ds") - F.col("col")
    table = F.create_map(*[F.lit(x) for c, (r, k) in [(e.pits[0], (0, 0)), *e.steps.items()] for x in (3 * r + k, c)])
    near = (F.abs(dr) <= 1) & (F.abs(dc) <= 1)
    code = F.when(F.col("idx_ds").isNull(), F.lit(e.nodata)).when(near, table[(dr * 3 + dc).cast("int")]).otherwise(F.raise_error(F.lit("the next cell is not a neighbour")).cast("int"))
    return full.select("row", "col", code.cast("smallint").alias("code"))


def convert(code: Column, source: str, target: str) -> Column:
    """Codes of one local encoding in another; pits are the target's first pit code, unknown ones missing."""
    a, b = encoding(source), encoding(target)
    back = {s: c for c, s in b.steps.items()}
    pairs = [(c, back[s]) for c, s in a.steps.items()] + [(p, b.pits[0]) for p in a.pits] + [(a.nodata, b.nodata)]
    return F.coalesce(F.create_map(*[F.lit(x) for p in pairs for x in p])[code.cast("int")], F.lit(b.nodata)).cast("smallint")
