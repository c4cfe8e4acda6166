"""Recursive network computations by block contraction.

A network is a table (idx, idx_ds): every cell has one downstream cell, pits
point to themselves.  Cells are cut into blocks (``block``) that fit one task.
A task solves its block with array operations and leaves a small remainder: the
cells where paths enter the block and where they go on.  That remainder is again
a network, so it is solved by the same function, until one block holds it.  Data
is shuffled once or twice a level, and levels shrink with a block's perimeter, so
the depth of the network doesn't matter.  Where contraction doesn't shrink the
network (ids without locality), paths are halved by joins instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from thalweg.plans.store import saved

#: Cells of a block of a network without a grid.
BLOCK_CELLS = 1 << 22
#: A remainder of more than this share of the cells is solved by joins.
SHRINK = 0.5
_COMBINE: dict[str, Callable] = {"sum": np.add, "min": np.minimum, "max": np.maximum}
_COLUMN: dict[str, Callable] = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
_AGGREGATE: dict[str, Callable] = {"sum": F.sum, "min": F.min, "max": F.max}


def identity(op: str, integral: bool):
    if op == "sum":
        return 0 if integral else 0.0
    lowest = -(1 << 62) if integral else float("-inf")
    return lowest if op == "max" else -lowest


def _places(idx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Where targets stand in idx; -1 for those that aren't there."""
    order = np.argsort(idx, kind="stable")
    at = np.minimum(np.searchsorted(idx[order], target), len(idx) - 1)
    return np.where(idx[order][at] == target, order[at], -1)


def _numbers(column: pa.ChunkedArray, fill) -> np.ndarray:
    return column.fill_null(fill).to_numpy() if column.null_count else column.to_numpy()


def follow(down: np.ndarray, ends: np.ndarray, values: dict[str, tuple[np.ndarray, str]]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """For each position the first end that its path meets, values folded over the
    path before it, and whether an end is met at all (loops meet none)."""
    here = np.arange(len(down))
    jump = np.where(ends, here, down)
    folded = {}
    for name, (v, op) in values.items():
        folded[name] = np.where(ends, identity(op, v.dtype.kind == "i"), v)
    for _ in range(max(1, int(len(down)).bit_length() + 1)):
        again = jump[jump]
        if (again == jump).all():
            break
        for name, (_v, op) in values.items():
            folded[name] = _COMBINE[op](folded[name], folded[name][jump])
        jump = again
    return jump, folded, ends[jump]


def gather(down: np.ndarray, roots: np.ndarray, values: dict[str, tuple[np.ndarray, str]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Values combined over everything upstream of each position, itself included,
    and which positions reach a root.  Cells in or above loops are left out."""
    _, steps, ok = follow(down, roots, {"n": (np.ones(len(down), np.int64), "sum")})
    deep = np.where(ok, steps["n"], 0)
    out = {k: v.copy() for k, (v, _) in values.items()}
    # by halving: jump is the exact 2^k-th cell downstream, -1 beyond the root
    jump = np.where(ok & ~roots, down, -1)
    for _ in range(int(deep.max(initial=0)).bit_length()):
        live = np.flatnonzero(jump >= 0)
        before = {k: v[live] for k, v in out.items()}
        for k, (_v, op) in values.items():
            _COMBINE[op].at(out[k], jump[live], before[k])
        jump[live] = jump[jump[live]]
    return out, ok


def _typed(df: DataFrame, names) -> dict[str, bool]:
    """Whether each column is integral."""
    kinds = dict(df.dtypes)
    return {c: kinds[c] in ("bigint", "int", "smallint", "tinyint", "boolean") for c in names}


def _prepared(df: DataFrame, ops: dict[str, str], integral: dict[str, bool]) -> list[F.Column]:
    out = []
    for c, op in ops.items():
        out.append(F.coalesce(F.col(c).cast("long" if integral[c] else "double"), F.lit(identity(op, integral[c]))).alias(c))
    return out


def with_block(df: DataFrame, block: F.Column | None = None) -> DataFrame:
    return df.withColumn("block", block if block is not None else F.floor(F.col("idx") / BLOCK_CELLS).cast("long"))


def _fields(ops: dict[str, str], integral: dict[str, bool]) -> list[StructField]:
    return [StructField(c, LongType() if integral[c] else DoubleType()) for c in ops]


def ascend(df: DataFrame, ops: dict[str, str] | None = None, stop: F.Column | None = None, block: F.Column | None = None) -> DataFrame:
    """(idx, terminal, ...) of every cell of ``df`` (idx, idx_ds, columns of ops).

    The terminal is the first cell on the downstream path, the cell itself
    included, that is a pit or where ``stop`` is true; null where a path runs into
    a loop.  ``ops`` folds columns by sum, min or max over the path's cells before
    the terminal (nulls count as nothing).
    """
    ops = ops or {}
    integral = _typed(df, ops)
    ends = F.col("idx") == F.col("idx_ds")
    ends = ends if stop is None else ends | F.coalesce(stop, F.lit(False))
    cells = df.where("idx_ds is not null").select(F.col("idx").cast("long"), F.col("idx_ds").cast("long"), ends.alias("_end"), *_prepared(df, ops, integral))
    return _ascend(with_block(cells, block), ops, integral)


def _ascend(cells: DataFrame, ops: dict[str, str], integral: dict[str, bool]) -> DataFrame:
    names = list(ops)

    def solve(table: pa.Table) -> pa.Table:
        idx, ds = table.column("idx").to_numpy(), table.column("idx_ds").to_numpy()
        end = table.column("_end").to_numpy()
        down = _places(idx, ds)
        leaves = ~end & (down < 0)
        values = {c: (table.column(c).to_numpy(), ops[c]) for c in names}
        jump, folded, ok = follow(np.where(down < 0, 0, down), end | leaves, values)
        goes_on = ok & leaves[jump]
        for c, (v, op) in values.items():
            folded[c] = np.where(goes_on, _COMBINE[op](folded[c], v[jump]), folded[c])
        out = {"idx": pa.array(idx), "terminal": pa.array(idx[jump], mask=~(ok & ~goes_on)), "_next": pa.array(ds[jump], mask=~goes_on)}
        return pa.table(out | {c: pa.array(folded[c]) for c in names})

    schema = StructType([StructField("idx", LongType()), StructField("terminal", LongType()), StructField("_next", LongType()), *_fields(ops, integral)])
    local = saved(cells.groupBy("block").applyInArrow(solve, schema), "paths")
    entries = local.where("_next is not null").select(F.col("_next").alias("idx")).distinct()
    rest = saved(entries.join(local, "idx"), "entries")
    n_rest = rest.count()
    if not n_rest:
        return local.drop("_next")
    # the remainder: from entry to entry; entries whose path ends in their block are the ends
    smaller = rest.select("idx", F.coalesce("_next", "idx").alias("idx_ds"), F.col("_next").isNull().alias("_end"), *names)
    if n_rest <= SHRINK * local.count():
        solved = _ascend(with_block(smaller), ops, integral)
    else:
        solved = _halve(smaller, ops)
    at_end = rest.where("_next is null").select(F.col("idx").alias("terminal"), F.col("terminal").alias("_t"), *[F.col(c).alias(f"_e_{c}") for c in names])
    solved = solved.join(at_end, "terminal", "left")
    full = solved.select(
        F.col("idx").alias("_next"),
        F.col("_t").alias("_terminal"),
        *[_COLUMN[ops[c]](F.col(c), F.coalesce(f"_e_{c}", F.lit(identity(ops[c], integral[c])))).alias(f"_f_{c}") for c in names],
    )
    both = local.join(full, "_next", "left")
    goes_on = F.col("_next").isNotNull()
    return saved(
        both.select(
            "idx",
            F.when(goes_on, F.col("_terminal")).otherwise(F.col("terminal")).alias("terminal"),
            *[F.when(goes_on, _COLUMN[ops[c]](F.col(c), F.coalesce(f"_f_{c}", F.lit(identity(ops[c], integral[c]))))).otherwise(F.col(c)).alias(c) for c in names],
        ),
        "ascended",
    )


def _halve(cells: DataFrame, ops: dict[str, str]) -> DataFrame:
    """ascend by joins: each round doubles how far cells look ahead; it ends when
    no more cells meet an end."""
    names = list(ops)
    integral = _typed(cells, ops)
    folded = [F.when(F.col("_end"), F.lit(identity(ops[c], integral[c]))).otherwise(F.col(c)).alias(c) for c in names]
    now = saved(cells.select("idx", F.when(~F.col("_end"), F.col("idx_ds")).alias("_j"), F.when(F.col("_end"), F.col("idx")).alias("terminal"), *folded), "halve")
    left = None
    while True:
        open_now = now.where("_j is not null").count()
        if open_now == 0 or open_now == left:
            return now.select("idx", "terminal", *names)
        left = open_now
        ahead = now.select(F.col("idx").alias("_j"), F.col("_j").alias("_jj"), F.col("terminal").alias("_tt"), *[F.col(c).alias(f"_a_{c}") for c in names])
        both = now.join(ahead, "_j", "left")
        moves = F.col("_j").isNotNull()
        now = saved(
            both.select(
                "idx",
                F.when(moves, F.col("_jj")).alias("_j"),
                F.coalesce("terminal", "_tt").alias("terminal"),
                *[F.when(moves, _COLUMN[ops[c]](F.col(c), F.col(f"_a_{c}"))).otherwise(F.col(c)).alias(c) for c in names],
            ),
            "halve",
        )


def descend(df: DataFrame, ops: dict[str, str], block: F.Column | None = None) -> DataFrame:
    """(idx, columns of ops) of every cell that reaches a pit: columns combined by
    sum, min or max over the cell and everything upstream of it (nulls count as
    nothing; all null gives null for min and max)."""
    integral = _typed(df, ops)
    cells = df.where("idx_ds is not null").select(F.col("idx").cast("long"), F.col("idx_ds").cast("long"), *_prepared(df, ops, integral))
    out = _descend(with_block(cells, block), ops, integral)
    nothing = lambda c: F.when(F.col(c) == F.lit(identity(ops[c], integral[c])), None).otherwise(F.col(c)) if ops[c] != "sum" else F.col(c)
    return out.select("idx", *[nothing(c).alias(c) for c in ops])


def _descend(cells: DataFrame, ops: dict[str, str], integral: dict[str, bool]) -> DataFrame:
    names = list(ops)
    fields = [StructField("idx", LongType()), *_fields(ops, integral), StructField("_next", LongType()), StructField("_exit", LongType()), StructField("_ok", BooleanType())]

    def solve(table: pa.Table) -> pa.Table:
        idx, ds = table.column("idx").to_numpy(), table.column("idx_ds").to_numpy()
        down = _places(idx, ds)
        leaves = down < 0
        roots = leaves | (idx == ds)
        down = np.where(leaves, 0, down)
        out, ok = gather(down, roots, {c: (table.column(c).to_numpy(), ops[c]) for c in names})
        jump, _, _ = follow(down, roots, {})
        cols = {"idx": pa.array(idx)} | {c: pa.array(out[c]) for c in names}
        # _next: where an exit flows to; _exit: the exit that a cell's path takes
        cols |= {"_next": pa.array(ds, mask=~leaves), "_exit": pa.array(idx[jump], mask=~(ok & leaves[jump])), "_ok": pa.array(ok)}
        return pa.table(cols)

    local = saved(cells.groupBy("block").applyInArrow(solve, StructType(fields)), "upstream")
    exits = local.where("_next is not null")
    n = exits.count()
    if not n:
        return local.where("_ok").select("idx", *names)
    into = local.select(F.col("idx").alias("_next"), F.col("_exit").alias("_on"), F.col("_ok").alias("_enters"))
    smaller = exits.join(into, "_next").where("_enters").select("idx", F.coalesce("_on", "idx").alias("idx_ds"), *names)
    smaller = saved(smaller, "exits")
    if n <= SHRINK * local.count():
        total = _descend(with_block(smaller), ops, integral)
    else:
        total = _doubled(smaller, ops)
    inflow = total.join(exits.select("idx", "_next"), "idx").groupBy(F.col("_next").alias("idx")).agg(*[_AGGREGATE[ops[c]](c).alias(f"_in_{c}") for c in names])
    more = cells.join(inflow, "idx", "left").select(
        "idx", "idx_ds", "block", *[_COLUMN[ops[c]](F.col(c), F.coalesce(f"_in_{c}", F.lit(identity(ops[c], integral[c])))).alias(c) for c in names]
    )
    done = saved(more.groupBy("block").applyInArrow(solve, StructType(fields)), "upstream")
    # cells whose way on leads into a loop don't count: their exit isn't among the solved ones
    good = total.select(F.col("idx").alias("_exit"), F.lit(True).alias("_reaches"))
    return done.where("_ok").join(good, "_exit", "left").where("_exit is null or _reaches").select("idx", *names)


def _doubled(cells: DataFrame, ops: dict[str, str]) -> DataFrame:
    """descend by joins, for networks that don't contract; cells of loops are dropped first."""
    names = list(ops)
    ends = _halve(cells.select("idx", "idx_ds", (F.col("idx") == F.col("idx_ds")).alias("_end")), {})
    now = saved(
        cells.join(ends.where("terminal is not null").select("idx"), "idx", "left_semi").select("idx", F.when(F.col("idx") != F.col("idx_ds"), F.col("idx_ds")).alias("_j"), *names),
        "double",
    )
    while not now.where("_j is not null").isEmpty():
        add = now.where("_j is not null").groupBy(F.col("_j").alias("idx")).agg(*[_AGGREGATE[ops[c]](c).alias(f"_a_{c}") for c in names])
        ahead = now.select(F.col("idx").alias("_j"), F.col("_j").alias("_jj"))
        both = now.join(ahead, "_j", "left").join(add, "idx", "left")
        now = saved(both.select("idx", F.col("_jj").alias("_j"), *[F.when(F.col(f"_a_{c}").isNull(), F.col(c)).otherwise(_COLUMN[ops[c]](F.col(c), F.col(f"_a_{c}"))).alias(c) for c in names]), "double")
    return now.select("idx", *names)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
