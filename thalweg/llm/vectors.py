"""Near-duplicate embeddings by a random-projection tree forest (operator 9).

Trees split at the median of a random projection and send what lies near the cut
to both sides.  Medians come from a bounded sample of the distinct vectors, so
trees are narrow where vectors are dense; every vector is then sent down every
tree.  Leaves that are still large get trees of their own, from a sample of what is
in them, until they are small or can't be split; those that can't are compared in
blocks.  Pairs of a leaf are verified in double precision.

A leaf returns a forest of its links and each vector's number of links, never pairs.
A pair that shares several leaves is counted in the first of them: vectors bring the
list of their leaves along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import components, forget, saved

THRESHOLD = 0.9
TREES = 6
#: Distinct vectors that the trees are fitted on, and the deepest tree: 2^12 medians a tree.
SAMPLE, MAX_DEPTH = 1 << 14, 12
#: Vectors that a leaf is to have.  Leaves of more than LARGE are split again, by trees
#: from about PART_SAMPLE of their vectors.
LEAF, LARGE, PART_SAMPLE = 512, 2048, 4096
#: Vectors of a block of a leaf that can't be split.
BLOCK = 1024
#: Half the width of the overlap, in standard deviations of the distance that a
#: pair at the threshold has along a random direction.
SPILL = 0.5
SEED = 20240601


def _usable(v) -> F.Column:
    """Non-null, with finite components that aren't all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _directions(seed: int, dim: int, depth: int) -> np.ndarray:
    """Of a tree, or of the tree of a leaf: its number is the seed."""
    d = np.random.Generator(np.random.Philox(key=[SEED + seed % (1 << 60), dim])).standard_normal((dim, max(depth, 1)))
    return d / np.linalg.norm(d, axis=0)


def _width(dim: int, threshold: float) -> float:
    return SPILL * float(np.sqrt((2 - 2 * threshold) / dim))


def _descend(p: np.ndarray, cuts: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, leaves) of projections p (rows x levels); a row may be in several leaves."""
    rows, node = np.arange(len(p)), np.zeros(len(p), np.int64)
    for level in range(p.shape[1]):
        x, c = p[rows, level], cuts[(1 << level) - 1 + node]
        lo, hi = x < c + width, x >= c - width
        rows, node = np.concatenate((rows[lo], rows[hi])), np.concatenate((2 * node[lo], 2 * node[hi] + 1))
    return rows, node


def fit_trees(sample: np.ndarray, depth: int, threshold: float = THRESHOLD, seeds=range(TREES)) -> list[np.ndarray]:
    """Per tree the medians of its nodes by level, for unit vectors of one dimension."""
    out, width = [], _width(sample.shape[1], threshold)
    for t in seeds:
        p = sample @ _directions(t, sample.shape[1], depth)
        cuts = np.zeros((1 << depth) - 1)
        rows, node = np.arange(len(sample)), np.zeros(len(sample), np.int64)
        for level in range(depth):
            x = p[rows, level]
            order = np.lexsort((x, node))
            begin = np.searchsorted(node[order], np.arange((1 << level) + 1))
            mid = (begin[:-1] + begin[1:]) // 2
            full = begin[1:] > begin[:-1]
            at = (1 << level) - 1
            cuts[at : at + (1 << level)][full] = x[order][mid[full]]
            c = cuts[at + node]
            lo, hi = x < c + width, x >= c - width
            rows, node = np.concatenate((rows[lo], rows[hi])), np.concatenate((2 * node[lo], 2 * node[hi] + 1))
        out.append(cuts)
    return out


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cell(*of: int) -> int:
    """The number of a leaf, given its tree, its dimension and its place."""
    return xxhash.xxh3_64_intdigest(np.array(of, np.int64).tobytes()) >> 1


def _cells(of: list[int], leaf: np.ndarray) -> np.ndarray:
    u, inverse = np.unique(leaf, return_inverse=True)
    return np.array([_cell(*of, int(x)) for x in u], np.int64)[inverse] if len(u) else np.zeros(0, np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    """Unit vectors from an Arrow column of lists of one length."""
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def leaf_links(x: np.ndarray, cells: list, copies: np.ndarray, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, whether the pair counts here) of the linked pairs of a leaf's unit vectors;
    with sides, of pairs of different sides.  ``cells`` has each one's earlier leaves."""
    n = len(x)
    flat = np.concatenate([np.asarray(c, np.int64) for c in cells]) if n else np.zeros(0, np.int64)
    of = np.repeat(np.arange(n), [len(c) for c in cells])
    u, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    number = np.cumsum(count > 1) - 1
    bits = np.zeros((n, int((count > 1).sum()) // 64 + 1), np.uint64)
    k = number[at[shared]]
    np.bitwise_or.at(bits, (of[shared], k >> 6), np.uint64(1) << (k & 63).astype(np.uint64))
    found = []
    for lo in range(0, n, 256):
        near = x[lo : lo + 256] @ x[lo:].T >= threshold
        near &= np.arange(lo, n)[None, :] > np.arange(lo, min(n, lo + 256))[:, None]
        if side is not None:
            near &= side[lo : lo + 256, None] != side[None, lo:]
        i, j = np.nonzero(near)
        i, j = i + lo, j + lo
        for part in range(0, len(i), 1 << 17):
            a, b = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
            found.append((a, b, ~(bits[a] & bits[b]).any(axis=1)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that links lead to, for numbers under n."""
    root = np.arange(n)
    while len(i):
        u, v = root[i], root[j]
        if (u == v).all():
            break
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return root


def _compare(threshold: float):
    """(id, root, near) of the linked vectors of a leaf or of two of its blocks."""

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        ids, copies, side = (table.column(c).to_numpy() for c in ("id", "copies", "side"))
        order = np.argsort(ids, kind="stable")
        ids, copies, side = ids[order], copies[order], side[order]
        x = _matrix(table.column("v").combine_chunks(), dim)[order]
        cells = table.column("earlier").combine_chunks().take(pa.array(order)).to_pylist()
        alone = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        i, j, first = leaf_links(x, cells, copies, threshold, None if alone else side)
        near = np.bincount(i[first], copies[j[first]], len(ids)) + np.bincount(j[first], copies[i[first]], len(ids))
        root = _forest(len(ids), i, j)
        at = np.flatnonzero((near > 0) | (root != np.arange(len(ids))))
        return pa.table({"id": pa.array(ids[at], pa.int64()), "root": pa.array(ids[root[at]], pa.int64()), "near": pa.array(near[at].astype(np.int64))})

    return run


def _split(placed: DataFrame, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Places (tree, cell, dim, id) with leaves of more than LARGE split again as long as that
    makes them smaller, and the (cell, blocks) of those that can't be split."""
    settled = None  # leaves that can't be split, with their sizes
    spark = placed.sparkSession
    while True:
        large = placed.groupBy("tree", "cell").agg(F.count("*").alias("n")).where(F.col("n") > LARGE)
        if settled is not None:
            large = large.join(settled, "cell", "left_anti")
        large = saved(large, "large")
        if large.isEmpty():
            break
        part = saved(placed.join(large, ["tree", "cell"]).join(classes.select("id", "v"), "id"), "large-leaves")
        draw = F.pmod(F.xxhash64("id", "cell"), F.lit(1 << 30)) < F.lit(float(PART_SAMPLE) * (1 << 30)) / F.col("n")

        def fit(table: pa.Table) -> pa.Table:
            cell, dim, n, tree = (table.column(c)[0].as_py() for c in ("cell", "dim", "n", "tree"))
            x = _matrix(table.column("v").combine_chunks(), dim)
            depth = min(int(np.ceil(np.log2(n / LEAF))), max(1, int(np.log2(len(x) / 8)))) if len(x) >= 16 else 0
            cuts = np.zeros(0)
            while depth:
                (cuts,) = fit_trees(x, depth, threshold, [cell])
                _, leaf = _descend(x @ _directions(cell, dim, depth), cuts, _width(dim, threshold))
                if np.bincount(leaf).max() <= 0.75 * len(x):
                    break
                depth, cuts = (depth + 1) // 2 if depth > 1 else 0, np.zeros(0)
            return pa.table({"cell": pa.array([cell], pa.int64()), "depth": pa.array([depth], pa.int32()), "cuts": pa.array([cuts], pa.list_(pa.float64()))})

        models = part.where(draw).groupBy("cell").applyInArrow(fit, "cell long, depth int, cuts array<double>")
        # a leaf of which nothing was drawn isn't split either
        models = saved(large.join(models, "cell", "left").select("cell", "n", F.coalesce("depth", F.lit(0)).alias("depth"), "cuts"), "models")

        def route(batches):
            for batch in batches:
                tree, cell, dim, ids, depth = (batch.column(c).to_numpy() for c in range(5))
                for k in np.unique(cell):
                    at = np.flatnonzero(cell == k)
                    d, levels = int(dim[at[0]]), int(depth[at[0]])
                    x = _matrix(batch.column(5).take(pa.array(at)), d)
                    cuts = np.array(batch.column(6)[int(at[0])].as_py())
                    i, leaf = _descend(x @ _directions(int(k), d, levels), cuts, _width(d, threshold))
                    yield pa.RecordBatch.from_arrays([pa.array(tree[at[i]]), pa.array(_cells([int(k)], leaf)), pa.array(dim[at[i]]), pa.array(ids[at[i]])], ["tree", "cell", "dim", "id"])

        stuck = models.where("depth = 0").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        settled = saved(stuck if settled is None else settled.unionByName(stuck), "stuck")
        routed = part.join(models.where("depth > 0").select("cell", "depth", "cuts"), "cell").select("tree", "cell", "dim", "id", "depth", "v", "cuts")
        routed = routed.mapInArrow(route, "tree int, cell long, dim int, id long")
        rest = placed.join(models.where("depth > 0").select("cell"), "cell", "left_anti").select("tree", "cell", "dim", "id")
        after = saved(rest.unionByName(routed), "places")
        forget(placed, part, large, models)
        placed = after
    if settled is None:
        settled = spark.createDataFrame([], "cell long, blocks int")
    return placed, settled


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding).

    Vectors link with cosine >= threshold (only such links are found, and nearly
    all of them); equal vectors and repeated rows link with each other.  Null,
    zero, and not wholly finite vectors link with nothing, nor do vectors of
    different lengths.  A row with null vec_id counts as a link of others, is
    never the smallest, and is never kept.  Other columns aren't read; no rows give
    no rows.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("v"))
    classes = saved(
        rows.where(_usable(F.col("v")))
        .groupBy("v")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumns({"dim": F.size("v"), "id": F.monotonically_increasing_id()}),
        "vectors",
    )
    shape = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    forest: dict[int, list[np.ndarray]] = {}
    depths: dict[int, int] = {}
    for dim, n in shape.items():
        depths[dim] = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(n / LEAF)))))
        if depths[dim]:
            part = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
            got = classes.where((F.col("dim") == dim) & part).select("v").limit(2 * SAMPLE).toPandas()["v"]
            forest[dim] = fit_trees(_unit(np.stack([np.asarray(v) for v in got])), depths[dim], threshold, range(trees)) if len(got) else []
            if not len(got):
                depths[dim] = 0
    shared = spark.sparkContext.broadcast((forest, depths))

    def leaves(batches):
        forest, depths = shared.value
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column(2).take(pa.array(at)), dim)
                for t in range(trees if depths[dim] else 1):
                    i, leaf = np.arange(len(at)), np.zeros(len(at), np.int64)
                    if depths[dim]:
                        i, leaf = _descend(x @ _directions(t, dim, depths[dim]), forest[dim][t], _width(dim, threshold))
                    cols = [pa.array(np.full(len(i), t, np.int32)), pa.array(_cells([t, dim], leaf)), pa.array(np.full(len(i), dim, np.int32)), pa.array(ids[at[i]])]
                    yield pa.RecordBatch.from_arrays(cols, ["tree", "cell", "dim", "id"])

    placed = saved(classes.select("id", "dim", "v").mapInArrow(leaves, "tree int, cell long, dim int, id long"), "places")
    placed, stuck = _split(placed, classes, threshold)

    # each vector once for each leaf, with its leaves before that one
    lists = placed.groupBy("id").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    spread = classes.select("id", "dim", "copies", "v").join(lists, "id").select("id", "dim", "copies", "v", "cells", F.posexplode("cells").alias("k", "cell"))
    spread = spread.withColumn("earlier", F.slice("cells", F.lit(1), F.col("k"))).drop("cells", "k")
    one = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    tile = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(block, o).alias("i"), F.greatest(block, o).alias("j"), (block > o).cast("int").alias("side")),
    )
    spread = spread.join(stuck, "cell", "left").withColumn("t", F.explode(F.when(F.col("blocks").isNull(), F.array(one)).otherwise(tile)))
    spread = spread.select("cell", "t.i", "t.j", "t.side", "dim", "id", "copies", "v", "earlier")
    found = saved(spread.groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "id long, root long, near long"), "found")
    forget(placed)
    degree = found.groupBy("id").agg(F.sum("near").alias("near"))
    united = components(found.select("id", "root"), "id", "root").withColumnRenamed("node", "id")
    labelled = classes.join(degree, "id", "left").join(united, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = saved(labelled.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    labelled = saved(
        labelled.join(least, "component").select("v", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id"), "labelled"
    )
    forget(found, least, classes)
    # vectors that link with nothing aren't joined: they would all have one key
    usable = _usable(F.col("v"))
    out = rows.where(usable).join(labelled, "v").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
