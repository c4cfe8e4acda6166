"""Helpers shared by the corpus operators: scratch storage, word patterns and
connected components on link tables."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) a temporary
    folder is made, set as checkpoint folder and removed at exit.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not at:
        own = tempfile.mkdtemp(prefix="thalweg-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(at := f"file://{own}")
    return at.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/thalweg-{app}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs that run inside pass at most so many rows at a time to Python: for rows
    that hold long arrays, of which the default number doesn't fit into memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def limit_arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's number of rows per batch for Python, if it is higher: the
    default suits numbers, and of whole texts it holds hundreds of MB a task.  For
    operators that return a frame which runs later, so that it can't be set back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: Bytes by which a worker may grow from task to task before it gives free memory back.
SLACK = 1 << 23
_size = 0


def _resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def _give_back() -> None:
    """Free memory goes back to the system, where the system is one that can be asked."""
    import pyarrow as pa

    global _size
    with suppress(OSError, AttributeError):
        now = _resident()
        if now > _size + SLACK:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
            _size = _resident()
        else:
            _size = min(_size, now)


def lean(run):
    """``run``, a function for mapInArrow, that gives back memory when its rows end: Spark
    keeps a task's Python for later stages, with what the largest of its tasks took."""

    @wraps(run)
    def rows(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return rows


_cleaned: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean_up(spark: SparkSession, app: str, path: str) -> None:
    """Remove a run's tables when Python ends, unless the session has ended before."""
    with suppress(Exception):
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
            _remove(spark, path)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, a
    lost executor costs one task, and later plans know the table's size.  ``forget``
    deletes it; what is left goes when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    if (run := path.rpartition("/")[0]) not in _cleaned:
        _cleaned.add(run)
        atexit.register(_clean_up, spark, spark.sparkContext.applicationId, run)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables that ``saved`` returned, once nothing will read them again: what was
    made from them must have been saved as well."""
    for df in frames:
        _remove(df.sparkSession, df._scratch)
    if frames:
        frames[0].sparkSession._jvm.System.gc()  # Spark removes the files of shuffles when their plans are collected


def extended(schema: StructType, ddl: str) -> StructType:
    """A schema with more columns, given as in SQL."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def n_words(text) -> F.Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Links that one task unites.
SMALL_GRAPH = 1 << 13


def _united(table):
    """Links of all nodes with the smallest node of their component."""
    import numpy as np
    import pyarrow as pa

    u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while not (root[a] == root[b]).all():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return pa.table({"u": pa.array(nodes[root[other]], pa.int64()), "v": pa.array(nodes[other], pa.int64())})


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of a link table as (node, component), where component
    is the smallest node reachable.  Nodes without links don't occur.

    Alternating large-star and small-star steps: each step is one minimum per
    node (combined before the shuffle) and one join, which adaptive execution can
    split at hot nodes.  Each node's links are replaced by links to its smallest
    neighbour until nothing changes, so the table never outgrows the first one.  What
    is left of at most SMALL_GRAPH links is finished by one task.
    """
    edges = saved(
        links.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).where("u < v").distinct(), "links"
    )
    for _ in range(max_rounds):
        if edges.count() <= SMALL_GRAPH:
            small = edges.groupBy(F.lit(0).alias("_g")).applyInArrow(_united, "u long, v long")
            after = saved(small, "small-graph")
            forget(edges)
            edges = after
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the joins can be split at hot nodes
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # now every link (u, v) has u < v; small-star works on the smaller neighbours
        large = saved(large, "large-star")
        low = saved(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        small = large.join(low, "v").select("m", "u", "v")
        small = small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()
        after = saved(small, "small-star")
        forget(edges, least, large, low)
        # settled: every node has one parent, and no parent has a parent
        parents = after.groupBy("v").agg(F.count("*").alias("n"))
        roots_below = after.select("u").distinct().join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        edges = after
        if parents.where("n > 1").isEmpty() and roots_below.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )


#: Bits of an id filter for each id, and its bits at least and at most (32 MB).
BITS_PER_ID, MIN_FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 16, 1 << 28
#: Bytes of text that are worked on at a time, and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 22, 1000


def bits_for(n: int, most: int, least: int = MIN_FILTER_BITS) -> int:
    """The power of two from n on, within limits."""
    return min(most, max(least, 1 << max(0, int(n) - 1).bit_length()))


def bytes_of(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow column of texts; none for null."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batch, column: int):
    """Parts of a batch of bounded length in the bytes of a column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right"))
        hi = min(max(hi, lo + 1), lo + SLICE_ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


def fresh(taken, *names: str) -> list[str]:
    """The names, with underscores before them as needed to differ from those taken
    (in any case: Spark doesn't tell them apart)."""
    taken = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class IdFilter:
    """A hash filter of a column's values: ``holds`` keeps every row whose value is in
    the column, and few others.  Used to read the texts of some documents without a
    shuffle of all texts; callers must bear with extra rows.

    Its size follows the number of rows up to MAX_FILTER_BITS, as it is broadcast.  With
    more ids than that it lets more rows through, in the end all, and what follows is a
    join of all texts by shuffle.
    """

    def __init__(self, df: DataFrame, column: str) -> None:
        self.bits = bits_for(df.count() * BITS_PER_ID, MAX_FILTER_BITS)
        h = self._hash(column) + 1  # bitmap functions count from 1
        parts = (
            df.select(h.alias("h"))
            .groupBy(F.bitmap_bucket_number("h").alias("k"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m"))
            .collect()
        )
        table = bytearray(self.bits // 8)
        for r in parts:
            at = (r["k"] - 1) * len(r["m"])
            table[at : at + len(r["m"])] = r["m"]
        self.table = df.sparkSession.sparkContext.broadcast(bytes(table))

    def _hash(self, column) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits))

    def holds(self, column) -> F.Column:
        table = self.table

        @F.arrow_udf("boolean")  # Arrow arrays, as pandas would stay in each worker's memory
        def found(h):
            import numpy as np
            import pyarrow as pa

            bits, v = np.frombuffer(table.value, np.uint8), h.to_numpy(zero_copy_only=False)
            return pa.array((bits[v >> 3] >> (v & 7).astype(np.uint8)) & 1 == 1)

        return found(self._hash(column))
