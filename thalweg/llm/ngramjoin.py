"""N-gram Jaccard self-join (operator 7): documents whose sets of word shingles
have a Jaccard index of 0.8 or more, exactly.

* Documents with equal sets are one entity from the start.
* Linked entities share a shingle of their prefixes: the first n - ceil(0.8 n) + 1
  of a set of n in one order for all sets.  Any order is right; this one is by level,
  the logarithm of the number of documents that have the shingle, then by hash.  So
  neither common passages nor shingles that long texts share by chance gather
  unrelated documents: such a shingle is in more documents than the others of either
  text or, if that one has copies, of its copies.  Levels are read from a bitmap of
  bounded size; where it is too small, it has the more frequent shingles.
* The sharers of a prefix shingle may link only if sizes and places in the prefixes
  leave room for the overlap.  Each shingle gives a forest over those that may, so
  what is written is linear in its sharers.  The forests' components are clusters:
  entities of different clusters don't link.
* Clusters are compared in tiles: bands of set size, cut into blocks of bounded
  length; a tile is a block, or two of one band or of neighbouring ones.  In a tile
  bitmap signatures bound the overlap (|A xor B| is at least the number of differing
  bits), then what remains is decided by intersecting sorted arrays.  A tile returns
  a forest of its links and each entity's number of links, never pairs.

For components alone, blocks are compared with themselves first; then only the
entities outside their cluster's largest component meet the cluster's blocks.
Numbers of links need all tiles, in which a large cluster takes the square of its
length in comparisons (not in rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import IdFilter, arrow_rows, bits_for, bytes_of, components, forget, fresh, lean, saved, slices
from thalweg.llm.shingles import SHINGLE_WORDS, mix, shingle_sets

#: The threshold as a fraction: intersection * DEN >= union * NUM.
NUM, DEN = 80, 100
#: Level j and those above have shingles of more than HOT * 2^(j - 1) documents; counted are
#: the REGION smallest hashes, as prefixes seldom reach further.  The others stand behind
#: level UNCOUNTED, before what is common.
HOT, LEVELS, REGION, UNCOUNTED = 1, 16, 0.6, 3
#: The bitmap of common shingles has this many bits for each of their levels, MAX_HOT_BITS
#: at most; with less than LEAST_PER_HOT bits for each, it has the more frequent shingles.
BITS_PER_HOT, LEAST_PER_HOT, MAX_HOT_BITS = 16, 2, 1 << 28
#: Prefix shingles are dealt into buckets of about this many, BUCKETS at least.
BUCKET_KEYS, BUCKETS = 1 << 21, 256
#: Sharers of a shingle that are compared pair by pair; of more, neighbours in size are.
SHARERS = 512
#: Sharers of a shingle within one batch of documents beyond which neighbours in size are
#: united before the shuffle; entries that a bucket holds before it does so again.
BATCH_SHARERS, HELD = 64, 1 << 23
#: Entities of a tile's block, and their shingles.
BLOCK, BLOCK_ITEMS = 1024, 1 << 20
#: Bits of a signature for each shingle of the largest set of a tile, within limits.
SIGNATURE, MIN_BITS, MAX_BITS = 8, 512, 1 << 16
#: Rows that Python gets at a time.
ARROW_ROWS = 1000
NO_ID = -(1 << 63)

#: A prefix shingle of an entity: what is left of its hash within the bucket, the
#: entity, the logarithm of the set's size and the place in the prefix, in small units.
ENTRY = np.dtype([("slot", np.uint32), ("entity", np.int64), ("size", np.uint16), ("place", np.uint16)])
#: Units of the logarithm of a size, the place of entries that stand for several
#: entities, and by how much the sizes of linked sets differ at most.
LOG, ANY = 2000, 0xFFFF
GAP = int(np.ceil(np.log(DEN / NUM) * LOG)) + 1


def signature(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def may_link(na: int, a: np.ndarray, nb: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the signatures (``b`` has one a row) allow a link between a set and others."""
    differ = np.bitwise_count(b ^ a).sum(axis=1, dtype=np.int64)
    total = na + nb
    # links need (NUM + DEN) * overlap >= NUM * total, and 2 * overlap <= total - differ
    return (NUM + DEN) * (total - differ) >= 2 * NUM * total


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both) and both > 0


def entity_of(s: np.ndarray) -> int | None:
    """A set's 64-bit id; none for an empty set."""
    if not len(s):
        return None
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _split(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and slot of hashes; a slot keeps 32 more bits of them."""
    return (keys % np.uint64(buckets)).astype(np.int64), (keys // np.uint64(buckets)).astype(np.uint32)


def _bit(bucket, slot: np.ndarray, bits: int, level=0) -> np.ndarray:
    """Where the bitmap of common shingles has whether a shingle is above a level."""
    at = slot.astype(np.uint64) << np.uint64(32) ^ np.asarray(level).astype(np.uint64) << np.uint64(26) ^ np.asarray(bucket).astype(np.uint64)
    return (mix(at) & np.uint64(bits - 1)).astype(np.int64)


def _counted_part(s: np.ndarray) -> int:
    """How many shingles of a set are counted: its smallest ones."""
    return int(np.searchsorted(s, np.uint64(REGION * (1 << 64))))


def _region(buckets: int, k: int):
    """Rows (bucket, slots): the slots that the documents of a batch have to count."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                sets = shingle_sets(bytes_of(part.column(0)), k)
                keys = np.concatenate([np.zeros(0, np.uint64), *(s[: _counted_part(s)] for s in sets)])
                yield from _packed(*_split(keys, buckets), buckets)

    return run


def _packed(bucket: np.ndarray, data: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    data = data[order]
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([data[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "data"])


@lean
def _counted(batches):
    """(bucket, slot, n) of slots of more than HOT documents, from rows sorted by bucket.
    Counts are merged as rows come, so a bucket takes memory for its distinct slots."""

    def flush(at, slots, counts, parts):
        slots = np.concatenate([slots, *parts])
        counts = np.concatenate([counts, *(np.ones(len(p), np.int64) for p in parts)])
        u, inverse = np.unique(slots, return_inverse=True)
        return u, np.bincount(inverse, weights=counts, minlength=len(u)).astype(np.int64)

    def result(at, u, n):
        hot = n > HOT
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(hot.sum()), at), pa.int32()), pa.array(u[hot].astype(np.int64)), pa.array(n[hot])], ["bucket", "slot", "n"])

    none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at, (slots, counts), parts, held = None, none, [], 0
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != at and at is not None:
                yield result(at, *flush(at, slots, counts, parts))
                (slots, counts), parts, held = none, [], 0
            at = bucket
            parts.append(np.frombuffer(data, np.uint32))
            held += len(parts[-1])
            if held > HELD:
                (slots, counts), parts, held = flush(at, slots, counts, parts), [], 0
    if at is not None:
        yield result(at, *flush(at, slots, counts, parts))


def _hot_bitmap(hot: DataFrame) -> tuple[np.ndarray, int]:
    """The bitmap of common shingles (bucket, slot, n) and its number of bits; 0 if there
    are none.  It is set in pieces by the executors.  Where there are too many for it,
    it has the more frequent ones."""
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / max(HOT, 1))))).cast("int")
    sizes = sorted((r["level"], r["level"] * r["count"]) for r in hot.groupBy(level.alias("level")).count().collect())
    while len(sizes) > 1 and sum(c for _, c in sizes) * LEAST_PER_HOT > MAX_HOT_BITS:
        sizes = sizes[1:]
    n = sum(c for _, c in sizes)
    if not n:
        return np.zeros(0, np.uint8), 0
    hot = hot.where(level >= sizes[0][0])
    bits = bits_for(n * BITS_PER_HOT, MAX_HOT_BITS)
    piece = 1 << 15

    @lean
    def place(batches):
        for batch in batches:
            at = _bit(*(c.to_numpy() for c in batch.columns[:2]), bits, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at // piece), pa.array(at % piece)], ["piece", "at"])

    rows = (
        hot.select("bucket", "slot", F.explode(F.sequence(F.lit(0), level - 1))).mapInArrow(place, "piece long, at long").groupBy("piece")
        .agg(F.bitmap_construct_agg("at").alias("m")).toLocalIterator()
    )
    table = np.zeros(bits // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        lo = r["piece"] * piece // 8
        table[lo : lo + piece // 8] = part[: len(table) - lo]
    return table, bits


def _prefix(s: np.ndarray, bucket: np.ndarray, slot: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Places in ``s`` of its prefix, in the order for all sets."""
    n = len(s)
    p = n - -(-NUM * n // DEN) + 1
    if not bits:
        return np.arange(p)
    counted = _counted_part(s)
    level, above = np.full(n, 2 * UNCOUNTED + 1, np.int8), np.arange(counted)
    level[above] = 0
    for j in range(LEVELS):
        at = _bit(bucket[above], slot[above], bits, j)
        above = above[(table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        level[above] = 2 * (j + 1)
        if (counted if j < UNCOUNTED else n) - len(above) >= p:  # what is above isn't in the prefix
            break
    return np.argsort(level, kind="stable")[:p]


def _describe(buckets: int, k: int, shared):
    """Two kinds of rows: (did, th, n, entity) of documents, and (bucket, data, a, b) with
    the packed entries of a batch of documents, and links of entities to cluster."""
    names = ["did", "th", "n", "entity", "bucket", "data", "a", "b"]
    types = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def made(length, **cols):
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(length, t) for c, t in zip(names, types, strict=True)], names)

    @lean
    def run(batches):
        table, bits = shared.value
        for batch in batches:
            for part in slices(batch, 2):
                sets = shingle_sets(bytes_of(part.column(2)), k)
                ids = [entity_of(s) for s in sets]
                yield made(len(sets), did=part.column(0), th=part.column(1), n=pa.array([len(s) for s in sets], pa.int64()), entity=pa.array(ids, pa.int64()))
                packs, seen = [], set()
                for s, e in zip(sets, ids, strict=True):
                    if e is None or e in seen:
                        continue
                    seen.add(e)
                    bucket, slot = _split(s, buckets)
                    at = _prefix(s, bucket, slot, table, bits)
                    entry = np.empty(len(at), ENTRY)
                    entry["slot"], entry["entity"] = slot[at], e
                    entry["size"] = int(np.log(len(s)) * LOG)
                    entry["place"] = np.arange(len(at)) * (ANY - 1) // len(s)
                    packs.append((bucket[at], entry))
                if packs:
                    bucket, entry = (np.concatenate(x) for x in zip(*packs, strict=True))
                    order = np.lexsort((entry["size"], entry["slot"], bucket))
                    bucket, entry = bucket[order], entry[order]
                    group = _groups(bucket.astype(np.uint64) << np.uint64(32) | entry["slot"])
                    entry, bucket, edges = _thinned(entry, group, BATCH_SHARERS, bucket)
                    for out in _packed(bucket, entry, buckets):
                        yield made(out.num_rows, bucket=out.column(0), data=out.column(1))
                    if len(edges[0]):
                        yield made(1, a=pa.array([edges[0]], pa.list_(pa.int64())), b=pa.array([edges[1]], pa.list_(pa.int64())))

    return run


def _groups(keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys."""
    return np.cumsum(np.append(False, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _thinned(entry: np.ndarray, group: np.ndarray, most: int, also: np.ndarray | None = None):
    """Entries sorted by group and size, without most of those of groups of more than
    ``most``: there, neighbours that may link by size are united, and of each range of
    sizes the smallest and the largest stay, as entries that may be in any place."""
    large = np.bincount(group)[group] > most if len(group) else np.zeros(0, bool)
    if not large.any():
        return entry, also, (np.zeros(0, np.int64),) * 2
    size = entry["size"].astype(np.int64)
    join = large[1:] & (group[1:] == group[:-1]) & (size[1:] - size[:-1] <= GAP)
    edges = _forest(entry["entity"][:-1][join], entry["entity"][1:][join])
    band = size // GAP
    first = np.append(True, (group[1:] != group[:-1]) | (band[1:] != band[:-1]))
    last = np.append(first[1:], True)
    entry = entry.copy()
    entry["place"][large] = ANY
    keep = ~large | first | last
    return entry[keep], also[keep] if also is not None else None, edges


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node of a graph with the smallest one of its component."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        u, v = root[x], root[y]
        if (u == v).all():
            break
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def may_share(entry: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and places leave room for the overlap of entries i and j, of which j
    has the larger size.  Rounding is to the side of more pairs."""
    size = entry["size"].astype(np.float64)
    low, high = np.exp(size / LOG), np.exp((size + 1) / LOG)
    place = entry["place"].astype(np.float64) / (ANY - 1)
    room = high * (1 - place) + 1e-6
    whole = (entry["place"][i] == ANY) | (entry["place"][j] == ANY)
    return whole | ((NUM + DEN) * np.minimum(room[i], room[j]) >= NUM * (low[i] + low[j]) * (1 - 1e-9))


def cluster_links(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the entities of a bucket that share a slot and may link."""
    entry = entry[np.lexsort((entry["entity"], entry["slot"]))]
    if len(entry):
        # ANY is the largest place and the least bound, so of equal entries it stays
        entry = entry[np.lexsort((-entry["place"].astype(np.int64), entry["entity"], entry["slot"]))]
        entry = entry[np.append(True, (entry["slot"][1:] != entry["slot"][:-1]) | (entry["entity"][1:] != entry["entity"][:-1]))]
    entry = entry[np.lexsort((entry["size"], entry["slot"]))]
    group = _groups(entry["slot"])
    n = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    several = n[group] > 1 if len(group) else np.zeros(0, bool)
    entry, group = entry[several], _groups(entry["slot"][several])
    entry, _, (a, b) = _thinned(entry, group, SHARERS)
    group = _groups(entry["slot"])
    size = entry["size"].astype(np.int64)
    at = group.astype(np.int64) << 17 | size
    partners = np.searchsorted(at, at + GAP, "right") - np.arange(len(entry)) - 1
    ends = np.cumsum(partners)
    lefts, rights = [a], [b]
    lo = 0
    while lo < len(entry):  # some millions of pairs at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 22), "right")))
        count = partners[lo:hi]
        i = np.repeat(np.arange(lo, hi), count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
        ok = may_share(entry, i, j)
        x, y = _forest(entry["entity"][i[ok]], entry["entity"][j[ok]])
        lefts.append(x)
        rights.append(y)
        lo = hi
    return _forest(np.concatenate(lefts), np.concatenate(rights))


@lean
def _clustered(batches):
    """(a, b) links of entities to cluster, from rows (bucket, data) sorted by bucket."""

    def links(parts):
        a, b = cluster_links(np.concatenate(parts))
        for lo in range(0, len(a), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 200_000]), pa.array(b[lo : lo + 200_000])], ["a", "b"])

    at, parts, held, limit = None, [], 0, HELD
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != at:
                if parts:
                    yield from links(parts)
                at, parts, held, limit = bucket, [], 0, HELD
            parts.append(np.frombuffer(data, ENTRY))
            held += len(parts[-1])
            if held > limit:
                entry = np.unique(np.concatenate(parts))
                entry = entry[np.lexsort((entry["size"], entry["slot"]))]
                entry, _, (a, b) = _thinned(entry, _groups(entry["slot"]), SHARERS)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                parts, held = [entry], len(entry)
                limit = max(HELD, 2 * held)
    if parts:
        yield from links(parts)


def _banded(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (cluster, entity, n, ...) with band and block, and (cluster, band, blocks).

    A cluster that one block holds has band 0 alone.  Else bands of size are so wide
    that partners are in one band or the next, and are cut into blocks.
    """
    size = members.groupBy("cluster").agg(F.count("*").alias("count"), F.sum("n").alias("items"))
    size = size.where((F.col("count") > BLOCK) | (F.col("items") > BLOCK_ITEMS)).select("cluster", F.lit(1).alias("large"))
    band = F.floor(F.log("n") / float(np.log(DEN / NUM) * 1.0001)).cast("int")
    banded = members.join(size, "cluster", "left").withColumn("band", F.when(F.col("large").isNull(), F.lit(0)).otherwise(band))
    banded = saved(banded, "banded")
    most = F.when(F.max("large").isNull(), F.lit(1)).otherwise(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)))
    blocks = saved(banded.groupBy("cluster", "band").agg(most.cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int")
    return banded, saved(banded.join(blocks, ["cluster", "band"]).withColumn("block", own), "blocked")


def _every(c: str) -> F.Column:
    n = F.coalesce(F.col(c), F.lit(0))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _tile(band, kind: str, i, j, side) -> F.Column:
    return F.struct(band.cast("int").alias("band"), F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))


TILE = ["cluster", "t.band", "t.kind", "t.i", "t.j", "t.side"]


def _near_blocks(placed: DataFrame) -> DataFrame:
    """Adds the numbers of blocks in the bands below and above as lower and upper."""
    blocks = placed.groupBy("cluster", "band").agg(F.first("blocks").alias("blocks"))
    near = lambda step, name: blocks.select("cluster", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))
    return placed.join(near(1, "lower"), ["cluster", "band"], "left").join(near(-1, "upper"), ["cluster", "band"], "left")


def _all_tiles(placed: DataFrame) -> DataFrame:
    """Members with each tile they are in: a block (side 0), two blocks of a band, and a
    block with one of the band below (side 1)."""
    p, band = F.col("block"), F.col("band")
    tiles = F.concat(
        F.transform(_every("blocks"), lambda j: F.when(p == j, _tile(band, "alone", p, p, F.lit(0))).otherwise(_tile(band, "band", F.least(p, j), F.greatest(p, j), p > j))),
        F.transform(_every("lower"), lambda j: _tile(band, "step", p, j, F.lit(0))),
        F.transform(_every("upper"), lambda i: _tile(band + 1, "step", i, p, F.lit(1))),
    )
    return _near_blocks(placed).withColumn("t", F.explode(tiles)).select(*TILE, "entity", "copies", "fetch", "fetch_hash")


def _loose_tiles(loose: DataFrame, placed: DataFrame) -> DataFrame:
    """Blocks of the loose members with every block of the cluster they may link into:
    side 0 has the loose ones, side 1 all.  Its pairs may be of two loose members."""
    counts = loose.groupBy("cluster", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int").alias("loose_blocks"))
    loose = _near_blocks(loose.join(counts, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("entity"), F.col("loose_blocks")).cast("int")))
    p, band = F.col("block"), F.col("band")
    left = F.concat(
        F.transform(_every("blocks"), lambda j: _tile(band, "same", p, j, F.lit(0))),
        F.transform(_every("lower"), lambda j: _tile(band, "down", p, j, F.lit(0))),
        F.transform(_every("upper"), lambda j: _tile(band, "up", p, j, F.lit(0))),
    )
    near = lambda step, name: counts.select("cluster", (F.col("band") + step).alias("band"), F.col("loose_blocks").alias(name))
    right = placed.join(near(0, "here"), ["cluster", "band"], "left").join(near(-1, "above"), ["cluster", "band"], "left").join(near(1, "below"), ["cluster", "band"], "left")
    sides = F.concat(
        F.transform(_every("here"), lambda i: _tile(band, "same", i, p, F.lit(1))),
        F.transform(_every("above"), lambda i: _tile(band + 1, "down", i, p, F.lit(1))),
        F.transform(_every("below"), lambda i: _tile(band - 1, "up", i, p, F.lit(1))),
    )
    keep = ["entity", "copies", "fetch", "fetch_hash"]
    return loose.withColumn("t", F.explode(left)).select(*TILE, *keep).unionByName(right.withColumn("t", F.explode(sides)).select(*TILE, *keep))


def tile_links(sets: list[np.ndarray], side: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i < j) of the sets of a tile, which are sorted by length: all of them
    if the tile is one block, else those of different sides."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cut = np.concatenate(([0], np.cumsum(n)))
    bits = MIN_BITS
    while bits < min(MAX_BITS, SIGNATURE * n[-1]):
        bits *= 2
    signs = np.stack([signature(s, bits) for s in sets])
    last = np.searchsorted(n, n * DEN // NUM, "right")
    mark = np.zeros(flat.max() + 1, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(sets) - 1):
        lo, hi = i + 1, int(last[i])
        if hi <= lo:
            continue
        ok = may_link(n[i], signs[i], n[lo:hi], signs[lo:hi])
        if not alone:
            ok &= side[lo:hi] != side[i]
        j = lo + np.flatnonzero(ok)
        if not len(j):
            continue
        mark[flat[cut[i] : cut[i + 1]]] = 1
        if 4 * len(j) > hi - lo:
            both = np.add.reduceat(mark[flat[cut[lo] : cut[hi]]], cut[lo:hi] - cut[lo])[j - lo]
        else:
            count = n[j]
            at = np.arange(count.sum()) + np.repeat(cut[j] - np.cumsum(count) + count, count)
            both = np.add.reduceat(mark[flat[at]], np.cumsum(count) - count)
        mark[flat[cut[i] : cut[i + 1]]] = 0
        j = j[(DEN + NUM) * both >= NUM * (n[i] + n[j])]
        if len(j):
            found.append((np.full(len(j), i), j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = zip(*found, strict=True)
    return np.concatenate(i), np.concatenate(j)


def _compared(k: int):
    """(entity, root, near): by tile the entities that link, with the smallest entity that
    links lead to inside the tile, and how many rows of other sets they link with.
    Rows (tile, side, entity, copies, text) come sorted by tile."""

    def result(tile, rows):
        """Rows by entity: an entity comes twice where its text does, or on both sides."""
        one = {(r[0], r[1]): r for r in rows}
        rows = sorted(one.values(), key=lambda r: (len(r[3]), r[0], r[1]))
        side = np.array([r[0] for r in rows])
        alone = tile[2] == "alone"
        if len(rows) < 2 or not alone and side.min() == side.max():
            return None
        i, j = tile_links([r[3] for r in rows], side, alone)
        names, copies = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        differ = names[i] != names[j]
        i, j = i[differ], j[differ]
        if not len(i):
            return None
        near = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        roots = dict(zip(*(x.tolist() for x in _forest(names[i], names[j])[::-1]), strict=True))
        at = np.flatnonzero(near)
        who = names[at].tolist()
        cols = [pa.array(who, pa.int64()), pa.array([roots.get(e, e) for e in who], pa.int64()), pa.array(near[at].astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["entity", "root", "near"])

    @lean
    def run(batches):
        at, rows = None, []
        for batch in batches:
            width = batch.num_columns
            for part in slices(batch, width - 1):
                sets = shingle_sets(bytes_of(part.column(width - 1)), k)
                for *tile, side, entity, copies, s in zip(*(c.to_pylist() for c in part.columns[:-1]), sets, strict=True):
                    if tile != at:
                        if rows and (out := result(at, rows)) is not None:
                            yield out
                        at, rows = tile, []
                    if entity_of(s) == entity:
                        rows.append((side, entity, copies, s))
        if rows and (out := result(at, rows)) is not None:
            yield out

    return run


def _links(tiles: DataFrame, texts: DataFrame, k: int, tag: str) -> DataFrame:
    """(entity, root, near) of the tiles; the texts are read again for their members alone."""
    wanted = IdFilter(tiles, "fetch")
    some = texts.where(wanted.holds("did")).dropDuplicates(["did", "th"]).withColumnsRenamed({"did": "fetch", "th": "fetch_hash"})
    rows = tiles.join(some, ["fetch", "fetch_hash"])
    tile = ["cluster", "band", "kind", "i", "j"]
    rows = rows.select(*tile, "side", "entity", "copies", "text").repartition(*tile).sortWithinPartitions(*tile)
    return saved(rows.mapInArrow(_compared(k), "entity long, root long, near long"), tag)


def _united(links: DataFrame) -> DataFrame:
    return components(links.select("entity", "root"), "entity", "root").select(F.col("node").alias("entity"), F.col("component").alias("label"))


def _classes(docs: DataFrame, k: int, count: bool) -> tuple[DataFrame, DataFrame]:
    """The documents (did, th, n, entity), and (entity, component_id, keep, keep_hash,
    n_links): n_links is null unless ``count``, and (keep, keep_hash) is the first
    document of the component, null ids last."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    letters = texts.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    buckets = max(BUCKETS, int(letters / 6 * REGION) // BUCKET_KEYS)
    by_bucket = lambda d: d.repartition("bucket").sortWithinPartitions("bucket")
    regions = by_bucket(texts.select("text").mapInArrow(_region(buckets, k), "bucket int, data binary"))
    hot = saved(regions.mapInArrow(_counted, "bucket int, slot long, n long"), "hot")
    shared = docs.sparkSession.sparkContext.broadcast(_hot_bitmap(hot))
    forget(hot)

    described = "did long, th long, n long, entity long, bucket int, data binary, a array<long>, b array<long>"
    both = saved(texts.mapInArrow(_describe(buckets, k, shared), described), "described")
    rows = saved(both.where("did is not null").select("did", "th", "n", "entity"), "rows")
    first = F.min(F.struct((F.col("did") == NO_ID).alias("last"), F.col("did"), F.col("th")))
    entities = rows.where("entity is not null").groupBy("entity").agg(F.any_value("n").alias("n"), first.alias("first"), F.count("*").alias("copies"))
    entities = saved(entities.select("entity", "n", "copies", F.col("first.did").alias("fetch"), F.col("first.th").alias("fetch_hash")), "entities")
    united = both.where("a is not null").select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b")
    shared_links = by_bucket(both.where("bucket is not null").select("bucket", "data")).mapInArrow(_clustered, "a long, b long")
    links = saved(shared_links.unionByName(united).distinct(), "cluster-links")
    forget(both)

    clusters = components(links).select(F.col("node").alias("entity"), F.col("component").alias("cluster"))
    members = saved(clusters.join(entities, "entity").select("cluster", "entity", "n", "copies", "fetch", "fetch_hash"), "members")
    forget(links)
    banded, placed = _banded(members)
    tiles = saved(_all_tiles(placed) if count else placed.select("cluster", "band", F.lit("alone").alias("kind"), F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "entity", "copies", "fetch", "fetch_hash"), "tiles")
    found = _links(tiles, texts, k, "links")
    forget(tiles, members)
    if not count:
        cut = placed.groupBy("cluster").agg(F.max("large").alias("large")).where("large = 1").select("cluster")
        if not cut.isEmpty():
            some = placed.join(cut, "cluster", "left_semi")
            labelled = saved(some.join(_united(found), "entity", "left").withColumn("label", F.coalesce("label", "entity")), "labelled")
            size = labelled.groupBy("cluster", "label").agg(F.count("*").alias("size"))
            main = size.groupBy("cluster").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
            loose = labelled.join(main, "cluster").where("label <> main").select(*placed.columns)
            more = saved(_loose_tiles(loose, some), "loose-tiles")
            found = found.unionByName(_links(more, texts, k, "more-links"))
            forget(labelled, more)
    final = saved(_united(found), "final")
    known = entities
    if count:
        known = known.join(found.groupBy("entity").agg(F.sum("near").alias("near")), "entity", "left")
        n_links = F.col("copies") - 1 + F.coalesce("near", F.lit(0))
    else:
        n_links = F.lit(None).cast("long")
    known = known.withColumn("n_links", n_links).join(final, "entity", "left").withColumn("component", F.coalesce("label", "entity"))
    least = known.groupBy("component").agg(F.min(F.struct((F.col("fetch") == NO_ID).alias("last"), F.col("fetch"), F.col("fetch_hash"))).alias("keep"))
    classes = known.join(least, "component").select(
        "entity", F.when(F.col("keep.fetch") != NO_ID, F.col("keep.fetch")).alias("component_id"), F.col("keep.fetch").alias("keep"), F.col("keep.fetch_hash").alias("keep_hash"), "n_links"
    )
    classes = saved(classes, "classes")
    forget(banded, placed, entities, final)
    return rows, classes


def join_components(docs: DataFrame, k: int = SHINGLE_WORDS, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id, set_id) per row of ``docs`` (doc_id, text).

    n_links is the number of other rows whose sets link with the row's, copies
    included; without ``count`` it is left out, for those who need components only.
    component_id is the smallest doc_id of the documents that links lead to, itself
    included.  set_id is equal for equal sets (null for empty ones).

    A null or empty text, and one without words, has no shingle, is linked with nothing
    and is its own component.  Rows that repeat, and rows with one doc_id, are linked as
    any others are.  A null doc_id is never the smallest, so a component of such rows
    only has a null component_id.  Texts may be of any length; other columns aren't
    read; no rows give no rows.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        rows, classes = _classes(docs, k, count)
    # rows without words aren't joined: they would all have one key
    out = rows.where("entity is not null").join(classes, "entity").select("did", "n", "entity", "component_id", "n_links")
    none = rows.where("entity is null").select("did", "n", "entity", F.when(F.col("did") != NO_ID, F.col("did")).alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = out.unionByName(none)
    return out.select(
        F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        *[F.col("n_links")] * count,
        "component_id",
        F.col("entity").alias("set_id"),
    )


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and others) with one row of each component.

    The smallest doc_id stays, a null id only where a component has no other; of rows
    with that id, the one of the smallest text hash, and of rows equal in both, any
    one.  Documents without words all stay.  Only texts that may go are shuffled.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        rows, classes = _classes(docs, k, False)
    decided = rows.where("entity is not null").join(classes, "entity").groupBy("did", "th").agg(
        F.any_value((F.col("did") == F.col("keep")) & (F.col("th") == F.col("keep_hash"))).alias("stays"), F.count("*").alias("copies")
    )
    names = docs.columns
    d, t, stays = fresh(names, "did", "th", "stays")
    marked = saved(decided.where("not stays or copies > 1").select(F.col("did").alias(d), F.col("th").alias(t), F.col("stays").alias(stays)), "marked")
    unsure = IdFilter(marked, d)
    did, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce("text", F.lit("")))
    some = docs.where(unsure.holds(did)).withColumns({d: did, t: th}).join(marked, [d, t], "left")
    return (
        docs.where(~unsure.holds(did))
        .unionByName(some.where(F.col(stays).isNull()).select(*names))
        .unionByName(some.where(F.col(stays)).dropDuplicates([d, t]).select(*names))
    )
