"""Document fingerprints as invertible Bloom lookup tables (operator 5).

A text's paragraphs (lines, and the sentences in them) have 64-bit digests; each
goes into three cells of a table, one in each third, as a count, an XOR of
digests and an XOR of check values.  Subtracting two tables leaves the digests
that only one of the texts has; peeling pure cells recovers them.  If that gets
stuck both tables are built again four times as large.  The likeness of two
fingerprints is the Jaccard index of the two digest sets.

Tables of many documents lie behind one another in flat arrays and are peeled
together, so a batch costs a few array operations a round.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the fingerprint that is returned and compared first; then four times as many, and so on.
CELLS, GROWTH = 24, 4
#: Documents stand in ranges of about this many by doc_id, at most MAX_RANGES ranges.
DOCS_PER_RANGE, MAX_RANGES = 2000, 50_000
#: A batch of documents is compared when it has so many characters.
CHUNK_CHARS = 1 << 20
_PARAGRAPH = re.compile(r"(?<=[.!?])[ \t]+|[\r\n]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(text: str) -> list[int]:
    """Digests of a text's paragraphs; the n-th copy of one has a digest of its own."""
    found = [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in _PARAGRAPH.split(text) if p]
    if len(set(found)) == len(found):
        return found
    return [xxhash.xxh3_64_intdigest(b"%d:%d" % (n, d)) if n else d for d, c in Counter(found).items() for n in range(c)]


class Tables:
    """A table of ``cells`` cells for each of n documents."""

    def __init__(self, n: int, cells: int) -> None:
        self.n, self.cells, self.third = n, cells, cells // 3
        self.count = np.zeros(n * cells, np.int64)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def places(self, keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
        seed = np.uint64((self.cells * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h = [_mix(keys ^ seed ^ np.uint64((i * 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(self.third) for i in (1, 2, 3)]
        return np.stack([doc * self.cells + i * self.third + x.astype(np.int64) for i, x in enumerate(h)])

    @staticmethod
    def checks(keys: np.ndarray) -> np.ndarray:
        return _mix(keys ^ np.uint64(0xD6E8FEB86659FD93))

    def add(self, keys: np.ndarray, doc: np.ndarray, sign) -> None:
        at, check = self.places(keys, doc), self.checks(keys)
        for row in at:
            np.add.at(self.count, row, sign)
            np.bitwise_xor.at(self.key, row, keys)
            np.bitwise_xor.at(self.check, row, check)

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(recovered with +1, with -1, whether a table came out empty), by document."""
        more, less = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            pure = look[(np.abs(self.count[look]) == 1) & (self.checks(self.key[look]) == self.check[look])]
            if not len(pure):
                break
            doc = pure // self.cells
            order = np.lexsort((self.key[pure], doc))
            pure, doc = pure[order], doc[order]
            new = np.append(True, (doc[1:] != doc[:-1]) | (self.key[pure[1:]] != self.key[pure[:-1]]))
            pure, doc = pure[new], doc[new]
            keys, sign = self.key[pure].copy(), self.count[pure].copy()
            more += np.bincount(doc[sign > 0], minlength=self.n)
            less += np.bincount(doc[sign < 0], minlength=self.n)
            at = np.unique(self.places(keys, doc))
            self.add(keys, doc, -sign)
            look = at[np.abs(self.count[at]) == 1]
        full = (self.count != 0) | (self.key != 0)
        return more, less, ~full.reshape(self.n, self.cells).any(axis=1)

    def text(self) -> list[str]:
        parts = [self.count.astype("<i4"), self.key.astype("<u8"), self.check.astype("<u4")]
        rows = [p.reshape(self.n, self.cells) for p in parts]
        return [base64.b64encode(b"".join(r[i].tobytes() for r in rows)).decode() for i in range(self.n)]


def _flat(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(s) for s in sets]
    keys = np.fromiter((k for s in sets for k in s), np.uint64, sum(sizes))
    return keys, np.repeat(np.arange(len(sets)), sizes)


def _build(sets: list[list[int]], cells: int) -> Tables:
    t = Tables(len(sets), cells)
    t.add(*_flat(sets), 1)
    return t


def fingerprints(sets: list[list[int]]) -> list[str]:
    return _build(sets, CELLS).text() if sets else []


def likeness(a: list[list[int]], b: list[list[int]]) -> list[float]:
    """Of the fingerprints of a[i] and b[i]; 1 for two texts without paragraphs."""
    out, todo, cells = [0.0] * len(a), list(range(len(a))), CELLS
    while todo:
        left, right = [a[i] for i in todo], [b[i] for i in todo]
        if cells > 64 * (max(len(x) + len(y) for x, y in zip(left, right, strict=True)) + CELLS):
            # only two digests that share all cells at every size get here
            sets = [(set(x), set(y)) for x, y in zip(left, right, strict=True)]
            more, less, ok = [len(x - y) for x, y in sets], [len(y - x) for x, y in sets], [True] * len(todo)
        else:
            more, less, ok = _build(left, cells).minus(_build(right, cells)).peel()
        for i, m, n, done in zip(todo, more, less, ok, strict=True):
            if done:
                both = len(a[i]) - int(m)
                all_of = both + int(m) + int(n)
                out[i] = both / all_of if all_of else 1.0
        todo = [i for i, done in zip(todo, ok, strict=True) if not done]
        cells *= GROWTH
    return out


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text), the fingerprints of its text and of its
    edited text (see FIELDS): the last half of the text replaced by the head of
    the next document in descending doc_id, after the last one by the first's.

    Null text is empty; a null doc_id counts as the smallest, and rows that agree
    in doc_id stand in order of the SHA-256 of their text.  A single document is
    its own next one; an empty table gives no rows.

    Rows are dealt once, into ranges of doc_id whose bounds are ids that exist; rows
    without doc_id, of which there may be many, into ranges of their texts' SHA-256.
    The first row of a range is thereby known before the shuffle and is sent to
    the range before as well, so each range is read once, in order, row by row.
    """
    named = F.col("doc_id").isNotNull()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_sha", F.when(~named, F.sha2("text", 256)))
    with_id = rows.where(named)
    n, top, nameless = rows.agg(F.count("doc_id"), F.max("doc_id"), F.count(F.when(~named, 1))).first()
    if not n + nameless:
        return docs.sparkSession.createDataFrame([], FIELDS)
    k = int(min(MAX_RANGES, max(1, n // DOCS_PER_RANGE)))
    cuts = with_id.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k).alias("c")).first()["c"] if k > 1 else []
    about = np.unique(np.array([int(x) for x in cuts], np.int64))

    @F.pandas_udf("int")
    def between(ids):
        return ids.__class__(np.searchsorted(about, ids.to_numpy(np.int64)).astype(np.int32))

    # percentiles of large ids aren't exact: the largest id there is up to each of them is
    tops = with_id.groupBy(between("doc_id")).agg(F.max("doc_id").alias("t")).collect() if len(about) else []
    firsts = np.array(sorted({int(x) for x in [top, *(r["t"] for r in tops)] if x is not None}, reverse=True), np.int64)  # the first id of each range, in order
    down = ~firsts  # ascending; unlike a negative it exists for every number
    # as many leading digits of the hash as there are ranges to make, four at most
    digits = min(4, max(0, int(np.ceil(np.log2(max(1, nameless / DOCS_PER_RANGE)) / 4))))
    least = sorted(r["s"] for r in rows.where(~named).groupBy(F.substring("_sha", 1, digits)).agg(F.min("_sha").alias("s")).collect()) if nameless else []
    count = len(firsts) + len(least)

    @F.pandas_udf("array<int>")
    def ranges(ids, hashes):
        """The range of a row and, for a range's first one, the range before."""
        import pandas as pd

        out = []
        known = hashes.isna().to_numpy()
        own = np.searchsorted(down, ~ids.to_numpy(np.int64), "right") - 1 if len(down) else np.zeros(len(ids), np.int64)
        for i, h, has, at in zip(ids, hashes, known, own, strict=True):
            if has:
                first = int(firsts[at]) == int(i)
            else:
                at = bisect_right(least, h) - 1
                first = least[at] == h
                at += len(firsts)
            out.append([int(at)] + [int(at - 1) % count] * first)
        return pd.Series(out)

    dealt = rows.select("doc_id", "text", "_sha", F.posexplode(ranges(F.coalesce("doc_id", F.lit(0)), F.col("_sha"))).alias("_extra", "_range"))
    # in each range: its own rows in order, then the next range's first row
    ordered = dealt.repartitionById(count, "_range").sortWithinPartitions("_range", "_extra", F.col("doc_id").desc_nulls_last(), F.coalesce("_sha", F.sha2("text", 256)))

    def compare(batches):
        pending: list[tuple[int | None, str, str]] = []
        size, last = 0, None  # last: (range, doc_id, text) still without its next document

        def flush():
            ids, texts, nexts = (list(x) for x in zip(*pending, strict=True))
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nexts, strict=True)]
            own, new, after = ([digests(t) for t in x] for x in (texts, edited, nexts))
            cols = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]]
            cols += [fingerprints(own), fingerprints(new), likeness(own, new), likeness(own, after)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            pending.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [f.split()[0] for f in FIELDS.split(", ")])

        for batch in batches:
            for doc_id, text, extra, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and last[0] == at:
                    pending.append((last[1], last[2], text))
                    size += len(last[2]) * 2 + len(text)
                    if size > CHUNK_CHARS:
                        yield flush()
                        size = 0
                # of the next range's first rows only the first counts
                last = None if extra else (at, doc_id, text)
        if pending:
            yield flush()

    return ordered.select("doc_id", "text", "_extra", "_range").mapInArrow(compare, FIELDS)
