"""Removal of repeated byte strings with enhanced suffix arrays (operator 1).

Every string of MIN_LENGTH bytes has one anchor, the k-gram of the smallest hash
in it, so equal strings have equal anchors in the same place.  Runs of windows
with one anchor are cut out as stretches.  A stretch whose anchor occurs nowhere
else repeats nothing; equal stretches repeat each other wholly.  What is left are
anchors with differing stretches: their suffixes from the anchor on are sorted
into a sparse suffix array with common-prefix lengths; a stack scan yields the
interval tree, and inside each interval the texts before the anchor are scanned
the same way, which tests left extensions and gives every maximal repeat with all
its occurrences.

An anchor of very many stretches is split by content, not by row: its windows are
divided into blocks by their place relative to the anchor, keyed by the bytes that
all windows of a block share.  Blocks get smaller until groups are bounded; a
block of one window needs a count only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm import shingles
from thalweg.llm.common import IdFilter, arrow_rows, bytes_of, forget, saved, slices
from thalweg.llm.shingles import _VALUE, chunks, mix, powers

MIN_LENGTH = 400
#: Bytes of an anchor.
GRAM = 32
#: Stretches of an anchor that one array holds; beyond it, windows per block by level.
GROUP, BLOCKS = 128, (64, 16, 4, 1)
#: Groups, and texts, that Python gets at a time.
GROUPS_AT_ONCE, TEXTS_AT_ONCE = 64, 1000
NO_ID = -(1 << 63)


def stretches(texts: list[bytes], length: int = MIN_LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, first window, number of windows, place of the anchor from the first
    window on, hash of the anchor) of every run of windows with one anchor."""
    gram = min(gram, length)
    step = max(shingles.CHUNK_BYTES, length)
    for lo, hi in chunks(texts):
        if hi - lo > 1 or len(texts[lo]) <= step:
            yield from _runs(texts[lo:hi], lo, 0, length, gram)
            continue
        # a long text by slices that share no window; a run that is cut is two runs, whose
        # bytes have less than a window in common
        for at in range(0, len(texts[lo]) - length + 1, step):
            yield from _runs([texts[lo][at : at + step + length - 1]], lo, at, length, gram)


def _runs(part: list[bytes], lo: int, at: int, length: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``stretches`` of texts numbered from ``lo``, whose first byte has the number ``at``."""
    w = length - gram + 1
    if part:
        ends = np.cumsum([len(t) for t in part])
        raw = np.frombuffer(b"".join(part), np.uint8)
        n = len(raw)
        if n < length:
            return
        up, down = powers(n + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * up[:-1], dtype=np.uint64)))
        h = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        # the smallest upper half of a hash, then the leftmost place
        v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(v) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(v)] = v
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - length + 1
        least = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows inside one text
        start = np.arange(count)
        text = np.searchsorted(ends, start, "right")
        inside = start + length <= ends[text]
        change = np.ones(count, bool)
        change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change)
        size = np.diff(np.append(first, count))
        keep = inside[first]
        first, size = first[keep], size[keep]
        of = text[first]
        base = np.concatenate(([0], ends))[of]
        for row in zip((lo + of).tolist(), (first - base + at).tolist(), size.tolist(), (least[first] - first).tolist(), h[least[first]].view(np.int64).tolist(), strict=True):
            yield row


def _digest(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:  # the first lo bytes agree, not all of hi
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common length, first, last) of every interval of a sorted array, given the
    common lengths of neighbours: a scan with a stack of open intervals."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp, -1], 1):
        left = i - 1
        while stack and stack[-1][0] > v:
            length, left = stack.pop()
            yield length, left, i - 1
        if v >= 0 and (not stack or stack[-1][0] < v):
            stack.append((v, left))


def maximal_repeats(members: list[tuple[bytes, int]], length: int = MIN_LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of the maximal repeats of
    at least ``length`` bytes around the anchors of (stretch, place of the anchor)."""
    right = [s[at:] for s, at in members]
    left = [s[:at][::-1] for s, at in members]
    order = sorted(range(len(members)), key=right.__getitem__)
    deepest = max(map(len, left))
    for r, lo, hi in intervals([common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]):
        if r + deepest < length:
            continue
        inner = sorted(order[lo : hi + 1], key=left.__getitem__)
        for x, i, j in intervals([common(left[a], left[b]) for a, b in zip(inner, inner[1:], strict=False)]):
            if x + r >= length:
                yield x, r, inner[i : j + 1]


def _found(batches):
    """Spans of the repeats in groups of stretches."""
    for batch in batches:
        out: list[tuple] = []
        length = batch.column(1)[0].as_py() if batch.num_rows else 0
        for i in range(batch.num_rows):
            group = batch.column(0)[i].as_py()
            reach: dict[int, list[tuple[int, int]]] = {}
            for x, r, who in maximal_repeats([(m["data"], m["at"]) for m in group], length):
                for k in who:
                    spans = reach.setdefault(k, [])
                    if not any(a >= x and b >= r for a, b in spans):
                        spans.append((x, r))
            for k, spans in reach.items():
                m = group[k]
                if m["copies"] == 1:
                    out += [(m["did"], m["th"], m["start"] + m["at"] - x, m["start"] + m["at"] + r) for x, r in spans]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["did", "th", "a", "b"])


SPAN = "did long, th long, a long, b long"
MEMBER = "key long, content long, did long, th long, start long, at int, n int, data binary"


def _differing(classes: DataFrame) -> DataFrame:
    """(key, k) of anchors with k > 1 contents, of which some occur once."""
    return classes.groupBy("key").agg(F.count("*").alias("k"), F.min("copies").alias("least")).where("k > 1 and least = 1").select("key", "k")


def _blocks(width: int, length: int):
    """Divides stretches into blocks of windows: those whose distance to the anchor
    has one quotient by ``width``.  The key is the bytes they share."""

    def run(batches):
        for batch in batches:
            out = []
            for key, did, th, start, at, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # window j (0 <= j < n) begins at - j before the anchor
                for q in range((at - n + 1) // width, at // width + 1):
                    near, far = max(q * width, at - n + 1), min(q * width + width - 1, at)
                    cut = data[at - far : at - near + length]
                    # the windows of any stretch in this block share these bytes, if it has all of the block
                    core = data[at - q * width : at - (q * width + width - 1) + length] if q * width <= at else b""
                    out.append((_digest(b"%d %d " % (key, q) + core), _digest(b"%d %d %d " % (key, far, near) + cut), did, th, start + at - far, far, far - near + 1, cut))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in MEMBER.split(", ")])

    return run


def repeated_spans(docs: DataFrame, length: int = MIN_LENGTH) -> DataFrame:
    """Spans (did, th, a, b) of bytes covered by strings of ``length`` bytes that
    start somewhere else as well; ``docs`` has did, th and text, where (did, th)
    is the same for equal rows only.  Spans overlap and may repeat."""

    def cut(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            texts = bytes_of(batch.column(2))
            did, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i, start, n, at, anchor in stretches(texts, length):
                out.append((anchor, _digest(b"%d %d " % (at, n) + texts[i][start : start + n - 1 + length]), did[i], th[i], start, at, n))
                if len(out) >= 100_000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(out):
        types = [pa.int64()] * 5 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in MEMBER.split(", ")[:7]])

    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        rows = saved(docs.select("did", "th", "text").mapInArrow(cut, MEMBER.rpartition(",")[0]), "stretches")
    where = F.struct("did", "th", "start", "at", "n")
    # of most stretches the anchor occurs once: they go before anything else is done with them;
    # joins by anchor have a written table on either side, so that they can be split where one is frequent
    keys = saved(rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "keys")
    classes = saved(rows.join(keys, "key", "left_semi").groupBy("key", "content").agg(F.count("*").alias("copies"), F.min(where).alias("w")), "classes")
    forget(keys)
    whole = rows.join(classes.where("copies > 1").select("key", "content"), ["key", "content"], "left_semi")
    spans = saved(whole.select("did", "th", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b")), "whole-spans")
    forget(rows)

    mixed = saved(_differing(classes), "differing")
    part = saved(classes.join(mixed, "key").select("key", "content", "copies", "w.*", "k"), "mixed")
    wanted = IdFilter(part, "did")
    places = part.groupBy("did", "th").agg(F.collect_list(F.struct("key", "content", "copies", "start", "at", "n", "k")).alias("places"))
    held = docs.where(wanted.holds("did")).dropDuplicates(["did", "th"]).join(places, ["did", "th"])

    def fetch(batches):
        names = ["key", "content", "copies", "did", "th", "start", "at", "n", "k", "data"]
        types = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                did, th, text, places = (batch.column(c)[i].as_py() for c in range(4))
                raw = text.encode("utf-8", "surrogatepass")
                out = [(p["key"], p["content"], p["copies"], did, th, p["start"], p["at"], p["n"], p["k"], raw[p["start"] : p["start"] + p["n"] - 1 + length]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    fetched = "key long, content long, copies long, did long, th long, start long, at int, n int, k long, data binary"
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        now = saved(held.select("did", "th", "text", "places").mapInArrow(fetch, fetched), "fetched")
    forget(part, classes)
    member = F.struct("did", "th", "start", "at", "copies", "data")
    for width in (*BLOCKS, 0):
        groups = now.where(F.col("k") <= GROUP).groupBy("key").agg(F.collect_list(member).alias("group"))
        with arrow_rows(docs.sparkSession, GROUPS_AT_ONCE):
            spans = spans.unionByName(saved(groups.select("group", F.lit(length)).mapInArrow(_found, SPAN), "spans"))
        if not width:
            break
        large = now.where(F.col("k") > GROUP)
        if large.isEmpty():
            break
        # classes of blocks: equal blocks repeat each other; a single one may still share windows
        blocks = saved(large.where("copies = 1").select("key", "did", "th", "start", "at", "n", "data").mapInArrow(_blocks(width, length), MEMBER).withColumn("own", F.lit(1)).unionByName(
            large.where("copies > 1").select("key", "did", "th", "start", "at", "n", "data").mapInArrow(_blocks(width, length), MEMBER).withColumn("own", F.lit(2))
        ), "blocks")
        classes = saved(blocks.groupBy("key", "content").agg(F.sum("own").alias("copies"), F.min(where).alias("w")), "block-classes")
        same = blocks.where("own = 1").join(classes.where("copies > 1").select("key", "content"), ["key", "content"], "left_semi")
        spans = spans.unionByName(same.select("did", "th", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b")))
        mixed = saved(_differing(classes), "differing")
        part = classes.join(mixed, "key").select("key", "content", "copies", "w.*", "k")
        data = blocks.select("key", "content", "did", "th", "start", "at", "n", "data").dropDuplicates(["key", "content"]).select("key", "content", "data")
        now = saved(part.join(data, ["key", "content"]), "refined")
    return spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = MIN_LENGTH, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``
    (doc_id, text), and with ``with_kept`` the remaining bytes as kept.

    Texts are UTF-8 bytes, null is empty; the rest of a text isn't scanned again.
    Equal rows repeat each other; a null doc_id is a document as any other.  Texts
    may be of any length and are read in slices; those under ``length`` bytes stay as
    they are.  Other columns aren't read; no rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = repeated_spans(named, length).distinct()
    per_text = saved(found.groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans-by-text")
    changed = IdFilter(per_text, "did")
    raw = F.encode("text", "UTF-8")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def remove(batches):
        names = [f.split()[0] for f in fields.split(", ")]
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                spans = _merged([(s["a"], s["b"]) for s in batch.column(2)[i].as_py() or []])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((batch.column(0)[i].as_py(), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
                size += len(raw)
                if size > 1 << 24 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0

    touched = named.where(changed.holds("did")).join(per_text, ["did", "th"], "left").select(F.col("doc_id").cast("long"), "text", "spans")
    rest = named.where(~changed.holds("did")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(raw).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"),
        (raw if with_kept else F.lit(None).cast("binary")).alias("kept"),
    )
    out = rest.unionByName(touched.mapInArrow(remove, fields))
    return out if with_kept else out.drop("kept")
