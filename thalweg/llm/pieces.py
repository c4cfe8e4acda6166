"""SentencePiece encoding and decoding by a max-plus scan (operator 6).

A vocabulary of the merging kind encodes a text by joining, again and again, the
neighbours whose union is the best piece.  Its result is also a path in the
lattice of pieces: the one path on which every two pieces in a row stand as they
are when the two are encoded by themselves.  (A merge across their border would
happen in the whole text if and only if it happens there.)  So an edge of the
lattice weighs 0 after a piece that it may follow and minus infinity otherwise,
and the encoding is the best path; every prefix of a text has exactly one.

A giant document is cut into chunks at nominal places, in words or anywhere.  A
state at a border is a piece that may reach over it or end there.  Each chunk
yields the matrix of best weights from every state at its start to every state at
its end; the matrices combine associatively in (max, +).  With the states known
that the text leads to, each chunk is traced back by itself, once for each exit,
and the exits that belong together are picked from the end.

No piece spans the start of a run of spaces, so between the first and the last
one in a chunk all paths are one, and its segments are encoded once and remembered.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import extended, fresh, lean, limit_arrow_rows, saved

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: How vocabularies write a space.
MARK = "▁"
#: Characters of a chunk, and the length above which a document is cut into chunks.
CHUNK_CHARS, GIANT_CHARS = 1 << 14, 1 << 15
#: Segments that a worker remembers before the older half goes, and the longest that it
#: remembers; longer ones go through the lattice.
MEMORY, LONGEST = 150_000, 64
#: Pairs of pieces that a worker remembers.
PAIRS = 1 << 19
#: Texts are encoded together until they have so many characters, and taken from Arrow so many at a time.
BATCH_CHARS, BATCH_ROWS = 1 << 18, 1000
#: No merge; more than any rank.
NEVER = 1 << 30


@dataclass
class Pieces:
    """A vocabulary: pieces by id, their scores, which of them match text, and the
    ids of the 256 byte pieces."""

    names: list[str]
    scores: list[float]
    usable: list[bool]
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in ids]
        byte_of = {int(names[i][3:-1], 16): i for i in ids if sp.is_byte(i)}
        if len(byte_of) != 256:
            raise ValueError("the vocabulary has no byte pieces, so it can't encode every text")
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in ids]
        return cls(names, [sp.get_score(i) for i in ids], usable, [byte_of[b] for b in range(256)])


class Codec:
    """Encodes and decodes texts.

    Pieces are matched with plain spaces for their marks, so a mark that stands in
    a text matches nothing, is spelt in byte pieces and comes back as it was.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        usable = [i for i, u in enumerate(pieces.usable) if u]
        texts = {i: pieces.names[i].replace(MARK, " ") for i in usable}
        order = {v: k for k, v in enumerate(sorted({pieces.scores[i] for i in usable}, reverse=True))}
        self.id_of = {name: i for i, name in texts.items()}
        #: Which union comes first: 0 is the best score; equal scores have one rank.
        self.rank = {name: order[pieces.scores[i]] for i, name in texts.items()}
        self.heads = {name[:k] for name in self.id_of for k in range(1, len(name) + 1)}
        self.longest = max(map(len, self.id_of), default=1)
        # unless some piece has a space after another character, nothing spans the start of a run of spaces
        self.cuts = not any(" " in name.lstrip(" ") for name in self.id_of)
        self.split = re.compile(r" +[^ ]*|[^ ]+" if self.cuts else r"(?s).+").findall
        self.start = re.compile(r"(?<=[^ ]) " if self.cuts else r"(?!)")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was remembered before the memory was last full
        self.pairs: dict[tuple[str, str], bool] = {}
        # for merging many segments at once: symbols are pieces, and characters of pieces that aren't pieces
        n = len(pieces.names)
        loose = sorted({c for name in self.id_of for c in name} - self.id_of.keys())
        symbol = self.id_of | {c: n + 1 + k for k, c in enumerate(loose)}
        self.other = n  # any other character
        chars = sorted((ord(c), i) for c, i in symbol.items() if len(c) == 1)
        self.char_codes, self.char_symbols = np.array([c for c, _ in chars], np.int64), np.array([i for _, i in chars], np.int64)
        unions = sorted((symbol[name[:k]] << 32 | symbol[name[k:]], i) for name, i in self.id_of.items() for k in range(1, len(name)) if name[:k] in symbol and name[k:] in symbol)
        self.union_keys, self.unions = np.array([k for k, _ in unions], np.int64), np.array([i for _, i in unions], np.int64)
        self.rank_of = np.full(n, NEVER, np.int64)
        self.rank_of[list(texts)] = [self.rank[name] for name in texts.values()]
        byte_at = {i: bytes((b,)) for b, i in enumerate(pieces.byte_ids)}
        spelt = [byte_at.get(i) or name.replace(MARK, " ").encode() for i, name in enumerate(pieces.names)]
        self.sizes = np.array([len(x) for x in spelt])
        self.places = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(spelt), np.uint8)

    @classmethod
    def of(cls, pieces: Pieces) -> Codec:
        """The codec of a vocabulary, made once per worker."""
        if not hasattr(pieces, "_codec"):
            pieces._codec = cls(pieces)
        return pieces._codec

    # --- the lattice
    def may_follow(self, a: str, b: str) -> bool:
        """Whether two pieces (or characters) in a row are encoded as they are; after
        nothing, whether the second one by itself is."""
        got = self.pairs.get((a, b))
        if got is None:
            parts, rank = list(a + b), self.rank.get
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: rank(parts[k] + parts[k + 1], NEVER))
                if parts[best] + parts[best + 1] not in self.rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(self.pairs) >= PAIRS:
                self.pairs = {}
            got = self.pairs[a, b] = parts == ([a, b] if a else [b])
        return got

    def after(self, s: str, i: int, before: str):
        """Lengths of the pieces at a place that may follow a piece."""
        for j in range(i + 1, min(len(s), i + self.longest) + 1):
            t = s[i:j]
            if j > i + 1 and t not in self.heads:
                return
            if (j == i + 1 or t in self.id_of) and self.may_follow(before, t):
                yield j - i

    def walk(self, s: str, seeds: dict[int, int], until: int) -> list[int]:
        """For every place the length of the piece that ends there on the path to it, 0
        for none; ``seeds`` has such lengths.  Pieces begin before ``until``."""
        last = [0] * (len(s) + 1)
        for i, n in seeds.items():
            last[i] = n
        for i in range(min(seeds, default=until), until):
            if last[i] or i in seeds:
                for n in self.after(s, i, s[i - last[i] : i]):
                    last[i + n] = n
        return last

    def trace(self, s: str, last: list[int], end: int, seeds) -> tuple[int, list[int]]:
        """The seed that the path to ``end`` comes from, and the ids on the way."""
        out: list[int] = []
        while end not in seeds:
            t = s[end - last[end] : end]
            i = self.id_of.get(t)
            out += [i] if i is not None else [self.pieces.byte_ids[b] for b in reversed(t.encode("utf-8", "surrogatepass"))]
            end -= last[end]
        return end, out[::-1]

    def segment(self, seg: str) -> bytes:
        """The ids of a segment, packed as 32-bit numbers."""
        got = self.memo.get(seg)
        if got is None:
            if len(seg) <= LONGEST:
                self.learn([seg])
                return self.memo[seg]
            last = self.walk(seg, {0: 0}, len(seg))
            got = array("i", self.trace(seg, last, len(seg), {0})[1]).tobytes()
        return got

    # --- segments
    def forget(self) -> None:
        """At the end of a task, so that a worker that goes on to other work is small."""
        self.memo, self.older, self.pairs = {}, {}, {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unions of pairs of symbols (-1 if there is none) and their ranks."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.union_keys, key), len(self.union_keys) - 1)
        union = np.where(self.union_keys[at] == key, self.unions[at], -1) if len(self.unions) else np.full(len(key), -1)
        return union, np.where(union >= 0, self.rank_of[union], NEVER)

    def learn(self, segs: list[str]) -> None:
        """Put segments into the memory, all at once: in every round each segment has its
        best pair merged, the first one of equals."""
        segs = [s for s in segs if len(s) <= LONGEST]
        new = [s for s in segs if s not in self.memo]
        if len(self.memo) + len(new) > MEMORY:
            self.older, self.memo, new = self.memo, {}, segs
        self.memo |= {s: self.older[s] for s in new if s in self.older}
        segs = [s for s in new if s not in self.memo]
        if not segs:
            return
        code = np.frombuffer("".join(segs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.char_codes, code), len(self.char_codes) - 1)
        symbol = np.where(self.char_codes[at] == code, self.char_symbols[at], self.other)
        of = np.repeat(np.arange(len(segs)), [len(s) for s in segs])
        inner = np.append(of[1:] == of[:-1], False)
        union, rank = self._ranks(symbol, np.append(symbol[1:], self.other))
        rank[~inner] = NEVER
        done: list[tuple[np.ndarray, ...]] = []
        while len(of):
            begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(of)), begin)
            on = best >> 32 < NEVER
            settled = np.repeat(~on, np.diff(np.append(begin, len(of))))
            done.append((of[settled], symbol[settled], code[settled]))
            if not on.any():
                break
            place = best[on] & 0xFFFFFFFF
            symbol[place] = union[place]
            keep = ~settled
            keep[place + 1] = False
            where = np.cumsum(keep)[place] - 1
            of, symbol, code, union, rank = of[keep], symbol[keep], code[keep], union[keep], rank[keep]
            # the pairs beside a new symbol
            for left in (where, where[where > 0] - 1):
                right = np.minimum(left + 1, len(of) - 1)
                u, r = self._ranks(symbol[left], symbol[right])
                union[left], rank[left] = u, np.where((of[left] == of[right]) & (right > left), r, NEVER)
        who, ids, code = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(who, kind="stable")
        ids, code = ids[order], code[order]
        bounds = np.searchsorted(who[order], np.arange(len(segs) + 1)).tolist()
        plain = ids < self.other
        strange = set(who[order][~plain].tolist())
        raw = ids.astype(np.int32).tobytes()
        for k, seg in enumerate(segs):
            lo, hi = bounds[k], bounds[k + 1]
            data = raw[4 * lo : 4 * hi]
            if k in strange:
                spelt: list[int] = []
                for i, c in zip(ids[lo:hi].tolist(), code[lo:hi].tolist(), strict=True):
                    spelt += [i] if i < self.other else [self.pieces.byte_ids[x] for x in chr(c).encode("utf-8", "surrogatepass")]
                data = array("i", spelt).tobytes()
            self.memo[seg] = data

    def packed_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of several texts, packed; nothing for null and empty."""
        segs = [self.split(" " + t) if t else [] for t in texts]
        self.learn(list({s for part in segs for s in part}))
        remembered, segment = self.memo.get, self.segment
        return [b"".join([remembered(s) or segment(s) for s in part]) for part in segs]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed_all([text])[0], np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of ids, whose pieces' bytes are laid end to end."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        size = self.sizes[ids]
        end = np.cumsum(size)
        at = np.repeat(self.places[ids] - end + size, size) + np.arange(end[-1])
        return self.letters[at].tobytes()[1:].decode("utf-8", "surrogatepass")

    # --- chunks of a giant text
    def states(self, s: str, at: int) -> list[int]:
        """The pieces that begin before a place and end there or beyond, each as how far
        it reaches beyond << 8 | its length."""
        if at >= len(s):
            return [n for n in range(1, min(self.longest, at) + 1) if self._is_piece(s[at - n : at])]
        out = []
        for i in range(max(0, at - self.longest), at):
            for j in range(at, min(len(s), i + self.longest) + 1):
                if self._is_piece(s[i:j]):
                    out.append(j - at << 8 | j - i)
        return sorted(out)

    def _is_piece(self, t: str) -> bool:
        return (len(t) == 1 or t in self.id_of) and self.may_follow("", t)

    def chunks(self, text: str, size: int = CHUNK_CHARS) -> list[tuple[str, int, int, list[int], list[int]]]:
        """(characters, where the core begins and ends in them, entry states, exit states)
        of each chunk; beside its core it has what pieces of the states may reach."""
        s, size, out = " " + text, max(size, 2 * self.longest), []
        at, entries = 0, [0]
        while at < len(s):
            end = at + size if at + size + self.longest < len(s) else len(s)
            exits = self.states(s, end)
            lo = max(0, at - self.longest)
            out.append((s[lo : end + self.longest], at - lo, end - lo, entries, exits))
            at, entries = end, exits
        return out

    def _middle(self, s: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and the last place in a chunk that no piece spans, after the reach of
        its entries."""
        first = self.start.search(s, lo + self.longest, hi)
        if not first:
            return None
        a = b = first.start()
        for m in self.start.finditer(s, max(a, hi - 4 * self.longest), hi):
            b = max(b, m.start())
        return a, b

    def transfer(self, s: str, lo: int, hi: int, entries: list[int], exits: list[int]) -> list[list[int | None]]:
        """Best weight from each entry to each exit: 0, or None where no path leads."""
        middle = self._middle(s, lo, hi)
        upto = middle[0] if middle else hi
        # by place, the pieces that end there with a bit for each entry that leads to them
        reached: dict[int, dict[int, int]] = {}
        for k, e in enumerate(entries):
            at = reached.setdefault(lo + (e >> 8), {})
            at[e & 255] = at.get(e & 255, 0) | 1 << k
        for i in range(lo, upto):
            for n, mask in reached.get(i, {}).items():
                for m in self.after(s, i, s[i - n : i]):
                    at = reached.setdefault(i + m, {})
                    at[m] = at.get(m, 0) | mask
        if middle:
            mask = 0
            for x in reached.get(upto, {}).values():
                mask |= x
            last = self.walk(s, {middle[1]: 0}, hi)
            ends = [mask if last[hi + (e >> 8)] == e & 255 else 0 for e in exits]
        else:
            ends = [reached.get(hi + (e >> 8), {}).get(e & 255, 0) for e in exits]
        return [[0 if mask >> k & 1 else None for mask in ends] for k in range(len(entries))]

    def back(self, s: str, lo: int, hi: int, entries: list[int], exits: list[int], weights: list[int | None]) -> tuple[list[int], list[tuple[int, list[int]]]]:
        """The ids that all paths share, and for each exit, given the weights at the
        entries: the entry (by place) that its path comes from, and its further ids.
        (-1, []) where no path leads."""
        live = {lo + (e >> 8): (e & 255, k) for k, (e, v) in enumerate(zip(entries, weights, strict=True)) if v is not None}
        seeds = {i: n for i, (n, _) in live.items()}
        middle = self._middle(s, lo, hi)
        common: list[int] = []
        if middle:
            last = self.walk(s, seeds, middle[0])
            begin, common = self.trace(s, last, middle[0], seeds)
            entry = live[begin][1]
            segs = self.split(s[middle[0] : middle[1]])
            self.learn(list(set(segs)))
            common = common + np.frombuffer(b"".join([self.segment(x) for x in segs]), np.int32).tolist()
            seeds = {middle[1]: 0}
        last = self.walk(s, seeds, hi)
        found = []
        for e in exits:
            end = hi + (e >> 8)
            if last[end] != e & 255:
                found.append((-1, []))
                continue
            begin, ids = self.trace(s, last, end, seeds)
            found.append((entry if middle else live[begin][1], ids))
        return common, found


Matrix = list[list]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The (max, +) product of two transfer matrices."""
    sums = lambda row, k: [v + other[k] for v, other in zip(row, b, strict=True) if v is not None and other[k] is not None]
    return [[max(sums(row, k), default=None) for k in range(len(b[0]))] for row in a]


def scan(matrices: list[Matrix]) -> list[Matrix]:
    """The products of the first 1, 2, ... matrices: blocks are combined first, then
    carried into one another, as a parallel scan does."""
    n = len(matrices)
    if n <= 1:
        return list(matrices)
    pairs = scan([times(matrices[i], matrices[i + 1]) for i in range(0, n - 1, 2)])
    return [pairs[i // 2] if i % 2 else (times(pairs[i // 2 - 1], matrices[i]) if i else matrices[0]) for i in range(n)]


def entry_weights(matrices: list[Matrix]) -> list[list[int | None]]:
    """Best weights at the entries of each chunk: None for states the text doesn't lead to."""
    return [[0]] + [m[0] for m in scan(matrices)[:-1]]


def joined(traced: list[tuple[list[int], list[tuple[int, list[int]]]]]) -> list[int]:
    """The ids of a text from what ``back`` gave for each chunk."""
    at, parts = None, []
    for common, options in reversed(traced):
        if at is None:  # one piece alone ends the text
            at = next(k for k, (entry, _) in enumerate(options) if entry >= 0)
        at, ids = options[at]
        parts.append([*common, *ids])
    return [i for ids in reversed(parts) for i in ids]


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", giant: int = GIANT_CHARS, size: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with token_ids, n_tokens, n_chunks and n_states in place of columns of
    these names: the ids that the vocabulary's own library gives, but that a mark in
    the text is spelt in bytes.

    Null and empty texts have no tokens and no chunks; repeated rows are each encoded.
    Texts up to ``giant`` characters are one chunk and are encoded where they stand;
    n_states is the number of entry states of the further chunks of longer ones.
    """
    limit_arrow_rows(docs.sparkSession)
    new = ["token_ids", "n_tokens", "n_chunks", "n_states"]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    names, at = docs.columns, docs.columns.index(text)
    (row,) = fresh([*names, *new], "row")
    schema = extended(docs.schema, "token_ids array<int>, n_tokens int, n_chunks int, n_states int")
    ints = pa.list_(pa.int32())

    @lean
    def whole(batches):
        codec = Codec.of(shared.value)
        for batch in (whole.slice(i, BATCH_ROWS) for whole in batches for i in range(0, whole.num_rows, BATCH_ROWS)):
            texts = batch.column(at).to_pylist()
            lo = n = 0
            for k, t in enumerate(texts):
                n += len(t or "")
                if n >= BATCH_CHARS or k == len(texts) - 1:
                    ids = codec.packed_all(texts[lo : k + 1])
                    count = np.array([len(x) // 4 for x in ids], np.int32)
                    flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), flat)
                    made = [lists, pa.array(count), pa.array((count > 0).astype(np.int32)), pa.array(np.zeros(len(count), np.int32))]
                    yield pa.RecordBatch.from_arrays([c.slice(lo, k + 1 - lo) for c in batch.columns] + made, [*names, *new])
                    lo, n = k + 1, 0
        codec.forget()

    def cut(batches):
        codec = Codec.of(shared.value)
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = codec.chunks(t.as_py(), size)
                for lo in range(0, len(found), 256):
                    part = found[lo : lo + 256]
                    cols = [[row] * len(part), list(range(lo, lo + len(part))), *map(list, zip(*part, strict=True))]
                    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), ints, ints]
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], chunk)

    chunk = ["row", "k", "s", "lo", "hi", "entries", "exits"]

    def transfers(batches):
        codec = Codec.of(shared.value)
        for batch in batches:
            found = [codec.transfer(*(r[c] for c in chunk[2:])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(found, pa.list_(pa.list_(pa.int64())))], ["row", "k", "m"])

    def combine(batches):
        for batch in batches:
            for r in batch.to_pylist():
                parts = sorted(r["parts"], key=lambda p: p["k"])
                weights = entry_weights([p["m"] for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]] * len(parts), pa.int64()), pa.array([p["k"] for p in parts], pa.int32()), pa.array(weights, pa.list_(pa.int64()))], ["row", "k", "weights"])

    @lean
    def back(batches):
        codec = Codec.of(shared.value)
        option = pa.list_(pa.struct([("entry", pa.int32()), ("ids", ints)]))
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                common, found = codec.back(*(r[c] for c in chunk[2:]), r["weights"])
                cols = [[r["row"]], [r["k"]], [len(r["entries"])], [common], [[{"entry": e, "ids": x} for e, x in found]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), ints, option], strict=True)], ["row", "k", "states", "common", "options"])
        codec.forget()

    def pick(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parts = sorted(batch.column("parts")[i].as_py(), key=lambda p: p["k"])
                ids = joined([(p["common"], [(o["entry"], o["ids"]) for o in p["options"]]) for p in parts])
                made = [pa.array([ids], ints), *(pa.array([v], pa.int32()) for v in (len(ids), len(parts), sum(p["states"] for p in parts[1:])))]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, 1), *made], [row, *new])

    long_text = F.coalesce(F.length(text), F.lit(0)) > giant
    small = docs.where(~long_text).mapInArrow(whole, schema)
    big = saved(docs.where(long_text).withColumn(row, F.monotonically_increasing_id()), "giant")
    parts = "row long, k int, s string, lo int, hi int, entries array<int>, exits array<int>"
    chunks = saved(big.select(row, text).mapInArrow(cut, parts).repartition("row", "k"), "chunks")
    matrices = chunks.mapInArrow(transfers, "row long, k int, m array<array<long>>")
    per_text = lambda d, *c: d.groupBy("row").agg(F.collect_list(F.struct("k", *c)).alias("parts"))
    starts = per_text(matrices, "m").mapInArrow(combine, "row long, k int, weights array<long>")
    traced = chunks.join(starts, ["row", "k"]).mapInArrow(back, "row long, k int, states int, common array<int>, options array<struct<entry:int,ids:array<int>>>")
    picked = per_text(traced, "states", "common", "options").mapInArrow(pick, f"`{row}` long, token_ids array<int>, n_tokens int, n_chunks int, n_states int")
    large = big.join(picked, row).select(*names, *new)
    return small.unionByName(large)


def decode(docs: DataFrame, pieces: Pieces, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` as column ``out``; null ids give null, no ids an empty text."""
    docs = docs.select(*[c for c in docs.columns if c != out])
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    names, at = docs.columns, docs.columns.index(ids)

    def run(batches):
        codec = Codec.of(shared.value)
        for batch in batches:
            lists = batch.column(at)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [codec.decode(flat[a:b]) if v else None for a, b, v in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return docs.mapInArrow(run, extended(docs.schema, f"{out} string"))
