"""Sets of hashed word shingles, computed over whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE_WORDS = 5
#: Work on at most about this many bytes of text at a time; longer texts are read in slices.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(n: int) -> list[np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        step = np.full(n, b, np.uint64)
        step[0] = 1
        out.append(np.multiply.accumulate(step))
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64.  Those of
    a chunk are kept; longer ones are made for the caller."""
    if n > 2 * CHUNK_BYTES + 1:
        up, down = _power_table(n)
        return up, down
    if len(_powers[0]) < n:
        _powers[:] = _power_table(2 * CHUNK_BYTES + 1)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, polynomial hash) of the words of some bytes."""
    up, down = powers(len(raw) + 1)
    word = ~_SPACE[raw]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[_LOWER[raw]] * up[:-1], dtype=np.uint64)))
    return begin, end, (total[end] - total[begin]) * down[begin]


def _long_words(text: bytes) -> np.ndarray:
    """The word hashes of a long text, slice by slice; a word may reach over many."""
    raw, out = np.frombuffer(text, np.uint8), []
    carry = None  # hash and length of a word that reaches to the end of the slices before
    for at in range(0, len(raw), CHUNK_BYTES):
        piece = raw[at : at + CHUNK_BYTES]
        begin, end, h = _sums(piece)
        size = (end - begin).astype(np.uint64)
        if carry is not None:
            if len(begin) and begin[0] == 0:
                h[0] = np.uint64((int(carry[0]) + int(h[0]) * pow(_BASE, int(carry[1]), 1 << 64)) & (1 << 64) - 1)
                size[0] += carry[1]
            else:
                out.append(mix(np.array([carry[0]]) + carry[1]))
            carry = None
        if len(end) and end[-1] == len(piece) and at + CHUNK_BYTES < len(raw):
            carry = (h[-1], size[-1])
            h, size = h[:-1], size[:-1]
        out.append(mix(h + size))
    return np.concatenate(out)


def _set_of(words: np.ndarray, joined: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct shingles of a text, given its words and k-word hashes."""
    if len(words) >= k:
        return np.unique(joined)
    if not len(words):
        return np.zeros(0, np.uint64)
    h = np.array([len(words)], np.uint64)
    for w in words:
        h = mix(h * _STEP + w)
    return h


def _joined(words: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        out = out * _STEP + words[j : j + len(out)]
    return mix(out)


def shingle_sets(texts: list[bytes], k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text (UTF-8) the sorted distinct hashes of its k-word shingles.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; a
    text of fewer words is one shingle, one without words has none.  Hashes have
    64 bits: two given sets are compared wrongly with probability about their
    size squared over 2^64.  A text takes memory for its words' hashes, its bytes
    are read in slices.
    """
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        if len(part) == 1 and len(part[0]) > CHUNK_BYTES:
            words = _long_words(part[0])
            out.append(_set_of(words, _joined(words, k), k))
            continue
        ends = np.cumsum([len(t) + 1 for t in part])
        raw = np.frombuffer(b"\n".join([*part, b""]), np.uint8)
        begin, end, h = _sums(raw)
        words = mix(h + (end - begin).astype(np.uint64))
        doc = np.searchsorted(ends, begin, "right")
        bounds = np.searchsorted(doc, np.arange(len(part) + 1))
        joined = _joined(words, k)
        out += [_set_of(words[a:b], joined[a : max(a, b - k + 1)], k) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out
