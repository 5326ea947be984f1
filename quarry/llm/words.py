"""Words and word shingles of whole Arrow text batches, vectorised with numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` (the separators
are ASCII, so UTF-8 bytes split exactly like code points). Every word gets a
64-bit hash from a prefix polynomial over randomised bytes, so a batch of
texts is hashed in a few array passes; only slices of bounded size are in
memory at once (a single longer text is its own slice).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 16
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARKS = _SPACE.copy()              # blanks and ASCII punctuation
_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_STEP = _rng.integers(1, 2**62, 1, dtype=np.uint64)[0] * _U(4) + _U(3)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective): every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_STEP, _BACK):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p))
        if n > 64 * SLICE_BYTES:     # a giant text: do not keep its tables
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of one slice: ``hash``/``start``/``end``/``doc`` per word (byte
    positions in ``data``), ``first`` = index of each document's first word
    (one more entry than documents)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(row, n_rows, bytes, offsets)`` of consecutive slices of a string
    column (null = empty); a slice ends before it passes SLICE_BYTES."""
    col = pc.fill_null(pc.cast(col, pa.large_string()), "")
    n = len(col)
    if n == 0:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(off, off[row] + SLICE_BYTES, "right")) - 1)
        to = min(to, n)
        yield row, to - row, raw[off[row]:off[to]], off[row:to + 1] - off[row]
        row = to


def words(data: np.ndarray, offsets: np.ndarray, fold: bool, split_punctuation: bool = False) -> Words:
    """Split and hash the words of a slice; ``fold`` lower-cases A-Z;
    ``split_punctuation`` ends words at ASCII punctuation too."""
    n, docs = len(data), len(offsets) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, z, np.zeros(docs + 1, np.int64), data, offsets)
    solid = ~(_MARKS if split_punctuation else _SPACE)[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(h, start, end, doc, first, data, offsets)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, ok)`` of the k words from each word on; ``ok`` marks those that
    stay inside one document."""
    n = len(w.hash)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        g[:n - k + 1] += w.hash[j:n - k + 1 + j] * _PLACE[j]
    ok = np.zeros(n, dtype=bool)
    ok[:n - k + 1] = w.doc[k - 1:] == w.doc[:n - k + 1]
    return mix(g), ok


def whole(hashes: np.ndarray) -> np.ndarray:
    """One-element array: hash of a whole (short) word sequence."""
    n = len(hashes)
    return mix(np.array([(hashes * _PLACE[:n]).sum(dtype=np.uint64) + _U(n)], dtype=np.uint64))


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles per document: ``(hashes, first)`` where
    ``hashes[first[d]:first[d+1]]`` are document d's, ascending. Fewer than k
    words: the whole sequence is the one shingle; no word: none."""
    docs = len(w.first) - 1
    g, ok = grams(w, k)
    doc, h = w.doc[ok], g[ok]
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.concatenate([whole(w.hash[w.first[d]:w.first[d + 1]]) for d in short])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, extra])
    order = np.argsort(h)
    if docs < 1 << 16:                   # 16-bit keys are radix-sorted
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[keep], h[keep]
    return h, np.searchsorted(doc, np.arange(docs + 1))
