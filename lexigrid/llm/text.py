"""Vectorised words and hashes over Arrow string buffers.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text.
All functions take whole texts; a batch is cut into slices of rows only to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone. Two workers share an executor's memory with its JVM, and
#: arrays over a slice hold many bytes for each of its own.
SLICE_BYTES = 1 << 20
#: Bytes over which sums are held at once, in texts of any length.
BLOCK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Bytes of white-space separated tokens.
SOLID = ~np.isin(np.arange(256), [9, 10, 13, 32])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base % (1 << 64), dtype=np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets at which each starts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    raw = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return raw, (offsets - first if len(offsets) else np.zeros(1, np.int64))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += int(n)
    if lo < len(size):
        yield lo, len(size)


def spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word (maximal run of bytes of `kind`), and the row it is in."""
    inside = kind[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    ends[before] = inside[before]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(offsets, begin, side="right") - 1


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial modulo 2**64 over random byte codes."""
    sums = _sums(raw, np.concatenate([begin, end]))
    low, high = _power("inverse", _INVERSE, BLOCK), _power(f"inverse {BLOCK}", pow(_INVERSE, BLOCK, 1 << 64), len(raw) // BLOCK + 1)
    value = (sums[len(begin) :] - sums[: len(begin)]) * low[begin % BLOCK] * high[begin // BLOCK]
    return mix(value + (end - begin).astype(np.uint64))


def _sums(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sums of the polynomial before each of `places`; those of one BLOCK are held at a time."""
    starts = np.arange(0, len(raw), BLOCK)
    base, high = _power("base", _BASE, BLOCK), _power(f"base {BLOCK}", pow(_BASE, BLOCK, 1 << 64), len(starts))
    order = np.argsort(places, kind="stable") if len(starts) > 1 else np.arange(len(places))
    first = np.append(np.searchsorted(places, starts[1:], sorter=order), len(places))
    out, before, done = np.zeros(len(places), np.uint64), U(0), 0
    for k, start in enumerate(starts):
        part = raw[start : start + BLOCK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * base[: len(part)], out=sums[1:])
        sums = sums * high[k] + before
        mine = order[done : first[k]]
        out[mine] = sums[places[mine] - start]
        before, done = sums[-1], first[k]
    return out


class Words:
    """Words of a slice of texts: `start`, `end` (bytes), `row`, `hash`, and `count` by row."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.texts = texts
        self.raw, self.offsets = buffers(pc.utf8_lower(texts) if lower else texts)
        self.rows = len(self.offsets) - 1
        self.start, self.end, self.row = spans(self.raw, self.offsets)
        self.hash = span_hashes(self.raw, self.start, self.end)
        self.count = np.bincount(self.row, minlength=self.rows).astype(np.int64)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte start and end of every word within its text as it was given; lower case has as many words, of other lengths maybe."""
        raw, offsets = buffers(self.texts)
        start, end, row = spans(raw, offsets)
        return start - offsets[row], end - offsets[row]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of each run of n words; a row of fewer words has one shingle of them all."""
        short = self.count < n
        value, row, size = self.hash, self.row, len(self.hash)
        if size >= n:
            out = np.zeros(size - n + 1, np.uint64)
            for k in range(n):
                out = out * U(0xD6E8FEB86659FD93) + value[k : size - n + 1 + k]
            whole = row[: size - n + 1] == row[n - 1 :]
            rows, hashes = row[: size - n + 1][whole], mix(out[whole])
        else:
            rows, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        some = np.flatnonzero(short & (self.count > 0))
        if len(some):
            first = np.searchsorted(row, some)
            extra = np.array([_joint(value[a : a + c]) for a, c in zip(first, self.count[some])], dtype=np.uint64)
            rows, hashes = np.concatenate([rows, some]), np.concatenate([hashes, extra])
        return rows, hashes


def _joint(values: np.ndarray) -> int:
    out = 0
    for v in values:
        out = (out * 0xD6E8FEB86659FD93 + int(v)) % (1 << 64)
    return int(mix(np.array([out ^ 0xA5A5A5A5], dtype=np.uint64))[0])
