"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch at a time: the UTF-8 bytes of all its
texts lie in one flat array with offsets, so tokenising, hashing and windowing
are a few numpy passes and no Python loop runs per word or byte.

Words are maximal runs of bytes outside ``{0x20, 0x09..0x0D}``, which is the
pattern ``[^\\x20\\x09-\\x0D]+``.  A null text reads as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled in runs of about this many bytes, so that a batch of long
#: documents needs no more memory than a batch of short ones.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE2 = U64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for ``i < n``; kept and grown."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inv = pow(int(base), -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inv, np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            up, down = np.cumprod(up), np.cumprod(down)
        _powers[int(base)] = got = (up, down)
    return got[0][:n], got[1][:n]


def prefix_sums(values: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i`` (n + 1 of them), for span_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values), base)[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of ``values[start:end]``, the same wherever that span stands."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * powers(len(sums), base)[1][start])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def runs_of(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``start[i] .. start[i] + size[i]``."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return np.arange(total) + shift


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's rank among them."""
    d = pa.array(x).dictionary_encode()
    values = d.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order], rank[d.indices.to_numpy(zero_copy_only=False)]


def ranked_small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for numbers that leave room for their places in 63 bits: one sort of plain numbers."""
    bits = len(x).bit_length()
    if int(x.max(initial=0)) >> (63 - bits):
        return ranked(x)
    both = np.sort((x << bits) | np.arange(len(x)))
    values, place = both >> bits, both & ((1 << bits) - 1)
    new = np.ones(len(x), bool)
    new[1:] = values[1:] != values[:-1]
    rank = np.empty(len(x), np.int64)
    rank[place] = np.cumsum(new) - 1
    return values[new], rank


def word_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (non-empty) byte string ``raw[start:end]``.

    Each block of eight bytes goes through the finaliser together with its
    number before the blocks are added, so no arithmetic pattern of the bytes
    cancels out as it can in a polynomial modulo 2**64.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    blocks = (size + 7) >> 3
    many = int(blocks.max()) > 1
    first = np.cumsum(blocks) - blocks
    nth = ragged(np.zeros(len(start), np.int64), blocks) if many else np.zeros(len(start), np.int64)
    at = (np.repeat(start, blocks) if many else start) + 8 * nth
    left = np.minimum((np.repeat(end, blocks) if many else end) - at, 8)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    block = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))[at]
    block &= U64(2**64 - 1) >> (U64(64) - left.astype(np.uint64) * U64(8))
    with np.errstate(over="ignore"):
        hashed = mix(block ^ mix((nth.astype(np.uint64) + U64(1)) * _BASE))
        return mix((np.add.reduceat(hashed, first) if many else hashed) + size.astype(np.uint64) * _BASE2)


class Words:
    """The words of a run of texts.

    ``start``/``end`` are byte positions in ``raw``, ``offsets`` the texts'
    ranges in the word arrays, ``code`` a 64-bit hash of each word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw = raw = _LOWER[raw] if lower else raw
        n = len(raw)
        word = ~_SPACE[raw]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        self.code = word_codes(raw, self.start, self.end)


def byte_codes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit code of every byte."""
    return _BYTE_CODES[raw]


def sliding_min(values: np.ndarray, w: int, op=np.minimum, fill=np.uint64(2**64 - 1)) -> np.ndarray:
    """Minimum (or ``op``) of each ``w`` consecutive values, in three passes."""
    n = len(values)
    if n < w:
        return np.zeros(0, values.dtype)
    pad = np.full(-(-n // w) * w, fill, values.dtype)
    pad[:n] = values
    grid = pad.reshape(-1, w)
    ahead = op.accumulate(grid, axis=1).ravel()
    behind = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """The text number of every item, from the texts' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
