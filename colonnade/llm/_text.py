"""Words, word hashes and shingles of whole Arrow columns in numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII character but letters and digits, for words without punctuation.
_PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: Words are hashed modulo a prime, once with each base; a modulus of two's powers would take some words for others by construction.
_PRIME = (1 << 31) - 1
_BASES = (1_284_865_837, 1_812_433_253)
#: Texts are hashed in pieces of about so many bytes, cut between words; a longer word is hashed in such pieces, too.
PIECE = 1 << 18


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about limit bytes of the column; a longer text is a slice of its own."""
    _, offsets = binary(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _powers(base: int, piece: int) -> np.ndarray:
    """Powers of the base modulo _PRIME, piece + 1 of them."""
    out = np.ones(1, np.uint64)
    while len(out) <= piece:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)])
    return out[: piece + 1]


def _prefixes(data: np.ndarray, base: int) -> np.ndarray:
    """Sums of (byte + 1) * base ** place over the bytes before each place, of at most PIECE bytes; below 2**60."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, PIECE)[: len(data)], out=out[1:])
    return out


def _long_word(word: np.ndarray, base: int) -> int:
    """The hash that a word longer than PIECE has by the rule of shorter ones."""
    total = 0
    for k in range(0, len(word), PIECE):
        total += int(_prefixes(word[k : k + PIECE], base)[-1]) * pow(base, k, _PRIME)
    return total % _PRIME


class Words:
    """Words of a piece of bytes: starts and ends, and for each document the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, punctuation: bool = False):
        """A word is a longest run of bytes that aren't white space (punctuation: nor ASCII punctuation)."""
        inside = ~(_PUNCTUATION if punctuation else _SPACE)[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
        self.data = data
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit number for each word (for its first `most` bytes), from 62 bits of hash: equal words have equal ones.

        Different words may share one (with a chance of about 2**-55 where nobody chose them to), so where words
        must be equal for certain, compare them.
        """
        out = np.zeros(len(self.starts), np.uint64)
        at, prime = 0, np.uint64(_PRIME)
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        while at < len(out):
            low = self.starts[at]
            to = int(np.searchsorted(self.ends, low + PIECE, "right"))
            if to <= at:
                word = self.data[low : ends[at]]
                values = [_long_word(word, base) for base in _BASES]
                out[at] = np.uint64(((values[0] << 31) | values[1]) ^ (len(word) << 40 & (1 << 64) - 1))
                at += 1
                continue
            s, e = self.starts[at:to] - low, ends[at:to] - low
            for k, base in enumerate(_BASES):
                sums = _prefixes(self.data[low : self.ends[to - 1]], base)
                down = _powers(pow(base, -1, _PRIME), PIECE)
                out[at:to] |= (sums[e] - sums[s]) % prime * down[s] % prime << np.uint64(31 * (1 - k))
            out[at:to] ^= (e - s).astype(np.uint64) << np.uint64(40)
            at = to
        return mix64(out)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words' bytes, each with a space behind it, and the place of each word's first byte (and the end)."""
        size = self.ends - self.starts + 1
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        out = np.full(at[-1], 0x20, np.uint8)
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts] += 1
        edge[self.ends] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        gaps = np.zeros(len(out), bool)
        gaps[at[1:] - 1] = True
        out[~gaps] = self.data[inside]
        return out, at

    def ids(self) -> np.ndarray:
        """A number for each word: two words of these texts have one number just if their bytes are equal."""
        data, at = self.joined()
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        return np.asarray(column.dictionary_encode().indices).astype(np.int64)


def gram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n words, from numbers of words: equal just if the runs are; the last n - 1 starts are left out."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    have, out = 1, ids
    while have < n:
        step = min(have, n - have)
        left, right = out[: len(out) - step], out[step:]
        # right is a run of `have` words that ends where the longer one does; overlapping runs tell the same
        out = np.unique(left * (np.int64(out.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        have += step
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, one for each start; the last n - 1 starts are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    factor = 1
    for k in range(n):
        out += hashes[k : k + m] * np.uint64(factor)
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64)
    return mix64(out)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each window of x; len(x) - width + 1 values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out
