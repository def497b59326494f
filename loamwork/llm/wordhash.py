"""Words of many texts at once, as keys and 64-bit hashes in numpy.

Texts come as an Arrow string column. A word of up to 15 bytes is its own key of
128 bits: its bytes and its length. A longer word's key is 120 bits of its
XXH3-128 digest, which no short word has. Hashes scramble the keys; the hash of a
run of words is built by doubling, each step a compression of two halves that can't
be undone for one of them, so words that collide are found by search alone. Equal words have equal keys and hashes whatever batch,
task or run they are met in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 19
#: A longer word's key is a digest.
KEY_BYTES = 15

#: Odd multipliers of the two hashes (fixed values).
_LOW = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_HIGH = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))
#: Masks that keep the first 0 to 8 bytes of a word read as one little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (public-domain splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def compressed(a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """One hash of two, in this order: b scrambled under a, and b added again, so that b does not follow from a and the result."""
    h = a * _HIGH[which]
    h ^= h >> np.uint64(32)
    h *= _LOW[which]
    h ^= b
    h = mix(h)
    h += b
    h ^= h >> np.uint64(29)
    h *= _LOW[which]
    return h ^ (h >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """One number of two, in this order, for tables that compare whole keys: b follows from a and the result."""
    h = a ^ (a >> np.uint64(32))
    h *= _LOW[which]
    h += b
    h ^= h >> np.uint64(29)
    h *= _HIGH[which]
    h ^= h >> np.uint64(32)
    return h


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, null as the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return offsets, data


@dataclass
class Chunk:
    """Some whole texts of a batch. Words are numbered through the chunk."""

    first: int  #: row of the batch that the chunk starts with
    data: np.ndarray  #: bytes
    offsets: np.ndarray  #: of texts in data
    starts: np.ndarray  #: of words in data
    ends: np.ndarray
    counts: np.ndarray  #: words of each text
    bounds: np.ndarray  #: number of the first word of each text, and the end

    @property
    def n_texts(self) -> int:
        return len(self.counts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Low and high half of each word's key."""
        padded = np.zeros(len(self.data) + 16, dtype=np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 9, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
        size = self.ends - self.starts
        low = eight[self.starts] & _FIRST[np.minimum(size, 8)]
        high = size.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero(size > 8)
        high[more] |= eight[self.starts[more] + 8] & _FIRST[np.minimum(size[more] - 8, 7)]
        for i in np.flatnonzero(size > KEY_BYTES).tolist():
            digest = xxhash.xxh3_128_digest(self.data[self.starts[i] : self.ends[i]])
            low[i], high[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:15] + b"\xff", "little")
        return low, high

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash for each word; two are to be had."""
        low, high = self.keys()
        return mix(compressed(high, low, which))


def run_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash for each run of ``length`` words, by the number of its first word.

    Runs of 1, 2, 4, .. words come of two halves each; the run wanted comes of two
    such runs that begin with its first and end with its last word.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    span, h = 1, words
    while 2 * span <= length:
        h = compressed(h[:-span], h[span:], which)
        span *= 2
    if span < length:
        h = compressed(h[:n], h[length - span :], which)
    return mix(h ^ np.uint64(length))


def chunks(column: pa.Array, lower: bool = False, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column in chunks of about ``chunk_bytes``; a longer text is one chunk."""
    offsets, data = string_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        at = offsets[row : stop + 1]
        part = data[at[0] : at[-1]]
        at = at - at[0]
        if lower:
            part = _LOWER[part]
        yield split(row, part, at)
        row = stop


def split(first: int, data: np.ndarray, offsets: np.ndarray) -> Chunk:
    word = ~_IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]  # a text's end also ends a word
    begins[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    return Chunk(first, data, offsets, starts, np.flatnonzero(closes) + 1, np.diff(bounds), bounds)
