"""Patched frame-of-reference blocks: a binary form for runs of token ids.

A segment is a header, an index with one entry for each block, and the blocks.
A block of 128 ids keeps its minimum in the index; what exceeds it is packed at
a width taken from the block's own percentiles, the one that makes the block
smallest. Ids too large for the width stand in an exception list as position
and high bits. The index has every block's start, so one block can be read alone.

    header  4s magic, u32 number of ids, u32 number of blocks
    index   per block: u32 start, u32 minimum, u8 width, u8 exceptions
    block   16 * width bytes of packed low bits, positions u8, high bits u32
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
MAGIC = b"LPF1"
PERCENTILES = (75, 90, 97, 100)

_HEADER = struct.Struct("<4sII")
_INDEX = np.dtype([("start", "<u4"), ("least", "<u4"), ("width", "u1"), ("exceptions", "u1")])


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encode(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return _HEADER.pack(MAGIC, 0, 0)
    grid = np.full(blocks * BLOCK, ids[-1], dtype=np.uint32)  # the last id fills the last block
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1)
    over = grid - least[:, None]
    ordered = np.sort(over, axis=1)
    best = np.full(blocks, np.iinfo(np.int64).max)
    width = np.zeros(blocks, dtype=np.int64)
    for p in PERCENTILES:
        w = _bit_length(ordered[:, -(-p * BLOCK // 100) - 1])
        out = (over >> w[:, None].astype(np.uint64) > 0).sum(axis=1)
        size = BLOCK // 8 * w + 5 * out
        width, best = np.where(size < best, w, width), np.minimum(size, best)
    high = (over >> width[:, None].astype(np.uint64)).astype(np.uint32)
    rows, places = np.nonzero(high)
    exceptions = np.bincount(rows, minlength=blocks)
    head = _HEADER.size + blocks * _INDEX.itemsize
    sizes = BLOCK // 8 * width + 5 * exceptions
    starts = head + np.cumsum(sizes) - sizes
    out = np.zeros(head + int(sizes.sum()), dtype=np.uint8)
    index = np.zeros(blocks, dtype=_INDEX)
    index["start"], index["least"], index["width"], index["exceptions"] = starts, least, width, exceptions
    out[:head] = np.frombuffer(_HEADER.pack(MAGIC, n, blocks) + index.tobytes(), dtype=np.uint8)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        lanes = 16 if w <= 16 else 32
        bits = np.unpackbits(over[which].astype(f"<u{lanes // 8}").view(np.uint8).reshape(len(which), BLOCK, lanes // 8), axis=2, bitorder="little")
        packed = np.packbits(bits[:, :, :w].reshape(len(which), -1), axis=1, bitorder="little")
        out[starts[which][:, None] + np.arange(BLOCK // 8 * w)] = packed
    positions = starts + BLOCK // 8 * width
    out[_ranges(positions, exceptions)] = places
    out[_ranges(positions + exceptions, 4 * exceptions)] = high[rows, places].astype("<u4").view(np.uint8)
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    magic, n, blocks = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token blocks")
    index = np.frombuffer(data, dtype=_INDEX, count=blocks, offset=_HEADER.size)
    return _blocks(np.frombuffer(data, dtype=np.uint8), index).reshape(-1)[:n]


def decode_block(data: bytes, number: int) -> np.ndarray:
    """The ids of one block, found through the index."""
    _, n, blocks = _HEADER.unpack_from(data)
    entry = np.frombuffer(data, dtype=_INDEX, count=1, offset=_HEADER.size + number * _INDEX.itemsize)
    return _blocks(np.frombuffer(data, dtype=np.uint8), entry).reshape(-1)[: n - number * BLOCK]


def _blocks(data: np.ndarray, index: np.ndarray) -> np.ndarray:
    grid = np.zeros((len(index), BLOCK), dtype=np.uint32)
    starts, width, exceptions = (index[x].astype(np.int64) for x in ("start", "width", "exceptions"))
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        lanes = 16 if w <= 16 else 32
        bits = np.zeros((len(which), BLOCK, lanes), dtype=np.uint8)
        packed = data[starts[which][:, None] + np.arange(BLOCK // 8 * w)]
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(which), BLOCK, w)
        grid[which] = np.packbits(bits, axis=2, bitorder="little").view(f"<u{lanes // 8}")[:, :, 0]
    rows = np.repeat(np.arange(len(index)), exceptions)
    positions = starts + BLOCK // 8 * width
    places = data[_ranges(positions, exceptions)]
    high = np.ascontiguousarray(data[_ranges(positions + exceptions, 4 * exceptions)]).view("<u4")
    grid[rows, places] |= high << width[rows].astype(np.uint32)
    return grid + index["least"][:, None]
