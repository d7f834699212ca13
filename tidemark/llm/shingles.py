"""Words and shingles of many texts as 64-bit hashes, by numpy over the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)
_STEPS = _RANDOM.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(max(n, BLOCK_BYTES), _FACTOR)], dtype=np.uint64)
    return _POWERS


_INVERSE = np.uint64(pow(int(_FACTOR), -1, 2**64))
_INVERSES = np.ones(1, dtype=np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        _INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(max(n, BLOCK_BYTES), _INVERSE)], dtype=np.uint64)
    return _INVERSES


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in bytes; A-Z count as a-z. Words are cut by ASCII white space."""
    space = _SPACE[data]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_VALUE[_LOWER[data]] * _powers(len(data))[: len(data)], dtype=np.uint64)]
        hashes = mixed((sums[ends] - sums[starts]) * _inverses(len(data))[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: the first text's place, all bytes, and where each text begins and the last ends. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes in a block, and how many words come before each text. Words end with their text."""
    bounds = offsets[1:-1]
    if len(bounds):  # a blank between texts keeps words apart
        data = np.insert(data, bounds, 32)
        offsets = offsets + np.r_[0, np.arange(len(offsets) - 1)]  # noqa: RUF005
        offsets[-1] = len(data)
    starts, ends, hashes = word_hashes(data)
    first = np.searchsorted(starts, offsets)
    return starts, ends, hashes, first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n] * _STEPS[0]
        for j in range(1, k):
            out = out + words[j : j + n] * _STEPS[j]
        return mixed(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; of fewer words, one hash of them all; none without words."""
    for _, data, offsets in text_blocks(column):
        _, _, hashes, first = block_words(data, offsets)
        runs = shingle_hashes(hashes, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    yield mixed(np.sum(hashes[a:b] * _STEPS[: b - a], dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)
