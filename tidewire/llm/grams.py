"""Words and shingles of Arrow columns as 64-bit hashes, whole batches at a time.

Bytes are classed, lower-cased and summed with numpy, so no Python object is made per
word. Work goes in slices of about a megabyte of text, and never cuts a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between ASCII spaces, and of words between ASCII signs.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
SIGN_WORD = np.zeros(256, dtype=bool)
SIGN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _power(n: int) -> np.ndarray:
    """Powers of one odd number, as many as the longest word so far asks for."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _STEP, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all of them."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def slices(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BYTES, "right")) - 1)
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def words(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and per text the place of its first word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    word = inside[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    start[heads] = word[heads]
    at = np.flatnonzero(start)
    first = np.searchsorted(at, ends)
    if not len(at):
        return np.zeros(0, np.uint64), first
    place = np.arange(at[0], len(data)) - np.repeat(at, np.diff(at, append=len(data)))
    body = word[at[0] :]
    place[~body] = 0
    part = _BYTE[LOWER[data[at[0] :]]] * _power(int(place.max()) + 1)[place]
    part[~body] = 0
    return mix(np.add.reduceat(part, at - at[0])), first


def shingles(
    data: np.ndarray, ends: np.ndarray, inside: np.ndarray, n: int, weight: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Per text the sorted distinct hashes of its n-word shingles, and what they weigh.

    A text of fewer words, but not none, is one shingle; without words it has none.
    ``weight`` is a table by the first bits of a word's hash; a shingle weighs the sum
    over its words.
    """
    h, first = words(data, ends, inside)
    keys = _power(n + 1)[1 : n + 1]
    run = np.zeros(len(h), dtype=np.uint64)
    heavy = None
    if weight is not None:
        each = weight[bucket(h, len(weight))]
        heavy = np.zeros(len(h), dtype=weight.dtype)
    for k in range(min(n, len(h))):
        run[: len(h) - k] += h[k:] * keys[k]
        if heavy is not None:
            heavy[: len(h) - k] += each[k:]
    run = mix(run)
    for i in range(len(ends) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            if heavy is None:
                yield np.unique(run[a : b - n + 1]), None
            else:
                found, at = np.unique(run[a : b - n + 1], return_index=True)
                yield found, heavy[a + at]
        else:
            short = np.zeros(0, np.uint64)
            if b > a:
                short = mix((h[a:b] * keys[: b - a]).sum(keepdims=True, dtype=np.uint64) ^ np.uint64(b - a))
            yield short, None if heavy is None else np.zeros(len(short), heavy.dtype)


def bucket(h: np.ndarray, size: int) -> np.ndarray:
    """The place of a hash in a table of 2^k places: its first k bits."""
    return (h >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def shingle_sets(column, n: int, inside: np.ndarray = SPACE_WORD, weight: np.ndarray | None = None):
    """(sorted distinct shingles, their weights) of every row, in order."""
    for _, data, ends in slices(column):
        yield from shingles(data, ends, inside, n, weight)
