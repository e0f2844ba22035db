"""A language model of bits: hashed contexts, mixed online by gated logistic weights.

Each predictor looks at one context of the next byte and has, per hashed context, a tree
of 255 bit probabilities. They are learned as counts of (context, byte), which add up
over any partition of the corpus. A mixer sums the predictors' log odds under weights
chosen by the bit's place in the byte, and moves the weights after every bit against the
gradient of the code length. An adaptive map refines what the mixer says: per place in
the byte and class of the mixed log odds it keeps what came of them, as log odds that
move after every bit in the same way, and the bit is coded by the mean of both.

Texts are coded in segments: the mixer starts afresh in each, the contexts do not. Many
segments advance side by side, a byte at a time, as numpy vectors: weights and maps belong
to one place in the byte, so its eight bits do not wait for each other.
"""

from __future__ import annotations

import numpy as np

from tidewire.llm import grams

#: Bits of a context's slot: the last two bytes, the last four, and the word so far.
SLOT_BITS = (13, 15, 16)
CONTEXTS = len(SLOT_BITS)
SEGMENT = 256
#: Segments side by side, and bytes of each whose odds are looked up at once.
LANES = 2048
BLOCK = 8
RATE = 0.03
#: Classes of the mixed log odds, whole numbers up to this on both sides, and the map's rate.
CLASS_EDGE = 4
MAP_RATE = 0.15
#: Log odds that a bit is coded with lie between -EDGE and EDGE.
EDGE = 9
START = 0.4
SCALE = 16.0
_PRIOR = 0.3
#: Ends every text; UTF-8 has no such byte.
END = 0xFF
#: Per place in the byte: how far down its node lies, and of every byte -1 for a one, 1 for a zero.
_DOWN = np.arange(8, 0, -1)[:, None, None]
_SIGNS = (1 - 2 * (np.arange(256) >> np.arange(7, -1, -1)[:, None] & 1)).astype(np.float32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = ~grams.SPACE_WORD


def inverse_of_odd(x: int) -> int:
    return pow(x, -1, 1 << 64)


_powers = {}


def _power(odd: int, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, kept and grown as texts ask for."""
    have = _powers.get(odd)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), odd, dtype=np.uint64)
        steps[0] = 1
        have = _powers[odd] = np.multiply.accumulate(steps)
    return have


def ended(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with an END behind each, and the offsets of that."""
    new = ends + np.arange(len(ends))
    out = np.full(len(data) + len(ends) - 1, END, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[new[1:] - 1] = False
    out[keep] = data
    return out, new


def contexts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Slots of every byte's contexts: CONTEXTS rows."""
    n = len(data)
    past = np.zeros((4, n), dtype=np.uint32)
    for k in range(4):
        past[k, k + 1 :] = data[: max(0, n - k - 1)]
    for depth in range(4):  # no text sees the one before it
        past[depth:, ends[:-1][np.diff(ends) > depth] + depth] = 0
    two = past[0] | past[1] << np.uint32(8)
    four = two | past[2] << np.uint32(16) | past[3] << np.uint32(24)
    out = np.empty((CONTEXTS, n), dtype=np.intp)
    for k, key in enumerate((two + np.uint32(1), four)):
        out[k] = (key.astype(np.uint64) * _ODD) >> np.uint64(64 - SLOT_BITS[k])
    # The word so far is a difference of running sums, shifted to the word's start.
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(int(_ODD), n)[:n], out=sums[1:])
    at = np.arange(n)
    head = np.where(np.concatenate(([True], _SPACE[data[:-1]])), at, 0)
    head[ends[:-1][ends[:-1] < n]] = ends[:-1][ends[:-1] < n]
    head = np.maximum.accumulate(head)
    word = (sums[:-1] - sums[head]) * _power(inverse_of_odd(int(_ODD)), n)[head]
    out[2] = grams.mix(word) >> np.uint64(64 - SLOT_BITS[2])
    return out


def counters(kind: type) -> list[np.ndarray]:
    """Per context a flat table of 256 numbers for every slot."""
    return [np.zeros(256 << bits, dtype=kind) for bits in SLOT_BITS]


def count(data: np.ndarray, ends: np.ndarray, tables: list[np.ndarray]) -> None:
    """Add the (context, byte) pairs of these texts to their counters."""
    data, ends = ended(data, ends)
    for table, slot in zip(tables, contexts(data, ends), strict=True):
        np.add.at(table, (slot << 8) | data, table.dtype.type(1))


def odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of a one at every node of every slot, in steps of 1 / SCALE.

    ``counts`` has 256 bytes per slot; node 1 is the first bit, 2 and 3 the second.
    """
    level = counts.astype(np.float32).reshape(-1, 256)
    out = np.zeros(level.shape, dtype=np.int8)
    for bit in range(7, -1, -1):
        zero, one = level[:, 0::2], level[:, 1::2]
        lean = np.log((one + _PRIOR) / (zero + _PRIOR))
        out[:, 1 << bit : 2 << bit] = np.clip(np.rint(lean * SCALE), -127, 127).astype(np.int8)
        level = zero + one
    return out.ravel()


def _segments(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of every segment, longest first."""
    sizes = np.diff(ends)
    parts = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = ends[text] + nth * SEGMENT
    length = np.minimum(SEGMENT, ends[text + 1] - start)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order], text[order]


def _cost(
    data: np.ndarray, slots: np.ndarray, start: np.ndarray, length: np.ndarray, tables: list[np.ndarray]
) -> np.ndarray:
    """Natural logarithms of one over the probability of some segments, longest first."""
    lanes = len(start)
    longest = int(length[0])
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # lanes longer than t
    weights = np.full((CONTEXTS, 8, lanes), START / SCALE, dtype=np.float32)
    # what the map adds to the mixed log odds, by class, place and lane
    refined = np.zeros((2 * CLASS_EDGE + 1) * 8 * lanes, dtype=np.float32)
    middle = np.arange(8 * lanes, dtype=np.int32).reshape(8, lanes) + CLASS_EDGE * 8 * lanes
    cost = np.zeros(lanes, dtype=np.float64)
    for t0 in range(0, longest, BLOCK):
        n = int(active[t0])
        steps = min(BLOCK, longest - t0)
        at = np.minimum(start[:n] + t0 + np.arange(steps)[:, None], len(data) - 1)
        byte = data[at]
        node = (byte.astype(np.intp) | 256) >> _DOWN
        lean = np.empty((CONTEXTS, 8, steps, n), dtype=np.int8)
        for k in range(CONTEXTS):
            tables[k].take(slots[k].take(at) << 8 | node, mode="clip", out=lean[k])
        signs = _SIGNS.take(byte, axis=1)
        rates = np.empty((2, 8, steps, n), dtype=np.float32)
        np.multiply(signs, np.float32(RATE / SCALE**2), out=rates[0])
        np.multiply(signs, np.float32(MAP_RATE), out=rates[1])
        products = np.ones((steps, n), dtype=np.float32)
        for t in range(steps):
            # every place in the byte has weights and a map of its own, so a byte's bits move at once
            m = int(active[t0 + t])
            x, w, sign = lean[:, :, t, :m].astype(np.float32), weights[:, :, :m], signs[:, t, :m]
            part = x * w
            z = part[0]
            for k in range(1, CONTEXTS):
                z += part[k]
            place = np.clip(z, -CLASS_EDGE, CLASS_EDGE).astype(np.int32)
            place *= 8 * lanes
            place += middle[:, :m]
            place = place.astype(np.intp)
            added = refined.take(place)
            # log odds of the wrong bit: as mixed, and as refined
            wrong = np.empty((2, 8, m), dtype=np.float32)
            np.multiply(z, sign, out=wrong[0])
            np.multiply(added, sign, out=wrong[1])
            wrong[1] += wrong[0]
            np.clip(wrong, -EDGE, EDGE, out=wrong)
            np.exp(wrong, out=wrong)
            total = wrong + 1
            wrong /= total  # the probability that was put on the wrong bit
            wrong *= rates[:, :, t, :m]
            known = z != 0
            if not known.all():
                wrong[1] *= known  # where nothing is known, nothing is refined
            added -= wrong[1]
            refined[place] = added
            x *= wrong[0]
            w -= x
            # one over the sum of both probabilities, over all bits
            np.multiply.reduce(total[0] * total[1] / (total[0] + total[1]), axis=0, out=products[t, :m])
        spent = np.log(products) + 8 * np.log(2)
        for t in range(steps):
            m = int(active[t0 + t])
            cost[:m] += spent[t, :m]
    return cost


def score(data: np.ndarray, ends: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of every text, its END included."""
    texts = len(ends) - 1
    data, ends = ended(data, ends)
    slots = contexts(data, ends)
    start, length, text = _segments(ends)
    cost = np.empty(len(start), dtype=np.float64)
    for a in range(0, len(start), LANES):
        some = slice(a, a + LANES)
        cost[some] = _cost(data, slots, start[some], length[some], tables)
    return np.bincount(text, weights=-cost / np.log(10), minlength=texts)
