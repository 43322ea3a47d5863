"""Position-independent rolling hashes and window anchors over one long array of elements.

Elements are bytes or words, as random-looking 64-bit values. The hash of a stretch is a
polynomial in an odd base modulo 2**64, taken from prefix sums, so that any stretch costs
two look-ups. Equal stretches have equal hashes; the reverse is not sure, so these hashes find
candidates only, of which whoever uses them compares the words or bytes themselves.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from quarry.llm.common import eights, first_bytes, mixed

BASE = 0x9E3779B97F4A7C15  # any odd number
#: Window starts handled at once, so that the arrays stay in the processor's cache.
STEP = 1 << 17
#: Bytes of a word from which its value is a digest.
LONG = 256


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n rounded up by the caller."""
    up = np.ones(n, np.uint64)
    up[1:] = BASE
    down = np.ones(n, np.uint64)
    down[1:] = pow(BASE, -1, 1 << 64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Stretches:
    """Hashes of any stretches of ``values``."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(12, int(len(values)).bit_length())
        self.up, self.down = powers(size)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all_of(self, length: int) -> np.ndarray:
        """Of each stretch of this length, by its start."""
        n = len(self.sums) - 1
        if n < length:
            return np.zeros(0, np.uint64)
        return (self.sums[length:] - self.sums[: n - length + 1]) * self.down[: n - length + 1]


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit values of all words (different for different words of up to eight bytes; else equal by chance only), their byte starts and ends in ``data``, and each text's n+1 word offsets."""
    n = len(data)
    inside = np.ones(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    # a word also ends where its text ends
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    cut = inner[inside[1:-1][inner] & inside[1:-1][inner - 1]] if n else inner
    if len(cut):
        starts = np.sort(np.concatenate([starts, cut]))
        ends = np.sort(np.concatenate([ends, cut]))
    size = ends - starts
    at_each = eights(data)
    values = mixed(first_bytes(at_each, starts, size) + size.astype(np.uint64) * np.uint64(BASE))
    done, long = 8, np.flatnonzero(size > 8)
    while len(long) and done < LONG:  # eight bytes more of each longer word; no step is linear in the one before
        values[long] = mixed(values[long] + mixed(first_bytes(at_each, starts[long] + done, size[long] - done) + np.uint64(done)))
        done += 8
        long = long[size[long] > done]
    for i in long.tolist():
        values[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return values, starts, ends, np.searchsorted(starts, offsets)


def anchors(values: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Each window's anchor: its gram of smallest hash, the leftmost of equals.

    Equal windows have equal anchors at equal places. Yields, for pieces of the array,
    (first, lead, count, seed): ``count`` windows from the position ``first`` on share one
    anchor, ``lead`` elements after ``first``; ``seed`` is the anchor gram's hash. Each window
    inside a text is in just one of them.
    """
    span = window - gram + 1
    n = len(values)
    for at in range(0, max(0, n - window + 1), STEP):
        to = min(n, at + STEP + window - 1)
        s = Stretches(values[at:to])
        grams = s.all_of(gram)
        bits = np.uint64(18)  # a place within the piece
        low = mixed(grams)
        low >>= bits
        low <<= bits
        low |= np.arange(len(low), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:  # smallest of 2, 4, 8 ... from each place on
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        place = (low & np.uint64((1 << 18) - 1)).astype(np.int64)
        count = len(place)
        # windows that cross from one text to the next don't count
        inside = np.zeros(count + 1, np.int32)
        first_text = int(np.searchsorted(offsets, at, side="right"))
        last_text = int(np.searchsorted(offsets, to, side="left"))
        crossing = np.unique(offsets[first_text:last_text]) - at
        crossing = crossing[crossing > 0]
        np.add.at(inside, np.clip(crossing - window + 1, 0, count), 1)
        np.add.at(inside, np.clip(crossing, 0, count), -1)
        valid = np.cumsum(inside[:-1]) == 0
        new = np.empty(count, bool)
        new[0] = True
        new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], count)
        keep = valid[begin]
        begin, stop = begin[keep], stop[keep]
        if not len(begin):
            continue
        lead, runs = place[begin] - begin, stop - begin
        yield begin + at, lead, runs, grams[place[begin]]
