"""Hashes of any stretch of a sequence from one prefix sum, on arrays.

A stretch's hash is the sum of value[x_j] * base^j over it, divided by base^start, modulo 2^64, and mixed.
The values of the symbols are random 64-bit numbers, and two families with other values and bases make 128 bits.
"""

import numpy as np

MASK = (1 << 64) - 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SEGMENT = 1 << 18


def mix(x):
    """Spread every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """One family of hashes."""

    def __init__(self, seed):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 1
        self.step = np.ones(1, dtype=np.uint64)
        self.back = np.ones(1, dtype=np.uint64)

    def _powers(self, n):
        if len(self.step) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("step", self.base), ("back", pow(self.base, -1, 1 << 64))):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def prefix(self, symbols):
        """Sums before each place. `symbols`: bytes as uint8, or 64-bit numbers used as they are."""
        n = len(symbols)
        self._powers(n + 1)
        values = self.values[symbols] if symbols.dtype == np.uint8 else symbols
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.step[:n], out=sums[1:])
        return sums

    def stretches(self, sums, starts, ends):
        return mix((sums[ends] - sums[starts]) * self.back[starts])

    def windows(self, sums, width):
        """Hash of the `width` symbols from each place on."""
        n = max(0, len(sums) - width)
        return mix((sums[width:] - sums[:n]) * self.back[:n])


FIRST, SECOND = Rolling(11), Rolling(23)
OVER_FIRST, OVER_SECOND = Rolling(37), Rolling(53)


def word_bounds(codes):
    """Starts and ends of the runs of bytes that are no white space."""
    inside = ~SPACE[codes]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(codes, families=(FIRST, SECOND)):
    """(starts, ends, one array of hashes per family) of the words in a byte array.

    Long arrays are taken in stretches that end between words, so that working memory stays small.
    """
    starts, ends = word_bounds(codes)
    hashes = [np.empty(len(starts), dtype=np.uint64) for _ in families]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SEGMENT)))
        low, high = int(starts[at]), int(ends[to - 1])
        for family, out in zip(families, hashes):
            sums = family.prefix(codes[low:high])
            out[at:to] = family.stretches(sums, starts[at:to] - low, ends[at:to] - low)
        at = to
    return starts, ends, hashes


class Texts:
    """The whole texts of one chunk, laid one behind the other with a line break between them.

    Rows of a group come in any order; whoever asks again about a chunk sorts its table first.
    """

    def __init__(self, column, lower=False):
        self.parts = [b"" if t is None else t.encode("utf-8") for t in column.to_pylist()]
        if lower:
            self.parts = [p.lower() for p in self.parts]  # of bytes: A-Z only
        self.codes = np.frombuffer(b"\n".join(self.parts), dtype=np.uint8)
        lengths = np.array([len(p) for p in self.parts], dtype=np.int64)
        self.lengths = lengths
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(lengths) else lengths

    def row_of(self, places):
        return np.searchsorted(self.offsets, places, side="right") - 1
