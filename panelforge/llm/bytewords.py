"""Words of whole Arrow batches as numpy arrays: no Python object is made for a word.

A batch is cut into slices of bounded bytes. Each slice gives the start and end of every word, the document
of each word, and prefix sums from which the 64-bit hash of any byte range of a word follows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Odd multipliers; their powers invert modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1


def fold_table(separators: bytes, lower: bool) -> bytes:
    """For bytes.translate: separators become spaces, and A-Z become a-z if wanted."""
    t = bytearray(range(256))
    if lower:
        for c in range(0x41, 0x5B):
            t[c] = c + 32
    for c in separators:
        t[c] = 0x20
    return bytes(t)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of a base and of its inverse modulo 2**64, extended when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_POWERS = [Powers(b) for b in BASES]


def windows_of(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values, in order."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[which].to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


class Slice:
    """Consecutive documents of a batch. ``first``: their place in the batch; ``words``: words of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.first, self.docs = data, first, len(bounds) - 1
        n = len(data)
        inside = np.zeros(n + 2, bool)
        np.not_equal(data, 0x20, out=inside[1 : n + 1])
        begins = inside[1:] & ~inside[:-1]  # at position i: a word starts at i
        ends = ~inside[1:] & inside[:-1]  # at position i: a word ends before i
        edges = bounds[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        touching = edges[inside[edges] & inside[edges + 1]]  # two documents meet without white space
        begins[touching] = True
        ends[touching] = True
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends)
        cuts = np.searchsorted(self.starts, bounds)
        self.bounds, self.cuts = bounds, cuts
        self.words = np.diff(cuts)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.words)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        up, down = _POWERS[0].to(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=out[1:])
        return out, down

    def hashes(self, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
        """Hashes of the words, then of their first bytes for each length (0 where a word is shorter)."""
        sums, down = self.sums()
        back = down[self.starts]
        out = [mix((sums[self.ends] - sums[self.starts]) * back)]
        for k in prefixes:
            h = mix((sums[np.minimum(self.starts + k, self.ends)] - sums[self.starts]) * back + np.uint64(k))
            h[self.ends - self.starts < k] = 0
            out.append(h)
        return out


_PLACES: list[np.ndarray] = []
FAR = 10  # bits of a byte's place in its word that the table of codes covers


def codes() -> np.ndarray:
    """A random-looking number for each byte at each of the first places of a word."""
    if not _PLACES:
        _PLACES.append(mix(np.arange(1 << FAR + 8, dtype=np.uint64) * np.uint64(BASES[0]) + np.uint64(BASES[1])))
    return _PLACES[0]


def word_codes(s: Slice) -> np.ndarray:
    """Hashes of the words of a slice: sums of a code for each byte and its place. Unlike powers of a base, the codes of
    different places have nothing to do with one another, so no pattern of letters makes two words equal."""
    inside = np.zeros(len(s.data) + 1, np.int64)
    inside[s.starts[1:]] = np.diff(s.starts)
    place = np.arange(len(s.data), dtype=np.int64) - np.cumsum(inside[:-1]) - (s.starts[0] if len(s.starts) else 0)
    np.maximum(place, 0, out=place)  # white space before the first word
    value = codes()[(place & (1 << FAR) - 1) << 8 | s.data]
    far = np.flatnonzero(place >> FAR)
    if len(far):
        value[far] = mix(value[far] ^ mix((place[far] >> FAR).astype(np.uint64)))
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix(sums[s.ends] - sums[s.starts])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls' rests, and where each row starts and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, separators: bytes = SPACE, lower: bool = False, most: int = 500_000) -> Iterator[Slice]:
    """The documents of a column in slices of about ``most`` bytes; a longer document has a slice of its own."""
    data, offsets = text_bytes(column)
    table, n, i = fold_table(separators, lower), len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        part = np.frombuffer(data[offsets[i] : offsets[j]].tobytes().translate(table), np.uint8)
        yield Slice(part, offsets[i : j + 1] - offsets[i], i)
        i = j
