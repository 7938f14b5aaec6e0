"""Words of an Arrow batch of texts: each distinct word once, and for every row the numbers of its words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed values of the 64-bit finaliser.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Base of the rolling sums.
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most: int = 1 << 20) -> list[tuple[int, int]]:
    """``(low, high)`` of neighbouring rows that hold about ``most`` bytes together, or one row that holds more."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // most)) + 1 if len(ends) else []
    return [(int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(ends)]) if b > a]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``(bounds, index, words)``: row ``r`` consists of ``words[i]`` for ``i`` in ``index[bounds[r]:bounds[r + 1]]``.

    A word is a run of anything but ``[\\x20\\x09-\\x0D]``; a null row has none.
    """
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    found = parts.flatten().dictionary_encode()
    words, index = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
    bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    if "" in words:  # before the first and after the last word of a row
        full = index != words.index("")
        index, bounds = index[full], np.concatenate([[0], np.cumsum(full)])[bounds]
    return bounds, index.astype(np.int64), words


def codes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


class Rolling:
    """Hashes of all stretches of ``n`` neighbouring values by prefix sums; sums wrap at 64 bits."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, x: np.ndarray, n: int) -> np.ndarray:
        if len(x) < n:
            return np.zeros(0, np.uint64)
        if len(self.up) <= len(x):
            powers = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(x), base, np.uint64)]))
            self.up, self.down = powers(BASE), powers(pow(BASE, -1, 1 << 64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.up[:len(x)])])
        return mix((total[n:] - total[:-n]) * self.down[:len(x) - n + 1])


def slide(f: np.ufunc, x: np.ndarray, n: int) -> np.ndarray:
    """``f`` (minimum or maximum) over all stretches of ``n`` neighbouring values."""
    width = 1
    while 2 * width <= n:
        x, width = f(x[:len(x) - width], x[width:]), 2 * width
    return f(x[:len(x) - (n - width)], x[n - width:]) if n > width else x
