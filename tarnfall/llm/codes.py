"""Texts of an Arrow batch as one array of code points, and rolling hashes over it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Stands between texts; it occurs in none of them.
SEPARATOR = 0x110000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread values for close inputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a separator after each; and the starts of the texts, with the end."""
    data = "\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(data, dtype="<u4").copy()
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    codes[starts[1:] - 1] = SEPARATOR
    return codes, starts


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: whether it is a letter or a digit; the separator counts."""
    table = np.fromiter((chr(c).isalnum() for c in range(SEPARATOR)), dtype=bool, count=SEPARATOR)
    return np.append(table, True)


class Rolling:
    """Hashes of all windows of any width over one array, from one prefix sum modulo 2**64."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers = np.full(n, _MULTIPLIER, dtype=np.uint64)
        self._undo = np.full(n, _INVERSE, dtype=np.uint64)
        if n:
            powers[0] = self._undo[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self._undo, out=self._undo)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers, out=self._sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """The hash of the window that starts at each place; windows over a separator included."""
        n = len(self._sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return (self._sums[width:] - self._sums[:n]) * self._undo[:n]
