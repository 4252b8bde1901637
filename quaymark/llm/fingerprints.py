"""Fingerprints of byte strings at every position of many texts, and content-chosen anchors."""

import numpy as np

LENGTH = 100
GRAM = 32
#: Places an anchor of a string of LENGTH bytes can have.
PLACES = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_C, _D = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 19)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            line = np.full(size, base, np.uint64)
            line[0] = 1
            _powers[k] = np.cumprod(line, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _D
    return x ^ (x >> np.uint64(32))


class Stretch:
    """Bytes whose substrings can be named: ``name(a, b)`` is equal for equal bytes, wherever they lie."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.up, self.down = _up_to(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def name(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * _B)


def grams(data: np.ndarray) -> np.ndarray:
    """Names of the GRAM bytes from every position on, by doubling 8 to 16 to 32; short at the end by GRAM - 1."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.empty(n + 24, np.uint64)
    for k in range(8):
        want = len(range(k, n + 24, 8))
        eight[k::8] = np.frombuffer(padded, "<u8", want, k)
    sixteen = eight[: n + 16] * _A
    sixteen += eight[8 : n + 24] * _B
    sixteen ^= sixteen >> np.uint64(32)
    out = sixteen[:n] * _C
    out += sixteen[16 : n + 16] * _D
    out ^= out >> np.uint64(29)
    out *= _A
    out ^= out >> np.uint64(32)
    return out | np.uint64(1)


def _sliding(x: np.ndarray, pick) -> np.ndarray:
    """``pick`` over PLACES values from every position on; shorter by PLACES - 1."""
    width = 1
    while width * 2 <= PLACES:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = PLACES - width
    return pick(x[: len(x) - rest], x[rest:])


def anchors(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions whose name is the least among those a string of LENGTH bytes can have, for any string start.

    ``starts`` marks where such a string begins inside one text. Equal strings choose equal anchors.
    """
    if len(names) < PLACES:
        return np.zeros(0, np.int64)
    least = np.where(starts[: len(names) - PLACES + 1], _sliding(names, np.minimum), np.uint64(0))
    around = np.concatenate([np.zeros(PLACES - 1, np.uint64), least, np.zeros(PLACES - 1, np.uint64)])
    return np.flatnonzero(_sliding(around, np.maximum) == names)
