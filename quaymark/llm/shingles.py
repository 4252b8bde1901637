"""Sets of word shingles as 64-bit hashes, computed for many texts at once."""

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_CHAIN = 0xC2B2AE3D27D4EB4F | 1
_SLICE = 1 << 22
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in a stretch of bytes."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return starts, mixed((sums[ends] - sums[starts]) * down[starts] + length * np.uint64(_CHAIN))


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts), np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, hashes = _word_hashes(data)
    cuts = np.searchsorted(starts, begin)
    chain = np.uint64(1)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width):
        rolled += hashes[j : j + len(rolled)] * chain
        chain = np.uint64((int(chain) * _CHAIN) & 0xFFFFFFFFFFFFFFFF)
    rolled = mixed(rolled)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:  # fewer words than a shingle: all of them together
            power = np.cumprod(np.full(b - a, _CHAIN, np.uint64), dtype=np.uint64)
            out.append(mixed((hashes[a:b] * power).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; words are what ASCII white space separates."""
    out: list[np.ndarray] = []
    waiting: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "replace")
        waiting.append(data)
        size += len(data)
        if size >= _SLICE:
            out += _sets(waiting, width)
            waiting, size = [], 0
    return out + (_sets(waiting, width) if waiting else [])
