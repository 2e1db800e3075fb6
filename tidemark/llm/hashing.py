"""Word and n-gram hashes of whole batches of texts, without a Python step per word.

A word is a run of bytes that are no ASCII white space, A-Z in lower case: the words of the
contracts. Its hash is a polynomial of random 64-bit values of its bytes, finally mixed;
it's taken from running sums over the batch's bytes, so a word costs what its bytes do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes that are hashed at once; a longer text is hashed alone.
STEP = 1 << 20

_rng = np.random.default_rng(20240517)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES[_SPACE] = 0
_FACTOR = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor and of its inverse modulo 2 ** 64."""
    if n <= STEP + 1:
        n = STEP + 1
    if n not in _powers:
        both = []
        for f in (_FACTOR, pow(_FACTOR, -1, 2**64)):
            p = np.full(n, f, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > STEP + 1:
            return both[0], both[1]
        _powers[n] = (both[0], both[1])
    return _powers[n]


def release() -> None:
    """Give up the powers that this worker holds; they are made anew when needed."""
    _powers.clear()


def _hashed(raw: list[bytes]) -> list[np.ndarray]:
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    up, down = _powers_up_to(len(buf))
    sums = np.cumsum(_VALUES[buf] * up[: len(buf)], dtype=np.uint64)
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # the byte before each word, and its last
    before, last = edge[::2], edge[1::2]
    h = mixed((sums[last] - sums[before]) * down[before + 1] + (last - before).astype(np.uint64))
    starts = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return np.split(h, np.searchsorted(before, starts[1:-1] - 1))


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    held: list[bytes] = []
    n = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "replace")
        if held and n + len(raw) + 1 > STEP - 2:
            yield from _hashed(held)
            held, n = [], 0
        held.append(raw)
        n += len(raw) + 1
    if held:
        yield from _hashed(held)


def gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """The hashes of a text's n-grams, in order; fewer words than width are one n-gram."""
    if not len(h):
        return h
    n, k = max(1, len(h) - width + 1), min(width, len(h))
    g = np.full(n, k, np.uint64)
    for i in range(k):
        g = mixed(g * np.uint64(0x100000001B3) + h[i : i + n])
    return g
