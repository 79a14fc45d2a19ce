"""Sets of word n-grams as sorted 64-bit hashes, computed for many texts at once.

Words are runs of bytes other than ASCII white space, after lower-casing A-Z. A text
with fewer words than n has its whole sequence as its one n-gram; without words, none.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the place of each text's first word, with the
    number of words at the end. Equal words have equal hashes wherever they stand."""
    data = [t.encode().lower() for t in texts]
    buf = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    white = _SPACE[buf]
    inner = ~white
    starts = np.flatnonzero(inner & np.concatenate([[True], white[:-1]]))
    ends = np.flatnonzero(inner & np.concatenate([white[1:], [True]])) + 1
    powers = np.full(len(buf) + 1, _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[buf] * powers[:-1])])
    # The word's place drops out when its sum is divided by the power at its start.
    back = np.full(len(buf) + 1, _INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))
    sizes = np.array([len(d) + 1 for d in data])
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, firsts


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """For each text, its distinct n-grams as sorted hashes."""
    words, firsts = word_hashes(texts)
    grams = np.zeros(max(len(words) - n + 1, 0), _U)
    for k in range(n):
        grams = mix(grams * _U(0xD6E8FEB86659FD93) + words[k:k + len(grams)])
    out = []
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            whole = np.full(1, b - a, _U)
            for word in words[a:b]:
                whole = mix(whole * _U(0xC2B2AE3D27D4EB4F) + word)
            out.append(whole)
        else:
            out.append(np.zeros(0, _U))
    return out
