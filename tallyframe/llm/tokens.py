"""Whole-batch word splitting and hashing with numpy, for Arrow string columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

M = 0x9E3779B97F4A7C15 | 1
M_INVERSE = pow(M, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: White space and ASCII punctuation.
BREAKS = WHITE.copy()
BREAKS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

LETTER = np.zeros(256, bool)
LETTER[[c for c in range(0x80) if chr(c).isalpha()]] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?")] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """hashes: of the words of all rows; row i has hashes[first[i]:first[i + 1]]; starts, ends: byte offsets."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words(offsets: np.ndarray, raw: np.ndarray, breaks: np.ndarray = WHITE, marks: bool = False) -> Words:
    """Words are runs of bytes that aren't breaks, A-Z lower-cased; none goes from one row into the next.

    marks: a punctuation mark between a letter and the word's end is a word of its own.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none)
    inside = ~breaks[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < n]
    begins[rows] = inside[rows]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = inside[last]
    if marks:
        alone = MARK[raw] & stops & ~begins
        alone[1:] &= LETTER[raw[:-1]]
        begins |= alone
        stops[:-1] |= alone[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers(M, n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(M_INVERSE, n)[starts])
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends)


def windows(hashes: np.ndarray, places: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """A hash of the words at i + place for every i at which all of them exist (rows aren't looked at)."""
    span = max(places) + 1
    n = max(0, len(hashes) - span + 1)
    out = np.full(n, (salt * 2 + 1) * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
    for place in places:
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += hashes[place : place + n]
    return mix(out)


def shingle_sets(w: Words, size: int = 5) -> list[np.ndarray]:
    """For each row its sorted distinct shingles; with fewer words the whole sequence is the only one."""
    every = windows(w.hashes, tuple(range(size)))
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(windows(w.hashes[a:b], tuple(range(b - a)), salt=int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
