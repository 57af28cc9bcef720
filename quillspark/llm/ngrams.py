"""Hashed n-grams and words of whole texts, for all texts of a block at once in numpy."""

from __future__ import annotations

import numpy as np

from .common import mix

BASE = 0x9E3779B97F4A7C15
MOD = 1 << 64
UNBASE = pow(BASE, -1, MOD)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n modulo 2**64, and those of its inverse."""
    if len(_powers[0]) <= n:
        for k, x in enumerate((BASE, UNBASE)):
            row = np.full(n + 1, x, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def slice_hashes(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each flat[begin:end]; equal bytes (or code points) have equal hashes wherever they stand."""
    up, down = powers(len(flat))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs where `inside` holds; no run crosses a text's begin (at)."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[(at > 0) & (at < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def characters(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where texts begin among them."""
    begin = np.flatnonzero((flat & 0xC0) != 0x80)
    code = flat[begin].astype(np.uint32)
    if len(begin) == len(flat):
        return code, at
    more = (code >= 0xC0).astype(np.int8) + (code >= 0xE0) + (code >= 0xF0)
    code &= np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint32)[more]
    for k in range(1, 4):
        own = np.flatnonzero(more >= k)
        code[own] = code[own] << np.uint32(6) | flat[np.minimum(begin[own] + k, len(flat) - 1)] & np.uint32(0x3F)
    return code, np.searchsorted(begin, at)


def lower_latin(flat: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (two bytes in UTF-8) in lower case."""
    out = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)
    if len(flat) > 1:
        capital = (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97)
        out[1:][capital] += np.uint8(32)
    return out


def no_cross(index: np.ndarray, at: np.ndarray, n: int, void: int) -> np.ndarray:
    """index of the n-grams by their first byte, with `void` for those that don't lie within one text."""
    for k in range(1, n):
        edge = at[1:] - k
        index[edge[edge >= 0]] = void
    return index
