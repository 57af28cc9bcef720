"""Suffix arrays of byte strings by induced sorting, in numpy.

Suffixes are classified as S (smaller than the next one) or L; the leftmost S suffixes of each run (LMS) are sorted first,
and all others are induced from them: L suffixes bucket by bucket from the least byte up, S suffixes from the greatest
down. Inducing visits each suffix once and handles a bucket at a time: what a bucket adds to itself in rounds,
what it adds to others in one stable distribution. LMS substrings are sorted by the same inducing and named; if
names repeat, the string of names is sorted in turn: by the same inducing where its alphabet is small (SYMBOLS), else by doubling distances
over names that still repeat, as inducing takes a numpy step for each symbol.
"""

from __future__ import annotations

import numpy as np


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is S."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    rise[-1] = 1
    at = np.where(rise != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rise[at] > 0


def induce(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes' order from the LMS suffixes in order; if these are ordered by their first byte only, then the order
    that results is that by LMS substrings."""
    n = len(text)
    starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet)))).astype(np.int64)
    out = np.full(n, -1, np.int32)
    head, tail = starts[:-1].copy(), starts[1:].copy()
    lms_at = np.concatenate(([0], np.cumsum(np.bincount(text[lms], minlength=alphabet))))

    def deal(places: np.ndarray, up: bool) -> None:
        """Places go to the next free cells of their bytes' buckets, in order."""
        byte = text[places]
        order = np.argsort(byte, kind="stable")
        byte = byte[order]
        first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        size = np.diff(np.append(first, len(byte)))
        rank = np.arange(len(byte)) - np.repeat(first, size)
        if up:
            out[head[byte] + rank] = places[order]
            head[byte[first]] += size
        else:
            out[tail[byte] - 1 - rank] = places[order]
            tail[byte[first]] -= size

    for c in range(alphabet):
        if starts[c] == starts[c + 1]:
            continue
        onward, low = [], starts[c]
        while low < head[c]:  # what the bucket holds, and then what it adds to itself
            own = out[low : head[c]]
            low = head[c]
            before = own[own > 0] - 1
            before = before[~s_type[before]]
            same = text[before] == c
            mine = before[same]
            out[low : low + len(mine)] = mine
            head[c] += len(mine)
            onward.append(before[~same])
        before = lms[lms_at[c] : lms_at[c + 1]]
        onward.append(before[before > 0] - 1)
        onward = np.concatenate(onward)
        if len(onward):
            deal(onward, True)
    for c in range(alphabet - 1, -1, -1):
        if starts[c] == starts[c + 1]:
            continue
        onward, high = [], starts[c + 1]
        if c == text[n - 1] and high - starts[c] == 1:  # nothing follows the last suffix, so nothing induces it
            tail[c] = starts[c]
            out[tail[c]] = n - 1
        while high > tail[c]:
            own = out[tail[c] : high][::-1]
            high = tail[c]
            before = own[own > 0] - 1
            before = before[s_type[before]]
            same = text[before] == c
            mine = before[same]
            out[high - len(mine) : high] = mine[::-1]
            tail[c] -= len(mine)
            onward.append(before[~same])
        own = out[starts[c] : head[c]][::-1]
        before = own[own > 0] - 1
        onward.append(before[s_type[before]])
        onward = np.concatenate(onward)
        if c == text[n - 1] and out[starts[c]] < 0:
            out[starts[c]] = n - 1
        if len(onward):
            deal(onward, False)
    return out


def refine(rank: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names, names being ranks of equal symbols (the least place of each in the order)."""
    n = len(rank)
    rank = rank.astype(np.int64)
    live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    step = 1
    while len(live):
        after = live + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key, at = key[order], live[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        old = rank[at]
        begin = np.concatenate(([True], old[1:] != old[:-1]))
        i = np.arange(len(at))
        inside = i - np.maximum.accumulate(np.where(begin, i, 0))
        new = old + np.maximum.accumulate(np.where(fresh, i, 0)) - (i - inside)
        rank[at] = new
        lone = fresh & np.concatenate((fresh[1:], [True]))
        live = np.sort(at[~lone])
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


#: Names that recursion takes at most, and how often each has to repeat on average.
SYMBOLS, REPEATED = 4096, 64


def sort_names(rank: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names whose last one occurs once."""
    values, text = np.unique(rank, return_inverse=True)
    if len(values) <= SYMBOLS and len(values) * REPEATED <= len(rank):
        return induced(text.astype(np.int32), len(values), zeros=False)
    return refine(rank)


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """text: strings of integers from 1 to alphabet - 1, none of them empty, with a 0 after each; zeros count as different
    from one another, in the order of their places."""
    return induced(text, alphabet, zeros=True)


def induced(text: np.ndarray, alphabet: int, zeros: bool) -> np.ndarray:
    """zeros: as above; else a string of any integers from 0 on whose last one occurs once."""
    n = len(text)
    placed = place_zeros if zeros else lambda order, _: order
    s_type = s_types(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if not len(lms):
        return placed(induce(text, s_type, lms, alphabet), text)
    by_byte = lms[np.argsort(text[lms], kind="stable")]
    order = placed(induce(text, s_type, by_byte, alphabet), text)
    order = order[is_lms[order]]
    length = np.empty(n, np.int32)
    length[lms[:-1]] = np.diff(lms)
    length[lms[-1]] = n - 1 - lms[-1]
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (text[a] == text[b])
    if zeros:
        same &= text[a] != 0
    live, o = np.flatnonzero(same), 1
    while len(live):
        unlike = text[np.minimum(a[live] + o, n - 1)] != text[np.minimum(b[live] + o, n - 1)]
        same[live[unlike]] = False
        live = live[~unlike & (o < length[a[live]])]
        o += 1
    fresh = np.concatenate(([True], ~same))
    name = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    slot = np.empty(n, np.int32)
    slot[lms] = np.arange(len(lms))
    rank = np.empty(len(lms), np.int64)
    rank[slot[order]] = name
    return placed(induce(text, s_type, lms[sort_names(rank)], alphabet), text)


def place_zeros(order: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Zeros lead, in the order of their places; nothing that was induced hangs on theirs."""
    zeros = np.flatnonzero(text == 0)
    order[: len(zeros)] = zeros
    return order


def permuted_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """The permuted array of common prefixes: by the place in the text of each marked start, how many bytes (`most` at most) it has in common
    with the marked suffix that comes before it in suffix order; 0 for the others. data: uint8, longer by 8 bytes than what is read; every
    marked suffix has `most` bytes of its own."""
    ranked = order[starts[order]]
    before = np.full(len(data), -1, np.int32)
    before[ranked[1:]] = ranked[:-1]
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    common = np.zeros(len(data), np.int32)
    live = np.flatnonzero(before >= 0).astype(np.int32)
    for o in range(0, most, 8):
        unlike = words[live + o] ^ words[before[live] + o]
        ended = unlike != 0
        low = unlike[ended]
        # bytes before the first one that differs: zeros below the lowest bit that is set
        common[live[ended]] = o + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        live = live[~ended]
    common[live] = most
    return np.minimum(common, most)
