"""Suffix arrays by induced sorting, with arrays for scans.

The text is classified into S and L suffixes; leftmost S (LMS) substrings are sorted by inducing and named; equal names
are resolved on the string of names, by the same induced sorting while its alphabet is small, and by doubling ranks
beyond that; then the order of all suffixes is induced. The left-to-right and right-to-left scans go bucket by bucket:
what a block of a bucket induces is dealt out by one stable counting sort, and a run of one symbol takes one block for
each of its repeats.
"""

from __future__ import annotations

import numpy as np

#: Symbols above which names are ordered by doubling: a scan takes a step for each symbol.
ALPHABET = 1024


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True for S: the suffix is less than the next one. The last symbol is unique and least."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    rising = t[change] < t[change + 1]
    lengths = np.diff(np.concatenate(([-1], change)))
    return np.append(np.repeat(rising, lengths), True) if n > 1 else np.ones(n, bool)


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The order of all suffixes from LMS positions that stand in order (of their first symbols, at least)."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    begins = ends - counts
    order = np.full(n, -1, np.int32)
    at = np.searchsorted(t[lms], np.arange(size + 1))
    symbols = np.flatnonzero(counts).tolist()
    small = t if t.dtype.itemsize <= 2 else t.astype(np.uint16)

    def dealt(block: np.ndarray, to_s: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        before = block[block > 0] - 1
        before = before[s_type[before] == to_s]
        chars = small[before]
        by = np.argsort(chars, kind="stable")
        chars, before = chars[by], before[by]
        new = np.flatnonzero(np.concatenate((chars[:1] == chars[:1], chars[1:] != chars[:-1])))
        much = np.diff(np.append(new, len(chars)))
        return before, chars[new].astype(np.int64), much, np.arange(len(chars)) - np.repeat(new, much)

    head = begins.copy()
    for c in symbols:
        done = begins[c]
        while True:
            block = order[done : head[c]]
            if not len(block):
                break
            done = head[c]
            before, to, much, rank = dealt(block, False)
            if len(before):
                order[np.repeat(head[to], much) + rank] = before
                head[to] += much
        before, to, much, rank = dealt(lms[at[c] : at[c + 1]], False)
        if len(before):
            order[np.repeat(head[to], much) + rank] = before
            head[to] += much
    tail = ends.copy()
    for c in reversed(symbols):
        done = ends[c]
        while True:
            block = order[tail[c] : done][::-1]
            if not len(block):
                break
            done = tail[c]
            before, to, much, rank = dealt(block, True)
            if len(before):
                order[np.repeat(tail[to], much) - 1 - rank] = before
                tail[to] -= much
        before, to, much, rank = dealt(order[begins[c] : head[c]][::-1], True)
        if len(before):
            order[np.repeat(tail[to], much) - 1 - rank] = before
            tail[to] -= much
    order[0] = n - 1
    return order


def doubled(t: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of t by their first `depth` symbols at least, by doubling ranks of what is still tied."""
    n, width = len(t), 1
    order = np.argsort(t, kind="stable")
    first = t[order]
    begin = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    size = np.diff(np.append(begin, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begin, size)  # a group's rank is where it begins
    tied = np.flatnonzero(np.repeat(size > 1, size))
    while len(tied) and width < depth:
        pos = order[tied]
        after = np.where(pos + width < n, rank[np.minimum(pos + width, n - 1)], -1)
        first = rank[pos]
        by = np.argsort(first * np.int64(n + 1) + after + 1, kind="stable")
        pos, first, after = pos[by], first[by], after[by]
        order[tied] = pos
        begin = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (after[1:] != after[:-1]))))
        size = np.diff(np.append(begin, len(tied)))
        rank[pos] = np.repeat(tied[begin], size)
        tied = tied[np.repeat(size > 1, size)]
        width *= 2
    return order


def suffix_array(t: np.ndarray, size: int, depth: int | None = None) -> np.ndarray:
    """The suffixes of t in order; t has symbols below `size` and ends with its only 0. depth: as many symbols of each
    suffix as matter at least; further ones may be left unsorted."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    s_type = suffix_types(t)
    is_lms = np.append(False, s_type[1:] & ~s_type[:-1])
    lms = np.flatnonzero(is_lms).astype(np.int32)
    order = induce(t, s_type, lms[np.argsort(t[lms], kind="stable")], size)
    by_substring = order[is_lms[order]]
    index = np.empty(n, np.int32)
    index[lms] = np.arange(len(lms), dtype=np.int32)
    length = np.append(np.diff(lms), 0)[index[by_substring]]  # up to the next one, inclusive: one more
    equal = np.zeros(len(by_substring), bool)
    live = np.flatnonzero(length[1:] == length[:-1]) + 1
    k = 0
    while len(live):
        a, b = by_substring[live - 1] + k, by_substring[live] + k
        live = live[t[a] == t[b]]
        over = length[live] <= k
        equal[live[over]] = True
        live = live[~over]
        k += 1
    equal[by_substring == n - 1] = False
    names = np.empty(len(lms), np.int64)
    names[index[by_substring]] = np.cumsum(~equal) - 1
    many = int(names.max()) + 1
    if many == len(lms):
        sorted_lms = by_substring
    else:
        most = len(lms) if depth is None else depth // 2 + 1  # each name but the last has two symbols or more
        inner = suffix_array(names, many, most) if many <= ALPHABET else doubled(names, most)
        sorted_lms = lms[inner]
    return induce(t, s_type, sorted_lms, size)


def permuted_lcp(t: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """For each position in `order` (any part of a suffix array), in the order of the text: the length, up to `most`, of
    the prefix it shares with its predecessor. Eight symbols are compared at a time."""
    padded = t + bytes(8)
    eights = np.ndarray((len(t) + 1,), "<u8", padded, strides=(1,)).copy()
    phi = np.full(len(t), -1, np.int64)
    phi[order[1:]] = order[:-1]
    out = np.zeros(len(t), np.int32)
    live = np.flatnonzero(phi >= 0)
    at = 0
    while len(live) and at < most:
        inside = np.maximum(live, phi[live]) + at < len(t)
        live = live[inside]
        diff = eights[live + at] ^ eights[phi[live] + at]
        same = diff == 0
        low = diff[~same] & (~diff[~same] + np.uint64(1))
        out[live[~same]] = at + (np.bitwise_count(low - np.uint64(1)) >> 3)
        live = live[same]
        at += 8
        out[live] = at
    return np.minimum(out, most)
