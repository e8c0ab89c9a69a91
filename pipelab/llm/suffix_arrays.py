"""Suffix arrays of byte strings by induced sorting, in whole-array steps.

Suffixes are classed as smaller (S) or larger (L) than the one after them. The leftmost-smaller
ones (LMS: an S after an L) cut the string into substrings; once the suffixes that start there
are in order, two linear scans induce the order of all others, bucket by bucket of their first
byte. The LMS substrings are put in order by the same scans, named, and the suffixes of the
string of names are ranked by joining names to pairs, pairs to fours and so on, for those
names only that still occur twice. Within a bucket a scan goes in waves, one per repetition of
the bucket's byte, so all steps are array operations.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the empty suffix at the end is the smallest."""
    n = len(text)
    change = np.full(n, n - 1, np.int64)
    differs = np.flatnonzero(text[:-1] != text[1:])
    change[differs] = differs
    nxt = np.minimum.accumulate(change[::-1])[::-1]
    smaller = np.zeros(n, bool)
    inner = nxt < n - 1
    smaller[inner] = text[nxt[inner]] < text[nxt[inner] + 1]
    return smaller


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes ``lms`` in order."""
    n = len(text)
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    starts = ends - counts
    large = np.bincount(text[~smaller], minlength=256)
    out = np.empty(n, np.int32)
    first = lms[np.argsort(text[lms], kind="stable")]
    lms_counts = np.bincount(text[lms], minlength=256)
    lms_ends = np.cumsum(lms_counts)
    head = starts.copy()

    def place_large(before: np.ndarray, own: int) -> np.ndarray:
        """Puts the L suffixes among ``before`` into their buckets; returns those of bucket ``own``."""
        before = before[before >= 0]
        before = before[~smaller[before]]
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        n_each = np.bincount(chars, minlength=256)
        upto = np.cumsum(n_each)
        for c in np.flatnonzero(n_each):
            out[head[c] : head[c] + n_each[c]] = before[upto[c] - n_each[c] : upto[c]]
            head[c] += n_each[c]
        return before[upto[own] - n_each[own] : upto[own]]

    place_large(np.array([n - 1]), 0)  # the suffix before the empty one
    done = starts.copy()
    for c in range(256):
        if not counts[c]:
            continue
        while done[c] < head[c]:
            wave = out[done[c] : head[c]]
            done[c] = head[c]
            place_large(wave - 1, c)
        if lms_counts[c]:
            place_large(first[lms_ends[c] - lms_counts[c] : lms_ends[c]] - 1, c)

    tail = ends.copy()

    def place_small(before: np.ndarray) -> None:
        """``before`` in falling order; S suffixes go to the ends of their buckets."""
        before = before[before >= 0]
        before = before[smaller[before]]
        chars = text[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        n_each = np.bincount(chars, minlength=256)
        upto = np.cumsum(n_each)
        for c in np.flatnonzero(n_each):
            out[tail[c] - n_each[c] : tail[c]] = before[upto[c] - n_each[c] : upto[c]][::-1]
            tail[c] -= n_each[c]

    seen = ends.copy()
    for c in range(255, -1, -1):
        if not counts[c]:
            continue
        while seen[c] > tail[c]:
            wave = out[tail[c] : seen[c]][::-1]
            seen[c] = tail[c]
            place_small(wave - 1)
        lows = out[starts[c] : starts[c] + large[c]]
        place_small(lows[::-1] - 1)
    return out


def _names(text: np.ndarray, ordered: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Names, equal for equal substrings and in their order, of the LMS substrings at ``positions``."""
    n = len(text)
    slot = np.zeros(n + 1, np.int64)
    slot[positions] = np.arange(len(positions))
    rank = slot[ordered]
    ends = np.append(positions[1:], n - 1)  # a substring takes in the first byte of the next one
    lengths = (ends - positions + 1)[rank]
    last = rank == len(positions) - 1  # only this one reaches the end of the string
    pair = np.flatnonzero((lengths[1:] == lengths[:-1]) & ~last[1:] & ~last[:-1])
    same = np.zeros(len(ordered), bool)
    for at in range(0, len(pair), 1 << 19):
        some = pair[at : at + (1 << 19)]
        size = lengths[some]
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        equal = text[np.repeat(ordered[some], size) + offset] == text[np.repeat(ordered[some + 1], size) + offset]
        same[some + 1] = np.logical_and.reduceat(equal, np.cumsum(size) - size) if len(some) else False
    names = np.empty(len(positions), np.int64)
    names[rank] = np.cumsum(~same) - 1
    return names


def _order_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by ranks of 1, 2, 4, ... names."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    width = 1
    # The rank of a group is the place of its first member.
    groups = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(groups, np.arange(n), 0))
    while True:
        starts = np.flatnonzero(groups)
        size = np.diff(np.append(starts, n))
        loose = np.repeat(size > 1, size)
        if not loose.any():
            return order
        at = np.flatnonzero(loose)
        members = order[at]
        after = members + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[members]
        key = first * (n + 1) + second
        by = np.argsort(key, kind="stable")
        members, key, first = members[by], key[by], first[by]
        order[at] = members
        groups[at] = np.concatenate(([True], key[1:] != key[:-1]))
        fresh = np.where(groups[at], at, 0)
        rank[members] = np.maximum.accumulate(fresh)
        width *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (uint8) in ascending order."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = _types(text)
    positions = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(positions) < 2:
        return _induce(text, smaller, positions)
    rough = _induce(text, smaller, positions)
    is_lms = np.zeros(n, bool)
    is_lms[positions] = True
    ordered = rough[is_lms[rough]].astype(np.int64)
    names = _names(text, ordered, positions)
    return _induce(text, smaller, positions[_order_of_names(names)])


def permuted_lcp(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Longest common prefix of every suffix, in text order, with the one before it in the array.

    Where both are preceded by the same byte the value is that of the position before less 1;
    only the other positions are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    place = np.arange(n)
    reducible = (before > 0) & (place > 0)
    reducible[reducible] = text[place[reducible] - 1] == text[before[reducible] - 1]
    # Values carry over only from a neighbour that was compared with the neighbouring suffix.
    reducible[1:] &= before[:-1] == before[1:] - 1
    own = np.flatnonzero(~reducible & (before >= 0))
    lcp = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    alive = own
    while len(alive):
        a, b = alive + lcp[alive], before[alive] + lcp[alive]
        x = np.ascontiguousarray(words[np.minimum(a, n)]).view(np.uint64).ravel()
        y = np.ascontiguousarray(words[np.minimum(b, n)]).view(np.uint64).ravel()
        diff = x ^ y
        low = diff & (~diff + np.uint64(1))
        step = np.where(diff == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        room = n - np.maximum(a, b)
        lcp[alive] += np.minimum(step, room)
        alive = alive[(step == 8) & (room > 8)]
    source = np.maximum.accumulate(np.where(reducible, 0, place))
    return np.maximum(lcp[source] - (place - source), 0) * (before >= 0)
