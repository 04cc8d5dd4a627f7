"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Suffixes are classified as larger or smaller than the next one. The substrings between leftmost
smaller suffixes are sorted by one induction and named in order; while names repeat, the string of
names is sorted recursively; a second induction from the sorted leftmost smaller suffixes gives the
whole array. An induction goes through the buckets of the first symbol. What a bucket induces is
dealt to the later buckets in one vectorised step, and what it induces into itself in further ones,
of which there are as many as the longest run of that symbol, so the work stays linear.

The string of names has a large alphabet with few suffixes in each bucket. Its recursion therefore
names pairs of names, pairs of pairs and so on, until all names differ.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol is the unique least."""
    n = len(t)
    smaller = np.empty(n, dtype=bool)
    smaller[-1] = True
    change = np.flatnonzero(t[:-1] != t[1:])
    rises = t[change] < t[change + 1]
    smaller[:-1] = np.repeat(rises, np.diff(np.concatenate([[-1], change])))[: n - 1]
    return smaller


def _induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of all suffixes from that of the seeds (leftmost smaller ones)."""
    n, k = len(t), len(sizes)
    heads = np.cumsum(sizes) - sizes
    larger_count = np.bincount(t[~smaller], minlength=k)
    order = np.empty(n, dtype=np.int32)
    # Seeds of each bucket, in order.
    dealt = np.argsort(t[seeds], kind="stable")
    seeds = seeds[dealt]
    seed_ends = np.cumsum(np.bincount(t[seeds], minlength=k))
    front = heads.copy()

    def place(found: np.ndarray, ends: np.ndarray, forward: bool) -> None:
        """Append to the buckets of their symbols, in order."""
        symbols = t[found]
        by = np.argsort(symbols, kind="stable")
        found, symbols = found[by], symbols[by]
        counts = np.bincount(symbols, minlength=k)
        present = np.flatnonzero(counts)
        got = counts[present]
        within = np.arange(len(found)) - np.repeat(np.cumsum(got) - got, got)
        if forward:
            order[np.repeat(ends[present], got) + within] = found
            ends[present] += got
        else:
            order[np.repeat(ends[present], got) - 1 - within] = found
            ends[present] -= got

    for c in np.flatnonzero(sizes).tolist():
        at = int(heads[c])
        while at < front[c]:  # what was induced so far, and what that induces into this bucket
            part = order[at : int(front[c])]
            at = int(front[c])
            before = part[part > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                place(before, front, True)
        own = seeds[(seed_ends[c - 1] if c else 0) : seed_ends[c]]
        before = own[own > 0] - 1
        if len(before):
            place(before[~smaller[before]], front, True)
    back = heads + sizes
    for c in np.flatnonzero(sizes).tolist()[::-1]:
        at = int(back[c])  # smaller suffixes stand at the end of a bucket, filled from the back
        top = int(heads[c] + sizes[c])
        at = top
        while at > back[c]:
            part = order[int(back[c]) : at][::-1]
            at = int(back[c])
            before = part[part > 0] - 1
            before = before[smaller[before]]
            if len(before):
                place(before, back, False)
        part = order[int(heads[c]) : int(heads[c] + larger_count[c])][::-1]
        before = part[part > 0] - 1
        before = before[smaller[before]]
        if len(before):
            place(before, back, False)
    order[0] = n - 1
    return order


def _named(t: np.ndarray, lms: np.ndarray, order: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Names of the substrings from each leftmost smaller suffix to the next, in their sorted order."""
    place = np.full(len(t), -1, dtype=np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    ranked = place[order]
    ranked = ranked[ranked >= 0]  # numbers of the substrings in sorted order
    lengths = np.diff(np.append(lms, len(t) - 1)) + 1
    a, b = ranked[:-1], ranked[1:]
    same = lengths[a] == lengths[b]
    at = np.flatnonzero(same)
    step = 0
    while len(at):  # compare the rest, one symbol further each time
        left, right = lms[a[at]] + step, lms[b[at]] + step
        keep = t[left] == t[right]
        same[at[~keep]] = False
        at = at[keep]
        step += 1
        at = at[lengths[a[at]] > step]
    names = np.empty(len(lms), dtype=np.int64)
    names[ranked] = np.cumsum(np.concatenate([[0], ~same]))
    return names


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: recursion over pairs of names.

    A rank is the number of suffixes that are smaller by the names compared so far; only suffixes
    that share one are told apart further, by the rank of what follows.
    """
    n, reach = len(names), 1
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    while True:
        shared = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(shared):
            return np.argsort(rank)
        follows = shared + reach
        second = np.where(follows < n, rank[np.minimum(follows, n - 1)] + 1, 0)
        key = rank[shared] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key, own = key[by], rank[shared][by]
        index = np.arange(len(by))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), index, 0))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), index, 0))
        rank = rank.copy()
        rank[shared[by]] = own + start - group
        reach *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of symbols 0..k whose last symbol 0 is the only one."""
    sizes = np.bincount(t)
    smaller = classify(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return _induce(t, smaller, lms, sizes)
    names = _named(t, lms, _induce(t, smaller, lms, sizes), smaller)
    ranked = np.argsort(names) if names.max() + 1 == len(names) else _rank_names(names)
    return _induce(t, smaller, lms[ranked], sizes)


def permuted_lcp(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position the common prefix with the suffix before it in order, over symbols below 2^15.

    A value is at least the one before it less one; only where the symbols before two neighbours
    differ must it be counted anew, and those counts are linear together.
    """
    n = len(t)
    before = np.empty(n, dtype=np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    position = np.arange(n)
    anew = (before <= 0) | (position == 0)
    rest = np.flatnonzero(~anew)
    anew[rest] = t[rest - 1] != t[before[rest] - 1]
    anew &= before >= 0
    plcp = np.full(n, -1, dtype=np.int64)
    active = np.flatnonzero(anew)
    plcp[before < 0] = 0
    length = np.zeros(len(active), dtype=np.int64)
    # Four symbols at a time, then one; past the end nothing agrees.
    single = np.concatenate([t.astype(np.uint64), np.full(8, 1 << 15, dtype=np.uint64)])
    fours = single[:-3] | single[1:-2] << np.uint64(16) | single[2:-1] << np.uint64(32) | single[3:] << np.uint64(48)
    index, other = np.arange(len(active)), before[active]
    for symbols, width in ((fours, 4), (single, 1)):
        while len(index):
            i = active[index] + length[index]
            same = symbols[np.minimum(i, n + 4)] == symbols[np.minimum(other[index] + length[index], n + 3)]
            index = index[same]
            length[index] += width
        index = np.arange(len(active))
    plcp[active] = length
    # The others go down by one from the last count before them.
    known = np.flatnonzero(plcp >= 0)
    last = known[np.searchsorted(known, position, side="right") - 1]
    return np.maximum(plcp[last] - (position - last), 0)
