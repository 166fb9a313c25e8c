"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller (LMS)
substrings by inducing, names them, sorts the names recursively, and induces
the whole array from the sorted LMS suffixes. A bucket's suffixes are induced
together with numpy, bucket by bucket. So that there are few buckets in the
recursion too, where a name may have one of very many values, each name is
written there as two symbols, its upper and lower half: suffixes that begin with
whole names stay in the order of the names. Strings of up to SHORT names are
sorted symbol by symbol. All of it takes linear time.

``permuted_prefixes`` finds, in text order, how far each suffix agrees with its
predecessor in the array. Where a suffix and its predecessor are each one
further than those before them, they agree for one symbol less; only the others
are compared with the text, eight symbols at once.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. ``s`` ends with its
    only smallest symbol, whose suffix counts as smaller."""
    n = len(s)
    step = np.diff(s.astype(np.int64))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]  # the next place at which symbols differ
    smaller = np.ones(n, bool)
    smaller[:-1] = step[np.minimum(following, n - 2)] > 0
    return smaller


def _append(sa: np.ndarray, heads: np.ndarray, s: np.ndarray, items: np.ndarray, sign: int) -> None:
    """Puts ``items``, in order, at the heads (sign 1) or tails (-1) of their buckets."""
    n = len(items)
    if n <= FEW:
        for i in items.tolist():
            c = s[i]
            sa[heads[c]] = i
            heads[c] += sign
        return
    symbols = s[items]
    order = symbols.argsort(kind="stable")
    symbols, place = symbols[order], np.arange(n)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    first = new.nonzero()[0]
    counts = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=counts[:-1])
    counts[-1] = n - first[-1]
    place -= first.repeat(counts)
    sa[heads[symbols] + sign * place] = items[order]
    heads[symbols[first]] += sign * counts


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The array induced from LMS suffixes in the order given."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    ends = np.cumsum(np.bincount(s, minlength=sigma))
    starts = ends - np.bincount(s, minlength=sigma)
    by_bucket = lms[np.argsort(s[lms], kind="stable")]
    bounds = np.searchsorted(s[by_bucket], np.arange(sigma + 1))
    used = np.flatnonzero(ends > starts)
    heads = starts.copy()
    for c in used:  # larger suffixes, from left to right
        done = starts[c]
        while True:
            batch = sa[done:heads[c]]
            if not len(batch):
                break
            done = heads[c]
            before = batch[batch > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _append(sa, heads, s, before, 1)
        batch = by_bucket[bounds[c]:bounds[c + 1]]
        before = batch[batch > 0] - 1  # what stands before an LMS suffix is larger
        if len(before):
            _append(sa, heads, s, before, 1)
    tails = ends - 1
    last_larger = heads  # up to here a bucket has larger suffixes
    for c in used[::-1]:  # smaller suffixes, from right to left
        done = ends[c] - 1
        while True:
            batch = sa[tails[c] + 1:done + 1][::-1]
            if not len(batch):
                break
            done = tails[c]
            before = batch[batch > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _append(sa, tails, s, before, -1)
        batch = sa[starts[c]:last_larger[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _append(sa, tails, s, before, -1)
    sa[0] = n - 1  # the end symbol stands alone in the first bucket
    return sa


def _names(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order; equal ones share a name."""
    n = len(s)
    length = np.zeros(n, np.int64)
    length[lms] = np.append(lms[1:], n - 1) - lms + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    alive, k = np.flatnonzero(same), 0
    while len(alive):
        x, y = a[alive] + k, b[alive] + k
        equal = (s[x] == s[y]) & (smaller[x] == smaller[y])
        same[alive[~equal]] = False
        alive = alive[equal]
        k += 1
        alive = alive[length[a[alive]] > k]
    name = np.zeros(n, np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int((~same).sum()) + 1


def _induce_names(s: list[int], sigma: int) -> list[int]:
    """The suffix array of a string of names, symbol by symbol."""
    n = len(s)
    smaller = bytearray(n)
    smaller[n - 1] = 1
    for i in range(n - 2, -1, -1):
        smaller[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and smaller[i + 1])
    sizes = [0] * (sigma + 1)
    for c in s:
        sizes[c + 1] += 1
    for c in range(sigma):
        sizes[c + 1] += sizes[c]
    lms = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]

    # places after which a larger, or a smaller, suffix is induced before them
    larger_before, smaller_before = bytearray(n), bytearray(n)
    for i in range(1, n):
        if smaller[i - 1]:
            smaller_before[i] = 1
        else:
            larger_before[i] = 1

    def induce(order: list[int]) -> list[int]:
        sa, tail = [0] * n, sizes[1:]
        for i in reversed(order):
            c = s[i]
            tail[c] = t = tail[c] - 1
            sa[t] = i
        head = sizes[:-1]
        for i in sa:  # grows behind the place that is read
            if larger_before[i]:
                c = s[i - 1]
                t = head[c]
                sa[t] = i - 1
                head[c] = t + 1
        tail = sizes[1:]
        for k in range(n - 1, -1, -1):
            i = sa[k]
            if smaller_before[i]:
                c = s[i - 1]
                tail[c] = t = tail[c] - 1
                sa[t] = i - 1
        return sa

    sa = induce(lms)
    if len(lms) > 1:
        end = dict(zip(lms, [*lms[1:], n - 1]))
        name, count, last = [0] * n, -1, None
        for i in sa:
            if i > 0 and smaller[i] and not smaller[i - 1]:
                part = s[i:end[i] + 1]
                if part != last or (end[i] == n - 1):
                    count += 1
                    last = part
                name[i] = count
        reduced = [name[i] for i in lms]
        if count + 1 < len(lms):
            sa = induce([lms[k] for k in _induce_names(reduced, count + 1)])
        else:
            order = [0] * len(lms)
            for k, c in enumerate(reduced):
                order[c] = lms[k]
            sa = induce(order)
    return sa


#: As few items as are put into buckets one by one.
FEW = 12
#: Strings of names up to this length are sorted symbol by symbol.
SHORT = 100_000


def _sorted_names(names: np.ndarray, count: int) -> np.ndarray:
    """The suffix array of a string of names under ``count``, the last of which is its only 0."""
    if len(names) <= SHORT:
        return np.array(_induce_names(names.tolist(), count))
    half = max(1, (int(count - 1).bit_length() + 1) // 2)
    halves = np.empty(2 * len(names) + 1, np.uint16 if half < 16 else np.uint32)
    halves[0:-1:2], halves[1:-1:2], halves[-1] = (names >> half) + 1, (names & ((1 << half) - 1)) + 1, 0
    sa = suffix_array(halves, (1 << half) + 2)
    whole = sa[1:]  # without the end
    return whole[whole % 2 == 0] // 2


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Of symbols under ``sigma``; the last one is 0 and no other is."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = classify(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = _induce(s, smaller, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    name, count = _names(s, smaller, lms, ordered)
    if count < len(lms):
        ordered = lms[_sorted_names(name, count)]
    return _induce(s, smaller, ordered, sigma)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """In text order, the number of symbols for which each suffix agrees with its
    predecessor in the array; 0 for the first of the array."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    # told by the place before: both moved on by one, and what they left behind agreed
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (s[:-1] == s[before[:-1]])
    at = np.flatnonzero(~follows & (before >= 0))
    agree = np.zeros(n, np.int64)
    # eight symbols in one number; of larger ones 8 bits, the rest is compared below
    low = np.append((s & 0xFF).astype(np.uint8), np.zeros(8, np.uint8))
    wide = np.ndarray((n,), "<u8", low, strides=(1,))
    full, k = at, 0
    exact = int(s.max()) < 256
    while len(full):
        x, y = full + k, before[full] + k
        inside = np.maximum(x, y) + 8 <= n
        same = np.zeros(len(full), bool)
        same[inside] = wide[x[inside]] == wide[y[inside]]
        if not exact:
            for j in range(8):
                at_j = np.flatnonzero(same)
                same[at_j] = s[x[at_j] + j] == s[y[at_j] + j]
        stop = full[~same]
        agree[stop] = k
        full, k = full[same], k + 8
    live = at
    for _ in range(8):
        x, y = live + agree[live], before[live] + agree[live]
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        live = live[s[x] == s[y]]
        agree[live] += 1
    source = np.maximum.accumulate(np.where(follows, -1, place))
    return np.where(follows, agree[source] - (place - source), agree)
