"""Suffix arrays by induced sorting, a bucket at a time, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Symbols of a string per symbol of its alphabet from which buckets induce as arrays.
BUCKET = 2048
#: Entries that a round should have on the whole.
ROUND = 64


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. The last is larger."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    smaller = s[differs] < s[differs + 1]
    at = np.searchsorted(differs, np.arange(n))
    return np.append(smaller, False)[at]


def _append(sa, s, fresh, place, step):
    """Puts suffixes into their buckets, in order, from the heads on or the tails back."""
    symbol = s[fresh]
    order = np.argsort(symbol, kind="stable")
    fresh, symbol = fresh[order], symbol[order]
    counts = np.bincount(symbol, minlength=len(place))
    begins = np.cumsum(counts) - counts
    sa[place[symbol] + step * (np.arange(len(fresh)) - begins[symbol])] = fresh
    place += step * counts


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes, induced from the leftmost-smaller ones in the given order.

    Larger suffixes from left to right, then smaller ones from right to left. A bucket's
    entries induce together; those that fall into the same bucket form its next round. Long
    periods make rounds of a few entries; past a share of the string's length the entries
    go one by one, so the time stays linear.
    """
    n = len(s)
    rounds = 2 * k + n // ROUND
    counts = np.bincount(s, minlength=k)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.full(n, -1, np.int64)
    tails = ends - 1
    _append(sa, s, lms[::-1], tails, -1)
    heads = begins.copy()
    _append(sa, s, np.array([n - 1]), heads, 1)  # the end of the string comes first

    def before(entries: np.ndarray, kind: bool) -> np.ndarray:
        j = entries[entries > 0] - 1
        return j[smaller[j] == kind]

    for c in np.flatnonzero(counts):
        done = begins[c]
        while done < heads[c]:
            rounds -= 1
            if not rounds:
                return _induce_by_one(s, smaller, lms, k)
            fresh, done = sa[done : heads[c]], heads[c]
            _append(sa, s, before(fresh, False), heads, 1)
        _append(sa, s, before(sa[tails[c] + 1 : ends[c]], False), heads, 1)
    tails = ends - 1
    for c in np.flatnonzero(counts)[::-1]:
        done = ends[c] - 1
        while done > tails[c]:
            rounds -= 1
            if not rounds:
                return _induce_by_one(s, smaller, lms, k)
            fresh, done = sa[tails[c] + 1 : done + 1][::-1], tails[c]
            _append(sa, s, before(fresh, True), tails, -1)
        _append(sa, s, before(sa[begins[c] : heads[c]][::-1], True), tails, -1)
    return sa


def _induce_by_one(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same for a string of many symbols, whose buckets are too small to go together."""
    counts = np.bincount(s, minlength=k)
    ends = np.cumsum(counts)
    symbol, kind = s.tolist(), smaller.tolist()
    sa = [-1] * len(symbol)
    tails, heads = (ends - 1).tolist(), (ends - counts).tolist()
    for i in reversed(lms.tolist()):
        c = symbol[i]
        sa[tails[c]] = i
        tails[c] -= 1
    last = len(symbol) - 1
    sa[heads[symbol[last]]] = last
    heads[symbol[last]] += 1
    # Entries are read as they are written: each induces the suffix before it.
    for i in sa:
        if i > 0 and not kind[i - 1]:
            c = symbol[i - 1]
            sa[heads[c]] = i - 1
            heads[c] += 1
    tails = (ends - 1).tolist()
    for at in range(last, -1, -1):
        i = sa[at]
        if i > 0 and kind[i - 1]:
            c = symbol[i - 1]
            sa[tails[c]] = i - 1
            tails[c] -= 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Suffix array of symbols 0 to k - 1, in time linear in the string.

    Suffixes are classified; the substrings between leftmost-smaller positions are sorted
    by one induction and named; where names repeat, the string of names, at most half as
    long, is sorted by this function again; a second induction sorts all suffixes.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    # Large buckets induce as arrays. Both ways take a fixed time per symbol.
    induce = _induce if len(s) >= BUCKET * k else _induce_by_one
    if len(lms) > 1:
        sa = induce(s, smaller, lms, k)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        nth = np.zeros(n, np.int64)
        nth[lms] = np.arange(len(lms))
        nth = nth[order]
        length = np.append(np.diff(lms) + 1, n - lms[-1])[nth]
        same = _same_substrings(s, smaller, order, length)
        name = np.append(0, np.cumsum(~same))
        names = np.empty(len(lms), np.int64)
        names[nth] = name
        if name[-1] < len(lms) - 1:
            order = lms[suffix_array(names, name[-1] + 1)]
        lms = order
    return induce(s, smaller, lms, k)


def _same_substrings(s, smaller, order, length):
    """Whether each leftmost-smaller substring equals the one sorted before it."""
    a, b = order[:-1], order[1:]
    same = length[:-1] == length[1:]
    live = np.flatnonzero(same)
    for at in range(int(length.max(initial=0))):
        live = live[length[live] > at]
        if not len(live):
            break
        x, y = a[live] + at, b[live] + at
        equal = (s[x] == s[y]) & (smaller[x] == smaller[y])
        same[live[~equal]] = False
        live = live[equal]
    # The last substring ends with the string, which equals nothing.
    return same & (a + length[:-1] < len(s)) & (b + length[1:] < len(s))


def common_prefixes(s: np.ndarray, sa: np.ndarray, stop: int = 0) -> np.ndarray:
    """For each rank, how many symbols it shares with the rank before, up to a ``stop``.

    They are found in text order: where the symbols before two neighbours are equal, the
    common prefix is one shorter than that of the position before. Only the other
    positions compare symbols.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    has = before >= 0
    inner = has & (i > 0) & (before > 0)
    inner[inner] = (s[i[inner] - 1] == s[before[inner] - 1]) & (s[i[inner] - 1] != stop)
    own = np.flatnonzero(has & ~inner)
    padded = np.append(s, stop)
    length = np.zeros(n, np.int64)
    live, at = own, 0
    while len(live):
        x = padded[np.minimum(live + at, n)]
        y = padded[np.minimum(before[live] + at, n)]
        equal = (x == y) & (x != stop)
        length[live[~equal]] = at
        live, at = live[equal], at + 1
    # length + position is constant from an own position to the next.
    reach = np.where(inner, 0, length + i)
    reach = np.maximum.accumulate(reach)
    permuted = np.where(inner, reach - i, length)
    return permuted[sa]
