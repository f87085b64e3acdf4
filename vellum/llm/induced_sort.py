"""Suffix arrays by induced sorting, and permuted common prefixes.

The first level works on bytes: the alphabet is small, so a whole bucket is induced with a few numpy operations (once more for each
repetition in a run of one byte). Deeper levels have large alphabets and a third of the length; they are induced a window at a time,
short ones in plain loops.
"""

from __future__ import annotations

import numpy as np

from vellum.llm.textblock import U


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. The last symbol is the unique least one."""
    n = len(s)
    turn = np.flatnonzero(s[1:] != s[:-1])
    up = s[turn] < s[turn + 1]
    out = np.ones(n, bool)
    if n > 1:
        out[: turn[-1] + 1] = np.repeat(up, np.diff(np.concatenate([[-1], turn])))
    return out


def leftmost(types: np.ndarray) -> np.ndarray:
    """Positions of smaller suffixes that follow a larger one."""
    return np.flatnonzero(types[1:] & ~types[:-1]) + 1


def induce_bytes(s: np.ndarray, types: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array induced from the order of the leftmost-smaller suffixes. size: how often each symbol occurs."""
    n, k = len(s), len(size)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(n, -1, np.int64)
    count = np.bincount(s[lms], minlength=k)
    order = np.argsort(s[lms], kind="stable")
    first = np.cumsum(count) - count
    sym = s[lms][order]
    sa[end[sym] - count[sym] + np.arange(len(lms)) - first[sym]] = lms[order]
    head = start.copy()

    def forward(p: np.ndarray) -> None:
        c = s[p]
        o = np.argsort(c, kind="stable")
        c = c[o]
        amount = np.bincount(c, minlength=k)
        sa[head[c] + np.arange(len(p)) - (np.cumsum(amount) - amount)[c]] = p[o]
        head[:] += amount

    for c in np.flatnonzero(size):
        lo = start[c]
        while lo < head[c]:
            hi = head[c]
            p = sa[lo:hi] - 1
            p = p[p >= 0]
            p = p[~types[p]]
            if len(p):
                forward(p)
            lo = hi
        if count[c]:
            p = sa[end[c] - count[c] : end[c]] - 1
            forward(p[p >= 0])
    tail = end.copy()

    def backward(p: np.ndarray) -> None:
        c = s[p]
        o = np.argsort(c, kind="stable")
        c = c[o]
        amount = np.bincount(c, minlength=k)
        sa[tail[c] - 1 - np.arange(len(p)) + (np.cumsum(amount) - amount)[c]] = p[o]
        tail[:] -= amount

    for c in np.flatnonzero(size)[::-1]:
        if c == 0:
            sa[0] = n - 1
            break
        hi = end[c]
        while tail[c] < hi:
            lo = tail[c]
            p = sa[lo:hi][::-1] - 1
            p = p[p >= 0]
            p = p[types[p]]
            if len(p):
                backward(p)
            hi = lo
        p = sa[start[c] : head[c]][::-1] - 1
        p = p[p >= 0]
        p = p[types[p]]
        if len(p):
            backward(p)
    return sa


def induce(larger: list[int], smaller: list[int], symbols: list[int], lms: list[int], size: np.ndarray) -> list[int]:
    """The same for a large alphabet, symbol by symbol. larger, smaller: for each position the symbol before it if the suffix
    there is of that type, else -1; one entry more, -1, stands for an empty place."""
    n = len(symbols)
    sa = [n] * n
    tail = np.cumsum(size).tolist()
    head = [t - c for t, c in zip(tail, size.tolist(), strict=True)]
    spare = tail[:]
    for p in reversed(lms):
        c = symbols[p]
        spare[c] = q = spare[c] - 1
        sa[q] = p
    for p in sa:
        c = larger[p]
        if c >= 0:
            q = head[c]
            sa[q] = p - 1
            head[c] = q + 1
    for p in reversed(sa):
        c = smaller[p]
        if c >= 0:
            tail[c] = q = tail[c] - 1
            sa[q] = p - 1
    sa[0] = n - 1
    return sa


def induce_wide(s: np.ndarray, types: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same, a window of the array at a time. A window ends before the first place that its own suffixes fill, so all it
    reads is final. Where windows stay short (many equal neighbours), ``induce`` does the work instead."""
    n = len(s)
    before = np.append(s[:-1], -1)  # by position - 1
    larger, smaller = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    larger[1:n] = np.where(types[:-1], -1, before[:-1])
    smaller[1:n] = np.where(types[:-1], before[:-1], -1)
    sa = np.full(n, n, np.int64)
    end = np.cumsum(size)
    sym = s[lms]
    order = np.argsort(sym, kind="stable")
    count = np.bincount(sym, minlength=len(size))
    first = np.cumsum(count) - count
    c = sym[order]
    sa[end[c] - count[c] + np.arange(len(lms)) - first[c]] = lms[order]
    wide = max(64, int(2 * n**0.5))
    for source, place, step in ((larger, end - size, 1), (smaller, end.copy(), -1)):
        at, turns, most = 0, 0, n // 24 + 64
        while at < n:
            turns += 1
            if turns > most:
                return np.array(induce(larger.tolist(), smaller.tolist(), s.tolist(), lms.tolist(), size))
            stop = min(at + wide, n)
            p = sa[at:stop] if step > 0 else sa[n - stop : n - at][::-1]
            c = source[p]
            have = np.flatnonzero(c >= 0)
            if len(have):
                c = c[have]
                o = np.argsort(c, kind="stable")
                c, have = c[o], have[o]
                new = np.concatenate([[True], c[1:] != c[:-1]])
                k = np.arange(len(c))
                rank = k - np.maximum.accumulate(np.where(new, k, 0))
                q = place[c] + rank if step > 0 else n - place[c] + rank  # as counted from the side where the scan starts
                limit = int(q.min())
                if limit < stop:
                    stop = limit
                    keep = have < stop - at
                    c, have, q = c[keep], have[keep], q[keep]
                v = p[have] - 1
                if step > 0:
                    sa[q] = v
                    place[c] = q + 1
                else:
                    sa[n - 1 - q] = v
                    place[c] = n - 1 - q
            at = stop
        sa[0] = n - 1
    return sa


def names(s: np.ndarray, types: np.ndarray, lms: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Number the leftmost-smaller substrings in their order; equal ones share a number.

    Symbols are compared with their types, several packed in a word; words after the first are read only where substrings tie.
    With types no substring is a prefix of another, so ties are of equal length until they are equal throughout.
    """
    bits = int(2 * k).bit_length()
    pack = 64 // bits
    both = np.concatenate([2 * s + types, np.zeros(pack, np.int64)]).astype(U)
    length = np.append(np.diff(lms) + 1, 1)

    def word(which: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros(len(which), U)
        for t in range(j * pack, (j + 1) * pack):
            out <<= U(bits)
            live = t < length[which]
            out |= np.where(live, both[np.minimum(lms[which] + t, len(both) - 1)], U(0))
        return out

    def places(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        return order, new

    everyone = np.arange(len(lms))
    order, new = places(word(everyone, 0))
    rank = np.empty(len(lms), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, everyone, 0))
    j = 1
    open_ = everyone
    while True:
        tied = np.bincount(rank, minlength=len(lms))[rank[open_]] > 1
        open_ = open_[tied & (length[open_] > j * pack)]
        if not len(open_):
            break
        order, new = places(word(open_, j), rank[open_])
        at = open_[order]
        group = np.concatenate([[True], rank[at][1:] != rank[at][:-1]])
        k_ = np.arange(len(at))
        offset = np.maximum.accumulate(np.where(new, k_, 0)) - np.maximum.accumulate(np.where(group, k_, 0))
        rank[at] = rank[at] + offset
        j += 1
    seen = np.zeros(len(lms), bool)
    seen[rank] = True
    return (np.cumsum(seen) - 1)[rank], int(seen.sum())


#: below this length plain loops are faster than windows
WIDE = 20_000


def suffix_array(s: np.ndarray, k: int, first: bool = True) -> np.ndarray:
    """s: integers in [0, k) whose last is the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    types = smaller_types(s)
    order = lms = leftmost(types)
    size = np.bincount(s, minlength=k)
    if len(lms) > 1:
        reduced, count = names(s, types, lms, k)
        if count == len(lms):
            order = np.empty(count, np.int64)
            order[reduced] = lms
        else:
            order = lms[suffix_array(reduced, count, first=False)]
    if first:
        return induce_bytes(s, types, order, size)
    if n >= WIDE:
        return induce_wide(s, types, order, size)
    before = np.where(types[:-1], -1, s[:-1]).tolist()
    return np.array(induce([-1, *before, -1], [-1, *np.where(types[:-1], s[:-1], -1).tolist(), -1], s.tolist(), order.tolist(), size))


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the length of the common prefix with its predecessor in the suffix array, in text order.

    text: bytes whose last is unique. Where the symbol before a position equals the one before its predecessor, the length is that
    of the position before, minus one; it is carried. The other lengths are found by comparing eight bytes at a time."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    carried = np.zeros(n, bool)
    i = np.flatnonzero((before[1:] > 0) & (before[:-1] >= 0)) + 1
    carried[i] = text[i - 1] == text[before[i] - 1]
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(16, np.uint8)]), 8).view(np.uint64)[:, 0]
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(~carried & (before >= 0))
    deep = 0
    while len(live):
        differ = wide[live + deep] ^ wide[before[live] + deep]
        ends = differ != 0
        lowest = differ[ends] & (~differ[ends] + U(1))
        out[live[ends]] = deep + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
        live = live[~ends]
        deep += 8
    at = np.arange(n)
    source = np.maximum.accumulate(np.where(carried, 0, at))
    return out[source] - (at - source)
