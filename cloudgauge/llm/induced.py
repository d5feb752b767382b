"""Suffix order and common prefixes of one shard by induced sorting, on disk if large.

The suffixes that begin a rise (S*) are ordered first: their substrings are named in
order, and the string of names, a third as long, is ordered the same way (by doubling
once it is small). Their order induces that of the falling suffixes (L) and this that of
the rising ones (S). Every first byte has a queue that is written at one end and read at
the other, in order; the queues lie one after another in an array that is a file once the
shard is larger than `memory` bytes. With each entry goes the common prefix with the one
before it: one more than the least of those between the two entries that induced them.
"""

from __future__ import annotations

import os

import numpy as np

SEPARATOR = 0xFF  # no byte of UTF-8
DOUBLING_LIMIT = 1 << 23
BATCH = 1 << 20


class Work:
    """Arrays of one shard: in memory, or as files in `folder` when they are large."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.made = folder, memory, 0

    def array(self, n: int, dtype: type) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.zeros(n, dtype)
        self.made += 1
        return np.memmap(os.path.join(self.folder, f"queue-{self.made}"), dtype, "w+", shape=(n,))


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (S); the last one never is."""
    n = len(text)
    out = np.zeros(n, bool)
    later = False  # type of the first suffix after the block
    for high in range(n, 0, -BATCH):
        low = max(0, high - BATCH)
        own = text[low:high].astype(np.int64)
        following = np.append(own[1:], int(text[high]) if high < n else -1)
        sign = np.sign(following - own)
        place = np.where(sign != 0, np.arange(len(own)), len(own))
        decided = np.minimum.accumulate(place[::-1])[::-1]
        up = np.append(sign > 0, later)
        out[low:high] = up[decided]
        later = bool(out[low])
    return out


class Words:
    """The eight bytes from any place of a text as one number, the first byte highest."""

    def __init__(self, text: np.ndarray, work: Work):
        self.n = len(text)
        padded = work.array(self.n + 8, np.uint8)
        padded[: self.n] = text
        padded[self.n :] = SEPARATOR
        self.view = np.ndarray((self.n + 1,), ">u8", buffer=padded, strides=(1,))

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.view[np.minimum(places, self.n)].astype(np.uint64)


def name_substrings(words: Words, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Ranks of text[start:stop]; of two where one begins the other, the longer is smaller
    (its next byte falls), so shorter ones are filled up with the largest byte."""
    names = np.zeros(len(starts), np.int64)
    rows = np.arange(len(starts))
    skip = 0
    while len(rows):
        beyond = 8 * np.clip(8 - (stops[rows] - starts[rows] - skip), 0, 8).astype(np.uint64)
        fill = np.where(beyond == 64, ~np.uint64(0), (np.uint64(1) << (beyond % 64)) - np.uint64(1))
        word = words.at(starts[rows] + skip) | fill
        order = np.lexsort((word, names[rows])) if skip else np.argsort(word)
        n_, w_ = names[rows][order], word[order]
        first = np.concatenate([[True], n_[1:] != n_[:-1]])
        change = first | np.concatenate([[True], w_[1:] != w_[:-1]])
        # a row's name: that of its group, plus the rows of the group that are smaller
        place = np.arange(len(rows))
        names[rows[order]] = n_ + np.maximum.accumulate(np.where(change, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        skip += 8
        # whoever is tied and goes on is compared further, with all it is tied with
        alone = change & np.append(change[1:], True)
        tied = np.ones(len(rows), bool)
        tied[order] = ~alone
        rows = rows[tied]
        goes_on = np.zeros(len(starts), bool)
        goes_on[names[rows[stops[rows] > starts[rows] + skip]]] = True
        rows = rows[goes_on[names[rows]]]
    return names


def order_by_doubling(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes of a string of whole numbers in order of their first `depth` symbols or
    more, common prefix of each with the one before, at most `depth`); the end is smallest.

    After each round the classes of equal beginnings of 1, 2, 4... symbols are kept, and
    from the largest down they tell how far two neighbours agree.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    value = symbols[order]
    rank = np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], value[1:] != value[:-1]]), np.arange(n), 0))
    kind = np.int32 if n < 2**31 else np.int64
    classes = [rank.astype(kind)]
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    step = 1
    while len(open_) and step < depth:
        ahead = open_ + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[open_])) if n >= 2**31 else np.argsort(rank[open_] * (n + 1) + second)
        f, s = rank[open_][by], second[by]
        place = np.arange(len(by))
        start = np.concatenate([[True], f[1:] != f[:-1]])
        change = start | np.concatenate([[True], s[1:] != s[:-1]])
        rank[open_[by]] = f + np.maximum.accumulate(np.where(change, place, 0)) - np.maximum.accumulate(np.where(start, place, 0))
        keep = np.ones(len(open_), bool)
        keep[by] = ~(change & np.append(change[1:], True))
        open_ = open_[keep]
        step *= 2
        classes.append(rank.astype(kind))
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for level in range(len(classes) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = classes[level][a[same]] == classes[level][b[same]]
        common += same << level
        a += same << level
        b += same << level
    shared[1:] = common
    return order, np.minimum(shared, depth)


def prefix(text: np.ndarray, words: Words | None, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, at most `cap`."""
    n, rows, done = len(text), np.arange(len(a)), 0
    out = np.zeros(len(a), np.int64)
    while len(rows) and done < cap:
        x, y = a[rows] + done, b[rows] + done
        if words is None:
            equal = ((x < n) & (y < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])).astype(np.int64)
            size = 1
        else:
            apart, size = words.at(x) ^ words.at(y), 8
            equal = sum((apart < np.uint64(1 << bits)).astype(np.int64) for bits in range(56, -1, -8))
        out[rows] += equal
        rows = rows[equal == size]
        done += size
    return np.minimum(np.minimum(out, n - np.maximum(a, b)), cap)


def with_last(text: np.ndarray, star: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Names of all S* substrings, given those of all but the last, which runs into the
    end: it is smaller than whatever it begins, or begins with."""
    own = text[star[-1] :].tolist()
    by = np.argsort(names, kind="stable")
    low, high = 0, len(by)
    while low < high:
        at = (low + high) // 2
        start = int(star[by[at]])
        other = text[start : min(int(star[by[at] + 1]) + 1, start + len(own))].tolist()
        if other < own[: len(other)]:
            low = at + 1
        else:
            high = at
    place = 2 * int(names[by[low]]) if low < len(by) else 2 * int(names.max(initial=0)) + 2
    return np.append(2 * names + 1, place)


class Pass:
    """One induction: takes entries in order and appends the suffixes before them to the
    queues of their first symbols. Down (S) fills the queues from their ends."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, order: np.ndarray, shared: np.ndarray, ends: np.ndarray, cap: int, down: bool):
        self.text, self.wanted, self.order, self.shared, self.cap, self.down = text, wanted, order, shared, cap, down
        self.write = ends.copy()
        self.fresh = np.ones(len(ends), bool)
        self.least = np.zeros(len(ends), np.int64)  # of the prefixes since a queue's last entry

    def take(self, at: np.ndarray, common: np.ndarray) -> None:
        """Entries in order, each with its common prefix with the entry before it."""
        source = np.flatnonzero(at > 0)
        before = at[source] - 1
        good = self.wanted[before]
        source, before = source[good], before[good]
        symbol = self.text[before]
        by = np.argsort(symbol, kind="stable")
        source, before, symbol = source[by], before[by], symbol[by].astype(np.int64)
        whole = int(common.min()) if len(common) else self.cap
        if not len(source):
            np.minimum(self.least, whole, out=self.least)
            return
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        last = np.append(first[1:], len(symbol)) - 1
        # least prefix over (source before it, its source]; a queue's first one since the start
        since = np.concatenate([[0], source[:-1] + 1])
        since[first] = 0
        bounds = np.column_stack([since, source + 1]).ravel()
        least = np.minimum.reduceat(np.append(common, self.cap), bounds)[::2]
        own = symbol[first]
        least[first] = np.minimum(least[first], self.least[own])
        value = np.minimum(least + 1, self.cap)
        value[first[self.fresh[own]]] = 0
        self.fresh[own] = False
        tail = np.minimum.reduceat(np.append(common, self.cap), np.column_stack([source[last] + 1, np.full(len(last), len(common))]).ravel())[::2]
        tail[source[last] + 1 >= len(common)] = self.cap
        np.minimum(self.least, whole, out=self.least)
        self.least[own] = tail
        for symbol_, a, b in zip(own.tolist(), first.tolist(), (last + 1).tolist(), strict=True):
            to, size = int(self.write[symbol_]), b - a
            if self.down:
                self.order[to - size : to] = before[a:b][::-1]
                self.shared[to - size : to] = value[a:b][::-1]
                self.write[symbol_] -= size
            else:
                self.order[to : to + size] = before[a:b]
                self.shared[to : to + size] = value[a:b]
                self.write[symbol_] += size


def suffix_order(text: np.ndarray, cap: int, work: Work) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `cap` symbols, common prefix of each with the one
    before, at most `cap`) of a string of whole numbers from 0."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    words = Words(text, work) if text.dtype == np.uint8 else None
    up = rising(text)
    star = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    # 1. order of the S* suffixes
    if len(star):
        names = with_last(text, star, name_substrings(words, star[:-1], star[1:] + 1) if words else name_numbers(text, star[:-1], star[1:] + 1))
        if len(star) <= DOUBLING_LIMIT:
            inner, agree = order_by_doubling(names, cap)
        else:
            inner, agree = suffix_order(np.unique(names, return_inverse=True)[1], cap, work)
        inner = inner.astype(np.int64)
        sorted_ = star[inner]
        # so many substrings agree; the rest is compared where the next ones begin
        near = np.zeros(len(star), np.int64)
        agree = agree[1:].astype(np.int64)
        ends = np.append(star, n)
        reach = ends[np.minimum(inner[1:] + agree, len(star))] - sorted_[1:]
        near[1:] = np.minimum(cap, reach + prefix(text, words, sorted_[:-1] + reach, sorted_[1:] + reach, cap))
    else:
        sorted_, near = star, np.zeros(0, np.int64)
    # 2. queues: for each symbol first the falling, then the rising suffixes
    most = int(text.max()) + 1
    falling_n = np.bincount(text[~up], minlength=most)
    total_n = np.bincount(text, minlength=most)
    start = np.cumsum(total_n) - total_n
    middle, end = start + falling_n, start + total_n
    kind = np.int32 if n < 2**31 else np.int64
    order, shared = work.array(n, kind), work.array(n, np.int16 if cap < 2**15 else np.int32)
    symbols = np.flatnonzero(total_n)
    star_symbol = text[sorted_]
    star_start = np.searchsorted(star_symbol, symbols, "left")
    star_end = np.searchsorted(star_symbol, symbols, "right")
    # 3. falling suffixes, smallest first
    left = Pass(text, ~up, order, shared, start, cap, down=False)
    left.take(np.array([n]), np.array([0]))  # the end of the string comes before all
    for c, s0, s1 in zip(symbols.tolist(), star_start.tolist(), star_end.tolist(), strict=True):
        read = int(start[c])
        while read < left.write[c]:
            stop = min(int(left.write[c]), read + BATCH)
            left.take(order[read:stop].astype(np.int64), shared[read:stop].astype(np.int64))
            read = stop
        for low in range(s0, s1, BATCH):
            at, common = sorted_[low : min(s1, low + BATCH)], near[low : min(s1, low + BATCH)].copy()
            if low == s0:
                common[0] = prefix(text, words, order[read - 1 : read].astype(np.int64), at[:1], cap)[0] if read > start[c] else 0
            left.take(at, common)
    # 4. rising suffixes, largest first; `shared` of an entry is here with the one after it
    right = Pass(text, up, order, shared, end, cap, down=True)
    edge = {}
    for c in symbols[::-1].tolist():
        read = int(end[c])
        while read > right.write[c]:
            stop = max(int(right.write[c]), read - BATCH)
            right.take(order[stop:read][::-1].astype(np.int64), shared[stop:read][::-1].astype(np.int64))
            read = stop
        if falling_n[c]:
            top = int(middle[c])
            edge[c] = int(prefix(text, words, order[top - 1 : top].astype(np.int64), order[top : top + 1].astype(np.int64), cap)[0]) if end[c] > top else 0
            for high in range(top, int(start[c]), -BATCH):
                low = max(int(start[c]), high - BATCH)
                common = shared[low + 1 : high + 1][::-1].astype(np.int64) if high < top else np.append(edge[c], shared[low + 1 : high][::-1].astype(np.int64))
                right.take(order[low:high][::-1].astype(np.int64), common)
    # with the one after -> with the one before
    for c in symbols.tolist():
        top, stop = int(middle[c]), int(end[c])
        if stop > top:
            for high in range(stop, top + 1, -BATCH):
                low = max(top + 1, high - BATCH)
                shared[low:high] = shared[low - 1 : high - 1].copy()
            shared[top] = edge.get(c, 0)
    return order, shared


def name_numbers(text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """`name_substrings` for symbols larger than a byte, one symbol at a time."""
    names = np.zeros(len(starts), np.int64)
    rows, skip, fill = np.arange(len(starts)), 0, int(text.max()) + 1
    while len(rows):
        at = starts[rows] + skip
        word = np.where(at < stops[rows], text[np.minimum(at, len(text) - 1)], fill)
        order = np.lexsort((word, names[rows]))
        n_, w_ = names[rows][order], word[order]
        place = np.arange(len(rows))
        first = np.concatenate([[True], n_[1:] != n_[:-1]])
        change = first | np.concatenate([[True], w_[1:] != w_[:-1]])
        names[rows[order]] = n_ + np.maximum.accumulate(np.where(change, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        alone = change & np.append(change[1:], True)
        keep = np.ones(len(rows), bool)
        keep[order] = ~alone & (w_ != fill)
        rows, skip = rows[keep], skip + 1
    return names
