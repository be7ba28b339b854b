"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified (a suffix is of type S if it is less than the next one), the leftmost
S suffixes of every run (LMS) are sorted by their substrings, these get names, the string of
names is sorted recursively where names repeat, and the order of all suffixes is induced from
it. Over few symbols a bucket is induced at a time, with all suffixes that it induces moved at
once; over many symbols (the strings of names) suffixes are induced one by one.
"""

from __future__ import annotations

import numpy as np

FEW = 512


def classify(text: np.ndarray) -> np.ndarray:
    """True for suffixes of type S; the last suffix is of type L (the end is less than all)."""
    n = len(text)
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # ends of runs of one symbol
    rises = np.append(text[last[:-1]] < text[last[:-1] + 1], False)
    return np.repeat(rises, np.diff(np.append(-1, last)))[:n]


def leftmost(kind: np.ndarray) -> np.ndarray:
    return np.flatnonzero(kind[1:] & ~kind[:-1]) + 1


def _place(sa: np.ndarray, at: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Suffixes go, in order, to the next free places of their symbols' buckets."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    sizes = np.diff(np.append(first, len(s)))
    rank = np.arange(len(s)) - np.repeat(first, sizes)
    sa[at[s] + step * rank] = suffixes[order]
    at[s[first]] += step * sizes


def _induce_few(text: np.ndarray, kind: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes, induced from the order of the LMS suffixes."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=size))
    starts = ends - np.bincount(text, minlength=size)
    sa = np.full(n, -1, np.int64)
    symbols = text[lms]
    by = np.argsort(symbols, kind="stable")
    bounds = np.searchsorted(symbols[by], np.arange(size + 1))
    heads = starts.copy()

    def before(batch: np.ndarray, want: bool) -> np.ndarray:
        p = batch[batch > 0] - 1
        return p[kind[p] == want]

    sa[heads[text[n - 1]]] = n - 1
    heads[text[n - 1]] += 1
    for c in range(size):
        done = starts[c]
        while done < heads[c]:
            upto = heads[c]
            p = before(sa[done:upto], False)
            done = upto
            if len(p):
                _place(sa, heads, text[p], p, 1)
        if bounds[c] < bounds[c + 1]:
            p = before(lms[by[bounds[c] : bounds[c + 1]]], False)
            if len(p):
                _place(sa, heads, text[p], p, 1)
    tails = ends - 1
    for c in range(size - 1, -1, -1):
        done = ends[c] - 1
        while done > tails[c]:
            upto = tails[c]
            p = before(sa[upto + 1 : done + 1][::-1], True)
            done = upto
            if len(p):
                _place(sa, tails, text[p], p, -1)
        if heads[c] > starts[c]:
            p = before(sa[starts[c] : heads[c]][::-1], True)
            if len(p):
                _place(sa, tails, text[p], p, -1)
    return sa


def _induce_many(text: np.ndarray, kind: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    n = len(text)
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    # symbol of the suffix before each one, if that is of type L (S), else -1; as for no suffix
    behind = np.append(text[:-1], -1)
    no = np.array([-1])
    of_l = np.concatenate([no, np.where(kind[:-1], -1, behind[:-1]), no]).tolist()
    of_s = np.concatenate([no, np.where(kind[:-1], behind[:-1], -1), no]).tolist()
    sa = [-1] * n
    tails = (ends - 1).tolist()
    for p, c in zip(lms[::-1].tolist(), text[lms[::-1]].tolist(), strict=True):
        at = tails[c]
        tails[c] = at - 1
        sa[at] = p
    heads = (ends - counts).tolist()
    c = int(text[n - 1])
    # the end induces the last suffix before anything else
    sa[heads[c]] = n - 1
    heads[c] += 1
    for v in sa:  # sees what is placed behind the current place
        c = of_l[v]
        if c >= 0:
            at = heads[c]
            heads[c] = at + 1
            sa[at] = v - 1
    tails = (ends - 1).tolist()
    for v in reversed(sa):
        c = of_s[v]
        if c >= 0:
            at = tails[c]
            tails[c] = at - 1
            sa[at] = v - 1
    return np.array(sa, np.int64)


def _names(text: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal names for equal LMS substrings; ``ordered`` are the LMS suffixes by substring."""
    n = len(text)
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    a, b = ordered[:-1], ordered[1:]
    same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
    open_, k = np.flatnonzero(same), 0
    while len(open_):
        x, y = a[open_], b[open_]
        equal = text[x + k] == text[y + k]
        same[open_[~equal]] = False
        k += 1
        open_ = open_[equal & (length[x] > k)]
    name = np.cumsum(np.append(0, ~same))
    names = np.zeros(n, np.int64)
    names[ordered] = name
    return names[lms], int(name[-1]) + 1


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffixes of ``text`` (symbols from 0 to size - 1) in order; the end is less than all."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    kind = classify(text)
    lms = leftmost(kind)
    induce = _induce_few if size <= FEW else _induce_many
    if not len(lms):
        return induce(text, kind, lms, size)
    by_substring = induce(text, kind, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = by_substring[is_lms[by_substring]]
    names, many = _names(text, ordered, lms)
    if many < len(lms):
        ordered = lms[suffix_array(names, many)]
    return induce(text, kind, ordered, size)


def permuted_common_prefixes(text: bytes, sa: np.ndarray, most: int) -> np.ndarray:
    """For every suffix, in the order of the text, the length of the prefix that it shares with
    the suffix before it in the suffix array; ``most`` (a multiple of 8) if it is longer."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.frombuffer(text + bytes(most + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (n + most, ), (1, ))
    shared = np.zeros(n, np.int64)
    here = np.flatnonzero(before >= 0)
    k = 0
    while len(here) and k < most:
        x = words[here + k] ^ words[before[here] + k]
        full = x == 0
        ends = x[~full]
        shared[here[~full]] = k + (np.bitwise_count((ends & (~ends + np.uint64(1))) - np.uint64(1)) >> 3)
        here = here[full]
        k += 8
    shared[here] = most
    room = np.minimum(n - np.arange(n), n - before)
    return np.minimum(np.minimum(shared, most), room)
