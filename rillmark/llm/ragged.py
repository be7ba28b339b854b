"""Rank-synchronous pair merging over many short sequences held as one ragged numpy array.

Each round finds the lowest-ranked neighbouring pair of every sequence and merges all its
occurrences at once (of overlapping ones the leftmost). A sequence leaves the array when no pair
is left in it. This equals merging one pair at a time unless a round that merges several
occurrences makes a pair of lower rank; sequences in which that happens are reported, so that
the caller can merge them one pair at a time.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int64(1) << 40


class PairTable:
    """(left, right) -> (rank, merged symbol); symbols are below 2**20."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.fromiter(((a << 20) | b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.fromiter((v[0] for v in pairs.values()), np.int64, len(pairs))[order]
        self.symbol = np.fromiter((v[1] for v in pairs.values()), np.int64, len(pairs))[order]
        self.pairs = pairs

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it has none) and its place in the table."""
        key = (left << 20) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE), at


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged symbols (flat, in order of the sequences), their counts, and which sequences need
    merging one pair at a time. ``lengths`` are all positive."""
    n = len(lengths)
    counts, odd = np.zeros(n, np.int64), np.zeros(n, bool)
    several = np.zeros(n, bool)  # of the last round
    done_seq: list[np.ndarray] = []
    done_sym: list[np.ndarray] = []
    sym, seq, last = symbols.astype(np.int64), np.repeat(np.arange(n), lengths), np.full(n, -1, np.int64)
    rank, at = table.find(sym[:-1], sym[1:])
    rank[seq[:-1] != seq[1:]] = NONE
    rank, at = np.append(rank, NONE), np.append(at, 0)
    while len(sym):
        starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        best = np.minimum.reduceat(rank, starts)
        ids = seq[starts]
        sizes = np.diff(np.append(starts, len(seq)))
        over = best == NONE
        odd[ids] |= (best < last[ids]) & several[ids]
        last[ids] = best
        several[ids] = False
        hit = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank < NONE))
        if len(hit):
            run = np.flatnonzero(np.append(True, np.diff(hit) != 1))
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            sym[hit] = table.symbol[at[hit]]
            of = seq[hit]
            several[of[1:][of[1:] == of[:-1]]] = True
        keep = np.ones(len(sym), bool)
        if over.any():
            gone = np.repeat(over, sizes)
            counts[ids[over]] = sizes[over]
            done_sym.append(sym[gone])
            done_seq.append(seq[gone])
            keep = ~gone
        keep[hit + 1] = False
        fresh = np.zeros(len(sym), bool)
        fresh[hit] = True
        sym, seq, rank, at, fresh = sym[keep], seq[keep], rank[keep], at[keep], fresh[keep]
        # only pairs that touch a merged symbol have a new rank
        new = np.flatnonzero(fresh)
        new = np.concatenate([new, new[(new > 0)] - 1])
        inner = new[new < len(sym) - 1]
        rank[new] = NONE
        inner = inner[seq[inner] == seq[inner + 1]]
        rank[inner], at[inner] = table.find(sym[inner], sym[inner + 1])
    flat_seq, flat = np.concatenate([*done_seq, np.empty(0, np.int64)]), np.concatenate([*done_sym, np.empty(0, np.int64)])
    return flat[np.argsort(flat_seq, kind="stable")], counts, odd


def merge_one(symbols: list[int], table: PairTable) -> list[int]:
    """One pair at a time: lowest rank first, of equal ranks the leftmost."""
    sym, n = list(symbols), len(symbols)
    prev, following = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = following[i]
        if j < n and (found := table.pairs.get((sym[i], sym[j]))):
            heapq.heappush(heap, (found[0], i, sym[i], sym[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = following[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = merged, -1
        following[i] = following[j]
        if following[j] < n:
            prev[following[j]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return [s for s in sym if s >= 0]
