"""Recommendations by exact Jaccard similarity, without a row for each pair of users.

Users are dealt into blocks. Every item's list of users goes, packed, to each block with a user of the
list, so a block has all that its users share with anybody and counts it in arrays; of that only the
nearest are kept. In the same way the items of the nearest users go to the blocks that ask for them.
A block is a range of users, as close ids tend to share items, with about ``WEIGHT`` places of lists
to be counted; a crowded range is cut by a hash of the users. What is dealt out is a list for each
block that it concerns, 2 to 4 bytes for each of its places, at most the places that are counted.
Where lists are so long that they concern nearly all blocks, pairs are counted in tiles instead: users
are dealt into groups, and a tile has two of them, so a place goes to as many tiles as there are groups.

One item's users and one user's items are in one task, and so are the lists of a block. Without items
in common there are no neighbours. A null item counts in a user's size; it is never common nor seen,
but a neighbour's null item is recommended, after all others. A null user is nobody's neighbour.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from rillmark.sources.files import forget, reachable, stored

#: Stands for a null item, after all others.
NULL = np.iinfo(np.int64).max
#: Places of lists to be counted in a block, and in one that keeps a core of a small session busy.
WEIGHT, LEAST_WEIGHT = 1 << 23, 1 << 22
#: Ranges that weights are known by, places of lists in a packed row, places counted at once, and the
#: span of ids up to which a table of all of them is kept.
CELLS, BODY, BATCH, SPAN = 4096, 1 << 16, 1 << 19, 1 << 24
#: Places to be counted in a tile of two groups, and places of a group. Of a tile's users, 1 in ``RARE`` at least have an item that
#: is multiplied; a product has so many users of a group and of the other.
TILE, SIDE, RARE, HIGH, WIDE = 1 << 30, 1 << 19, 16, 256, 4096
#: Rows of a task that deals items out to lists, or histories to who asks for them.
ROWS = 750_000
DEALT = "to int, kind int, body binary"


# ---- packed columns --------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of longs as planes of bytes, as many as the widest value over the least one needs."""
    out = [np.int64(len(columns)).tobytes()]
    for x in columns:
        x = np.ascontiguousarray(x, np.int64)
        least = x.min() if len(x) else np.int64(0)
        over = x.view(np.uint64) - least.view(np.uint64)
        planes = (int(over.max()).bit_length() + 7) // 8 if len(x) else 0
        out += [np.array([len(x), least, planes], np.int64).tobytes(), over.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()]
    return b"".join(out)


def unpack(body) -> list[np.ndarray]:
    data = np.frombuffer(body, np.uint8)
    at, out = 8, []
    for _ in range(int(data[:8].view(np.int64)[0])):
        n, least, planes = np.frombuffer(data[at : at + 24].tobytes(), np.int64)
        at += 24
        x = np.zeros((n, 8), np.uint8)
        x[:, :planes] = data[at : at + n * planes].reshape(planes, n).T
        at += n * planes
        out.append((x.reshape(-1).view(np.uint64) + least.view(np.uint64)).view(np.int64))
    return out


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def pack_lists(heads: np.ndarray, counts: np.ndarray, flat: np.ndarray, *more: np.ndarray) -> bytes:
    """Lists (none empty, ascending) as their first values and gaps."""
    inner = np.ones(len(flat), bool)
    inner[starts_of(counts)] = False
    return pack(np.diff(heads, prepend=0), counts, flat[~inner], np.diff(flat, prepend=0)[inner], *more)


def unpack_lists(body) -> list[np.ndarray]:
    """Heads, counts, values, and what else was packed with them."""
    heads, counts, first, gaps, *more = unpack(body)
    starts = starts_of(counts)
    full, inner = np.zeros(int(counts.sum()), np.int64), np.ones(int(counts.sum()), bool)
    inner[starts] = False
    full[inner] = gaps
    full = np.cumsum(full)
    return [np.cumsum(heads), counts, full + np.repeat(first - full[starts], counts), *more]


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after the other."""
    return np.repeat(starts - starts_of(counts), counts) + np.arange(int(counts.sum()))


def parts_of(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring lists of at most so many places together, or one list."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        before = ends[at] - counts[at]
        upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(at, upto)
        at = upto


def bucket(keys: np.ndarray, n: int) -> np.ndarray:
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int32)


def rows(**columns) -> pa.RecordBatch:
    kinds = {"to": pa.int32(), "kind": pa.int32(), "body": pa.binary(), "entries": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "weights": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))


def bodies(batches) -> Iterator[tuple[int, int, memoryview]]:
    for batch in batches:
        to, kind, body = (batch.column(name) for name in ("to", "kind", "body"))
        for r in range(batch.num_rows):
            yield to[r].as_py(), kind[r].as_py(), body[r].as_buffer()


def joined(parts: list, *kinds) -> list[np.ndarray]:
    """Columns of several bodies put together."""
    return [np.concatenate([np.empty(0, kind), *(p[c] for p in parts)]) for c, kind in enumerate(kinds)]


def dealt(to: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of columns, packed for where they go."""
    order = np.argsort(to, kind="stable")
    to, columns = to[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1)) if len(to) else np.empty(0, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield rows(to=[int(to[a])], kind=[kind], body=[pack(*(c[a:b] for c in columns))])


def deal(df: DataFrame, n: int, route: Callable | None = None) -> DataFrame:
    return (df.mapInArrow(route, DEALT) if route else df.select("to", "kind", "body")).repartitionById(n, F.col("to"))


def columns_of(batches, least: int) -> Iterator[list[np.ndarray]]:
    """Columns of so many rows at least, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= least:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


# ---- users, lists and blocks -----------------------------------------------------------------


def whole_users(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Users and items that come in their order, in pieces of about ``4 * BODY`` rows that end with a user's last row."""
    rest = None
    for u, i in columns_of(batches, 4 * BODY):
        if rest is not None:
            u, i = np.append(rest[0], u), np.append(rest[1], i)
        new = np.append(True, (u[1:] != u[:-1]) | (i[1:] != i[:-1]))
        u, i = u[new], i[new]
        cut = int(np.searchsorted(u, u[-1]))
        if cut:
            yield u[:cut], i[:cut]
        rest = u[cut:], i[cut:]
    if rest is not None:
        yield rest


def histories(batches) -> Iterator[pa.RecordBatch]:
    """The different items of each user of a task, which gets them in order and holds a piece of them."""
    for u, i in whole_users(batches):
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        users, counts = u[first], np.diff(np.append(first, len(u)))
        for part in parts_of(counts, 4 * BODY):
            own = i[first[part][0] : first[part][0] + counts[part].sum()]
            yield rows(body=[pack_lists(users[part], counts[part], own)], entries=[len(own)], lo=[users[part][0]], hi=[users[part][-1]])


def cells_of(users: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return np.minimum((users.astype(np.float64) - float(lo)) * (CELLS / (float(hi) - float(lo) + 1)), CELLS - 1).astype(np.int64)


def by_item(n: int):
    def route(batches):
        for batch in batches:
            for body in batch.column("body"):
                users, counts, items = unpack_lists(body.as_buffer())
                u, size = np.repeat(users, counts), np.repeat(counts, counts)
                has = items != NULL
                yield from dealt(bucket(items[has], n), 0, u[has], items[has], size[has])

    return route


def lists(lo: int, hi: int):
    """The users of each item with several, their sizes, and by ranges of users what counting them costs and how many they are."""

    def gather(batches):
        u, i, size = joined([unpack(body) for _, _, body in bodies(batches)], np.int64, np.int64, np.int64)
        if not len(u):
            return
        order = np.lexsort((u, i))
        u, i, size = u[order], i[order], size[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        counts = np.diff(np.append(first, len(u)))
        several = np.repeat(counts > 1, counts)
        u, size, counts = u[several], size[several], counts[counts > 1]
        cells = cells_of(u, lo, hi)
        weights = np.append(np.bincount(cells, np.repeat(counts, counts), CELLS), np.bincount(cells, minlength=CELLS))
        at = 0
        for part in parts_of(counts, BODY):
            upto = at + int(counts[part].sum())
            yield rows(body=[pack_lists(np.zeros(part.stop - part.start), counts[part], u[at:upto], size[at:upto])], weights=[weights if at == 0 else None])
            at = upto

    return gather


class Blocks:
    """Which block a user is in."""

    def __init__(self, weights: np.ndarray, lo: int, hi: int, cores: int, want: int = 0):
        total = float(weights.sum())
        want = want or max(-(-total // WEIGHT), min(cores, -(-total // LEAST_WEIGHT)), 1)
        self.lo, self.hi, self.n, held = lo, hi, 0, np.inf
        self.first, self.cuts = np.zeros(CELLS, np.int32), np.ones(CELLS, np.int32)
        for cell, weight in enumerate(weights.tolist()):
            if weight > 2 * total / want:
                self.first[cell], self.cuts[cell] = self.n, int(-(-weight * want // total))
                self.n, held = self.n + int(self.cuts[cell]), np.inf
                continue
            if held + weight / 2 > total / want:
                self.n, held = self.n + 1, 0.0
            self.first[cell] = self.n - 1
            held += weight

    def of(self, users: np.ndarray) -> np.ndarray:
        cell = cells_of(users, self.lo, self.hi)
        out, cuts = self.first[cell], self.cuts[cell]
        for n in np.unique(cuts[cuts > 1]).tolist():
            at = np.flatnonzero(cuts == n)
            out[at] += bucket(users[at], n)
        return out

    def lists_for(self, batches):
        """Each list, for all blocks with a user of it."""
        for batch in batches:
            for body in batch.column("body"):
                _, counts, users, size = unpack_lists(body.as_buffer())
                starts = starts_of(counts)
                concerned = np.unique(self.of(users).astype(np.int64) * len(counts) + np.repeat(np.arange(len(counts)), counts))
                to, which = concerned // len(counts), concerned % len(counts)
                edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1)).tolist()
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    own = counts[which[a:b]]
                    at = places(starts[which[a:b]], own)
                    yield rows(to=[to[a]], kind=[0], body=[pack_lists(np.zeros(b - a), own, users[at], size[at])])


class Tiles:
    """Groups of users, and the tiles of two of them, or of one with itself."""

    def __init__(self, weights: np.ndarray, held: np.ndarray, lo: int, hi: int, cores: int):
        """A tile counts some ``TILE`` places and a group has some ``SIDE``, by halves of both as either may be where the other isn't."""
        total, n = float(weights.sum()), float(held.sum())
        busy = min(6 * cores, -(-total // LEAST_WEIGHT))
        want = int(max(np.ceil(np.sqrt(max(total / TILE, busy))), -(-n // SIDE), 1))
        self.groups = Blocks(weights / total + held / n if n else weights, lo, hi, cores, want)
        self.one, self.two = np.triu_indices(self.groups.n)
        self.n = len(self.one)

    def lists_for(self, batches):
        """Of each list, to all tiles with a pair of its users, the users of their groups."""
        for batch in batches:
            for body in batch.column("body"):
                _, counts, users, size = unpack_lists(body.as_buffer())
                which, group = np.repeat(np.arange(len(counts)), counts), self.groups.of(users)
                order = np.argsort(group, kind="stable")
                edges = np.searchsorted(group[order], np.arange(self.groups.n + 1))
                of_group = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                has = [np.bincount(which[at], minlength=len(counts)) for at in of_group]
                for to, (a, b) in enumerate(zip(self.one.tolist(), self.two.tolist(), strict=True)):
                    n = has[a] + has[b] if a != b else has[a]
                    meet = (has[a] > 0) & (has[b] > 0) if a != b else n > 1
                    if meet.any():
                        at = np.sort(np.append(of_group[a], of_group[b])) if a != b else of_group[a]
                        at = at[meet[which[at]]]
                        yield rows(to=[to], kind=[0], body=[pack_lists(np.zeros(int(meet.sum())), n[meet], users[at], size[at])])


def layout(weights: np.ndarray, held: np.ndarray, lo: int, hi: int, cores: int) -> Blocks | Tiles:
    """Tiles where a list's place would go to more than twice as many blocks."""
    blocks, tiles = Blocks(weights, lo, hi, cores), Tiles(weights, held, lo, hi, cores)
    return tiles if min(blocks.n, weights.sum() / max(held.sum(), 1)) > 2 * tiles.groups.n else blocks


# ---- counting --------------------------------------------------------------------------------


def best(group: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k highest values of each group (groups lie together), ties by the least ``tie``,
    in that order, and their ranks from 1."""
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)] if len(group) else []
    kept = [np.empty(0, np.int64)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > k:
            own = value[a:b]
            kept.append(a + np.flatnonzero(own >= np.partition(own, b - a - k)[b - a - k]))
        else:
            kept.append(np.arange(a, b))
    at = np.concatenate(kept)
    at = at[np.lexsort((tie[at], -value[at], group[at]))]
    first = np.append(True, group[at][1:] != group[at][:-1]) if len(at) else np.empty(0, bool)
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) + 1
    return at[rank <= k], rank[rank <= k]


class Column:
    """An array that grows where it is."""

    def __init__(self, kind):
        self.held, self.n = np.empty(BATCH, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            self.held.resize(max(self.n + len(x), len(self.held) + len(self.held) // 4), refcheck=False)
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Ids:
    """Ids as small numbers of the same order; ``narrow`` is how they are held until all are known."""

    def __init__(self, lo: int, hi: int):
        self.lo = lo if hi - lo < 1 << 31 else 0
        self.kind = np.int32 if hi - lo < 1 << 31 else np.int64
        self.found = np.zeros(hi - lo + 1, bool) if hi - lo < SPAN else None
        self.some: list[np.ndarray] = [np.empty(0, self.kind)]

    def narrow(self, ids: np.ndarray) -> np.ndarray:
        out = (ids - self.lo).astype(self.kind)
        if self.found is not None:
            self.found[out] = True
        else:
            self.some.append(np.unique(out))
            if len(self.some) > 64:
                self.some = [np.unique(np.concatenate(self.some))]
        return out

    def close(self) -> None:
        self.all = np.flatnonzero(self.found) if self.found is not None else np.unique(np.concatenate(self.some))
        self.table = None
        if self.found is not None:
            self.table = np.zeros(len(self.found), np.int32)
            self.table[self.all] = np.arange(len(self.all))

    def number(self, narrow: np.ndarray) -> np.ndarray:
        return self.table[narrow] if self.table is not None else np.searchsorted(self.all, narrow).astype(np.int32)

    def back(self, numbers: np.ndarray) -> np.ndarray:
        return self.all[numbers].astype(np.int64) + self.lo


def nearest(blocks: Blocks, k: int):
    """The k most similar of each user of a block, ties by id."""

    def give(block, ids, user, at, v, similarity):
        top, _ = best(at, similarity, v, k)
        yield rows(to=[block], kind=[1], body=[pack(ids.back(user[top]), ids.back(v[top]), similarity[top].view(np.int64))])

    return counted(blocks, give)


def pairs_from(blocks: Blocks, threshold: float):
    """u < v and similarity of each pair, with a common item and that similarity at least, whose first is in a block."""

    def give(block, ids, user, at, v, similarity):
        kept = np.flatnonzero((user < v) & (similarity >= threshold))
        for a in range(0, len(kept), BODY):
            part = kept[a : a + BODY]
            yield pa.RecordBatch.from_arrays([pa.array(ids.back(user[part])), pa.array(ids.back(v[part])), pa.array(similarity[part])], names=["u", "v", "similarity"])

    return counted(blocks, give)


def counted(blocks: Blocks, give: Callable):
    """What ``give`` makes of some users of a block (``user``, numbered by ``at``), all they share items with, and how similar these are."""

    def count(batches):
        ids, counts, sizes, own_user, own_list, block, n_lists = Ids(blocks.lo, blocks.hi), [], [], [], [], None, 0
        held_ids = Column(ids.kind)
        for block, _, body in bodies(batches):
            _, n, users, size = unpack_lists(body)
            held = ids.narrow(users)
            own = np.flatnonzero(blocks.of(users) == block)
            own_user.append(held[own])
            own_list.append(np.repeat(np.arange(n_lists, n_lists + len(n)), n)[own])
            known, at = np.unique(held, return_index=True)
            sizes.append((known, size[at]))
            held_ids.add(held)
            counts.append(n.astype(np.int32))
            n_lists += len(n)
            if len(sizes) > 64:
                sizes = [firsts(sizes)]
        if block is None:
            return
        body = None  # else what was read stays in memory
        pa.default_memory_pool().release_unused()
        ids.close()
        size = firsts(sizes)[1]  # in the order of ids
        counts, flat = np.concatenate(counts).astype(np.int64), held_ids.all()
        for at in range(0, len(flat), BATCH):
            flat[at : at + BATCH] = ids.number(flat[at : at + BATCH])
        starts = starts_of(counts)
        own_user, own_list = ids.number(np.concatenate(own_user)), np.concatenate(own_list)
        order = np.argsort(own_user, kind="stable")
        own_user, own_list = own_user[order], own_list[order]
        for user, at, v, both in met(own_user, own_list, starts, counts, flat, len(ids.all)):
            other = user != v
            at, v, both, user = at[other], v[other], both[other], user[other]
            similarity = both / (size[user] + size[v] - both)
            yield from give(block, ids, user, at, v, similarity)

    return count


def met(own_user: np.ndarray, own_list: np.ndarray, starts: np.ndarray, counts: np.ndarray, flat: np.ndarray, n_all: int):
    """Of some users (in order) after the others: user, their place among these, whom they meet in lists (ranges of ``flat``), and in how many."""
    first = np.flatnonzero(np.append(True, own_user[1:] != own_user[:-1]))
    mine, n_own = own_user[first].astype(np.int64), np.diff(np.append(first, len(own_user)))
    for part in parts_of(np.add.reduceat(counts[own_list], first), BATCH):
        begin = first[part.start]
        held = own_list[begin : begin + n_own[part].sum()]
        if counts[held].sum() > BATCH:  # one user
            both = np.zeros(n_all, np.int64)
            for some in parts_of(counts[held], BATCH):
                both += np.bincount(flat[places(starts[held[some]], counts[held[some]])], minlength=n_all)
            v = np.flatnonzero(both)
            at, both = np.zeros(len(v), np.int64), both[v]
        elif (part.stop - part.start) * n_all <= 2 * counts[held].sum():  # they share with nearly all
            key = np.repeat(np.repeat(np.arange(part.stop - part.start) * n_all, n_own[part]), counts[held])
            key += flat[places(starts[held], counts[held])]
            both = np.bincount(key, minlength=(part.stop - part.start) * n_all)
            key = np.flatnonzero(both)
            both, at, v = both[key], key // n_all, key % n_all
        else:
            key = np.repeat(np.repeat(np.arange(part.stop - part.start) << 32, n_own[part]), counts[held])
            key |= flat[places(starts[held], counts[held])]
            key.sort()
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            both = np.diff(np.append(edge, len(key)))
            key = key[edge]
            at, v = key >> 32, key & 0xFFFFFFFF
        yield mine[part][at], at, v, both


class Side:
    """A group's users in a tile: their ids and sizes, and for each place of the tile's lists user and list."""

    def __init__(self, users: np.ndarray, size: np.ndarray, lists_: np.ndarray, n_lists: int):
        self.ids, first, self.user = np.unique(users, return_index=True, return_inverse=True)
        self.size, self.list, self.n = size[first].astype(np.float64), lists_, np.bincount(lists_, minlength=n_lists)

    def by_user(self, at=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        user, lists_ = self.user[at], self.list[at]
        order = np.argsort(user, kind="stable")
        return user[order], lists_[order]

    def matrix(self, common: np.ndarray, kind, share: float, last: bool) -> np.ndarray:
        """A row for each user: which of the common lists it is in, and what makes a product less by a share of both sizes."""
        out = np.zeros((len(self.ids), int(common.sum()) + 2), kind)
        at = common[self.list]
        out[self.user[at], (np.cumsum(common) - 1)[self.list[at]]] = 1
        out[:, -1 if last else -2], out[:, -2 if last else -1] = -share * self.size, 1
        return out


def pairs_in_tiles(tiles: Tiles, threshold: float):
    """What ``pairs_from`` gives, of a tile. Where many of its users meet, common lists are multiplied as matrices, and rare ones added."""

    def count(batches):
        parts, n_lists, tile = [], 0, None
        for tile, _, body in bodies(batches):
            _, n, users, size = unpack_lists(body)
            parts.append((users, np.repeat(np.arange(n_lists, n_lists + len(n), dtype=np.int32), n), size.astype(np.int32)))
            n_lists += len(n)
        if tile is None:
            return
        body = None  # else what was read stays in memory
        users, which, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        group, same = tiles.groups.of(users), tiles.one[tile] == tiles.two[tile]
        one = Side(*(x[group == tiles.one[tile]] for x in (users, size, which)), n_lists)
        two = one if same else Side(*(x[group == tiles.two[tile]] for x in (users, size, which)), n_lists)
        dense = float((one.n * two.n).sum()) * RARE > float(len(one.ids)) * len(two.ids)
        for u, v, both in multiplied(one, two, same, threshold) if dense else ((u, v, both) for u, _, v, both in met(*one.by_user(), starts_of(two.n), two.n, two.user, len(two.ids))):
            similarity = both / (one.size[u] + two.size[v] - both)
            kept = np.flatnonzero((both > 0) & (similarity >= threshold) & (not same or u < v))
            for a in range(0, len(kept), BODY):
                part = kept[a : a + BODY]
                ids = one.ids[u[part]], two.ids[v[part]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*ids)), pa.array(np.maximum(*ids)), pa.array(similarity[part])], names=["u", "v", "similarity"])

    return count


def multiplied(one: Side, two: Side, same: bool, threshold: float):
    """Users of both sides that may have the similarity, and how many lists they share. As a pair with it shares at least a part of both sizes, that part
    is taken off in the product; whole numbers under it and their parts are told apart in ``kind``."""
    kind = np.float32 if max(one.size.max(), two.size.max()) < 1 << 16 else np.float64
    share = threshold / (1 + threshold)
    common = (one.n * RARE >= len(one.ids)) & (two.n * RARE >= len(two.ids))
    left, right = one.matrix(common, kind, share, True), np.ascontiguousarray(two.matrix(common, kind, share, False).T)
    rare_user, rare_list = one.by_user(~common[one.list])
    starts, n = starts_of(two.n), len(two.ids)
    high = int(min(HIGH, max(1, 8 * BATCH // n)))
    for a in range(0, len(one.ids), high):
        b = min(a + high, len(one.ids))
        held, added = slice(*np.searchsorted(rare_user, [a, b])), None
        if held.stop > held.start:
            added = np.zeros((b - a) * n, np.int64)
            for some in parts_of(two.n[rare_list[held]], 8 * BATCH):
                user, own = rare_user[held][some], rare_list[held][some]
                added += np.bincount(np.repeat((user - a) * n, two.n[own]) + two.user[places(starts[own], two.n[own])], minlength=len(added))
            added = added.reshape(b - a, n).astype(kind)
        for c in range(a if same else 0, n, WIDE):
            d = min(c + WIDE, n)
            over = left[a:b] @ right[:, c:d]
            if added is not None:
                over += added[:, c:d]
            found = np.flatnonzero(over >= (-0.1 if threshold else 0.5))
            u, v = a + found // (d - c), c + found % (d - c)
            yield u, v, np.rint(over.reshape(-1)[found] + share * (one.size[u] + two.size[v])).astype(np.int64)


def firsts(parts: list) -> tuple[np.ndarray, np.ndarray]:
    known, value = (np.concatenate(c) for c in zip(*parts, strict=True))
    known, at = np.unique(known, return_index=True)
    return known, value[at]


def asked(blocks: Blocks, n: int):
    """Whose items a block needs: those of its users and of their neighbours."""

    def route(batches):
        for block, _, body in bodies(batches):
            u, v, _ = unpack(body)
            who = np.unique(np.concatenate([u, v]))
            yield from dealt(bucket(who, n), 1, who, np.full(len(who), block))

    return route


def history_rows(n: int):
    """Histories, to where the requests for them go."""

    def route(batches):
        for batch in batches:
            for body in batch.column("body"):
                users, counts, items = unpack_lists(body.as_buffer())
                to, starts = bucket(users, n), starts_of(counts)
                for b in np.unique(to).tolist():
                    own = np.flatnonzero(to == b)
                    yield rows(to=[b], kind=[0], body=[pack_lists(users[own], counts[own], items[places(starts[own], counts[own])])])

    return route


def answered(batches):
    """The histories that were asked for, for the blocks that did."""
    users, counts, items, who, block = [], [], [], [], []
    for _, kind, body in bodies(batches):
        if kind:
            one, two = unpack(body)
            who.append(one)
            block.append(two)
        else:
            one, two, three = unpack_lists(body)
            users.append(one)
            counts.append(two)
            items.append(three)
    if not who:
        return
    users, counts, items, who, block = map(np.concatenate, (users, counts, items, who, block))
    starts, order = starts_of(counts), np.argsort(users)
    which = order[np.searchsorted(users[order], who)]
    order = np.lexsort((who, block))
    which, block = which[order], block[order]
    new = np.append(True, (which[1:] != which[:-1]) | (block[1:] != block[:-1]))
    which, block = which[new], block[new]
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for part in parts_of(counts[which[a:b]], BODY):
            own = which[a:b][part]
            yield rows(to=[block[a]], kind=[0], body=[pack_lists(users[own], counts[own], items[places(starts[own], counts[own])])])


def rounded(x: np.ndarray) -> np.ndarray:
    """To 9 digits, halves away from zero; ``x`` is not negative."""
    whole = np.floor(x * 1e9)
    return (whole + (x * 1e9 - whole >= 0.5)) / 1e9


def items_of_nearest(neighbours: int, k: int):
    """The k items of each user of a block with the highest sums of similarities."""
    width = max(1, neighbours).bit_length()  # a neighbour's place; the one after the last is the user's own

    def score(batches):
        users, counts, items, pairs = [], [], Column(np.int32), []
        for _, kind, body in bodies(batches):
            if kind:
                pairs.append(unpack(body))
                continue
            one, two, three = unpack_lists(body)
            users.append(one)
            counts.append(two)
            if items.held.dtype == np.int32 and (three.min() < -(1 << 31) or three.max() >= 1 << 31):
                items.held = items.held.astype(np.int64)
            items.add(three)
        body = None  # else what was read stays in memory
        pa.default_memory_pool().release_unused()
        u, v, bits = joined(pairs, np.int64, np.int64, np.int64)
        if not len(u):
            return
        users, counts, items = np.concatenate(users), np.concatenate(counts), items.all()
        every = None
        if items.dtype == np.int64:
            every = np.unique(items)
            items = np.searchsorted(every, items).astype(np.int32)
        null = len(every) - 1 if every is not None and every[-1] == NULL else None
        lowest = int(items.min())
        starts, order = starts_of(counts), np.argsort(users)
        find = lambda x: order[np.searchsorted(users[order], x)]
        by = np.argsort(u, kind="stable")  # a user's neighbours stay in order
        u, v, similarity = u[by], find(v[by]), bits[by].view(np.float64)
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        mine, n_near = u[first], np.diff(np.append(first, len(u)))
        own = find(mine)
        for part in parts_of(np.add.reduceat(counts[v], first) + counts[own], BATCH):
            begin, m = first[part.start], part.stop - part.start
            near = slice(begin, begin + int(n_near[part].sum()))
            slot = places(np.zeros(m, np.int64), n_near[part])
            weight = np.zeros((m, neighbours + 1))
            weight[np.repeat(np.arange(m), n_near[part]), slot] = similarity[near]
            lists_, group = np.append(v[near], own[part]), np.append(np.repeat(np.arange(m), n_near[part]), np.arange(m))
            head = (group << (32 + width)) | np.append(slot, np.full(m, neighbours))
            n = counts[lists_]
            key = items[places(starts[lists_], n)].astype(np.int64) - lowest
            if null is not None:
                key = np.where((key + lowest == null) & (np.repeat(np.arange(len(lists_)), n) >= len(slot)), -1, key)  # own null items are not seen
            kept = key >= 0
            key = ((key << width) | np.repeat(head, n))[kept]
            key.sort()
            at = key >> width
            edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            last = key[np.append(edge[1:], len(key)) - 1] & ((1 << width) - 1)
            score_ = rounded(np.add.reduceat(weight[key >> (32 + width), key & ((1 << width) - 1)], edge))
            fresh = last != neighbours
            at, score_ = at[edge][fresh], score_[fresh]
            group, item = at >> 32, (at & 0xFFFFFFFF) + lowest
            top, rank = best(group, score_, item, k)
            item = item[top] if every is None else every[item[top]]
            yield pa.RecordBatch.from_arrays([pa.array(mine[part][group[top]]), pa.array(item, mask=item == NULL), pa.array(score_[top]), pa.array(rank.astype(np.int32))], names=["user_id", "item", "score", "rank"])

    return score


# ---- the operator ----------------------------------------------------------------------------


def numbered(watches: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
    """Whole numbers in place of other ids, in the same order, and the table that leads back."""
    if isinstance(watches.schema[column].dataType, IntegralType):
        return watches, None
    known = stored(watches.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).select(column, F.monotonically_increasing_id().alias("_n")), "ids")
    return watches.join(known, column, "left").drop(column).withColumnRenamed("_n", column), known


def collect_garbage(spark) -> None:
    """Shuffles that nothing reads any more stay on disk until the driver happens to do this."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lists_in_blocks(watches: DataFrame, nulls_meet: bool = False) -> tuple[DataFrame, DataFrame, tuple, int, dict[str, DataFrame | None]]:
    """Histories, lists of items with several users, what ``Blocks`` and ``layout`` are made of, among how many tasks rows are dealt, and what leads back to ids. With ``nulls_meet`` the null item is one like others."""
    spark = watches.sparkSession
    reachable(spark)
    seen, user_ids = numbered(watches.select("user_id", "item").where("user_id is not null"), "user_id")
    seen, item_ids = numbered(seen, "item")
    known, null = F.col("item").cast("long"), int(NULL) - nulls_meet
    item = F.when(known >= null, F.raise_error(F.lit("an item's id is the highest long"))).otherwise(F.coalesce(known, F.lit(null)))
    seen = seen.select(F.col("user_id").cast("long").alias("user_id"), item.alias("item"))
    in_order = seen.repartition("user_id").sortWithinPartitions("user_id", "item")
    own = stored(in_order.mapInArrow(histories, "body binary, entries long, lo long, hi long"), "histories")
    known = own.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()[0]
    lo, hi = known.lo or 0, known.hi or 0
    m = max(spark.sparkContext.defaultParallelism, -(-known.entries // ROWS))
    shared = stored(deal(own, m, by_item(m)).mapInArrow(lists(lo, hi), "body binary, weights array<double>"), "lists")
    weights = np.zeros(2 * CELLS)
    for r in shared.select(F.posexplode("weights").alias("cell", "weight")).groupBy("cell").agg(F.sum("weight").alias("weight")).collect():
        weights[r.cell] = r.weight
    collect_garbage(spark)
    return own, shared, (weights[:CELLS], weights[CELLS:], lo, hi, spark.sparkContext.defaultParallelism), m, {"user_id": user_ids, "item": item_ids}


def similar_pairs(watches: DataFrame, threshold: float = 0.0, nulls_meet: bool = False) -> DataFrame:
    """u < v, similarity of all pairs of users with a common item whose Jaccard similarity is ``threshold`` or more.

    Pairs are counted in blocks or tiles, and only those that are given are ever rows; nothing of them is shuffled.
    """
    _, shared, known, _, ids = lists_in_blocks(watches, nulls_meet)
    blocks = layout(*known)
    count = pairs_in_tiles if isinstance(blocks, Tiles) else pairs_from
    out = deal(shared, blocks.n, blocks.lists_for).mapInArrow(count(blocks, threshold), "u long, v long, similarity double")
    for side in "uv":
        if ids["user_id"] is not None:
            out = out.join(ids["user_id"].withColumnRenamed("user_id", "_id"), F.col(side) == F.col("_n"), "left").drop(side, "_n").withColumnRenamed("_id", side)
    return out.select(*(F.col(c).cast(watches.schema["user_id"].dataType).alias(c) for c in "uv"), "similarity")


def recommend_exact(watches: DataFrame, neighbours: int = 20, k: int = 10) -> DataFrame:
    """user_id, item, score, rank: what ``recommend`` gives with the nearest of ``exact_pairs``."""
    spark, kinds = watches.sparkSession, {c: watches.schema[c].dataType for c in ("user_id", "item")}
    own, shared, (weights, _, *rest), n, ids_of = lists_in_blocks(watches)
    blocks = Blocks(weights, *rest)
    near = stored(deal(shared, blocks.n, blocks.lists_for).mapInArrow(nearest(blocks, neighbours), DEALT), "nearest")
    forget(shared)
    collect_garbage(spark)
    histories_ = own.mapInArrow(history_rows(n), DEALT).unionByName(near.mapInArrow(asked(blocks, n), DEALT))
    there = deal(histories_, n).mapInArrow(answered, DEALT).unionByName(near)
    out = deal(there, blocks.n).mapInArrow(items_of_nearest(neighbours, k), "user_id long, item long, score double, rank int")
    for column, ids in ids_of.items():
        if ids is not None:
            out = out.join(ids.withColumnRenamed(column, "_id"), F.col(column) == F.col("_n"), "left").drop(column, "_n").withColumnRenamed("_id", column)
    return out.select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("user_id", "item")), "score", "rank")
