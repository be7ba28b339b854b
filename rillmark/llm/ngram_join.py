"""N-gram Jaccard join and its components.

A document's set holds its distinct shingles of ``SHINGLE`` words (64-bit hashes; A-Z lower-cased,
words between ASCII white space). Documents of equal sets are one class, and only classes go on.

* Order: a sketch of ``BUCKETS`` counters over all documents ranks shingles from rare to common.
  Any one order is right; this one keeps common passages out of what follows.
* Tiles: of n shingles the first n - ceil(3n/4) + 1 in that order are a class's tokens, the first
  n - ceil(6n/7) + 1 of these its leading ones. Two classes with a similarity of 3/4 share a token
  that leads in the smaller one. A tile is the classes of a token, in the order of their sizes;
  a class without another one in the band of sizes that can reach 3/4 leaves the tile. Tokens with
  the same classes are one tile, so that long texts meet once and not once for each passage.
* Parts: tokens in more than ``MANY`` classes are counted exactly (only where the sketch allows for
  so many) and dealt over parts before they are sorted; tiles whose bitmaps need more than
  ``PART_BYTES`` are dealt over parts before they are compared. Both bounds are absolute.
* Forest: tiles are compared within the band by coarse parity bitmaps (about a bit a shingle; of
  two widths the wider one is folded). The bits in which two bitmaps differ bound the difference
  of the sets from below, so the overlap from above. A tile hands over the pairs that connect its
  classes, fewer than it has classes, and the classes between which it held others back, by the
  group that they were connected to. The pairs are verified.
* The rest: such groups, and tiles that came in parts, whose classes are of several components
  still, are compared once more, by fine bitmaps (eight bits a shingle and more), and hand over all
  pairs of different components. Of a group the classes of its largest component stand in one block
  each; only the others visit every block.
* Verification: what the bitmaps leave is intersected exactly as sorted arrays.

Nothing is dropped for its frequency: the components equal those of all links. A link needs equal
64-bit hashes of shingles; sets are taken for equal by 128 bits of hash.

A group in which most classes are of different components is compared all with all by its bitmaps,
n**2 / ``BLOCK`` rows: the method has no bound for classes that share a rare token, have the same
size and are not linked.

Defined results: a null text, or one without words, has an empty set and is a component of its
own; fewer words than ``SHINGLE`` are one shingle; repeated rows are documents of equal sets; the
component is the least id reachable, ids of null aside; very long texts are taken whole; an empty
table gives no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, row_key, slices, table, texts_of, written
from .components import components

SHINGLE = 5
BUCKETS, CHUNK = 1 << 20, 1 << 14
NARROWEST, WIDEST = 256, 1 << 20
#: Eighths of a bit for a shingle, at least, in coarse and in fine bitmaps.
COARSE, FINE = 6, 64
MEMO = 200_000
#: Rows of a token that one task is meant to sort, bytes of a tile that are compared at once, and
#: classes of a block.
MANY, PART_BYTES, BLOCK = 1 << 20, 1 << 22, 1000
FILTER_BITS = 1 << 24
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_weights = np.random.default_rng(5).integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


def shingles(text: str | None, memo: WordHashes) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    n = len(w) - size + 1
    out = np.full(n, np.uint64(size) * _weights[SHINGLE])
    for j in range(size):
        out += w[j : j + n] * _weights[j]
    out ^= out >> np.uint64(31)
    out *= _weights[0]
    out ^= out >> np.uint64(29)
    out.sort()
    keep = np.ones(n, bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def sketch(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many documents have a shingle of each bucket: BUCKETS numbers, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        memo, total = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in texts_of(batch.column(0)):
                held.append(bucket(shingles(text, memo)))
                size += len(held[-1])
                if size > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        parts = [zlib.compress(total[i : i + CHUNK].astype(np.uint32 if total.max() < 1 << 32 else np.int64).tobytes(), 1) for i in range(0, BUCKETS, CHUNK)]
        wide = [bool(total.max() >= 1 << 32)] * len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array(wide)], names=["part", "data", "wide"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for data, wide in zip(group.column("data").to_pylist(), group.column("wide").to_pylist(), strict=True):
            total += np.frombuffer(zlib.decompress(data), np.int64 if wide else np.uint32)
        return pa.table({"part": group.column("part").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "part int, data binary, wide boolean")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("part").applyInArrow(add, "part int, data binary").collect():
        out[r.part * CHUNK : (r.part + 1) * CHUNK] = np.frombuffer(r.data, np.int64)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Rank of every bucket: 0 up to eight times the usual load, then one more for each doubling."""
    usual = max(1.0, float(np.median(counts)))
    return np.clip(np.ceil(np.log2(np.maximum(counts, 1) / (8 * usual))), 0, 15).astype(np.uint8)


def prefix(n: int, top: int, of: int) -> int:
    """How many of n shingles are tokens, if at least top/of of them have to be shared."""
    return n - -(-top * n // of) + 1 if n else 0


def set_rows(docs: DataFrame, id_col: str, text_col: str, counts: np.ndarray) -> DataFrame:
    """id, key, n, d (128-bit hash of the set), coarse bitmap, tokens and how many of them lead, of
    every row."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(np.unpackbits(levels(counts)[:, None], axis=1)[:, 4:], axis=None))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        four = np.unpackbits(shared.value).reshape(-1, 4)
        rank = (four @ np.array([8, 4, 2, 1], np.uint8)).astype(np.uint64)
        memo = WordHashes()
        for batch in batches:
            for part in slices(batch, 2):
                n, d, maps, lead, tokens = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text, memo)
                    n.append(len(s))
                    d.append(xxhash.xxh3_128_digest(s.tobytes()))
                    maps.append(bitmap(s, COARSE))
                    lead.append(prefix(len(s), 6, 7))
                    order = np.argsort((rank[bucket(s)] << np.uint64(60)) | (s >> np.uint64(4)), kind="stable")[: prefix(len(s), 3, 4)]
                    tokens.append(s[order].view(np.int64))
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in tokens])), pa.int32())
                cols = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(maps, pa.binary()), pa.array(lead, pa.int32())]
                cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens))))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "n", "d", "bitmap", "lead", "tokens"])

    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, key long, n long, d binary, bitmap binary, lead int, tokens array<long>")


def bitmap(s: np.ndarray, eighths: int) -> bytes:
    """Parity of the number of shingles at each bit; a map of half the width is the two halves'
    exclusive or."""
    width = NARROWEST
    while width < min(eighths * len(s) // 8, WIDEST):
        width *= 2
    at = (s & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(bool), bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of several widths, and in how many bits pairs of them differ."""

    def __init__(self, column: pa.Array):
        data = column.to_pylist()
        self.words = np.fromiter((len(d) // 8 for d in data), np.int64, len(data))
        self.place: dict[int, np.ndarray] = {}
        self.maps: dict[int, np.ndarray] = {}
        for width in np.unique(self.words).tolist():
            own, wider = np.flatnonzero(self.words == width), np.flatnonzero(self.words == 2 * width)
            maps = np.frombuffer(b"".join([data[i] for i in own]), np.uint64).reshape(-1, width)
            if len(wider):
                both = np.frombuffer(b"".join([data[i] for i in wider]), np.uint64).reshape(-1, 2, width)
                maps = np.concatenate([maps, both[:, 0] ^ both[:, 1]])
            self.maps[width] = maps
            self.place[width] = np.zeros(len(data), np.int64)
            self.place[width][np.append(own, wider)] = np.arange(len(maps))

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of sets whose sizes are within a band the widths are equal or one is twice the other;
        for all others the answer is so large that they can't link."""
        low, high = np.minimum(self.words[a], self.words[b]), np.maximum(self.words[a], self.words[b])
        out = np.full(len(a), 1 << 50)
        for width in np.unique(low).tolist():
            at = np.flatnonzero((low == width) & (high <= 2 * width))
            place, maps = self.place[width], self.maps[width]
            for i in range(0, len(at), 4096):
                k = at[i : i + 4096]
                out[k] = np.bitwise_count(maps[place[a[k]]] ^ maps[place[b[k]]]).sum(axis=1, dtype=np.int64)
        return out


def in_band(n_a, n_b):
    return 4 * np.minimum(n_a, n_b) >= 3 * np.maximum(n_a, n_b)


def could_link(n_a: np.ndarray, n_b: np.ndarray, maps: Bitmaps, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether 7 * overlap >= 3 * (n_a + n_b) with the greatest overlap that the bitmaps allow."""
    fits = in_band(n_a, n_b)
    some = np.flatnonzero(fits)
    fits[some] = n_a[some] + n_b[some] >= 7 * maps.differing(a[some], b[some])
    return fits


def class_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d and s (the sorted shingles) of the classes, given with the key of one row of each.

    A bit filter of fixed size tells which rows are read again. It lets through some rows of other
    classes, and equal rows twice; who joins by d doesn't mind.
    """
    at = F.pmod("key", F.lit(FILTER_BITS))
    words = classes.groupBy(F.shiftright(at, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}) & 63 as int))")).alias("w")).toArrow()
    bit_filter = np.zeros(FILTER_BITS // 64, np.int64)
    bit_filter[words.column("at").to_numpy()] = words.column("w").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter.tobytes())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(shared.value, np.int64)
        memo = WordHashes()
        for batch in batches:
            bit = batch.column(0).to_numpy() % FILTER_BITS
            texts = batch.column(1).take(pa.array(np.flatnonzero((wanted[bit >> 6] >> (bit & 63)) & 1)))
            for part in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0):
                found = [shingles(t, memo).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in found], pa.binary()), pa.array(found, pa.binary())], names=["d", "s"])

    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("t"))
    return written(texts.mapInArrow(sets, "d binary, s binary"), "sets")


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 3/4 or more."""
    named = pairs.join(classes.select(F.col("c").alias("a"), F.col("d").alias("d_a")), "a").join(classes.select(F.col("c").alias("b"), F.col("d").alias("d_b")), "b")
    both = named.join(sets.toDF("d_b", "s_b"), "d_b").join(sets.toDF("d_a", "s_a"), "d_a")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                fits.append(7 * int((y[at] == x).sum()) >= 3 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(fits, pa.bool_())) for x in ("a", "b")], names=["a", "b"])

    return written(both.select("a", "b", "s_a", "s_b").mapInArrow(intersect, "a long, b long"), "links", rows)


TILE = ("t", "x")


def tile_pairs(rows: DataFrame, everything: bool) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a tile and may link.

    ``rows`` have t, x (the tile), c, root, n, lead (a token leads), home (of two that are not, no
    pair is asked for) and bitmap, sorted by tile and size. Unless ``everything`` is asked for, a tile hands over a forest, and rows without
    b: classes a (with t, n, lead) of a group g of the tile in which pairs were held back.
    """

    def out(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = np.stack([batch.column(x).to_numpy() for x in TILE], axis=1)
        c, root, n = (batch.column(x).to_numpy() for x in ("c", "root", "n"))
        lead, home = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("lead", "home"))
        maps = Bitmaps(batch.column("bitmap"))
        cut = np.flatnonzero(np.append(True, (t[1:] != t[:-1]).any(axis=1)))
        size = np.diff(np.append(cut, len(t)))
        tile = np.repeat(np.arange(len(cut)), size)
        end = np.repeat(cut + size, size)
        # rows are in size order: of each row the partners follow it, up to 4/3 of its size
        stride = np.int64(4 * n.max() + 1)
        last = np.minimum(np.searchsorted(tile * stride + 3 * n, tile * stride + np.minimum(4 * n, stride - 1), side="right"), end)
        many = np.maximum(last - np.arange(len(n)) - 1, 0)
        name, pairs = root.copy(), []
        held: list[tuple[int, int]] = []  # row, group

        def find(owner: dict, r: int) -> int:
            while r in owner:
                r = owner[r]
            return r

        owner: dict[int, int] = {}
        between: set[int] = set()
        of_tile = -1

        def settle() -> None:
            held.extend((r, find(owner, int(root[r]))) for r in sorted(between))
            between.clear()

        step = 0
        while step < len(n):
            # so many rows that they have a bounded number of partners
            upto = max(step + 1, int(np.searchsorted(np.cumsum(many[step : step + 4096]), 200_000)) + step)
            k = many[step:upto]
            a = np.repeat(np.arange(step, step + len(k)), k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            step += len(k)
            some = (root[a] != root[b]) & (lead[a] | (lead[b] & (n[a] == n[b]))) & (home[a] | home[b])
            a, b = a[some], b[some]
            some = could_link(n[a], n[b], maps, a, b)
            a, b = a[some], b[some]
            if everything:
                pairs.append((c[a], c[b]))
                continue
            # what is connected since an earlier step; only one tile can go on from there
            met = name[a] == name[b]
            if met.any():
                between.update(np.unique(np.append(a[met], b[met])).tolist())
                a, b = a[~met], b[~met]
            kept = []
            for i, (x, y, where) in enumerate(zip(root[a].tolist(), root[b].tolist(), tile[a].tolist(), strict=True)):
                if where != of_tile:
                    settle()
                    owner.clear()
                    of_tile = where
                x, y = find(owner, x), find(owner, y)
                if x == y:
                    between.update((int(a[i]), int(b[i])))
                else:
                    owner[max(x, y)] = min(x, y)
                    kept.append(i)
            pairs.append((c[a[kept]], c[b[kept]]))
            if step < len(n) and tile[step] == of_tile:
                rest = slice(step, int(end[step]))
                name[rest] = [find(owner, x) for x in root[rest].tolist()]
        settle()
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        r = np.array([x for x, _ in held], np.int64)
        none = [None] * len(found)
        cols = [found[:, 0].tolist() + c[r].tolist(), found[:, 1].tolist() + [None] * len(r), none + t[r, 0].tolist(), none + [g for _, g in held], none + n[r].tolist()]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(none + lead[r].tolist(), pa.bool_())], names=["a", "b", "t", "g", "n", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = np.stack([batch.column(x).to_numpy() for x in TILE], axis=1)
            change = np.flatnonzero((t[1:] != t[:-1]).any(axis=1))
            cut = int(change[-1]) + 1 if len(change) else 0  # the last tile may go on
            if not cut and rest and all(rest[0].column(x)[0] == batch.column(x)[0] for x in TILE):
                rest.append(batch)
                continue
            if rest or cut:
                yield out(pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()[0])
            rest = [batch.slice(cut)]
        if rest:
            yield out(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, "a long, b long, t long, g long, n long, lead boolean")


def in_tiles(rows: DataFrame) -> DataFrame:
    return rows.select(*TILE, "c", "root", "n", "lead", "home", "bitmap").repartition(*TILE).sortWithinPartitions(*TILE, "n")


def rooted(df: DataFrame, found: DataFrame | None) -> DataFrame:
    """Adds root, a class's component so far."""
    if found is None:
        return df.withColumn("root", F.col("c"))
    return df.join(found, "c", "left").withColumn("root", F.coalesce("root", "c"))


def classes_of(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct().join(classes, "c")


def dealt(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """Adds o, the token, and salt to rows of tokens with more than ``MANY`` classes; null and 0 for
    others. Buckets of the sketch with so many shingles tell which tokens are counted."""
    full = np.flatnonzero(counts > MANY).tolist()
    if not full:
        return rows.withColumn("o", F.lit(None).cast("long")).withColumn("salt", F.lit(0).cast("long"))
    buckets = rows.sparkSession.createDataFrame([(x,) for x in full], "bucket long")  # BUCKETS at most
    asked = rows.select("t", F.shiftrightunsigned("t", 44).alias("bucket")).join(F.broadcast(buckets), "bucket")
    often = written(asked.groupBy("t").agg(F.count("*").alias("often")).where(F.col("often") > MANY), "often")
    parts = F.ceil(F.col("often") / MANY).cast("long")
    both = rows.join(often.withColumn("o", F.col("t")), "t", "left")
    return both.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("c"), parts), F.lit(0).cast("long"))).drop("often")


def tiles_of(classes: DataFrame, counts: np.ndarray) -> DataFrame:
    """t (tile), x (part), c, n, lead, and o (what the parts of a tile have in common, if there are
    several), of classes given with n, lead and tokens, that have company of their size."""
    rows = classes.select("c", "n", F.col("lead").alias("l"), F.posexplode("tokens").alias("i", "t"))
    rows = dealt(rows.select("t", "c", (F.col("n") * 2 + (F.col("i") < F.col("l")).cast("long")).alias("m")), counts)
    part = Window.partitionBy("t", "salt")
    near = rows.withColumn("_b", F.shiftright(F.lag("m").over(part.orderBy("m")), 1)).withColumn("_a", F.shiftright(F.lead("m").over(part.orderBy("m")), 1))
    size = F.shiftright("m", 1)
    near = near.where((4 * F.col("_b") >= 3 * size) | (3 * F.col("_a") <= 4 * size) | F.col("o").isNotNull())
    # tokens with the same classes are one tile
    own = F.when(F.col("o").isNull(), F.bit_xor(F.xxhash64("c")).over(part)).otherwise(F.xxhash64("t", "salt"))
    weight = F.sum(F.lit(200) + F.shiftright("m", 4)).over(part)
    same = near.select("c", "m", "o", own.alias("t"), weight.alias("weight")).repartition("c")
    tiles = same.groupBy("c", "t").agg(F.max("m").alias("m"), F.max("weight").alias("weight"), F.first("o").alias("o"))
    parts = F.ceil(F.col("weight") / PART_BYTES).cast("long")
    x = F.pmod(F.xxhash64("c", F.lit(1)), parts)
    return tiles.select("t", x.alias("x"), "c", F.shiftright("m", 1).alias("n"), (F.col("m") % 2 == 1).alias("lead"), F.coalesce("o", F.when(parts > 1, F.col("t"))).alias("o"))


def visited(left: DataFrame) -> DataFrame:
    """The rows of groups (t) with classes of several components, in blocks (x): classes of a group's
    largest component are in one block each, at home; the others visit all its blocks."""
    by_root = left.groupBy("t", "root").agg(F.count("*").alias("n"))
    groups = by_root.groupBy("t").agg(F.max(F.struct("n", "root"))["root"].alias("largest"), F.sum("n").alias("rows"), F.count("*").alias("roots")).where("roots > 1")
    mine = left.join(groups.drop("roots"), "t").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("long")).withColumn("own", F.pmod(F.xxhash64("c"), "blocks"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    mine = mine.withColumn("x", F.explode(F.when(F.col("root") == F.col("largest"), F.array("own")).otherwise(everywhere)))
    return mine.select("t", "x", "c", "n", "lead", "root", (F.col("x") == F.col("own")).alias("home"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, key, n_shingles, class_id (the least id of an equal set), group_id (equal within
    a component) and component_id of every row."""
    counts = sketch(docs, text_col)
    sets = set_rows(docs, id_col, text_col, counts).withColumn("r", F.monotonically_increasing_id())
    sets = written(sets, "shingle-sets")
    size = sets.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).collect()[0]
    docs_n, tokens_n = size.docs, size.shingles // 4 + size.docs
    filled = sets.where("n > 0")
    # a class is named by its least row number, which takes less room in a shuffle than a hash
    classes = filled.groupBy("d").agg(F.min("r").alias("c"), *(F.first(x).alias(x) for x in ("n", "bitmap")), *(F.min(x).alias(x) for x in ("id", "key")))
    classes = written(classes, "classes", docs_n)
    tokens = filled.groupBy("d").agg(F.min("r").alias("c"), *(F.first(x).alias(x) for x in ("n", "lead", "tokens")))
    tiles = written(tiles_of(tokens, counts), "tiles", tokens_n)

    first = tiles.join(classes.select("c", "bitmap"), "c").withColumn("root", F.col("c")).withColumn("home", F.lit(True))
    handed = written(tile_pairs(in_tiles(first), False), "handed", tiles.count())
    pairs = written(handed.where("b is not null").select("a", "b").distinct(), "pairs", docs_n)
    links = verified(pairs, classes, class_sets(docs, classes_of(pairs, classes), id_col, text_col), docs_n)
    found = components(links, docs_n) if links.take(1) else None

    # what is left: groups between which pairs were held back, and tiles in parts, of several components
    parted = tiles.where("o is not null").select(F.col("o").alias("t"), F.lit(0).cast("long").alias("g"), "c", "n", "lead")
    held = handed.where("b is null").select("t", "g", F.col("a").alias("c"), "n", "lead").unionByName(parted)
    mine = written(visited(written(rooted(held.select(F.xxhash64("t", "g").alias("t"), "c", "n", "lead"), found), "left", tiles.count() + docs_n)), "mixed", tiles.count() + docs_n)
    if mine.take(1):
        own = mine.select("c").distinct().join(classes, "c")
        own_sets = class_sets(docs, own, id_col, text_col)

        def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                maps = [bitmap(np.frombuffer(s.as_buffer(), np.uint64), FINE) for s in batch.column("s")]
                yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(maps, pa.binary())], names=["d", "bitmap"])

        maps = own_sets.mapInArrow(fine, "d binary, bitmap binary").join(own.select("d", "c"), "d").groupBy("c").agg(F.first("bitmap").alias("bitmap"))
        rest = tile_pairs(in_tiles(mine.join(maps, "c")), True).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        rest = written(rest, "rest", docs_n)
        more = verified(rest, classes, own_sets, docs_n)
        if more.take(1):
            # components of components: links between the roots found so far
            root = rooted(classes.select("c"), found)
            ends = more.join(root.toDF("a", "x"), "a").join(root.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            above = components(ends, docs_n)
            found = root.join(above.toDF("root", "top"), "root", "left").select("c", F.coalesce("top", "root").alias("root"))

    least = written(rooted(classes.select("c", "d", F.col("id").alias("least")), found), "roots", docs_n)
    label = least.groupBy("root").agg(F.min("least").alias("label"))
    of_class = least.join(label, "root").select("d", "root", "label", "least")
    out = sets.select("id", "key", "n", "d", "r").join(of_class, "d", "left")
    filled = F.col("n") > 0
    return out.select(
        F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), F.when(filled, F.col("least")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("root", "r").alias("group_id"), F.when(filled, F.col("label")).otherwise(F.col("id")).alias("component_id"),
    )


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
