"""Periodic runs of words, by the longest previous factors of a text.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), of
at least ``exponent`` periods and ``least`` words, that no neighbouring word extends.

1. Suffixes of all texts of a slice are sorted together, each text by itself, by doubling: only classes that aren't told apart
   yet are sorted again, and the classes of every length 1, 2, 4, ... are kept. These compare any two places of a text
   in a few array steps, forwards and backwards; that gives the LCP array.
2. The nearest suffixes in that order that begin earlier in the text, with the least LCP on the way, give the longest
   previous factor of every place, found by jumping over pointers; texts whose chains don't shorten in
   ``JUMPS`` rounds are done by a stack, one place after the other. From these follow the LZ blocks.
3. Main's extensions: at the boundary of two blocks a stretch of period p crosses or touches it where places p apart are equal
   around the boundary. A run's last boundary bounds its period: if a whole period lay before the previous
   block, that block would have been longer. So for blocks of a and b words only (exponent - 1) * p < a + b is looked at,
   at all boundaries at once.
4. A run inside a block is a copy of a run inside the block's source: runs are kept in buckets by start and copied, block after block.

Steps 1 to 3 are array operations over some megabytes of texts, step 4 a loop over the long blocks of texts with a run.
Spark deals out the texts; nothing is shuffled. One text is in one task, whole, with some 200 bytes of memory for each of its words,
and more for repetitive ones (4 bytes a word for each doubling). A lost executor's tasks are repeated from the input.

Results: a null, empty or wordless text has no words and no runs, and an empty text is kept of it. Very long texts are taken whole. Repeated rows are each
judged alone. An empty table has no rows. Other columns than those named go, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, table, texts_of

EXPONENT, LEAST = 4, 6
#: Rounds of pointer jumping before a text is done by a stack.
JUMPS = 40
RUN = "struct<start:long,length:long,period:long>"


def first_of(new: np.ndarray) -> np.ndarray:
    """For each place the last place up to it that begins a class."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def begins(keys: np.ndarray) -> np.ndarray:
    return np.append(True, keys[1:] != keys[:-1])[: len(keys)]


class Suffixes:
    """Sorted suffixes of the texts of a slice.

    ``doc`` has the text of every place, ``low`` and ``high`` where that text begins and ends. ``levels`` has, for
    the lengths 1, 2, 4, ..., the class of every place by so many words; what ends before is a class of its own.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n = len(words)
        ends = np.cumsum(sizes)
        self.ends, self.starts = ends, ends - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.low, self.high = self.starts[self.doc], ends[self.doc]
        keys = self.doc * (int(words.max()) + 1) + words
        order = np.argsort(keys, kind="stable")
        new = begins(keys[order])
        rank = np.empty(n, np.int32)
        rank[order] = first_of(new)
        self.levels, reach = [(1, rank)], 1
        todo = order[~(new & np.append(new[1:], True))]
        while len(todo):
            after = todo + reach
            second = np.where(after < self.high[todo], rank[np.minimum(after, n - 1)] + np.int64(1), 0)
            held = rank[todo]
            keys = held * np.int64(n + 1) + second
            order = np.argsort(keys, kind="stable")
            held, todo = held[order], todo[order]
            new = begins(keys[order])
            rank = rank.copy()
            rank[todo] = held + first_of(new) - first_of(begins(held))
            reach *= 2
            self.levels.append((reach, rank))
            todo = todo[~(new & np.append(new[1:], True))]
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and y (x < y, of one text) on are equal."""
        x, y, far = x.copy(), y.copy(), len(self.doc) - 1
        end, begun = self.ends[self.doc[x]], y.copy()
        for length, rank in reversed(self.levels):
            equal = (y < end) & (rank[np.minimum(x, far)] == rank[np.minimum(y, far)])
            x += length * equal
            y += length * equal
        return y - begun

    def backward(self, x: np.ndarray, y: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many words up to x and y (x < y), both counted, are equal; x may be before ``low``."""
        x, y, begun = x.copy(), y.copy(), y.copy()
        for length, rank in reversed(self.levels):
            there = x - length + 1 >= low
            equal = there & (rank[np.where(there, x - length + 1, 0)] == rank[np.where(there, y - length + 1, 0)])
            x -= length * equal
            y -= length * equal
        return begun - y

    def lcp(self) -> np.ndarray:
        """Of each suffix with the one before it in order; 0 at the first."""
        first_words = self.levels[0][1][self.order]
        at = np.flatnonzero(~begins(first_words))
        out = np.zeros(len(self.order), np.int64)
        one, two = self.order[at - 1], self.order[at]
        out[at] = self.forward(np.minimum(one, two), np.maximum(one, two))
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest factor that begins at each place and at an earlier one too, and that one."""
        n, common = len(self.order), self.lcp()
        near, reach, slow = [], [], np.zeros(0, np.int64)
        for step, met in ((-1, common), (1, np.append(common[1:], 0))):
            to, least = np.clip(np.arange(n) + step, 0, n - 1), met.copy()
            active = np.flatnonzero(least > 0)
            for _ in range(JUMPS):
                active = active[(least[active] > 0) & (self.order[to[active]] > self.order[active])]
                if not len(active):
                    break
                over = to[active]
                onward, smaller = to[over], np.minimum(least[active], least[over])
                to[active], least[active] = onward, smaller
            else:
                active = active[(least[active] > 0) & (self.order[to[active]] > self.order[active])]
                slow = np.append(slow, self.doc[self.order[active]])
            near.append(to)
            reach.append(least)
        left = reach[0] >= reach[1]
        length, source = np.empty(n, np.int64), np.empty(n, np.int64)
        length[self.order] = np.where(left, reach[0], reach[1])
        source[self.order] = self.order[np.where(left, near[0], near[1])]
        for d in np.unique(slow):
            a, b = int(self.starts[d]), int(self.ends[d])
            length[a:b], source[a:b] = by_stack(self.order[a:b].tolist(), common[a:b].tolist())
        return length, source


def by_stack(order: list[int], common: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors of one text from its sorted suffixes (places of the slice, together its range)."""
    base = min(order)
    length, source = np.zeros(len(order), np.int64), np.arange(base, base + len(order))
    stack: list[list[int]] = []  # place, and its LCP with what is below it

    def offer(place: int, n: int, other: int) -> None:
        if n > length[place - base]:
            length[place - base], source[place - base] = n, other

    for place, met in zip([*order, -1], [*common, 0], strict=True):
        while stack and stack[-1][0] > place:
            above, down = stack.pop()
            if place >= 0:
                offer(above, met, place)
            met = min(met, down)
        if stack and place >= 0:
            offer(place, met, stack[-1][0])
        stack.append([place, met])
    return length, source


def blocks_of(length: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> list[list[int]]:
    """Where the LZ blocks of each text begin; texts of fewer words than a run have none."""
    steps, out = np.maximum(length, 1).tolist(), []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        begun = []
        if b - a >= least:
            while a < b:
                begun.append(a)
                a += steps[a]
        out.append(begun)
    return out


def at_boundaries(suffixes: Suffixes, begun: list[list[int]], exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the runs that cross or touch a boundary of blocks, by start."""
    none = np.zeros(0, np.int64)
    counts = np.array([len(b) for b in begun], np.int64)
    place = np.array([x for b in begun for x in b], np.int64)
    if not len(place):
        return none, none, none
    owner = np.repeat(np.arange(len(begun)), counts)
    last = np.append(owner[1:] != owner[:-1], True)
    end = np.where(last, suffixes.ends[owner], np.append(place[1:], 0))
    size = end - place
    both = size + np.where(last, 0, np.append(size[1:], 0))  # of the blocks before and after each block's end
    most, fewest = (both - 1) // (exponent - 1), np.maximum(1, least + 1 - both)
    many = np.maximum(0, most - fewest + 1)
    which = np.repeat(np.arange(len(place)), many)
    if not len(which):
        return none, none, none
    period = fewest[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    at, low, high = end[which], suffixes.starts[owner[which]], suffixes.ends[owner[which]]
    found = []
    for back, ahead in ((period, 0), (0, period)):  # a period before the boundary, or after it
        x, y = at - back, at + ahead
        ok = (x >= low) & (y <= high)
        x, y, p, lo, hi = x[ok], y[ok], period[ok], low[ok], high[ok]
        after = np.zeros(len(x), np.int64)
        inside = y < hi
        after[inside] = suffixes.forward(x[inside], y[inside])
        before = suffixes.backward(x - 1, y - 1, lo)
        a, b = x - before, y + after
        runs = b - a >= np.maximum(least, exponent * p)
        found.append((a[runs], b[runs], p[runs]))
    start, stop, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    keep = begins(start) | begins(stop)
    return start[keep], stop[keep], period[keep]


def with_copies(runs: list[tuple[int, int, int]], begun: list[int], high: int, source: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Adds the runs inside the blocks, each a copy of one inside the block's source, by buckets of starts."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, stop, period in runs:
        buckets.setdefault(start, []).append((stop, period))
    for at, end in zip(begun, [*begun[1:], high], strict=True):
        if end - at < least + 2:
            continue
        shift = at - int(source[at])
        for start in range(at - shift + 1, end - shift - least):
            for stop, period in buckets.get(start, ()):
                if stop < end - shift and (stop + shift, period) not in buckets.setdefault(start + shift, []):
                    buckets[start + shift].append((stop + shift, period))
    return [(start, stop, period) for start, rest in buckets.items() for stop, period in rest]


def runs_of(words: np.ndarray, sizes: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of all runs, by start and period, of each text that has one; ``words`` has
    the texts' words as numbers, one text after the other."""
    if not len(words):
        return {}
    suffixes = Suffixes(words, sizes)
    length, source = suffixes.previous_factors()
    begun = blocks_of(length, suffixes.starts, suffixes.ends, least)
    found: dict[int, list[tuple[int, int, int]]] = {}
    start, stop, period = at_boundaries(suffixes, begun, exponent, least)
    for d, *run in zip(suffixes.doc[start].tolist(), start.tolist(), stop.tolist(), period.tolist(), strict=True):
        found.setdefault(d, []).append(tuple(run))
    for d, runs in found.items():
        low = int(suffixes.starts[d])
        whole = with_copies(runs, begun[d], int(suffixes.ends[d]), source, least)
        found[d] = sorted((a - low, b - a, p) for a, b, p in whole)
        found[d].sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by a space."""
    kept = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        kept[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, kept, strict=True) if k])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """id_col, n_words, runs (array of start, length, period) and kept_text of every row.

    Words are what ASCII white space separates. ``exponent`` is 2 at least.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    kind = docs.schema[id_col].dataType
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t.encode().split() if t else [] for t in texts_of(part.column(1))]
                sizes = np.array([len(t) for t in texts], np.int64)
                words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
                found = runs_of(words, sizes, exponent, least)
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(d, ())] for d in range(len(texts))]
                kept = [collapsed(t, found[d]) if d in found else b" ".join(t) for d, t in enumerate(texts)]
                columns = [part.column(0), pa.array(sizes), pa.array(runs, pa.list_(fields)), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "kept_text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, n_words long, runs array<{RUN}>, kept_text string").withColumnRenamed("id", id_col)


def highest(runs: Column) -> Column:
    """The run of most periods; ties to the first by start and period. Null without runs."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(more(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    """A line of start,length,period for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text: a tenth of the texts, by the id's CRC-32, are periodic from some word on; a null id never is."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    shaped = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    altered = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    return shaped.select("doc_id", F.when(F.col("a").isNotNull(), altered).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", highest(F.col("runs")))
    exponent = F.expr("1000 * best.length div best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        exponent.alias("exponent_milli"), F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, cast(doc_id as varchar) s from documents),
h as (select doc_id, w, len(w) n, xor(list_reduce(range(8 * length(s)), lambda c, t:
  xor((case when t % 8 = 0 then xor(c, ascii(substr(s, t // 8 + 1, 1))::bigint) else c end) // 2,
      case when (case when t % 8 = 0 then xor(c, ascii(substr(s, t // 8 + 1, 1))::bigint) else c end) % 2 = 1 then 3988292384 else 0 end), 4294967295), 4294967295) h from d),
g as (select doc_id, w, n, case when h % 10 = 0 and n > 0 then (h // 10) % n end a, h // 10 g from h),
p as (select *, 1 + (n - a) // (3 + g % 8) p from g),
t as materialized (select doc_id, n, i, w[1 + case when i < a then i else coalesce(a + (i - a) % p, i) end] x from p, unnest(range(n)) u(i)),
same as (select a.doc_id, b.i - a.i q, b.i from t a join t b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n),
lanes as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) lane from same),
stretch as (select doc_id, q, min(i) - q as "start", count(*) + q as "length" from lanes group by doc_id, q, lane having count(*) + q >= greatest(6, 4 * q)),
runs as materialized (select doc_id, "start", "length", min(q) period from stretch group by 1, 2, 3),
best as (select * from runs qualify row_number() over (partition by doc_id order by "length"::double / period desc, "start", period) = 1),
lines as (select doc_id, count(*) n_runs, string_agg("start" || ',' || "length" || ',' || period || chr(10), '' order by "start", period) lines from runs group by 1),
gone as (select distinct doc_id, i from runs, unnest(range("start" + period, "start" + "length")) u(i)),
kept as (select doc_id, string_agg(x, ' ' order by i) kept from t anti join gone using (doc_id, i) group by 1)
select doc_id, coalesce(n_runs, 0) n_runs, "start", "length", period, 1000 * "length" // period exponent_milli, sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(kept, '')) collapsed_sha256
from d left join lines using (doc_id) left join best using (doc_id) left join kept using (doc_id)"""
