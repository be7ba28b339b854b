"""Removal of repeated passages by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes around it also starts anywhere else, in the same or
in another document. Texts are dealt into shards so that equal strings meet: the start of every
window of ``LENGTH`` bytes belongs to the least hash of a ``GRAM``-byte gram in the window, its
anchor. Neighbouring starts of one anchor (``PIECE`` of them at most, so that a shard is of bounded
size whatever a text repeats) and the bytes that their windows cover are a region.

* Regions are counted by anchor and content, over all documents. A region whose content occurs
  twice is repeated as a whole; an anchor with one content that holds the anchor once has nothing
  repeated. Two contents can only share a window if they agree in the ``BESIDE`` bytes before or
  behind the anchor. Two bit filters, sized by their number up to ``FILTER_BITS``, tell the second pass
  which regions to hand over.
* Only contents that agree so with another one of their anchor, and all of an anchor that stands
  in a content twice, need their bytes compared: each of them goes once into a shard. Shards are sorted as suffix arrays
  (``induced``), and starts whose permuted common prefix, with the suffix before or the one
  behind, has ``LENGTH`` bytes are repeated.
* Anchors with more than ``GROUP`` contents are cut into more shards by what surrounds them. A window of ``LENGTH`` bytes around
  a context of fewer has half of the bytes that are left before it or half of them behind it. So a context grows by
  that half to either side; contents meet again in the shards of these wider contexts, by 128-bit hashes, and those of too many
  contents grow again, to whole windows at the end. A context that is a whole window and stands in two places is repeated.
* Starts go back to their documents as spans; each document is cut once.

Defined results: a null text is empty; matches never cross documents; repeated rows are matches
of each other; texts under ``LENGTH`` bytes keep everything; very long texts are read in parts of ``BATCH``
bytes that overlap by a window; an empty table gives no rows.
Contents are taken for equal by 128 bits of hashes. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, spread, table, texts_of, written
from .induced import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 200, 48
#: A window has so many bytes at least before its anchor, or behind it.
BESIDE = (LENGTH - GRAM) // 2
#: Tells the two bit filters' values apart.
OTHER = 0x5851F42D4C957F2D
SHARD = 1 << 20
#: Starts of a region at most: longer regions (of periodic texts) are several.
PIECE = 1024
#: Contents of an anchor, or of a context, that are one shard at most.
GROUP = 2000
#: Bits of a filter for each value, and bits of all.
SPARSE, FILTER_BITS = 32, 1 << 30
BATCH = 1 << 20


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over ``width`` neighbours from every place on, for places that have so many."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the GRAM bytes from every place on (garbage where fewer are left)."""
    padded = np.frombuffer(data + bytes(GRAM + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + GRAM,), (1,)).copy()
    h = np.full(len(data), np.uint64(GRAM))
    for at in range(0, GRAM, 8):
        h ^= words[at : at + len(data)]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def regions(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """doc, start, end (of the starts), anchor, content hash, whether the anchor is in the region
    more than once, and hashes of the bytes before and behind it (0: fewer than ``BESIDE`` in the
    region), of all regions of the texts; the texts' bytes in a row, and offsets."""
    data = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes) - sizes
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none, none, data, offsets
    h = gram_hashes(data)[: len(data) - GRAM + 1]
    least = _slide(h, width, np.minimum)  # of the windows, by their start
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    whole = np.arange(len(least)) + LENGTH <= (offsets + sizes)[doc]
    change = np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(change & whole)
    edges = np.append(np.flatnonzero(change), len(least))
    last = edges[np.searchsorted(edges, first, side="right")] - 1
    last = np.minimum(last, (offsets + sizes)[doc[first]] - LENGTH)
    cuts = (last - first) // PIECE + 1
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first = np.repeat(first, cuts) + nth * PIECE
    last = np.minimum(first + PIECE - 1, np.repeat(last, cuts))
    anchor = least[first]
    # where the anchors are: grams that are the least of some window
    most = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    chosen = np.flatnonzero(most == h)
    names, rank = np.unique(h[chosen], return_inverse=True)
    key = np.sort(rank * np.int64(len(h)) + chosen)
    own = np.searchsorted(names, anchor) * np.int64(len(h))
    lowest = np.searchsorted(key, own + first)
    twice = np.searchsorted(key, own + last + width - 1, side="right") - lowest > 1
    place = key[lowest] - own
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)), np.uint64, len(first))
    sides = []
    for begin, fits in ((place - BESIDE, place - BESIDE >= first), (place + GRAM, place + GRAM + BESIDE <= last + LENGTH)):
        some = np.flatnonzero(fits)
        side = np.zeros(len(first), np.int64)
        side[some] = np.fromiter((digest(view[x : x + BESIDE]) >> 1 for x in begin[some].tolist()), np.int64, len(some))
        sides.append(side)
    return doc[first], first - offsets[doc[first]], last - offsets[doc[first]], anchor, content, twice, *sides, data, offsets


def _batches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts of about ``BATCH`` bytes: the row of each, where in its text it begins, and its bytes.
    Longer texts come in several parts, in one of which each start has its whole window."""
    part, size = [], 0

    def out() -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        rows, begins, data = zip(*part, strict=True)
        return np.array(rows), np.array(begins), list(data)

    for i, text in enumerate(texts_of(column)):
        data = text.encode() if text else b""
        for begin in range(0, max(1, len(data) - LENGTH + 1), BATCH):
            part.append((i, begin, data[begin : begin + BATCH + LENGTH - 1]))
            size += len(part[-1][2])
            if size >= BATCH:
                yield out()
                part, size = [], 0
    if part:
        yield out()


def counted_regions(docs: DataFrame, text_col: str) -> DataFrame:
    """a (anchor), d (content), n (how often), twice, before and behind of every different region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            for _, _, texts in _batches(batch.column(0)):
                _, _, _, a, d, twice, before, behind, _, _ = regions(texts)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(d.view(np.int64)), pa.array(twice), pa.array(before), pa.array(behind)], names=["a", "d", "twice", "before", "behind"])

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "a long, d long, twice boolean, before long, behind long")
    return rows.groupBy("a", "d").agg(F.count("*").alias("n"), *(F.max(x).alias(x) for x in ("twice", "before", "behind")))


def to_compare(counted: DataFrame, rows: int) -> DataFrame:
    """a, d of the contents that may share a window with another one, or within themselves.

    Contents that occur twice are repeated as they are: they are only there for one that doesn't.
    """
    by_anchor = counted.groupBy("a").agg(F.count("*").alias("contents"), F.max("twice").alias("any"), F.min("n").alias("least"))
    several = by_anchor.where("(contents > 1 or any) and least = 1").select("a", "any")
    asked = written(counted.join(several, "a").select("a", "d", "n", "any", "before", "behind"), "several", rows)
    for side in ("before", "behind"):
        alike = asked.where(F.col(side) != 0).groupBy("a", side).agg(F.count("*").alias("m"), F.min("n").alias("least"))
        alike = alike.where("m > 1 and least = 1").select("a", side, F.lit(True).alias(f"by_{side}"))
        asked = asked.join(alike, ["a", side], "left")
    return written(asked.where("any or by_before or by_behind").select("a", "d"), "compared", rows)


def bit_filter(rows: DataFrame, column) -> np.ndarray:
    """Bits of a column of longs, ``SPARSE`` for each row: FILTER_BITS / 64 numbers at most leave Spark."""
    size = min(FILTER_BITS, 1 << max(16, (SPARSE * rows.count()).bit_length()))
    at = F.pmod(column, F.lit(size))
    bits = rows.select(at.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("w")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[bits.column("at").to_numpy()] = bits.column("w").to_numpy()
    return out


def passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values % (64 * len(bits))
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def shard_starts(rows: DataFrame) -> DataFrame:
    """a, d and spans (first, last) of repeated starts within the region, of regions given with
    their bytes and what they are compared by (g), and sorted by that."""

    def spans_of(parts: list[bytes]) -> list[list[dict]]:
        text = np.concatenate([x for p in parts for x in (np.frombuffer(p, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64))])
        sa = suffix_array(text, 257)
        # a window must lie within its region: the byte 0 between regions may be one of a text
        valid = np.concatenate([np.arange(len(p) + 1) <= len(p) - LENGTH for p in parts])
        prefix = permuted_common_prefixes(b"\0".join(parts) + b"\0", sa, LENGTH)
        one, two = sa[:-1], sa[1:]
        same = (prefix[two] >= LENGTH) & valid[one] & valid[two]
        repeated = np.zeros(len(sa), bool)
        repeated[one[same]] = True
        repeated[two[same]] = True
        out, at = [], 0
        for p in parts:
            hit = np.flatnonzero(repeated[at : at + len(p) - LENGTH + 1])
            cut = np.flatnonzero(np.diff(hit) != 1) + 1
            runs = np.split(hit, cut) if len(hit) else []
            out.append([{"first": int(r[0]), "last": int(r[-1])} for r in runs])
            at += len(p) + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        a, d, parts, size, last = [], [], [], 0, None
        here: set[tuple[int, int]] = set()  # a content of several groups is in a shard once

        def out(n: int) -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(a[:n], pa.int64()), pa.array(d[:n], pa.int64()), pa.array(spans_of(parts[:n]), kind)], names=["a", "d", "spans"])
            del a[:n], d[:n], parts[:n]
            return got

        for batch in batches:
            for g, x, y, z in zip(*(batch.column(c).to_pylist() for c in ("g", "a", "d", "bytes")), strict=True):
                if size >= SHARD and g != last:
                    yield out(len(a))
                    size = 0
                    here.clear()
                last = g
                if (x, y) in here:
                    continue
                here.add((x, y))
                a.append(x)
                d.append(y)
                parts.append(z)
                size += len(z)
        if a:
            yield out(len(a))

    return rows.mapInArrow(run, "a long, d long, spans array<struct<first:int,last:int>>")


def wider(contents: DataFrame, length: int, step: int) -> DataFrame:
    """a, d, at and key (hash) of the contexts of length + step bytes around those of ``length`` bytes that
    begin at the places ``at`` of each content (null: wherever its anchor stands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows, keys = [], []
                for a, d, data, at in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns), strict=True):
                    if at is None:
                        at = np.flatnonzero(gram_hashes(data)[: len(data) - GRAM + 1].view(np.int64) == a).tolist()
                    begins = {x - step for x in at if x >= step} | {x for x in at if x + length + step <= len(data)}
                    rows += [(a, d, x) for x in begins]
                    keys += [xxhash.xxh3_128_digest(data[x : x + length + step]) for x in begins]
                if rows:
                    a_, d_, at_ = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(d_, pa.int64()), pa.array(at_, pa.int32()), pa.array(keys, pa.binary())], names=["a", "d", "at", "key"])

    return contents.select("a", "d", "bytes", "at").mapInArrow(run, "a long, d long, at int, key binary")


def crowded_starts(contents: DataFrame, rows_n: int) -> list[DataFrame]:
    """Tables of what ``shard_starts`` gives (none without contents), of contents (a, d, bytes) of anchors that have too many for one shard: by
    contexts that grow until few enough share one, or are whole windows."""
    spark, found = contents.sparkSession, []
    live, length = contents.withColumn("at", F.lit(None).cast("array<int>")), GRAM
    while not live.isEmpty():
        step = -(-(LENGTH - length) // 2)
        around = written(wider(live, length, step), "contexts")
        length += step
        sizes = around.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        if length == LENGTH:
            here = F.struct(F.col("at").alias("first"), F.col("at").alias("last"))
            return [*found, around.join(sizes, "key").groupBy("a", "d").agg(F.collect_set(here).alias("spans"))]
        few = around.join(sizes.where(F.col("n") <= GROUP), "key").select(F.col("key").alias("g"), "a", "d").distinct()
        laid = few.join(contents, ["a", "d"]).select("g", "a", "d", "bytes").repartition(spread(spark, rows_n), "g").sortWithinPartitions("g")
        found.append(written(shard_starts(laid).where(F.size("spans") > 0), "found"))
        many = around.join(sizes.where(F.col("n") > GROUP), "key").groupBy("a", "d").agg(F.collect_set("at").alias("at"))
        live = written(many.join(contents, ["a", "d"]), "crowded")
    return found


def repeated_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key and spans (first, last) of starts that are repeated, of documents that have any."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    counted = written(counted_regions(docs, text_col), "regions")
    rows_n = counted.count()
    compared = to_compare(counted, rows_n)
    full = counted.where("n > 1").select("a", "d")
    needs = spark.sparkContext.broadcast(bit_filter(compared, F.col("a").bitwiseXOR(F.col("d")).bitwiseXOR(F.lit(OTHER))).tobytes())
    whole = spark.sparkContext.broadcast(bit_filter(full, F.col("a").bitwiseXOR(F.col("d"))).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need_bits, whole_bits = np.frombuffer(needs.value, np.int64), np.frombuffer(whole.value, np.int64)
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for rows_of, begins, texts in _batches(batch.column(2)):
                doc, first, last, a, d, _, _, _, data, offsets = regions(texts)
                a, d = a.view(np.int64), d.view(np.int64)
                need = passes(need_bits, a ^ d ^ np.int64(OTHER))
                hit = np.flatnonzero(need | passes(whole_bits, a ^ d))
                parts = []
                for i, wanted in zip(hit.tolist(), need[hit].tolist(), strict=True):
                    if wanted and (name := (int(a[i]), int(d[i]))) not in sent:
                        sent.add(name)  # each content once a task
                        begin = int(offsets[doc[i]] + first[i])
                        parts.append(data[begin : begin + int(last[i] - first[i]) + LENGTH])
                    else:
                        parts.append(None)
                if len(sent) > 500_000:
                    sent.clear()
                own, begin = pa.array(rows_of[doc[hit]]), begins[doc[hit]]
                cols = [batch.column(0).take(own), batch.column(1).take(own), pa.array((first[hit] + begin).astype(np.int32)), pa.array((last[hit] + begin).astype(np.int32)), pa.array(a[hit]), pa.array(d[hit]), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "first", "last", "a", "d", "bytes"])

    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("t"))
    found = written(rows.mapInArrow(run, f"id {kind}, key long, first int, last int, a long, d long, bytes binary"), "occurrences")

    counts = compared.groupBy("a").agg(F.count("*").alias("contents"))
    contents = found.where("bytes is not null").join(compared, ["a", "d"]).groupBy("a", "d").agg(F.first("bytes").alias("bytes")).join(counts, "a")
    contents = written(contents, "contents", rows_n)
    own = contents.where(F.col("contents") <= GROUP).select(F.col("a").alias("g"), "a", "d", "bytes").repartition(spread(spark, rows_n), "g").sortWithinPartitions("g")
    crowded = crowded_starts(contents.where(F.col("contents") > GROUP).select("a", "d", "bytes"), rows_n)
    starts = reduce(DataFrame.unionByName, crowded, shard_starts(own).where(F.size("spans") > 0))
    # a content that occurs twice is repeated as a whole, whatever the shards say of it
    some = written(starts, "starts", rows_n).join(full.withColumn("full", F.lit(True)), ["a", "d"], "left_anti")
    marks = full.withColumn("spans", F.lit(None).cast("array<struct<first:int,last:int>>")).unionByName(some.select("a", "d", "spans"))
    hits = found.select("id", "key", "first", "last", "a", "d").join(marks, ["a", "d"])
    everything = F.array(F.struct(F.col("first"), F.col("last")))
    inner = F.transform("spans", lambda s: F.struct((F.col("first") + s["first"]).alias("first"), (F.col("first") + s["last"]).alias("last")))
    spans = hits.select("id", "key", F.explode(F.coalesce(inner, everything)).alias("s"))
    return spans.groupBy("id", "key").agg(F.collect_set("s").alias("spans"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes that no window from a repeated start covers, and how many runs are removed."""
    kept, at, runs = [], 0, 0
    for first, last in sorted(spans):
        begin, end = first, last + LENGTH
        if begin > at or not runs:
            kept.append(text[at:begin])
            runs += 1
        at = max(at, end)
    kept.append(text[at:])
    return b"".join(kept), runs


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), texts: bool = True) -> DataFrame:
    """id_col, columns of ``keep``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    kept_text (bytes of characters that were cut in two are left out of it) of every row."""
    spans = repeated_spans(docs, id_col, text_col).toDF("_id", "_key", "_spans")
    rows = docs.select(F.col(id_col).alias("_doc"), *keep, row_key(id_col, text_col).alias("_k"), F.col(text_col).alias("_t"))
    both = rows.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left").select("_doc", *keep, "_t", "_spans")
    fields = [both.schema[c] for c in ("_doc", *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, removed, runs, digests, kept = [], [], [], [], []
                for text, found in zip(part.column("_t").to_pylist(), part.column("_spans").to_pylist(), strict=True):
                    data = text.encode() if text else b""
                    left, n = cut(data, [(s["first"], s["last"]) for s in found]) if found else (data, 0)
                    sizes.append(len(data))
                    removed.append(len(data) - len(left))
                    runs.append(n)
                    digests.append(hashlib.sha256(left).hexdigest())
                    if texts:
                        kept.append(left.decode(errors="ignore") if n else text)
                cols = [part.column(f.name) for f in fields] + [pa.array(x, pa.int64()) for x in (sizes, removed, runs)] + [pa.array(digests, pa.string())]
                names = [f.name for f in fields] + ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts:
                    cols.append(pa.array(kept, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if texts else "")
    return both.mapInArrow(run, schema).withColumnRenamed("_doc", id_col)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), texts=False)
