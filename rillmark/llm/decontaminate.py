"""Benchmark decontamination by winnowing.

A word is a run of letters, digits and characters outside ASCII, A-Z lower-cased. Of every
``WINDOW - GRAM + 1`` neighbouring ``GRAM``-word hashes the smallest is a fingerprint, so each
span of ``WINDOW`` words that a document shares with an item holds a fingerprint of both. Items
of fewer words are one fingerprint of all their words. Fingerprints of items go into a bit filter
of fixed size (``FILTER_BITS``); fingerprints of documents that pass it are joined with those of
the items and every hit is extended, word by word and on the words themselves, to the longest
run that both sides share around it. Runs of ``WINDOW`` words or more (whole items, if shorter)
are hits.

Defined results: a null or empty text has no words and is not contaminated; items without words
match nothing; rows of one item id are one item; items with a null id hit words but are not
counted; repeated documents each get the same result; very long texts are taken whole, by one task each; empty tables on either
side give no hits.
Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, table, written

WINDOW, GRAM = 13, 5
FILTER_BITS = 1 << 22
MEMO = 200_000
#: Lower-cases A-Z and turns every byte that is in no word into a space.
TO_WORDS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_weights = np.random.default_rng(13).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
NEVER = np.uint64((1 << 64) - 1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


def gram_hashes(words: np.ndarray, rest: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every place; NEVER where fewer are left in the text."""
    out = np.full(len(words), NEVER)
    n = len(words) - size + 1
    if n <= 0:
        return out
    total = np.full(n, np.uint64(size))
    for j in range(size):
        total += words[j : j + n] * _weights[j]
    total ^= total >> np.uint64(29)
    total *= _weights[0]
    total ^= total >> np.uint64(32)
    total[total == NEVER] = 0
    out[:n] = np.where(rest[:n] >= size, total, NEVER)
    return out


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over ``width`` neighbours from every place on (fewer at the end)."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of fingerprints: a hash that is the smallest of some window of neighbours.

    Windows that run over the end of a text may choose more places; never fewer.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    width = WINDOW - GRAM + 1
    least = _slide(hashes, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least])
    most = _slide(padded, width, np.maximum)[: len(hashes)]
    return np.flatnonzero((most >= hashes) & (hashes != NEVER))


def fingerprints(texts: list[list[bytes]], memo: WordHashes, lengths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """text, place, size and hash of every fingerprint of word lists; of ``lengths`` every gram."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter((memo[w] for t in texts for w in t), np.uint64, int(counts.sum()))
    starts = np.cumsum(counts) - counts
    rest = np.repeat(starts + counts, counts) - np.arange(len(flat))
    found = []
    for size in (GRAM, *lengths):
        hashes = gram_hashes(flat, rest, size)
        at = winnowed(hashes) if size == GRAM and found == [] else np.flatnonzero(hashes != NEVER)
        found.append((at, np.full(len(at), size if found else 0), hashes[at]))
    at, size, fp = (np.concatenate([f[k] for f in found]) for k in range(3))
    text = np.searchsorted(starts, at, side="right") - 1
    return text, at - starts[text], size, fp


def bits(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (fp & np.uint64(FILTER_BITS - 1)).astype(np.int64), ((fp >> np.uint64(40)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def around(words: list[bytes], at: int, size: int) -> tuple[int, bytes]:
    """Words before the gram, and the gram with the words that a window around it can reach."""
    if size:
        return 0, b" ".join(words[at : at + size])
    first = max(0, at - WINDOW + GRAM)
    return at - first, b" ".join(words[first : at + WINDOW])


def item_fingerprints(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fp, size (0: a gram of an item of WINDOW words or more), item, lead and words around."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            rows = []
            for i, w in enumerate(words):
                if len(w) >= WINDOW:
                    _, at, _, fp = fingerprints([w], memo, ())
                    rows += [(i, f, 0, *around(w, a, 0)) for a, f in zip(at.tolist(), fp.view(np.int64).tolist(), strict=True)]
                elif w:
                    _, at, size, fp = fingerprints([w], memo, (len(w),))
                    rows += [(i, f, s, *around(w, a, s)) for a, s, f in zip(at.tolist(), size.tolist(), fp.view(np.int64).tolist(), strict=True) if s]
            pick = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(0).take(pick), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.binary())))]
            yield pa.RecordBatch.from_arrays(cols, names=["item", "fp", "size", "item_lead", "item_words"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"item {kind}, fp long, size int, item_lead int, item_words binary").distinct()


def filter_of(prints: DataFrame) -> tuple[np.ndarray, tuple[int, ...]]:
    """The bit filter, built by Spark and read as at most FILTER_BITS / 64 numbers, and the
    sizes of short items (at most WINDOW - 1)."""
    low = F.col("fp").bitwiseAND(F.lit(FILTER_BITS - 1))
    high = F.shiftrightunsigned("fp", 40).bitwiseAND(F.lit(FILTER_BITS - 1))
    both = prints.select(F.explode(F.array(low, high)).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    rows = both.groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(F.bit_or(one).alias("w")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[rows.column("at").to_numpy()] = rows.column("w").to_numpy()
    sizes = sorted(r[0] for r in prints.where("size > 0").select("size").distinct().collect())
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool), tuple(sizes)


def document_fingerprints(docs: DataFrame, id_col: str, text_col: str, bit_filter: np.ndarray, lengths: tuple[int, ...]) -> DataFrame:
    """id, key, n_words and the fingerprints that pass the filter, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_filter))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        memo, passes = WordHashes(), np.unpackbits(shared.value).astype(bool)
        one = pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("lead", pa.int32()), ("words", pa.binary())])
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and size < 400_000:
                    part.append(words_of(texts[at + len(part)]))
                    size += len(part[-1])
                text, place, grams, fp = fingerprints(part, memo, lengths)
                low, high = bits(fp)
                hit = np.flatnonzero(passes[low] & passes[high])
                hits: list[list[dict]] = [[] for _ in part]
                for t, p, s, f in zip(text[hit].tolist(), place[hit].tolist(), grams[hit].tolist(), fp[hit].view(np.int64).tolist(), strict=True):
                    lead, words = around(part[t], p, s)
                    hits[t].append({"fp": f, "size": s, "at": p, "lead": lead, "words": words})
                cols = [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array([len(p) for p in part], pa.int64()), pa.array(hits, pa.list_(one))]
                at += len(part)
                yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "n_words", "hits"])

    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, key long, n_words long, hits array<struct<fp:long,size:int,at:int,lead:int,words:binary>>")


def extended(hits: DataFrame) -> DataFrame:
    """Adds start and end of the run of words that document and item share around the gram;
    rows whose run is too short go."""
    keep = [f for f in hits.schema.fields if f.name in ("id", "key", "item")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {n: batch.column(n).to_pylist() for n in ("size", "at", "lead", "words", "item_lead", "item_words")}
            rows, starts, ends = [], [], []
            for i, (size, at, lead, ours, item_lead, theirs) in enumerate(zip(*own.values(), strict=True)):
                if size:
                    if ours == theirs:
                        rows.append(i)
                        starts.append(at)
                        ends.append(at + size)
                    continue
                a, b = ours.split(), theirs.split()
                if a[lead : lead + GRAM] != b[item_lead : item_lead + GRAM]:
                    continue
                left = right = 0
                while left < min(lead, item_lead) and a[lead - left - 1] == b[item_lead - left - 1]:
                    left += 1
                i_a, i_b = lead + GRAM, item_lead + GRAM
                while i_a + right < len(a) and i_b + right < len(b) and a[i_a + right] == b[i_b + right]:
                    right += 1
                if left + GRAM + right >= WINDOW:
                    rows.append(i)
                    starts.append(at - left)
                    ends.append(at + GRAM + right)
            pick = pa.array(rows, pa.int64())
            cols = [batch.column(f.name).take(pick) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[*(f.name for f in keep), "start", "end"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", start long, end long"
    return hits.mapInArrow(run, schema)


def covered(spans):
    """Number of places in spans, given as an array of (start, end)."""

    def step(acc, s):
        fresh = F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["upto"]))
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + fresh).alias("n"))

    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.sort_array(spans), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_col, key (of id and text), n_words, n_hit, items (sorted strings) and spans (hit runs)
    of every row of ``docs``."""
    prints = written(item_fingerprints(items, item_id, item_text), "item-prints")
    base = written(document_fingerprints(docs, id_col, text_col, *filter_of(prints)), "doc-prints")
    ours = base.where(F.size("hits") > 0).select("id", "key", F.explode("hits").alias("x")).select("id", "key", "x.*")
    hits = extended(ours.join(prints, ["fp", "size"]))
    per_doc = hits.groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set(F.col("item").cast("string")).alias("items"))
    per_doc = per_doc.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.sort_array("spans").alias("spans"), F.sort_array("items").alias("items"))
    all_docs = base.select("id", "key", "n_words").join(per_doc, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0))
    items_found = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return all_docs.select(F.col("id").alias(id_col), "key", "n_words", n_hit.cast("long").alias("n_hit"), items_found.alias("items"), "spans")


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )
