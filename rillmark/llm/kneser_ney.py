"""Modified Kneser-Ney model over the bytes of words, counted by Spark, kept in sorted arrays of keys.

A text is the sequence space, its words with one space between them, space; every byte behind the
first space is predicted from at most ``ORDER - 1`` bytes before it, across words. Each language
has counts of its own: a key packs the language's number (21 bits), the order (3 bits) and the
n-gram's bytes (40 bits), so that no two n-grams or contexts share one. More than ``LANGS``
languages are an error.

Tasks count the longest n-gram at every place (all others are suffixes of these) and sum before
the shuffle. Counts, continuation counts and context sums are Spark aggregates over the whole
corpus. Only the finished model leaves Spark: the probability of every n-gram and the back-off
weight of every context by its key, 12 bytes each. It grows with the distinct n-grams of the corpus.
As the texts scored are the texts counted, tasks get one table of every n-gram's final probability.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, texts_of, written

ORDER = 5
LANGS = 1 << 21
#: Bytes of text that a task holds before it turns them into n-gram counts, and places looked at at once.
#: Rows of a small table, one for each language and order.
FEW = 1000
HELD = 500_000
STEP = 250_000


def lang_name(column):
    return F.coalesce(column.cast("string"), F.lit(""))


def languages(docs: DataFrame, lang_col: str) -> dict[str, int]:
    """A number of its own for every language."""
    names = sorted(r[0] for r in docs.select(lang_name(F.col(lang_col))).distinct().collect())
    if len(names) > LANGS:
        raise ValueError(f"{len(names)} languages do not fit into a key")
    return {name: i for i, name in enumerate(names)}


def ragged_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of " word " for all words in a row, each byte's place in its word, and its word."""
    flat = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    return flat, place, np.repeat(np.arange(len(words)), sizes)


def packed(flat: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes up to every place as one number."""
    out = flat.copy()
    for back in range(1, order):
        out[back:] |= flat[:-back] << (8 * back)
    return out


def head(lang: int, order) -> np.ndarray:
    return (np.int64(lang) << 43) | (np.asarray(order, np.int64) << 40)


def text_keys(lang: int, texts: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """Where each " text " starts, and in steps the place, longest n-grams and whether they are predicted."""
    raw = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    starts = np.cumsum(sizes) - sizes
    order = np.full(len(raw), ORDER, np.uint8)
    for k in range(ORDER - 1):
        order[starts[sizes > k] + k] = k + 1
    orders = np.arange(ORDER + 1)
    masks, heads = (np.int64(1) << (8 * orders)) - 1, head(lang, orders)

    def steps() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i in range(0, len(raw), STEP):
            lo, o = max(0, i - ORDER + 1), order[i : i + STEP]
            keys = packed(raw[lo : i + STEP].astype(np.int64), ORDER)[i - lo :]
            yield i, (keys & masks[o]) | heads[o], o > 1

    return starts, steps()


def longest_ngrams(lang: int, counted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    words = list(counted)
    flat, place, word = ragged_words(words)
    weight = np.fromiter(counted.values(), np.int64, len(words))
    order = np.minimum(place + 1, ORDER)
    mask = (np.int64(1) << (8 * order)) - 1
    keys = (packed(flat, ORDER) & mask) | head(lang, order)
    seen = place > 0
    found, at = np.unique(keys[seen], return_inverse=True)
    return found, np.bincount(at, weights=weight[word[seen]], minlength=len(found)).astype(np.int64)


def count_ngrams(docs: DataFrame, text_col: str, lang_col: str, langs: dict[str, int]) -> DataFrame:
    """key, n: occurrences of the longest n-gram at each place, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        held: dict[int, list[bytes]] = defaultdict(list)
        sums: list[tuple[np.ndarray, np.ndarray]] = []

        def turn() -> None:
            got = list(sums)
            for lang, texts in held.items():
                got.extend(np.unique(keys[seen], return_counts=True) for _, keys, seen in text_keys(lang, texts)[1])
            held.clear()
            sums.clear()
            if got:
                keys, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                sums.append((keys, np.bincount(at, weights=np.concatenate([g[1] for g in got]), minlength=len(keys)).astype(np.int64)))

        def out() -> Iterator[pa.RecordBatch]:
            for keys, n in sums:
                for i in range(0, len(keys), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["key", "n"])
            sums.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(texts_of(batch.column(0)), texts_of(batch.column(1)), strict=True):
                words = (text or "").encode().split()
                if words:
                    held[langs[lang]].append(b" ".join(words))
                    size += len(text)
                    if size > HELD:
                        turn()
                        size = 0
            if sums and len(sums[0][0]) > 1_000_000:
                yield from out()
        turn()
        yield from out()

    rows = docs.select(lang_name(F.col(lang_col)).alias("lang"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(adjusted: DataFrame) -> DataFrame:
    """lang, o, d1, d2, d3: what is taken from counts of 1, 2 and more, of each language and order."""
    n = [F.col(f"n{c}") for c in range(1, 5)]
    tally = adjusted.where("n <= 4").groupBy(F.shiftright("key", 43).cast("int").alias("lang"), "o").agg(*(F.count(F.when(F.col("n") == c, 1)).alias(f"n{c}") for c in range(1, 5)))
    every = adjusted.select(F.shiftright("key", 43).cast("int").alias("lang"), "o").distinct().join(tally, ["lang", "o"], "left").fillna(0, [f"n{c}" for c in range(1, 5)])
    y = F.when((n[0] > 0) & (n[1] > 0), n[0] / (n[0] + 2 * n[1])).otherwise(0.5)
    cut = [F.when((n[c - 1] > 0) & (n[c] > 0), F.least(F.greatest(c - (c + 1) * y * n[c] / F.greatest(n[c - 1], F.lit(1)), F.lit(0.05)), F.lit(c - 0.05))).otherwise(0.5 * c) for c in (1, 2, 3)]
    return written(every.select("lang", "o", *(d.alias(f"d{c}") for c, d in enumerate(cut, 1))), "kn-discounts", FEW)


def model_rows(ngrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, alpha) of n-grams and (key, gamma) of contexts, the keys distinct."""
    spaced = F.shiftright("key", 40).bitwiseAND(7)
    base = written(ngrams.select("key", "n", spaced.cast("int").alias("o")), "kn-counts")
    by_order, level = [], base.where(F.col("o") == ORDER).select("key", "n")
    by_order.append(level.withColumn("o", F.lit(ORDER)))
    for o in range(ORDER - 1, 0, -1):
        # continuation counts: how many distinct n-grams end in this one
        mask = F.lit((1 << (8 * o)) - 1)
        lang = F.shiftleft(F.shiftright("key", 43), 43).bitwiseOR(F.lit(o << 40))
        tail = level.groupBy(lang.bitwiseOR(F.col("key").bitwiseAND(mask)).alias("key")).agg(F.count("*").alias("n"))
        # the n-grams that texts begin with are also met within texts
        level = tail if o == 1 else tail.unionByName(base.where(F.col("o") == o).select("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
        by_order.append(level.withColumn("o", F.lit(o)))
    everything = by_order[0]
    for part in by_order[1:]:
        everything = everything.unionByName(part)
    adjusted = written(everything, "kn-adjusted", 3 * base.count())
    context = F.shiftleft(F.shiftright("key", 40), 40).bitwiseOR(F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 40) - 1)), 8))
    own = adjusted.withColumn("lang", F.shiftright("key", 43).cast("int")).join(discounts(adjusted), ["lang", "o"])
    discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = own.select("key", "o", "n", context.alias("ctx"), discount.alias("d"))
    sums = cut.groupBy("ctx", "o").agg(F.sum("n").alias("a"), (F.sum("d") / F.sum("n")).alias("gamma"))
    alphas = cut.join(sums.select("ctx", "a"), "ctx").select("key", ((F.col("n") - F.col("d")) / F.col("a")).cast("float").alias("v"))
    return alphas, sums.select(F.col("ctx").alias("key"), F.col("gamma").cast("float").alias("v"))


class Model:
    """Sorted arrays of keys with their values, and the negative log-likelihood of words under them."""

    def __init__(self, alphas: tuple[np.ndarray, np.ndarray], gammas: tuple[np.ndarray, np.ndarray]):
        self.alphas, self.gammas = alphas, gammas

    @classmethod
    def collected(cls, alphas: DataFrame, gammas: DataFrame) -> Model:
        """One row of each n-gram and of each context."""

        def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
            t = df.toArrow()
            keys, values = t.column("key").to_numpy(), t.column("v").to_numpy()
            own = np.argsort(keys)
            return keys[own], values[own]

        return cls(arrays(alphas), arrays(gammas))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key))
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        hit = keys[at] == key
        return hit, np.where(hit, values[at], 0.0)

    def nll(self, lang: int, words: list[bytes]) -> np.ndarray:
        """Negative log-likelihood (nats) of every word with its closing space."""
        flat, place, word = ragged_words(words)
        at = np.flatnonzero(place > 0)
        p = np.full(len(at), 1 / 257)
        for o in range(1, ORDER + 1):
            fits = place[at] >= o - 1
            where = at[fits]
            grams = packed(flat, o)[where] & ((np.int64(1) << (8 * o)) - 1)
            key = grams | head(lang, o)
            ctx = (grams >> 8) | head(lang, o)
            seen, gamma = self._find(self.gammas, ctx)
            _, alpha = self._find(self.alphas, key)
            old = p[fits]
            p[fits] = np.where(seen, alpha + gamma * old, old)
        return np.bincount(word[at], weights=-np.log(np.clip(p, 1e-12, 1.0)), minlength=len(words))


class Known:
    """Final negative log-likelihoods (nats) of a model's n-grams, and those of whole texts by them."""

    def __init__(self, model: Model):
        self.keys = model.alphas[0]
        self.values = np.zeros(len(self.keys), np.float32)
        for i in range(0, len(self.keys), STEP):
            keys = self.keys[i : i + STEP]
            lang, order, grams = keys >> 43, keys >> 40 & 7, keys & ((1 << 40) - 1)
            p = np.full(len(keys), 1 / 257)
            for o in range(1, ORDER + 1):
                at = np.flatnonzero(order >= o)
                key = (grams[at] & ((1 << (8 * o)) - 1)) | (lang[at] << 43) | (o << 40)
                seen, gamma = model._find(model.gammas, (key >> 40 << 40) | ((key & ((1 << 40) - 1)) >> 8))
                _, alpha = model._find(model.alphas, key)
                p[at] = np.where(seen, alpha + gamma * p[at], p[at])
            self.values[i : i + STEP] = -np.log(np.clip(p, 1e-12, 1.0))

    def nll(self, lang: int, texts: list[bytes]) -> np.ndarray:
        """Negative log-likelihood of every text, words with one space between them."""
        lo, hi = np.searchsorted(self.keys, [lang << 43, (lang + 1) << 43])
        own, values = self.keys[lo:hi], self.values[lo:hi]
        starts, steps = text_keys(lang, texts)
        parts = []
        for _, keys, seen in steps:
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            parts.append(np.where(seen, np.where(own[at] == keys, values[at], np.float32(np.log(257))), np.float32(0)))
        return np.add.reduceat(np.concatenate(parts), starts, dtype=np.float64)
