"""Quality rules: base counts of every text, and perplexity bands of a Kneser-Ney model.

A first pass counts the corpus (``kneser_ney``), a second one scores every whole text and takes
its base counts. Perplexity is judged as its logarithm, the mean negative log-likelihood of a
word. It scatters around its language's median the less the longer a text is, so a text's
distance from the median is multiplied by the root of its number of words. Each language has
a band of ``below`` and ``above`` times the spread of these distances; the spread is twice the
smaller distance of a quartile from the median, which a source of junk on one side can't
stretch. The quantiles come from histograms of fixed bins over all documents.

Defined results: a null or empty text has no words, fails the base rules and has no perplexity;
a null language is the empty string; every language has counts and bands of its own; repeated
rows are judged alike, each on its own; an empty table gives none. Columns other than those named are
not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import fresh, slices, table, written

SYMBOLS = b"#*$%&|<>"
SPAN = 8
#: Words that a worker remembers, and words looked at together.
MEMO, TOGETHER = 100_000, 150_000
BIN, FAR_BIN = 0.02, 0.1


class Words(dict):
    """Word -> its number."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, span: int = SPAN) -> np.ndarray:
    """Words of each document in a window of ``span`` words that is in it twice or more.

    ``ids`` are the words of documents in a row, ``doc`` the document of each. Windows get equal
    numbers exactly where they are equal: windows of 2, 4 and 8 words are numbered in turn.
    """
    if len(ids) < span:
        return np.zeros(n_docs, np.int64)
    level, width = ids, 1
    while width < span:
        pair = level[:-width] * np.int64(len(ids) + int(level.max()) + 1) + level[width:]
        level = np.unique(pair, return_inverse=True)[1]
        width *= 2
    inside = doc[: len(level)] == doc[span - 1 :]
    key = level * np.int64(n_docs) + doc[: len(level)]
    key[~inside] = -1 - np.arange(len(key))[~inside]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[at] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + span, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.encode().split()] if "\n" in text else ()
    return len(lines) - len(set(lines))


def base_counts(texts: list[str | None], langs: list[int], known: kn.Known, of: Words) -> dict[str, np.ndarray]:
    """The counts of every text, and the negative log-likelihood of its words."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    nll = np.zeros(n)
    at = 0
    while at < n:
        words_in, doc_in, begun, size = [], [], at, 0
        by_lang: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        while at < n and size < TOGETHER:
            text = texts[at] or ""
            data = text.encode()
            words = data.split()
            k = len(words)
            out["n_words"][at] = k
            letters = sum(map(len, words))
            out["word_chars"][at] = letters - (len(data) - len(text))
            out["n_symbols"][at] = len(data) - len(data.translate(None, SYMBOLS))
            out["n_dup_lines"][at] = repeated_lines(text)
            if k:
                by_lang[langs[at]].append((at, b" ".join(words)))
                words_in.append(np.fromiter(map(of.__getitem__, words), np.int64, k))
                doc_in.append((at - begun, k))
                size += k
            at += 1
        if not doc_in:
            continue
        for lang, own in by_lang.items():
            nll[[d for d, _ in own]] = known.nll(lang, [t for _, t in own])
        flat = np.concatenate(words_in)
        doc = np.repeat([d for d, _ in doc_in], [k for _, k in doc_in])
        out["n_repeat_words"][begun:at] = repeated_words(flat, doc, at - begun)
        if len(of) > MEMO:
            of.clear()
    return out | {"nll": nll}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_documents(docs: DataFrame, id_col: str, text_col: str, lang_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, columns of ``keep``, the language's number, the base counts and nll of every row."""
    spark = docs.sparkSession
    numbers = kn.languages(docs, lang_col)
    known = spark.sparkContext.broadcast(kn.Known(kn.Model.collected(*kn.model_rows(kn.count_ngrams(docs, text_col, lang_col, numbers)))))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        of = Words()
        for whole in batches:
            for batch in slices(whole, 2):
                langs = [numbers[x] for x in batch.column(1).to_pylist()]
                got = base_counts(batch.column(2).to_pylist(), langs, known.value, of)
                cols = [batch.column("_id"), pa.array(langs, pa.int32()), *(batch.column(c) for c in keep), *(pa.array(got[c]) for c in (*COUNTS, "nll"))]
                yield pa.RecordBatch.from_arrays(cols, names=["_id", "lang_id", *keep, *COUNTS, "nll"])

    rows = docs.select(F.col(id_col).alias("_id"), kn.lang_name(F.col(lang_col)).alias("_lang"), F.col(text_col).alias("_text"), *keep)
    schema = f"_id {kind}, lang_id int, " + "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + ", ".join(f"{c} long" for c in COUNTS) + ", nll double"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def quantiles(rows: DataFrame, value, size: float, cuts: tuple[float, ...]) -> DataFrame:
    """lang_id, q25 and so on of a value, from a histogram of bins of one size."""
    bins = rows.groupBy("lang_id", F.floor(value / size).alias("bin")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang_id")
    upto = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("all", F.sum("n").over(own))
    return upto.groupBy("lang_id").agg(*[F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("bin") + 0.5) * size)).alias(f"q{int(q * 100)}") for q in cuts])


def bands(scored: DataFrame, below: float, above: float) -> DataFrame:
    """lang_id, middle, and the room below and above it (times the root of the words): one row of each
    language."""
    rate = F.col("nll") / F.col("n_words")
    some = scored.where("n_words > 0")
    middle = quantiles(some, rate, BIN, (0.5,)).withColumnRenamed("q50", "middle")
    far = (rate - F.col("middle")) * F.sqrt("n_words")
    cut = quantiles(some.join(F.broadcast(middle), "lang_id"), far, FAR_BIN, (0.25, 0.5, 0.75))
    spread = F.greatest(2 * F.least(F.col("q75") - F.col("q50"), F.col("q50") - F.col("q25")), F.lit(1.0))
    return middle.join(cut, "lang_id").select("lang_id", "middle", (spread * below).alias("room_below"), (spread * above).alias("room_above"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 2.25, above: float = 2.8, keep: tuple[str, ...] = ()) -> DataFrame:
    """The base counts, log_perplexity (null without words), its band, base_failed and kept."""
    scored = written(score_documents(docs, id_col, text_col, lang_col, keep), "quality-scored")
    with_bands = scored.join(F.broadcast(bands(scored, below, above)), "lang_id", "left")
    rate = F.when(F.col("n_words") > 0, F.col("nll") / F.col("n_words"))
    root = F.sqrt(F.greatest("n_words", F.lit(1)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = with_bands.withColumn("log_perplexity", rate).withColumn("low", F.col("middle") - F.col("room_below") / root).withColumn("high", F.col("middle") + F.col("room_above") / root)
    fits = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fits).drop("lang_id", "nll", "middle", "room_below", "room_above")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
