"""URL filters: rules first, then the ratio of two character language models.

A rule names a host and a path; it fits the host and its subdomains where the url's path starts
with the rule's, and the longest fitting rule decides. What no rule decides goes by two smoothed
variable-order Markov models over the bytes of the whole url (up to ``kneser_ney.ORDER - 1``
bytes of context, Witten-Bell interpolation), one of the urls that rules allow and one of those
that rules block: the difference of their log-likelihoods, divided by the url's length, has to
reach a threshold. The threshold is calibrated on all urls that a rule decides, each scored by
models of the other half of them, and is where the two classes' errors together are least.

Tasks sum n-gram counts before the shuffle; only finished probabilities leave Spark, one of each
distinct n-gram and context.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and
is scored as it is (null: as empty); where one class has no url, what no rule decides is
allowed; repeated rows count as often as they stand there; an empty table gives no rows. Columns
other than those named are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
BIN = 0.01
RANGE = 1000
#: Groups of counts: blocked and allowed urls by half (0 to 3), then all blocked, all allowed.
BLOCKED, ALLOWED = 4, 5


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        at = text.index("/")
        own, start = text[:at], text[at:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def labelled_counts(rows: DataFrame) -> DataFrame:
    """key, n of the longest n-grams of the urls (column t) by their group (column g)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for g, counted in held.items():
                keys, n = kn.longest_ngrams(g, counted)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
            held.clear()

        for batch in batches:
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[g][text.encode()] += 1
            if sum(map(len, held.values())) > 50_000:
                yield from out()
        yield from out()

    return rows.select("g", "t").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def model_rows(ngrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, v) of n-grams and of contexts, as ``kneser_ney.Model`` reads them."""
    group = F.shiftright("key", 43)
    merged = F.shiftleft(F.lit(BLOCKED).cast("long") + F.shiftright(group, 1), 43).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 43) - 1)))
    both = ngrams.unionByName(ngrams.select(merged.alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")))
    base = written(both.withColumn("o", F.shiftright("key", 40).bitwiseAND(7).cast("int")), "url-counts")
    level = base.where(F.col("o") == kn.ORDER).select("key", "n")
    everything = level.withColumn("o", F.lit(kn.ORDER))
    for o in range(kn.ORDER - 1, 0, -1):
        top = F.shiftleft(F.shiftright("key", 43), 43).bitwiseOR(F.lit(o << 40))
        tail = level.select(top.bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << (8 * o)) - 1))).alias("key"), "n")
        level = tail.unionByName(base.where(F.col("o") == o).select("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
        everything = everything.unionByName(level.withColumn("o", F.lit(o)))
    counts = written(everything, "url-levels")
    context = F.shiftleft(F.shiftright("key", 40), 40).bitwiseOR(F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 40) - 1)), 8))
    cut = counts.select("key", "o", "n", context.alias("ctx"))
    sums = cut.groupBy("ctx", "o").agg((F.sum("n") + F.count("*")).alias("a"), (F.count("*") / (F.sum("n") + F.count("*"))).alias("v"))
    alphas = cut.join(sums.select("ctx", "a"), "ctx").select("key", (F.col("n") / F.col("a")).cast("float").alias("v"))
    return alphas, sums.select(F.col("ctx").alias("key"), F.col("v").cast("float").alias("v"))


def score(rows: DataFrame, id_col: str) -> DataFrame:
    """Adds final (score by all labelled urls) and held_out (labelled urls: by the other half)."""
    model = rows.sparkSession.sparkContext.broadcast(kn.Model.collected(*model_rows(labelled_counts(rows.where("g is not null")))))
    fields = [f for f in rows.schema.fields if f.name != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [t.encode() for t in batch.column("t").to_pylist()]
            half = np.array([-1 if g is None else g % 2 for g in batch.column("g").to_pylist()])
            size = np.fromiter(map(len, urls), np.int64, len(urls)) + 1
            final, held = np.zeros(len(urls)), np.full(len(urls), np.nan)
            for i in range(0, len(urls), 2000):
                part = urls[i : i + 2000]
                own = slice(i, i + len(part))
                final[own] = (model.value.nll(BLOCKED, part) - model.value.nll(ALLOWED, part)) / size[own]
                for h in (0, 1):
                    at = np.flatnonzero(half[own] == h)
                    if len(at):
                        some = [part[k] for k in at]
                        held[i + at] = (model.value.nll(1 - h, some) - model.value.nll(3 - h, some)) / size[i + at]
            cols = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(final), pa.array(held)], names=[*(f.name for f in fields), "final", "held_out"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", final double, held_out double"
    return rows.mapInArrow(run, schema)


def threshold(scored: DataFrame) -> float:
    """Where the shares of blocked urls that reach it and of allowed ones that don't add up to
    least; minus infinity if a class is empty. Reads a histogram of at most 4 * RANGE + 2 rows."""
    place = F.greatest(F.least(F.floor(F.col("held_out") / BIN), F.lit(RANGE)), F.lit(-RANGE)).cast("int")
    rows = scored.where("g is not null").groupBy((F.col("g") >= 2).alias("good"), place.alias("at")).agg(F.count("*").alias("n")).collect()
    bins = {c: np.zeros(2 * RANGE + 1) for c in (False, True)}
    for r in rows:
        bins[r.good][r["at"] + RANGE] += r.n
    if not all(b.sum() for b in bins.values()):
        return float("-inf")
    lost = np.append(0, np.cumsum(bins[True] / bins[True].sum()))
    passed = 1 - np.append(0, np.cumsum(bins[False] / bins[False].sum()))
    total = lost + passed
    best = np.flatnonzero(total <= total.min() + 1e-12)
    return float((best[len(best) // 2] - RANGE) * BIN)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id_col, url_col, host, path, rule, verdict and score of every row."""
    url = F.col(url_col)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    told = pages.select(F.col(id_col), url, host_of(url).alias("host"), path_of(url).alias("path"))
    told = told.withColumn("rule", rule).withColumn("said", says)
    half = F.pmod(F.xxhash64(url), F.lit(2)).cast("int")
    group = F.when(F.col("said") == "block", half).when(F.col("said") == "allow", half + 2)
    scored = written(score(told.withColumn("g", group).withColumn("t", F.coalesce(url, F.lit(""))), id_col), "url-scores")
    by_model = F.when(F.col("final") >= threshold(scored), "allow").otherwise("block")
    return scored.select(id_col, url_col, "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"), F.col("final").alias("score"))


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
