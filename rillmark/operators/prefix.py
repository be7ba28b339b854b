"""Terms with frequencies, looked up by prefix."""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions.text import normalise

from .windows import numbered


def vocabulary(rows: DataFrame, term: str = "term", weight: str | None = None) -> DataFrame:
    """term, freq of normalised terms that are not empty."""
    freq = F.count("*") if weight is None else F.sum(weight)
    return rows.select(normalise(F.col(term)).alias("term"), *([weight] if weight else [])).where("term <> ''").groupBy("term").agg(freq.cast("long").alias("freq"))


def lookup(terms: DataFrame, words: DataFrame, column: str = "word") -> DataFrame:
    """column and its frequency (lower case, white space counts); 0 if it is no term."""
    asked = words.withColumn("_t", F.lower(F.col(column)))
    return asked.join(terms.withColumnRenamed("term", "_t"), "_t", "left").select(column, F.coalesce("freq", F.lit(0).cast("long")).alias("freq"))


def complete(terms: DataFrame, prefix: str, k: int = 5) -> DataFrame:
    """Best terms for one prefix; the filter reaches the scan of a stored vocabulary."""
    own = prefix.lower().strip()
    return terms.where(F.startswith("term", F.lit(own))).orderBy(F.desc("freq"), "term").limit(k)


def prefixes(terms: DataFrame) -> DataFrame:
    """Adds prefix: every beginning of the term, itself included."""
    return terms.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda i: F.substring(F.col("term"), F.lit(1), i))))


def complete_many(terms: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """prefix, term, freq, rank for many prefixes: an equi-join on beginnings, of each of which
    every task keeps k rows before the shuffle."""
    top = Window.partitionBy("prefix").orderBy(F.desc("freq"), "term")
    wanted = asked.select(normalise(F.col("prefix")).alias("prefix")).where("prefix <> ''").distinct()
    hits = prefixes(terms).join(wanted, "prefix")
    return hits.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def subtree_frequency(terms: DataFrame) -> DataFrame:
    return prefixes(terms).groupBy("prefix").agg(F.sum("freq").alias("total_freq"), F.count("*").alias("terms"))


def without(terms: DataFrame, words: DataFrame, column: str = "word") -> DataFrame:
    return terms.join(words.select(F.lower(F.col(column)).alias("term")), "term", "left_anti")


def deleted(terms: DataFrame, words: DataFrame, column: str = "word") -> DataFrame:
    """column and existed (whether it was a term) of every distinct word to delete."""
    asked = words.select(column).distinct().withColumn("_t", F.lower(F.col(column)))
    there = terms.select(F.col("term").alias("_t"), F.lit(True).alias("existed"))
    return asked.join(there, "_t", "left").select(column, F.coalesce("existed", F.lit(False)).alias("existed"))


def search_counts(searches: DataFrame) -> DataFrame:
    """query, searches: how often each was searched, empty ones too."""
    return searches.select(normalise(F.col("query")).alias("query")).groupBy("query").agg(F.count("*").alias("searches"))


def suggested_before(searches: DataFrame, catalog: DataFrame, k: int = 5, span: int = 10_000) -> DataFrame:
    """search_id, query, term, freq, rank: what every search was offered, of the catalog and of strictly earlier searches.

    ``searches`` has search_id (order) and query, ``catalog`` term and freq. A search meets the
    terms that begin with it; a searched term counts as often as it was searched before.

    Searches are cut into blocks of ``span``. What a block adds to a term is one row for each asked beginning of it. From these, a pass over
    the blocks of each asked beginning keeps its terms in order, and says for each block what it starts with: the counts of
    the terms that the block changes, and the k best of the others. Each beginning and block is then played by
    itself. So a search is a row for each asked beginning of its query and gives k rows, and one that is half of
    all searches is spread over the blocks. The terms of one beginning are in one task.
    """
    asked = numbered(searches.select("search_id", normalise(F.col("query")).alias("query")).where("query <> ''"), "search_id")
    asked = asked.withColumn("block", F.floor(F.col("place") / span))
    wanted = asked.select(F.col("query").alias("prefix")).distinct()
    known = prefixes(asked.select(F.col("query").alias("term")).distinct()).join(wanted, "prefix")
    added = asked.groupBy(F.col("query").alias("term"), "block").agg(F.count("*").alias("n")).join(known, "term")
    listed = prefixes(catalog.select("term", "freq")).join(wanted, "prefix")
    started = asked.select(F.col("query").alias("prefix"), "block").distinct()
    steps = listed.select("prefix", F.lit(-1).cast("long").alias("block"), "term", F.col("freq").cast("long").alias("n"), F.lit(0).alias("step"))
    steps = steps.unionByName(started.withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "step": F.lit(1)}))
    steps = steps.unionByName(added.select("prefix", "block", "term", "n", F.lit(2).alias("step")))
    begins = steps.groupBy("prefix").applyInPandas(_starts(k), "prefix string, block long, term string, n long, other boolean")
    kind = searches.schema["search_id"].dataType.simpleString()
    plays = asked.select(F.col("query").alias("term"), "search_id", "place", "block").join(known, "term")
    both = plays.groupBy("prefix", "block").cogroup(begins.groupBy("prefix", "block"))
    return both.applyInPandas(_played(k), f"search_id {kind}, query string, term string, freq long, rank int")


def _starts(k: int):
    """Of one beginning: what each block in which it is asked starts with."""

    def run(steps: pd.DataFrame) -> pd.DataFrame:
        counts: dict[str, int] = {}
        order: list[tuple[int, str]] = []
        prefix, out = steps["prefix"].iloc[0], []

        def add(term: str, n: int) -> None:
            if term in counts:
                del order[bisect_left(order, (-counts[term], term))]
            counts[term] = counts.get(term, 0) + n
            insort(order, (-counts[term], term))

        first = steps[steps["step"] == 0]
        counts.update(first.groupby("term")["n"].sum().to_dict())
        order.extend(sorted((-n, t) for t, n in counts.items()))
        for block, part in steps[steps["step"] > 0].sort_values("block").groupby("block"):
            changes = part[part["step"] == 2]
            if (part["step"] == 1).any():
                changed = set(changes["term"])
                out += [(prefix, block, t, counts.get(t, 0), False) for t in changed]
                rest = (x for x in order if x[1] not in changed)
                out += [(prefix, block, t, -n, True) for n, t in islice(rest, k)]
            for term, n in zip(changes["term"].tolist(), changes["n"].tolist(), strict=True):
                add(term, n)
        return pd.DataFrame(out, columns=["prefix", "block", "term", "n", "other"])

    return run


def _played(k: int):
    """Of one beginning and block: what each search for it is offered."""

    def run(plays: pd.DataFrame, begins: pd.DataFrame) -> pd.DataFrame:
        out = []
        own = begins[~begins["other"]]
        counts = {t: n for t, n in zip(own["term"].tolist(), own["n"].tolist(), strict=True) if n}
        order = sorted((-n, t) for t, n in counts.items())
        others = sorted((-n, t) for t, n in zip(begins["term"][begins["other"]].tolist(), begins["n"][begins["other"]].tolist(), strict=True))
        rows = plays.sort_values("place")
        for prefix, term, search in zip(rows["prefix"].tolist(), rows["term"].tolist(), rows["search_id"].tolist(), strict=True):
            if term == prefix:
                best = sorted(order[:k] + others)[:k]
                out += [(search, prefix, t, -n, rank) for rank, (n, t) in enumerate(best, 1)]
            if term in counts:
                del order[bisect_left(order, (-counts[term], term))]
            counts[term] = counts.get(term, 0) + 1
            insort(order, (-counts[term], term))
        return pd.DataFrame(out, columns=["search_id", "query", "term", "freq", "rank"])

    return run
