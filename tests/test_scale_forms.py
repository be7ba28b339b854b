"""Operators whose hot keys are cut into parts give what the plain forms give."""

from __future__ import annotations

import random

import duckdb
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillmark.operators import bots, prefix, priority, recommend, similarity, windows
from rillmark.plans import queries


@pytest.mark.parametrize("block", [1, 3, 2000])
def test_large_buckets_lose_no_link(spark, block, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", block)
    r = random.Random(block)
    rows = [(u, b, str(r.randrange(1, 3) if u % 2 else 0)) for u in range(25) for b in range(2)]
    keys = spark.createDataFrame(rows, "user_id long, band int, key string")
    want = {(u, v) for u, b, x in rows for v, c, y in rows if u < v and b == c and x == y}
    got = [tuple(x) for x in similarity.candidates(keys).collect()]
    assert set(got) == want and len(got) == len(want)


def test_nearest_of_copies(spark):
    r = random.Random(8)
    sets = [[r.randrange(30) for _ in range(6)] for _ in range(12)]
    rows = [(u, i) for u in range(60) for i in sets[0 if u % 3 == 0 else u % 12]] + [(100, 5), (101, 999)]
    sigs = similarity.signatures(spark.createDataFrame(rows, "user_id long, item long"), 16)
    plain = similarity.nearest(similarity.scored(similarity.candidates(similarity.band_keys(sigs, 16, 8)), sigs, 16), 7)
    got = similarity.nearest_by_class(sigs, 16, 8, 7)
    order = lambda df: sorted((x.u, x["rank"], x.v, x.similarity) for x in df.collect())
    assert order(got) == order(plain) and got.count() > 300
    assert similarity.nearest_by_class(sigs.where("user_id < 0"), 16, 8, 7).count() == 0


def timed(rows, spark, shape):
    return spark.createDataFrame(rows, f"event_id long, us long, {shape}").withColumn("ts", F.timestamp_micros("us"))


def test_running_flag_over_days(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(5 * 86_400) * 1_000_000, r.choice([None, 1, 1, 1, 2]), r.choice([None, *range(9)])) for i in range(300)]
    events = timed(rows, spark, "user_id long, address long")
    seen, want = {}, {}
    for i, _, u, a in sorted(rows, key=lambda x: (x[1], x[0])):
        if a is not None:
            seen.setdefault(u, set()).add(a)
            want[i] = len(seen[u])
    got = bots.running_flag(events, 3).collect()
    assert {x.event_id: x.addresses for x in got} == want and len(got) == len(want)
    assert all(x.flagged == (x.addresses >= 3) for x in got)


@pytest.mark.parametrize(("seconds", "slot"), [(1, 1), (5, 2), (60, 60)])
def test_trailing_counts_by_seconds(spark, seconds, slot):
    r = random.Random(seconds)
    us = [r.randrange(20_000_000) for _ in range(150)] + [1_000_000 * k for k in range(12)] * 2
    events = timed([(i, t, "x") for i, t in enumerate(us)], spark, "kind string")
    got = {x.event_id: x.in_window for x in windows.trailing_total(events, seconds, slot).collect()}
    assert got == {i: sum(t - seconds * 1_000_000 <= x <= t for x in us) for i, t in enumerate(us)}


def test_places_equal_one_sort(spark):
    r = random.Random(1)
    events = timed([(i, r.randrange(50), r.randrange(4)) for i in range(500)], spark, "priority int")
    plain = events.withColumn("want", F.row_number().over(Window.orderBy("priority", "ts", "event_id")))
    both = plain.join(priority.placed(events).select("event_id", "place"), "event_id")
    assert both.where("want = place").count() == 500


@pytest.mark.parametrize("span", [1, 7, 10_000])
def test_suggestions_by_blocks(spark, span):
    r = random.Random(span)
    words = ["a", "ab", "abc", "abd", "b", "ba", " A ", "", "abca"]
    asks = [(i * 3, r.choice(words) if r.random() < 0.5 else "ab") for i in range(120)]
    terms = [("abc", 3), ("abz", 2), ("b", 1), ("zz", 9)]
    got = prefix.suggested_before(spark.createDataFrame(asks, "search_id long, query string"), spark.createDataFrame(terms, "term string, freq long"), 3, span)
    want, counts = [], dict(terms)
    for i, q in asks:
        q = q.strip().lower()
        if not q:
            continue
        best = sorted((-n, t) for t, n in counts.items() if t.startswith(q))[:3]
        want += [(i, q, t, -n, rank) for rank, (n, t) in enumerate(best, 1)]
        counts[q] = counts.get(q, 0) + 1
    assert sorted(tuple(x) for x in got.select("search_id", "query", "term", "freq", "rank").collect()) == sorted(want)


def shuffled_rows(spark, group: str, run) -> int:
    """Rows that the stages of what ``run`` does have shuffled."""
    context = spark.sparkContext
    context.setJobGroup(group, "")
    run()
    context.setLocalProperty("spark.jobGroup.id", None)
    out, seen = 0, context.statusTracker()
    for stage in {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}:
        try:
            out += context._jsc.sc().statusStore().lastStageAttempt(stage).shuffleWriteRecords()
        except Py4JJavaError:  # skipped
            continue
    return out


def watched(spark, path, rows, customers=0):
    """Tables in which each watch is a line of an order of its own."""
    lines = spark.createDataFrame([(n, i, u) for n, (u, i) in enumerate(rows)], "l_orderkey long, l_partkey long, u long")
    lines.drop("u").write.parquet(f"{path}/lineitem.parquet")
    lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("u").alias("o_custkey")).write.parquet(f"{path}/orders.parquet")
    spark.range(customers).select(F.col("id").alias("c_custkey")).write.parquet(f"{path}/customer.parquet")


@pytest.mark.parametrize("name", ["recommend_lsh", "recommend_fallback"])
def test_items_of_neighbours_are_not_shuffled_as_rows(spark, tmp_path, name):
    """420 users in groups of 21 that share 60 items and have 10 of their own: 20 neighbours bring 260 items to each."""
    rows = [(u, 1000 * (u // 21) + i) for u in range(420) for i in range(60)] + [(u, 100_000 + 10 * u + i) for u in range(420) for i in range(10)]
    watched(spark, str(tmp_path), rows, 430)
    found = []
    n = shuffled_rows(spark, f"rows of {name}", lambda: found.extend(queries.queries()[name](spark, str(tmp_path)).collect()))
    assert len({x.user_id for x in found if name == "recommend_lsh" or x.source == "similar"}) > 400
    assert n < 2.7 * len(rows)  # lines by order, watches by user, and little else


@pytest.mark.parametrize("name", ["recommend_lsh", "recommend_fallback"])
def test_users_are_shuffled_few_times(spark, tmp_path, name):
    """Without broadcasts: keys of bands once, signatures once by value and once by user; who has no neighbours sends no items to himself."""
    rows = [(u, 1000 * u + i) for u in range(500) for i in range(4)] + [(u, 10**6 + i) for u in range(500, 540) for i in range(4)]
    watched(spark, str(tmp_path), rows, 540)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    found = []
    try:
        n = shuffled_rows(spark, f"few of {name}", lambda: found.extend(queries.queries()[name](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len({x.user_id for x in found}) == (0 if name == "recommend_lsh" else 540)  # the last 40 have seen all that their neighbours have
    assert n < 26_000


@pytest.mark.parametrize("name", ["recommend_lsh", "recommend_fallback"])
def test_recommendations_of_odd_rows(spark, tmp_path, name):
    """Repeated watches, null items, users of null items only and a null user, as in SQL."""
    r = random.Random(4)
    rows = [(u, r.randrange(8) + 8 * (u % 4)) for u in range(60) for _ in range(9)]
    rows += [(u, None) for u in range(0, 60, 5) for _ in range(2)] + [(u, None) for u in (70, 71)] + [(None, i) for i in range(8)] + [(80, 999)]
    watched(spark, str(tmp_path), rows, 90)
    got = queries.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(queries.oracle_sql()[name]).fetchall()
    same = lambda rows: sorted(rows, key=lambda x: (x[0], x[3]))
    assert same(map(tuple, got.collect())) == same(want) and any(x[1] is None for x in want)


def test_recommendations_from_profiles(spark):
    r = random.Random(6)
    w = spark.createDataFrame([(u, r.randrange(10) + 5 * (u % 6)) for u in range(80) for _ in range(7)], "user_id long, item long")
    near = similarity.nearest_by_class(similarity.signatures(w, 16), 16, 8, 5)
    order = lambda df: sorted((x.user_id, x["rank"], x.item, x.score) for x in df.collect())
    held = similarity.profiles(w, 16)
    assert order(recommend.recommend_from_profiles(held, near, 5, 4)) == order(recommend.recommend(w, near, 4))
    assert sorted(map(tuple, similarity.watches_of(held).collect())) == sorted(map(tuple, w.collect()))
