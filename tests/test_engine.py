"""Parts of the engine against plain versions, and the commands."""

from __future__ import annotations

import random
from collections import OrderedDict

from pyspark.sql import functions as F

from rillmark import __main__ as commands
from rillmark.operators import cache, prefix, similarity, windows
from rillmark.sources import generator
from rillmark.streaming import jobs


def accesses(spark, n=900, keys=40, seed=1):
    r = random.Random(seed)
    rows = [(i * 3 + r.randrange(3), int(r.paretovariate(0.7)) % keys) for i in range(n)]
    return rows, spark.createDataFrame(rows, "pos long, key long")


def test_cache_in_blocks_equals_one_cache(spark):
    rows, df = accesses(spark)
    for capacity, span in ((1, 100), (7, 64), (20, 10_000)):
        held, want = OrderedDict(), {}
        for pos, key in rows:
            hit, out = key in held, None
            held[key] = held.pop(key, True)
            if len(held) > capacity:
                out = held.popitem(last=False)[0]
            want[pos] = (hit, out)
        assert {r.pos: (r.hit, r.evicted) for r in cache.play(df, capacity, span).collect()} == want
        got = cache.full_statistics(cache.play(df, capacity, span), capacity).collect()[0]
        assert (got.size, got.evictions) == (len(held), sum(o is not None for _, o in want.values()))
    assert cache.play(df.limit(0), 3).count() == 0


def test_reuse_distances(spark):
    rows, df = accesses(spark, seed=2)
    want, stack = {}, []
    for pos, key in rows:
        n = stack.index(key) if key in stack else None
        want[pos] = n if n is not None and n < 12 else None
        stack = [key, *(k for k in stack if k != key)]
    assert {r.pos: r.distance for r in cache.reuse_distance(df, 12, 100).collect()} == want


def test_cache_operations(spark):
    # five puts, a get that hits, a put that evicts, a get that misses
    ops = [("put", f"v00{i}") for i in range(1, 6)] + [("get", "v001"), ("put", "v006"), ("get", "v002"), ("contains", "v003"), ("put", "v003"), ("get", "v009"), ("put", "v007")]
    df = spark.createDataFrame([("one", i, k, o) for i, (o, k) in enumerate(ops)] + [("two", 0, "v001", "get")], "cache string, pos long, key string, op string")
    got = {(r.cache, r.pos): (r.found, r.evicted) for r in cache.operate(df, 5).collect()}
    assert [got["one", i] for i in range(5, 12)] == [(True, None), (False, "v002"), (False, None), (True, None), (True, None), (False, None), (False, "v004")]
    assert got["two", 0] == (False, None)


def test_rolling_mean_over_blocks(spark):
    df = spark.range(1, 501).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 13).alias("value")).repartition(5)
    got = {r.event_id: r.rolling for r in windows.rolling_mean(df, "value", "event_id", n=50, span=60).collect()}
    value = {i: i * 7 % 13 for i in range(1, 501)}
    for i in value:
        own = [value[k] for k in range(max(1, i - 49), i + 1)]
        assert abs(got[i] - sum(own) / len(own)) < 1e-9


def test_signature_of_nothing(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    seen = spark.createDataFrame([(1, 5)], "user_id long, item long")
    got = {r.user_id: r.sig for r in similarity.signatures_of(users, seen, 8).collect()}
    assert got[2] == [similarity.PRIME] * 8 and max(got[1]) < similarity.PRIME


def test_deletion_tells_what_was_there(spark):
    terms = prefix.vocabulary(spark.createDataFrame([("a",), ("b",)], "term string"))
    words = spark.createDataFrame([("A",), ("c",)], "word string")
    assert {r.word: r.existed for r in prefix.deleted(terms, words).collect()} == {"A": True, "c": False}


def test_flags_of_dotted_addresses(spark, tmp_path):
    rows = [(i, f"2025-01-01 00:00:{i:02d}", "u", f"10.0.0.{i % 4}" if i else "") for i in range(9)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id string, address string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    every = jobs.run_to_table(jobs.flagged_users(stream, 3), "append", "dotted").collect()
    assert sorted((r.event_id, r.addresses) for r in every) == [(3, 3), (4, 4), (5, 4), (6, 4), (7, 4), (8, 4)]
    capped = jobs.run_to_table(jobs.flagged_users(stream, 3, all_counts=False), "append", "dotted").collect()
    assert sorted((r.event_id, r.addresses) for r in capped) == [(i, 3) for i in range(3, 9)]


def test_bursts_are_more_rows(spark):
    stream = generator.event_stream(spark, 10, burst=5.0, burst_at=1.0, burst_seconds=2.0, numPartitions="1")
    assert stream.isStreaming and {"user_id", "event_type", "payload"} <= set(stream.columns)


def test_commands(spark, tmp_path, capsys):
    frames = []
    done = commands.run(spark, rate=40, seconds=10, refresh=5.0, show=frames.append)
    assert done["events"] > 0 and frames and done["bots"] <= done["alerts"]
    commands.main(["generate", "--events", "300", "--output", str(tmp_path / "csv")])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 300
    out = commands.demo(spark, show=lambda _: None)
    assert out["first"][0] in ("purchase", "subscription") and "bot_user" in out["suspects"]
    assert out["stats"]["processed"] == 510 and out["completed"]["salt"] == ["salt and cinder", "salt harbour"]
