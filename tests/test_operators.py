"""Golden cases worked out by hand, edge cases and invariants."""

from __future__ import annotations

from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from rillmark.operators import bloom, bots, cache, frequency, prefix, priority, recommend, similarity, windows
from rillmark.sources import events as src
from rillmark.sources import files, generator


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def addresses(spark, rows):
    return frame(spark, [(i, u, a) for i, (u, a) in enumerate(rows)], "event_id long, user_id string, address string").withColumn("ts", F.timestamp_seconds("event_id"))


def test_suspects(spark):
    e = addresses(spark, [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "2"), ("c", "3"), ("c", "4")])
    assert [tuple(r) for r in bots.suspects(e).collect()] == [("c", 4)]


def test_running_flag(spark):
    e = addresses(spark, [("u", "192.168.1.1"), ("u", "10.0.0.1"), ("u", "10.0.0.1"), ("u", "172.16.0.1"), ("u", "8.8.8.8"), ("u", None), ("u", "")])
    got = [r.flagged for r in bots.running_flag(e).orderBy("event_id").collect()]
    assert got == [False, False, False, True, True]


TITLES = [("avengers endgame", 9500), ("avengers infinity war", 8900), ("avatar the way of water", 7200), ("the dark knight", 9800), ("the dark knight rises", 8100), ("spider-man no way home", 9100), ("spider-man homecoming", 7500), ("thor ragnarok", 7800)]


@pytest.mark.parametrize(("asked", "want"), [("av", ["avengers endgame", "avengers infinity war", "avatar the way of water"]), ("the d", ["the dark knight", "the dark knight rises"]), ("SPIDER ", ["spider-man no way home", "spider-man homecoming"]), ("thor", ["thor ragnarok"]), ("x", [])])
def test_complete(spark, asked, want):
    terms = prefix.vocabulary(frame(spark, TITLES, "term string, n long"), weight="n")
    assert [r.term for r in prefix.complete(terms, asked, 3).collect()] == want
    many = prefix.complete_many(terms, frame(spark, [(asked,)], "prefix string"), 3).orderBy("rank").collect()
    assert [r.term for r in many] == want


def test_vocabulary_and_lookup(spark):
    terms = prefix.vocabulary(frame(spark, [(" Foo ",), ("foo",), ("\t",), (None,)], "term string"))
    assert [tuple(r) for r in terms.collect()] == [("foo", 2)]
    got = prefix.lookup(terms, frame(spark, [("FOO",), ("foo ",)], "word string")).collect()
    assert {(r.word, r.freq) for r in got} == {("FOO", 2), ("foo ", 0)}


def test_delete_removes_an_existing_term(spark):
    terms = prefix.vocabulary(frame(spark, [("a",), ("b",)], "term string"))
    assert [r.term for r in prefix.without(terms, frame(spark, [("A",)], "word string")).collect()] == ["b"]


def test_suggest_sees_only_earlier_searches(spark):
    catalog = prefix.vocabulary(frame(spark, [("avatar",)], "term string"))
    out = prefix.suggested_before(frame(spark, [(1, "av"), (2, "av")], "search_id long, query string"), catalog).orderBy("search_id", "rank").collect()
    assert [(r.search_id, r.term, r.freq) for r in out] == [(1, "avatar", 1), (2, "av", 1), (2, "avatar", 1)]


def test_priorities(spark):
    rows = [(0, "search", False), (1, "play", True), (2, "purchase", False), (3, "play", False), (4, "play", True), (5, "subscribe", False), (6, "log", False), (7, "log", True), (8, "purchase", True), (9, "like", None)]
    e = priority.classified(frame(spark, rows, "event_id long, event_type string, is_premium boolean").withColumn("ts", F.timestamp_seconds("event_id")))
    assert {r.event_id: r.priority for r in e.collect()} == {0: 2, 1: 1, 2: 0, 3: 1, 4: 1, 5: 2, 6: 3, 7: 1, 8: 0, 9: 3}
    assert [r.event_id for r in priority.drained(e.where("event_id < 6")).collect()] == [2, 1, 3, 4, 0, 5]
    assert priority.batch(e.where("event_id < 0"), 1).count() == 0


def test_top_k_keeps_every_candidate(spark):
    e = frame(spark, [("a",), ("a",), ("a",), ("b",), (None,)], "item string")
    assert [tuple(r) for r in frequency.top_k(e, "item", 3).collect()] == [("a", 3), ("b", 1)]


def test_sizes():
    assert (bloom.bits_for(1_000_000, 0.01), bloom.hashes_for(9_585_058, 1_000_000)) == (9_585_058, 6)
    assert (frequency.width_for(0.001), frequency.depth_for(0.01)) == (2719, 5)
    assert round(similarity.lsh_threshold(128, 32), 4) == 0.4204
    with pytest.raises(ValueError):
        similarity.lsh_threshold(10, 3)


def test_bloom_has_no_false_negatives(spark):
    known = frame(spark, [(f"u{i}",) for i in range(200)], "user_id string")
    judged = bloom.contains(known, "user_id", bloom.build(known, "user_id", 2048, 4), 2048, 4)
    assert judged.where("not maybe").count() == 0


def test_native_filter_agrees(spark):
    known = frame(spark, [(i,) for i in range(0, 400, 2)], "user_id long")
    native = bloom.native_filter(known, "user_id", 200, 0.01)
    assert all(native.mightContainLong(i) for i in range(0, 400, 2))
    assert sum(native.mightContainLong(i) for i in range(1, 400, 2)) < 20


def test_sketch_never_underestimates(spark):
    e = frame(spark, [(f"i{i % 37}",) for i in range(900)], "item string")
    table = frequency.sketch(e, "item", 11, 3)
    both = frequency.relative_error(frequency.estimate(e, "item", table, 11, 3), frequency.exact(e, "item"), "item")
    assert both.where("estimate < cnt").count() == 0
    assert [r.n for r in table.groupBy("row").agg(F.sum("cnt").alias("n")).collect()] == [900] * 3


def test_jaccard(spark):
    sets = frame(spark, [([1, 3, 7, 12], [1, 3, 9, 12], 0.6), ([], [], 1.0), ([], [1], 0.0), (list(range(50)), list(range(30, 80)), 0.25)], "a array<int>, b array<int>, want double")
    assert sets.where(similarity.jaccard(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_candidates_are_pairs_and_equal_sets_meet(spark):
    w = frame(spark, [(u, i) for u in (1, 2) for i in range(20)] + [(3, 99)], "user_id long, item long")
    sigs = similarity.signatures(w, 16)
    pairs = similarity.scored(similarity.candidates(similarity.band_keys(sigs, 16, 4)), sigs, 16).collect()
    assert [(r.u, r.v, r.similarity) for r in pairs] == [(1, 2, 1.0)]


def test_fallback_is_what_is_popular(spark):
    w = frame(spark, [(1, 10), (2, 10), (2, 11)], "user_id long, item long")
    none = frame(spark, [], "user_id long, item long, score double, rank int")
    out = recommend.with_fallback(frame(spark, [(1,), (9,)], "user_id long"), none, w, 1).collect()
    assert {(r.user_id, r.item, r.source) for r in out} == {(1, 10, "popular"), (9, 10, "popular")}


def test_cache_golden(spark):
    keys = [1, 2, 3, 4, 5, 1, 6, 2]
    log = frame(spark, list(enumerate(keys)), "pos long, key long")
    out = cache.play(log, 5, span=3).orderBy("pos").collect()
    assert [r.hit for r in out] == [False] * 5 + [True, False, False]
    assert (out[6].evicted, out[7].evicted) == (2, 3)
    assert [r.key for r in cache.contents(log.where("pos < 7"), 5).orderBy("rank").collect()] == [6, 1, 5, 4, 3]
    assert tuple(cache.statistics(cache.play(log.limit(0), 5)).collect()[0]) == (0, 0, 0.0)


@pytest.mark.parametrize("capacity", [0, 1, 3, 8])
def test_cache_equals_one_list(spark, capacity):
    keys = [(i * i * 7 + i // 3) % 13 for i in range(200)]
    held, want = OrderedDict(), []
    for k in keys:
        want.append(k in held)
        held[k] = True
        held.move_to_end(k)
        if len(held) > max(1, capacity):
            held.popitem(last=False)
    log = frame(spark, list(enumerate(keys)), "pos long, key long")
    assert [r.hit for r in cache.play(log, capacity, span=17).orderBy("pos").collect()] == want
    far = cache.reuse_distance(log, max(1, capacity)).orderBy("pos").collect()
    assert [r.distance is not None for r in far] == want


def test_closed_window(spark):
    e = frame(spark, [(1, 0), (2, 60), (3, 121)], "event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    for out in (windows.trailing_count(e, 60), windows.trailing_total(e, 60, 50)):
        assert {r.event_id: r.in_window for r in out.collect()} == {1: 1, 2: 2, 3: 1}
    assert windows.contents(e, F.timestamp_seconds(F.lit(60)), 60).count() == 2


def test_generator_is_repeatable_and_in_proportion(spark, tmp_path):
    one, two = generator.events(spark, 20_000, 7).drop("payload"), generator.events(spark, 20_000, 7).repartition(7).drop("payload")
    assert one.exceptAll(two).count() == 0
    share = one.where("event_type = 'play'").count() / 20_000
    assert abs(share - 0.40) < 0.02
    assert one.where("(event_type = 'search') <> (video_id is null)").count() == 0
    ranks = generator.zipf(spark, 1000, 50_000, 1.2, 3).groupBy("rank").count().orderBy("rank").collect()
    weight = sum((i + 1) ** -1.2 for i in range(1000))
    assert abs(ranks[0]["count"] / 50_000 - 1 / weight) < 0.02 and ranks[-1]["rank"] <= 999
    files.write_csv(generator.stored(spark, 500, 5), str(tmp_path / "csv"))
    back = src.read_csv(spark, str(tmp_path / "csv"))
    assert back.count() == 500 and back.where("timestamp is null or is_premium is null").count() == 0
    assert generator.events(spark, 5).select(generator.line()).count() == 5
    assert generator.random_words(spark, 10).where("length(word) = 8").count() == 10


def test_empty_tables(spark):
    e = frame(spark, [], "event_id long, user_id long, address long, item long, event_type string, is_premium boolean, ts timestamp")
    assert bots.suspects(e).count() == 0 and frequency.top_k(e, "item", 3).count() == 0
    assert similarity.exact_pairs(e).count() == 0 and windows.hot_item(e, "1 hour").count() == 0
