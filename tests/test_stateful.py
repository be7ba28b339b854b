"""Streams with bounded state: by themselves with a state in memory, and over Spark."""

from __future__ import annotations

import heapq
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rillmark.operators import similarity
from rillmark.operators.lsh_index import LshIndex
from rillmark.streaming import batches, bot_filter, frames, metrics, pending, signatures, top_items, trailing
from rillmark.streaming.service import RecommendationService


class State:
    def __init__(self):
        self.value, self.rows = None, []

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if self.value is not None else iter(self.rows)

    def update(self, value):
        self.value = value

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def clear(self):
        self.value, self.rows = None, []


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getValueState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, State())

    getListState = getValueState  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)


def started(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def fed(processor, key, *parts):
    return [r for out in processor.handleInputRows((key,), iter([pd.DataFrame(p) for p in parts]), None) for r in out.itertuples(index=False, name=None)]


# ---- signatures and their index ------------------------------------------------------------


def test_only_changed_bands_are_given(spark):
    one = signatures.Minima(8, 4)
    started(one)
    r = random.Random(4)
    first = [r.randrange(similarity.PRIME) for _ in range(30)]
    assert [x[1:2] + x[3:] for x in fed(one, 7, {"h": first[:10]})] == [(b, False) for b in range(4)]
    assert fed(one, 7, {"h": first[:10]}, {"h": first[3:5]}) == []
    started(one)
    now = {}
    for part in (first[:10], first[10:12], first[12:]):
        for user, band, key, gone in fed(one, 7, {"h": part}):
            assert (now.pop(band) if gone else now.setdefault(band, key)) == key and user == 7
    best = [min((h * a + b) % similarity.PRIME for h in first) for a, b in similarity.family(8)]
    assert one.keys(pd.Series(best).to_numpy()) == ["-".join(map(str, best[2 * b : 2 * b + 2])) for b in range(4)]
    assert one.held.get()[0] == best


@pytest.mark.parametrize("kind", ["long", "string"])
def test_users_of_a_slice_keep_their_own_signatures(spark, kind, monkeypatch):
    monkeypatch.setattr(signatures, "SLICES", 2)
    monkeypatch.setattr(signatures, "CHUNK", 16)
    r = random.Random(8)
    rows = [(None if u == 5 else (1 << 60) + u, r.randrange(60), b) for b in range(3) for u in range(12) for _ in range(r.randrange(9)) if u % 4 != b]
    watches = spark.createDataFrame(rows, "user_id long, item long, b int").withColumn("user_id", F.col("user_id").cast(kind))
    sink = batches.Batches(spark, "slices")
    changed = signatures.changed_keys(batches.replayed(watches, 3, "b", "user_id"), 8, 4, mark=True)
    assert "slice" in changed._jdf.queryExecution().analyzed().toString()
    now, marks = {}, 0
    for x in sorted(sink.run(changed, "update").rows(changed.schema).collect(), key=lambda x: (x.batch, not x.gone)):
        if x.band < 0:
            marks += 1
        else:
            assert (now.pop((x.user_id, x.band)) if x.gone else now.setdefault((x.user_id, x.band), x["key"])) == x["key"]
    want = similarity.band_keys(similarity.signatures(watches, 8), 8, 4).collect()
    assert now == {(x.user_id, x.band): x["key"] for x in want} and marks >= len({u for u, _, _ in rows})


def keys_of(rows, spark):
    return spark.createDataFrame(rows, "user_id long, band int, key string")


def test_index_takes_changes_and_is_asked_in_place(spark):
    index = LshIndex(spark)
    index.add(keys_of([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 1, "b")], spark), 0)
    change = spark.createDataFrame([(1, 0, "a", True), (1, 0, "c", False)], "user_id long, band int, key string, gone boolean")
    for _ in range(2):  # taking it again changes nothing
        index.apply(change, 1)
    held = lambda: sorted((r.band, r["key"], r.user_id) for r in index.current().collect())
    assert held() == [(0, "a", 2), (0, "c", 1), (1, "b", 1), (1, "b", 3)]
    asks = keys_of([(9, 0, "c"), (9, 1, "b"), (1, 1, "b"), (2, 5, "a")], spark)
    assert sorted(tuple(r) for r in index.candidates(asks).collect()) == [(1, 3), (9, 1), (9, 3)]
    index.remove(spark.createDataFrame([(3,), (77,)], "user_id long"), 2)
    assert held() == [(0, "a", 2), (0, "c", 1), (1, "b", 1)] and index.size() == 2
    index.compact()
    assert held() == [(0, "a", 2), (0, "c", 1), (1, "b", 1)] and spark.table(index.name).count() == 3
    index.add(keys_of([(3, 1, "b")], spark), 3)
    assert index.size() == 3


def test_index_is_not_shuffled(spark):
    index = LshIndex(spark)
    index.add(keys_of([(u, b, str(u % 7)) for u in range(40) for b in range(4)], spark), 0)
    assert "Exchange" not in index.current()._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.candidates(keys_of([(u, b, "3") for u in range(40) for b in range(4)], spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    scan = next(i for i, x in enumerate(lines) if index.name in x)
    asked, own = (i for i, x in enumerate(lines) if i > join and (x.lstrip(" |").startswith((":- ", "+- ", ":-"))) and x.index("- ") == lines[join].index("- ") + 3)
    assert asked < own < scan and "Exchange" in "".join(lines[asked:own]) and "Exchange" not in "".join(lines[own : scan + 1])


def test_pairs_from_a_similarity_on(spark):
    r = random.Random(6)
    rows = [(u, r.randrange(12)) for u in range(60) for _ in range(r.randrange(1, 8))] + [(u, i) for u in (70, 71, 72) for i in (1, 2, 99)] + [(80, None), (81, None), (None, 1), (82, 99)]
    watches = spark.createDataFrame(rows, "user_id long, item long")
    sets = {u: {i for v, i in rows if v == u} for u, _ in rows if u is not None}
    for t in (0.1, 0.5, 0.6, 1.0):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
        got = [tuple(x) for x in similarity.pairs_at_least(watches, t).collect()]
        assert {(a, b): s for a, b, s in got} == want and len(got) == len(want)
    assert similarity.pairs_at_least(watches.where("user_id > 99"), 0.5).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        similarity.pairs_at_least(watches, 0)


# ---- counters, filters, windows ------------------------------------------------------------


def test_counts_are_off_by_no_more_than_they_say():
    r = random.Random(5)
    for counters in (1, 3, 10, 50):
        one = top_items.Counters(counters, 5, LongType())
        started(one)
        true = {}
        for _ in range(30):
            part = [int(r.paretovariate(0.7)) % 200 for _ in range(r.randrange(1, 80))]
            for x in part:
                true[x] = true.get(x, 0) + 1
            out = fed(one, 0, {"item": part, "n": [1] * len(part)})
            items, counts, off, total, _ = one.held.get()
            assert len(items) <= counters and total == sum(true.values()) and off * (counters + 1) <= total
            assert all(n <= true[i] <= n + off for i, n in zip(items, counts, strict=True))
            assert {i for i, n in true.items() if n > off} <= set(items) and len(out) <= 5
    assert top_items.counters_for(0.001) == 1000 and top_items.counters_for(0.3) == 4


def addresses(rows):
    return {"user_id": [u for u, _, _ in rows], "user": [u for u, _, _ in rows], "event_id": range(len(rows)), "us": [t for _, _, t in rows], "h1": [hash((u, a, 1)) for u, a, _ in rows], "h2": [hash((u, a, 2)) for u, a, _ in rows]}


def test_filter_keeps_its_size():
    one = bot_filter.PairFilter(3, 1 << 16, 7, 10**9)
    started(one)
    r, seen, sizes = random.Random(1), {}, set()
    for t in range(40):
        rows = [(r.randrange(20), r.randrange(300), t) for _ in range(100)]
        flagged = {e: n for _, e, n in fed(one, 0, addresses(rows))}
        for i, (u, a, _) in enumerate(rows):
            seen.setdefault(u, set()).add(a)
            assert flagged.get(i, 0) in (len(seen[u]), len(seen[u]) - 1) if len(seen[u]) > 3 else flagged.get(i, 0) <= len(seen[u])
        sizes.add(len(one.held.get()[0]))
    assert sizes == {1 << 13}


def test_filter_grows_with_what_was_not_expected():
    one = bot_filter.PairFilter(1, 1 << 10, 30, 10**9)  # for about 23 pairs
    started(one)
    r, seen = random.Random(5), {}
    for t, n in enumerate((10, 3000, 200, 4000)):
        rows = [(r.randrange(20), r.randrange(400), t) for _ in range(n)]
        flagged = {e: n for _, e, n in fed(one, 0, addresses(rows))}
        for i, (u, a, _) in enumerate(rows):
            seen.setdefault(u, set()).add(a)
            assert flagged[i] == len(seen[u])
    assert len(one.held.get()[0]) < 1 << 17


def test_filter_forgets():
    one = bot_filter.PairFilter(1, 1024, 5, 100)
    started(one)
    count = lambda t, a: fed(one, 0, addresses([(1, a, t)]))[0][2]
    assert [count(0, "x"), count(50, "x"), count(120, "x"), count(230, "x")] == [1, 1, 1, 1]  # seen again in each generation
    assert [count(231, "y"), count(440, "x"), count(441, "y")] == [2, 1, 2]  # all forgotten, the user too


def test_slot_gives_closed_windows():
    r = random.Random(2)
    us = sorted(r.randrange(40) for _ in range(60))
    for resolution in (1, 5):
        out = {}
        for slot in range(4):
            one = trailing.Slot(15, 10, resolution)
            handle = started(one)
            rows = [(i, t) for i, t in enumerate(us) if t // 10 <= slot <= (t + 15) // 10]
            r.shuffle(rows)
            for part in (rows[::2], rows[1::2]):
                assert fed(one, slot, {"event_id": [i for i, _ in part], "us": [t for _, t in part]} if part else {"event_id": pd.Series([], dtype="int64"), "us": pd.Series([], dtype="int64")}) == []
            assert len(handle.timers) == 1
            for frame in one.handleExpiredTimer((slot,), None, None):
                out |= dict(frame.itertuples(index=False, name=None))
            assert not one.ring.exists()
        assert out == {i: sum(t - 15 - (t - 15) % resolution <= x < t - t % resolution + resolution for x in us) for i, t in enumerate(us)}


# ---- queues and recovery -------------------------------------------------------------------


def test_queue_releases_in_order(spark):
    r = random.Random(3)
    arrivals = [[(b * 100 + i, r.randrange(4), r.randrange(50)) for i in range(n)] for b, n in enumerate((30, 0, 45, 3))]
    queue = pending.PendingQueue(spark, 12)
    heap, want, left = [], [], []
    for b, rows in enumerate(arrivals):
        df = spark.createDataFrame(rows, "event_id long, priority int, s long").withColumn("ts", F.timestamp_seconds("s"))
        for _ in range(2 if b == 2 else 1):  # a trigger that is repeated
            queue.trigger(df, b)
        for i, p, s in rows:
            heapq.heappush(heap, (p, s, i))
        want += [(b, k, heapq.heappop(heap)[2]) for k in range(1, 1 + min(12, len(heap)))]
        left.append(len(heap))
    again = pending.PendingQueue(spark, 12, queue.path)  # goes on from the folder
    assert again.drain(4) >= 7
    for b in range(4, 20):
        want += [(b, k, heapq.heappop(heap)[2]) for k in range(1, 1 + min(12, len(heap)))]
    assert sorted((x.batch, x.place, x.event_id) for x in again.released().collect()) == want
    told = again.statistics().groupBy("batch").agg(F.sum("pending").alias("n")).orderBy("batch").collect()
    assert [x.n for x in told][:4] == left and told[-1].n == 0


@pytest.mark.parametrize("n", [1, 7, 24, 25, 100])
def test_draining_is_no_job_for_each_trigger(spark, n, monkeypatch):
    rows = [(i, i % 3, i * 7 % 11) for i in range(24)]
    df = spark.createDataFrame(rows, "event_id long, priority int, s long").withColumn("ts", F.timestamp_seconds("s"))
    queue = pending.PendingQueue(spark, n)
    first = queue.trigger(df, 0)
    monkeypatch.setattr(queue, "trigger", None)
    assert queue.drain(1) == 2 + (24 - first) // n
    order = sorted(rows, key=lambda x: (x[1], x[2], x[0]))
    assert sorted((x.batch, x.place, x.event_id) for x in queue.released().collect()) == [(i // n, i % n + 1, x[0]) for i, x in enumerate(order)]
    told = queue.statistics().groupBy("batch").agg(F.sum("released").alias("r"), F.sum("pending").alias("p")).orderBy("batch").collect()
    assert [(x.r, x.p) for x in told if x.r] == [(min(n, 24 - b), max(0, 24 - b - n)) for b in range(0, 24, n)]
    assert queue.waiting(99).count() == 0


def test_no_row_twice_after_a_failure(spark):
    rows = spark.range(300).withColumn("x", F.col("id") % 7)
    stream, sink, failed = batches.replayed(rows, 3, "id"), batches.Batches(spark, "recovery"), []

    def fails_once(batch, number):
        sink.write(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost between writing and the commit")

    with pytest.raises(Exception, match="lost between"):
        sink.run(stream, take=fails_once)
    assert sorted(r.id for r in sink.rows(rows.schema).collect()) != list(range(300))
    sink.run(stream, take=fails_once)
    assert sorted(r.id for r in sink.rows(rows.schema).collect()) == list(range(300)) and failed == [1]


def test_stop_ends_what_has_arrived(spark):
    rows = spark.range(100)
    sink = batches.Batches(spark, "drained")
    query = sink.start(batches.replayed(rows, 4, "id"))
    batches.stop_drained(query)
    assert not query.isActive and sink.rows(rows.schema).count() == 100
    batches.stop_drained(query)


# ---- metrics and frames --------------------------------------------------------------------


def test_late_and_repeated_rows_are_told_apart(spark):
    table = metrics.MetricsTable(spark)
    rows = [(i, i) for i in range(10, 1000, 10)] + [(i, i) for i in range(100, 1000, 100)]  # seconds; some twice
    late = [(5000 + i, 3) for i in range(7)]  # far behind the watermark when they come
    shape = "event_id long, s long"
    parts = [spark.createDataFrame(x, shape).withColumn("ts", F.timestamp_seconds("s")) for x in (rows, [(9000, 990)], late)]  # what is late is told by the batch before the last one's watermark
    sink = batches.Batches(spark, "admitted")
    try:
        stream = metrics.admitted(batches._streamed(parts, parts[0]), "2 minutes")
        sink.run(stream)
        done = table.totals().collect()[0]
        each = {r.batch: (r.received, r.late, r.repeated) for r in table.rows().collect() if r.input_rows}
    finally:
        table.close()
    passed = sink.rows(stream.schema).count()
    assert (done.received, done.late, done.repeated, done.passed) == (116, 7, 9, passed) == (116, 7, 9, 100)
    assert each == {0: (108, 0, 9), 1: (1, 0, 0), 2: (7, 7, 0)}


def test_frames_of_a_stream(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("type"), F.col("id") % 7).alias("kind"), "id")
    counts = batches.replayed(rows, 2, "id").groupBy("kind").agg(F.count("*").alias("n"))
    query = frames.shown(frames.sections(counts, "events", "kind", "n"), str(tmp_path / "frames"), str(tmp_path / "checkpoint"), top=3, availableNow=True)
    query.awaitTermination()
    frame = frames.last_frame(spark, str(tmp_path / "frames"))
    assert frame.splitlines()[0] == "batch 1" and frame.splitlines()[1].split() == ["events", "100"]
    assert [x.split()[1:3] for x in frame.splitlines()[2:]] == [["type0", "15"], ["type1", "15"], ["type2", "14"]]
    assert len(list((tmp_path / "frames").glob("frame-*.txt"))) == 2 and frames.last_frame(spark, str(tmp_path / "none")) is None


# ---- served recommendations ----------------------------------------------------------------


def test_a_watch_makes_the_own_list_outdated(spark):
    shape = "user_id long, item long"
    first = [(u, i) for u in (1, 2, 3) for i in range(u, 12)] + [(9, 500)]
    service = RecommendationService(spark, k=16, bands=16, n=3)
    old = spark.createDataFrame(first, shape)
    service.ingest(batches._streamed([old], old))
    asks = spark.createDataFrame([(1,), (2,), (3,), (9,), (77,)], "user_id long")
    lists = lambda df: {r.user_id: (r["items"], r.source, r.from_cache) for r in df.collect()}
    got = lists(service.serve(asks, old, 0))
    assert got[2][:2] == ([1], "similar") and got[3][:2] == ([1, 2], "similar") or got[3][0] == [2, 1]
    assert got[77][1] == got[9][1] == "popular" and len(got[9][0]) == 3 and not any(x[2] for x in got.values())
    more = spark.createDataFrame([(2, 1), (3, 4)], shape)  # 4 is nothing new for user 3, but a watch
    whole = old.unionByName(more)
    again = RecommendationService(spark, k=16, bands=16, n=3, path=service.changes.path)
    source = batches._streamed([old, more], old)
    again.changes.path = f"{service.changes.path}/second"  # another source, another checkpoint
    again.ingest(source)
    got = lists(again.serve(asks, whole, 1))
    assert {u for u, x in got.items() if not x[2]} >= {2, 3} and got[77][2]
    told = again.statistics(whole).collect()[0]
    assert told.recommender.users == 4 and told.cache.requests == 10 and told.cache.hits + told.cache.misses == 10


def test_a_replayed_part_is_one_batch_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(batches, "FILE_ROWS", 20)
    rows = spark.range(300).withColumn("ts", F.timestamp_seconds(F.when(F.col("id") < 3, F.col("id")).otherwise(9)))
    last = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.timestamp_seconds(F.lit(0)).alias("ts"))
    for stream, parts in ((batches.replayed(rows, 3, closing=last), 4), (batches.replayed_in_order(rows, 3), None)):
        sink, files = batches.Batches(spark, "files"), []
        sink.run(stream, take=lambda batch, number: (files.append(batch.select(F.input_file_name()).distinct().count()), sink.write(batch, number)))  # noqa: B023
        out = sink.rows(stream.schema).groupBy("batch").agg(F.collect_list("id").alias("ids"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("batch").collect()
        assert sorted(i for r in out for i in r.ids if i >= 0) == list(range(300)) and max(files) > 1
        if parts:
            assert len(out) == parts and out[-1].ids == [-1]
        else:
            assert all(a.hi < b.lo for a, b in zip(out, out[1:]))


def test_cells_of_a_stream_with_null_items(spark):
    from rillmark.operators import frequency
    from rillmark.streaming import jobs

    rows = spark.range(500).select(F.when(F.col("id") % 9 > 0, F.col("id") % 13).alias("item"))
    cells = top_items.sketch_cells(batches.replayed(rows.withColumn("id", F.monotonically_increasing_id()), 3, "id"), "item", 64, 3)
    want = rows.select(frequency.cells("item", 64, 3).alias("c")).groupBy("c.row", "c.col").count()
    assert sorted(map(str, jobs.run_to_table(cells, "complete", "cells").collect())) == sorted(str(r).replace("count=", "cnt=") for r in want.collect())
    assert "MapInArrow" in cells._jdf.queryExecution().analyzed().toString()
