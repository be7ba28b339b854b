from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from rillmark.operators import neighbours, recommend, similarity
from rillmark.plans import queries


def plain(rows, near: int, k: int):
    """One user after the other; a null item (None) counts in sizes, is never common or seen, and comes last."""
    has = defaultdict(set)
    for u, i in rows:
        if u is not None:
            has[u].add(i)
    out = []
    for u, own in has.items():
        common = {v: len((own & other) - {None}) for v, other in has.items() if v != u}
        ranked = sorted((-(c / (len(own) + len(has[v]) - c)), v) for v, c in common.items() if c)[:near]
        scores = defaultdict(float)
        for s, v in ranked:
            for i in has[v]:
                if i is None or i not in own:
                    scores[i] -= s
        best = sorted(((-round(s, 9), i is None, i) for i, s in scores.items()), key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[:k]
        out += [(u, i, -s, r) for r, (s, _, i) in enumerate(best, 1)]
    return sorted(out, key=lambda x: (x[0], x[3]))


def answers(df):
    return sorted(((r.user_id, r.item, r.score, r.rank) for r in df.select("user_id", "item", "score", "rank").collect()), key=lambda x: (x[0], x[3]))


def random_rows(seed: int, users: list, items: list, n: int) -> list:
    rnd = random.Random(seed)
    return [(rnd.choice(users), items[int(len(items) * rnd.random() ** 2)]) for _ in range(n)]


WIDE = [-(1 << 63), -5, 0, 7, 1 << 31, (1 << 31) + 1, 1 << 40, (1 << 63) - 2]


@pytest.mark.parametrize(("users", "items", "kind"), [
    (list(range(1, 61)), list(range(40)), "user_id long, item long"),
    (list(range(50)), [*range(30), None], "user_id int, item long"),
    ([*WIDE, *range(100, 130), None], [*WIDE, *range(12)], "user_id long, item long"),
    ([*WIDE, *range(100, 130)], [*WIDE, *range(12), None], "user_id long, item long"),
    ([f"u{n}" for n in range(40)] + [None], [f"i{n}" for n in range(30)] + [None], "user_id string, item string"),
])
def test_equals_one_user_after_the_other(spark, monkeypatch, users, items, kind):
    rows = random_rows(3, users, items, 400)
    w = spark.createDataFrame(rows, kind)
    for weight in (1 << 26, 50):  # one block, and many of them, with crowded ranges
        monkeypatch.setattr(neighbours, "WEIGHT", weight)
        out = neighbours.recommend_exact(w, 5, 4)
        got = answers(out)
        want = plain(rows, 5, 4)
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1.1e-9, rtol=0)
        assert out.schema["user_id"].dataType == w.schema["user_id"].dataType and out.schema["item"].dataType == w.schema["item"].dataType


def test_equals_pairs(spark):
    w = spark.createDataFrame(random_rows(5, list(range(300)), list(range(200)), 4000), "user_id long, item long")
    assert answers(neighbours.recommend_exact(w, 20, 10)) == answers(recommend.recommend(w, similarity.nearest(similarity.exact_pairs(w), 20), 10))


def test_nothing_in_common(spark):
    empty = spark.createDataFrame([], "user_id long, item long")
    alone = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, None), (None, 1)], "user_id long, item long")
    assert neighbours.recommend_exact(empty).count() == 0 and neighbours.recommend_exact(alone).count() == 0
    highest = spark.createDataFrame([(1, (1 << 63) - 1)], "user_id long, item long")
    with pytest.raises(Exception, match="highest long"):
        neighbours.recommend_exact(highest).count()


def test_pairs_do_not_reach_the_disk(spark, tmp_path):
    """500 items with 100 users each: 2.5 million pairs, of 50,000 rows."""
    lines = spark.range(50_000).select(F.col("id").alias("l_orderkey"), (F.col("id") % 500).alias("l_partkey"))
    orders = spark.range(50_000).select(F.col("id").alias("o_orderkey"), F.pmod(F.xxhash64("id"), F.lit(2000)).alias("o_custkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    context = spark.sparkContext
    context.setJobGroup("pairs", "")
    assert queries.queries()["recommend_exact"](spark, str(tmp_path)).count() == 20_000
    context.setLocalProperty("spark.jobGroup.id", None)
    shuffled, seen = 0, context.statusTracker()
    for stage in {s for j in seen.getJobIdsForGroup("pairs") for s in seen.getJobInfo(j).stageIds}:
        try:
            data = context._jsc.sc().statusStore().lastStageAttempt(stage)
        except Py4JJavaError:  # skipped
            continue
        shuffled += data.shuffleWriteBytes() + data.diskBytesSpilled()
    assert 0 < shuffled < 5_000_000


def test_packed_columns():
    longs = np.array([np.iinfo(np.int64).min, -1, 0, 5, np.iinfo(np.int64).max])
    one, two, three = neighbours.unpack(neighbours.pack(longs, longs[:0], np.array([7, 7])))
    assert one.tolist() == longs.tolist() and len(two) == 0 and three.tolist() == [7, 7]
    counts, flat = np.array([2, 1, 3]), np.array([longs[0], longs[4], 3, -2, 0, 1 << 40])
    heads, n, values, more = neighbours.unpack_lists(neighbours.pack_lists(np.array([1, 5, 6]), counts, flat, flat))
    assert (heads.tolist(), n.tolist(), values.tolist(), more.tolist()) == ([1, 5, 6], [2, 1, 3], flat.tolist(), flat.tolist())


def test_users_with_very_long_lists(monkeypatch):
    """A user with more to count than a batch has is counted by itself, with the same result."""
    rnd = random.Random(2)
    lists = [sorted(rnd.sample(range(30), rnd.randint(2, 20))) for _ in range(40)]
    counts, flat = np.array([len(x) for x in lists]), np.array([u for x in lists for u in x])
    size = np.bincount(flat, minlength=30)
    body = neighbours.rows(to=[0], kind=[0], body=[neighbours.pack_lists(np.zeros(40), counts, flat, size[flat])])
    blocks = neighbours.Blocks(np.ones(neighbours.CELLS), 0, 29, 1)
    found = []
    for batch in (1 << 19, 20):
        monkeypatch.setattr(neighbours, "BATCH", batch)
        found.append([c.tolist() for c in neighbours.joined([neighbours.unpack(b) for _, _, b in neighbours.bodies(neighbours.nearest(blocks, 5)(iter([body])))], np.int64, np.int64, np.int64)])
    assert found[0] == found[1] and len(found[0][0]) == 150


def test_blocks_of_crowded_ranges():
    weights = np.zeros(neighbours.CELLS)
    weights[5], weights[100:200] = 1000 * neighbours.WEIGHT, neighbours.WEIGHT / 10
    blocks = neighbours.Blocks(weights, 0, 40_959, 4)
    users = np.arange(40_960)
    block = blocks.of(users)
    assert 0 <= block.min() and block.max() < blocks.n and blocks.cuts[5] >= 500
    assert len(set(block[50:60].tolist())) > 5 and len(set(block[1000:2000].tolist())) >= 9
    assert blocks.of(users[1234:1300]).tolist() == block[1234:1300].tolist()


@pytest.mark.parametrize(("items", "kind"), [(9, "string"), (4000, "long")])
def test_pairs_are_counted_without_rows_of_them(spark, items, kind):
    r = random.Random(11)
    rows = [(1000 + u, r.randrange(items)) for u in range(90) for _ in range(r.randrange(1, 7))]
    watches = spark.createDataFrame(rows, "user_id long, item long").select(F.col("user_id").cast(kind).alias("user_id"), "item")
    sets = {u: {i for v, i in rows if v == u} for u, _ in rows}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    for got, t in ((similarity.exact_pairs(watches), 0), (similarity.pairs_at_least(watches, 0.2), 0.2)):
        found = got.collect()
        assert {(int(x.u), int(x.v)): x.similarity for x in found} == {p: s for p, s in share.items() if s >= t} and len(found) == len({(x.u, x.v) for x in found})
        assert kind == "string" or "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_blocks_do_not_grow_with_the_input():
    """6, 60 and 360 copies of the 0.1 tables have 18 million places each: a block of many copies has no more than one of few."""
    a_block = []
    for copies in (6, 60, 360):
        blocks = neighbours.Blocks(np.full(neighbours.CELLS, copies * 18e6 / neighbours.CELLS), 0, copies * 15_000, 12)
        a_block.append(copies * 18e6 / blocks.n)
    assert max(a_block) < 1.1 * a_block[0]


def test_histories_come_while_rows_are_read():
    """A task's rows come in order and leave in pieces, each with all items of its users; only a piece is held."""
    taken, most, given = 0, 0, []
    users = np.repeat(np.arange(60_000), 20)
    items = np.tile(np.repeat(np.arange(10), 2), 60_000)  # every row twice

    def batches():
        nonlocal taken
        for a in range(0, len(users), 7_777):
            taken = a
            yield pa.RecordBatch.from_arrays([pa.array(users[a : a + 7_777]), pa.array(items[a : a + 7_777])], names=["user_id", "item"])

    done = 0
    for batch in neighbours.histories(batches()):
        own, counts, held = neighbours.unpack_lists(batch.column("body")[0].as_buffer())
        given += own.tolist()
        assert set(counts.tolist()) == {10} and held.tolist() == list(range(10)) * len(own)
        done += 20 * len(own)
        most = max(most, taken - done)
    assert given == list(range(60_000)) and most < neighbours.BODY
    assert list(neighbours.histories(iter([]))) == []


def crowd(spark, users: int, items: int):
    """user_id, item: users with 12 places each at items that all know."""
    return spark.range(12 * users).select((F.col("id") % users).alias("user_id"), F.pmod(F.xxhash64("id"), F.lit(items)).alias("item"))


def sets_of(watches, users: int, items: int) -> np.ndarray:
    has = np.zeros((users, items), np.float32)
    for batch in watches.toArrow().to_batches():
        has[batch.column("user_id").to_numpy(), batch.column("item").to_numpy()] = 1
    return has


def test_lists_of_all_users_go_to_few_tiles(spark):
    """20,000 users and 100 items: each list concerns all users; with a copy of all lists for each block 26 MB were shuffled."""
    watches, context = crowd(spark, 20_000, 100), spark.sparkContext
    context.setJobGroup("tiles", "")
    found = similarity.pairs_at_least(watches, 0.4).agg(F.count("*"), F.sum("similarity"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u", "v")).collect()[0]
    context.setLocalProperty("spark.jobGroup.id", None)
    has = sets_of(watches, 20_000, 100)
    size, pairs, total = has.sum(1), 0, 0.0
    for a in range(0, 20_000, 500):
        both = (has[a : a + 500] @ has.T).astype(np.float64)
        share = both / (size[a : a + 500, None] + size[None] - both)
        share = share[(share >= 0.4) & (np.arange(a, a + 500)[:, None] < np.arange(20_000)[None])]
        pairs, total = pairs + len(share), total + share.sum()
    assert found[0] == found[3] == pairs > 1000 and abs(found[1] - total) < 1e-6
    shuffled, seen = 0, context.statusTracker()
    for stage in {s for j in seen.getJobIdsForGroup("tiles") for s in seen.getJobInfo(j).stageIds}:
        try:
            shuffled += context._jsc.sc().statusStore().lastStageAttempt(stage).shuffleWriteBytes()
        except Py4JJavaError:  # skipped
            continue
    assert 0 < shuffled < 15_000_000


@pytest.mark.parametrize(("users", "items", "threshold", "rare"), [(90, 20, 0.2, 16), (90, 20, 0.0, 16), (300, 3000, 0.0, 16), (300, 3000, 0.05, 16), (300, 3000, 0.0, 1 << 20), (90, 20, 0.3, 1), (90, 20, 1.0, 16), (300, 300, 0.1, 4)])
def test_tiles_equal_all_pairs(monkeypatch, users, items, threshold, rare):
    """By products, by rare lists added to them, and by lists alone; with groups that are ranges and groups cut by a hash."""
    rnd = random.Random(4)
    sets = {u * 3 - 50: {min(int(items * rnd.random() ** 2), items - 1) for _ in range(rnd.randint(1, 12))} for u in range(users)}
    lists = [x for x in (sorted(u for u in sets if i in sets[u]) for i in range(items)) if len(x) > 1]
    flat, counts = np.array([u for x in lists for u in x]), np.array([len(x) for x in lists])
    body = neighbours.rows(body=[neighbours.pack_lists(np.zeros(len(lists)), counts, flat, np.array([len(sets[u]) for u in flat.tolist()]))])
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    monkeypatch.setattr(neighbours, "RARE", rare)
    for side, lo in ((1 << 19, -50), (100, -50), (100, -(1 << 40))):
        monkeypatch.setattr(neighbours, "SIDE", side)
        cells = neighbours.cells_of(flat, lo, 3 * users)
        tiles = neighbours.Tiles(np.bincount(cells, np.repeat(counts, counts), neighbours.CELLS), np.bincount(cells, minlength=neighbours.CELLS), lo, 3 * users, 1)
        assert (tiles.n > 1) == (side == 100)
        there = defaultdict(list)
        for r in tiles.lists_for(iter([body, body.slice(0, 0)])):
            there[r.column("to")[0].as_py()].append(r)
        found = [x for to in there for batch in neighbours.pairs_in_tiles(tiles, threshold)(iter(there[to])) for x in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "similarity")), strict=True)]
        assert {(u, v): s for u, v, s in found} == {p: s for p, s in want.items() if s >= threshold} and len(found) == len({x[:2] for x in found})


def test_copies_of_long_lists_do_not_grow_with_their_length():
    """100 items that all users know, 6.7 million places at 360 times: a place goes to few tiles, and a tile has few places."""
    for copies in (6, 60, 360):
        places = np.full(neighbours.CELLS, copies * 18_500 / neighbours.CELLS)
        tiles = neighbours.layout(places * copies * 185, places, 0, copies * 1500, 12)
        assert isinstance(tiles, neighbours.Tiles) and tiles.groups.n <= 25 and places.sum() / tiles.groups.n < 1.2 * neighbours.SIDE
    short = np.full(neighbours.CELLS, 36e6 / neighbours.CELLS)
    assert isinstance(neighbours.layout(short * 30, short, 0, 600_000, 12), neighbours.Blocks)
