"""Vector codes, periodic runs and exact search against plain versions, SQL and odd rows."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import exact_search, queries, runs, vector_codes

from .brute import sha

NEW = ["op11_vector_codes", "op12_periodic_runs", "op13_exact_search"]


@pytest.mark.parametrize("name", NEW)
def test_equals_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want, key=repr)


# ---- vectors -------------------------------------------------------------------------------


def usable(rows):
    """Ids, whole numbers of finite vectors of the length of the least id, and labels, by id and vector."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    return sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def plain_codes(rows, parts, entries, rounds):
    rows = [r for r in usable(rows) if len(r[1]) % parts == 0]
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    whole = [[math.floor(256 * x) for x in r[1]] for r in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, now, strict=True) if a[p][1] == i]
                if mine:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((r[0], "".join(f"{i:02x}" for _, i in a), sum(d for d, _ in a)) for r, a in zip(rows, found, strict=True)), key=repr), sha(text)


def odd_vectors(spark, n=60, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-0.5, -0.01, 0.0, 0.25, rnd.gauss(0, 0.2)]) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(n)]
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[5][1], None), (n + 1, None, 1), (n + 2, [None] * 8, 1), (n + 3, [], 2)]
    rows += [(n + 4, [float("nan")] * 8, 1), (n + 5, [float("inf")] + [0.0] * 7, 1), (n + 6, [0.5] * 16, 1), (n + 7, [0.5] * 3, 1), (-4, [0.0] * 8, None)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, id string")


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 7, 2), (1, 200, 1), (8, 3, 3), (2, 16, 0)])
def test_codes_equal_plain_ones(spark, parts, entries, rounds):
    rows, df = odd_vectors(spark)
    books = vector_codes.train(df, parts=parts, entries=entries, rounds=rounds)
    coded = vector_codes.encode(df, books)
    got = sorted(((r.vec_id, r.code.hex(), r.error) for r in coded.collect()), key=repr)
    assert (got, books.digest()) == plain_codes(rows, parts, entries, rounds)
    back = vector_codes.decode(coded, books).where("vec_id = 7").collect()[0]
    whole = [math.floor(256 * x) for x in rows[7][1]]
    assert sum((a - b) ** 2 for a, b in zip(whole, back.approximate, strict=True)) == back.error


def test_nearest_entry_of_many_dimensions():
    r = np.random.default_rng(3)
    x, book = r.integers(-9, 9, (500, 6)), r.integers(-9, 9, (70, 6))
    book[33] = book[2]
    index, best = vector_codes.nearest(x, book)
    all_ = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (index == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all()


def test_sums_of_groups_often_and_seldom(spark):
    rows = [(i, None if i % 3 == 0 else i if i % 3 == 1 else -1, i) for i in range(6000)]
    got = vector_codes.with_group_sum(spark.createDataFrame(rows, "id int, g int, v long"), "g", "v", "s").collect()
    total = {}
    for _, g, v in rows:
        total[g] = total.get(g, 0) + v
    assert len(got) == 6000 and all(r.s == total[r.g] for r in got)


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.train(none) is None and vector_codes.encode(none, None).count() == 0
    assert exact_search.search(none, F.col("id") >= 0).count() == 0
    with pytest.raises(Exception, match="no exact sums"):
        vector_codes.train(spark.createDataFrame([(1, [1e30] * 16)], "vec_id long, embedding array<double>"))


def plain_search(rows, asked, k):
    rows = usable(rows)
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if len(v) == len(rows[0][1])]
    out = []
    for q in sorted({i for i, _ in rows if i is not None and asked(i)}):
        own = next(v for i, v in rows if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i is None, i or 0) for i, v in rows if i != q)
        out += [(q, n, None if null else i, -s) for n, (s, null, i) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("k", [1, 5, 500])
def test_search_equals_plain_one(spark, k, monkeypatch):
    rows, df = odd_vectors(spark, 90, k)
    monkeypatch.setattr(exact_search, "QUERY_BYTES", 8 * 8 * 7)  # several blocks
    got = exact_search.search(df.repartition(3), F.col("id") % 3 == 0, k).collect()
    assert sorted(tuple(r) for r in got) == [r for r in plain_search(rows, lambda i: i % 3 == 0, k)] or k == 500
    assert sorted((r.query_id, r.rank, r.score) for r in got) == [(q, n, s) for q, n, _, s in plain_search(rows, lambda i: i % 3 == 0, k)]


def test_shards_give_all_that_is_competitive():
    r = np.random.default_rng(5)
    for low, high in ((-20, 20), (-20, -3), (0, 2), (-1, 1)):
        rows, query = r.integers(low, high, (400, 12)), r.integers(-9, 9, 12)
        rows[7] = 0
        shard, scores = exact_search.Shard(np.arange(400), np.zeros(400, bool), rows), rows @ query
        for least in (None, int(scores.min()) - 1, -5, 0, 1, int(np.sort(scores)[-5]), int(scores.max()), int(scores.max()) + 1):
            at, found = shard.competitive(query, least)
            assert at.tolist() == [i for i, s in enumerate(scores.tolist()) if least is None or s >= least]
            assert (found == scores[at]).all()


# ---- runs ----------------------------------------------------------------------------------


def plain_runs(words, exponent, least):
    """Every period by itself: stretches of places that equal the one a period before."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(rnd):
    texts = []
    for _ in range(rnd.randint(1, 6)):
        w = [rnd.randrange(rnd.randint(1, 4)) for _ in range(rnd.randint(0, 50))]
        while w and rnd.random() < 0.7:
            a = rnd.randrange(len(w))
            b = rnd.randint(a, min(len(w), a + 8))
            w = w[:a] + w[a:b] * rnd.randint(1, 6) + w[b:]
            if w and rnd.random() < 0.4:
                a = rnd.randrange(len(w))
                w = w + [9] * rnd.randint(0, 1) + w[a : rnd.randint(a, len(w))]
        texts.append(w[:300])
    return texts


def test_runs_equal_plain_ones(monkeypatch):
    rnd = random.Random(2)
    for _ in range(400):
        texts = periodic_texts(rnd)
        exponent, least = rnd.choice([2, 3, 4]), rnd.choice([2, 4, 6, 9])
        monkeypatch.setattr(runs, "JUMPS", rnd.choice([0, 1, 40]))
        got = runs.runs_of(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]), exponent, least)
        assert got == {d: r for d, t in enumerate(texts) if (r := plain_runs(t, exponent, least))}, (exponent, least, texts)


def test_runs_of_long_texts():
    words = np.array([1, 2, 3] * 40_000 + [7] + [1, 2, 3] * 5_000 + list(range(10, 400)), np.int64)
    assert runs.runs_of(words, np.array([len(words)])) == {0: [(0, 120_000, 3), (120_001, 15_000, 3)]}
    one = np.zeros(200_000, np.int64)
    assert runs.runs_of(one, np.array([150_000, 0, 50_000])) == {0: [(0, 150_000, 1)], 2: [(0, 50_000, 1)]}


def test_runs_of_odd_rows(spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "a a a a a a", 5: "a a a a a", 6: "x a\u00a0b c a\u00a0b c a\u00a0b c a\u00a0b c a\u00a0b y", 7: "Ab ab " * 9}
    df = spark.createDataFrame([(d, t, "r") for d, t in [*texts.items(), (4, texts[4]), (None, "b b b b b b b")]], "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text) for r in runs.find_runs(df).collect()), key=repr)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 6, [(0, 6, 1)], "a"), (4, 6, [(0, 6, 1)], "a"), (5, 5, [], "a a a a a")]
    want += [(6, 11, [(1, 9, 2)], "x a\u00a0b c y"), (7, 18, [(0, 18, 2)], "Ab ab"), (None, 7, [(0, 7, 1)], "b")]
    assert got == sorted(want, key=repr)
    assert runs.find_runs(df.where("doc_id > 99")).count() == 0
    assert spark.createDataFrame([([(0, 9, 2), (1, 18, 4), (3, 10, 2), (4, 5, 1)],)], f"r array<{runs.RUN}>").select(runs.highest(F.col("r")).alias("b")).collect()[0].b == (3, 10, 2)
