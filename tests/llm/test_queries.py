from __future__ import annotations

import re

import duckdb

import corpus_pipeline
from rillmark.llm import queries as q

from . import brute


def test_chat_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = con.sql(f"select {', '.join(cols)} from ({q.oracle_sql()['op10_chat_formatting']})").fetchall()
    got = q.queries()["op10_chat_formatting"](spark, sf_dir).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_operator_has_one_query():
    names = [int(re.match(r"op(\d+)_", n)[1]) for n in q.queries()]
    assert sorted(names) == list(range(1, 14))


def test_queries_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    run = lambda name: {r[0]: tuple(r)[1:] for r in q.queries()[name](spark, sf_dir).collect()}
    assert {d: x[:2] for d, x in run("op1_ngram_jaccard").items()} == brute.components(docs)
    assert run("op2_suffix_dedup") == brute.cut(docs)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {d: (n, h, len(i), brute.sha(",".join(i)), h > 0 and 20 * h >= n) for d, (n, h, i) in brute.contaminated(docs, items).items()}
    assert run("op3_decontamination") == want
    out = run("op4_html_extraction")
    assert all(len(text) == n for _, text, n in out.values()) and all(text for _, text, _ in out.values())
    sizes = [0] * 24
    for _, _, law, shard, _, grown in run("op8_sharding").values():
        sizes[shard] += 1
        assert law == "rows" and grown is None
    assert max(sizes) - min(sizes) <= 1


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    seen = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "test-stage")
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r[0] for r in docs.select("doc_id").collect()}
        if k == 1:
            want = brute.components(list(before.items()))
            assert after == {c for _, c in want.values()}
        if k == 2:
            cut = brute.cut(list(before.items()))
            whole = {r.doc_id: brute.sha(r.text) for r in docs.collect()}
            assert all(whole[d] == x[3] for d, x in cut.items() if x[1] == 0)
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0] and len(text) == seen[0]
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[-1]


def test_stages_on_odd_rows(spark, sf_dir):
    """Null in any column, empty texts, repeats, an empty table, and columns that clash with inner names."""
    say = "the and of to in that is was for with as on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so"
    rows = [(i, f"{say} number {i} {say[i:]}", "en", "s", 9) for i in range(12)]
    rows += [rows[0], rows[0], (None, rows[3][1], "en", "s", 9), (None, None, None, None, None), (50, None, "en", "s", 0), (51, "", None, "s", 0), (52, " \n", "fr", None, 2), (50, None, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(*x, 1, 2, "k") for x in rows], schema + ", id int, key int, t string")
    none = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.collect()
        assert stage(spark, none, sf_dir).count() == 0
    near = corpus_pipeline.near_duplicates(spark, odd, sf_dir).collect()
    ids = [r.doc_id for r in near if r.text and r.text.strip()]
    assert None not in ids and len(ids) == len(set(ids)) and 0 in ids
    assert {(r.doc_id, r.text) for r in near if not (r.text or "").strip()} == {(None, None), (50, None), (51, ""), (52, " \n")}
    assert corpus_pipeline.repeated_passages(spark, odd, sf_dir).count() == len(rows)
    assert corpus_pipeline.benchmark_passages(spark, odd, sf_dir).count() == len(rows)
    assert corpus_pipeline.token_ids(spark, odd, sf_dir).count() == len(rows)
    assert all((r.text or "").strip() for r in corpus_pipeline.quality_rules(spark, odd, sf_dir).collect())


def test_queries_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name in ("op1_ngram_jaccard", "op2_suffix_dedup", "op3_decontamination"):
        df = q.queries()[name](spark, sf_dir)
        want = con.sql(f"select {', '.join(sorted(df.columns))} from ({q.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(want)
