"""Properties of queries over whole tables, beside their SQL."""

from __future__ import annotations

from rillmark.plans.queries import queries

Q = queries()


def test_sized_bloom_filter_knows_all_buyers(spark):
    d = "/root/testdata/sf0.1"
    buyers = {r[0] for r in spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'").select("user_id").distinct().collect()}
    maybe = {r.user_id for r in Q["bloom_membership"](spark, d).collect() if r.maybe}
    assert buyers <= maybe
    false = Q["bloom_false_positives"](spark, d).collect()[0]
    assert false.probes > 0 and false.false_positives < 0.03 * false.probes
    assert 0.3 < Q["bloom_fill_ratio"](spark, d).collect()[0].fill_ratio < 0.6
    print(len(buyers), false)


def test_sized_count_min_sketch(spark):
    rows = Q["cms_error"](spark, "/root/testdata/sf0.1").collect()
    assert all(0 <= r.estimate - r.cnt <= 0.001 * sum(x.cnt for x in rows) for r in rows)


def test_lookup_and_deletion_take_the_whole_table(spark, sf_dir):
    names = {(r.p_name, r.p_size) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    found = {r.word: r.freq for r in Q["term_lookup"](spark, sf_dir).collect()}
    assert all(found[n] > 0 and found[n.upper()] == found[n] and found[n + " "] == 0 for n, _ in names)
    gone = {n.lower() for n, size in names if size >= 50}
    left = {r.term for r in Q["trie_delete"](spark, sf_dir).collect()}
    assert gone and left == {n.lower() for n, _ in names} - gone
