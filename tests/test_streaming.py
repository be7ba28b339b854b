from __future__ import annotations

from pyspark.sql import functions as F

from rillmark.operators import frequency
from rillmark.sources import events as src
from rillmark.sources import generator
from rillmark.streaming import jobs


def test_stream_equals_batch(spark, sf_dir):
    stream = jobs.run_to_table(jobs.item_counts(jobs.event_stream(spark, sf_dir)), "complete", "items")
    batch = frequency.exact(src.activity(spark, sf_dir), "item")
    assert stream.exceptAll(batch).count() == 0 and stream.count() == batch.count()


def test_windows_that_are_open_are_not_out(spark, sf_dir):
    closed = jobs.run_to_table(jobs.window_counts(jobs.event_stream(spark, sf_dir), "1 hour"), "append", "windows")
    everything = src.activity(spark, sf_dir)
    assert 0 < closed.agg(F.sum("cnt")).collect()[0][0] < everything.count()


def test_priority_batches_and_metrics(spark, sf_dir):
    seen = []
    query = jobs.by_priority(jobs.event_stream(spark, sf_dir), lambda df, n: seen.extend(r.priority for r in df.collect()))
    query.processAllAvailable()
    told = jobs.metrics(query)
    query.stop()
    assert seen == sorted(seen) and len(seen) == src.activity(spark, sf_dir).count()
    assert told["active"] and "latency_ms" in told


def test_sliding(spark, sf_dir):
    out = jobs.run_to_table(jobs.sliding_counts(jobs.event_stream(spark, sf_dir), "2 hours", "1 hour"), "complete", "slides")
    assert out.agg(F.sum("cnt")).collect()[0][0] == 2 * src.activity(spark, sf_dir).count()


def test_flag_callback(spark, sf_dir):
    seen = []
    query = jobs.on_flagged(jobs.event_stream(spark, sf_dir), 40, lambda df, n: seen.extend(df.collect()))
    query.processAllAvailable()
    query.stop()
    assert seen and all(r.addresses >= 40 for r in seen)


def test_generated_stream_has_the_wire_columns(spark):
    assert {c.split()[0] for c in src.WIRE_SCHEMA.split(", ")} <= set(generator.event_stream(spark, 10, burst=5).columns)


def test_dashboard():
    text = jobs.dashboard({"events": 5}, [("play", 3)], [("video_1", 2)])
    assert "0.0%" in text and "1. video_1" in text
