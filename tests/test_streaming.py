"""Streams end where the batch forms say."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspan.operators import state
from leafspan.plans import inputs
from leafspan.streaming import reading

SF = "/root/testdata/sf0.001"


def test_reading_state_equals_the_batch_fold(spark, tmp_path):
    streamed = reading.read_status_stream(spark, SF, f"file://{tmp_path}/s")
    calls = inputs.tool_calls(spark, SF).filter("tool = 'view'")
    batch = state.read_pages(calls).select("session_id", "n_pages", "total_reads")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Two files, two runs: state is kept in between, and no file is read twice."""
    calls = spark.read.parquet(f"{SF}/events.parquet")
    folder = f"{tmp_path}/in/events.parquet"
    calls.filter("event_id % 2 = 0").coalesce(1).write.parquet(folder)
    reading.read_status_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/s")
    calls.filter("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(folder)
    both = reading.read_status_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/s")
    whole = state.read_pages(inputs.tool_calls(spark, SF).filter("tool = 'view'")).select("session_id", "n_pages", "total_reads")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))


def test_windows_in_batches(spark, tmp_path):
    days = reading.daily_tools_stream(spark, SF, f"file://{tmp_path}/d")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd 00:00:00").alias("day")).count()
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, batch.collect()))


def test_progress_of_two_runs_is_streamed_once(spark, tmp_path):
    """Events of a run, of a second one while the stream is down, and of one that is told twice."""
    from leafspan.operators import ingest

    pages = spark.createDataFrame([(d, p, f"page {p} of {d}") for d in (1, 2) for p in (1, 2)], "doc long, page long, text string")
    path, seen = f"file://{tmp_path}/library", []

    def drain():
        keep = lambda rows, _: seen.extend((r["run"], r["seq"], r["step"], r["state"], r["batch"]) for r in rows.collect())
        query = reading.progress(spark, path).writeStream.option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()

    first = ingest.ingest(pages.filter("doc = 1"), path)
    drain()
    assert sorted(e[1:] for e in seen) == [(2 * k + n + 1, step, state, 1) for k, step in enumerate(ingest.STEPS) for n, state in enumerate(("start", "built"))]
    second = ingest.ingest(pages, path)
    first.told -= 1
    first.tell("registry", "built", 1)  # told again, as after a retry
    drain()
    assert len(seen) == len(set(seen)) == 16 and {e[0] for e in seen} == {first.run, second.run}
    assert {r["doc"]: r["batch"] for r in second.batches("index").collect()} == {1: 1, 2: 2}
    second.table("pages").sparkSession.createDataFrame([(1, 9, "lost", 0, "broken off")], "doc long, page long, text string, bucket int, build string").write.mode("append").parquet(f"{path}/pages")
    assert second.table("pages").count() == 4  # rows of a build that was never noted do not count
