"""Reading state and counts over streams of tool calls.

The batch forms in ``operators.state`` say what the results are; these keep them
up to date. State is keyed by session; order within a micro-batch is by event
time and id. Late events beyond the watermark are left out of window counts, never of reading state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "365 days"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, a file at a time. The name is a pattern, since a stream's path is a folder or a pattern; no other table's files are read."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Reads per page of one session: state maps a page to its number of reads."""
    pages, counts = state.get if state.exists else ([], [])
    reads = dict(zip(pages, counts, strict=True))
    for rows in batches:
        for page, n in rows["page"].dropna().value_counts().items():
            reads[int(page)] = reads.get(int(page), 0) + int(n)
    state.update((list(reads), list(reads.values())))
    yield pd.DataFrame({"session_id": [key[0]], "n_pages": [len(reads)], "total_reads": [sum(reads.values())]})


def reading_state(calls: DataFrame) -> DataFrame:
    """(session_id, n_pages, total_reads) after each micro-batch, for streams or batches of content calls (session_id, page).

    A call without a page reads nothing; a session of such calls alone has a row of zeros.
    """
    return calls.groupBy("session_id").applyInPandasWithState(
        _advance,
        "session_id long, n_pages long, total_reads long",
        "pages array<long>, reads array<long>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def _drained(stream: DataFrame, path: str, mode: str, keep) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()


def read_status_stream(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Runs the reading state over all events there are and returns each session's last row."""
    calls = events_stream(spark, sf_dir).where("event_type = 'view'").select(
        F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("long").alias("page")
    )

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/states")

    _drained(reading_state(calls), path, "update", keep)
    states = spark.read.schema("session_id long, n_pages long, total_reads long, batch long").parquet(f"{path}/states")
    last = states.groupBy("session_id").agg(F.max_by(F.struct("n_pages", "total_reads"), "batch").alias("s"))
    return last.select("session_id", "s.*")


def daily_tools_stream(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """(event_type, day, n): calls per tool and day, kept by a windowed aggregation with a watermark."""
    rows = events_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", WATERMARK)
    counts = rows.groupBy("event_type", F.window("at", "1 day").alias("w")).count()
    out = counts.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("day"), F.col("count").alias("n"))

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/days")

    _drained(out, path, "update", keep)
    states = spark.read.schema("event_type string, day string, n long, batch long").parquet(f"{path}/days")
    return states.groupBy("event_type", "day").agg(F.max_by("n", "batch").alias("n"))


def progress(spark: SparkSession, library: str) -> DataFrame:
    """A library's events (ingest.EVENT) as a stream, each once, also where a writer has told one twice; those later than a day are not told apart."""
    from leafspan.operators.ingest import EVENT

    rows = spark.readStream.schema(EVENT).parquet(f"{library}/events")
    return rows.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["run", "seq"])
