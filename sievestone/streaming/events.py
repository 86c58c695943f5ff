"""Streams of events: novelty, windows with late data, bounded session state, append-only sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RECENT = 16


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def novel_routes(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """The first event of every route (user and type). A horizon bounds the state; without one every route is kept, as a seen-set must."""
    if horizon:
        return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return events.dropDuplicates(["user_id", "event_type"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per type and window; events later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def _remember(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A key's events come in several frames, in no order over frames; only what can end the sorted whole is held between them."""
    types, stalls, last = state.get if state.exists else ("", 0, "")
    recent = [x for x in types.split(",") if x]
    n, run, tail = 0, 0, None
    for pdf in parts:
        if len(pdf):
            n += len(pdf)
            held = pdf[["ts", "event_id", "event_type"]]
            tail = (held if tail is None else pd.concat([tail, held])).sort_values(["ts", "event_id"])
            other = (tail["event_type"] != tail["event_type"].iloc[-1]).to_numpy().nonzero()[0]
            run = len(tail) - 1 - other[-1] if len(other) else len(tail)
            tail = tail.iloc[-max(run + 1, MOST_RECENT) :]  # the event before the run too: it bounds what later frames can add
    if n:
        kind = tail["event_type"].iloc[-1]
        stalls = int(stalls + run if run == n and kind == last else run - 1)
        last, recent = kind, (recent + tail["event_type"].tolist())[-MOST_RECENT:]
    state.update((",".join(recent), stalls, last))
    yield pd.DataFrame({"user_id": [key[0]], "recent": [",".join(recent)], "stalls": [stalls], "n": [n]})


def bounded_sessions(events: DataFrame) -> DataFrame:
    """Per user and batch: the last sixteen types and how often the last one repeated. The state per user is bounded."""
    return events.groupBy("user_id").applyInPandasWithState(_remember, "user_id long, recent string, stalls long, n long", "types string, stalls long, last string", "update", "NoTimeout")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run all available input into a Parquet table (exactly once by the checkpoint) and read it."""
    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
