"""Run telemetry as streams: tolerant JSON file source, minute buckets, gap sessions, explicit-start segments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.telemetry import GAP_SECONDS

EVENT = "run STRING, event STRING, time STRING, pos BIGINT, step BIGINT, tokens BIGINT, speed DOUBLE"


def log_stream(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    """Rows of an append-only log folder; lines that do not parse have `_corrupt` set and no time."""
    r = spark.readStream.schema(f"{schema}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt")
    return r.json(folder).withColumn("ts", F.try_to_timestamp("time"))


def minute_buckets(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Mean speed and last step and tokens by position, per run and minute of train rows."""
    rows = events.filter("event = 'train' AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    g = rows.groupBy("run", F.window("ts", "1 minute"))
    return g.agg(F.avg("speed").alias("speed"), F.max_by("step", "pos").alias("step"), F.max_by("tokens", "pos").alias("tokens")).select("run", F.col("window.start").alias("minute"), "speed", "step", "tokens")


def gap_sessions(events: DataFrame, gap: str = f"{GAP_SECONDS} seconds", late: str = "10 minutes") -> DataFrame:
    """T3, by pauses alone: count and span of each session of train rows."""
    rows = events.filter("event = 'train' AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy("run", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("run", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


STATE = "session bigint, segment bigint, last double, after boolean"
SEGMENTED = "run string, pos bigint, event string, ts double, session bigint, segment bigint"


def segments_stream(events: DataFrame) -> DataFrame:
    """T3/T4 with explicit starts: each row with its session and segment, by state kept for each run.

    Rows of a run are taken in the order of pos within a batch; counters and clocks may go back and are never clipped.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        session, segment, last, after = state.get if state.exists else (0, 0, float("nan"), False)
        rows = pd.concat(list(batches)).sort_values("pos")
        out = []
        for r in rows.itertuples(index=False):
            start = r.event == "start"
            if start:
                session, last = session + 1, float("nan")
            if start or after or (r.event == "train" and r.ts - last > GAP_SECONDS):
                segment += 1
            if r.event == "train":
                last = r.ts
            after = r.event == "finished"
            out.append((key[0], r.pos, r.event, r.ts, session, segment))
        state.update((session, segment, last, after))
        yield pd.DataFrame(out, columns=["run", "pos", "event", "ts", "session", "segment"])

    rows = events.filter("ts IS NOT NULL").select("run", "pos", "event", F.col("ts").cast("double").alias("ts"))
    return rows.groupBy("run").applyInPandasWithState(run, SEGMENTED, STATE, "append", "NoTimeout")


def incomplete_lines(batch: DataFrame) -> int:
    """Lines of a batch that did not parse."""
    return batch.filter("_corrupt IS NOT NULL").count()


def results_sink(df: DataFrame, path: str, checkpoint: str, seconds: int | None = None):
    """Durable result rows, one Parquet batch at a time, exactly once by the checkpoint.

    With `seconds` the source is polled at that interval (15 for samples, 60 for a flush), else what there is now is read
    and the query ends. A query started again with the same checkpoint goes on after the last complete batch, with the
    state of its runs.
    """
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)
