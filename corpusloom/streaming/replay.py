"""Tables played as streams, and the liveness of runs as a stream with timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import drop_path, materialize, shared_dir
from corpusloom.streaming.telemetry import results_sink


def replay(rows: DataFrame, at: Column, cuts: list, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives that meets rows in slices: up to the first cut of `at`, up to the second, ..., and the rest.

    Every slice is appended to one folder and the stream started again on its checkpoint, so state and watermark go on
    from slice to slice. Rows whose `at` is null come with the last slice. The result is a written table.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/corpusloom/replay-{uuid4().hex}"
    for k in range(len(cuts) + 1):
        part = rows.filter(_slice(at, cuts, k))
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        results_sink(build(stream), f"{base}/out", f"{base}/checkpoint").start().awaitTermination()
    out = materialize(spark.read.parquet(f"{base}/out"), "replayed")
    folder = spark.createDataFrame([], "x int")
    folder._corpusloom_path = base
    drop_path(folder)
    return out


def _slice(at: Column, cuts: list, k: int) -> Column:
    low = F.lit(True) if k == 0 else at > F.lit(cuts[k - 1])
    high = F.lit(True) if k == len(cuts) else at <= F.lit(cuts[k])
    return (low & high) | at.isNull() if k == len(cuts) else low & high


VERDICT = "run string, last bigint, clock bigint, rows bigint, state string"
#: Groups of runs that keep their state together: Python is called once for each in a batch, not once for each run.
BUCKETS = 512


def liveness_stream(rows: DataFrame, limit: float, run: str = "run", ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """`alive` for each run in each batch that has rows of it, `stale` once its last row is over `limit` seconds old.

    The clock is the watermark. The state of a bucket of runs holds each run's last row, its timer is due with the first of
    them and fires without a new row; a new row makes a run alive again and sets the timer anew. Rows later than the watermark
    are dropped, rows without run or time are not looked at.
    """

    def verdict(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        clock = state.getCurrentWatermarkMs()
        due = lambda last: -(-last // 1000) + int(limit * 1000)
        held = {r: (last, stale) for r, last, stale in zip(*state.get, strict=True)} if state.exists else {}
        seen: dict[str, tuple[int, int]] = {}
        for b in () if state.hasTimedOut else batches:
            g = b.groupby("run")["at"].agg(["max", "size"])
            for r, last, n in zip(g.index.tolist(), g["max"].tolist(), g["size"].tolist(), strict=True):
                old = seen.get(r, (last, 0))
                seen[r] = (max(old[0], last), old[1] + n)
        out = []
        for r, (last, n) in seen.items():
            held[r] = (max(last, held[r][0]) if r in held else last, False)
            out.append((r, held[r][0], clock, n, "alive"))
        for r, (last, stale) in held.items():
            if not stale and (due(last) < clock or r in seen and due(last) == clock):  # seen: late, but kept
                held[r] = (last, True)
                out.append((r, last, clock, 0, "stale"))
        state.update((list(held), [x[0] for x in held.values()], [x[1] for x in held.values()]))
        waiting = [due(last) for last, stale in held.values() if not stale]
        if waiting:
            state.setTimeoutTimestamp(min(waiting))
        if out:
            yield pd.DataFrame(out, columns=["run", "last", "clock", "rows", "state"])

    seen = rows.filter(F.col(run).isNotNull() & F.col(ts).isNotNull()).select(F.col(run).cast("string").alias("run"), F.col(ts).cast("timestamp").alias("ts"))
    timed = seen.withWatermark("ts", late).withColumn("at", F.unix_micros("ts")).withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(BUCKETS)))
    held = "runs array<string>, last array<bigint>, stale array<boolean>"
    told = timed.groupBy("bucket").applyInPandasWithState(verdict, VERDICT, held, "append", "EventTimeTimeout")
    return told.select("run", F.timestamp_micros("last").alias("last"), F.timestamp_millis("clock").alias("clock"), "rows", "state")
