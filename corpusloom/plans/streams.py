"""Queries of streams: tables played in slices of their arrival, with watermarks, late rows, state and timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import table
from corpusloom.streaming import replay as R
from corpusloom.streaming import telemetry as S

#: Slices that a table is played in.
SLICES = 4
LATE_HOURS, GAP_MINUTES, LIMIT_HOURS = 2, 30, 6


def _cuts(rows: DataFrame, at: str) -> list:
    """Equal parts of the time that a table spans."""
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    return [] if ends["low"] is None else [ends["low"] + (ends["high"] - ends["low"]) * k / SLICES for k in range(1, SLICES)]


def _clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as a log of runs: a client is a run, a click a train row; the number of a click is its place and step."""
    d = table(spark, sf, "clicks")
    return d.select(F.col("client_id").cast("string").alias("run"), F.lit("train").alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("click_id").alias("pos"), F.col("click_id").alias("step"), F.col("click_id").alias("tokens"), F.col("value").alias("speed"), F.col("arrived_at").cast("timestamp").alias("arrived_at"))


def clicks_by_minute(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes of clients, closed by a watermark; clicks that arrive after their minute was closed are dropped."""
    d = _clicks(spark, sf)
    out = R.replay(d, F.col("arrived_at"), _cuts(d, "arrived_at"), lambda s: S.minute_buckets(s, f"{LATE_HOURS} hours"))
    return out.select("run", F.col("minute").cast("timestamp_ntz").alias("minute"), F.round("speed", 6).alias("speed"), "step", "tokens")


def clicks_in_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of clients by pauses, closed by a watermark, with the late rule."""
    d = _clicks(spark, sf)
    out = R.replay(d, F.col("arrived_at"), _cuts(d, "arrived_at"), lambda s: S.gap_sessions(s, f"{GAP_MINUTES} minutes", f"{LATE_HOURS} hours"))
    return out.select("run", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def users_alive_and_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Users of the events turn alive with their rows and stale by a timer, at the clock of each slice."""
    d = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run"), F.col("ts").cast("timestamp").alias("ts"))
    out = R.replay(d, F.col("ts"), _cuts(d, "ts"), lambda s: R.liveness_stream(s, LIMIT_HOURS * 3600))
    return out.select("run", F.col("last").cast("timestamp_ntz").alias("last"), "rows", "state")


def users_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions and segments of users by explicit starts, ends and pauses, with state that goes on from
    slice to slice; a sign-up starts a session, an error ends a segment."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "finished").otherwise("train")
    d = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run"), kind.alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("pos"))
    out = R.replay(d, F.col("pos"), [int(x) for x in _cuts(d, "pos")], S.segments_stream)
    return out.select("run", "pos", "session", "segment")


def _sliced(source: str, at: str) -> str:
    """CTEs: c, the rows with the number k of their slice (a null time in the last one); w, the watermark after each slice."""
    return f"""e AS (SELECT min({at}) AS low, max({at}) AS high FROM s0),
c AS (SELECT s0.*, CASE {" ".join(f"WHEN {at} <= low + to_microseconds((epoch_us(high) - epoch_us(low)) * {k} // {SLICES}) THEN {k}" for k in range(1, SLICES))} ELSE {SLICES} END AS k FROM s0, e)"""


_CLICKS = f"""s0 AS (SELECT client_id::VARCHAR AS run, ts, click_id, value, arrived_at FROM clicks),
{_sliced('clicks', 'arrived_at')},
m AS (SELECT k, max(max(epoch_ms(ts))) OVER (ORDER BY k) - {LATE_HOURS * 3600000} AS wm FROM (SELECT unnest(range(0, {SLICES} + 1)) AS k) LEFT JOIN c USING (k) GROUP BY k),
v AS (SELECT c.*, coalesce(m.wm, 0) AS before FROM c JOIN m ON m.k = c.k - 1 WHERE ts IS NOT NULL)"""
MINUTES_SQL = f"""WITH {_CLICKS},
r AS (SELECT *, date_trunc('minute', ts) AS minute FROM v)
SELECT run, minute, round(avg(value), 6) AS speed, max(click_id) AS step, max(click_id) AS tokens FROM r
WHERE epoch_ms(minute) + 60000 > before AND epoch_ms(minute) + 60000 <= (SELECT wm FROM m WHERE k = {SLICES}) GROUP BY run, minute"""


def _sessions_sql() -> str:
    """Slice by slice: what is open and what comes, cut at pauses; what ends before the watermark is closed, the rest stays."""
    gap = GAP_MINUTES * 60_000_000
    steps, closed = [], []
    for k in range(1, SLICES + 1):
        carried = f"SELECT run, us, run_end FROM o{k - 1} UNION ALL " if k > 1 else ""
        steps.append(f"""i{k} AS ({carried}SELECT run, epoch_us(ts) AS us, 0::BIGINT AS run_end FROM v WHERE k = {k} AND epoch_us(ts) + {gap} > before * 1000),
g{k} AS (SELECT run, us, sum(new) OVER (PARTITION BY run ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM
  (SELECT run, us, CASE WHEN us - lag(us) OVER (PARTITION BY run ORDER BY us) <= {gap} THEN 0 ELSE 1 END AS new FROM i{k})),
z{k} AS (SELECT run, g, min(us) AS first, max(us) + {gap} AS last, count(*) AS n FROM g{k} GROUP BY run, g),
o{k} AS (SELECT g{k}.run, us, 0::BIGINT AS run_end FROM g{k} JOIN z{k} ON z{k}.run IS NOT DISTINCT FROM g{k}.run AND z{k}.g = g{k}.g WHERE last > (SELECT wm FROM m WHERE k = {k}) * 1000)""")
        closed.append(f"SELECT run, make_timestamp(first) AS start, make_timestamp(last) AS \"end\", n FROM z{k} WHERE last <= (SELECT wm FROM m WHERE k = {k}) * 1000")
    return f"WITH {_CLICKS}, {', '.join(steps)} {' UNION ALL '.join(closed)}"


LIVENESS_SQL = f"""WITH s0 AS (SELECT user_id::VARCHAR AS run, ts FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
{_sliced('events', 'ts')},
m AS (SELECT k, max(max(epoch_ms(ts))) OVER (ORDER BY k) AS wm FROM c GROUP BY k),
a AS (SELECT run, k, max(ts) AS last, count(*) AS rows FROM c GROUP BY run, k),
t AS (SELECT run, last, 0::BIGINT AS rows, (SELECT min(m.k) FROM m WHERE m.k >= a.k AND m.wm > (epoch_us(last) + 999) // 1000 + {LIMIT_HOURS * 3600000}) AS stale_at,
             lead(k) OVER (PARTITION BY run ORDER BY k) AS next FROM a)
SELECT run, last, rows, 'alive' AS state FROM a
UNION ALL SELECT run, last, rows, 'stale' FROM t WHERE stale_at IS NOT NULL AND (next IS NULL OR stale_at < next)"""

SEGMENTS_SQL = """WITH b AS (SELECT user_id::VARCHAR AS run, event_id AS pos, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'finished' ELSE 'train' END AS event, epoch(ts) AS ts FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum((event = 'start')::INT) OVER w AS session, lag(event) OVER w AS before FROM b WINDOW w AS (PARTITION BY run ORDER BY pos)),
t AS (SELECT *, last_value(CASE WHEN event = 'train' THEN ts END IGNORE NULLS) OVER (PARTITION BY run, session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s)
SELECT run, pos, session::BIGINT AS session, sum(CASE WHEN event = 'start' OR before = 'finished' OR (event = 'train' AND ts - last > 180) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY pos)::BIGINT AS segment FROM t"""

QUERIES = {
    "users_in_segments": (users_in_segments, SEGMENTS_SQL),
    "clicks_by_minute": (clicks_by_minute, MINUTES_SQL),
    "clicks_in_sessions": (clicks_in_sessions, _sessions_sql()),
    "users_alive_and_stale": (users_alive_and_stale, LIVENESS_SQL),
}
