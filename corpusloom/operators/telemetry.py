"""Run telemetry: sessions, segments, buckets, thresholds, histograms, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.splits import offsets

GAP_SECONDS = 180
LOG_BASE = 1.05
#: Targets that each row of crossings() may be held against.
FEW_TARGETS = 1000


#: Numbers, or seconds, that a block of a running measure spans.
BLOCK = 100_000


def last_before(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column], ties: tuple[str, ...] = (), block: float | None = None) -> DataFrame:
    """rows with, for each name, the last value that is not null before the row, in the order of a number or time.

    Blocks of `block` numbers keep their last values, those run over the blocks of a group (a row a block), and only
    inside a block rows follow one another, so a group of any size is many tasks.
    """
    number = F.col(order).cast("double") if dict(rows.dtypes)[order] not in ("timestamp_ntz",) else F.col(order).cast("timestamp").cast("double")
    held = rows.withColumns({f"__{n}": v for n, v in values.items()}).withColumns({"__order": number, "__at": F.floor(number / (block or BLOCK))})
    inside = Window.partitionBy(*keys, "__at").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("__order", *ties)
    blocks = held.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__at").alias("__b")).agg(*[F.max_by(F.col(f"__{n}"), F.when(F.col(f"__{n}").isNotNull(), place)).alias(f"__last_{n}") for n in values])
    names = [f"__k{i}" for i in range(len(keys))]
    over = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*names, "__b", *[F.last(f"__last_{n}", ignorenulls=True).over(over).alias(f"__carried_{n}") for n in values])
    own = held.withColumns({f"__own_{n}": F.last(f"__{n}", ignorenulls=True).over(inside) for n in values})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__at").eqNullSafe(F.col("__b")))
    out = own.join(carried, on).withColumns({n: F.coalesce(f"__own_{n}", f"__carried_{n}") for n in values})
    return out.drop(*[f"{p}{n}" for n in values for p in ("__", "__own_", "__carried_")], "__order", "__at", "__b", *names)


def _count_upto(rows: DataFrame, keys: list[str], order: str, flag: Column, name: str) -> DataFrame:
    """rows with the number of flagged ones up to each, itself included, by blocks."""
    marked = rows.withColumn("__flag", F.when(F.coalesce(flag, F.lit(False)), 1).otherwise(0))
    return offsets(marked, keys, "__flag", [order], BLOCK).withColumn(name, F.col("token_offset") + F.col("__flag")).drop("token_offset", "__flag")


def sessions(events: DataFrame, run: str = "run", pos: str = "pos") -> DataFrame:
    """`session` number by explicit start events, in file order (counters and clocks may roll back)."""
    return _count_upto(events, [run], pos, F.col("event") == "start", "session")


def segments(events: DataFrame, run: str = "run", pos: str = "pos", gap: float = GAP_SECONDS) -> DataFrame:
    """`segment` inside runs: a start, a pause over `gap` seconds between train rows, or a row after `finished`."""
    s = sessions(events, run, pos)
    s = last_before(s, [run], pos, {"__event": F.col("event")})
    s = last_before(s, [run, "session"], pos, {"__train": F.when(F.col("event") == "train", F.col("ts"))})
    paused = (F.col("event") == "train") & (F.col("ts") - F.col("__train") > gap)
    opens = (F.col("event") == "start") | paused | (F.col("__event") == "finished")
    return _count_upto(s, [run], pos, opens, "segment").drop("__event", "__train")


def minutes(rows: DataFrame) -> DataFrame:
    """Per (run, segment, minute) mean speed and the last step and tokens by position."""
    b = F.floor(F.col("ts") / 60).cast("bigint")
    return rows.groupBy("run", "segment", b.alias("minute")).agg(F.avg("speed").alias("speed"), F.max_by("step", "pos").alias("step"), F.max_by("tokens", "pos").alias("tokens"))


def gap_segments(series: DataFrame, by: list[str], ts: str, value: str, gap: float) -> DataFrame:
    """A sampled series cut at pauses over `gap` and at null values (which are dropped, not zero)."""
    d = last_before(series, by, ts, {"__ts": F.col(ts), "__null": F.col(value).isNull()})
    cut = F.col("__ts").isNull() | (F.col(ts) - F.col("__ts") > gap) | F.col("__null")
    return _count_upto(d, by, ts, cut, "part").drop("__ts", "__null").filter(F.col(value).isNotNull())


def crossings(rows: DataFrame, targets: DataFrame, by: str, step: str, counter: str) -> DataFrame:
    """For each target the first step whose counter reaches it.

    Few targets (a plan's milestones) take one pass: each row lists the targets at or under its counter, and the least
    step is aggregated with partial sums. More than FEW_TARGETS stand among the rows of each group in the counter's order.
    """
    distinct = targets.select("target").distinct()
    goals = [r[0] for r in distinct.orderBy("target").limit(FEW_TARGETS + 1).collect()]
    if len(goals) > FEW_TARGETS:
        own = rows.groupBy(F.col(by).alias("by"), F.col(counter).alias("at")).agg(F.min(step).alias("step"))
        own = own.select("by", "at", F.lit(None).cast(distinct.schema["target"].dataType).alias("target"), "step", F.lit(True).alias("row"))
        asked = rows.select(F.col(by).alias("by")).distinct().crossJoin(distinct.filter("target IS NOT NULL"))
        asked = asked.select("by", F.col("target").alias("at"), "target", F.lit(None).cast(rows.schema[step].dataType).alias("step"), F.lit(None).cast("boolean").alias("row"))
        w = Window.partitionBy("by").orderBy(F.desc("at"))  # rows at the target itself are its peers
        met = own.filter("at IS NOT NULL").unionByName(asked).withColumns({"first": F.min("step").over(w), "reached": F.max("row").over(w)})
        return met.filter("row IS NULL AND reached").select(F.col("by").alias(by), "target", F.col("first").alias("step"))
    passed = F.filter(F.array(*[F.lit(g) for g in goals]), lambda g: F.col(counter) >= g)
    return rows.select(by, step, F.explode(passed).alias("target")).groupBy(by, "target").agg(F.min(step).alias("step"))


def running_best(rows: DataFrame, by: str, order: str, loss: str) -> DataFrame:
    """Whether a row's loss is under all earlier ones."""
    before = F.min(loss).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("improved", F.coalesce(F.col(loss) < before, F.col(loss).isNotNull()))


def warm_up(rows: DataFrame, by: str, order: str, first: int) -> DataFrame:
    """Label the first rows of each group."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("phase", F.when(n <= first, "warmup").otherwise("steady"))


def last_rows(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("n") <= n).drop("n")


def fit_turns(turns: DataFrame, by: str, order: str, tokens: str, budget: int, reserve: int) -> DataFrame:
    """The longest suffix of turns within the budget; the last turn always stays."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    total = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)) + reserve
    return turns.withColumn("n", F.row_number().over(w)).withColumn("total", total).filter((F.col("n") == 1) | (F.col("total") <= budget)).drop("n", "total")


def log_histogram(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count and the upper bounds of the median's and the 95th percentile's bucket (powers of LOG_BASE)."""
    b = F.when(F.col(value) > 0, F.ceil(F.round(F.log(F.col(value)) / F.log(F.lit(LOG_BASE)), 9))).otherwise(-1000000).cast("bigint")
    counts = rows.groupBy(by, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    c = counts.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket")))
    bound = lambda x: F.when(x == -1000000, F.lit(0.0)).otherwise(F.pow(F.lit(LOG_BASE), x))
    return c.groupBy(by).agg(F.max("total").alias("n"), bound(at(0.5)).alias("p50"), bound(at(0.95)).alias("p95"))


def self_time(phases: DataFrame) -> DataFrame:
    """Time of a path less that of its direct children; paths are joined by `/`."""
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", ""))
    child = phases.withColumn("parent", parent).groupBy("parent").agg(F.sum("inclusive").alias("inner"))
    return phases.join(child, phases["path"] == child["parent"], "left").select("path", "inclusive", (F.col("inclusive") - F.coalesce("inner", F.lit(0.0))).alias("self"))


def compare_phases(before: DataFrame, after: DataFrame) -> DataFrame:
    """Speedup and change of each path; paths of one side only are added or removed."""
    a, b = before.select("path", F.col("seconds").alias("before")), after.select("path", F.col("seconds").alias("after"))
    j = a.join(b, "path", "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("both")
    return j.select("path", "before", "after", status.alias("status"), F.when(F.col("after") > 0, F.col("before") / F.col("after")).alias("speedup"), F.when(F.col("before") > 0, 100.0 * (F.col("after") - F.col("before")) / F.col("before")).alias("percent"))


#: What two reports must share to be compared.
SAME = ["schema", "mode", "warmup_steps", "flush_seconds", "detail_limit_seconds"]
SAME_METADATA = ["workload", "environment"]


def mismatches(a: str = "a", b: str = "b") -> Column:
    """Array of the reasons why two reports (struct columns of one row) are not comparable; empty if they are.

    Settings have to be equal; workload and environment have to be given and equal; the monitor's digest has to be equal;
    both runs have to be complete.
    """
    x, y = F.col(a), F.col(b)
    differ = lambda n: ~x[n].eqNullSafe(y[n])
    given = lambda n: F.coalesce(x[n] != "", F.lit(False))
    reasons = [F.when(differ(n), n) for n in SAME] + [F.when(~given(n) | differ(n), f"metadata.{n}") for n in SAME_METADATA]
    reasons.append(F.when(differ("monitoring_source_sha256"), "metadata.monitoring_source_sha256"))
    complete = F.coalesce((x["status"] == "completed") & (y["status"] == "completed"), F.lit(False))
    return F.array_compact(F.array(*reasons, F.when(~complete, "incomplete_run")))


def by_self_time(phases: DataFrame) -> DataFrame:
    """Paths with their own time, the longest first."""
    return self_time(phases).orderBy(F.desc("self"), "path")


def mode_overhead(rows: DataFrame, mode: str = "mode", value: str = "seconds", base: str = "off") -> DataFrame:
    """Median, least and most of each mode, and its overhead over the base mode in percent."""
    per = rows.groupBy(mode).agg(F.expr(f"percentile({value}, 0.5)").alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))
    ref = F.max(F.when(F.col(mode) == base, F.col("median"))).over(Window.partitionBy(F.lit(1)))
    return per.withColumn("overhead_percent", 100.0 * (F.col("median") - ref) / ref)


def latest(rows: DataFrame, by: str, ts: str, now: Column, old: float = 90, ahead: float = 5) -> DataFrame:
    """Newest sample of each group and whether it is fresh (not over `old` behind nor `ahead` in front)."""
    newest = rows.groupBy(by).agg(F.max(ts).alias("ts"), F.max_by("value", ts).alias("value"))
    age = now - F.col("ts")
    return newest.withColumn("fresh", (age <= old) & (age >= -ahead))


def live_state(status, heartbeat, present, now, old: float = 90) -> Column:
    """Struct (age, fresh, live, recoverable) of a run: live if running, fresh and its process there; a paused run
    shows its saved checkpoint."""
    age = F.when(heartbeat.isNotNull(), F.greatest(F.lit(0.0), now - heartbeat))
    fresh = F.coalesce(age <= old, F.lit(False))
    return F.struct(age.alias("age"), fresh.alias("fresh"), ((status == "running") & fresh & present).alias("live"), (status == "paused").alias("recoverable"))


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, block: float | None = None) -> DataFrame:
    """For each left row the right value at or before its time: union, then the last that is not null, by blocks of time."""
    u = left.select(by, ts, F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(1).alias("side")).unionByName(right.select(by, ts, F.col(value).alias("__value"), F.lit(0).alias("side")))
    return last_before(u, [by], ts, {value: F.col("__value")}, ("side",), block).filter("side = 1").drop("side", "__value")


def elapsed(sessions_: list[tuple[float, float]], t: Column) -> Column:
    """time inside sessions up to t; sessions of one run, a few on the driver."""
    total = F.lit(0.0)
    for start, end in sessions_:
        total = total + F.greatest(F.lit(0.0), F.least(t, F.lit(float(end))) - F.lit(float(start)))
    return total


def in_sessions(rows: DataFrame, sessions_: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """Rows with the session they fall in; a range join as an equi-join on buckets of time, then the exact test.

    A session goes to buckets of the least power of two seconds that is not under its length, so it stands in two of them at
    most however long it is, and a row looks at one bucket of each width that the sessions of its group have. Both joins
    are sorted ones: Spark guesses the size of the rows by their files, which say nothing of a row for each width.
    """
    width = F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1.0)))).cast("int")
    s = sessions_.withColumn("__w", width)
    wide = F.pow(F.lit(2.0), F.col("__w"))
    widths = s.groupBy(by).agg(F.collect_set("__w").alias("__widths"))  # at most one for each power of two
    s = s.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor(F.col("end") / wide))))
    r = rows.join(widths.hint("merge"), by).withColumn("__w", F.explode("__widths")).drop("__widths")
    r = r.withColumn("__b", F.floor(F.col(ts) / F.pow(F.lit(2.0), F.col("__w"))))
    return r.join(s.hint("merge"), [by, "__w", "__b"]).filter(F.col(ts).between(F.col("start"), F.col("end"))).drop("__b", "__w")


def schedule_fraction(tokens, total: float, began: float | None = None, deadline: float | None = None, now: Column | None = None) -> Column:
    """how much of a run is done, in [0, 1]: by tokens, or by the clock where it has a deadline and is further."""
    f = F.col(tokens) / F.lit(float(total))
    if now is not None:
        f = F.greatest(f, (now - F.lit(float(began))) / F.lit(max(1.0, float(deadline) - float(began))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), f))


def schedule(tokens, total: float, warm: float = 0.0) -> Column:
    """cosine rate from 1 to 0.1 over the tokens, times a linear warm-up."""
    f = schedule_fraction(tokens, total)
    rate = 0.1 + 0.45 * (1 + F.cos(F.pi() * f))
    return rate * F.least(F.lit(1.0), F.col(tokens) / F.lit(float(warm))) if warm else rate


def process_name(command) -> Column:
    """name of an application bundle or of the executable, without arguments."""
    c = F.col(command) if isinstance(command, str) else command
    app = F.regexp_extract(c, r"([^/]+)\.app/", 1)
    exe = F.regexp_extract(F.coalesce(F.when(c.startswith('"'), F.regexp_extract(c, r'^"([^"]*)"', 1)), F.regexp_extract(c, r"^(\S*)", 1)), r"([^/]*)$", 1)
    return F.when(app != "", app).otherwise(exe)


def extremes(rows: DataFrame, by: str) -> DataFrame:
    """Best and last step, least loss, most memory, median speed."""
    return rows.groupBy(by).agg(F.min_by("step", F.struct("loss", "step")).alias("best_step"), F.min("loss").alias("best_loss"), F.max_by("step", "pos").alias("last_step"), F.max("peak").alias("peak"), F.expr("percentile(speed, 0.5)").alias("median_speed"))


def work_delta(first: DataFrame, last: DataFrame) -> DataFrame:
    """Counters (name, source, tokens) gained; `violation` where one went down or is missing."""
    j = first.select("name", "source", F.col("tokens").alias("x")).join(last.select("name", "source", F.col("tokens").alias("y")), ["name", "source"], "full_outer")
    return j.select("name", "source", (F.coalesce("y", F.lit(0)) - F.coalesce("x", F.lit(0))).alias("delta"), (F.col("y").isNull() | (F.col("y") < F.coalesce("x", F.lit(0)))).alias("violation"))


def learning_gate(rows: DataFrame, by: str) -> DataFrame:
    """Last loss under half the first, ten more recalled, and 128 cases."""
    g = rows.groupBy(by).agg(F.min_by("loss", "step").alias("first"), F.max_by("loss", "step").alias("last"), F.min_by("recall", "step").alias("r0"), F.max_by("recall", "step").alias("r1"), F.max("n").alias("n"))
    return g.withColumn("passed", (F.col("last") < F.col("first") / 2) & (F.col("r1") >= F.col("r0") + 10) & (F.col("n") == 128))
