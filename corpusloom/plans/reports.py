"""Queries over events, conversations, documents and labels: telemetry, scoring, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import grading as G
from corpusloom.operators import scoring as S
from corpusloom.operators import telemetry as M
from corpusloom.plans.corpus import FAMILY_SQL, families, records
from corpusloom.session import table


def run_events(spark, sf) -> DataFrame:
    """Events as run telemetry: user is the run, signup a start, error the end, anything else a train row."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "finished").otherwise("train")
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("ts"), kind.alias("event"), F.col("value").alias("speed"), F.col("event_id").alias("step"), (F.col("event_id") * 10).alias("tokens"))


EV_SQL = """ev AS (SELECT user_id AS run, event_id AS pos, epoch_us(ts) / 1e6 AS ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'finished' ELSE 'train' END AS event,
  value AS speed, event_id AS step, event_id * 10 AS tokens FROM events),
se AS (SELECT *, sum(CASE WHEN event = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY pos) AS session FROM ev),
lt AS (SELECT *, last_value(CASE WHEN event = 'train' THEN ts END IGNORE NULLS) OVER (PARTITION BY run, session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ts,
  lag(event) OVER (PARTITION BY run ORDER BY pos) AS before FROM se),
sg AS (SELECT *, sum(CASE WHEN event = 'start' OR coalesce(event = 'train' AND ts - last_ts > 180, false) OR coalesce(before = 'finished', false) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY pos) AS segment FROM lt)"""


def sessionize_gap(spark, sf):
    s = M.segments(run_events(spark, sf))
    return s.groupBy("run", "session", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def history_minutes(spark, sf):
    s = M.segments(run_events(spark, sf)).filter("event = 'train'")
    return M.minutes(s).withColumn("speed", F.round("speed", 6))


def gap_segments(spark, sf):
    e = run_events(spark, sf).withColumn("speed", F.when(F.col("pos") % 11 != 0, F.col("speed")))
    g = M.gap_segments(e, ["run"], "ts", "speed", 86400.0)
    return g.groupBy("run", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("least_pos"))


GAP_SQL = f"""WITH {EV_SQL.split('se AS')[0].rstrip().rstrip(',')}, e AS (SELECT run, pos, ts, CASE WHEN pos % 11 <> 0 THEN speed END AS speed FROM ev),
l AS (SELECT *, lag(ts) OVER w AS pt, lag(speed) OVER w AS ps FROM e WINDOW w AS (PARTITION BY run ORDER BY ts)),
p AS (SELECT *, sum(CASE WHEN coalesce(ts - pt > 86400, false) OR ps IS NULL OR pt IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts) AS part FROM l)
SELECT run, part::BIGINT AS part, count(*) AS n, min(pos) AS least_pos FROM p WHERE speed IS NOT NULL GROUP BY ALL"""


def threshold_crossing(spark, sf):
    e = run_events(spark, sf)
    goals = spark.createDataFrame([(10_000,), (50_000,), (90_000,)], "target bigint")
    return M.crossings(e, goals, "run", "step", "tokens")


CROSS_SQL = f"WITH {EV_SQL.split('se AS')[0].rstrip().rstrip(',')} SELECT run, target::BIGINT AS target, min(step) AS step FROM ev JOIN (VALUES (10000), (50000), (90000)) t(target) ON tokens >= target GROUP BY ALL"


def running_best(spark, sf):
    return M.running_best(run_events(spark, sf), "run", "pos", "speed").select("run", "pos", "improved")


BEST_SQL = f"WITH {EV_SQL.split('se AS')[0].rstrip().rstrip(',')} SELECT run, pos, coalesce(speed < min(speed) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), speed IS NOT NULL) AS improved FROM ev"


def warmup_steady(spark, sf):
    return M.warm_up(run_events(spark, sf), "run", "pos", 3).groupBy("run", "phase").agg(F.count(F.lit(1)).alias("n"))


WARM_SQL = "WITH n AS (SELECT user_id AS run, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3 THEN 'warmup' ELSE 'steady' END AS phase FROM events) SELECT run, phase, count(*) AS n FROM n GROUP BY ALL"


def last_checkpoints(spark, sf):
    return M.last_rows(run_events(spark, sf), "run", "pos", 2).select("run", "pos")


def log_histogram(spark, sf):
    return M.log_histogram(table(spark, sf, "events"), "event_type", "value").select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


HIST_SQL = """WITH b AS (SELECT event_type, CASE WHEN value > 0 THEN ceil(round(ln(value) / ln(1.05::DOUBLE), 9)) ELSE -1000000 END AS bucket, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
q AS (SELECT event_type, max(total)::BIGINT AS n, min(bucket) FILTER (upto >= 0.5 * total) AS a, min(bucket) FILTER (upto >= 0.95 * total) AS z FROM c GROUP BY event_type)
SELECT event_type, n, round(CASE WHEN a = -1000000 THEN 0 ELSE pow(1.05::DOUBLE, a) END, 6) AS p50, round(CASE WHEN z = -1000000 THEN 0 ELSE pow(1.05::DOUBLE, z) END, 6) AS p95 FROM q"""


def phase_compare(spark, sf):
    """Every event is on one of two sides by turns; paths of users are on both or on one."""
    e = table(spark, sf, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path"), "value", (F.col("event_id") % 2 == 0).alias("first"))
    half = lambda d: d.groupBy("path").agg(F.round(F.sum("value"), 6).alias("seconds"))
    c = M.compare_phases(half(e.filter("first")), half(e.filter("NOT first")))
    return c.select("path", "status", F.round("speedup", 6).alias("speedup"), F.round("percent", 4).alias("percent"))


PHASE_SQL = """WITH e AS (SELECT event_type || '/' || user_id AS path, value, event_id % 2 = 0 AS first FROM events),
a AS (SELECT path, round(sum(value), 6) AS x FROM e WHERE first GROUP BY path),
b AS (SELECT path, round(sum(value), 6) AS y FROM e WHERE NOT first GROUP BY path)
SELECT path, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'both' END AS status, round(CASE WHEN y > 0 THEN x / y END, 6) AS speedup, round(CASE WHEN x > 0 THEN 100.0 * (y - x) / x END, 4) AS percent FROM a FULL JOIN b USING (path)"""


def self_time(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 5).cast("string").alias("u"), "value")
    inner = e.groupBy(F.concat_ws("/", "event_type", "u").alias("path")).agg(F.sum("value").alias("inclusive"))
    outer = e.groupBy(F.col("event_type").alias("path")).agg((F.sum("value") * 2).alias("inclusive"))
    return M.self_time(inner.unionByName(outer)).select("path", F.round("inclusive", 4).alias("inclusive"), F.round("self", 4).alias("self"))


SELF_SQL = """WITH i AS (SELECT event_type || '/' || (user_id % 5) AS path, event_type AS parent, sum(value) AS inclusive FROM events GROUP BY ALL),
o AS (SELECT event_type AS path, sum(value) * 2 AS inclusive FROM events GROUP BY ALL), c AS (SELECT parent, sum(inclusive) AS inner_ FROM i GROUP BY parent)
SELECT path, round(inclusive, 4) AS inclusive, round(inclusive, 4) AS self FROM i UNION ALL SELECT path, round(inclusive, 4), round(inclusive - inner_, 4) FROM o JOIN c ON parent = path"""


def mode_overhead(spark, sf):
    m = M.mode_overhead(table(spark, sf, "events"), "event_type", "value", "view")
    return m.select("event_type", F.round("median", 6).alias("median"), "least", "most", F.round("overhead_percent", 4).alias("overhead_percent"))


MODE_SQL = """WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY event_type)
SELECT event_type, round(median, 6) AS median, least, most, round(100.0 * (median - (SELECT median FROM m WHERE event_type = 'view')) / (SELECT median FROM m WHERE event_type = 'view'), 4) AS overhead_percent FROM m"""


def liveness(spark, sf):
    e = run_events(spark, sf).select("run", "ts", F.col("speed").alias("value"))
    now = F.lit(float(e.agg(F.max("ts")).first()[0] or 0) - 3600)
    return M.latest(e, "run", "ts", now, 86400, 5).select("run", "value", "fresh")


LIVE_SQL = f"WITH {EV_SQL.split('se AS')[0].rstrip().rstrip(',')}, n AS (SELECT max(ts) - 3600 AS now FROM ev) SELECT run, arg_max(speed, ts) AS value, any_value(now) - max(ts) BETWEEN -5 AND 86400 AS fresh FROM ev, n GROUP BY run"


def as_of_heartbeat(spark, sf):
    e = run_events(spark, sf)
    return M.as_of(e.filter("event = 'train'").select("run", "ts", "pos"), e.filter("event <> 'train'").select("run", "ts", F.col("pos").alias("last")), "run", "ts", "last").groupBy("run").agg(F.count("last").alias("with_heartbeat"), F.count(F.lit(1)).alias("n"))


ASOF_SQL = f"""WITH {EV_SQL.split('se AS')[0].rstrip().rstrip(',')}, t AS (SELECT run, ts FROM ev WHERE event = 'train'), h AS (SELECT run, ts, pos FROM ev WHERE event <> 'train')
SELECT t.run, count(h.pos) AS with_heartbeat, count(*) AS n FROM t ASOF LEFT JOIN h ON t.run = h.run AND t.ts >= h.ts GROUP BY t.run"""


def session_join(spark, sf):
    e = run_events(spark, sf)
    s = M.sessions(e).filter("session > 0").groupBy("run", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return M.in_sessions(e.select("run", "ts", "pos"), s, "run").groupBy("run", "session").agg(F.count(F.lit(1)).alias("n"))


SESSION_JOIN_SQL = f"""WITH {EV_SQL}, s AS (SELECT run, session, min(ts) AS a, max(ts) AS z FROM se WHERE session > 0 GROUP BY ALL)
SELECT s.run, s.session::BIGINT AS session, count(*) AS n FROM s JOIN ev ON ev.run = s.run AND ev.ts BETWEEN a AND z GROUP BY ALL"""


def lr_schedule(spark, sf):
    return run_events(spark, sf).select("pos", F.round(M.schedule("tokens", 60000, 500), 9).alias("rate"))


LR_SQL = f"WITH {EV_SQL.split('se AS')[0].rstrip().rstrip(',')} SELECT pos, round((0.1 + 0.45 * (1 + cos(pi() * least(1.0, greatest(0.0, tokens / 60000.0::DOUBLE))))) * least(1.0, tokens / 500.0::DOUBLE), 9) AS rate FROM ev"


def json_props(spark, sf):
    return table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("n"))


JSON_SQL = "SELECT event_type, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS n FROM events GROUP BY event_type"


def conversation_pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return c.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "answer")


PAIR_SQL = "SELECT conv_id, turn, text AS prompt, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"


def turn_budget(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.size(F.split("text", " ")))
    return M.fit_turns(c.withColumnRenamed("n", "tokens"), "conv_id", "turn", "tokens", 60, 10).select("conv_id", "turn")


TURN_SQL = """WITH t AS (SELECT *, len(string_split(text, ' ')) AS k FROM conversations),
s AS (SELECT *, sum(k) OVER (PARTITION BY conv_id ORDER BY turn DESC) + 10 AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t) SELECT conv_id, turn FROM s WHERE n = 1 OR total <= 60"""


def token_f1(spark, sf):
    p = conversation_pairs(spark, sf)
    w = lambda c: F.filter(F.split(F.lower(c), " "), lambda x: x != "")
    return p.select("conv_id", "turn", F.round(S.token_f1(w("prompt"), w("answer")), 9).alias("f1"))


F1_SQL = f"""WITH p AS ({PAIR_SQL}), a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(lower(prompt), ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(lower(answer), ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS o FROM a JOIN b USING (conv_id, turn, w) GROUP BY ALL),
k AS (SELECT conv_id, turn, sum(n) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT conv_id, turn, round(2.0::DOUBLE * coalesce(o, 0) / greatest(1, coalesce(n, 0)), 9) AS f1 FROM p LEFT JOIN o USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn)"""


def narrative_stats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.trim("text") != "").alias("nonempty"), F.round(S.unique_word_share("text", lower=False), 9).alias("unique_share"))


NARRATIVE_SQL = "WITH w AS (SELECT doc_id, trim(text) <> '' AS nonempty, regexp_extract_all(text, '[^\\s]+') AS w FROM documents) SELECT doc_id, nonempty, round(len(list_distinct(w))::DOUBLE / greatest(1, len(w)), 9) AS unique_share FROM w"


def repetition_tags(spark, sf):
    """Symptoms of every document as an answer: empty, cut at 4,000 characters, repeating itself."""
    stop = F.when(F.length("text") > 4000, "token_limit").otherwise("eos")
    t = G.error_tags("source", "text", stop, F.lit(None).cast("boolean"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.array_join(t["tags"], ",").alias("tags"))


TAGS_SQL = """WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\s]+') AS w FROM documents),
g AS (SELECT *, CASE WHEN len(w) >= 20 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) ELSE [] END AS g FROM w)
SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'empty_answer' END, CASE WHEN length(text) > 4000 THEN 'token_limit' END,
  CASE WHEN len(w) >= 20 AND len(list_distinct(g)) < 0.55 * len(g) THEN 'repetition' END], lambda x: x IS NOT NULL), ',') AS tags FROM g"""


def rule_results(spark, sf) -> DataFrame:
    """A rule's verdict on labelled documents as result rows: is the text free of repeated marks?"""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    guess = F.when(d["text"].rlike(r"!!|[*$%&#]{2,}|\|"), 0).otherwise(1)
    scored = F.col("doc_id") % 10 != 0
    return d.select("doc_id", "source", F.col("lang").alias("language"), "quality", guess.alias("guess"), F.when(scored, guess == F.col("quality")).alias("correct"), F.lit(True).alias("reference_parseable"), F.when(F.length("text") > 4000, "length").otherwise("eos").alias("stop_reason"), F.when(~scored, "unscored").when(F.length("text") < 30, "format_error").otherwise("scored").alias("status"), F.col("text").alias("generated"))


RULE_SQL = """rr AS (SELECT doc_id, source, lang AS language, quality, text, CASE WHEN regexp_matches(text, '!!|[*$%&#]{2,}|\\|') THEN 0 ELSE 1 END AS guess FROM documents JOIN labels USING (doc_id)),
res AS (SELECT *, CASE WHEN doc_id % 10 <> 0 THEN guess = quality END AS correct, CASE WHEN length(text) > 4000 THEN 'length' ELSE 'eos' END AS stop_reason,
  CASE WHEN doc_id % 10 = 0 THEN 'unscored' WHEN length(text) < 30 THEN 'format_error' ELSE 'scored' END AS status FROM rr)"""
SCORES_SQL = "sc AS (SELECT source, count(*) AS generated, count(correct) AS scored, count(*) FILTER (correct) AS correct, CASE WHEN count(correct) > 0 THEN count(*) FILTER (correct) / count(correct)::DOUBLE END AS accuracy FROM res GROUP BY source)"


def source_scores(spark, sf):
    return S.source_scores(rule_results(spark, sf)).withColumn("accuracy", F.round("accuracy", 9))


def language_scores(spark, sf):
    return S.source_scores(rule_results(spark, sf), ("source", "language")).withColumn("accuracy", F.round("accuracy", 9))


def family_macro(spark, sf):
    fam = table(spark, sf, "documents").select("source").distinct().withColumn("family", families(F.col("source")))
    return S.family_macro(S.source_scores(rule_results(spark, sf)), fam).withColumn("macro", F.round("macro", 9))


FAMILY_MACRO_SQL = f"WITH {RULE_SQL}, {SCORES_SQL} SELECT {FAMILY_SQL} AS family, round(avg(accuracy), 9) AS macro, sum(correct)::BIGINT AS correct, sum(scored)::BIGINT AS scored, count(*) AS sources FROM sc GROUP BY 1"


def wilson(spark, sf):
    s = S.source_scores(rule_results(spark, sf))
    w = S.wilson("correct", "scored")
    return s.select("source", F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"))


WILSON_SQL = f"""WITH {RULE_SQL}, {SCORES_SQL}, p AS (SELECT source, scored::DOUBLE AS n, correct / scored::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM sc)
SELECT source, round(CASE WHEN n > 0 THEN greatest(0.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END, 9) AS low,
  round(CASE WHEN n > 0 THEN least(1.0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END, 9) AS high FROM p"""


def eval_summary(spark, sf):
    return S.summary(rule_results(spark, sf))


SUMMARY_SQL = f"""WITH {RULE_SQL} SELECT source, count(*) AS attempted, count(correct) AS scored, count(*) FILTER (correct) AS correct, count(*) FILTER (status = 'format_error') AS format_errors,
 count(*) FILTER (status = 'unscored') AS unscored, count(*) FILTER (stop_reason = 'length') AS cutoffs, count(*) FILTER (trim(text) = '') AS empty, NULL::DOUBLE AS suite_accuracy FROM res GROUP BY source"""


def label_concentration(spark, sf):
    return S.concentration(rule_results(spark, sf), "guess", "quality")


CONC_SQL = f"""WITH {RULE_SQL}, p AS (SELECT source, guess, count(*) AS n FROM res GROUP BY ALL), q AS (SELECT source, quality, count(*) AS n FROM res GROUP BY ALL)
SELECT source, count(*) AS distinct_predictions, max(p.n) AS mode_count, (SELECT max(q.n) FROM q WHERE q.source = p.source) AS majority_count FROM p GROUP BY source"""


def majority_baseline(spark, sf):
    r = rule_results(spark, sf)
    return S.majority_baseline(r.filter("doc_id % 7 < 4"), r.filter("doc_id % 7 >= 4"), "quality")


MAJORITY_SQL = f"""WITH {RULE_SQL}, c AS (SELECT source, quality, count(*) AS n FROM res WHERE doc_id % 7 < 4 GROUP BY ALL), m AS (SELECT source, quality AS majority FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, quality) = 1)
SELECT source, any_value(majority) AS majority, count(*) AS n, count(*) FILTER (quality = majority) AS correct FROM res JOIN m USING (source) WHERE doc_id % 7 >= 4 GROUP BY source"""


def paired_compare(spark, sf):
    r = rule_results(spark, sf)
    other = r.withColumn("correct", F.when(F.col("doc_id") % 3 != 0, F.col("quality") == 1))
    return S.paired(r, other, ["doc_id"])


PAIRED_SQL = f"""WITH {RULE_SQL}, j AS (SELECT correct AS x, CASE WHEN doc_id % 3 <> 0 THEN quality = 1 END AS y FROM res)
SELECT count(*) AS n, count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS first_only, count(*) FILTER (NOT x AND y) AS second_only, count(*) FILTER (NOT x AND NOT y) AS neither FROM j WHERE x IS NOT NULL AND y IS NOT NULL"""


def macro_loss(spark, sf):
    d = table(spark, sf, "documents").select("source", (F.length("text") / 1000.0).alias("loss"))
    fam = d.select("source").distinct().withColumn("family", families(F.col("source")))
    return S.macro_loss(d, fam).withColumn("loss", F.round("loss", 6))


LOSS_SQL = f"""WITH s AS (SELECT source, avg(length(text) / 1000.0::DOUBLE) AS loss FROM documents GROUP BY source)
SELECT 'source' AS level, source AS name, round(loss, 6) AS loss FROM s UNION ALL SELECT 'family', {FAMILY_SQL}, round(avg(loss), 6) FROM s GROUP BY 2 UNION ALL SELECT 'macro', 'all', round(avg(loss), 6) FROM s"""


def weighted_loss(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.col("value").alias("loss"), (F.col("event_id") % 2).alias("mask"))
    return S.weighted_loss(e, ["event_type"]).withColumn("loss", F.round("loss", 6))


def allocation(spark, sf):
    n = F.size(F.split(T.collapse("text"), " "))
    a = S.allocation(n)
    return table(spark, sf, "documents").select(a.alias("a")).agg(F.count_if(F.col("a.supported")).alias("supported"), F.count_if(~F.col("a.supported")).alias("rejected"), F.count_if(F.expr("a.reduced AND a.supported")).alias("reduced"), F.min("a.effective").alias("least"), F.max("a.effective").alias("most"))


ALLOC_SQL = """WITH n AS (SELECT 1024 - len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS l FROM documents), a AS (SELECT l, least(l, 1024) AS g FROM n)
SELECT count(*) FILTER (g >= 64) AS supported, count(*) FILTER (g < 64) AS rejected, count(*) FILTER (g < 1024 AND g >= 64) AS reduced, min(greatest(g, 0))::INT AS least, max(greatest(g, 0))::INT AS most FROM a"""


QUERIES = {
    "sessionize_gap": (sessionize_gap, f"WITH {EV_SQL} SELECT run, session::BIGINT AS session, segment::BIGINT AS segment, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM sg GROUP BY ALL"),
    "history_minutes": (history_minutes, f"WITH {EV_SQL} SELECT run, segment::BIGINT AS segment, floor(ts / 60)::BIGINT AS minute, round(avg(speed), 6) AS speed, arg_max(step, pos) AS step, arg_max(tokens, pos) AS tokens FROM sg WHERE event = 'train' GROUP BY ALL"),
    "gap_segments": (gap_segments, GAP_SQL), "threshold_crossing": (threshold_crossing, CROSS_SQL), "running_best": (running_best, BEST_SQL), "warmup_steady": (warmup_steady, WARM_SQL),
    "last_checkpoints": (last_checkpoints, "SELECT user_id AS run, event_id AS pos FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 2"),
    "log_histogram": (log_histogram, HIST_SQL), "phase_compare": (phase_compare, PHASE_SQL), "self_time": (self_time, SELF_SQL), "mode_overhead": (mode_overhead, MODE_SQL), "liveness": (liveness, LIVE_SQL),
    "as_of_heartbeat": (as_of_heartbeat, ASOF_SQL), "session_join": (session_join, SESSION_JOIN_SQL), "lr_schedule": (lr_schedule, LR_SQL), "json_props": (json_props, JSON_SQL),
    "conversation_pairs": (conversation_pairs, PAIR_SQL), "turn_budget": (turn_budget, TURN_SQL), "token_f1": (token_f1, F1_SQL), "narrative_stats": (narrative_stats, NARRATIVE_SQL), "repetition_tags": (repetition_tags, TAGS_SQL),
    "source_scores": (source_scores, f"WITH {RULE_SQL}, {SCORES_SQL} SELECT source, generated, scored, correct, round(accuracy, 9) AS accuracy FROM sc"),
    "language_scores": (language_scores, f"WITH {RULE_SQL} SELECT source, language, count(*) AS generated, count(correct) AS scored, count(*) FILTER (correct) AS correct, round(CASE WHEN count(correct) > 0 THEN count(*) FILTER (correct) / count(correct)::DOUBLE END, 9) AS accuracy FROM res GROUP BY ALL"),
    "family_macro": (family_macro, FAMILY_MACRO_SQL), "wilson": (wilson, WILSON_SQL), "eval_summary": (eval_summary, SUMMARY_SQL), "label_concentration": (label_concentration, CONC_SQL), "majority_baseline": (majority_baseline, MAJORITY_SQL),
    "paired_compare": (paired_compare, PAIRED_SQL), "macro_loss": (macro_loss, LOSS_SQL), "weighted_loss": (weighted_loss, "SELECT event_type, round(sum(value * (event_id % 2)) / greatest(sum(event_id % 2), 1), 6) AS loss FROM events GROUP BY event_type"),
    "allocation": (allocation, ALLOC_SQL),
}
