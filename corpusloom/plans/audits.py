"""Queries of audits, joins, measures and telemetry over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit, dedup, grading, scoring, splits, telemetry
from corpusloom.plans.corpus import REC_SQL, records
from corpusloom.session import table
from corpusloom.sources import converters, sinks

QUERIES: dict = {}


def states(sql: str):
    """Register the decorated query with the SQL of its result."""

    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _labelled(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    return table(spark, sf, "labels").filter(where).select("doc_id").distinct()


# ---- joins and identities -------------------------------------------------------------------------------------------
@states(f"WITH {REC_SQL} SELECT original_id FROM keyed WHERE key NOT IN (SELECT key FROM keyed JOIN labels ON doc_id = ord WHERE quality = 0)")
def without_bad_prompts(spark, sf):
    """Documents whose first line is not that of a document of low quality."""
    d = records(spark, sf).withColumn("key", T.digest(T.normal("prompt")))
    return dedup.without_duplicates_of(d, d.join(_labelled(spark, sf, "quality = 0"), F.col("ord") == F.col("doc_id"), "left_semi")).select("original_id")


@states("""WITH p AS (SELECT doc_id, source, n_chars, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'dev' ELSE 'train' END AS split FROM documents),
b AS (SELECT DISTINCT source FROM p WHERE split = 'dev' AND n_chars % 40 <> 7 AND n_chars IN (SELECT n_chars FROM p WHERE split = 'train' AND n_chars % 40 <> 7))
SELECT doc_id FROM p WHERE NOT (split = 'dev' AND source IN (SELECT source FROM b))""")
def without_code_overlap(spark, sf):
    """Held-out groups of programs go if one has the syntax tree of a train program; some do not parse."""
    d = _documents(spark, sf).join(_labelled(spark, sf).withColumn("split", F.lit("dev")), "doc_id", "left").fillna("train", ["split"])
    program = F.concat(F.when(F.col("lang") == "en", "x=").otherwise("x  =  "), F.col("n_chars").cast("string"), F.when(F.col("n_chars") % 40 == 7, " +").otherwise(F.lit("")))
    return dedup.code_overlap(d.select("doc_id", "split", F.col("source").alias("group"), T.code_key(program).alias("code_key"))).select("doc_id")


@states("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN lang ELSE lang || chr(10) || chr(10) || 'Required function name: f' || (doc_id % 5) END AS prompt FROM documents""")
def prompts_with_interfaces(spark, sf):
    """The name that a test calls and the program defines goes into the prompt; a third defines another."""
    d = _documents(spark, sf).select(F.lit("s").alias("source"), F.col("doc_id").cast("string").alias("original_id"), "doc_id", F.col("lang").alias("prompt"))
    name = F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string"))
    program = F.concat(F.lit("def "), F.when(F.col("doc_id") % 3 == 2, "g").otherwise(name), F.lit("(x):\n    return x"))
    named = d.select("source", "original_id", T.called_name(F.concat(F.lit("assert len(str("), name, F.lit("(1))) == 1")), program).alias("name"))
    return T.with_interface(d, named).select("doc_id", "prompt")


@states("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 = 0 THEN 'function_interface' WHEN len(l) <> len(list_filter(l, lambda x: x <> '')) THEN 'unaligned_tests' END AS reason,
len(l)::INT AS cases, lang AS reference FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) WHERE doc_id IN (SELECT doc_id FROM labels)""")
def code_tasks_of_documents(spark, sf):
    """Documents as tasks, lines as inputs, lines with text as outputs, with the references of labelled ones."""
    d = _documents(spark, sf).withColumn("inputs", F.split("text", "\n", -1))
    raw = d.select("source", F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 7 == 0, "f").alias("fn_name"), "inputs", F.filter("inputs", lambda x: x != "").alias("outputs"))
    dev = d.join(_labelled(spark, sf), "doc_id", "left_semi").select("source", F.col("doc_id").cast("string").alias("original_id"), F.lit(0).alias("variant"), F.col("lang").alias("answer"))
    return converters.code_tasks(raw, dev).select("id", "reason", F.size("cases").alias("cases"), F.array_join("references", ",").alias("reference"))


@states("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS more FROM documents)
SELECT doc_id::VARCHAR AS id, CASE WHEN more THEN 'stronger' WHEN len(l) > 1 THEN 'several' ELSE 'single' END AS coverage, md5(l[1]) AS shown, (len(l) + more::INT - 1)::INT AS scored FROM d""")
def cases_with_boundaries(spark, sf):
    """Lines as cases, one more for toxic documents; the first is shown, the rest scored."""
    case = lambda x: F.struct(x.alias("input"), F.lit("o").alias("output"))
    tasks = _documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.transform(F.split("text", "\n", -1), case).alias("cases"))
    extra = _labelled(spark, sf, "toxic = 1").select(F.col("doc_id").cast("string").alias("id"), F.array(case(F.lit("0"))).alias("extra_cases"))
    out = converters.public_example(converters.with_boundary_cases(tasks, extra))
    return out.select("id", "coverage", F.md5("shown.input").alias("shown"), F.size("scored").alias("scored"))


@states("SELECT doc_id, CASE WHEN source = 'src1' OR doc_id NOT IN (SELECT doc_id FROM labels) THEN 'train' ELSE 'dev' END AS split FROM documents")
def one_source_to_train(spark, sf):
    """Held-out records of one source go to train."""
    d = _documents(spark, sf).join(_labelled(spark, sf).withColumn("split", F.lit("dev")), "doc_id", "left").fillna("train", ["split"])
    d = d.withColumn("source", F.when(F.col("source") == "src1", "hotpotqa").otherwise(F.col("source")))
    return converters.hotpot_to_train(d).select("doc_id", "split")


@states("""WITH d AS (SELECT doc_id, string_split(text, ' ') AS w, doc_id % 2 = 0 AS ordered FROM documents)
SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'missing_table' WHEN len(w) > 10000 THEN 'reference_failed'
WHEN CASE WHEN ordered THEN w = list_reverse(w) ELSE true END THEN 'match' ELSE 'mismatch' END AS status FROM d""")
def results_of_documents(spark, sf):
    """Words as the rows of a result, against the same rows reversed; half of the references order them."""
    d = _documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.split("text", " ").alias("w"))
    results = d.select("id", F.reverse("w").alias("actual"), F.when(F.col("doc_id") % 2 == 0, "SELECT w FROM t ORDER  BY w").otherwise("SELECT w FROM orders").alias("reference_sql"))
    return grading.compare_on_tables(results, d.join(_labelled(spark, sf), "doc_id", "left_semi").select("id", F.col("w").alias("expected")))


@states("SELECT quality::VARCHAR AS before, CASE WHEN lower(trim(t)) = lower(trim(lang)) THEN 'correct' ELSE 'incorrect' END AS after, count(*) AS n FROM (SELECT doc_id, lang, split_part(text, ' ', 1) AS t FROM documents) JOIN labels USING (doc_id) GROUP BY ALL")
def rescored_documents(spark, sf):
    """Labels as old verdicts of first words, graded anew against the language's code."""
    d = _documents(spark, sf).select(F.lit("s").alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit("text").alias("kind"), F.col("lang").alias("reference"), F.lit(None).cast("array<string>").alias("choices"), F.split("text", " ")[0].alias("generated"))
    old = d.join(table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("status")), "id").select("source", "id", "generated", "status")
    verdict = grading.grade("kind", F.split("generated", "\n")[0], "reference", "choices")["status"]
    return grading.rescore(old.withColumn("generated", F.split("generated", "\n")[0]), d.drop("generated"), verdict).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


# ---- audits ---------------------------------------------------------------------------------------------------------
@states("""WITH a AS (SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL),
m AS (SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY ALL)
SELECT source, lang, a.n AS actual, m.n AS manifest FROM a FULL JOIN m USING (source, lang) WHERE a.n IS DISTINCT FROM m.n OR a.chars IS DISTINCT FROM m.chars""")
def counts_against_manifest(spark, sf):
    """V2: counts of documents against those without toxic ones."""
    per = lambda d: d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    d = _documents(spark, sf)
    out = audit.counts_differ(per(d), per(d.join(_labelled(spark, sf, "toxic = 1"), "doc_id", "left_anti")), ["source", "lang"], ["n", "chars"])
    return out.select("source", "lang", F.col("actual.n").alias("actual"), F.col("manifest.n").alias("manifest"))


@states("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND (source, md5(text)) NOT IN (SELECT (source, md5(text)) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)")
def suite_rows_without_partner(spark, sf):
    """Labelled documents without an equal text of good quality in their source."""
    d = _documents(spark, sf).select("doc_id", "source", F.md5("text").alias("content"))
    suite = d.join(_labelled(spark, sf), "doc_id", "left_semi")
    return audit.absent_from(suite, d.join(_labelled(spark, sf, "quality = 1"), "doc_id", "left_semi"), ["source", "content"]).select("doc_id", "source")


@states(f"""WITH {REC_SQL}, k AS (SELECT sha256({{0}}) AS p, sha256({{1}}) AS a, original_id, ord FROM rec)
SELECT original_id FROM k WHERE (p, a) NOT IN (SELECT (p, a) FROM k JOIN labels ON doc_id = ord WHERE quality = 1)""".format("lower(trim(regexp_replace(prompt, '\\s+', ' ', 'g')))", "lower(trim(regexp_replace(answer, '\\s+', ' ', 'g')))"))
def answers_without_raw_label(spark, sf):
    """Documents whose first line and rest are not those of a document of good quality."""
    d = records(spark, sf).select("ord", "original_id", T.digest(T.normal("prompt")).alias("prompt_key"), T.digest(T.normal("answer")).alias("answer_key"))
    return audit.raw_labels_differ(d, d.join(_labelled(spark, sf, "quality = 1"), F.col("ord") == F.col("doc_id"), "left_semi")).select("original_id")


@states("""WITH s AS (SELECT source || '-' || lang AS source, CASE WHEN quality = 0 THEN 'dev' ELSE 'train' END AS split FROM documents JOIN labels USING (doc_id))
SELECT source, split FROM (SELECT DISTINCT source FROM s), (SELECT unnest(['train', 'dev']) AS split) EXCEPT SELECT source, split FROM s""")
def empty_splits_of_labels(spark, sf):
    """Sources and languages without documents of one quality."""
    d = _documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return audit.empty_partitions(d.select(F.concat_ws("-", "source", "lang").alias("source"), F.when(F.col("quality") == 0, "dev").otherwise("train").alias("split")))


@states("SELECT doc_id AS pos, quality::VARCHAR AS left, toxic::VARCHAR AS right FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM toxic")
def labels_in_order(spark, sf):
    """Two lists by place: both labels of documents, where they differ."""
    d = table(spark, sf, "labels")
    return audit.order_differs(d.select(F.col("doc_id").alias("pos"), F.col("quality").cast("string").alias("k")), d.select(F.col("doc_id").alias("pos"), F.col("toxic").cast("string").alias("k")), "pos", "k")


@states("""SELECT lang, source, sum(x)::BIGINT AS extra FROM (SELECT lang, source, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS x FROM documents JOIN labels USING (doc_id)) GROUP BY ALL HAVING sum(x) <> 0""")
def labels_as_bags(spark, sf):
    """Languages and sources that one quality holds more often."""
    d = _documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    side = lambda q: d.filter(f"quality = {q}").select("lang", "source")
    return audit.bag_differs(side(1), side(0))


@states("""WITH k AS (SELECT md5(text) AS k, lang FROM documents) SELECT k, 'left' AS side FROM (SELECT k FROM k WHERE lang = 'en' EXCEPT SELECT k FROM k WHERE lang <> 'en')
UNION ALL SELECT k, 'right' FROM (SELECT k FROM k WHERE lang <> 'en' EXCEPT SELECT k FROM k WHERE lang = 'en')""")
def texts_as_sets(spark, sf):
    """Texts of one side of the languages only."""
    d = _documents(spark, sf).select(F.md5("text").alias("k"), "lang")
    return audit.set_differs(d.filter("lang = 'en'"), d.filter("lang <> 'en'"), "k")


@states("""WITH t AS (SELECT CASE doc_id % 6 WHEN 0 THEN 'choice' WHEN 1 THEN 'number' WHEN 2 THEN 'text' WHEN 3 THEN 'odd' WHEN 4 THEN 'choice' ELSE 'external' END AS kind,
  split_part(text, chr(10), 1) AS prompt, doc_id % 6 AS k, len(string_split(text, chr(10))) AS n, list_filter(string_split(text, chr(10)), lambda x: trim(x) = '') AS blank, n_chars FROM documents)
SELECT violation, count(*) AS n FROM (SELECT CASE WHEN kind = 'odd' THEN 'kind' WHEN trim(prompt) = '' THEN 'prompt' WHEN kind = 'choice' AND (n NOT BETWEEN 2 AND 26 OR len(blank) > 0) THEN 'choices'
  WHEN kind = 'choice' AND NOT (k = 0 AND n >= 3) THEN 'reference' WHEN kind = 'number' AND n_chars % 2 = 1 THEN 'reference' END AS violation FROM t) WHERE violation IS NOT NULL GROUP BY violation""")
def unsound_documents(spark, sf):
    """Documents as tasks of all kinds, lines as choices."""
    k = F.col("doc_id") % 6
    kind = F.when(k.isin(0, 4), "choice").when(k == 1, "number").when(k == 2, "text").when(k == 3, "odd").otherwise("external")
    reference = F.when(k == 0, "C").when(k == 4, "?").when(k == 1, F.when(F.col("n_chars") % 2 == 0, F.col("n_chars").cast("string")).otherwise("many")).otherwise("x")
    d = _documents(spark, sf).select(kind.alias("kind"), F.split("text", "\n")[0].alias("prompt"), F.split("text", "\n", -1).alias("choices"), reference.alias("reference"))
    return audit.bad_tasks(d).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@states("SELECT source, n_chars AS id, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def repeated_lengths(spark, sf):
    """Identities that are not unique: source and length."""
    return audit.duplicate_identity(_documents(spark, sf).withColumn("id", F.col("n_chars")))


@states("""WITH l AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'data/train-' || source WHEN 1 THEN '../train/' || source WHEN 2 THEN 'data/test-' || source WHEN 3 THEN 'data/' || source ELSE 'data/train/' || lang END AS path,
  CASE WHEN doc_id % 11 = 0 THEN 'dev' ELSE 'train' END AS split, CASE WHEN doc_id % 13 = 0 THEN 'none' ELSE sha256(text) END AS digest FROM documents)
SELECT doc_id, CASE WHEN split <> 'train' THEN 'split' WHEN doc_id % 5 = 2 THEN 'held-out file' WHEN doc_id % 5 = 1 THEN 'path escape' WHEN doc_id % 5 = 3 THEN 'not a train file' ELSE 'digest' END AS violation
FROM l WHERE split <> 'train' OR doc_id % 5 IN (1, 2, 3) OR digest = 'none'""")
def lock_of_documents(spark, sf):
    """A lock row for each document, with paths, splits and digests that break each rule."""
    k = F.col("doc_id") % 5
    path = F.when(k == 0, F.concat(F.lit("data/train-"), "source")).when(k == 1, F.concat(F.lit("../train/"), "source")).when(k == 2, F.concat(F.lit("data/test-"), "source")).when(k == 3, F.concat(F.lit("data/"), "source")).otherwise(F.concat(F.lit("data/train/"), "lang"))
    d = _documents(spark, sf).select("doc_id", path.alias("path"), F.when(F.col("doc_id") % 11 == 0, "dev").otherwise("train").alias("original_split"), F.when(F.col("doc_id") % 13 == 0, "none").otherwise(F.sha2("text", 256)).alias("sha256"))
    return audit.bad_locks(d).select("doc_id", "violation")


@states("""WITH f AS (SELECT lang AS family, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS weight FROM documents GROUP BY lang)
SELECT family, round(weight, 9) AS weight FROM f WHERE abs(weight - 1.0 / (SELECT count(*) FROM f)) > 1e-9""")
def shares_of_languages(spark, sf):
    """Languages off an equal share of the documents."""
    d = _documents(spark, sf)
    n = d.count()
    return audit.wrong_weights(d.groupBy("source", F.col("lang").alias("family")).agg((F.count(F.lit(1)) / n).alias("weight"))).withColumn("weight", F.round("weight", 9))


@states("""WITH q AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT CASE WHEN regexp_matches(line, '[0-9]') THEN 'number' ELSE 'text' END AS t, CASE WHEN length(line) > 100 THEN 'long' ELSE 'short' END AS s, length(line) AS n FROM q)
SELECT 'answer_type' AS kind, t AS value, count(*) AS n FROM k GROUP BY t UNION ALL SELECT 'scale', s, count(*) FROM k GROUP BY s UNION ALL SELECT 'total', 'questions', count(*) FROM k
UNION ALL SELECT 'total', 'within', count(*) FILTER (n <= 80) FROM k UNION ALL SELECT 'total', 'contexts', count(*) FROM documents""")
def screened_lines(spark, sf):
    """Lines of documents as questions, by type and scale, and how many are short enough."""
    one = lambda x: F.struct(x.alias("question"), F.when(x.rlike("[0-9]"), "number").otherwise("text").alias("answer_type"), F.when(F.length(x) > 100, "long").otherwise("short").alias("scale"))
    d = _documents(spark, sf).select(F.transform(F.split("text", "\n", -1), one).alias("questions"))
    return audit.answer_kinds(d, F.length("q.question"), 80)


@states("SELECT count(*)::BIGINT AS rows, sum(n_chars)::BIGINT AS bytes, count(DISTINCT source) AS sources FROM documents")
def totals_of_documents(spark, sf):
    """Totals of what each source and language has."""
    return audit.campaign_totals(_documents(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("bytes")))


@states("SELECT source, coalesce(count(*) FILTER (toxic = 1), 0) + CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN count(*) ELSE 0 END AS v FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def merged_counts(spark, sf):
    """Documents of sources, overwritten by their toxic ones where there are any."""
    d = _documents(spark, sf)
    per = lambda x: x.groupBy("source").agg(F.count(F.lit(1)).alias("v"))
    return sinks.merged_sources(per(d), per(d.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id")), "source", "v")


# ---- measures -------------------------------------------------------------------------------------------------------
@states("""WITH d AS (SELECT source, quality = 1 AS good, trim(text) <> '' AS nonempty, n_chars / 8.0::DOUBLE AS f FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'good' AS proxy, count(good) AS n, count(*) FILTER (good) AS positive, NULL::DOUBLE AS mean FROM d UNION ALL SELECT 'nonempty', count(nonempty), count(*) FILTER (nonempty), NULL FROM d
UNION ALL SELECT source || '_f', count(*), 0, avg(f) FROM d WHERE source IN ('src0', 'src3') GROUP BY source""")
def proxies_of_documents(spark, sf):
    """Flags counted where they are known, and means of one source each."""
    d = _documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select("source", (F.col("quality") == 1).alias("good"), (F.trim("text") != "").alias("nonempty"), (F.col("n_chars") / 8.0).alias("f"))
    return scoring.proxies(d, ["good", "nonempty"], {"src0": "f", "src3": "f"})


@states("""SELECT sum((quality = 1)::INT)::BIGINT AS before_correct, sum((quality = 1 OR toxic = 0)::INT)::BIGINT AS after_correct, count(*)::BIGINT AS before_scored, count(*)::BIGINT AS after_scored,
(sum((quality = 1 OR toxic = 0)::INT) - sum((quality = 1)::INT))::BIGINT AS additional, true AS comparable FROM documents JOIN labels USING (doc_id)""")
def gained_labels(spark, sf):
    """Documents that a laxer rule accepts as well."""
    d = _documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    per = lambda c: d.groupBy("source").agg(F.count_if(F.expr(c)).alias("correct"), F.count(F.lit(1)).alias("scored"))
    return scoring.additional_correct(per("quality = 1"), per("quality = 1 OR toxic = 0"))


@states("""WITH d AS (SELECT source, CASE WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS status, len(string_split(text, chr(10))) AS cases FROM documents JOIN labels USING (doc_id))
SELECT source, status, count(*) AS n, sum(cases)::BIGINT AS cases, count(*) FILTER (status = 'passed' AND cases > 1) AS stronger_passes FROM d GROUP BY ALL""")
def test_rollup_of_documents(spark, sf):
    """Labelled documents as tasks, their lines as cases."""
    n = F.size(F.split("text", "\n", -1))
    d = _documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return scoring.test_rollup(d.select("source", F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("status"), F.when(n > 1, "several").otherwise("single_original_case_only").alias("coverage"), n.alias("cases")))


# ---- telemetry ------------------------------------------------------------------------------------------------------
@states("""WITH r AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'light' ELSE 'off' END AS mode, count(*) AS n, min(event_type) AS env, CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY user_id)
SELECT a.user_id, array_to_string(list_filter([CASE WHEN a.mode <> b.mode THEN 'mode' END, CASE WHEN a.n <> b.n THEN 'warmup_steps' END, CASE WHEN a.env <> b.env THEN 'metadata.environment' END,
CASE WHEN a.status <> 'completed' OR b.status <> 'completed' THEN 'incomplete_run' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r a JOIN r b ON b.user_id = a.user_id + 1""")
def reports_of_users(spark, sf):
    """Reports of users against that of the next user."""
    d = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_type").alias("environment"))
    report = F.struct(F.lit(1).alias("schema"), F.when(F.col("user_id") % 2 == 0, "light").otherwise("off").alias("mode"), F.col("n").alias("warmup_steps"), F.lit(60.0).alias("flush_seconds"), F.lit(None).cast("double").alias("detail_limit_seconds"), F.lit("w").alias("workload"), "environment", F.lit("m").alias("monitoring_source_sha256"), F.when(F.col("user_id") % 7 == 0, "failed").otherwise("completed").alias("status"))
    r = d.select("user_id", report.alias("a"))
    j = r.join(r.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b")), "user_id")
    return j.select("user_id", F.array_join(telemetry.mismatches(), ",").alias("reasons"))


@states("""WITH r AS (SELECT user_id, max(epoch(ts)) AS h, arg_max(event_type, event_id) AS e FROM events GROUP BY user_id), n AS (SELECT max(epoch(ts)) AS now FROM events)
SELECT user_id, now - h <= 7200 AS fresh, e = 'click' AND now - h <= 7200 AND user_id % 3 > 0 AS live, e = 'error' AS recoverable FROM r, n""")
def liveness_of_users(spark, sf):
    """Users with a click last are running, with an error paused; a third has no process."""
    d = table(spark, sf, "events")
    now = d.agg(F.max(F.col("ts").cast("timestamp").cast("double")).alias("now")).first()["now"]
    last = d.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp").cast("double")).alias("h"), F.max_by("event_type", "event_id").alias("e"))
    status = F.when(F.col("e") == "click", "running").when(F.col("e") == "error", "paused").otherwise("done")
    s = telemetry.live_state(status, F.col("h"), F.col("user_id") % 3 > 0, F.lit(now), 7200)
    return last.select("user_id", *[s[k].alias(k) for k in ("fresh", "live", "recoverable")])


@states("""SELECT user_id::VARCHAR AS run, arg_min(event_id, (value, event_id)) AS best_step, min(value) AS best_loss, max(event_id) AS last_step, max(value * 2) AS peak, quantile_cont(value, 0.5) AS median_speed
FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def extremes_of_users(spark, sf):
    """Best and last events of users."""
    d = table(spark, sf, "events").filter("value IS NOT NULL").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("pos"), F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.col("value") * 2).alias("peak"), F.col("value").alias("speed"))
    return telemetry.extremes(d, "run")


@states("""WITH c AS (SELECT coalesce(kind, '') AS name, coalesce(client_id, -1)::VARCHAR AS source, arrived_at < TIMESTAMP '2024-03-01' AS early FROM clicks),
x AS (SELECT name, source, count(*) AS t FROM c WHERE early GROUP BY ALL), y AS (SELECT name, source, count(*) AS t FROM c WHERE NOT early GROUP BY ALL)
SELECT name, source, coalesce(y.t, 0) - coalesce(x.t, 0) AS delta, y.t IS NULL OR y.t < coalesce(x.t, 0) AS violation FROM x FULL JOIN y USING (name, source)""")
def added_clicks(spark, sf):
    """Clicks of kinds and clients before and after the first of March; fewer, or none, is a violation."""
    d = table(spark, sf, "clicks").select(F.coalesce("kind", F.lit("")).alias("name"), F.coalesce("client_id", F.lit(-1)).cast("string").alias("source"), F.expr("arrived_at < TIMESTAMP_NTZ '2024-03-01'").alias("early"))
    per = lambda c: d.filter(c).groupBy("name", "source").agg(F.count(F.lit(1)).alias("tokens"))
    return telemetry.work_delta(per("early"), per("NOT early"))


@states("""WITH g AS (SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(event_id // 100) AS r0, max(event_id // 100) AS r1, CASE WHEN user_id % 2 = 0 THEN 128 ELSE 64 END AS n FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, last < first / 2 AND r1 >= r0 + 10 AND n = 128 AS passed FROM g""")
def gates_of_users(spark, sf):
    """Values as losses, hundreds of events as recalls."""
    d = table(spark, sf, "events").filter("value IS NOT NULL").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("loss"), F.floor(F.col("event_id") / 100).alias("recall"), F.when(F.col("user_id") % 2 == 0, 128).otherwise(64).alias("n"))
    return telemetry.learning_gate(d, "user_id").select("user_id", "passed")


@states("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Tool ' || page_id WHEN 1 THEN 'run ' || page_id WHEN 2 THEN CASE WHEN url LIKE '%/' THEN '' ELSE regexp_extract(url, '([^/]*)$', 1) END ELSE 'p' || page_id END AS name FROM pages""")
def process_names_of_pages(spark, sf):
    """commands of bundles, quoted paths, addresses and plain names."""
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    command = F.when(k == 0, F.concat(F.lit("/Applications/Tool "), n, F.lit(".app/Contents/MacOS/x --y"))).when(k == 1, F.concat(F.lit('"/opt/my dir/run '), n, F.lit('" -v'))).when(k == 2, F.concat("url", F.lit(" -m x"))).otherwise(F.concat(F.lit("p"), n))
    return table(spark, sf, "pages").select("page_id", telemetry.process_name(command).alias("name"))


_SESSIONS = [(1704067200.0, 1704500000.0), (1704600000.0, 1705000000.5), (1705500000.0, 1706000000.0)]


@states("SELECT event_id, round(" + " + ".join(f"greatest(0.0::DOUBLE, least(epoch(ts), {b}::DOUBLE) - {a}::DOUBLE)" for a, b in _SESSIONS) + ", 3) AS seconds FROM events")
def active_seconds_of_events(spark, sf):
    """seconds inside three sessions up to each event."""
    return table(spark, sf, "events").select("event_id", F.round(telemetry.elapsed(_SESSIONS, F.col("ts").cast("timestamp").cast("double")), 3).alias("seconds"))


@states("SELECT event_id, round(least(1.0, greatest(0.0, greatest(event_id / 20000.0::DOUBLE, (epoch(ts) - 1704067200.0::DOUBLE) / 2000000.0::DOUBLE))), 9) AS fraction FROM events")
def schedule_of_events(spark, sf):
    """how much of a run is done by the events' numbers or its clock, whichever is further."""
    f = telemetry.schedule_fraction("event_id", 20000, 1704067200, 1706067200, F.col("ts").cast("timestamp").cast("double"))
    return table(spark, sf, "events").select("event_id", F.round(f, 9).alias("fraction"))


@states("SELECT source, doc_id::VARCHAR AS id FROM documents ORDER BY source, doc_id")
def documents_as_sorted_tasks(spark, sf):
    """O1: tasks by source, then by their id as a number."""
    return splits.sorted_tasks(_documents(spark, sf).select("source", F.col("doc_id").cast("string").alias("id")))


@states("""WITH p AS (SELECT lang AS path, sum(n_chars)::DOUBLE AS t FROM documents GROUP BY lang UNION ALL SELECT lang || '/' || source, sum(n_chars)::DOUBLE FROM documents GROUP BY ALL)
SELECT p.path, p.t AS inclusive, p.t - coalesce((SELECT sum(c.t) FROM p c WHERE regexp_replace(c.path, '/[^/]*$', '') = p.path AND c.path <> p.path), 0) AS self FROM p ORDER BY self DESC, path""")
def phases_by_self_time(spark, sf):
    """Characters of languages and their sources as phases, the longest own share first."""
    d = _documents(spark, sf)
    per = lambda *c: d.groupBy(F.concat_ws("/", *c).alias("path")).agg(F.sum("n_chars").cast("double").alias("inclusive"))
    return telemetry.by_self_time(per("lang").unionByName(per("lang", "source")))
