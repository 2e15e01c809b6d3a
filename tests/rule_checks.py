"""Queries of readers, sinks, joins, audits and measures over small fixed rows, each with the rows it has to give."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import tokens as K
from corpusloom.operators import audit, dedup, grading, scoring, splits, telemetry
from rule_cases import literal
from corpusloom.sources import converters, readers, sinks
from corpusloom.storage import shared_dir
from corpusloom.streaming import telemetry as streams

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def gives(columns: str, *rows: tuple):
    """Register the decorated query with the rows that it has to give; columns: `name type, ...`."""
    names = [c.rsplit(" ", 1) for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(literal(v, k) for v, (_, k) in zip(r, names, strict=True)) + ")" for r in rows)
    quoted = ", ".join(f'"{n}"' for n, _ in names)
    sql = f"SELECT * FROM (VALUES {values}) t({quoted})"
    if not rows:
        sql = f"SELECT {', '.join(f'{literal(None, k)} AS {n}' for n, k in names)} WHERE false"

    def put(f):
        QUERIES[f.__name__] = (lambda spark, sf: f(spark, sf).select(*[F.col(n).cast(k).alias(n) for n, k in names]), sql)
        return f

    return put


def _frame(spark: SparkSession, ddl: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusloom/files-{uuid4().hex}"


def _written(spark: SparkSession, *lines: str) -> str:
    """A text file with these lines in the shared folder."""
    path = _folder(spark)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


# ---- readers --------------------------------------------------------------------------------------------------------
@gives("x int, y string", (1, "a"), (2, None), (3, "c"))
def read_json_lines(spark, sf):
    """Two files, blank lines skipped."""
    return readers.json_lines(spark, [_written(spark, '{"x": 1, "y": "a"}', "", '{"x": 2}'), _written(spark, '{"x": 3, "y": "c"}')], "x INT, y STRING")


@gives("key string, v int", ("k1", 1), ("k2", 2))
def read_json_object(spark, sf):
    """S7."""
    return readers.json_objects(spark, _written(spark, '{"k1": {"v": 1},', ' "k2": {"v": 2}}'), "struct<v:int>")


@gives("a string, b string", ("1", "x\ny"), ("2", 'say "no"'))
def read_csv(spark, sf):
    """Quoted line ends and quotes."""
    return readers.csv(spark, _written(spark, "a,b", '1,"x', 'y"', '2,"say ""no"""'))


@gives("uid bigint, x int", (0, 5), (1, 7), (2, 6))
def read_numbered_lines(spark, sf):
    """S9."""
    return readers.numbered_lines(spark, _written(spark, '{"x": 5}', "", '{"x": 7}', '{"x": 6}'), "x INT")


@gives("x int, broken boolean", (1, False), (2, False), (None, True))
def read_log(spark, sf):
    """A partial last line is marked, not an error."""
    return readers.log_lines(spark, _written(spark, '{"x": 1}', '{"x": 2}', '{"x": 3'), "x INT").select("x", F.col("_corrupt").isNotNull().alias("broken"))


@gives("ids string", ("25185,2659",))
def read_flat_tokens(spark, sf):
    """Little-endian numbers of two bytes; the file holds `abc` and a line end."""
    return readers.flat_tokens(spark, _written(spark, "abc") + "/*.txt").select(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@gives("length bigint, sha256 string", (4, "edeaaff3f1774ad2888673770c6d64097e391bc362d7d6fb34982ddf0efd18cb"))
def file_checksums(spark, sf):
    """Of a file of `abc` and a line end."""
    return readers.file_digests(spark, _written(spark, "abc") + "/*.txt")


@gives("path string", ("gone",), ("here",))
def changed_files(spark, sf):
    """V5: one file changed, one is missing, one is as the manifest says."""
    files = _frame(spark, "path string, content binary", ("here", b"x"), ("same", b"abc"))
    return audit.files_changed(files, _frame(spark, "path string, sha256 string", ("here", "0" * 64), ("gone", "1" * 64), ("same", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")))


@gives("ordinal int, text string, label string", (0, "a", "x"), (1, "b", "y"))
def paired_files(spark, sf):
    """Two files by position."""
    return converters.pair_ordered(_frame(spark, "ordinal int, text string", (0, "a"), (1, "b")), _frame(spark, "ordinal int, label string", (1, "y"), (0, "x")))


@gives("rows bigint, keys string", (3, "a,b"))
def counted_and_projected(spark, sf):
    """The number of rows without reading a column, and one column as a set."""
    path = _folder(spark)
    _frame(spark, "k string, v int", ("a", 1), ("b", 2), ("a", 3)).write.parquet(path)
    keys = readers.parquet(spark, path, ["k"]).agg(F.array_join(F.sort_array(F.collect_set("k")), ",").alias("keys"))
    return keys.withColumn("rows", F.lit(readers.row_count(spark, path)))


@gives("id string, v string", ("123456789012345678901234567890", "1,22222222222222222222"), (None, None))
def json_big_integers(spark, sf):
    """integers of any size stay as they are written."""
    d = _frame(spark, "t string", ('{"id": 123456789012345678901234567890, "v": [1, 22222222222222222222]}',), ("not json",))
    return d.select(F.from_json("t", "struct<id:string,v:array<string>>").alias("j")).select("j.id", F.array_join("j.v", ",").alias("v"))


# ---- sinks ----------------------------------------------------------------------------------------------------------
@gives("source string, split string, ord bigint, text string", ("a", "dev", 1, "é\n"), ("a", "train", 2, ""), ("b", "train", 3, None))
def partitioned_round_trip(spark, sf):
    """Written by source and split, read back."""
    path = _folder(spark)
    sinks.partitioned(_frame(spark, "ord long, text string, source string, split string", (1, "é\n", "a", "dev"), (2, "", "a", "train"), (3, None, "b", "train")), path)
    return readers.parquet(spark, path)


@gives("source string, ord bigint, ids string, answer_start int, token_offset bigint, token_length bigint", ("a", 0, "1,9,3", 2, 0, 3), ("a", 1, "9,4", 1, 3, 2), ("b", 0, "7,9", 2, 0, 2))
def token_store_round_trip(spark, sf):
    """Ids with the place of the answer and the running offset, written and read back; V6 finds no difference."""
    d = _frame(spark, "source string, split string, ord long, ids array<int>", ("a", "train", 0, [1, 9, 3]), ("a", "train", 1, [9, 4]), ("b", "train", 0, [7, 9]))
    d = d.withColumn("answer_start", K.answer_start(F.col("ids"), 9)).withColumn("token_length", F.size("ids").cast("bigint"))
    d = splits.offsets(d, ["source", "split"], "token_length", ["ord"])
    path = _folder(spark)
    sinks.token_store(d, path)
    back = readers.parquet(spark, path)
    back = back.join(audit.mask_differs(back, d).select("source", "ord"), ["source", "ord"], "left_anti")
    return back.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@gives("source string, ord bigint", ("a", 1), ("b", 5))
def stored_ids_differ(spark, sf):
    """V6: records whose stored ids or answer start are not those of encoding anew, or that are missing."""
    ddl = "source string, ord long, ids array<int>, answer_start int"
    return audit.mask_differs(_frame(spark, ddl, ("a", 0, [1, 2], 1), ("a", 1, [1, 2], 1)), _frame(spark, ddl, ("a", 0, [1, 2], 1), ("a", 1, [1, 2], 2), ("b", 5, [1], 0)))


@gives("x int, t string", (1, "é \"q\"\n"), (2, None))
def json_round_trip(spark, sf):
    """K1/S5."""
    path = _folder(spark)
    sinks.json_lines(_frame(spark, "x int, t string", (1, "é \"q\"\n"), (2, None)), path)
    return readers.json_lines(spark, path, "x INT, t STRING")


@gives("ord bigint, t string", (0, "p"), (5, "q"), (6, "n"), (8, "m"))
def parent_and_new(spark, sf):
    """Parent rows keep their places, new ones follow; V4 finds no changed prefix."""
    parent = _frame(spark, "ord long, t string", (0, "p"), (5, "q"))
    child = sinks.parent_then_new(parent, _frame(spark, "ord long, t string", (0, "n"), (2, "m")))
    return child.join(audit.prefix_changed(parent, child, "ord", "t").select("ord"), "ord", "left_anti")


@gives("ord bigint", (1,), (2,))
def changed_prefix(spark, sf):
    """V4: parent rows that are gone or changed."""
    return audit.prefix_changed(_frame(spark, "ord long, t string", (0, "a"), (1, "b"), (2, "c")), _frame(spark, "ord long, t string", (0, "a"), (1, "x"), (3, "d")), "ord", "t")


@gives("k string, v int", ("a", 1), ("b", 3), ("c", 4))
def merged_maps(spark, sf):
    """The right side wins."""
    return sinks.merged_sources(_frame(spark, "k string, v int", ("a", 1), ("b", 2)), _frame(spark, "k string, v int", ("b", 3), ("c", 4)), "k", "v")


@gives("pos int, session int, segment int", (0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 1, 2), (5, 2, 3), (6, 2, 3))
def stream_resumed(spark, sf):
    """A log read as a stream, stopped, gone on with after more lines came, the last one incomplete."""
    import json

    def lines(*rows):
        return [(json.dumps({"run": "r", "event": e, "time": f"2026-01-01T00:{s // 60:02}:{s % 60:02}Z", "pos": p, "step": p, "tokens": 0, "speed": 1.0}),) for p, e, s in rows]

    log, out, checkpoint = (_folder(spark) for _ in range(3))
    for part in (lines((0, "start", 0), (1, "train", 10), (2, "train", 70)), [*lines((3, "train", 400), (4, "finished", 410), (5, "start", 500), (6, "train", 510)), ('{"run": "r", "ev',)]):
        spark.createDataFrame(part, "value string").coalesce(1).write.mode("append").text(log)
        streams.results_sink(streams.segments_stream(streams.log_stream(spark, log)), out, checkpoint).start().awaitTermination()
    return spark.read.parquet(out)


@gives("weights string, files int", ('{"a": 2.0}', 1))
def manifest_view(spark, sf):
    """K5: other weights over the same files."""
    import json

    files = _frame(spark, "path string, sha256 string", ("a/train.parquet", "0" * 64))
    m = sinks.view_of(sinks.manifest(files, _frame(spark, "source string, split string, records int", ("a", "train", 3)), "v1"), {"a": 2.0})
    return _frame(spark, "weights string, files int", (json.dumps(m["weights"]), len(m["files"])))


@gives("source string, id string, place int", ("a", "x", 0), ("a", "2", 1), ("a", "10", 2), ("b", "1", 3))
def task_order(spark, sf):
    """O1: by source, then by the id as a number."""
    d = splits.sorted_tasks(_frame(spark, "source string, id string", ("b", "1"), ("a", "10"), ("a", "2"), ("a", "x")))
    return _frame(spark, "source string, id string, place int", *[(r.source, r.id, i) for i, r in enumerate(d.collect())])


@gives("path string, place int", ("a", 0), ("a/b", 1), ("a/b/c", 2))
def phase_order(spark, sf):
    """The longest own time first."""
    d = telemetry.by_self_time(_frame(spark, "path string, inclusive double", ("a/b/c", 5.0), ("a", 60.0), ("a/b", 20.0)))
    return _frame(spark, "path string, place int", *[(r.path, i) for i, r in enumerate(d.collect())])


# ---- joins and identities -------------------------------------------------------------------------------------------
@gives("source string, original_id string, prompt string", ("mbpp", "1", "p\n\nRequired function name: f"), ("mbpp", "2", "q"), ("apps", "1", "r"))
def interface_prompts(spark, sf):
    """The name that the first assertion calls and the program defines goes into the prompt."""
    tasks = _frame(spark, "source string, original_id string, test string, code string", ("mbpp", "1", "assert g(f(1)) == 2", "def f(x): return x"), ("mbpp", "2", "assert len([]) == 0", "def f(): pass"))
    names = tasks.select("source", "original_id", T.called_name("test", "code").alias("name"))
    return T.with_interface(_frame(spark, "source string, original_id string, prompt string", ("mbpp", "1", "p"), ("mbpp", "2", "q"), ("apps", "1", "r")), names)


@gives("id string", ("b",))
def without_corpus_rows(spark, sf):
    """J10/P11."""
    return dedup.without_duplicates_of(_frame(spark, "id string, key string", ("a", "k1"), ("b", "k2"), ("c", "k1")), _frame(spark, "key string", ("k1",), ("k3",)))


@gives("id int", (1,), (3,), (5,))
def code_overlap_groups(spark, sf):
    """The whole held-out group goes if one of its programs is in train."""
    d = _frame(spark, "id int, group string, split string, program string", (1, "t", "train", "x = 1"), (2, "d", "dev", "x=1"), (3, "e", "dev", "y = 2"), (4, "d", "dev", "z = 3"), (5, "f", "dev", "no (parse"))
    return dedup.code_overlap(d.withColumn("code_key", T.code_key("program")))


@gives("id string, status string", ("1", "match"), ("2", "mismatch"), ("3", "missing_table"), ("4", "candidate_failed"))
def results_on_tables(spark, sf):
    """J5/G10."""
    results = _frame(spark, "id string, actual array<string>, reference_sql string", ("1", ["b", "a"], "SELECT x"), ("2", ["b", "a"], "SELECT x ORDER BY x"), ("3", ["a"], "SELECT x"), ("4", None, "SELECT x"))
    return grading.compare_on_tables(results, _frame(spark, "id string, expected array<string>", ("1", ["a", "b"]), ("2", ["a", "b"]), ("4", ["a"])))


@gives("source string, id string, before string, after string, changed boolean", ("a", "1", "correct", "correct", False), ("a", "2", "correct", "incorrect", True), ("b", "1", None, "format_error", True))
def rescored(spark, sf):
    """J4."""
    results = _frame(spark, "source string, id string, generated string, status string", ("a", "1", "yes", "correct"), ("a", "2", "no", "correct"), ("b", "1", "x\ny", None), ("c", "9", "x", "correct"))
    tasks = _frame(spark, "source string, id string, kind string, reference string, choices array<string>", ("a", "1", "text", "Yes", None), ("a", "2", "text", "yes", None), ("b", "1", "text", "x", None))
    return grading.rescore(results, tasks, grading.grade("kind", grading.contract_line("generated"), "reference", "choices")["status"])


@gives("source string, id string, metric string", ("gsm8k", "2", "final_answer_match"), ("go_emotions", "3", "emotion_label_set_exact_and_f1"))
def self_scored(spark, sf):
    """References that their scorer cannot read or does not accept."""
    ddl = "source string, id string, answer string, answers array<string>, choices array<string>, original_labels array<string>"
    return grading.self_scores(_frame(spark, ddl, ("gsm8k", "1", "x #### 5", None, None, None), ("gsm8k", "2", "five", None, None, None), ("go_emotions", "3", "joy", None, None, ["joy", "love"]), ("mbpp", "4", "x = 1", None, None, None), ("squad", "5", "a", ["a"], None, None)))


@gives("source string, id string, reason string, cases int", ("apps", "1", None, 2), ("apps", "2", "function_interface", 1), ("apps", "3", "unaligned_tests", 2))
def code_task_references(spark, sf):
    """Tasks with the references of the held-out records that name them; others have none and stay out."""
    raw = _frame(spark, "source string, id string, fn_name string, inputs array<string>, outputs array<string>", ("apps", "1", None, ["1", "2"], ["3", "4"]), ("apps", "2", "f", ["1"], ["2"]), ("apps", "3", None, ["1", "2"], ["3"]), ("apps", "4", None, [], []))
    dev = _frame(spark, "source string, original_id string, variant int, answer string", ("apps", "1", 1, "b"), ("apps", "1", 0, "a"), ("apps", "2", 0, "c"), ("apps", "3", 0, "d"))
    return converters.code_tasks(raw, dev).select("source", "id", "reason", F.size("cases").alias("cases"))


@gives("id string, coverage string, shown string, scored int", ("1", "stronger", "1", 2), ("2", "several", "5", 1), ("3", "single", "7", 0))
def boundary_cases(spark, sf):
    """Extra cases, coverage, and the first case shown."""
    kind = "array<struct<input:string,output:string>>"
    tasks = _frame(spark, f"id string, cases {kind}", ("1", [("1", "2"), ("3", "4")]), ("2", [("5", "6"), ("6", "7")]), ("3", [("7", "8")]))
    out = converters.public_example(converters.with_boundary_cases(tasks, _frame(spark, f"id string, extra_cases {kind}", ("1", [("0", "0")]))))
    return out.select("id", "coverage", F.col("shown.input").alias("shown"), F.size("scored").alias("scored"))


@gives("source string, split string", ("hotpotqa", "train"), ("squad", "dev"))
def hotpot_train(spark, sf):
    """D12."""
    return converters.hotpot_to_train(_frame(spark, "source string, split string", ("hotpotqa", "dev"), ("squad", "dev")))


# ---- audits ---------------------------------------------------------------------------------------------------------
@gives("source string, split string", ("a", "dev"), ("b", "train"), ("c", "train"))
def manifest_counts(spark, sf):
    """V2: a wrong count, and splits that one side lacks."""
    mine = _frame(spark, "source string, split string, records long", ("a", "train", 2), ("a", "dev", 1), ("b", "train", 4))
    return audit.counts_differ(mine, _frame(spark, "source string, split string, records long", ("a", "train", 2), ("a", "dev", 3), ("c", "train", 1)), ["source", "split"], ["records"])


@gives("source string, original_id string", ("a", "2"))
def suite_rows_absent(spark, sf):
    """Suite rows whose content the partition does not hold."""
    suite = _frame(spark, "source string, original_id string, content string", ("a", "1", "x"), ("a", "2", "y"))
    return audit.absent_from(suite, _frame(spark, "source string, original_id string, content string", ("a", "1", "x"), ("a", "2", "z")), ["source", "original_id", "content"])


@gives("original_id string", ("2",))
def raw_label_differs(spark, sf):
    """An answer that is none of its prompt's raw references."""
    kept = _frame(spark, "prompt_key string, answer_key string, original_id string", ("p", "a", "1"), ("p", "c", "2"), ("q", "b", "3"))
    return audit.raw_labels_differ(kept, _frame(spark, "prompt_key string, answer_key string", ("p", "a"), ("p", "b"), ("q", "b")))


@gives("source string, split string", ("b", "dev"))
def empty_splits(spark, sf):
    """V16."""
    return audit.empty_partitions(_frame(spark, "source string, split string", ("a", "train"), ("a", "dev"), ("b", "train")))


@gives("pos int, left string, right string", (1, "b", "c"), (2, None, "d"))
def list_order(spark, sf):
    """Two lists by place."""
    return audit.order_differs(_frame(spark, "pos int, k string", (0, "a"), (1, "b")), _frame(spark, "pos int, k string", (0, "a"), (1, "c"), (2, "d")), "pos", "k")


@gives("k string, side string", ("a", "left"), ("c", "right"))
def set_differences(spark, sf):
    """U7."""
    return audit.set_differs(_frame(spark, "k string", ("a",), ("b",), ("b",)), _frame(spark, "k string", ("b",), ("c",)), "k")


@gives("v int, extra int", (1, 1), (2, -1))
def bag_differences(spark, sf):
    """Rows that one side holds more often."""
    return audit.bag_differs(_frame(spark, "v int", (1,), (1,), (2,), (None,)), _frame(spark, "v int", (1,), (2,), (2,), (None,)))


@gives("violation string, n int", ("kind", 1), ("prompt", 1), ("choices", 1), ("reference", 2))
def unsound_tasks(spark, sf):
    """P7."""
    ddl = "kind string, prompt string, choices array<string>, reference string"
    tasks = _frame(spark, ddl, ("choice", "p", ["x", "y"], "B"), ("choice", "p", ["x", "y"], "C"), ("choice", "p", ["x"], "A"), ("number", "p", None, "z"), ("number", "p", None, "4"), ("odd", "p", None, None), ("text", " ", None, "x"))
    return audit.bad_tasks(tasks).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@gives("source string, id string, n bigint", ("a", "1", 2))
def repeated_identities(spark, sf):
    """P8."""
    return audit.duplicate_identity(_frame(spark, "source string, id string", ("a", "1"), ("a", "1"), ("b", "1"), ("a", "2")))


@gives("violation string", ("digest",), ("held-out file",), ("path escape",), ("split",))
def lock_rows(spark, sf):
    """V14/P6/S16."""
    ok = "0" * 64
    return audit.bad_locks(_frame(spark, "path string, original_split string, sha256 string", ("data/train-1.parquet", "train", ok), ("../train.parquet", "train", ok), ("data/test.parquet", "train", ok), ("train.parquet", "dev", ok), ("train.parquet", "train", "x")))


@gives("family string, weight double", ("f", 0.75), ("*", 1.25))
def family_weights(spark, sf):
    """Families off an equal share, and the sum."""
    return audit.wrong_weights(_frame(spark, "source string, family string, weight double", ("a", "f", 0.25), ("b", "f", 0.5), ("c", "g", 0.5))).withColumn("weight", F.round("weight", 9))


@gives("kind string, value string, n int", ("answer_type", "span", 2), ("answer_type", "count", 1), ("scale", "", 2), ("scale", "million", 1), ("total", "questions", 3), ("total", "within", 1), ("total", "contexts", 2))
def screened_answers(spark, sf):
    """Answers by type and scale, and how many questions fit."""
    d = _frame(spark, "context string, questions array<struct<question:string,answer_type:string,scale:string>>", ("one two", [("a b", "span", ""), ("c", "count", "")]), ("three " * 3, [("d", "span", "million")]))
    return audit.answer_kinds(d, F.size(F.split(F.concat_ws(" ", F.trim("context"), "q.question"), " ")), 3)


@gives("rows int, bytes int, sources int", (60, 900, 2))
def collected_totals(spark, sf):
    """A31."""
    return audit.campaign_totals(_frame(spark, "source string, rows int, bytes int", ("a", 10, 100), ("a", 20, 300), ("b", 30, 500)))


# ---- measures -------------------------------------------------------------------------------------------------------
@gives("proxy string, n int, positive int, mean double", ("syntax_valid", 2, 1, None), ("nonempty", 1, 1, None), ("samsum_token_f1", 2, 0, 0.25))
def answer_proxies(spark, sf):
    """A14."""
    d = _frame(spark, "source string, syntax_valid boolean, nonempty boolean, token_f1 double", ("apps", True, None, None), ("apps", False, None, None), ("piqa", None, True, None), ("samsum", None, None, 0.5), ("samsum", None, None, 0.0), ("squad", None, None, 1.0))
    return scoring.proxies(d, ["syntax_valid", "nonempty"], {"samsum": "token_f1"})


@gives("before_correct int, after_correct int, additional int, comparable boolean", (5, 9, 4, True))
def gained_answers(spark, sf):
    """A19."""
    return scoring.additional_correct(_frame(spark, "source string, correct int, scored int", ("a", 2, 10), ("b", 3, 10)), _frame(spark, "source string, correct int, scored int", ("a", 5, 12), ("b", 4, 8)))


@gives("source string, status string, n int, cases int, stronger_passes int", ("apps", "passed", 2, 6, 1), ("apps", "timeout", 1, 3, 0), ("mbpp", "passed", 1, 1, 0))
def code_test_rollup(spark, sf):
    """A29."""
    return scoring.test_rollup(_frame(spark, "source string, status string, coverage string, cases int", ("apps", "passed", "several", 5), ("apps", "passed", "single_original_case_only", 1), ("apps", "timeout", "several", 3), ("mbpp", "passed", "single_original_case_only", 1)))


@gives("reasons string", ("",), ("mode,metadata.workload,metadata.environment",), ("metadata.monitoring_source_sha256,incomplete_run",))
def report_mismatches(spark, sf):
    """A24/V18."""
    side = "struct<schema:int,mode:string,warmup_steps:int,flush_seconds:double,detail_limit_seconds:double,workload:string,environment:string,monitoring_source_sha256:string,status:string>"
    base = (1, "light", 3, 60.0, None, "w", "e", "m", "completed")
    return _frame(spark, f"a {side}, b {side}", (base, base), (base, (1, "off", 3, 60.0, None, None, "f", "m", "completed")), (base, (*base[:7], "n", "failed"))).select(F.array_join(telemetry.mismatches(), ",").alias("reasons"))


@gives("run string, fresh boolean, live boolean, recoverable boolean", ("a", True, True, False), ("b", False, False, False), ("c", True, False, True), ("d", False, False, False), ("e", True, False, False))
def run_liveness(spark, sf):
    """Running and fresh, stale, paused, without heartbeat, process gone."""
    d = _frame(spark, "run string, status string, heartbeat double, present boolean", ("a", "running", 950.0, True), ("b", "running", 909.0, True), ("c", "paused", 1000.0, True), ("d", "running", None, True), ("e", "running", 1001.0, False))
    s = telemetry.live_state(F.col("status"), F.col("heartbeat"), F.col("present"), F.lit(1000.0))
    return d.select("run", *[s[k].alias(k) for k in ("fresh", "live", "recoverable")])


@gives("run string, best_step int, best_loss double, last_step int, peak double, median_speed double", ("a", 2, 1.0, 3, 7.0, 20.0))
def run_extremes(spark, sf):
    """A17."""
    return telemetry.extremes(_frame(spark, "run string, pos int, step int, loss double, peak double, speed double", ("a", 0, 1, 3.0, 5.0, 10.0), ("a", 1, 2, 1.0, 7.0, 20.0), ("a", 2, 3, 1.0, 6.0, 40.0)), "run")


@gives("name string, source string, delta bigint, violation boolean", ("r", "a", 20, False), ("r", "b", -1, True), ("r", "c", -5, True), ("r", "d", 4, False))
def added_work(spark, sf):
    """A counter that went down or is gone is a violation."""
    x = _frame(spark, "name string, source string, tokens long", ("r", "a", 10), ("r", "b", 5), ("r", "c", 5))
    return telemetry.work_delta(x, _frame(spark, "name string, source string, tokens long", ("r", "a", 30), ("r", "b", 4), ("r", "d", 4)))


@gives("run string, passed boolean", ("a", True), ("b", False), ("c", False))
def gate_verdicts(spark, sf):
    """Half the loss, ten more recalled, 128 cases."""
    rows = [("a", 0, 4.0, 1, 128), ("a", 9, 1.9, 11, 128), ("b", 0, 4.0, 1, 128), ("b", 9, 2.0, 11, 128), ("c", 0, 4.0, 1, 64), ("c", 9, 1.0, 50, 64)]
    return telemetry.learning_gate(_frame(spark, "run string, step int, loss double, recall int, n int", *rows), "run")


@gives("command string, name string", ("/Applications/Tool Box.app/Contents/MacOS/x --y", "Tool Box"), ('"/opt/my dir/run it" -v', "run it"), ("/usr/bin/python3 -m x", "python3"), ("top", "top"))
def process_names(spark, sf):
    """F27."""
    d = _frame(spark, "command string", ("/Applications/Tool Box.app/Contents/MacOS/x --y",), ('"/opt/my dir/run it" -v',), ("/usr/bin/python3 -m x",), ("top",))
    return d.select("command", telemetry.process_name("command").alias("name"))


@gives("t double, seconds double", (150.0, 50.0), (200.0, 100.0), (500.0, 100.0), (173050.0, 150.0), (173100.0, 200.0))
def active_seconds(spark, sf):
    """F29."""
    return _frame(spark, "t double", *[(x,) for x in (150.0, 200.0, 500.0, 173050.0, 173100.0)]).select("t", telemetry.elapsed([(100, 200), (173000, 173100)], F.col("t")).alias("seconds"))


@gives("tokens int, now double, fraction double", (10, 0.0, 0.1), (10, 50.0, 0.5), (200, 0.0, 1.0), (0, -5.0, 0.0))
def schedule_clock(spark, sf):
    """tokens or the deadline's clock, whichever is further."""
    return _frame(spark, "tokens int, now double", (10, 0.0), (10, 50.0), (200, 0.0), (0, -5.0)).select("tokens", "now", telemetry.schedule_fraction("tokens", 100, 0, 100, F.col("now")).alias("fraction"))


@gives("n int, supported boolean, whole boolean, effective int", (100, True, False, 924), (0, True, True, 1024), (980, False, False, 44), (1100, False, False, 0))
def output_room(spark, sf):
    """Room for an answer, and for all of it."""
    a, w = scoring.allocation("n"), scoring.allocation("n", whole=True)
    return _frame(spark, "n int", (100,), (0,), (980,), (1100,)).select("n", a["supported"].alias("supported"), w["supported"].alias("whole"), a["effective"].alias("effective"))


@gives("a string, same boolean, known boolean, best double, choice string", (" Paris ", False, True, 1.0, " Paris "), ("B)", False, False, 0.0, "paris"), ("paris", True, True, 1.0, "paris"))
def answer_matches(spark, sf):
    """Exact, any reference in NFKC form, best F1, a letter as its choice."""
    refs, choices = F.array(F.lit("PARIS"), F.lit("the city")), F.array(F.lit("x"), F.lit("paris"))
    d = _frame(spark, "a string", (" Paris ",), ("B)",), ("paris",))
    return d.select("a", scoring.exact("a", F.lit("paris ")).alias("same"), scoring.any_match("a", refs).alias("known"), scoring.best_f1("a", refs).alias("best"), grading.choice_of("a", choices).alias("choice"))


@gives("t string, plain string, folded string, asked string, contract string", ("  The ﬁne,  STRASSE ß ", "the ﬁne, strasse ß", "the fine, strasse ss", "ﬁne strasse ß", "the fine, strasse ss"), ("A\u00a0b an  the. x", "a b an the. x", "a b an the. x", "b x", "a b an the. x"), ("", "", "", "", ""))
def normal_forms(spark, sf):
    """F2/F16: the four normalizers differ on purpose."""
    texts = ("  The ﬁne,  STRASSE ß ", "A\u00a0b an  the. x", "")
    return _frame(spark, "t string", *[(x,) for x in texts]).select("t", T.normal("t").alias("plain"), T.norm("t").alias("folded"), T.qa("t").alias("asked"), T.contract("t").alias("contract"))


@gives("t string, same boolean, shown string", ("Passage: A  b\n\nQuestion: q", True, "A. x\nB. y"), ("Premise: c\nHypothesis: h", False, "A. x\nB. y"), ("none", None, "A. x\nB. y"))
def context_keys(spark, sf):
    """the key of a prompt's context, and lettered choices."""
    markers = [("Passage: ", "\n\nQuestion:"), ("Premise: ", "\nHypothesis:")]
    d = _frame(spark, "t string", ("Passage: A  b\n\nQuestion: q",), ("Premise: c\nHypothesis: h",), ("none",))
    return d.select("t", (T.context_key("t", markers) == T.digest(F.lit("a b"))).alias("same"), T.lettered(F.array(F.lit("x"), F.lit("y"))).alias("shown"))


@gives("a string, same boolean", ("x = 1", True), ("x=1  # one", True), ("x = 2", False), ("x = (", None))
def program_keys(spark, sf):
    """equal syntax trees have equal keys; what does not parse has none."""
    d = _frame(spark, "a string", ("x = 1",), ("x=1  # one",), ("x = 2",), ("x = (",))
    return d.select("a", (T.code_key(F.col("a")) == T.code_key(F.lit("x = 1"))).alias("same"))


@gives("t string, within boolean, answer_at int, mask string, one boolean", ("a", True, 2, "0,0,1", True), ("bcdef", False, 1, "0,1,1", False), ("gh", True, None, "0,0", False))
def record_checks(spark, sf):
    """Bytes within a bound, the answer mask, exactly one delimiter (token 9)."""
    d = _frame(spark, "t string, ids array<int>", ("a", [1, 9, 3]), ("bcdef", [9, 9, 3]), ("gh", [1, 2]))
    mask = F.array_join(F.transform(K.answer_mask(F.col("ids"), F.col("answer_at")), lambda x: x.cast("string")), ",")
    d = d.withColumn("answer_at", F.nullif(K.answer_start(F.col("ids"), 9), F.lit(0)))
    return d.select("t", T.bounded_bytes("t", 4, 2).alias("within"), "answer_at", mask.alias("mask"), K.one_delimiter(F.col("ids"), 9).alias("one"))


@gives("a string, same boolean", ("x", True), ("y", False), ("z", False))
def signatures(spark, sf):
    """F32: equal settings, a changed one, and one with a further setting that is chained."""
    d = _frame(spark, "a string, model string, seed int, clock int", ("x", "m", 1, None), ("y", "m", 2, None), ("z", "m", 1, 5))
    base = F.sha2(F.lit('{"model":"m","seed":1}'), 256)
    return d.select("a", (T.signature("model", "seed", chained=(("clock",),)) == base).alias("same"))


@gives("group string, split string", ("g1", "dev"), ("g2", "confirmation"), ("g3", "train"), ("g4", "train"))
def small_holdouts(spark, sf):
    """Groups of a small source that move so that each held-out split has its label."""
    rows = [("cb", g, "train", ["x"], r) for g, r in (("g3", "3"), ("g1", "1"), ("g2", "2"), ("g4", "4"))]
    return splits.balance(_frame(spark, "source string, group string, split string, labels array<string>, rank string", *rows)).drop("source")


@gives("digest string", ("35172c364a0d06a3ddbd3869ff682dd0395fad299787cda9c74cea0a14d8dc41",))
def corpus_digest(spark, sf):
    """The digest of ordered rows in two levels."""
    d = _frame(spark, "ord int, t string", (1, "b"), (0, "a"), (20000, "c"))
    return _frame(spark, "digest string", (K.stream_digest(d, "t", "ord"),))
