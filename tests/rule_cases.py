"""Queries over fixed cases: rules on single values, each held against the value that its rule states.

A case is a row of arguments and the results that the rule gives for them; the query computes the results with the
operator, its SQL lists them. The cases are edge values (empty, doubled, turned, badly formed), which tables rarely hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import grading as G
from corpusloom.operators import scoring as S

QUERIES: dict[str, tuple[Callable, str | None]] = {}
_TYPES = {"string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "array<string>": "VARCHAR[]"}


def literal(v, kind: str) -> str:
    """A value as a DuckDB literal."""
    if v is None:
        return f"NULL::{_TYPES[kind]}"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return f"[{', '.join(literal(x, 'string') for x in v)}]::VARCHAR[]"
    return f"{str(v).lower()}::{_TYPES[kind]}"


def listed(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL of rows with a running number `n` from 0."""
    values = ", ".join(f"({i}, {', '.join(literal(v, k) for v, k in zip(r, columns.values(), strict=True))})" for i, r in enumerate(rows))
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT n::INTEGER AS n, {names} FROM (VALUES {values}) t(n, {names})"


def cases(name: str, arguments: dict[str, str], results: dict[str, str], rows: list[tuple], build: Callable[[], dict[str, Column]], *before: Callable[[], dict[str, Column]]) -> None:
    """Register a query of the cases `rows` (arguments, then results); before: columns that the results are made of, in steps."""
    k = len(arguments)
    ddl = ", ".join(["n int", *[f"{c} {t}" for c, t in arguments.items()]])

    def query(spark: SparkSession, sf: str) -> DataFrame:
        d = spark.createDataFrame([(i, *r[:k]) for i, r in enumerate(rows)], ddl)
        for step in before:
            d = d.withColumns(step())
        out = build()
        return d.select("n", *[out[c].cast(t).alias(c) for c, t in results.items()])

    QUERIES[name] = (query, listed(results, [r[k:] for r in rows]))


TEXT, BOOL, MANY = "string", "boolean", "array<string>"

cases(
    "final_answer", {"source": TEXT, "t": TEXT}, {"answer": TEXT},
    [
        ("gsm8k", "so it is\n#### 1,234", "1234"), ("gsm8k", "#### 5 apples", None), ("gsm8k", "#### +5", "+5"), ("gsm8k", "42", "42"), ("gsm8k", " -3.50 ", "-3.50"),
        ("gsm8k", "#### 1\n#### 2", "2"), ("gsm8k", "####", None), ("gsm8k", "#### 7.", None), ("gsm8k", "about 42", None), ("gsm8k", "", None),
        ("math", "x \\boxed{\\frac{1}{2}} y", "\\frac{1}{2}"), ("math", "\\boxed{1} or \\boxed{ 2 + 3 }", "2+3"), ("math", "\\boxed{1", None), ("math", "7", None), ("math", "\\boxed{}", ""),
        ("aqua_rat", "Answer: B ) 3 KM", "b ) 3 km"), ("aqua_rat", "B", None), ("qasc", "Answer: x Answer: Straße ", "strasse"), ("qasc", "Answer:", ""),
        ("boolq", "  Yes \n indeed ", "yes indeed"), ("boolq", "", ""),
    ],
    lambda: {"answer": G.final_answer("t", F.col("source"))},
)

_W = ["w", "x", "y", "z"]
cases(
    "contract_grade", {"kind": TEXT, "answer": TEXT, "reference": TEXT, "choices": MANY, "source": TEXT}, {"status": TEXT, "correct": BOOL},
    [
        ("number", "Final answer: 4.00", "4", None, None, "correct", True), ("number", "4e0", "4", None, None, "correct", True), ("number", "4 meters", "4", None, None, "format_error", False),
        ("number", "400", "4e2", None, None, "correct", True), ("number", "0.1000000000000000000001", "0.1", None, None, "incorrect", False), ("number", "1,000", "1000", None, None, "format_error", False),
        ("number", "-0", "0", None, None, "correct", True), ("number", "infinity", "1", None, None, "format_error", False), ("number", "two\nlines", "2", None, None, "format_error", False),
        ("text", "why\nFinal answer: Blue", "blue", None, None, "correct", True), ("text", "Final answer: a\nFinal answer: b", "b", None, None, "format_error", False), ("text", "why\nfinal ANSWER: Blue  sky", "blue sky", None, None, "correct", True),
        ("text", "why\nFinal answer:Blue", "blue", None, None, "format_error", False), ("text", "Final answer: Blue\nmore", "blue", None, None, "format_error", False), ("text", "Final answer: ", "", None, None, "format_error", False),
        ("text", "", "x", None, None, "format_error", False), ("text", "STRASSE", "straße", None, None, "correct", True), ("text", "red", "blue", None, None, "incorrect", False),
        ("choice", "B", "B", _W, None, "correct", True), ("choice", "(B)", "B", _W, None, "format_error", False), ("choice", "b", "B", _W, None, "format_error", False), ("choice", "B.", "B", _W, None, "format_error", False),
        ("choice", "A", "B", _W, None, "incorrect", False), ("choice", "E", "B", _W, None, "format_error", False), ("external", "x", "x", None, None, "unscored_external_grader_required", None),
        ("legacy_proxy", "Final answer: 1,234", "so\n#### 1234", None, "gsm8k", "correct", True), ("legacy_proxy", "5 apples", "#### 5", None, "gsm8k", "incorrect", False), ("legacy_proxy", "5", "no number", None, "gsm8k", "unscored_invalid_reference", None),
        ("legacy_proxy", "\\frac{1} {2}", "\\boxed{\\frac{1}{2}}", None, "math", "correct", True), ("legacy_proxy", "b) 3", "Answer: B) 3", None, "aqua_rat", "correct", True), ("legacy_proxy", "B", "x", _W, "arc", "correct", True),
        ("legacy_proxy", "x = 1", "x = 1", None, "apps", "unscored_external_grader_required", None), ("legacy_proxy", "a\nb", "a", None, "boolq", "format_error", False),
    ],
    lambda: {c: F.col("verdict")[c] for c in ("status", "correct")},
    lambda: {"content": G.contract_line("answer")},
    lambda: {"metric": G.score_general("source", G.legacy_form("source", "content"), "reference", choices="choices")},
    lambda: {"verdict": G.grade("kind", "content", "reference", "choices", "metric")},
)

cases(
    "sql_text_match", {"a": TEXT, "b": TEXT}, {"match": BOOL},
    [("SELECT 1;", "select 1", True), ("a ;;", "  a", False), ("a;;", "A ", True), (" a; ", "a", True), ("a; ;", "a", False), ("select  1", "select 1", False), ("", ";", True), ("STRASSE", "straße", True)],
    lambda: {"match": G.sql_match("a", "b")},
)

cases(
    "score_by_source", {"source": TEXT, "generated": TEXT, "answer": TEXT, "answers": MANY, "choices": MANY, "labels": MANY},
    {"metric": TEXT, "correct": BOOL, "reference_parseable": BOOL, "token_f1": "double", "label_f1": "double", "text_match": BOOL, "syntax_valid": BOOL, "nonempty": BOOL, "unique_word_fraction": "double"},
    [
        ("gsm8k", "#### 8", "x #### 8", None, None, None, "final_answer_match", True, True, None, None, None, None, None, None), ("gsm8k", "8", "none", None, None, None, "final_answer_match", False, False, None, None, None, None, None, None),
        ("boolq", "YES ", "yes", None, None, None, "answer_match", True, True, None, None, None, None, None, None), ("arc", "B.", "x", None, _W, None, "answer_match", True, True, None, None, None, None, None, None),
        ("arc", "E", "e", None, _W, None, "answer_match", True, True, None, None, None, None, None, None), ("arc", "(B)", "x", None, _W, None, "answer_match", False, True, None, None, None, None, None, None),
        ("squad", "The Eiffel  Tower!", "x", ["eiffel tower", "tower"], None, None, "answer_exact_and_token_f1", True, None, 1.0, None, None, None, None, None), ("squad", "in paris", "Paris", None, None, None, "answer_exact_and_token_f1", False, None, 2 / 3, None, None, None, None, None),
        ("triviaqa", "ﬁ  X", "FI x", ["other"], None, None, "original_answer_exact_proxy", True, None, None, None, None, None, None, None), ("tydiqa", "b", "a", ["a", "B"], None, None, "original_answer_exact_proxy", True, None, None, None, None, None, None, None),
        ("samsum", "a b, b", "B b c", None, None, None, "summary_unigram_f1_proxy_not_factuality", None, None, 2 / 3, None, None, None, None, None), ("go_emotions", "Joy; anger,joy", "", None, None, ["joy", "anger"], "emotion_label_set_exact_and_f1", True, None, None, 1.0, None, None, None, None),
        ("go_emotions", "joy", "", None, None, ["joy", "anger"], "emotion_label_set_exact_and_f1", False, None, None, 2 / 3, None, None, None, None), ("copa", "B", "x", None, _W, None, "original_label_or_answer_match", True, None, None, None, None, None, None, None),
        ("medqa", "E", "e", None, [*"vwxyz"], None, "original_label_or_answer_match", True, None, None, None, None, None, None, None), ("mbpp", "x = 1", "y", None, None, None, "syntax_only_not_functional", None, None, None, None, None, True, None, None),
        ("apps", " ", "y", None, None, None, "syntax_only_not_functional", None, None, None, None, None, False, None, None), ("piqa", "a A a b", "y", None, None, None, "unscored_open_generation", None, None, None, None, None, None, True, 0.75),
        ("hellaswag", "", "y", None, None, None, "unscored_open_generation", None, None, None, None, None, None, False, 0.0), ("spider", "SELECT 1;", "select 1", None, None, None, "sql_text_match_not_execution", None, None, None, None, True, None, None, None),
    ],
    lambda: (lambda m: {c: F.round(m[c], 9) if c in ("token_f1", "label_f1", "unique_word_fraction") else m[c] for c in QUERY_FIELDS})(G.score_general("source", "generated", "answer", "answers", "choices", "labels")),
)
QUERY_FIELDS = ["metric", "correct", "reference_parseable", "token_f1", "label_f1", "text_match", "syntax_valid", "nonempty", "unique_word_fraction"]
QUERIES["score_by_source"] = (QUERIES["score_by_source"][0], f"SELECT * REPLACE (round(token_f1, 9) AS token_f1, round(label_f1, 9) AS label_f1) FROM ({QUERIES['score_by_source'][1]})")

_LONG = " ".join(["one two three four"] * 6)
cases(
    "error_tags", {"source": TEXT, "generated": TEXT, "stop_reason": TEXT, "correct": BOOL, "expected": TEXT}, {"tags": TEXT, "checked": "int", "wrong": "int"},
    [
        ("boolq", "", "eos", False, "yes", "empty_answer,label_format_or_content", 0, 0), ("boolq", "Answer: Yes.", "eos", False, "yes", "trivial_label_format_only", 0, 0), ("boolq", "no", "token_limit", False, "yes", "token_limit,wrong_label", 0, 0),
        ("boolq", "no idea", "eos", False, "yes", "label_format_or_content", 0, 0), ("gsm8k", "<<1+1=2>> <<2*3=7>> <<x=1>>", "deadline", True, "2", "deadline,explicit_arithmetic_inconsistency", 2, 1), ("gsm8k", "9", "eos", False, "8", "answer_mismatch_cause_unresolved", 0, 0),
        ("gsm8k", _LONG, "length", None, "8", "repetition", 0, 0), ("gsm8k", _LONG[:80], "eos", True, "8", "", 0, 0), ("gsm8k", "<<4/2=2>>", "eos", True, "2", "", 1, 0),
    ],
    lambda: (lambda t: {"tags": F.array_join(t["tags"], ","), "checked": t["checked"], "wrong": t["wrong"]})(G.error_tags("source", "generated", "stop_reason", "correct", "expected")),
)

cases(
    "label_diagnostic", {"source": TEXT, "t": TEXT}, {"label": TEXT},
    [("boolq", " YES! ", "yes"), ("boolq", "Answer : no.", "no"), ("boolq", "label:yes .", "yes"), ("boolq", "yes, it is", None), ("wiqa", "No Effect", "no effect"), ("gsm8k", "yes", None), ("snli", "answer: label: neutral", None), ("snli", "", None)],
    lambda: {"label": G.label_diagnostic("source", "t")},
)

cases(
    "arithmetic", {"t": TEXT}, {"value": TEXT},
    [
        ("1/3+1/6", "1/2"), ("2*(3-5)", "-4/1"), ("1/0", None), ("__import__('os')", None), ("--3", "3/1"), ("2*-3", "-6/1"), ("1+2*3", "7/1"), ("(1", None), ("1 2", None), ("1e5", "100000/1"), ("0x10", "16/1"), ("007", None), (".5", "1/2"), ("2**3", None), ("7//2", None),
        ("1,000", None), ("9" * 31, None), ("1" + "0" * 30, "1" + "0" * 30 + "/1"), ("1/3/7", "1/21"), ("1e400", None), ("", None), (" 1", None), ("1 ", "1/1"), ("1+" * 12 + "1", "13/1"), ("1+" * 13 + "1", None), ("(" * 50 + "1" + ")" * 50, None), ("-" * 18 + "1", "1/1"), (None, None),
    ],
    lambda: {"value": G.arithmetic("t")},
)

cases(
    "strict_number", {"t": TEXT}, {"value": TEXT},
    [("4", "4E0"), (" 4.00 ", "4E0"), ("400", "4E2"), ("4e2", "4E2"), ("-.5", "-5E-1"), ("+0.0", "0"), ("-0", "0"), ("1.", "1E0"), (".", None), ("1e", None), ("1,0", None), ("nan", None), ("12345678901234567890.10", "123456789012345678901E-1"), ("", None)],
    lambda: {"value": G.number("t")},
)

cases(
    "same_output", {"a": TEXT, "b": TEXT}, {"same": BOOL},
    [("1 2", "1  2\n", True), ("1.0000001", "1", True), ("10", "11", False), ("10", "10.0", True), ("a", "a b", False), ("x", "1", False), ("", " ", True), ("1.1", "1.2", False)],
    lambda: {"same": S.same_output("a", "b")},
)

_END = "\n\nYou may explain your reasoning. End with exactly one line in this format:\nFinal answer: <{}>\nDo not put Markdown formatting around that final line."
cases(
    "contract_prompt", {"kind": TEXT, "prompt": TEXT, "choices": MANY, "source": TEXT, "legacy_choices": MANY, "system": TEXT}, {"text": TEXT},
    [
        ("external", "do it", None, "s", None, None, "do it"), ("choice", "which?", ["x", "y"], "s", None, None, "which?\n\nA. x\nB. y" + _END.format("the single option letter")), ("number", "how many?", None, "s", None, "be brief", "System instructions:\nbe brief\n\nhow many?" + _END.format("the numeric result, without units")),
        ("text", "who?", None, "s", None, "", "who?" + _END.format("the short answer only")), ("legacy_proxy", "q", None, "gsm8k", None, None, "q" + _END.format("the numeric result only, without units")), ("legacy_proxy", "q", None, "math", None, None, "q" + _END.format("the final mathematical expression, without a box wrapper")),
        ("legacy_proxy", "q", None, "qasc", ["x"], None, "q" + _END.format("the option letter followed by its exact option text, as shown in the question")), ("legacy_proxy", "q", None, "arc", ["x"], None, "q" + _END.format("the exact text of the selected option (not its letter)")),
        ("legacy_proxy", "q", None, "go_emotions", [], None, "q" + _END.format("the emotion labels separated by commas")), ("legacy_proxy", "q", None, "boolq", None, None, "q" + _END.format("the answer only, without explanation")),
    ],
    lambda: {"text": G.input_text("system", G.prompt_for("kind", "prompt", "choices", "source", "legacy_choices"))},
)

cases(
    "result_compare", {"actual": MANY, "expected": MANY, "sql": TEXT}, {"status": TEXT, "ordered": BOOL},
    [(["a", "b"], ["b", "a"], "SELECT x", "match", False), (["a", "b"], ["b", "a"], "select x order  by y", "mismatch", True), (["a", "a"], ["a"], "SELECT x", "mismatch", False), ([], [], "SELECT x", "match", False), (None, ["a"], "SELECT x", "candidate_failed", False), (["a"], None, "SELECT x", "reference_failed", False), (["a"], ["a"], "SELECT border by", "match", False)],
    lambda: {c: G.compare_results("actual", "expected", "sql")[c] for c in ("status", "ordered")},
)


def _sha(t: str) -> str:
    import hashlib

    return hashlib.sha256(t.encode()).hexdigest()


cases(
    "dialogue_cases", {"t": TEXT}, {"key": TEXT},
    [
        ("Ann: Hi there\nBob:  Bye", "dialogue-content:" + _sha("hi there bye")), ("Eve: hi THERE\\nZed: ﬁne", "dialogue-content:" + _sha("hi there fine")), ("no speaker", "dialogue-content:" + _sha("no speaker")), ("A: b: c", "dialogue-content:" + _sha("b: c")),
        (":x\n" + "n" * 61 + ": y", "dialogue-content:" + _sha(":x " + "n" * 61 + ": y")), ("", "dialogue-content:" + _sha("")),
    ],
    lambda: {"key": T.dialogue_key("t")},
)

cases(
    "clean_markup", {"t": TEXT}, {"text": TEXT},
    [("a<br>b", "a b"), ("a <> b", "a <> b"), ("&lt;x&gt; &amp;amp;", "<x> &amp;"), ("<p>caf&eacute;</p>", " café "), ("1 < 2", "1 < 2"), ("", "")],
    lambda: {"text": T.clean("t")},
)

_P = "Read.\n\nPassage: Some Text\n\nQuestion: What is\tit?\nOptions: x"
cases(
    "overlap_keys", {"prompt": TEXT, "group": TEXT, "title": TEXT}, {"keys": TEXT},
    [
        (_P, "g", "A Title", ",".join(["prompt:" + _sha("read. passage: some text question: what is it? options: x"), "context:" + _sha("some text"), "question:" + _sha("what is it?"), "article:" + _sha("a title"), "base-group:g"])),
        ("Answer this.\n\nWhy so?\nA. x", "g", None, ",".join(["prompt:" + _sha("answer this. why so? a. x"), "question:" + _sha("why so?"), "base-group:g"])),
        ("Only line", "g", "", ",".join(["prompt:" + _sha("only line"), "question:" + _sha("only line"), "base-group:g"])),
        ("Premise: p\nHypothesis: h Context: c", "g", None, ",".join(["prompt:" + _sha("premise: p hypothesis: h context: c"), "context:" + _sha("p"), "context:" + _sha("c"), "question:" + _sha("premise: p"), "base-group:g"])),
    ],
    lambda: {"keys": F.array_join(T.old_keys("prompt", "group", "title"), ",")},
)

cases(
    "later_overlap_keys", {"prompt": TEXT, "source": TEXT}, {"keys": TEXT},
    [
        ("Context: x\nQuestion: Who?", "triviaqa", "context:" + _sha("who?")), ("Context: x\nQuestion: Who?", "squad", ""),
        ("Dialogue:\nA: hi\nB: you\n\nQuestion: z", "dream", ",".join(["context:" + _sha("a: hi b: you"), "dialogue-content:" + _sha("hi you")])),
        ("First: a <b>x</b>\nSecond: b", "mrpc", ",".join(["context:" + _sha("a x"), "context:" + _sha("b")])), ("Comment: ok &amp; so", "go_emotions", "context:" + _sha("ok & so")),
    ],
    lambda: {"keys": F.array_join(T.extra_old_keys("prompt", "source"), ",")},
)

cases(
    "question_cores", {"prompt": TEXT, "source": TEXT}, {"core": TEXT, "task": TEXT},
    [
        ("Do it.\n\nContext: c\nQuestion: Why?\nOptions:\nA. x", "qasc", "Why?", "Context: c\nQuestion: Why?\nOptions:\nA. x"), ("Do it.\n\nWhat is it?\nA. x\nB. y", "arc", "What is it?", "What is it?\nA. x\nB. y"),
        ("Write code.\n\nSum two.\n\nStarter code:\ndef f\n\nRequired function name: f", "apps", "Sum two.", "Sum two."), ("plain", "x", "plain", "plain"),
    ],
    lambda: {"core": T.question_core("prompt", "source"), "task": T.task_core("prompt")},
)
