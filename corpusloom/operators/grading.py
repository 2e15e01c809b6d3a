"""Responses to results: final answers, contracts, scorers by source, prompts and diagnostics of single answers.

A null `correct` means not scored, never wrong. The rules differ by source on purpose: some compare NFKC forms, some
case-folded ones, some plain text.
"""

from __future__ import annotations

import ast
import re
import unicodedata
from collections import Counter
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.operators.scoring import token_f1, unique_word_share

#: Sources by the rule that scores them.
CODE = ("apps", "mbpp", "code_contests")
NARRATIVE = ("hellaswag", "piqa")
QA = ("squad", "quoref", "ropes", "drop", "hotpotqa")
SQL = ("spider", "wikisql")
EXACT = ("triviaqa", "tydiqa", "tabmwp")
ITEMS = ("multinli", "mrpc", "qqp", "cb", "copa", "multirc", "wic", "wsc", "go_emotions", "medqa", "samsum", "logiqa")
FINAL = ("gsm8k", "math", "aqua_rat", "qasc")
#: The labels that an answer can be, by source.
LABELS = {"boolq": ("yes", "no"), "snli": ("entailment", "neutral", "contradiction"), "anli": ("entailment", "neutral", "contradiction"), "scitail": ("entailment", "neutral"), "wiqa": ("more", "less", "no effect")}
#: Stop reasons that are symptoms, and the line that ends an answer under the contract.
STOPS = ("token_limit", "context_exceeded", "deadline")
MARKER = "Final answer:"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- answers --------------------------------------------------------------------------------------------------------
def boxed(c) -> Column:
    r"""content of the last \boxed{...} with balanced braces; null without one."""
    t = _c(c)

    def inside(rest):
        step = lambda s, ch: F.when(s["depth"] <= 0, s).otherwise(F.struct((s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("depth"), (s["n"] + 1).alias("n")))
        walk = F.aggregate(F.split(rest, ""), F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step)
        return T.let(walk, lambda w: F.when(w["depth"] == 0, F.substring(rest, F.lit(1), w["n"] - 1)))

    return F.when(F.contains(t, F.lit("\\boxed{")), T.let(F.substring_index(t, "\\boxed{", -1), inside))


def final_answer(c, source) -> Column:
    """the explicit answer of a text by its source; null where the source's form is not met.

    gsm8k: all that follows the last #### (or the whole text) if it is one number, without commas; math: the last box,
    without white space; aqua_rat and qasc: what follows the last `Answer:`, case-folded; others: the case-folded text.
    """
    t, s = _c(c), F.lit(source) if isinstance(source, str) else source
    tail = T.strip(F.substring_index(t, "####", -1))
    # one Python call for both uses, and only of what they need
    whole = F.coalesce(~s.isin("gsm8k", "math"), F.lit(True))
    folded = T.casefold(F.when(s.isin("aqua_rat", "qasc"), F.when(F.contains(t, F.lit("Answer:")), F.substring_index(t, "Answer:", -1))).when(whole, t))
    return (
        F.when(s == "gsm8k", F.when(tail.rlike(r"^[-+]?[0-9][0-9,]*(?:\.[0-9]+)?\z"), F.replace(tail, F.lit(","), F.lit(""))))
        .when(s == "math", F.regexp_replace(boxed(t), T.SPACE, ""))
        .when(s.isin("aqua_rat", "qasc"), T.strip(folded))
        .otherwise(T.collapse(folded))
    )


def choice_of(answer, choices, last: str = "Z") -> Column:
    """A lone letter with `.` or `)` is the choice at its place; other answers stay."""
    t = _c(answer)
    letter = T.strip(t)
    named = F.get(_c(choices), F.ascii(letter) - 65)
    return F.when(letter.rlike(rf"^[A-{last}][.)]?\z") & named.isNotNull(), named).otherwise(t)


def contract_line(c) -> Column:
    """the content of the only `Final answer:` line if it ends the text, after exactly one space; else, without
    such a line, a text of one line; else null."""

    def body(t):
        found = F.regexp_extract_all(t, F.lit(rf"(?im)^[ \t]*{MARKER}[ \t]*(.*?)[ \t]*$"), F.lit(1))
        last = T.strip(F.element_at(F.split(t, T.LINE_ENDS), -1))
        value = T.strip(F.get(found, 0))
        ends = (F.size(found) == 1) & (value != "") & (F.lower(last) == F.lower(F.concat(F.lit(MARKER + " "), value)))
        return F.when(F.size(found) > 0, F.when(ends, value)).when((t != "") & ~F.contains(t, F.lit("\n")), t)

    return T.let(T.strip(c), body)


def number(c) -> Column:
    """a strict finite decimal number in one written form: sign, digits without outer zeros, E, exponent; else null.

    Equal numbers have equal forms whatever their digits, so no precision is lost.
    """

    def form(t):
        part = lambda i: F.regexp_extract(t, r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?\z", i)
        digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
        bare = F.regexp_replace(digits, "0+$", "")
        power = F.coalesce(part(4).try_cast("bigint"), F.when(part(4) == "", F.lit(0))) - F.length(part(3)) + F.length(digits) - F.length(bare)
        sign = F.when(part(1) == "-", "-").otherwise("")
        return F.when(t.rlike(r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\z"), F.when(bare == "", "0").otherwise(F.concat(sign, bare, F.lit("E"), power.cast("string"))))

    return T.let(T.strip(c), form)


@F.pandas_udf(BooleanType())
def parses(s: pd.Series) -> pd.Series:
    """Whether a text is a program that parses and is not blank."""

    def one(t):
        try:
            ast.parse(t)
            return bool(t.strip())
        except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError):
            return False

    return s.map(one).astype(bool)


@F.pandas_udf(DoubleType())
def norm_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the words of two texts in NFKC form, as multisets; 0 if both are empty."""

    def one(x, y):
        x, y = (Counter(re.findall(r"\w+", unicodedata.normalize("NFKC", t or "").casefold())) for t in (x, y))
        return 2 * (x & y).total() / max(1, x.total() + y.total())

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


# ---- scorers by source ----------------------------------------------------------------------------------------------
METRIC = "struct<metric:string,correct:boolean,reference_parseable:boolean,token_f1:double,label_f1:double,text_match:boolean,syntax_valid:boolean,nonempty:boolean,unique_word_fraction:double>"


def _result(metric, **values: Column) -> Column:
    names = ["correct", "reference_parseable", "token_f1", "label_f1", "text_match", "syntax_valid", "nonempty", "unique_word_fraction"]
    fields = [F.lit(metric) if isinstance(metric, str) else metric, *[values.get(n, F.lit(None)) for n in names]]
    return F.struct(*[f.alias(n) for f, n in zip(fields, ["metric", *names], strict=True)]).cast(METRIC)


def sql_match(a, b) -> Column:
    """Equal SQL text: stripped, then without final semicolons, then case-folded."""
    bare = lambda c: T.casefold(F.regexp_replace(T.strip(c), r";+\z", ""))
    return bare(a) == bare(b)


def score_general(source, generated, answer, answers=None, choices=None, original_labels=None, memorization: bool = False) -> Column:
    """The metric of a response by its source, as a struct; `correct` is null where nothing is decided.

    memorization: only whether the stripped texts are equal. Code: parses, not run. Open continuations: not scored. SQL:
    text match. QA: any exact match and the best F1 over the references, in QA form. Exact sources: NFKC form equal to the
    answer (tydiqa: any of answers). Items: samsum F1, go_emotions label sets, else a letter A-D as its choice, NFKC form
    equal. The others: a letter A-Z as its choice, then final answers equal.
    """
    s, g, a = _c(source), _c(generated), _c(answer)
    none = F.lit(None).cast("array<string>")
    many, listed, labels = (none if x is None else _c(x) for x in (answers, choices, original_labels))
    if memorization:
        return _result("training_answer_recall", correct=T.strip(g) == T.strip(a))
    references = F.coalesce(many, F.array(a))
    words = lambda c: T.words(T.qa(c))
    qa_exact = F.exists(references, lambda r: T.qa(r) == T.qa(g))
    qa_f1 = F.array_max(F.transform(references, lambda r: token_f1(words(g), words(r))))
    got = F.array_distinct(F.array_remove(T.norm_all(F.split(g, "[;,]")), ""))
    want = F.array_distinct(F.coalesce(labels, F.array().cast("array<string>")))
    both = F.size(F.array_intersect(got, want))
    picked, item = choice_of(g, listed), choice_of(g, listed, "D")
    actual, expected = final_answer(picked, s), final_answer(a, s)
    return (
        F.when(s == "tydiqa", _result("original_answer_exact_proxy", correct=F.array_contains(T.norm_all(references), T.norm(g))))
        .when(s.isin(*EXACT), _result("original_answer_exact_proxy", correct=T.norm(g) == T.norm(a)))
        .when(s == "samsum", _result("summary_unigram_f1_proxy_not_factuality", token_f1=norm_f1(g, a)))
        .when(s == "go_emotions", _result("emotion_label_set_exact_and_f1", correct=(both == F.size(got)) & (both == F.size(want)), label_f1=2.0 * both / F.greatest(F.lit(1), F.size(got) + F.size(want))))
        .when(s.isin(*ITEMS), _result("original_label_or_answer_match", correct=T.norm(item) == T.norm(a)))
        .when(s.isin(*CODE), _result("syntax_only_not_functional", syntax_valid=parses(g)))
        .when(s.isin(*NARRATIVE), _result("unscored_open_generation", nonempty=T.strip(g) != "", unique_word_fraction=unique_word_share(g, lower=False)))
        .when(s.isin(*SQL), _result("sql_text_match_not_execution", text_match=sql_match(g, a)))
        .when(s.isin(*QA), _result("answer_exact_and_token_f1", correct=qa_exact, token_f1=qa_f1))
        .otherwise(_result(F.when(s.isin(*FINAL), "final_answer_match").otherwise("answer_match"), correct=F.coalesce(actual == expected, F.lit(False)), reference_parseable=expected.isNotNull()))
    )


def legacy_form(source, content) -> Column:
    """The content of a contract put back into the form that its source's scorer reads."""
    s, got = _c(source), _c(content)
    return F.when(s == "gsm8k", F.concat(F.lit("#### "), got)).when(s == "math", F.concat(F.lit("\\boxed{"), got, F.lit("}"))).when(s.isin("aqua_rat", "qasc"), F.concat(F.lit("Answer: "), got)).otherwise(got)


def grade(kind, content, reference, choices, metric=None) -> Column:
    """Struct (status, correct) of a response by the content of its contract, contract_line().

    legacy_proxy: by `metric`, score_general() of legacy_form(). Content and metric are best columns of their own, so that
    they are computed once.
    """
    k = _c(kind)
    verdict = lambda status, ok=None: F.struct(F.lit(status).alias("status"), F.lit(ok).cast("boolean").alias("correct"))
    decided = lambda ok: F.struct(F.when(ok, "correct").otherwise("incorrect").alias("status"), F.coalesce(ok, F.lit(False)).alias("correct"))
    got, bad = _c(content), verdict("format_error", False)
    letters = F.transform(_c(choices), lambda _, i: F.chr((i + 65).cast("bigint")))
    out = F.when(k == "external", verdict("unscored_external_grader_required")).when(got.isNull(), bad)
    out = out.when((k == "choice") & ~F.coalesce(F.array_contains(letters, got), F.lit(False)), bad).when(k == "choice", decided(got == _c(reference)))
    out = out.when((k == "number") & number(got).isNull(), bad).when(k == "number", decided(number(got) == number(reference)))
    if metric is not None:
        m = _c(metric)
        judged = F.when(~F.coalesce(m["reference_parseable"], F.lit(True)), verdict("unscored_invalid_reference")).when(m["correct"].isNull(), verdict("unscored_external_grader_required")).otherwise(decided(m["correct"]))
        out = out.when(k == "legacy_proxy", judged)
    folded = lambda c: T.collapse(T.casefold(c))
    return out.otherwise(decided(folded(got) == folded(reference)))


# ---- prompts --------------------------------------------------------------------------------------------------------
def prompt_for(kind, prompt, choices, source, legacy_choices) -> Column:
    """the prompt with its choices and the contract of its kind; external tasks stay as they are."""
    k, s, p = _c(kind), _c(source), _c(prompt)
    legacy = (
        F.when(s.isin("gsm8k", "tabmwp"), "the numeric result only, without units")
        .when(s == "math", "the final mathematical expression, without a box wrapper")
        .when(s.isin("aqua_rat", "qasc"), "the option letter followed by its exact option text, as shown in the question")
        .when(F.coalesce(F.size(_c(legacy_choices)) > 0, F.lit(False)), "the exact text of the selected option (not its letter)")
        .when(s == "go_emotions", "the emotion labels separated by commas")
        .otherwise("the answer only, without explanation")
    )
    contract = F.when(k == "choice", "the single option letter").when(k == "number", "the numeric result, without units").when(k == "legacy_proxy", legacy).otherwise("the short answer only")
    full = F.when(k == "choice", F.concat(p, F.lit("\n\n"), T.lettered(choices))).otherwise(p)
    ask = F.concat(F.lit(f"\n\nYou may explain your reasoning. End with exactly one line in this format:\n{MARKER} <"), contract, F.lit(">\nDo not put Markdown formatting around that final line."))
    return F.when(k == "external", p).otherwise(F.concat(full, ask))


def input_text(system, prompt) -> Column:
    """a prompt with its system instructions in front, where it has any."""
    return F.when(F.coalesce(_c(system), F.lit("")) != "", F.concat(F.lit("System instructions:\n"), _c(system), F.lit("\n\n"), _c(prompt))).otherwise(_c(prompt))


# ---- diagnostics ----------------------------------------------------------------------------------------------------
def label_diagnostic(source, c) -> Column:
    """the whole answer as one of its source's labels, but for case, `answer:` or `label:` and final marks; else null."""
    t = T.strip(F.regexp_replace(T.strip(T.casefold(c)), r"(?U)^(answer|label)\s*:\s*", ""))
    bare = T.strip(F.regexp_replace(t, r"[.!]+\z", ""))
    return F.when(F.coalesce(F.array_contains(F.element_at(_label_map(), _c(source)), bare), F.lit(False)), bare)


def _label_map() -> Column:
    return F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])


BOUND = 10**30
_TOKEN = re.compile(r"[ \t\f]*(?:(?P<mark>[-+*/()])|(?P<number>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:[0-9](?:_?[0-9])*)?\.?(?:[0-9](?:_?[0-9])*)?(?:(?<=[0-9.])[eE][+-]?[0-9](?:_?[0-9])*)?)(?![\w.]))")
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "pos": 3}


def _number(text: str) -> Fraction:
    """A number literal's value; ValueError for what is none."""
    bare = text.replace("_", "")
    if not bare or bare == ".":
        raise ValueError(text)
    if bare[:2].lower() in ("0x", "0o", "0b"):
        return Fraction(int(bare, 0))
    if bare.isdigit():
        if bare[0] == "0" and bare.strip("0"):
            raise ValueError(text)
        return Fraction(int(bare))
    return Fraction(str(float(bare)))


def arithmetic_value(text: str) -> Fraction | None:
    """exact value of + - * / and brackets over number literals by two stacks; null outside the bounds.

    Bounds: 100 characters, 40 parts (one for the whole, one a number, two an operator), and 10 ** 30 for every value and
    denominator on the way.
    """
    if text is None or len(text) > 100 or text[:1] in (" ", "\t", "\f"):
        return None
    values: list[Fraction] = []
    marks: list[str] = []

    def held(x: Fraction) -> None:
        if abs(x) > BOUND or x.denominator > BOUND:
            raise ValueError("out of bounds")
        values.append(x)

    def settle() -> None:
        mark, x = marks.pop(), values.pop()
        if mark in ("neg", "pos"):
            held(-x if mark == "neg" else x)
            return
        y = values.pop()
        held(y + x if mark == "+" else y - x if mark == "-" else y * x if mark == "*" else y / x)

    body, at, parts, open_ = text.rstrip(), 0, 1, True  # open_: an operand has to follow
    try:
        while at < len(body):
            m = _TOKEN.match(body, at)
            if m is None:
                return None
            at = m.end()
            mark = m["mark"]
            if mark is None:
                if not open_:
                    return None
                held(_number(m["number"]))
                parts, open_ = parts + 1, False
            elif mark == "(":
                if not open_:
                    return None
                marks.append(mark)
            elif mark == ")":
                while marks and marks[-1] != "(":
                    settle()
                if open_ or not marks:
                    return None
                marks.pop()
            else:
                name = {"-": "neg", "+": "pos"}.get(mark) if open_ else mark
                if name is None:
                    return None
                while not open_ and marks and marks[-1] != "(" and _RANK[marks[-1]] >= _RANK[name]:
                    settle()
                marks.append(name)
                parts, open_ = parts + 2, True
        if open_ or parts > 40 or "(" in marks:
            return None
        while marks:
            settle()
        return values[0]
    except (ValueError, ZeroDivisionError, OverflowError):
        return None


@F.pandas_udf(StringType())
def arithmetic(s: pd.Series) -> pd.Series:
    """the value of an expression as `p/q`; null where it has none."""
    return s.map(lambda t: None if (v := arithmetic_value(t)) is None else f"{v.numerator}/{v.denominator}")


@F.pandas_udf(StructType([StructField("checked", IntegerType()), StructField("wrong", IntegerType())]))
def equalities(s: pd.Series) -> pd.DataFrame:
    """the <<expression=value>> marks of a text that can be computed, and those of them that are wrong."""
    checked, wrong = [], []
    for t in s:
        pairs = [(arithmetic_value(a), arithmetic_value(b)) for a, b in re.findall(r"<<([^<>]+)=([^<>]+)>>", t or "")]
        known = [a == b for a, b in pairs if a is not None and b is not None]
        checked.append(len(known))
        wrong.append(known.count(False))
    return pd.DataFrame({"checked": checked, "wrong": wrong})


def error_tags(source, generated, stop_reason, correct, expected) -> Column:
    """struct (tags, checked, wrong) of the symptoms of an answer; a wrong answer proves no mechanism."""
    g = F.coalesce(_c(generated), F.lit(""))

    def repeats(w):
        four = lambda i: F.concat_ws("\u0001", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3))
        return F.when(F.size(w) >= 20, T.let(F.transform(F.sequence(F.lit(0), F.size(w) - 4), four), lambda x: F.size(F.array_distinct(x)) / F.size(x) < 0.55)).otherwise(False)

    label = label_diagnostic(source, g)
    trivial = F.coalesce(label == T.strip(T.casefold(expected)), F.lit(False))
    wrong = F.when(trivial, "trivial_label_format_only").when(_c(source).isin(*LABELS), F.when(label.isNotNull(), "wrong_label").otherwise("label_format_or_content")).otherwise("answer_mismatch_cause_unresolved")
    sums = equalities(g)
    tags = [
        F.when(T.strip(g) == "", "empty_answer"),
        F.when(_c(stop_reason).isin(*STOPS), _c(stop_reason)),
        F.when(T.let(T.words(g, r"(?U)[^\s]+"), repeats), "repetition"),
        F.when(~F.coalesce(_c(correct), F.lit(True)), wrong),
        F.when(sums["wrong"] > 0, "explicit_arithmetic_inconsistency"),
    ]
    return F.struct(F.array_compact(F.array(*tags)).alias("tags"), sums["checked"].alias("checked"), sums["wrong"].alias("wrong"))


# ---- results --------------------------------------------------------------------------------------------------------
def compare_results(actual, expected, reference_sql, most: int = 10_000) -> Column:
    """Struct (status, ordered) of two query results given as arrays of rows; they are compared as bags unless the
    reference orders its rows. A null result is a failed query, one of more than `most` rows is over the limit."""
    a, e = _c(actual), _c(expected)
    ordered = F.coalesce(_c(reference_sql).rlike(r"(?i)\bORDER\s+BY\b"), F.lit(False))
    equal = F.when(ordered, a == e).otherwise(F.array_sort(a) == F.array_sort(e))
    failed = lambda r: r.isNull() | (F.size(r) > most)
    status = F.when(failed(e), "reference_failed").when(failed(a), "candidate_failed").when(equal, "match").otherwise("mismatch")
    return F.struct(status.alias("status"), ordered.alias("ordered"))


def compare_on_tables(results: DataFrame, tables: DataFrame) -> DataFrame:
    """Results (id, actual, reference_sql) against the expected rows of their table (id, expected); without one missing_table."""
    known = tables.select("id", "expected", F.lit(True).alias("known"))
    return results.join(known, "id", "left").select("id", F.when(F.col("known"), compare_results("actual", "expected", "reference_sql")["status"]).otherwise("missing_table").alias("status"))


def rescore(results: DataFrame, tasks: DataFrame, verdict: Column) -> DataFrame:
    """Saved responses graded anew against their tasks by (source, id): source, id, before, after, changed."""
    joined = results.select("source", "id", "generated", F.col("status").alias("before")).join(tasks, ["source", "id"])
    return joined.select("source", "id", "before", verdict.alias("after")).withColumn("changed", ~F.col("before").eqNullSafe(F.col("after")))


def self_scores(tasks: DataFrame) -> DataFrame:
    """References that their own scorer does not accept, or cannot read; none in a sound suite."""
    m = score_general("source", "answer", "answer", "answers", "choices", "original_labels")
    scored = tasks.withColumn("m", m).select("source", "id", F.col("m.metric").alias("metric"), F.col("m.correct").alias("correct"), F.coalesce("m.reference_parseable", F.lit(True)).alias("parseable"))
    return scored.filter("NOT parseable OR NOT correct")
