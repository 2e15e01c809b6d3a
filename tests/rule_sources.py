"""Queries over small raw rows written out here: source adapters, readers and sinks, with the records they have to give.

The rows of a source come from this file because no table of the corpus has its raw form; files that readers need are
written to the shared folder first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rule_cases import listed
from corpusloom.sources import converters as C
from corpusloom.sources.converters import EMOTIONS

QUERIES: dict[str, tuple[Callable, str | None]] = {}
FIELDS = {"source": "string", "prompt": "string", "answer": "string", "reason": "string", "language": "string", "choices": "array<string>", "labels": "array<string>"}


def record(source, prompt, answer, reason=None, language=None, choices=None, labels=None) -> tuple:
    return source, prompt, answer, reason, language, choices, labels


def converted(name: str, raws: list[tuple[str, str, list[tuple], list[tuple]]], prepare: Callable | None = None) -> None:
    """Register a query of the records that raw rows (source, schema, rows) have to give."""
    want = [r for _, _, _, records in raws for r in records]

    def query(spark: SparkSession, sf: str) -> DataFrame:
        parts: list[DataFrame] = []
        for source, ddl, rows, _ in raws:
            for row in rows:
                d = spark.createDataFrame([row], ddl)
                out = C.convert(prepare(spark, d) if prepare else d, source).withColumn("n", F.lit(len(parts)))
                parts.append(out.select("n", "source", "prompt", "answer", "reason", "language", "choices", F.col("original_labels").alias("labels")))
        return reduce(DataFrame.unionByName, parts)

    QUERIES[name] = (query, listed(FIELDS, want))


_SOLVE = "Solve this math problem and explain your calculation.\n\n"
_PASSAGE = "Answer the question using the passage.\n\nPassage: "
_NLI = "Classify the hypothesis as entailment, neutral, or contradiction.\n\n"
_CHOICES = "choices struct<label:array<string>,text:array<string>>"

converted("convert_mbpp", [("mbpp", "task_id int, text string, code string", [(1, "Add two.", "def f(): pass")], [record("mbpp", "Write a Python 3 function for this task. Output code only.\n\nAdd two.", "def f(): pass")])])
converted(
    "convert_math",
    [
        ("gsm8k", "question string, answer string", [("q?", "a"), ("q", " "), ("q <eos>", "x")], [record("gsm8k", _SOLVE + "q?", "a"), record("gsm8k", _SOLVE + "q", " ", "empty_answer"), record("gsm8k", _SOLVE + "q <eos>", "x", "reserved_token_in_original")]),
        ("math", "problem string, solution string", [("p", "s")], [record("math", _SOLVE + "p", "s")]),
    ],
)
converted("convert_squad", [("squad", "id string, title string, context string, question string, answers struct<text:array<string>>", [("i", "T", "ctx", "q", (["x", "x", "y"],))], [record("squad", _PASSAGE + "ctx\n\nQuestion: q", "x")])])
converted("convert_boolq", [("boolq", "question string, passage string, answer boolean", [("q", "p", True), ("q", "p", False)], [record("boolq", "Answer yes or no using the passage.\n\nPassage: p\n\nQuestion: q", a) for a in ("yes", "no")])])
converted("convert_hellaswag", [("hellaswag", "ctx string, endings array<string>, label string, source_id string", [("c", ["a", "b"], "1", "s"), ("c", ["a"], "", "s")], [record("hellaswag", "Continue this description of an activity.\n\nc", "b"), record("hellaswag", "Continue this description of an activity.\n\nc", None, "empty_answer")])])
converted("convert_piqa", [("piqa", "goal string, sol1 string, sol2 string, label int", [("g", "x", "y", 1), ("g", "x", "y", 0)], [record("piqa", "Describe a way to accomplish this goal.\n\ng", a) for a in "yx"])])
converted("convert_winogrande", [("winogrande", "sentence string, option1 string, option2 string, answer string", [("The _ sat.", "cat", "dog", "2")], [record("winogrande", "Fill in the blank with the correct option.\n\nThe _ sat.\nOptions: cat; dog", "dog")])])
converted(
    "convert_keyed_choices",
    [
        ("arc", f"id string, question string, {_CHOICES}, answerKey string", [("i", "q", (["1", "2"], ["x", "y"]), "2"), ("i", "q", (["A"], ["x"]), "Z")], [record("arc", "Answer this science question.\n\nq\n1. x\n2. y", "y"), record("arc", "Answer this science question.\n\nq\nA. x", None, "empty_answer")]),
        ("openbookqa", f"id string, question_stem string, {_CHOICES}, answerKey string", [("i", "q", (["A", "B"], ["x", "y"]), "A")], [record("openbookqa", "Answer this question.\n\nq\nA. x\nB. y", "x")]),
        ("commonsenseqa", f"id string, question string, {_CHOICES}, answerKey string", [("i", "q", (["A", "B"], ["x", "y"]), "B")], [record("commonsenseqa", "Answer this question.\n\nq\nA. x\nB. y", "y")]),
        ("qasc", f"id string, question string, fact1 string, fact2 string, {_CHOICES}, answerKey string", [("i", "q", "one.", "two.", (["A", "B"], ["x", "y"]), "B")], [record("qasc", "Answer this question.\n\nq\nA. x\nB. y", "one. two.\nAnswer: y")]),
        ("quartz", f"id string, question string, para string, para_id string, {_CHOICES}, answerKey string", [("i", "q", "Ice melts.", "p1", (["A", "B"], ["x", "y"]), "B")], [record("quartz", "Use this knowledge: Ice melts.\n\nAnswer this question.\n\nq\nA. x\nB. y", "y")]),
    ],
)
converted(
    "convert_reading",
    [
        ("sciq", "question string, support string, correct_answer string", [("q", "s", "a")], [record("sciq", _PASSAGE + "s\n\nQuestion: q", "a")]),
        ("ropes", "id string, background string, situation string, question string, answers struct<text:array<string>>", [("i", "b", "s", "q", (["x"],))], [record("ropes", "Answer using the background and situation.\n\nBackground: b\nSituation: s\nQuestion: q", "x")]),
        ("drop", "query_id string, section_id string, passage string, question string, answers_spans struct<spans:array<string>>", [("i", "s", "p", "q", (["x", "y"],))], [record("drop", _PASSAGE + "p\n\nQuestion: q", "x; y")]),
        ("race", "example_id string, article string, question string, options array<string>, answer string", [("i", "art", "q", ["x", "y"], "B")], [record("race", _PASSAGE + "art\n\nQuestion: q\nA. x\nB. y", "y", choices=["x", "y"])]),
        ("quarel", "id string, question string, answer_index int", [("i", "Which? (A) x (B) y", 1)], [record("quarel", "Choose the correct option, A or B.\n\nWhich? (A) x (B) y", "B")]),
        ("snli", "premise string, hypothesis string, label int", [("p", "h", 2), ("p", "h", -1)], [record("snli", _NLI + "Premise: p\nHypothesis: h", "contradiction"), record("snli", _NLI + "Premise: p\nHypothesis: h", None, "invalid_label")]),
        ("aqua_rat", "question string, options array<string>, rationale string, correct string", [("q", ["A)1", "B)2"], "r", "B"), ("q", ["A)1"], "r", "F")], [record("aqua_rat", _SOLVE + "q\nA)1\nB)2", "r\nAnswer: B)2"), record("aqua_rat", _SOLVE + "q\nA)1", None, "invalid_label")]),
    ],
)
converted("convert_hotpotqa", [("hotpotqa", "id string, question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>", [("i", "q", "a", (["T1", "T2"], [["s1 ", "s2"], ["s3"]]))], [record("hotpotqa", "Answer the question using the passages.\n\nT1: s1 s2\n\nT2: s3\n\nQuestion: q", "a")])])


def _with_schemas(spark, d):
    schemas = spark.createDataFrame([("d", ["t", "u"], [(-1, "*"), (0, "a"), (1, "b")], ["text", "number", "text"], [[1, 2]])], "db_id string, table_names_original array<string>, column_names_original array<struct<t:int,c:string>>, column_types array<string>, foreign_keys array<array<int>>")
    return C.with_schema(d, schemas)


converted("convert_spider", [("spider", "db_id string, question string, query string", [("d", "q", "SELECT 1")], [record("spider", "Write a SQL query. Output SQL only.\n\nSchema:\nt(a number)\nu(b text)\nForeign keys: t.a = u.b\n\nQuestion: q", "SELECT 1")])], _with_schemas)
converted(
    "convert_broad",
    [
        ("social_i_qa", "context string, question string, answerA string, answerB string, answerC string, label string", [("c", "q", "x", "y", "z", "2"), ("c", "q", "x", "y", "z", "4")], [record("social_i_qa", "Answer the question using the context.\n\nContext: c\n\nQuestion: q\nA. x\nB. y\nC. z", a, r, choices=["x", "y", "z"]) for a, r in (("y", None), (None, "invalid_choice"))]),
        ("cosmos_qa", "context string, question string, answer0 string, answer1 string, answer2 string, answer3 string, label int", [("c", "q", "x", "y", "z", "w", 3)], [record("cosmos_qa", "Answer the question using the context.\n\nContext: c\n\nQuestion: q\nA. x\nB. y\nC. z\nD. w", "w", choices=["x", "y", "z", "w"])]),
        ("quoref", "id string, url string, context string, question string, answers struct<text:array<string>>", [("i", "u", "c", "q", (["x", "y"],))], [record("quoref", _PASSAGE + "c\n\nQuestion: q", "x")]),
        ("wiqa", "question_para_step array<string>, question_stem string, answer_label string, metadata_para_id int, choices struct<text:array<string>>", [(["s1", "s2"], "q", "no_effect", 7, (["more", "less", "no effect"],))], [record("wiqa", "Predict the effect of this change.\n\nProcess:\ns1\ns2\n\nQuestion: q\nA. more\nB. less\nC. no effect", "no effect", choices=["more", "less", "no effect"])]),
        ("dream", "dialogue array<string>, question string, choice array<string>, answer string, dialogue_id string", [(["A: hi", "B: ho"], "q", ["x", "y"], "y", "1"), (["A: hi"], "q", ["x"], "z", "1")], [record("dream", "Answer the question using the dialogue.\n\nDialogue:\nA: hi\nB: ho\n\nQuestion: q\nA. x\nB. y", "y", choices=["x", "y"]), record("dream", "Answer the question using the dialogue.\n\nDialogue:\nA: hi\n\nQuestion: q\nA. x", "z", "answer_not_a_choice", choices=["x"])]),
        ("anli", "uid string, premise string, hypothesis string, label int", [("u", "p", "h", 1)], [record("anli", _NLI + "Premise: p\nHypothesis: h", "neutral")]),
        ("scitail", "premise string, hypothesis string, label string", [("p", "h", "entails"), ("p", "h", "odd")], [record("scitail", "Classify the hypothesis as entailment, or neutral.\n\nPremise: p\nHypothesis: h", a, r) for a, r in (("entailment", None), ("odd", "invalid_label"))]),
    ],
)
_WIKISQL = "question string, table struct<id:string,header:array<string>,types:array<string>>, sql struct<sel:int,agg:int,conds:struct<column_index:array<int>,operator_index:array<int>,condition:array<string>>>"
converted(
    "convert_wikisql",
    [
        (
            "wikisql", _WIKISQL, [("q", ("t", ['na"me', "n"], ["text", "real"]), (1, 4, ([0], [0], ["O'Reilly"]))), ("q", ("t", ["a"], ["text"]), (0, 0, ([0, 0], [0], ["x"]))), ("q", ("t", ["a"], ["text"]), (0, 0, ([], [], [])))],
            [
                record("wikisql", 'Write a SQL query. Output SQL only.\n\nSchema:\ndata("na""me" TEXT, "n" REAL)\n\nQuestion: q', "SELECT SUM(\"n\") FROM data WHERE \"na\"\"me\" = 'O''Reilly'"),
                record("wikisql", 'Write a SQL query. Output SQL only.\n\nSchema:\ndata("a" TEXT)\n\nQuestion: q', None, "invalid_sql"), record("wikisql", 'Write a SQL query. Output SQL only.\n\nSchema:\ndata("a" TEXT)\n\nQuestion: q', 'SELECT "a" FROM data'),
            ],
        )
    ],
)
_TYDI = "Answer using a span from the passage in its original language.\n\nPassage: aé bc\n\nQuestion: q"
_TABLE = "Answer the question using the table. Give only the final answer, including the unit when provided.\n\nTable title: T\nTable:\na|b\n\nQuestion: q"
converted(
    "convert_multilingual",
    [
        ("triviaqa", "question_id string, question string, answer struct<value:string,aliases:array<string>>", [("i", " q ", ("v", ["w"]))], [record("triviaqa", "Answer this factual question with a short answer.\n\nQuestion: q", "v", language="english")]),
        (
            "tydiqa", "id string, title string, context string, question string, answers struct<text:array<string>,answer_start:array<int>>",
            [("english-1", "T", "aé bc", "q", (["bc"], [3])), ("klingon-1", "T", "aé bc", "q", (["bc"], [3])), ("finnish-1", "T", "aé bc", "q", (["zz"], [0])), ("finnish-1", "T", "aé bc", "q", (["bc"], [-1]))],
            [record("tydiqa", _TYDI, "bc", language="english"), record("tydiqa", _TYDI, "bc", "language", "klingon"), record("tydiqa", _TYDI, "zz", "answer_not_in_context", "finnish"), record("tydiqa", _TYDI, "bc", "negative_offset", "finnish")],
        ),
        (
            "tabmwp", "uid string, split string, question string, table string, table_title string, answer string, unit string, choices array<string>",
            [("u", "train", "q", "a|b", "T", "3", "cm", None), ("u", "train", "q", "a|b", "T", "3", None, ["3", "4"]), ("u", "test", "q", "a|b", "T", "3", "", None), ("u", "train", "q", "a|b", "T", "5", "", ["3"])],
            [
                record("tabmwp", _TABLE + "\nUnit: cm", "3 cm", language="english"), record("tabmwp", _TABLE + "\nChoices: 3; 4", "3", language="english", choices=["3", "4"]),
                record("tabmwp", _TABLE, "3", "split", "english"), record("tabmwp", _TABLE + "\nChoices: 3", "5", "answer_not_a_choice", "english", ["3"]),
            ],
        ),
    ],
)
_PAIR = "Do these two {}? Answer yes or no.\n\nFirst: a\nSecond: b"
_EMOTION = f"List all annotated emotions expressed in this comment, separated by semicolons.\nAllowed labels: {', '.join(EMOTIONS)}\n\nComment: t"
_LETTERS = "\nA. w\nB. x\nC. y\nD. z"
converted(
    "convert_item_sources",
    [
        ("multinli", "pairID string, promptID int, premise string, hypothesis string, label int", [("i", 4, " p ", "h ", 0), ("i", 4, "p", " ", 0), ("i", 4, "p", "h", 3)], [record("multinli", _NLI + "Premise: p\nHypothesis: h", "entailment", labels=["entailment"]), record("multinli", _NLI + "Premise: p\nHypothesis: ", "entailment", "empty_hypothesis", labels=["entailment"]), record("multinli", _NLI + "Premise: p\nHypothesis: h", None, "invalid_original_label", labels=[None])]),
        ("cb", "premise string, hypothesis string, label int, idx int", [("p", "h", 1, 5)], [record("cb", _NLI + "Premise: p\nHypothesis: h", "contradiction", labels=["contradiction"])]),
        ("mrpc", "idx int, sentence1 string, sentence2 string, label int", [(1, "a", "b", 1)], [record("mrpc", _PAIR.format("sentences have equivalent meaning"), "yes", labels=["yes"])]),
        ("qqp", "idx int, question1 string, question2 string, label int", [(1, "a", "b", 0)], [record("qqp", _PAIR.format("questions ask the same thing"), "no", labels=["no"])]),
        ("wic", "sentence1 string, sentence2 string, word string, idx int, start1 int, end1 int, start2 int, end2 int, label int", [("run ran", "they run", "run", 1, 0, 3, 5, 8, 1), ("run", "run", "run", 1, 0, 4, 0, 3, 1)], [record("wic", "Is the marked word used with the same meaning in both sentences? Answer yes or no.\n\nFirst: [TARGET]run[/TARGET] ran\nSecond: they [TARGET]run[/TARGET]", "yes", labels=["yes"]), record("wic", "Is the marked word used with the same meaning in both sentences? Answer yes or no.\n\nFirst: [TARGET]run[/TARGET]\nSecond: [TARGET]run[/TARGET]", "yes", "invalid_word_span", labels=["yes"])]),
        ("copa", "premise string, choice1 string, choice2 string, question string, idx int, label int", [("p", "x", "y", "cause", 1, 1)], [record("copa", "Choose the more plausible cause. Give the full option text.\n\nPremise: p\nA. x\nB. y", "y", choices=["x", "y"], labels=["choice2"])]),
        ("multirc", "paragraph string, question string, answer string, idx struct<paragraph:int,question:int,answer:int>, label int", [("p", "q", "a", (1, 2, 3), 0)], [record("multirc", "Does the proposed answer correctly answer the question using the passage? Answer yes or no.\n\nPassage: p\n\nQuestion: q\nProposed answer: a", "no", labels=["no"])]),
        ("wsc", "text string, span1_index int, span2_index int, span1_text string, span2_text string, idx int, label int", [("Bob ate his pie", 0, 2, "Bob", "his", 1, 1), ("Bob ate", 0, 2, "Bob", "his", 1, 1)], [record("wsc", "Does the second marked expression refer to the first? Answer yes or no.\n\nPassage: Bob ate his pie\nFirst expression: Bob (word index 0, zero-based)\nSecond expression: his (word index 2, zero-based)", "yes", labels=["yes"]), record("wsc", "Does the second marked expression refer to the first? Answer yes or no.\n\nPassage: Bob ate\nFirst expression: Bob (word index 0, zero-based)\nSecond expression: his (word index 2, zero-based)", "yes", "invalid_coreference_span", labels=["yes"])]),
        ("go_emotions", "id string, text string, labels array<int>", [("i", "t", [17, 15, 17]), ("i", "t", [])], [record("go_emotions", _EMOTION, "gratitude; joy", labels=["gratitude", "joy"]), record("go_emotions", _EMOTION, "", "invalid_emotion_labels", labels=[])]),
        ("medqa", "question string, options map<string,string>, answer string, answer_idx string", [("q", {"B": "x", "A": "w", "D": "z", "C": "y"}, "x", "B"), ("q", {"A": "w", "B": "x", "C": "y", "D": "z"}, "y", "A")], [record("medqa", "Answer this medical exam question. Give the full correct option text.\n\nQuestion: q" + _LETTERS, "x", choices=[*"wxyz"], labels=["B"]), record("medqa", "Answer this medical exam question. Give the full correct option text.\n\nQuestion: q" + _LETTERS, "y", "medical_answer_key_mismatch", choices=[*"wxyz"], labels=["A"])]),
        ("logiqa", "id int, text string, question string, options array<string>, answer int", [(1, "t", "q", [*"wxyz"], 0), (1, " ", "q", [*"wxyz"], 0)], [record("logiqa", "Use logical reasoning to answer the question. Give the full correct option text.\n\nPassage: t\n\nQuestion: q" + _LETTERS, "w", choices=[*"wxyz"], labels=["0"]), record("logiqa", "Use logical reasoning to answer the question. Give the full correct option text.\n\nPassage: \n\nQuestion: q" + _LETTERS, "w", "empty_original_text", choices=[*"wxyz"], labels=["0"])]),
        ("samsum", "id string, dialogue string, summary string", [("i", "A: hi", "s")], [record("samsum", "Summarize the dialogue, preserving the important people, actions, and decisions.\n\nDialogue:\nA: hi", "s")]),
    ],
)


def _programs(name: str, build: Callable, ddl: str, rows: list[tuple], want: list[tuple]) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return build(spark.createDataFrame(rows, ddl)).select("original_id", "variant", "prompt", "answer")

    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in (x.replace("'", "''") if isinstance(x, str) else x for x in r)) + ")" for r in want)
    QUERIES[name] = (query, f"SELECT original_id, variant::INTEGER AS variant, prompt, answer FROM (VALUES {values}) t(original_id, variant, prompt, answer)")


_WRITE = "Write a Python 3 program that solves this problem. Output code only.\n\n"
_programs(
    "convert_apps", C.apps, "id string, problem_id string, question string, starter_code string, solutions string",
    [("1", "p1", "q", "", '["print(1)", "print( 1 )", "def bad(", "print(22)"]'), ("2", "p2", "q2", "def f", '["x = 1"]'), ("3", "p3", "q3", "", "not json")],
    [("p1", 0, _WRITE + "q", "print(1)"), ("p1", 1, _WRITE + "q", "print(22)"), ("p2", 0, _WRITE + "q2\n\nStarter code:\ndef f", "x = 1")],
)
_programs(
    "convert_code_contests", C.code_contests, "name string, description string, solutions struct<language:array<int>,solution:array<string>>",
    [("n1", "d", ([3, 2, 3, 3], ["x=1", "int x;", "x = 1", "y=2  "])), ("n2", "e", ([2], ["z"]))], [("n1", 0, _WRITE + "d", "x=1"), ("n1", 1, _WRITE + "d", "y=2  ")],
)
