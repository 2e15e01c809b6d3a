"""Source adapters: raw rows of a source to canonical records, as one select each.

An adapter takes a DataFrame of raw rows and returns Columns: the parts of a record, its group or its identities, and the
reasons for which a row is rejected, in the order in which they are looked for. convert() puts the source's instruction
in front of the prompt, adds identity, group digest and split, and keeps rejected rows with their reason, so that they
can be counted. Sources came in waves; a wave has its own rule for groups and its own salt for the split.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

c = F.col
ADAPTERS: dict[str, Callable[[DataFrame], dict]] = {}

#: The instruction that opens the prompts of each source.
INSTRUCTIONS = {
    "apps": "Write a Python 3 program that solves this problem. Output code only.",
    "code_contests": "Write a Python 3 program that solves this problem. Output code only.",
    "mbpp": "Write a Python 3 function for this task. Output code only.",
    "gsm8k": "Solve this math problem and explain your calculation.",
    "math": "Solve this math problem and explain your calculation.",
    "aqua_rat": "Solve this math problem and explain your calculation.",
    "squad": "Answer the question using the passage.",
    "sciq": "Answer the question using the passage.",
    "drop": "Answer the question using the passage.",
    "race": "Answer the question using the passage.",
    "quoref": "Answer the question using the passage.",
    "hotpotqa": "Answer the question using the passages.",
    "boolq": "Answer yes or no using the passage.",
    "hellaswag": "Continue this description of an activity.",
    "piqa": "Describe a way to accomplish this goal.",
    "winogrande": "Fill in the blank with the correct option.",
    "arc": "Answer this science question.",
    "openbookqa": "Answer this question.",
    "commonsenseqa": "Answer this question.",
    "qasc": "Answer this question.",
    "quartz": "Answer this question.",
    "quarel": "Choose the correct option, A or B.",
    "ropes": "Answer using the background and situation.",
    "snli": "Classify the hypothesis as entailment, neutral, or contradiction.",
    "anli": "Classify the hypothesis as entailment, neutral, or contradiction.",
    "multinli": "Classify the hypothesis as entailment, neutral, or contradiction.",
    "cb": "Classify the hypothesis as entailment, neutral, or contradiction.",
    "scitail": "Classify the hypothesis as entailment, or neutral.",
    "spider": "Write a SQL query. Output SQL only.",
    "wikisql": "Write a SQL query. Output SQL only.",
    "social_i_qa": "Answer the question using the context.",
    "cosmos_qa": "Answer the question using the context.",
    "wiqa": "Predict the effect of this change.",
    "dream": "Answer the question using the dialogue.",
    "triviaqa": "Answer this factual question with a short answer.",
    "tydiqa": "Answer using a span from the passage in its original language.",
    "tabmwp": "Answer the question using the table. Give only the final answer, including the unit when provided.",
    "mrpc": "Do these two sentences have equivalent meaning? Answer yes or no.",
    "qqp": "Do these two questions ask the same thing? Answer yes or no.",
    "wic": "Is the marked word used with the same meaning in both sentences? Answer yes or no.",
    "multirc": "Does the proposed answer correctly answer the question using the passage? Answer yes or no.",
    "wsc": "Does the second marked expression refer to the first? Answer yes or no.",
    "medqa": "Answer this medical exam question. Give the full correct option text.",
    "logiqa": "Use logical reasoning to answer the question. Give the full correct option text.",
    "samsum": "Summarize the dialogue, preserving the important people, actions, and decisions.",
}
#: Sources of the first wave and of the later ones that join rows by identities; the salts of their splits.
FIRST = ("apps", "mbpp", "gsm8k", "math", "squad", "boolq", "hellaswag", "piqa", "winogrande", "arc")
BROAD = ("social_i_qa", "cosmos_qa", "quoref", "wiqa", "dream", "anli", "scitail", "wikisql")
JOINED = ("triviaqa", "tydiqa", "tabmwp", "multinli", "mrpc", "qqp", "cb", "copa", "multirc", "wic", "wsc", "go_emotions", "medqa", "samsum", "logiqa")
PILOT, EXPANDED, EXPANSION = "pilot-v1:", "expanded-v2:", "expansion-2026-09-11:"
#: Languages of the multilingual source, as in the prefix of its ids.
LANGUAGES = ["arabic", "bengali", "english", "finnish", "indonesian", "korean", "russian", "swahili", "telugu"]
#: The 28 emotion labels in the order of their numbers.
EMOTIONS = ["admiration", "amusement", "anger", "annoyance", "approval", "caring", "confusion", "curiosity", "desire", "disappointment", "disapproval", "disgust", "embarrassment", "excitement", "fear", "gratitude", "grief", "joy", "love", "nervousness", "optimism", "pride", "realization", "relief", "remorse", "sadness", "surprise", "neutral"]
#: Label names of the other sources that number them.
ENTAILMENT = ["entailment", "neutral", "contradiction"]


def source(*names: str):
    def put(f):
        for n in names:
            ADAPTERS[n] = f
        return f

    return put


def say(*parts) -> Column:
    """Parts one after another; texts stand for themselves."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def pick(names: list[str], label: Column) -> Column:
    """The name at an integer label; null outside."""
    return F.get(F.array(*[F.lit(n) for n in names]), label.cast("int"))


def unless(sound: Column, reason: str) -> Column:
    """A reason where a condition does not hold (or is not known)."""
    return F.when(~F.coalesce(sound, F.lit(False)), reason)


def optional(d: DataFrame, name: str) -> Column:
    return c(name) if name in d.columns else F.lit(None).cast("string")


def lettered_below(options: Column) -> Column:
    return say("\n", T.lettered(options))


# ---- first wave -----------------------------------------------------------------------------------------------------
@source("mbpp")
def _mbpp(d):
    return {"body": c("text"), "answer": c("code"), "group": say("code:", T.normal("text")), "id": c("task_id")}


@source("gsm8k")
def _gsm8k(d):
    return {"body": c("question"), "answer": c("answer"), "group": say("math:", T.normal("question"))}


@source("math")
def _math(d):
    return {"body": c("problem"), "answer": c("solution"), "group": say("math:", T.normal("problem"))}


@source("squad")
def _squad(d):
    return {"body": say("Passage: ", c("context"), "\n\nQuestion: ", c("question")), "answer": F.get("answers.text", 0), "answers": F.array_distinct("answers.text"), "group": say("article:", c("title")), "id": c("id"), "title": c("title")}


@source("boolq")
def _boolq(d):
    return {"body": say("Passage: ", c("passage"), "\n\nQuestion: ", c("question")), "answer": F.when(c("answer"), "yes").otherwise("no"), "group": say("passage:", T.normal("passage"))}


@source("hellaswag")
def _hellaswag(d):
    return {"body": c("ctx"), "answer": F.get("endings", c("label").try_cast("int")), "group": say("hellaswag-source:", c("source_id"))}


@source("piqa")
def _piqa(d):
    return {"body": c("goal"), "answer": F.when(c("label").cast("int") == 0, c("sol1")).otherwise(c("sol2")), "group": say("goal:", T.normal("goal"))}


@source("winogrande")
def _winogrande(d):
    return {"body": say(c("sentence"), "\nOptions: ", c("option1"), "; ", c("option2")), "answer": F.when(c("answer") == "1", c("option1")).when(c("answer") == "2", c("option2")), "group": say("winogrande:", T.word_bag("sentence"))}


def labelled_choices(d) -> tuple[Column, Column]:
    """Lines `label. text` of the choices, and the text at the answer's label."""
    at = F.array_position(c("choices.label"), c("answerKey"))
    shown = F.array_join(F.zip_with("choices.label", "choices.text", lambda k, t: say(k, ". ", t)), "\n")
    return shown, F.when(at > 0, F.get("choices.text", (at - 1).cast("int")))


@source("arc")
def _arc(d):
    shown, answer = labelled_choices(d)
    return {"body": say(c("question"), "\n", shown), "answer": answer, "group": say("science:", T.normal("question")), "id": optional(d, "id")}


# ---- second wave ----------------------------------------------------------------------------------------------------
@source("openbookqa", "commonsenseqa", "qasc", "quartz")
def _keyed_choices(d):
    """A paragraph of knowledge comes before the instruction; two facts come before the answer."""
    question = F.coalesce(optional(d, "question"), optional(d, "question_stem"))
    shown, answer = labelled_choices(d)
    if "fact1" in d.columns:
        answer = say(c("fact1"), " ", c("fact2"), "\nAnswer: ", answer)
    before = say("Use this knowledge: ", c("para"), "\n\n") if "para" in d.columns else F.lit("")
    return {"body": say(question, "\n", shown), "answer": answer, "group": c("para_id") if "para_id" in d.columns else question, "id": optional(d, "id"), "before": before}


@source("sciq")
def _sciq(d):
    return {"body": say("Passage: ", c("support"), "\n\nQuestion: ", c("question")), "answer": c("correct_answer"), "group": F.when(c("support") != "", c("support")).otherwise(c("question"))}


@source("ropes")
def _ropes(d):
    return {"body": say("Background: ", c("background"), "\nSituation: ", c("situation"), "\nQuestion: ", c("question")), "answer": F.get("answers.text", 0), "group": c("background"), "id": c("id")}


@source("drop")
def _drop(d):
    return {"body": say("Passage: ", c("passage"), "\n\nQuestion: ", c("question")), "answer": F.array_join("answers_spans.spans", "; "), "group": c("section_id"), "id": c("query_id")}


@source("race")
def _race(d):
    return {"body": say("Passage: ", c("article"), "\n\nQuestion: ", c("question"), lettered_below(c("options"))), "answer": F.get("options", T.letter_index("answer")), "choices": c("options"), "group": c("article"), "id": say(c("example_id"), ":", F.substring(T.digest("question"), 1, 12))}


@source("quarel")
def _quarel(d):
    return {"body": c("question"), "answer": pick(["A", "B"], c("answer_index")), "group": c("question"), "id": c("id")}


@source("snli")
def _snli(d):
    return {"body": say("Premise: ", c("premise"), "\nHypothesis: ", c("hypothesis")), "answer": pick(ENTAILMENT, c("label")), "group": c("premise"), "reasons": [unless(c("label").between(0, 2), "invalid_label")]}


@source("aqua_rat")
def _aqua(d):
    return {"body": say(c("question"), "\n", F.array_join("options", "\n")), "answer": say(c("rationale"), "\nAnswer: ", F.get("options", T.letter_index("correct"))), "group": c("question"), "reasons": [unless(c("correct").rlike(r"^[A-E]\z"), "invalid_label")]}


@source("hotpotqa")
def _hotpot(d):
    paragraphs = F.array_join(F.zip_with("context.title", "context.sentences", lambda t, s: say(t, ": ", F.array_join(s, ""))), "\n\n")
    return {"body": say(paragraphs, "\n\nQuestion: ", c("question")), "answer": c("answer"), "group": c("question"), "id": c("id")}


def with_schema(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """Rows of spider with their database's schema; rows without one are left to the anti-join check."""
    return rows.join(schemas, "db_id")


@source("spider")
def _spider(d):
    """Needs the schema columns of with_schema()."""
    cols = F.arrays_zip(c("column_names_original").alias("n"), c("column_types").alias("k"))
    own = lambda i: F.transform(F.filter(cols, lambda x: x["n"]["t"] == i), lambda x: say(x["n"]["c"], " ", x["k"]))
    tables = F.transform("table_names_original", lambda n, i: say(n, "(", F.array_join(own(i), ", "), ")"))
    side = lambda i: say(F.get("table_names_original", F.get("column_names_original", i)["t"]), ".", F.get("column_names_original", i)["c"])
    keys = F.transform("foreign_keys", lambda k: say(side(F.get(k, 0)), " = ", side(F.get(k, 1))))
    return {"body": say("Schema:\n", F.array_join(tables, "\n"), "\nForeign keys: ", F.array_join(keys, "; "), "\n\nQuestion: ", c("question")), "answer": c("query"), "group": c("db_id")}


# ---- broad wave -----------------------------------------------------------------------------------------------------
def _chosen(options: Column, at: Column) -> dict:
    return {"answer": F.get(options, at), "choices": options, "below": options, "reasons": [unless(at.between(0, F.size(options) - 1), "invalid_choice")]}


@source("social_i_qa")
def _social(d):
    return {"body": say("Context: ", c("context"), "\n\nQuestion: ", c("question")), "group": c("context"), **_chosen(F.array("answerA", "answerB", "answerC"), c("label").try_cast("int") - 1)}


@source("cosmos_qa")
def _cosmos(d):
    return {"body": say("Context: ", c("context"), "\n\nQuestion: ", c("question")), "group": c("context"), **_chosen(F.array("answer0", "answer1", "answer2", "answer3"), c("label"))}


@source("quoref")
def _quoref(d):
    return {"body": say("Passage: ", c("context"), "\n\nQuestion: ", c("question")), "answer": F.get("answers.text", 0), "answers": c("answers.text"), "group": F.coalesce(F.when(c("url") != "", c("url")), c("context")), "id": c("id")}


@source("wiqa")
def _wiqa(d):
    answer = F.replace(c("answer_label"), F.lit("_"), F.lit(" "))
    return {"body": say("Process:\n", F.array_join("question_para_step", "\n"), "\n\nQuestion: ", c("question_stem")), "answer": answer, "choices": c("choices.text"), "below": c("choices.text"), "group": say("wiqa:", c("metadata_para_id").cast("string")), "reasons": [unless(F.array_contains(c("choices.text"), answer), "answer_not_a_choice")]}


@source("dream")
def _dream(d):
    return {"body": say("Dialogue:\n", F.array_join("dialogue", "\n"), "\n\nQuestion: ", c("question")), "answer": c("answer"), "choices": c("choice"), "below": c("choice"), "group": say("dialogue:", c("dialogue_id")), "reasons": [unless(F.array_contains("choice", c("answer")), "answer_not_a_choice")]}


@source("anli")
def _anli(d):
    return {"body": say("Premise: ", c("premise"), "\nHypothesis: ", c("hypothesis")), "answer": pick(ENTAILMENT, c("label")), "group": c("premise"), "id": c("uid"), "reasons": [unless(c("label").between(0, 2), "invalid_label")]}


@source("scitail")
def _scitail(d):
    answer = F.when(c("label") == "entails", "entailment").otherwise(c("label"))
    return {"body": say("Premise: ", c("premise"), "\nHypothesis: ", c("hypothesis")), "answer": answer, "group": c("premise"), "reasons": [unless(answer.isin("entailment", "neutral"), "invalid_label")]}


@source("wikisql")
def _wikisql(d):
    sql = T.sql_text(c("sql.sel"), c("sql.agg"), c("sql.conds.column_index"), c("sql.conds.operator_index"), c("sql.conds.condition"), c("table.header"))
    named = F.zip_with("table.header", "table.types", lambda h, k: say('"', F.replace(h, F.lit('"'), F.lit('""')), '" ', F.when(k == "real", "REAL").otherwise("TEXT")))
    return {"body": say("Schema:\ndata(", F.array_join(named, ", "), ")\n\nQuestion: ", c("question")), "answer": sql, "group": say("wikisql-table:", c("table.id")), "reasons": [unless(sql.isNotNull(), "invalid_sql")]}


# ---- waves joined by identities -------------------------------------------------------------------------------------
def same(kind: str, text: Column) -> tuple[str, Column]:
    return kind, text


def context(text: Column) -> dict:
    """A text that has to be there, and that rows may share: an identity and a check."""
    return {"identities": [same("context", T.clean(text))], "checks": [same("context", T.clean(text))], "reasons": [unless(T.strip_ends(text) != "", "empty_original_text")]}


def both(*parts: dict) -> dict:
    """Parts of a record; identities, checks and reasons are gathered in order."""
    lists = {k: reduce(lambda a, p: a + p.get(k, []), parts, []) for k in ("identities", "checks", "reasons")}
    return reduce(lambda a, p: a | p, parts, {}) | lists


def labelled(label: Column, names: list[str], reason: str = "invalid_original_label") -> dict:
    return {"labels": F.array(pick(names, label)), "reasons": [unless(label.between(0, len(names) - 1), reason)]}


def yes_or_no(label: Column) -> dict:
    answer = pick(["no", "yes"], label)
    return {"answer": answer, "labels": F.array(answer), "reasons": [unless(label.between(0, 1), "invalid_original_label")]}


@source("triviaqa")
def _trivia(d):
    question = T.strip_ends("question")
    return {"body": say("Question: ", question), "answer": c("answer.value"), "aliases": c("answer.aliases"), "identities": [same("question", question)], "checks": [same("question", question)], "id": c("question_id"), "language": F.lit("english"), "reasons": [unless(question != "", "empty_question")]}


@source("tydiqa")
def _tydi(d):
    language, question = F.get(F.split("id", "-"), 0), T.strip_ends("question")
    pairs = F.arrays_zip(c("answers.text").alias("t"), c("answers.answer_start").alias("s"))
    match = F.forall(pairs, lambda x: F.substring(c("context"), x["s"] + 1, F.length(x["t"])) == x["t"])
    shared = [same("context", c("context")), same("article", c("title"))]
    article = T.digest(say("article:", c("title")))
    return {
        "body": say("Passage: ", c("context"), "\n\nQuestion: ", question), "answer": F.get("answers.text", 0), "answers": c("answers.text"), "identities": shared, "checks": shared, "group_checks": article, "id": c("id"), "title": c("title"), "language": language, "offsets_match": match,
        "reasons": [
            unless(question != "", "empty_question"), unless(language.isin(LANGUAGES), "language"), unless((F.size("answers.text") > 0) & (F.size("answers.text") == F.size("answers.answer_start")), "misaligned_answers"),
            unless(F.forall("answers.answer_start", lambda x: x >= 0), "negative_offset"), unless(F.forall("answers.text", lambda t: (t != "") & F.contains(c("context"), t)), "answer_not_in_context"),
        ],
    }


@source("tabmwp")
def _tabmwp(d):
    question, unit = T.strip_ends("question"), F.coalesce("unit", F.lit(""))
    has = F.coalesce(F.size("choices") > 0, F.lit(False))
    more = say(F.when(has, say("\nChoices: ", F.array_join("choices", "; "))).otherwise(""), F.when(unit != "", say("\nUnit: ", unit)).otherwise(""))
    return {
        "body": say("Table title: ", F.coalesce("table_title", F.lit("")), "\nTable:\n", c("table"), "\n\nQuestion: ", question, more), "answer": F.when(unit != "", say(c("answer"), " ", unit)).otherwise(c("answer")), "choices": F.when(has, c("choices")), "identities": [same("table", c("table"))], "checks": [same("table", c("table"))],
        "id": c("uid"), "language": F.lit("english"), "reasons": [unless(question != "", "empty_question"), unless(c("split") == "train", "split"), unless(T.strip_ends("table") != "", "missing_table"), unless(~has | F.array_contains("choices", c("answer")), "answer_not_a_choice")],
    }


def _inference(names: list[str], id_: Column, **more) -> dict:
    hypothesis = T.strip_ends("hypothesis")
    return both({"body": say("Premise: ", T.strip_ends("premise"), "\nHypothesis: ", hypothesis), "answer": pick(names, c("label")), "id": id_}, context(c("premise")), {"reasons": [unless(hypothesis != "", "empty_hypothesis")]}, labelled(c("label"), names), more)


@source("multinli")
def _multinli(d):
    return _inference(ENTAILMENT, c("pairID"), identities=[same("multinli-prompt", c("promptID").cast("string"))])


@source("cb")
def _cb(d):
    return _inference(["entailment", "contradiction", "neutral"], c("idx").cast("string"))


def _pair(a: str, b: str, first: Column | None = None, second: Column | None = None, **more) -> dict:
    shown = [T.strip_ends(a) if first is None else first, T.strip_ends(b) if second is None else second]
    return both({"body": say("First: ", shown[0], "\nSecond: ", shown[1]), "id": c("idx").cast("string")}, context(c(a)), context(c(b)), yes_or_no(c("label")), more)


@source("mrpc")
def _mrpc(d):
    return _pair("sentence1", "sentence2")


@source("qqp")
def _qqp(d):
    return _pair("question1", "question2")


def marked(text: Column, start: Column, end: Column) -> Column:
    """The text with marks around the code points from start to end."""
    return say(F.substring(text, F.lit(1), start), "[TARGET]", F.substring(text, start + 1, end - start), "[/TARGET]", F.substring(text, end + 1, F.length(text)))


@source("wic")
def _wic(d):
    inside = lambda i: (c(f"start{i}") >= 0) & (c(f"start{i}") < c(f"end{i}")) & (c(f"end{i}") <= F.length(f"sentence{i}"))
    show = lambda i: marked(c(f"sentence{i}"), c(f"start{i}"), c(f"end{i}"))
    return _pair("sentence1", "sentence2", show(1), show(2), reasons=[unless(inside(1) & inside(2), "invalid_word_span")])


@source("copa")
def _copa(d):
    options = F.array("choice1", "choice2")
    body = say("Premise: ", T.strip_ends("premise"), "\nA. ", c("choice1"), "\nB. ", c("choice2"))
    instruction = say("Choose the more plausible ", c("question"), ". Give the full option text.")
    return both({"instruction": instruction, "body": body, "answer": F.get(options, c("label")), "choices": options, "id": c("idx").cast("string")}, context(c("premise")), {"reasons": [unless(c("question").isin("cause", "effect"), "unknown_direction")]}, labelled(c("label"), ["choice1", "choice2"]))


@source("multirc")
def _multirc(d):
    number = F.concat_ws(":", *[c(f"idx.{k}").cast("string") for k in ("paragraph", "question", "answer")])
    body = say("Passage: ", T.strip_ends("paragraph"), "\n\nQuestion: ", c("question"), "\nProposed answer: ", c("answer"))
    return both({"body": body, "id": number}, context(c("paragraph")), {"identities": [same("multirc-paragraph", c("idx.paragraph").cast("string"))]}, yes_or_no(c("label")))


@source("wsc")
def _wsc(d):
    sound = lambda i: T.word_at("text", f"span{i}_index") & (c(f"span{i}_text") != "")
    shown = lambda i, name: say(f"\n{name} expression: ", c(f"span{i}_text"), " (word index ", c(f"span{i}_index").cast("string"), ", zero-based)")
    return both({"body": say("Passage: ", T.strip_ends("text"), shown(1, "First"), shown(2, "Second")), "id": c("idx").cast("string")}, context(c("text")), {"reasons": [unless(sound(1) & sound(2), "invalid_coreference_span")]}, yes_or_no(c("label")))


@source("go_emotions")
def _emotions(d):
    numbers = F.array_sort(F.array_distinct("labels"))
    names = F.transform(numbers, lambda i: pick(EMOTIONS, i))
    sound = (F.size("labels") > 0) & F.forall("labels", lambda i: i.between(0, len(EMOTIONS) - 1))
    body = say(f"Allowed labels: {', '.join(EMOTIONS)}\n\nComment: ", T.strip_ends("text"))
    instruction = F.lit("List all annotated emotions expressed in this comment, separated by semicolons.")
    return both({"instruction": instruction, "gap": "\n", "body": body, "answer": F.array_join(names, "; "), "labels": names, "id": c("id")}, context(c("text")), {"reasons": [unless(sound, "invalid_emotion_labels")]})


@source("medqa")
def _medqa(d):
    question = T.strip_ends("question")
    options = F.array(*[F.try_element_at("options", F.lit(k)) for k in "ABCD"])
    sound = (F.array_sort(F.map_keys("options")) == F.array(*[F.lit(k) for k in "ABCD"])) & (F.try_element_at("options", c("answer_idx")) == c("answer"))
    return both({"body": say("Question: ", question, lettered_below(options)), "answer": c("answer"), "choices": options, "labels": F.array("answer_idx")}, context(c("question")), {"checks": [same("question", question)], "reasons": [unless(sound, "medical_answer_key_mismatch")]})


@source("logiqa")
def _logiqa(d):
    sound = (F.size("options") == 4) & c("answer").between(0, 3)
    return both({"body": say("Passage: ", T.strip_ends("text"), "\n\nQuestion: ", c("question"), lettered_below(c("options"))), "answer": F.get("options", c("answer")), "choices": c("options"), "labels": F.array(c("answer").cast("string")), "id": c("id").cast("string")}, context(c("text")), {"reasons": [unless(sound, "logic_answer_key_mismatch")]})


@source("samsum")
def _samsum(d):
    spoken = same("dialogue-content", T.spoken("dialogue"))
    return both({"body": say("Dialogue:\n", T.strip_ends("dialogue")), "answer": c("summary"), "id": c("id")}, context(c("dialogue")), {"identities": [spoken], "checks": [spoken]})


# ---- programs -------------------------------------------------------------------------------------------------------
def programs(df: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Rows (keys, program) to the first `most` programs by (length, text) that parse, one for each syntax tree."""
    d = df.withColumn("code_key", T.code_key("program")).filter("code_key IS NOT NULL")
    first = F.row_number().over(Window.partitionBy(*keys, "code_key").orderBy(F.length("program"), "program"))
    d = d.withColumn("n", first).filter("n = 1")
    return d.withColumn("variant", F.row_number().over(Window.partitionBy(*keys).orderBy(F.length("program"), "program")) - 1).filter(F.col("variant") < most).drop("n")


def apps(df: DataFrame) -> DataFrame:
    """One record for each kept solution; the starter code closes the prompt; invalid JSON has no records."""
    found = F.from_json("solutions", "array<string>", {"mode": "PERMISSIVE"})
    d = df.select(F.coalesce("problem_id", "id").alias("original_id"), "question", F.coalesce("starter_code", F.lit("")).alias("starter"), F.explode(found).alias("program"))
    p = programs(d, ["original_id", "question", "starter"])
    more = F.when(F.col("starter") != "", say("\n\nStarter code:\n", c("starter"))).otherwise("")
    prompt = say(INSTRUCTIONS["apps"], "\n\n", c("question"), more)
    return p.select("original_id", "variant", prompt.alias("prompt"), F.col("program").alias("answer"), T.digest(say("code:", T.normal("question"))).alias("group"), "code_key")


def code_contests(df: DataFrame) -> DataFrame:
    """Solutions in Python 3 (language 3) by the same rule."""
    zipped = F.filter(F.arrays_zip(c("solutions.language").alias("l"), c("solutions.solution").alias("s")), lambda x: x["l"] == 3)
    d = df.select(c("name").alias("original_id"), c("description").alias("question"), F.explode(F.transform(zipped, lambda x: x["s"])).alias("program"))
    return programs(d, ["original_id", "question"]).select("original_id", "variant", say(INSTRUCTIONS["code_contests"], "\n\n", c("question")).alias("prompt"), c("program").alias("answer"), T.digest(say("code_contests:", T.normal("question"))).alias("group"), "code_key")


def parts(df: DataFrame, name: str) -> dict[str, Column]:
    """The columns of a source's records over its raw rows, but for the split; `__split_of` is what that is told from.

    They are plain expressions, so several sources can be converted in one pass over rows that hold the raw columns of each.
    """
    f = ADAPTERS[name](df)
    none = F.lit(None).cast("string")
    many = F.lit(None).cast("array<string>")
    opening = f.get("instruction", F.lit(INSTRUCTIONS.get(name, "")))
    prompt = say(f.get("before", ""), opening, f.get("gap", "\n\n"), f["body"], lettered_below(f["below"]) if "below" in f else "")
    uid = F.coalesce(f.get("id", none).cast("string"), T.digest(F.concat_ws("\n", prompt, f["answer"])))
    blank = unless(T.strip_ends(f["answer"]) != "", "empty_answer")
    reserved = F.when(T.has_control_token(prompt) | T.has_control_token(f["answer"]), "reserved_token_in_original")
    identities = checks = many
    if name in JOINED:
        identities = T.keys_of([*f["identities"], same(f"{name}-id", uid), same("prompt", prompt)])
        checks = T.keys_of([*f["checks"], same("prompt", prompt)])
        if "group_checks" in f:
            checks = F.concat(checks, F.array(say("base-group:", f["group_checks"])))
        group = T.digest(F.array_min(identities))
    elif name in FIRST:
        group = T.digest(f["group"])
    else:
        group = T.digest(T.normal(f["group"]) if name in BROAD else say(f"{name}:", T.normal(f["group"])))
    return {
        "source": F.lit(name), "original_id": uid, "variant": F.lit(0), "group": group, "__split_of": f["group"] if name in FIRST else group,
        "prompt": prompt, "answer": f["answer"], "original_split": F.lit("train"), "language": f.get("language", none), "choices": f.get("choices", many),
        "answers": f.get("answers", many), "original_labels": f.get("labels", many), "aliases": f.get("aliases", many), "title": f.get("title", none),
        "original_answer_offsets_match": f.get("offsets_match", F.lit(None).cast("boolean")), "identities": identities, "checks": checks, "reason": F.coalesce(*f.get("reasons", []), blank, reserved),
    }


def convert(df: DataFrame, name: str) -> DataFrame:
    """Canonical records of a source with `reason` where a row is rejected; ids default to the content's digest.

    Groups of the first waves are digests of a text; of the joined ones of the row's least identity, which
    graph.connected_groups() replaces by that of all rows connected to it. Splits follow the wave's salt.
    """
    out = df.select(*[x.alias(k) for k, x in parts(df, name).items()])
    salt, confirmation = (EXPANSION, 5) if name in JOINED else (PILOT if name in FIRST or name in BROAD else EXPANDED, 0)
    return out.withColumn("split", T.split_of("__split_of", salt, 5, confirmation)).drop("__split_of")


def accepted(records: DataFrame) -> DataFrame:
    return records.filter("reason IS NULL").drop("reason")


def pair_ordered(rows: DataFrame, labels: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Two files by position; lengths have to be equal."""
    if rows.count() != labels.count():
        raise ValueError("the files differ in length")
    return rows.join(labels, ordinal)


def hotpot_to_train(df: DataFrame) -> DataFrame:
    """D12."""
    return df.withColumn("split", F.when(F.col("source") == "hotpotqa", "train").otherwise(F.col("split")))


def code_tasks(raw: DataFrame, dev: DataFrame) -> DataFrame:
    """Raw tasks with the references of the held-out records that name them, and a reason where not usable."""
    refs = dev.groupBy("source", "original_id").agg(F.sort_array(F.collect_list(F.struct("variant", "answer"))).alias("r")).select("source", c("original_id").alias("id"), F.transform("r", lambda x: x["answer"]).alias("references"))
    reason = F.when(c("fn_name").isNotNull(), "function_interface").when(F.size("inputs") != F.size("outputs"), "unaligned_tests")
    return raw.join(refs, ["source", "id"]).withColumn("reason", reason).withColumn("cases", F.zip_with("inputs", "outputs", lambda i, o: F.struct(i.alias("input"), o.alias("output"))))


def with_boundary_cases(tasks: DataFrame, extra: DataFrame) -> DataFrame:
    """Fixed cases of (id, extra_cases) appended, and a coverage label."""
    j = tasks.join(extra, "id", "left")
    label = F.when(c("extra_cases").isNotNull(), "stronger").when(F.size("cases") > 1, "several").otherwise("single")
    return j.withColumn("coverage", label).withColumn("cases", F.concat("cases", F.coalesce("extra_cases", F.array().cast(tasks.schema["cases"].dataType)))).drop("extra_cases")


def public_example(tasks: DataFrame) -> DataFrame:
    """The first case is shown, the rest are scored."""
    return tasks.withColumn("shown", F.get("cases", 0)).withColumn("scored", F.slice("cases", 2, F.greatest(F.size("cases"), F.lit(1))))
