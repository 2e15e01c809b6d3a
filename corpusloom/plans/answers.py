"""Queries of final answers, contracts, scorers, prompts, diagnostics and keys over answers made of the documents' texts.

A document's first line, rest, language, source and length are put into the forms that answers and prompts take, sound and
unsound ones by turns of doc_id and length; the SQL states each rule on the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import tokens as K
from corpusloom.operators import grading as G
from corpusloom.operators import scoring
from corpusloom.plans.adapters import ROWS_SQL, STRIP, _rows
from corpusloom.plans.corpus import FOLD_SQL

QUERIES: dict = {}
NL = "chr(10)"


def states(sql: str):
    """Register the decorated query with the SQL of its result; {r} are the rows that it starts from."""

    def put(f):
        QUERIES[f.__name__] = (f, f"WITH {ROWS_SQL}" + sql)
        return f

    return put


def cycle(by: str, *values) -> Column:
    """The value at a number modulo their count; texts stand for themselves, Columns for what they hold."""
    out = None
    for i, v in enumerate(values):
        hit, value = F.pmod(F.col(by), F.lit(len(values))) == i, v if isinstance(v, Column) else F.lit(v)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _columns() -> tuple[Column, ...]:
    """First line, rest, source, language, length and number of a document, and the length as text."""
    return *(F.col(c) for c in ("q", "p", "s", "lang", "n", "k")), F.col("n").cast("string")


LOW = "lower(replace({0}, 'ß', 'ss'))"


# ---- answers --------------------------------------------------------------------------------------------------------
@states(f""", t AS (SELECT *, ['gsm8k', 'math', 'aqua_rat', 'boolq'][k % 4 + 1] AS src FROM r)
SELECT k, src, CASE src WHEN 'gsm8k' THEN [n || '500', NULL, n || '.5'][n % 3 + 1] WHEN 'math' THEN CASE WHEN n % 3 < 2 THEN '\\frac{{' || n || '}}{{2}}' END
  WHEN 'aqua_rat' THEN CASE WHEN n % 3 < 2 THEN lang END ELSE md5(trim(regexp_replace({LOW.format('q')}, '\\s+', ' ', 'g'))) END AS answer FROM t""")
def final_answers(spark, sf):
    """the last number behind ####, the last box with balanced braces, what follows `Answer:`, or the folded text."""
    q, p, s, lang, n, k, num = _columns()
    src = cycle("k", "gsm8k", "math", "aqua_rat", "boolq")
    number = say(p, "\n#### ", cycle("n", say(num, ",500"), say("about ", num), say(num, ".5")))
    box = F.when(n % 3 < 2, say(p, "\\boxed{1} so \\boxed{\\frac {", num, "}{2}} done")).otherwise(say(p, "\\boxed{\\frac{", num, "}{2}"))
    last = F.when(n % 3 < 2, say(p, "\nAnswer:  ", F.upper(lang), " \n")).otherwise(q)
    t = F.when(src == "gsm8k", number).when(src == "math", box).when(src == "aqua_rat", last).otherwise(q)
    d = _rows(spark, sf).select("k", src.alias("src"), t.alias("t"))
    answer = G.final_answer("t", F.col("src"))
    return d.select("k", "src", F.when(F.col("src") == "boolq", F.md5(answer)).otherwise(answer).alias("answer"))


_BLANK = STRIP.format("q") + " = ''"


@states(f""", t AS (SELECT k, q, lang, s, n, ['choice', 'number', 'text', 'external'][k % 4 + 1] AS kind,
  CASE k % 4 WHEN 0 THEN ['A', 'B', 'Q'][n % 3 + 1] WHEN 1 THEN [n || '.0', n || '.50', 'many'][n % 3 + 1] ELSE [upper(lang), s, lang][n % 3 + 1] END AS x,
  CASE n % 5 WHEN 3 THEN {_BLANK} WHEN 4 THEN {_BLANK} WHEN 1 THEN false ELSE true END AS told FROM r)
SELECT k, kind, CASE WHEN told THEN x END AS content, CASE WHEN kind = 'external' THEN 'unscored_external_grader_required' WHEN NOT told THEN 'format_error'
  WHEN kind = 'choice' THEN CASE x WHEN 'Q' THEN 'format_error' WHEN 'B' THEN 'correct' ELSE 'incorrect' END
  WHEN kind = 'number' THEN CASE WHEN x = 'many' THEN 'format_error' WHEN x::DOUBLE = n THEN 'correct' ELSE 'incorrect' END
  ELSE CASE WHEN lower(x) = lower(lang) THEN 'correct' ELSE 'incorrect' END END AS status FROM t""")
def graded_contracts(spark, sf):
    """Contents of contract lines, graded by kind; two lines, a line too many or none have no content."""
    q, p, s, lang, n, k, num = _columns()
    x = F.when(k % 4 == 0, cycle("n", "A", "B", "Q")).when(k % 4 == 1, cycle("n", say(num, ".0"), say(num, ".50"), "many")).otherwise(cycle("n", F.upper(lang), s, lang))
    d = _rows(spark, sf).withColumn("x", x).withColumn("kind", cycle("k", "choice", "number", "text", "external"))
    told = say("Final answer: ", F.col("x"))
    d = d.withColumn("t", cycle("n", say(q, "\n", told), say(told, "\n", told), F.col("x"), say(q, "\n", F.col("x")), say(told, "\n", q)))
    d = d.withColumn("reference", cycle("k", "B", num, lang, lang)).withColumn("choices", F.array("lang", "s")).withColumn("content", G.contract_line("t"))
    return d.select("k", "kind", "content", G.grade("kind", "content", "reference", "choices")["status"].alias("status"))


_CONTRACT = f"""{NL} || {NL} || 'You may explain your reasoning. End with exactly one line in this format:' || {NL} || 'Final answer: <' || contract || '>' || {NL} || 'Do not put Markdown formatting around that final line.'"""


@states(f""", t AS (SELECT *, ['choice', 'number', 'legacy_proxy', 'external', 'text'][k % 5 + 1] AS kind, ['gsm8k', 'math', 'qasc', 'go_emotions', 'boolq'][n % 5 + 1] AS src FROM r),
c AS (SELECT *, CASE kind WHEN 'choice' THEN 'the single option letter' WHEN 'number' THEN 'the numeric result, without units' WHEN 'legacy_proxy' THEN
  CASE WHEN src = 'gsm8k' THEN 'the numeric result only, without units' WHEN src = 'math' THEN 'the final mathematical expression, without a box wrapper'
  WHEN src = 'qasc' THEN 'the option letter followed by its exact option text, as shown in the question' WHEN n % 2 = 0 THEN 'the exact text of the selected option (not its letter)'
  WHEN src = 'go_emotions' THEN 'the emotion labels separated by commas' ELSE 'the answer only, without explanation' END ELSE 'the short answer only' END AS contract FROM t)
SELECT k, md5(CASE WHEN n % 3 = 0 THEN 'System instructions:' || {NL} || s || {NL} || {NL} ELSE '' END || CASE WHEN kind = 'external' THEN q ELSE q || CASE WHEN kind = 'choice' THEN {NL} || {NL} || 'A. ' || lang || {NL} || 'B. ' || s ELSE '' END || {_CONTRACT} END) AS prompt FROM c""")
def contract_prompts(spark, sf):
    """prompts of every kind with lettered choices, their contract and system instructions."""
    q, p, s, lang, n, k, num = _columns()
    d = _rows(spark, sf).withColumn("kind", cycle("k", "choice", "number", "legacy_proxy", "external", "text")).withColumn("src", cycle("n", "gsm8k", "math", "qasc", "go_emotions", "boolq"))
    d = d.withColumn("choices", F.array("lang", "s")).withColumn("legacy", F.when(n % 2 == 0, F.array("lang")))
    prompt = G.prompt_for("kind", "q", "choices", "src", "legacy")
    return d.select("k", F.md5(G.input_text(F.when(n % 3 == 0, s), prompt)).alias("prompt"))


@states(f""", t AS (SELECT k, ['boolq', 'snli', 'scitail', 'wiqa'][k % 4 + 1] AS src, ['yes', 'neutral', 'no effect', regexp_replace(regexp_replace({STRIP.format(LOW.format('q'))}, '^(answer|label)\\s*:\\s*', ''), '[.!]+$', '')][n % 4 + 1] AS x FROM r)
SELECT k, CASE WHEN x IN (SELECT unnest(CASE src WHEN 'boolq' THEN ['yes', 'no'] WHEN 'snli' THEN ['entailment', 'neutral', 'contradiction'] WHEN 'scitail' THEN ['entailment', 'neutral'] ELSE ['more', 'less', 'no effect'] END)) THEN x END AS label FROM t""")
def labels_in_answers(spark, sf):
    """answers that are a label of their source but for case, a word in front and marks behind."""
    q, p, s, lang, n, k, num = _columns()
    d = _rows(spark, sf).withColumn("src", cycle("k", "boolq", "snli", "scitail", "wiqa")).withColumn("t", cycle("n", "Answer: YES.", " label :  Neutral!! ", "No effect", q))
    return d.select("k", G.label_diagnostic("src", "t").alias("label"))


@states(""", t AS (SELECT k, n, CASE k % 4 WHEN 0 THEN n + k * 3 WHEN 1 THEN n - k WHEN 2 THEN -(n::BIGINT) * 2 END AS over, CASE k % 4 WHEN 1 THEN 4 ELSE 1 END AS under FROM r)
SELECT k, CASE WHEN over IS NOT NULL THEN (over // gcd(abs(over), under)) || '/' || (under // gcd(abs(over), under)) END AS value FROM t""")
def values_of_expressions(spark, sf):
    """exact values of expressions with brackets, signs and fractions; what is none has no value."""
    q, p, s, lang, n, k, num = _columns()
    key = k.cast("string")
    t = cycle("k", say(num, " + ", key, "*3"), say("(", num, "-", key, ") / 4"), say("-", num, " * (1 + 1)"), say(num, " + ("))
    return _rows(spark, sf).select("k", G.arithmetic(t).alias("value"))


@states(f""", t AS (SELECT *, CASE WHEN k % 6 = 0 THEN ' ' WHEN k % 6 = 1 THEN 'Answer: Yes.' ELSE q || ' <<' || n || '+1=' || (n + 1 + n % 2) || '>>' END AS g FROM r),
w AS (SELECT *, regexp_extract_all(g, '[^\\s]+') AS w FROM t),
f AS (SELECT *, CASE WHEN len(w) >= 20 THEN list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], chr(1))) ELSE [] END AS four FROM w)
SELECT k, array_to_string(list_filter([CASE WHEN trim(g) = '' THEN 'empty_answer' END, CASE WHEN n % 4 = 0 THEN 'token_limit' END, CASE WHEN len(four) > 0 AND len(list_distinct(four)) / len(four) < 0.55 THEN 'repetition' END,
  CASE WHEN k % 3 = 0 THEN CASE WHEN k % 6 = 1 AND k % 2 = 1 THEN 'trivial_label_format_only' WHEN k % 2 = 1 THEN CASE WHEN {LOW.format(STRIP.format('g'))} IN ('yes', 'no') THEN 'wrong_label' ELSE 'label_format_or_content' END ELSE 'answer_mismatch_cause_unresolved' END END,
  CASE WHEN k % 6 > 1 AND n % 2 = 1 THEN 'explicit_arithmetic_inconsistency' END], lambda x: x IS NOT NULL), ',') AS tags, CASE WHEN k % 6 > 1 THEN 1 ELSE 0 END AS checked FROM f""")
def tags_of_answers(spark, sf):
    """symptoms of answers: empty, cut off, repeated, wrong labels, wrong sums."""
    q, p, s, lang, n, k, num = _columns()
    g = F.when(k % 6 == 0, " ").when(k % 6 == 1, "Answer: Yes.").otherwise(say(q, " <<", num, "+1=", (n + 1 + n % 2).cast("string"), ">>"))
    d = _rows(spark, sf).select("k", g.alias("g"), F.when(k % 2 == 1, "boolq").otherwise("squad").alias("src"), F.when(n % 4 == 0, "token_limit").otherwise("stop").alias("stop"), (k % 3 > 0).alias("ok"))
    tags = G.error_tags("src", "g", "stop", "ok", F.lit("yes"))
    return d.withColumn("t", tags).select("k", F.array_join("t.tags", ",").alias("tags"), F.col("t.checked").alias("checked"))


@states(""", t AS (SELECT k, list_filter(regexp_split_to_array(q || ' ' || n, '\\s+'), lambda x: x <> '') AS x, list_filter(regexp_split_to_array(CASE k % 4 WHEN 0 THEN '  ' || q || '  ' || n WHEN 1 THEN q || ' ' || (n + 1) WHEN 2 THEN q || ' ' || n || '.0' ELSE q END, '\\s+'), lambda x: x <> '') AS y FROM r)
SELECT k, len(x) = len(y) AND len(list_filter(list_zip(x, y), lambda t: t[1] = t[2] OR (NOT (regexp_full_match(t[1], '[+-]?[0-9]+') AND regexp_full_match(t[2], '[+-]?[0-9]+'))
  AND coalesce(abs(TRY_CAST(t[1] AS DOUBLE) - TRY_CAST(t[2] AS DOUBLE)) <= 1e-6 * greatest(abs(TRY_CAST(t[1] AS DOUBLE)), abs(TRY_CAST(t[2] AS DOUBLE))), false)))) = len(x) AS same FROM t""")
def outputs_alike(spark, sf):
    """outputs word by word; whole numbers exactly, others nearly."""
    q, p, s, lang, n, k, num = _columns()
    b = cycle("k", say("  ", q, "  ", num), say(q, " ", (n + 1).cast("string")), say(q, " ", num, ".0"), q)
    return _rows(spark, sf).select("k", scoring.same_output(say(q, " ", num), b).alias("same"))


_SOURCES = ("triviaqa", "tydiqa", "go_emotions", "multinli", "apps", "hellaswag", "spider", "squad", "boolq", "samsum")


@states(f""", t AS (SELECT *, {list(_SOURCES)}[k % 10 + 1] AS src FROM r)
SELECT k, CASE WHEN src IN ('triviaqa', 'tydiqa') THEN 'original_answer_exact_proxy' WHEN src = 'go_emotions' THEN 'emotion_label_set_exact_and_f1' WHEN src = 'multinli' THEN 'original_label_or_answer_match'
  WHEN src = 'apps' THEN 'syntax_only_not_functional' WHEN src = 'hellaswag' THEN 'unscored_open_generation' WHEN src = 'spider' THEN 'sql_text_match_not_execution' WHEN src = 'squad' THEN 'answer_exact_and_token_f1'
  WHEN src = 'samsum' THEN 'summary_unigram_f1_proxy_not_factuality' ELSE 'answer_match' END AS metric,
  CASE src WHEN 'triviaqa' THEN n % 2 = 0 WHEN 'tydiqa' THEN n % 3 < 2 WHEN 'go_emotions' THEN n % 2 = 0 WHEN 'multinli' THEN n % 2 = 0 WHEN 'squad' THEN n % 2 = 0 WHEN 'boolq' THEN n % 2 = 0 END AS correct,
  round(CASE src WHEN 'squad' THEN CASE WHEN n % 2 = 0 THEN 1.0 ELSE 0.0 END WHEN 'samsum' THEN 2.0 / 3 END, 6)::DOUBLE AS token_f1, round(CASE WHEN src = 'go_emotions' THEN CASE WHEN n % 2 = 0 THEN 1.0 ELSE 2.0 / 3 END END, 6)::DOUBLE AS label_f1,
  CASE WHEN src = 'spider' THEN n % 2 = 0 END AS text_match, CASE WHEN src = 'apps' THEN n % 2 = 0 END AS syntax_valid, CASE WHEN src = 'hellaswag' THEN {STRIP.format('p')} <> '' END AS nonempty FROM t""")
def scores_by_source(spark, sf):
    """Responses scored by the rule of their source: exact, sets of labels, letters, syntax, SQL text, F1."""
    q, p, s, lang, n, k, num = _columns()
    even = n % 2 == 0
    g = cycle("k", say("  ", F.upper(lang), " "), cycle("n", s, F.upper(lang), "odd"), F.when(even, "Joy; LOVE").otherwise("joy, fear, joy"), "B.", F.when(even, say("x = ", num)).otherwise("def bad("), p, say(" SELECT ", num, ";; "), say("The ", lang), F.when(even, "A)").otherwise("B"), say(lang, " ", s))
    a = cycle("k", F.when(even, lang).otherwise(s), lang, "joy; love", F.when(even, s).otherwise(lang), "x", "x", F.when(even, say("select ", num)).otherwise("select"), lang, lang, s)
    answers = F.when(k % 10 == 1, F.array("s", "lang")).when(k % 10 == 7, F.when(even, F.array("s", "lang")).otherwise(F.array("s")))
    labels = F.when(k % 10 == 2, F.when(even, F.array(F.lit("love"), F.lit("joy"))).otherwise(F.array(F.lit("joy"))))
    d = _rows(spark, sf).select("k", cycle("k", *_SOURCES).alias("src"), g.alias("g"), a.alias("a"), answers.alias("answers"), labels.alias("labels"), F.array("lang", "s").alias("choices"))
    m = d.withColumn("m", G.score_general("src", "g", "a", "answers", "choices", "labels"))
    return m.select("k", "m.metric", "m.correct", F.round("m.token_f1", 6).alias("token_f1"), F.round("m.label_f1", 6).alias("label_f1"), "m.text_match", "m.syntax_valid", "m.nonempty")


@states(f""" SELECT k, {STRIP.format('q')} = {STRIP.format("CASE WHEN k % 3 = 0 THEN q || ' ' ELSE p END")} AS recalled FROM r""")
def recalled_answers(spark, sf):
    """G1: whether the stripped texts are equal."""
    q, p, s, lang, n, k, num = _columns()
    d = _rows(spark, sf).withColumn("a", F.when(k % 3 == 0, say(q, " ")).otherwise(p))
    return d.select("k", G.score_general(F.lit("squad"), "q", "a", memorization=True)["correct"].alias("recalled"))


@states(""" SELECT k::VARCHAR AS id, ['final_answer_match', 'final_answer_match', 'emotion_label_set_exact_and_f1'][k % 5 + 1] AS metric FROM r WHERE k % 5 = 1 AND n % 2 = 0 OR k % 5 = 2 AND n % 2 = 0""")
def references_that_fail(spark, sf):
    """References that their own scorer cannot read or does not accept."""
    q, p, s, lang, n, k, num = _columns()
    even = n % 2 == 0
    answer = cycle("k", say("so #### ", num), F.when(even, "five").otherwise(say("#### ", num)), "joy", say("x = ", num), lang)
    labels = F.when(k % 5 == 2, F.when(even, F.array(F.lit("joy"), F.lit("love"))).otherwise(F.array(F.lit("joy"))))
    none = F.lit(None).cast("array<string>")
    d = _rows(spark, sf).select(cycle("k", "gsm8k", "gsm8k", "go_emotions", "mbpp", "squad").alias("source"), k.cast("string").alias("id"), answer.alias("answer"), F.when(k % 5 == 4, F.array("lang")).alias("answers"), none.alias("choices"), labels.alias("original_labels"))
    return G.self_scores(d).select("id", "metric")


# ---- keys -----------------------------------------------------------------------------------------------------------
_KEY = lambda kind, x: f"'{kind}:' || sha256({FOLD_SQL.format(x)})"
_PROMPT = f"'Answer.' || {NL} || {NL} || 'Passage: ' || p || {NL} || {NL} || 'Question: ' || q"


@states(f""" SELECT k, array_to_string([{_KEY('prompt', _PROMPT)}, {_KEY('context', 'p')}, {_KEY('question', 'q')}, {_KEY('article', 'lang')}, 'base-group:' || s], ',') AS keys,
  sha256(lower(trim(regexp_replace(p, '\\s+', ' ', 'g')))) AS context FROM r""")
def overlap_keys_of_documents(spark, sf):
    """keys of a prompt, its passage, question and article, its group; and the key of the passage alone."""
    q, p, s, lang, n, k, num = _columns()
    d = _rows(spark, sf).withColumn("prompt", say("Answer.\n\nPassage: ", p, "\n\nQuestion: ", q))
    return d.select("k", F.array_join(T.old_keys("prompt", "s", "lang"), ",").alias("keys"), T.context_key("prompt", [("Premise: ", "\nHypothesis:"), ("Passage: ", "\n\nQuestion:")]).alias("context"))


_LINES = f"'A: ' || lang || ' <b>x</b> &amp; y' || {NL} || 'B: ' || s"


@states(f""" SELECT k, array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN {_KEY('context', 'q')} END, {_KEY('context', f"'A: ' || lang || '  x  & y' || {NL} || 'B: ' || s")}, {_KEY('dialogue-content', "lang || ' <b>x</b> &amp; y ' || s")}], lambda x: x IS NOT NULL), ',') AS keys FROM r""")
def later_keys_of_documents(spark, sf):
    """Keys of a question, of a dialogue without mark-up and of what is spoken in it."""
    q, p, s, lang, n, k, num = _columns()
    d = _rows(spark, sf).withColumn("prompt", say("Dialogue:\nA: ", lang, " <b>x</b> &amp; y\nB: ", s, "\n\nQuestion: ", q))
    return d.select("k", F.array_join(T.extra_old_keys("prompt", F.when(k % 2 == 0, "triviaqa").otherwise("samsum")), ",").alias("keys"))


@states(""" SELECT k, md5(CASE k % 3 WHEN 0 THEN q WHEN 1 THEN q || chr(10) || 'A. ' || lang ELSE s END) AS core FROM r""")
def cores_of_prompts(spark, sf):
    """questions of prompts without instruction, starter code, options and interface."""
    q, p, s, lang, n, k, num = _columns()
    prompt = cycle("k", say("Answer.\n\n", q, "\nA. ", lang), say("Answer.\n\nQuestion: ", q, "\nA. ", lang, "\nOptions: ", s), say("Write.\n\n", s, "\n\nStarter code:\ndef f\n\nRequired function name: f"))
    return _rows(spark, sf).select("k", F.md5(T.question_core(prompt, cycle("k", "arc", "piqa", "apps"))).alias("core"))


@states(""" SELECT k, CASE WHEN k % 5 > 0 THEN k || '00000000000000000000' || n END AS id, CASE WHEN k % 5 > 0 THEN '1,' || n || '99999999999999999999' END AS v FROM r""")
def big_numbers_of_documents(spark, sf):
    """whole numbers of any size in JSON stay as they are written; what is no JSON has none."""
    q, p, s, lang, n, k, num = _columns()
    key = k.cast("string")
    t = F.when(k % 5 == 0, "not json").otherwise(say('{"id": ', key, "00000000000000000000", num, ', "v": [1, ', num, "99999999999999999999]}"))
    return _rows(spark, sf).select("k", F.from_json(t, "struct<id:string,v:array<string>>").alias("j")).select("k", "j.id", F.array_join("j.v", ",").alias("v"))


@states("""SELECT k, strlen(q || p) + 100 <= 2000 AS within, CASE WHEN n % 2 = 0 THEN sha256('{"base_signature":"' || b || '","n":' || n || '}') ELSE b END AS signature
FROM (SELECT *, sha256('{"lang":"' || lang || '","s":"' || s || '"}') AS b FROM r)""".replace("SELECT k, strlen", " SELECT k, strlen", 1))
def bounds_and_signatures(spark, sf):
    """Whether a text is within a bound of bytes; a signature of two settings, chained with a third where given."""
    q, p, s, lang, n, k, num = _columns()
    d = _rows(spark, sf).select("k", say(q, p).alias("t"), "lang", "s", F.when(n % 2 == 0, n).alias("n"))
    return d.select("k", T.bounded_bytes("t", 2000, 100).alias("within"), T.signature("lang", "s", chained=(("n",),)).alias("signature"))


def digest_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One digest of all texts in the order of doc_id, by levels."""
    q, p, s, lang, n, k, num = _columns()
    return K.ordered_digest(_rows(spark, sf).select("k", say(q, "\n", p).alias("t")), "t", "k")


QUERIES["digest_of_documents"] = (digest_of_documents, f"""WITH {ROWS_SQL},
a AS (SELECT k // 10000 AS b, sha256(string_agg(sha256(q || {NL} || p), '' ORDER BY k)) AS d FROM r GROUP BY k // 10000),
c AS (SELECT b // 10000 AS b, sha256(string_agg(d, '' ORDER BY b)) AS d FROM a GROUP BY b // 10000)
SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest FROM c""")
