"""Operator 5: quality rules by divergence from language references.

Base rules: at least MIN_WORDS words, and at most 30 of 100 words inside 8-word windows that occur more than once in
the text. The method's rule: the Jensen-Shannon distance (square root of the base-2 divergence) between a document's
character-class histogram and its language's reference may not pass MAX_CHARS, and between its common-word histogram
and the reference not MAX_WORDS; texts shorter than the guards are not judged by that rule. Without a reference of its own
a language's characters are compared to the nearest reference, and its words are not judged: a text without the common
words of four languages can be clean prose of a fifth. Its distance to the nearest words is reported all the same.

The references are fixed values of the languages, not of the corpus, so a document's verdict never depends on others.
Everything stays inside the row: no shuffle, no Python.

Defined cases: null text has no words and fails; null or unknown lang is a language without a reference; repeated
rows are judged each on its own; marks that combine with a letter count as letters; extra columns pass through keep() and are ignored by measure(); an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let

from .common import table

MIN_WORDS = 20
GRAM = 8
MAX_REPEAT_PERCENT = 30
#: Limits from the references' own spread, not from a corpus: a text whose every tenth character is of no class is at 0.212
#: from any reference (every eighth: 0.241), and a text without a single common word at 0.324 (de) to 0.390 (es).
MAX_CHARS, GUARD_CHARS = 0.22, 100
MAX_WORDS, GUARD_WORDS = 0.32, 50

#: Shares of lower-case letters, upper-case letters, digits, white space, sentence marks, other characters.
CHARS = {
    "en": [0.775, 0.030, 0.005, 0.165, 0.022, 0.003],
    "de": [0.775, 0.050, 0.005, 0.145, 0.022, 0.003],
    "fr": [0.775, 0.025, 0.005, 0.165, 0.027, 0.003],
    "es": [0.775, 0.025, 0.005, 0.165, 0.027, 0.003],
}
#: Common words of each language with their shares of running text.
WORDS = {
    "en": {"the": 0.060, "of": 0.030, "and": 0.028, "to": 0.026, "in": 0.021, "a": 0.021, "is": 0.011, "that": 0.011, "for": 0.010, "it": 0.010, "with": 0.008, "on": 0.007},
    "de": {"der": 0.035, "die": 0.035, "und": 0.030, "in": 0.018, "den": 0.012, "das": 0.012, "von": 0.010, "zu": 0.010, "mit": 0.009, "ist": 0.010, "nicht": 0.007, "ein": 0.007},
    "fr": {"de": 0.050, "la": 0.028, "le": 0.025, "et": 0.022, "les": 0.018, "des": 0.015, "en": 0.013, "un": 0.011, "une": 0.010, "du": 0.012, "que": 0.010, "est": 0.009},
    "es": {"de": 0.055, "la": 0.037, "que": 0.028, "el": 0.028, "en": 0.025, "y": 0.024, "a": 0.018, "los": 0.016, "se": 0.011, "del": 0.011, "las": 0.010, "un": 0.010},
}

SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


#: Marks that end a word, and a common word between white space with such marks after it.
END_MARKS = ".,;:!?"
COMMON = sorted({w for v in WORDS.values() for w in v})
COMMON_WORD = rf"{SPACE}({'|'.join(sorted(COMMON, key=len, reverse=True))})(?=[{END_MARKS}]*+(?:{SPACE}|\z))"


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms as arrays of shares, 0 where empty."""

    def more(total, x):
        m = (x["p"] + x["q"]) / 2
        return total + F.when(x["p"] > 0, x["p"] * F.log2(x["p"] / m)).otherwise(0.0) / 2 + F.when(x["q"] > 0, x["q"] * F.log2(x["q"] / m)).otherwise(0.0) / 2

    pairs = F.zip_with(p, q, lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    return F.sqrt(F.greatest(F.aggregate(pairs, F.lit(0.0), more), F.lit(0.0)))


def _by_language(values: dict) -> Column:
    """A map from language to an array of fixed values."""
    return F.create_map(*[x for code, v in values.items() for x in (F.lit(code), F.array(*[F.lit(i) for i in v]))])


def _repeat_words(hashes: str) -> Column:
    """Words in windows of GRAM words that occur twice or more, from the hash of each window."""
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda o: F.sort_array(F.filter(F.transform(o, lambda x, k: F.when((x["h"] == F.get(o, k - 1)["h"]) | (x["h"] == F.get(o, k + 1)["h"]), x["i"]).otherwise(-1)), lambda i: i >= 0))
    cover = lambda s: F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + GRAM - F.greatest(a["end"], i)).alias("n"), (i + GRAM).alias("end")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(order, lambda o: cover(same(o)))).otherwise(0)


def measure(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the measures of the base rules, the two distances and the verdicts, under names starting with `q_`.

    Windows are hashed by doubling (words, pairs, fours, eights). Characters are counted by what is left of a text without
    its lower-case ASCII letters, then without any letters, so that only one pattern runs over the whole text.
    """
    less = lambda a, b: F.length(a) - F.length(b)
    gone = lambda c, pattern: F.regexp_replace(c, pattern, "")
    doubled = lambda c, k: F.zip_with(c, F.slice(c, k + 1, F.greatest(F.size(c) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    t = F.col("q_text")
    d = docs.withColumn("q_text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns({"q_list": F.array_remove(F.split(t, SPACE + "+"), ""), "q_lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_SPACE)), "q_some": gone(t, "[a-z]+"), "q_common": F.regexp_extract_all(F.concat(F.lit(" "), F.lower(t)), F.lit(COMMON_WORD), F.lit(1))})
    n = F.col("q_n_words")
    d = d.withColumns({"q_n_words": F.size("q_list").cast("bigint"), "q_hash": F.transform("q_list", lambda w: F.xxhash64(w)), "q_rest": gone("q_some", r"[\p{L}\p{M}]+"), "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint")})
    for k in (1, 2, 4):
        d = d.withColumn("q_hash", F.when(n >= GRAM, doubled("q_hash", k)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumns({
        "q_wins": F.slice("q_hash", F.lit(1), F.greatest(n - GRAM + 1, F.lit(0)).cast("int")),
        "q_n_chars": F.length(t),
        "q_letters": less(t, "q_rest"),
        "q_upper": less("q_some", gone("q_some", r"\p{Lu}+")),
        "q_digits": less("q_rest", gone("q_rest", "[0-9]+")),
        "q_space": less("q_rest", gone("q_rest", SPACE + "+")),
        "q_marks": less("q_rest", gone("q_rest", r"[.,;:?!'\x22()-]+")),
        "q_n_symbols": less("q_rest", gone("q_rest", r"[#*$%&|<>]+")).cast("bigint"),
    })
    d = d.withColumn("q_n_repeat_words", _repeat_words("q_wins").cast("bigint")).withColumn("q_word_chars", (F.col("q_n_chars") - F.col("q_space")).cast("bigint"))
    whole = F.greatest(F.col("q_n_chars"), F.lit(1)).cast("double")
    counted = ["q_letters", "q_digits", "q_space", "q_marks"]
    shares = [(F.col("q_letters") - F.col("q_upper")) / whole, F.col("q_upper") / whole, F.col("q_digits") / whole, F.col("q_space") / whole, F.col("q_marks") / whole, (F.col("q_n_chars") - sum((F.col(c) for c in counted), F.lit(0))) / whole]
    known = F.col(lang).isin(list(WORDS))
    d = d.withColumns({"q_shares": F.array(*shares), "q_codes": F.when(F.coalesce(known, F.lit(False)), F.array(F.col(lang))).otherwise(F.array(*[F.lit(c) for c in WORDS]))})
    names, by_words, by_chars = _by_language(WORDS), _by_language({c: [*v.values(), 1.0 - sum(v.values())] for c, v in WORDS.items()}), _by_language(CHARS)
    share = lambda w: (F.size("q_common") - F.size(F.array_remove("q_common", w))) / F.greatest(n, F.lit(1)).cast("double")

    def words_to(code):
        own = F.transform(F.element_at(names, code), share)
        return let(own, lambda p: distance(F.concat(p, F.array(F.lit(1.0) - F.aggregate(p, F.lit(0.0), lambda a, x: a + x))), F.element_at(by_words, code)))

    nearest = lambda to: F.round(F.array_min(F.transform("q_codes", to)), 6)
    d = d.withColumns({"q_js_chars": nearest(lambda code: distance(F.col("q_shares"), F.element_at(by_chars, code))), "q_js_words": nearest(words_to)})
    failed = (n < MIN_WORDS) | (F.lit(100) * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * n)
    off = ((F.col("q_n_chars") >= GUARD_CHARS) & (F.col("q_js_chars") > MAX_CHARS)) | (F.coalesce(known, F.lit(False)) & (n >= GUARD_WORDS) & (F.col("q_js_words") > MAX_WORDS))
    d = d.withColumn("q_base_failed", failed)
    return d.withColumn("q_kept", ~F.col("q_base_failed") & ~off).drop("q_text", "q_list", "q_hash", "q_lines", "q_some", "q_rest", "q_common", "q_wins", "q_shares", "q_codes")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that pass every rule, with their own columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # the row number keeps the filter above the measures: pushed down, each would be computed inside every lambda that uses it
    judged = measure(packed).withColumn("q_row", F.monotonically_increasing_id())
    return judged.filter("q_kept AND q_row >= 0").select("row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measure(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words"]
    return m.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in names])


def sql() -> str:
    """The base measures by unnesting, the distances by the same formulas."""

    def js(p, q):
        parts = [f"(CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b!r}::DOUBLE) / 2)) ELSE 0 END) / 2 + ({b!r}::DOUBLE * log2({b!r}::DOUBLE / (({a} + {b!r}::DOUBLE) / 2))) / 2" for a, b in zip(p, q, strict=True)]
        return f"sqrt(greatest({' + '.join(parts)}, 0.0::DOUBLE))"

    chars = ["(letters - uppers) / n", "uppers / n", "digits / n", "spaces / n", "marks / n", "(n_chars - letters - digits - spaces - marks) / n"]
    chars = [f"({c})" for c in chars]
    by_chars = {c: js(chars, CHARS[c]) for c in CHARS}

    def words_to(code):
        own = [f"(len(list_filter(common, lambda x: x = '{w}')) / greatest(n_words, 1)::DOUBLE)" for w in WORDS[code]]
        return js([*own, f"(1.0::DOUBLE - ({' + '.join(['0.0::DOUBLE', *own])}))"], [*WORDS[code].values(), 1.0 - sum(WORDS[code].values())])

    by_words = {c: words_to(c) for c in WORDS}
    pick = lambda by: "round(CASE lang " + " ".join(f"WHEN '{c}' THEN {x}" for c, x in by.items()) + f" ELSE least({', '.join(by.values())}) END, 6)"
    every = ", ".join(f"'{w}'" for w in sorted({x for v in WORDS.values() for x in v}))
    codes = ", ".join(f"'{c}'" for c in WORDS)
    gone = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    return f"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM a),
c AS (SELECT *, len(words)::BIGINT AS n_words, length(t) AS n_chars, greatest(length(t), 1)::DOUBLE AS n,
             {gone('[\\p{L}\\p{M}]+')} AS letters, {gone('[\\p{Lu}]+')} AS uppers, {gone('[0-9]+')} AS digits,
             {gone('[\\x20\\x09-\\x0D]+')} AS spaces, {gone("[.,;:?!''\\x22()-]+")} AS marks, ({gone('[#*$%&|<>]+')})::BIGINT AS n_symbols,
             list_filter(list_transform(words, lambda w: lower(regexp_replace(w, '[.,;:!?]+$', ''))), lambda w: w IN ({every})) AS common FROM b),
g AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 8], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(0, len(words) - 7)) AS i FROM b)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM h WHERE k > 1) GROUP BY doc_id),
m AS (SELECT c.doc_id, c.lang, n_words, (n_chars - spaces)::BIGINT AS word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_chars, {pick(by_chars)} AS js_chars, {pick(by_words)} AS js_words
      FROM c LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_chars >= {GUARD_CHARS} AND js_chars > {MAX_CHARS}) AND NOT (coalesce(lang IN ({codes}), false) AND n_words >= {GUARD_WORDS} AND js_words > {MAX_WORDS}) AS kept,
       js_chars, js_words FROM f
"""
