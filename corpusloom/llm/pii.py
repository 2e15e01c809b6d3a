"""Operator 4: personal data by proposing patterns, confirming checksums and context words.

Regular expressions propose spans per kind, leftmost and without overlap; validators confirm them (octets at most 255,
Luhn, digit counts, ISO 7064 mod 97). The base kinds stay once confirmed. The method adds two kinds: IBANs confirmed by
mod 97, and identity numbers of the form 3-2-4 digits, whose score of 0.4 has to be lifted by a context word within
40 characters before or after them. Every span carries a score: 0.6 for a pattern, 0.9 with a checksum, 0.3 more near a
context word of its kind, 1 at most.

The patterns are written so that a match can start only where a run of its characters starts (or right after the match
before) and with possessive quantifiers, which finds the same spans in linear time on texts without spaces. That of the
IBAN proposes its first four characters only: its length follows from the country, so no text after or before it can
become part of it; of spans that overlap the first one confirmed stays.

Places are code points. Splitting by the pattern gives the text between matches, so lengths add up to places without a
search. Running sums go over blocks of RUN matches, and text is read at a place from blocks of PART code points, so neither a scan nor a redaction of many spans in one long
text takes quadratic time. Everything stays inside the row: no shuffle, no Python.

Defined cases: null or empty text has no spans and the hash of the empty string; repeated rows are scanned each on its
own; extra columns pass through redact() and are ignored by scan(); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let

from .common import table

#: Kind, proposing pattern, necessary substring pattern (cheap test), context words.
KINDS = [
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|e-mail|kontakt|courriel|correo"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", "ip|address|host|server|adresse"),
    ("card", r"(?:(?<![0-9])(?<![0-9][\x20-]))[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", None, "card|visa|mastercard|amex|credit|karte|carte|tarjeta"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|tel|mobile|telefon|fax"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", None, "iban|account|konto|compte|cuenta"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social|security|identity"),
]
BASE = ("email", "ip", "card", "phone")
CHECKED = ("card", "iban", "ip")
#: Countries by the length of their IBANs (ISO 13616 registry, and countries that use IBANs outside it).
IBANS = {
    15: "NO",
    16: "BE",
    18: "DK|FI|FK|FO|GL|NL|SD",
    19: "MK|SI",
    20: "AT|BA|EE|KZ|LT|LU|MN|XK",
    21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|IQ|ME|RS|VA",
    23: "AE|GI|IL|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "AO|CV|GW|LY|MZ|PT|ST",
    26: "DZ|IR|IS|TR",
    27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD",
    28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG",
    29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE",
    31: "MT|SC",
    32: "LC",
    33: "RU",
}
#: The whole span at a proposed IBAN: by its country's length, for other codes the longest run.
IBAN = "^(?:" + "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in IBANS.items()) + rf"|(?!{'|'.join(IBANS.values())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9]))"
#: Characters of context on each side of a span, and those read from an IBAN's start: 34 with their spaces, then context.
NEAR = 40
REACH = 4 + 60 + NEAR
#: A span of the method's own kinds needs this score.
LEAST = 0.6
#: Numbers summed in one go, and code points of a block of text.
RUN, PART = 64, 4096
SPAN = "struct<start:int,rank:int,stop:int,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(a, i):
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + F.when(x > 9, x - 9).otherwise(x)

    n = F.length(d)
    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def _mod97(m: Column) -> Column:
    c = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))

    def step(a, i):
        ch = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(ch < 65, (a * 10 + ch - 48) % 97).otherwise((a * 100 + ch - 55) % 97)

    return F.length(c).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", "").rlike("^[0-9]{1,3}$") & (F.substring(F.regexp_replace(x, "^0+(?=.)", ""), 1, 3).cast("int") <= 255))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _before(values: Column, add) -> Column:
    """For each number of an array, what `add` makes of 0 and all the numbers before it.

    Blocks of RUN numbers are summed first, so a number costs the numbers before it in its block, and a block the blocks
    before it; an array that grows by one element a step would be copied at every step.
    """
    fold = lambda x, start: F.aggregate(x, start, add)

    def blocks(v):
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / RUN).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * RUN + 1, RUN))

    def sums(parts):
        whole = F.transform(parts, lambda x: fold(x, F.lit(0)))
        own = lambda x, start: F.transform(x, lambda _, j: fold(F.slice(x, F.lit(1), j), start))
        return let(whole, lambda w: F.flatten(F.transform(parts, lambda x, i: let(fold(F.slice(w, F.lit(1), i), F.lit(0)), lambda start: own(x, start)))))

    return let(values, lambda v: let(blocks(v), sums))


def _apart(spans: Column) -> Column:
    """The spans that do not overlap the last one kept before them, the first of all kept."""

    def step(a, x):
        keep = x["start"] >= a["at"]
        return F.struct(F.when(keep, x["stop"]).otherwise(a["at"]).alias("at"), F.when(keep, F.concat(a["all"], F.array(x))).otherwise(a["all"]).alias("all"))

    def walk(all_):
        return F.aggregate(all_, F.struct(F.lit(0).alias("at"), F.slice(all_, 1, 0).alias("all")), step, lambda a: a["all"])

    # most texts have none that overlap, and then nothing has to be walked
    clear = lambda s: F.forall(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, y: y.isNull() | (y["start"] >= x["stop"])), lambda e: e)
    return let(spans, lambda s: F.when(clear(s), s).otherwise(walk(s)))


def _read(blocks: Column, a: Column, b: Column) -> Column:
    """The text from code point a to b (exclusive), from its blocks of PART code points."""
    first, last = F.floor(a / PART).cast("int"), F.floor(b / PART).cast("int")
    head = lambda n: F.substring(F.get(blocks, first), a - first * PART + 1, n)
    end = F.coalesce(F.substring(F.get(blocks, last), F.lit(1), b - last * PART), F.lit(""))
    across = F.concat(head(F.lit(PART)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), end)
    return F.coalesce(F.when(first == last, head(b - a)).otherwise(across), F.lit(""))


def _spans(kind: str, rank: int, pattern: str, needs: str | None, words: str, text: Column, blocks: Column) -> Column:
    """Confirmed spans of one kind: array of (start, rank, stop, score)."""
    possible = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def at_places(matches):
        lengths = F.transform(matches, lambda m: F.length(m))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.concat(F.array(F.lit(0)), F.slice(lengths, F.lit(1), F.greatest(F.size(matches) - 1, F.lit(0)))), lambda gap, before: gap + before)
        starts = let(steps, lambda v: F.zip_with(_before(v, lambda a, x: a + x), v, lambda a, x: a + x))
        return F.zip_with(matches, starts, lambda m, start: F.struct(start.alias("start"), m.alias("m")))

    placed = let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), at_places)
    if kind == "iban":
        placed = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.regexp_extract(_read(blocks, x["start"], x["start"] + REACH), IBAN, 0).alias("m")))
    base = 0.9 if kind in CHECKED else 0.4 if kind == "ssn" else 0.6
    ends = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("stop"), x["m"].alias("m")))

    def judged(x):
        around = [_read(blocks, F.greatest(x["start"] - NEAR, F.lit(0)), x["start"]), _read(blocks, x["stop"], x["stop"] + NEAR)]
        near = F.lower(around[0]).rlike(rf"\b(?:{words})") | F.lower(around[1]).rlike(rf"\b(?:{words})")
        score = F.least(F.lit(1.0), F.lit(base) + F.when(near, 0.3).otherwise(0.0))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.round(score, 2).alias("score"))

    found = F.transform(F.filter(ends, lambda x: (x["stop"] > x["start"]) & _confirmed(kind, x["m"])), judged)
    if kind not in BASE:
        found = F.filter(found, lambda x: x["score"] >= LEAST)
    if kind == "iban":
        found = _apart(found)
    return F.when(possible & text.rlike(pattern), found.cast(f"array<{SPAN}>")).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `__text` (null as empty), its `__blocks`, and `__spans`, ordered by start, then kind."""
    out = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("__blocks", F.regexp_extract_all("__text", F.lit(f"(?s)(.{{1,{PART}}})"), F.lit(1)))
    out = out.withColumns({f"__k{i}": _spans(k, i, p, needs, words, F.col("__text"), F.col("__blocks")) for i, (k, p, needs, words) in enumerate(KINDS)})
    spans = F.sort_array(F.concat(*[F.col(f"__k{i}") for i in range(len(KINDS))]))
    return out.withColumn("__spans", spans).drop(*[f"__k{i}" for i in range(len(KINDS))])


def _name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k, *_ in KINDS]), rank + 1)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _name(s["rank"]), s["start"], s["stop"])), ",")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, digest and all spans of each document."""
    s = with_spans(docs.select(key, text), text).select(key, "__spans", F.filter("__spans", lambda x: x["rank"] < len(BASE)).alias("__base"))
    n = lambda i: F.size(F.filter("__spans", lambda x: x["rank"] == i)).cast("bigint")
    return s.select(
        key,
        *[n(i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)],
        F.sha2(_written(F.col("__base")), 256).alias("base_sha256"),
        _written(F.col("__spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("__spans", lambda x: x["score"])), F.lit(0.0)).alias("max_score"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    columns = docs.columns
    s = with_spans(docs.select(F.struct(*columns).alias("row"), F.col(text).alias("text")))
    blocks = F.col("__blocks")
    # what stands between spans: from the end of all spans before to the start of the next that does not overlap them
    ends = _before(F.transform("__spans", lambda x: x["stop"]), lambda a, x: F.greatest(a, x))
    placed = F.zip_with("__spans", ends, lambda x, at: F.struct(at.alias("from"), x["start"].alias("to"), x["rank"].alias("rank")))
    kept = F.filter(placed, lambda x: x["to"] >= x["from"])
    parts = F.transform(kept, lambda x: F.concat(_read(blocks, x["from"], x["to"]), F.lit("["), F.upper(_name(x["rank"])), F.lit("]")))
    rest = _read(blocks, F.array_max(F.transform("__spans", lambda x: x["stop"])), F.length("__text"))
    done = F.concat(F.array_join(parts, ""), rest)
    s = s.withColumn("__new", F.when(F.size("__spans") > 0, done).otherwise(F.col("text")))
    return s.select(*[F.col("__new").alias(c) if c == text else F.col("row")[c].alias(c) for c in columns])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql() -> str:
    """The same result stated relationally: matches of the plain patterns, placed by the lengths of what is between them.

    Identity numbers are whole runs of digits and hyphens, IBANs start where a run of letters and digits does.
    """
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]", "[A-Za-z0-9]+", "[0-9-]+"]
    score = lambda kind: 0.9 if kind in CHECKED else 0.4 if kind == "ssn" else 0.6
    kinds = ", ".join(f"('{k}', {i}, '{p}', {score(k)}::DOUBLE, '\\b(?:{w})')" for (i, (k, _, _, w)), p in zip(enumerate(KINDS), patterns, strict=True))
    known = "|".join(IBANS.values())
    sized = "|".join(rf"(?:{c})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBANS.items())
    return rf"""
WITH k(kind, rank, pat, base, words) AS (VALUES {kinds}),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, t, kind, rank, base, words, regexp_extract_all(t, pat) AS ms, list_transform(string_split_regex(t, pat), lambda g: length(g)) AS gs FROM d, k),
y AS (SELECT * EXCLUDE (ms, gs), ms[i] AS m, (list_sum(gs[1 : i]) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda w: length(w))), 0))::BIGINT AS start
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM x)),
i AS (SELECT * REPLACE (CASE WHEN kind <> 'iban' THEN m WHEN NOT regexp_matches(m, '^[A-Z]{{2}}[0-9]{{2}}') THEN ''
             WHEN regexp_matches(m, '^(?:{known})') THEN regexp_extract(substr(t, start + 1, {REACH}), '^({sized})(?:[^A-Za-z0-9]|$)', 1)
             ELSE regexp_extract(substr(t, start + 1, {REACH}), '^([A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?:[^A-Za-z0-9]|$)', 1) END AS m) FROM y),
n AS (SELECT *, start + length(m) AS stop, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS bare FROM i WHERE m <> ''),
v AS (SELECT *, array_to_string(list_transform(string_split(substr(bare, 5) || substr(bare, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '') AS s FROM n),
w AS (SELECT *, CASE WHEN kind = 'iban' THEN TRY_CAST(substr(s, 1, 30) AS HUGEINT) % 97 END AS r1 FROM v),
z AS (SELECT *, CASE WHEN kind = 'iban' THEN ((r1 || substr(s, 31, 30))::HUGEINT % 97) END AS r2 FROM w),
c AS (SELECT * FROM z WHERE CASE kind
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 999) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(digits, length(digits) - j + 1, 1)::INT
       WHEN substr(digits, length(digits) - j + 1, 1)::INT > 4 THEN 2 * substr(digits, length(digits) - j + 1, 1)::INT - 9 ELSE 2 * substr(digits, length(digits) - j + 1, 1)::INT END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN length(bare) BETWEEN 15 AND 34 AND (r2 || substr(s, 61, 30))::HUGEINT % 97 = 1
  WHEN 'ssn' THEN regexp_matches(m, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') ELSE true END),
g AS (SELECT *, round(least(1.0::DOUBLE, base + CASE WHEN regexp_matches(lower(substr(t, greatest(start - {NEAR}, 0) + 1, start - greatest(start - {NEAR}, 0))), words)
             OR regexp_matches(lower(substr(t, stop + 1, {NEAR})), words) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END), 2) AS score FROM c),
f AS (SELECT * FROM g WHERE kind IN ('email', 'ip', 'card', 'phone') OR score >= {LEAST}),
a AS (SELECT * FROM f WHERE kind <> 'iban' OR NOT EXISTS (SELECT 1 FROM f o WHERE o.r = f.r AND o.kind = 'iban' AND o.start < f.start AND o.stop > f.start)),
h AS (SELECT r, {', '.join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, (k, *_) in enumerate(KINDS))}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS own, max(score) AS max_score FROM a GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in KINDS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(max_score, 0.0::DOUBLE) AS max_score
FROM d LEFT JOIN h USING (r)
"""
