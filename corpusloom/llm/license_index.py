"""Operator 1: licence scan by a positional index of rare words.

A template is a word list with mandatory key phrases: a base phrase, a sentence of a well-known licence notice, or the
body of a licence. The index holds the RARE words of each template with the highest IDF over the template collection
(a base phrase: its one rarest) as postings (word, template, position). A file is looked up by the places of its indexed
words: a place and a posting propose a start, the place less the position. The postings of a template are intersected by
relative position: a start survives if at least the template's `need` of its rare words propose a start within SHIFT words
of it, and if each key phrase stands, word by word, within SHIFT words of where the start puts it. So list numbers, names of
holders and small changes do not lose a licence. Base phrases have to stand exactly (no shift).

A label's score is the part of its longest template that was found: the words of the template that matched, times the share
of its rare words that agree, by the words of the label's longest template; a document's score is the largest of its labels.

All of it runs inside one row with array functions: no shuffle, no Python, nothing grows with the corpus but the scan.

Defined cases: null or empty text has no words, counts 0, null places, empty labels and score 0; only A-Z are lowered
(letters whose small form is an ASCII letter stand for no template's word); repeated rows are scanned each on its own; a
start may lie before a file's first word; other columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, with their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Label, sentence of the notice, mandatory key phrase inside it.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc0", "dedicated to the public domain under the cc0 1 0 universal dedication", "cc0 1 0 universal"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]


#: Parts of the bodies of licences, as words.
MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_THIRD = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_TAIL = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
BSD_KEYS = ["redistribution and use in source and binary forms", "in binary form must reproduce the above copyright notice"]
APACHE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details you should have received a copy of the gnu {0} along with this program"
UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"
ZLIB = "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
MPL = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"
USEFUL = "distributed in the hope that it will be useful"
#: Bodies of licences, with their mandatory key phrases.
BODIES = [
    ("mit", MIT, ["permission is hereby granted free of charge", "notice and this permission notice shall be included"]),
    ("isc", ISC, ["permission to use copy modify and or distribute this software", "this permission notice appear in all copies"]),
    ("bsd", f"{BSD_HEAD} {BSD_TAIL}", BSD_KEYS),
    ("bsd", f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}", [*BSD_KEYS, "used to endorse or promote products derived from this software"]),
    ("apache-2", APACHE, ["apache license version 2 0", "unless required by applicable law or agreed to in writing"]),
    ("gpl", GPL.format("general public license", "3"), ["the gnu general public license", USEFUL]),
    ("lgpl", GPL.format("lesser general public license", "3"), ["the gnu lesser general public license", USEFUL]),
    ("agpl", GPL.format("affero general public license", "3"), ["the gnu affero general public license", USEFUL]),
    ("mpl-2", MPL, ["the terms of the mozilla public license v 2 0", "you can obtain one at"]),
    ("unlicense", UNLICENSE, ["free and unencumbered software", "commercial or non commercial and by any means"]),
    ("zlib", ZLIB, ["in no event will the authors be held liable", "to alter it and redistribute it freely"]),
]
#: Rare words indexed for a notice and a body, and words by which their places may be off.
RARE, SHIFT = 8, 12


def _at(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def templates() -> list[dict]:
    """Templates with their postings: words, keys (position and words of each key phrase), rare (positions of the indexed
    words, rarest first), need (rare words that have to agree: all of a base phrase, else half), shift, and longest, the
    number of words of the label's longest template."""
    rows = [(label, p.split(), [p], True) for label, p in BASE] + [(label, t.split(), [k], False) for label, t, k in NOTICES] + [(label, t.split(), ks, False) for label, t, ks in BODIES]
    df: dict[str, int] = {}
    for _, words, _, _ in rows:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    longest = {label: max(len(w) for x, w, _, _ in rows if x == label) for label, _, _, _ in rows}
    out = []
    for label, words, phrases, base in rows:
        keys = [(_at(words, p.split()), p.split()) for p in phrases]
        idf = lambda i: (math.log(len(rows) / df[words[i]]), len(words[i]), words[i], -i)  # noqa: B023, E731
        # of a notice the key phrase alone has to stand, so its rare words come from there
        own = range(len(words)) if len(phrases) > 1 else range(keys[0][0], keys[0][0] + len(keys[0][1]))
        rare = sorted(own, key=idf, reverse=True)[: 1 if base else RARE]
        need = 1 if base else -(-len(rare) // 2)
        out.append({"label": label, "words": words, "keys": keys, "base": base, "rare": rare, "need": need, "shift": 0 if base else SHIFT, "longest": longest[label]})
    return out


def _index() -> Column:
    """The templates as one constant array of structs, so that one expression serves them all."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    texts = lambda xs: f"array({', '.join(map(text, xs))})"
    rows = []
    for t in templates():
        rare = ", ".join(f"named_struct('p', {p}, 'w', {text(t['words'][p])})" for p in t["rare"])
        keys = ", ".join(f"named_struct('p', {p}, 'w', {texts(phrase)})" for p, phrase in t["keys"])
        known = sorted({t["words"][p] for p in t["rare"]})
        enough = max(1, t["need"] - (len(t["rare"]) - len(known)))  # distinct words that enough places need
        share = f"CAST({len(t['words'])} AS DOUBLE) / {t['longest']}"
        rows.append(f"named_struct('label', {text(t['label'])}, 'base', {str(t['base']).lower()}, 'need', {t['need']}, 'shift', {t['shift']}, 'share', {share}, 'known', {texts(known)}, 'enough', {enough}, 'rare', array({rare}), 'keys', array({keys}))")
    return F.expr(f"array({', '.join(rows)})")


def _starts(t: Column, places: Column, words: Column) -> Column:
    """(s, n): starts in the file (they may lie before word 0) near which n rare words, enough of them, and all key phrases stand."""
    low, high = (lambda s, x: F.greatest(s + x["p"] - t["shift"], F.lit(0))), (lambda s, x: s + x["p"] + t["shift"])
    # only the words near a place are looked at, so many places take linear time
    near = lambda s, x: (high(s, x) >= 0) & F.array_contains(F.slice(words, low(s, x) + 1, F.greatest(high(s, x) - low(s, x) + 1, F.lit(0))), x["w"])
    whole = lambda s, x: F.exists(F.sequence(low(s, x), F.greatest(high(s, x), low(s, x))), lambda at: F.slice(words, at + 1, F.size(x["w"])) == x["w"])
    proposed = F.flatten(F.transform(t["rare"], lambda r: F.transform(F.filter(places, lambda x: x["w"] == r["w"]), lambda x: x["i"] - r["p"])))
    counted = F.transform(F.array_distinct(proposed), lambda s: F.struct(s.alias("s"), F.size(F.filter(t["rare"], lambda r: near(s, r))).alias("n")))
    stands = lambda s: F.forall(t["keys"], lambda x: (high(s, x) >= 0) & whole(s, x))
    return F.filter(F.filter(counted, lambda c: c["n"] >= t["need"]), lambda c: stands(c["s"]))


def _lowered(text: Column) -> Column:
    """The text with A-Z lowered; the two other letters whose small form has an ASCII letter become one without."""
    kept = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")), F.lit("\u0130"), F.lit("\u00e9"))
    return F.lower(kept)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with counts, places, labels and score."""
    indexed = sorted({t["words"][p] for t in templates() for p in t["rare"]})
    lowered = _lowered(F.coalesce(F.col(text), F.lit("")))
    w = docs.select(key, F.array_remove(F.split(lowered, SPLIT), "").alias("words"))
    w = w.select(key, "words", F.size("words").cast("bigint").alias("n_words"), F.filter(F.transform("words", lambda x, i: F.when(x.isin(indexed), F.struct(i.alias("i"), x.alias("w")))), lambda x: x.isNotNull()).alias("places"))
    w = w.withColumn("known", F.array_distinct(F.transform("places", lambda x: x["w"])))
    # a template is looked at only where the file has enough of its rare words
    possible = F.filter(_index(), lambda t: F.size(F.array_intersect(F.col("known"), t["known"])) >= t["enough"])
    hit = lambda t: F.struct(t["label"].alias("label"), t["base"].alias("base"), t["share"].alias("share"), F.size(t["rare"]).alias("rare"), _starts(t, F.col("places"), F.col("words")).alias("starts"))
    hits = F.filter(F.transform(possible, hit), lambda h: F.size(h["starts"]) > 0)
    w = w.withColumn("hits", F.when(F.size("known") > 0, hits)).select(key, "n_words", "hits")
    none = F.array().cast("array<int>")
    based = F.filter("hits", lambda h: h["base"])
    w = w.withColumn("places", F.coalesce(F.flatten(F.transform(based, lambda h: F.transform(h["starts"], lambda x: x["s"]))), none))
    label = lambda some: F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.transform(some, lambda h: h["label"]), F.array().cast("array<string>")))), ",")
    best = F.transform("hits", lambda h: F.array_max(F.transform(h["starts"], lambda x: x["n"])) / h["rare"] * h["share"])
    return w.select(
        key,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        label(based).alias("base_labels"),
        label(F.col("hits")).alias("labels"),
        F.round(F.coalesce(F.array_max(best), F.lit(0.0)), 9).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql() -> str:
    """The same result stated relationally: rare words propose starts, starts near one another agree, phrases stand near."""
    index = templates()
    flag = lambda x: str(x).lower()
    known = ", ".join(f"({i}, '{t['label']}', {flag(t['base'])}, {len(t['words'])}, {len(t['rare'])}, {t['need']}, {t['shift']}, {t['longest']}, {len(t['keys'])})" for i, t in enumerate(index))
    rare = ", ".join(f"({i}, {p}, '{t['words'][p]}')" for i, t in enumerate(index) for p in t["rare"])
    keys = ", ".join(f"({i}, {k}, {p}, {j}, '{w}', {len(phrase)})" for i, t in enumerate(index) for k, (p, phrase) in enumerate(t["keys"]) for j, w in enumerate(phrase))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t(t, label, base, n_words, n_rare, need, shift, longest, n_keys) AS (VALUES {known}),
p(t, p, w) AS (VALUES {rare}),
k(t, k, p, j, w, n) AS (VALUES {keys}),
x AS (SELECT doc_id, unnest(words) AS w, unnest(range(0, len(words))) AS i FROM d),
c AS (SELECT doc_id, t, p, i - p AS s FROM x JOIN p USING (w)),
f AS (SELECT doc_id, t, k, p, i - j AS place FROM x JOIN k USING (w) GROUP BY doc_id, t, k, p, i - j, n HAVING count(*) = n),
a AS (SELECT doc_id, t, o.s, count(DISTINCT c.p) AS n FROM (SELECT DISTINCT doc_id, t, s FROM c) o JOIN c USING (doc_id, t) JOIN t USING (t) WHERE abs(c.s - o.s) <= shift GROUP BY doc_id, t, o.s, need HAVING count(DISTINCT c.p) >= need),
h AS (SELECT doc_id, t, s, a.n FROM a JOIN f USING (doc_id, t) JOIN t USING (t) WHERE abs(f.place - f.p - a.s) <= shift GROUP BY doc_id, t, s, a.n, n_keys HAVING count(DISTINCT f.k) = n_keys),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(n::DOUBLE / n_rare * n_words / longest) AS score FROM h JOIN t USING (t) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 9) AS score
FROM d LEFT JOIN g USING (doc_id)
"""
