import random

import pytest
from pyspark.sql import functions as F

import brute
from corpusloom.llm import license_index, pii, poisson_mix, quality_rules
from corpusloom.session import table

DDL = "doc_id long, text string, lang string, source string, copy int, q_text string"


def docs(spark, rows, ddl=DDL):
    return spark.createDataFrame([tuple(r) + (None,) * (6 - len(r)) for r in rows], ddl)


CASES = [None, "", "a", "mail bob@x.org, b@c.d%e@f.gh or a@b.", "10.0.0.1 and 300.1.1.1 1.2.3.4.5.6.7.8 001.2.3.0004", "4111 1111 1111 1111x 4111-1111-1111-1112 12345678901234567890123", "+49 30 (123) 4567-89. +1 2 +4930123456789012345", "ñ 😀 +1 415 555 2671 ip 8.8.8.8", "9" * 20000, "a" * 50000 + "@x.yz", "x@y" + ".z" * 20000, "-".join("0" * 16), "4" + " 1" * 15]


def test_pii_base_equals_brute_force(spark, sf):
    texts = CASES + [r.text for r in table(spark, sf, "documents").collect()]
    rng = random.Random(4)
    texts += ["".join(rng.choice("0123456789 -.+@ab()%") for _ in range(rng.randint(5, 120))) for _ in range(1500)]
    got = pii.scan(docs(spark, [(i, t) for i, t in enumerate(texts)])).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute.pii_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[:5], texts[r.doc_id][:200]
        assert set(want[5].split(",")) <= set(r.spans.split(",")) or not want[5]


def test_pii_method_kinds_and_redaction(spark):
    rows = [(1, "pay to DE89 3704 0044 0532 0130 00 now"), (2, "iban DE89 3704 0044 0532 0130 01"), (3, "ssn 123-45-6789"), (4, "code 123-45-6789"), (5, "mail a@b.co and +49 30 1234567"), (6, None)]
    got = {r.doc_id: r for r in pii.scan(docs(spark, rows)).collect()}
    assert (got[1].n_iban, got[2].n_iban, got[3].n_ssn, got[4].n_ssn) == (1, 0, 1, 0)
    red = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert red[1] == "pay to [IBAN] now" and red[5] == "mail [EMAIL] and [PHONE]" and red[6] is None and red[4] == rows[3][1]
    assert pii.redact(docs(spark, rows)).columns == docs(spark, rows).columns


def test_iban_ends_by_country(spark):
    iban, grouped = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    rows = [f"IBAN {iban} BIC COBADEFFXXX", f"{iban} The rest", f"{grouped} BIC COBADEFF", f"{iban} 2024", f"{iban} {grouped}", f"XX12 {iban}", f"NO12 3456 7890 {iban}, GB82WEST12345698765432 A", "DE89370400440532013001 The", f"{iban}0 A", f"x {iban}A", "DE"]
    want = ["IBAN [IBAN] BIC COBADEFFXXX", "[IBAN] The rest", "[IBAN] BIC COBADEFF", "[IBAN] 2024", "[IBAN] [IBAN]", "XX12 [IBAN]", "NO12 3456 7890 [IBAN], [IBAN] A", *rows[7:11]]
    got = {r.doc_id: r.text for r in pii.redact(docs(spark, list(enumerate(rows)))).collect()}
    assert [got[i] for i in range(len(want))] == want


def test_context_on_both_sides(spark):
    far = "word " * 8
    rows = ["SSN: 123-45-6789, 987-65-4321, 111-22-3333", "123-45-6789 (SSN)", f"ssn {far}123-45-6789", f"123-45-6789 {far}ssn", "123-45-6789, 987-65-4321", "mail a@b.co c@d.ef", "10.0.0.1 is the host", "1 12.0.0.1 2"]
    got = {r.doc_id: r for r in pii.scan(docs(spark, list(enumerate(rows)))).collect()}
    assert [got[i].n_ssn for i in range(5)] == [3, 1, 0, 0, 0] and got[0].spans == "ssn:5:16,ssn:18:29,ssn:31:42"
    assert (got[5].max_score, got[6].max_score, got[7].max_score) == (0.9, 1.0, 0.9)
    assert pii.redact(docs(spark, [(1, rows[0])])).first().text == "SSN: [SSN], [SSN], [SSN]"


def test_license_bodies_and_lowering(spark):
    label, body, _ = license_index.BODIES[1]
    words = body.split()
    cut = " ".join(words[: len(words) // 2])  # its second key phrase is missing
    other = " ".join("of" if w in ("fee", "disclaims") else w for w in words)
    kelvin = "BU\u212a under the MIT license, under the M\u0130T license"
    got = {r.doc_id: r for r in license_index.scan(docs(spark, [(1, "Copyright X. " + body.upper()), (2, cut), (3, other), (4, kelvin), (5, "b" + body[1:])])).collect()}
    assert got[1].labels == label and got[1].score == 1.0 and got[1].n_base == 0
    assert got[3].labels == label and 0.7 < got[3].score <= 1 and got[2].labels == label and 0 < got[2].score < 0.3  # by its notice alone
    assert (got[4].n_base, got[4].first_word, got[4].n_words) == (1, 1, 9)
    assert got[5].labels == "" and got[5].score == 0


BSD_2 = """Copyright (c) 2019, Jane Doe and others
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of Jane Doe, Incorporated nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY JANE DOE AND OTHERS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL JANE DOE BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
MIT_NAMED = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice (including the next
paragraph) shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_FILE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


def test_licences_as_they_are_written(spark):
    """Texts with list numbers, names of holders and inserted words are found by their bodies, not by notices alone."""
    code = "int main() { return 0; }\n" * 40
    star = lambda t: "".join(f" * {x}\n" for x in t.split("\n"))
    dashed = BSD_2.replace("1. ", "* ").replace("2. ", "* ")
    rows = [BSD_2 + BSD_END, BSD_2 + BSD_3 + BSD_END, star(BSD_2 + BSD_3 + BSD_END), dashed + BSD_END, MIT_NAMED.replace(" (including the next\nparagraph)", ""), MIT_NAMED, APACHE_FILE]
    rows = [code + t + code for t in rows]
    got = {r.doc_id: (r.labels, r.score) for r in license_index.scan(docs(spark, list(enumerate(rows)))).collect()}
    assert [got[i][0] for i in range(4)] == ["bsd,proprietary"] * 4 and got[4][0] == "mit" and got[6][0] == "apache-2"
    assert all(got[i][1] >= 0.4 for i in (0, 1, 2, 3, 4, 6)), got
    # the words put into the key phrase leave the notice alone
    assert got[5][0] == "mit" and got[5][1] < 0.3


def test_license_places_and_labels(spark):
    rows = [(1, "Under the MIT License, under the mit license"), (2, "Apache-License, Version 2.0 CC BY-NC"), (3, None), (4, ""), (5, "Permission is hereby granted, free of charge, to any"), (6, "mit mit mit license"), (6, "cc by nc")]
    got = sorted(license_index.scan(docs(spark, rows)).collect())
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == 7
    r = by[1, 8]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (2, 0, 4, "mit", round(4 / len(license_index.MIT.split()), 9))
    r = by[2, 8]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (2, 0, 5, "apache-2,cc-by-nc")
    assert by[3, 0].n_base == 0 and by[3, 0].first_word is None and by[4, 0].labels == ""
    assert by[5, 9].labels == "mit" and by[5, 9].base_labels == "" and 0 < by[5, 9].score < 0.3
    assert by[6, 4].n_base == 0 and by[6, 3].labels == "cc-by-nc"


def test_quality_measures(spark):
    w = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, None), (2, ""), (3, f"{w} {w}\nx\nx\n\n \n#*"), (4, " ".join(f"w{i}" for i in range(3000)), "en"), (5, "THE!! BIG!! " * 3 + " ".join(f"WORD{'ABCDEFGHIJ'[i % 10]}{'KLMNOPQRST'[i // 10]}!!" for i in range(60)), "en")]
    got = {r.doc_id: r for r in quality_rules.measure(docs(spark, rows)).collect()}
    assert got[1].q_n_words == 0 and got[1].q_base_failed and not got[2].q_kept
    assert (got[3].q_n_words, got[3].q_n_repeat_words, got[3].q_n_dup_lines, got[3].q_n_symbols) == (19, 16, 1, 2)
    assert not got[4].q_base_failed and got[5].q_js_chars > 0.3 and not got[5].q_kept
    assert quality_rules.keep(docs(spark, rows)).columns == docs(spark, rows).columns


def test_each_histogram_rejects_by_itself(spark):
    """Clean prose is kept; prose without common words falls to the words alone, prose with marks to the characters alone."""
    rng = random.Random(5)
    other = lambda: "".join(rng.choice("kzvbpgum") for _ in range(rng.randint(3, 8)))
    share = [(w, p) for w, p in quality_rules.WORDS["en"].items()]
    prose = lambda: " ".join(rng.choices([w for w, _ in share] + [None], [p for _, p in share] + [1 - sum(p for _, p in share)])[0] or other() for _ in range(400))
    clean = prose()
    rare = " ".join(other() for _ in range(400))
    odd = " ".join(w + "%" if i % 2 else w + "*" for i, w in enumerate(clean.split()))
    got = {r.doc_id: r for r in quality_rules.measure(docs(spark, [(1, clean, "en"), (2, rare, "en"), (3, odd, "en"), (4, rare, None), (5, clean, "xx")])).collect()}
    # the words of a language without a reference are not judged
    assert all(got[i].q_kept for i in (1, 4, 5)) and not any(got[i].q_kept for i in (2, 3)) and not any(r.q_base_failed for r in got.values())
    assert got[2].q_js_chars <= quality_rules.MAX_CHARS and got[2].q_js_words > quality_rules.MAX_WORDS
    assert got[3].q_js_chars > quality_rules.MAX_CHARS


def test_languages_without_a_reference_are_kept(spark):
    """Prose of languages that have no reference, with or without their code, and with combining marks."""
    words = {
        "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой весь год от так о для ты же все тот мочь вы человек такой его сказать только или ещё бы себя один как уже до время если сам когда другой вот говорить наш мой знать стать при чтобы дело жизнь кто первый очень два день её новый рука даже во со раз где там под можно ну какой после их работа без самый потом надо хотеть ли слово идти большой должен место",
        "pl": "i w nie na się z do to że jest o jak ale po co tak za od go już jego był czy tylko jej przez może ich być przy też gdy przed który ma dla ten bardzo kiedy ja ze był jeszcze gdzie jednak są nic pod sobie tego więc mnie teraz nawet ona bez tu życie dom ręka czas człowiek oczy",
        "hi": "है के में की से को का और पर यह एक हैं कि नहीं भी इस कर तो ही था हो ने लिए वह जो अपने या साथ बाद किया गया अब तक जब वे थे कुछ रहे सकते लोग समय दिन काम बात घर पानी देश",
        "el": "και το να του η της με που την από για είναι στο ο οι τα δεν σε θα τον των τη τους μια στη αυτό αλλά ως στην ήταν έχει ότι κατά μετά όπως άνθρωπος χρόνος μέρα ζωή κόσμος",
    }
    rng = random.Random(8)
    prose = lambda w: " ".join(" ".join(rng.choices(w.split(), k=12)) + "." for _ in range(25))
    rows = [(2 * i + j, prose(w), code if j else None) for i, (code, w) in enumerate(words.items()) for j in (0, 1)]
    got = quality_rules.measure(docs(spark, rows)).collect()
    assert [r.doc_id for r in got if not r.q_kept] == [] and len(got) == 8


def test_equal_rows_are_mixed_each_on_its_own(spark):
    """1,000 rows equal in every column: about as many come out as are wanted, and not all in one partition."""
    rows = spark.createDataFrame([(1, "same", "en", "a")], "doc_id long, text string, lang string, source string").crossJoin(spark.range(1000).select())
    out = poisson_mix.mix(rows, total_rows=1000)
    got = out.collect()
    assert abs(len(got) - 1000) < 4 * 1000**0.5 and len({r.shuffle_key for r in got}) == len(got)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mix_rates_and_large_means(spark):
    rows = [(i, "t", "en", "a" if i < 300 else "b" if i < 390 else None) for i in range(400)]
    df = docs(spark, rows)
    out = poisson_mix.mix(df, weights={"a": 1.0, "b": 1.0, None: 2.0}, total_rows=8000).collect()
    n = {s: sum(r.source == s for r in out) for s in ("a", "b", None)}
    assert abs(n["a"] - 2000) < 250 and abs(n["b"] - 2000) < 250 and abs(n[None] - 4000) < 400  # mean 400 a row of None
    assert poisson_mix.mix(df, weights={"a": 1.0}).filter("source = 'b'").count() == 0
    assert poisson_mix.mix(df.limit(0)).count() == 0
    a, b = (sorted((r.doc_id, r.copy, r.shuffle_key) for r in poisson_mix.mix(d).collect()) for d in (df, df.repartition(7)))
    assert a == b


def test_mix_of_null_and_repeated_ids(spark):
    """Rows without id, and rows of one id, are drawn and placed each on its own; both joins of the rates agree."""
    rows = [(None if i % 2 else 5, f"text {i}", "en", "a" if i < 1000 else "b") for i in range(2000)]
    out = poisson_mix.mix(docs(spark, rows), weights={"a": 1.0, "b": 3.0}, total_rows=4000)
    got = out.collect()
    n = {s: sum(r.source == s for r in got) for s in "ab"}
    assert abs(n["a"] - 1000) < 150 and abs(n["b"] - 3000) < 250 and len({r.shuffle_key for r in got}) == len(got)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 0.6 * len(got)


def test_mix_with_many_sources(spark, monkeypatch):
    rows = docs(spark, [(i, f"t{i}", "en", f"s{i % 40}") for i in range(400)])
    want = sorted((r.doc_id, r.copy) for r in poisson_mix.mix(rows).collect())
    monkeypatch.setattr(poisson_mix, "BROADCAST_SOURCES", 3)
    assert sorted((r.doc_id, r.copy) for r in poisson_mix.mix(rows).collect()) == want


def test_pii_many_spans_in_one_long_text(spark):
    """100,000 spans in 2 MB: places, context and redaction in linear time."""
    import time

    line = "+491234567890 word "
    text = line * 100_000
    d = docs(spark, [(1, text)])
    began = time.time()
    r = pii.scan(d).first()
    want = brute.pii_base(text)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[:5] and r.n_phone == 100_000
    assert pii.redact(d).first().text == "[PHONE] word " * 100_000
    assert time.time() - began < 60


def test_pii_reads_across_blocks(spark, monkeypatch):
    """Small blocks give the spans of large ones, with contexts and redactions that cross them."""
    rng = random.Random(6)
    words = ["ssn 123-45-6789", "123-45-6789", "iban DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "a@b.co", "10.0.0.1", "host", "+49 30 1234567", "4111 1111 1111 1111", "😀", "é", "plain", "card"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    d = docs(spark, list(enumerate(texts)))
    want = sorted(map(tuple, pii.scan(d).collect())), sorted((r.doc_id, r.text) for r in pii.redact(d).collect())
    monkeypatch.setattr(pii, "RUN", 3)
    monkeypatch.setattr(pii, "PART", 7)
    assert want == (sorted(map(tuple, pii.scan(d).collect())), sorted((r.doc_id, r.text) for r in pii.redact(d).collect()))


def test_long_texts(spark):
    """Texts of 200,000 words: places, counts and copies are those of the whole text."""
    n = 200_000
    words = [f"w{'abcdefghij'[i % 10]}{i}" for i in range(n)]
    words[5:9] = ["under", "the", "MIT", "License"]
    words[n - 4 :] = "apache license version 2".split()
    text = " ".join(words)
    r = license_index.scan(docs(spark, [(1, text)])).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, 2, 5, n - 4, "apache-2,mit")
    q = {x.doc_id: x for x in quality_rules.measure(docs(spark, [(1, text, "en"), (2, "again and again " * 50_000, "en")])).collect()}
    assert (q[1].q_n_words, q[1].q_n_repeat_words, q[1].q_word_chars) == (n, 0, len(text) - n + 1)
    assert (q[2].q_n_words, q[2].q_n_repeat_words, q[2].q_base_failed) == (150_000, 150_000, True)
    out = poisson_mix.mix(docs(spark, [(1, text, "en", "a")] * 3), total_rows=30).collect()
    assert 10 < len(out) < 60 and all(x.text == text for x in out)


@pytest.mark.parametrize("scan", [license_index.scan, pii.scan, quality_rules.measure])
def test_empty_tables(spark, scan):
    assert scan(docs(spark, []).limit(0)).count() == 0
