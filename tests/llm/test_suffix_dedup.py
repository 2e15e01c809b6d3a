import hashlib
import random

import pytest

import brute
from corpusloom.llm import suffix_dedup
from corpusloom.session import table


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé ") for _ in range(r.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(r.randint(30, 90)) for _ in range(6)]
    out = [None, "", "x" * 199, "x" * 200, "y" * 1000, "ab" * 400, "z" * 150 + text(40)]
    for _ in range(n):
        t = text(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            t += s[a : a + r.randint(100, len(s))] + text(r.randint(0, 30))
        out.append(t)
    base = text(200)
    for _ in range(30):  # near copies
        k = r.randint(0, len(base) - 1)
        out.append(base[:k] + r.choice("xyz") + base[k + 1 :])
    return out + out[20:25]


@pytest.mark.parametrize("together", [64, 2])
def test_equals_brute_force(spark, together):
    texts = corpus(7)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, told int").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, together=together).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute.repeats(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, texts[i] and texts[i][:80], want)


def test_documents_equal_brute_force(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in suffix_dedup.op2_suffix_dedup(spark, sf).collect()}
    for r, want in zip(rows, brute.repeats([r.text for r in rows])):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    texts = [t.encode() for t in corpus(3) if t and len(t) > 900]
    for raw in texts:
        whole, part = suffix_dedup.Zones([raw]), suffix_dedup.LongZones(raw)
        assert whole.lo.tolist() == part.lo.tolist() and whole.hi.tolist() == part.hi.tolist()
        assert whole.g.tolist() == part.g.tolist() and whole.z.tolist() == part.z.tolist()


def test_repeated_ids_nulls_and_empty_table(spark):
    a, b = "p" * 50 + "".join(chr(97 + i * 7 % 26) + str(i) for i in range(150)), "q" * 300
    rows = [(1, a), (1, a), (1, "other " + b[:5]), (None, a), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted([(1, len(a), len(a)), (1, len(a), len(a)), (1, 11, 0), (0, len(a), len(a)), (0, 0, 0)])
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_zone_names_that_agree_in_32_bits(spark):
    line = "This line of 150 bytes stands in many documents, each time in other surroundings, and its windows are never repeated as a whole; only the line itself i"[:150]
    edge = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:25]
    # found by search: one bucket, and zones whose names have the same top 32 bits
    texts = [edge(i) + line + edge(-i - 1) for i in (38490, 239040)]
    z = suffix_dedup.Zones([t.encode() for t in texts])
    assert z.g[0] == z.g[1] and z.z[0] >> 32 == z.z[1] >> 32 and z.z[0] != z.z[1]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_texts_of_one_id_are_told_apart(spark):
    """Two texts with one id that are settled in the second pass, each by its own windows."""
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    p, q, edge = text(260), text(260), lambda: text(200)
    rows = [(1, edge() + p + edge()), (1, edge() + q + edge()), (3, edge() + p + edge()), (4, edge() + q + edge()), (None, edge() + p[:240] + edge()), (None, edge() + q[10:] + edge())]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), together=1).collect()
    two = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((str(k), *w) for (k, _), w in zip(rows, brute.repeats([t for _, t in rows]), strict=True))
    for out in (got, two):
        assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out) == want
    assert sorted(w[2] for w in want) == [240, 250, 260, 260, 260, 260]


def test_brute_force_with_repeated_ids_and_nulls(spark):
    r = random.Random(4)
    texts = corpus(9)
    rows = [(None if r.random() < 0.1 else r.randrange(len(texts) // 2) if r.random() < 0.3 else i + 1000, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(docs, together=8).collect())
    assert got == sorted((str(k), *w) for (k, _), w in zip(rows, brute.repeats(texts), strict=True))


def test_bucket_pointers_are_equal_for_equal_bytes():
    import numpy as np

    r = np.random.default_rng(3)
    base = r.integers(0, 3, 900).astype(np.uint8)
    flat = np.concatenate([base, base[100:700], np.zeros(500, np.uint8), base[300:]])
    pointer = suffix_dedup.bucket_pointers(flat)
    seen: dict = {}
    for i in range(len(flat) - suffix_dedup.WINDOW + 1):
        assert seen.setdefault(flat[i : i + suffix_dedup.WINDOW].tobytes(), pointer[i]) == pointer[i]
    assert len(set(seen.values())) == len(seen)


def test_equal_rows_ask_once(spark, monkeypatch):
    """2,000 rows without id and with one text, beside a row that shares a passage: two zones are compared, not 2,001."""
    asked = []
    old = suffix_dedup.compare_together
    monkeypatch.setattr(suffix_dedup, "compare_together", lambda a: (asked.append(a.count()), old(a))[1])
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, a, b = text(150), text(200), text(200)
    docs = spark.createDataFrame([(None, a + shared + a[::-1])] * 2000 + [(1, b + shared + b[::-1])], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs).collect()
    want = brute.repeats([a + shared + a[::-1]] * 2 + [b + shared + b[::-1]])
    assert max(asked) <= 4
    assert {(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got if x.doc_id is None} == {want[0]}
    assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got if x.doc_id == 1] == [want[2]]
