import hashlib
import math
import random
import re

import brute
import corpus_pipeline
from corpusloom.llm import piece_codec, quality_rules


def distance(p, q):
    t = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        t += (a * math.log2(a / m) if a > 0 else 0) / 2 + (b * math.log2(b / m) if b > 0 else 0) / 2
    return math.sqrt(max(t, 0))


def passes(text, lang):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    grams = {}
    for i in range(n - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in grams.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    if n < 20 or 100 * len(covered) > 30 * n:
        return False
    t = text
    letters, upper, digits = sum(c.isalpha() for c in t), sum(c.isupper() for c in t), sum(c in "0123456789" for c in t)
    spaces, marks = len(re.findall(r"[\x20\x09-\x0D]", t)), sum(c in ".,;:?!'\"()-" for c in t)
    shares = [x / len(t) for x in (letters - upper, upper, digits, spaces, marks, len(t) - letters - digits - spaces - marks)]
    bare = [re.sub(r"[.,;:!?]+$", "", w).lower() for w in words]
    js_c = min(distance(shares, quality_rules.CHARS[k]) for k in ([lang] if lang in quality_rules.CHARS else quality_rules.CHARS))

    def to(k):
        own = [bare.count(w) / n for w in quality_rules.WORDS[k]]
        return distance([*own, 1 - sum(own)], [*quality_rules.WORDS[k].values(), 1 - sum(quality_rules.WORDS[k].values())])

    js_w = min(to(k) for k in ([lang] if lang in quality_rules.WORDS else quality_rules.WORDS))
    return not (len(t) >= 100 and round(js_c, 6) > 0.22) and not (lang in quality_rules.WORDS and n >= 50 and round(js_w, 6) > 0.32)


def redacted(text):
    out, at = "", 0
    for span in [s for s in brute.pii_base(text)[5].split(",") if s]:
        kind, a, b = span.split(":")
        a, b = int(a), int(b)
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, b)
    return out + text[at:]


def copies(row, rate):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    name = md5(":".join("null" if c is None else md5(str(c)) for c in row)) + ":0"  # no two rows are equal here
    parts = max(1, math.ceil(rate / 200))
    mean, total = rate / parts, 0
    for j in range(parts):
        u = int(hashlib.sha256(f"mix-1:{name}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-mean), math.exp(-mean)
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        total += k
    return total


def documents():
    r = random.Random(11)
    common = ["the", "of", "and", "to", "in", "a", "is", "that"]
    word = lambda: r.choice(common) if r.random() < 0.3 else "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    rows = []
    for i in range(60):
        t = [word() for _ in range(r.randint(15, 90))]
        rows.append((" ".join(t), "en", f"s{i % 3}"))
        if i % 6 == 0:
            u = list(t)
            u[len(u) // 2] = "changed"
            rows += [(" ".join(u), "en", "s0"), (" ".join(t), "en", "s1")]
        if i % 7 == 0:
            rows.append((" ".join(t) + " write bob@mail.example.org or +49 30 1234567, 10.0.0.1 4111 1111 1111 1111 x", None, "s2"))
        if i % 9 == 0:
            rows.append((" ".join(w.upper() + "!!" for w in t), "en", "s0"))
            rows.append(("again and again it goes round " * 12, "en", None))
    rows += [(None, "en", "s0"), ("", None, None)]
    return [(i, t, lang, source, len(t or "")) for i, (t, lang, source) in enumerate(rows)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = documents()
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    kept = [r for r in rows if passes(r[1], r[2])]
    sets = [brute.shingles(r[1], 5) for r in kept]
    both = lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y)
    comp = brute.near_components([r[0] for r in kept], sets, both)
    kept = [(r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1]))) for r in kept if comp[r[0]] == r[0]]
    n = {}
    for _, _, _, s, _ in kept:
        n[s] = n.get(s, 0) + 1
    whole = sum(math.sqrt(v) for v in n.values())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    want = []
    for i, t, lang, s, chars in kept:
        ids = sp.encode(t, add_eos=True)
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        want += [row] * copies((i, t, lang, s, chars), len(kept) * math.sqrt(n[s]) / whole / n[s])
    assert 20 < len(kept) < len(rows) - 12
    assert got == sorted(want)


def test_stages_keep_columns_and_take_odd_rows(spark):
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy int, row string, component_id long"
    text = "the of and to in a is that for it with on " * 2 + " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en", "a", 5, 7, "r", 9), (1, text, "en", "a", 5, 7, "r", 9), (None, text, None, None, None, None, None, None), (3, None, None, None, None, None, None, None)], ddl)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, "")
            assert out.columns == docs.columns
            out.collect()
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3]
