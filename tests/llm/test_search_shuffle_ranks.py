"""Operators 11 to 13 against plain versions, with the odd cases that their docstrings define."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import rank_routing, tiered_search, two_pass_shuffle


# ---- 11: two-pass shuffle -------------------------------------------------------------------------------------------
def plain_shuffle(digests, sizes, shards, seed, bucket_bytes):
    """Shard and slot of each (digest, number among equal rows)."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    seen, held = Counter(), defaultdict(list)
    buckets = max(shards, -(-sum(sizes) // bucket_bytes))
    for d in digests:
        key = md5(f"{seed}:{d}:{seen[d]}")
        seen[d] += 1
        held[int(key[:15], 16) % buckets].append((key, d))
    order = []
    for b in sorted(held):
        rows = sorted(held[b])
        for i in range(len(rows) - 1, 0, -1):
            j = int(md5(f"{seed}:{b}:{i}")[:15], 16) % (i + 1)
            rows[i], rows[j] = rows[j], rows[i]
        order += [d for _, d in rows]
    out, at = [], 0
    for shard in range(shards):
        n = len(order) // shards + (shard < len(order) % shards)
        out += [(order[at + k], shard, k) for k in range(n)]
        at += n
    return Counter(out)


def odd_rows():
    rows = [(i, f"text {i} ü" * (i % 7), f"s{i % 3}", 5, i % 2) for i in range(90)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "", "s", 1, 1), (7, "", "s", 1, 1), (7, None, "s", 1, 1), (8, "x" * 5000, "s", 2, 0)]
    return rows


SHUFFLED = "doc_id long, text string, source string, shard int, slot int"


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 300])
def test_shuffle_equals_plain(spark, bucket_bytes):
    docs = spark.createDataFrame(odd_rows(), SHUFFLED).repartition(3)
    digested = docs.select(two_pass_shuffle.row_digest(docs).alias("d"), "text").collect()
    sizes = [len((r.text or "").encode()) + 16 for r in digested]
    want = plain_shuffle([r.d for r in digested], sizes, 6, "s", bucket_bytes)
    out = two_pass_shuffle.shuffle(docs, 6, "s", bucket_bytes)
    flat = out.select("row.*", F.col("shard").alias("to"), F.col("slot").alias("place"), "size")
    got = flat.select(two_pass_shuffle.row_digest(flat.select(*docs.columns)).alias("d"), "to", "place").collect()
    assert Counter((r.d, r.to, r.place) for r in got) == want
    assert Counter(map(tuple, out.select("row.*").collect())) == Counter(odd_rows())
    counts = Counter(r.to for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_equal_rows_are_spread(spark):
    docs = spark.createDataFrame([(None, "same")], "doc_id long, text string").crossJoin(spark.range(25_000).select()).unionByName(spark.createDataFrame([(1, "other")], "doc_id long, text string"))
    got = two_pass_shuffle.shuffle(docs, 8).select("row.*", "shard", "slot").toPandas()
    assert len(got) == 25_001 and set(got["text"]) == {"same", "other"}
    assert sorted(Counter(got["shard"]).values()) == [3125] * 7 + [3126]
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def test_shuffle_of_nothing_and_of_few(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert two_pass_shuffle.shuffle(docs).count() == 0
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in two_pass_shuffle.shuffle(docs).collect()) == [(0, 0), (1, 0)]


def test_nested_and_named_alike(spark):
    docs = spark.sql("SELECT 1 AS doc_id, 'a' AS text, array('x, y') AS row, map('k', 1) AS m, 3 AS size UNION ALL SELECT 1, 'a', array('x', 'y'), map('k', 1), 3")
    assert two_pass_shuffle.shuffle(docs, 2).select("row.row").distinct().count() == 2


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SHUFFLED)
    two_pass_shuffle.write_shards(docs, f"{tmp_path}/out", 4, bucket_bytes=500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, back.select("doc_id", "text", "source").collect())) == Counter(r[:3] for r in odd_rows())
    assert sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]


# ---- 12: tiered search ----------------------------------------------------------------------------------------------
def words_of(text):
    out, word = [], []
    for b in (text or "").encode():
        c = b + 32 if 65 <= b <= 90 else b
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            word.append(c)
        elif word:
            out.append(bytes(word).decode())
            word = []
    return out + [bytes(word).decode()] * bool(word)


def plain_search(docs, items):
    counted = [(i, Counter(words_of(t))) for i, t in docs]
    n, total = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    joined = defaultdict(list)
    for name, text in items:
        joined[name] += words_of(text)
    for name, words in joined.items():
        scores = []
        for i, c in counted:
            m = 75 + 25 * c.total() * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(name, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:20])]
    return sorted(out, key=repr)


def search_docs(n=400, seed=3):
    r = random.Random(seed)
    w = [f"w{i}" for i in range(60)] + ["ÄÖ", "ß", "x9", "日本"]
    common = ["the", "of", "and"]
    docs = [(i, " ".join(r.choices(common, k=r.randint(0, 20)) + r.choices(w, [1 / (k + 1) for k in range(len(w))], k=r.randint(1, 60)))) for i in range(n)]
    docs += [(1000 + i, "The same copy, of W1 and w7!") for i in range(70)]  # ties beyond the best
    docs += [(None, "w59 w59 w58"), (None, None), (5, None), (6, ""), (7, " .,\n"), (3, "w59"), (3, "w59"), (9, "w1 " * 30_000), (10, "Hello wORLD-äÄ")]
    items = [(1, "w1 W7 the the of"), (2, "nothing-here zzz"), (3, None), (4, ""), (5, "w59"), (6, "the of and w1 w2 w3 w4 w5 w6 w30 w40"), (7, "ÄÖ äÄ 日本 w59"), (1, "w20"), (None, "the w8")]
    return docs, items


@pytest.mark.parametrize("tiers,chunk", [(tiered_search.TIERS, 1000), (((4, 0), (12, 0), (24, 0)), 3), (((1, 0), (0, 0.1)), 2)])
def test_search_equals_plain(spark, tiers, chunk):
    docs, items = search_docs()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, block int").repartition(3)
    got = tiered_search.search(d, spark.createDataFrame(items, "item_id long, text string"), tiers=tiers, chunk=chunk)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain_search(docs, items)


def test_items_without_proof_fall(spark, monkeypatch):
    fallen = []
    old = tiered_search._Item.fall
    monkeypatch.setattr(tiered_search._Item, "fall", lambda self: (old(self), fallen.append(dict(self.depth))))
    docs, items = search_docs()
    tiered_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), tiers=((4, 0), (12, 0), (24, 0))).count()
    assert fallen and any(len(set(x.values())) > 1 for x in fallen)  # some terms stay where they are


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert tiered_search.search(none, items).count() == 0
    assert tiered_search.search(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), items.limit(0)).count() == 0


# ---- 13: ranks routed down a tree -----------------------------------------------------------------------------------
def plain_changes(events):
    """events: (key, batch, value, delta) with any of None."""
    out = []
    for key in {e[0] or "" for e in events}:
        own = [e for e in events if (e[0] or "") == key]
        old = (0, 0, 0, None, None, None)
        for batch in sorted({e[1] for e in own}):
            held = Counter()
            for e in own:
                if e[1] <= batch:
                    held[e[2]] += e[3]
            rows = sum(held.values())
            values = sorted(v for v, n in held.items() if v is not None for _ in range(n))
            new = (rows, len(set(values)), sum(values), *((values[0], values[-1], values[(len(values) + 1) // 2 - 1]) if values else (None,) * 3))
            if new != old:
                out.append((batch, key, *[x for pair in zip(old, new, strict=True) for x in pair]))
            old = new
    return sorted(out, key=repr)


def random_events(seed, n):
    r, events, held = random.Random(seed), [], []
    for batch in range(12):
        for _ in range(n):
            e = (r.choice(["hot", "hot", "hot", "b", None]), batch, r.choice([None, r.randint(-50, 50), r.randint(-(10**12), 10**12), 7]), 1)
            events.append(e)
            held.append(e)
        r.shuffle(held)
        for _ in range(min(len(held), r.choice([0, n, 2 * n]))):
            k, _, v, _ = held.pop()
            events.append((k, batch, v, -1))
    events += [("gone", 0, 5, 1), ("gone", 3, 5, -1), ("null", 2, None, 1), ("none", 1, 4, 1), ("none", 1, 4, -1)]
    return events


@pytest.mark.parametrize("leaf", [1024, 16, 1])
def test_changes_equal_plain(spark, leaf):
    events = random_events(leaf, 25)
    df = spark.createDataFrame(events, "source string, batch long, value long, delta long").withColumn("node", F.lit("x")).repartition(3)
    got = rank_routing.changes(df, ["source"], leaf=leaf)
    state = [f"{a}_{c}" for c in rank_routing.STATE for a in ("old", "new")]
    assert sorted(map(tuple, got.select("batch", "source", *state).collect()), key=repr) == plain_changes(events)


def test_changes_of_nothing(spark):
    assert rank_routing.changes(spark.createDataFrame([], "g string, batch long, value long, delta long"), ["g"]).count() == 0


def test_document_events(spark):
    rows = [(i, "s" if i % 5 else None, "en", None if i % 11 == 0 else i % 17) for i in range(300)] + [(None, "s", None, 3), (4, "s", "en", 4), (4, "s", "en", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long").withColumn("h", F.lit(1))
    events = []
    for i, s, lang, n in rows:
        h = zlib.crc32(("" if i is None else str(i)).encode())
        b, q, key = h % 20, h // 20 % 4, (s or "") + "|" + (lang or "")
        moves = [(b, n, 1), (b + q, n, -1)] + [(b + q, None if n is None else n + q, 1)] * (q % 3 == 0)
        events += [(key, at, v, d) for at, v, d in moves if at < 20]
    got = rank_routing.changes(rank_routing.document_events(docs), ["source", "lang"], leaf=8)
    state = [f"{a}_{c}" for c in rank_routing.STATE for a in ("old", "new")]
    assert sorted(map(tuple, got.select("batch", F.concat_ws("|", "source", "lang"), *state).collect()), key=repr) == plain_changes(events)
