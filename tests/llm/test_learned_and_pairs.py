import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from corpusloom.llm import byte_cnn, components, minhash_join, pfor_store, piece_codec, pivot_index
from corpusloom.llm.common import Scratch
from corpusloom.session import table


def linked(percent):
    def f(x, y):
        both = len(x & y)
        return bool(x) and bool(y) and 100 * both >= percent * (len(x) + len(y) - both)

    return f


def near_texts(seed=5, n=40):
    r = random.Random(seed)
    w = lambda: "".join(r.choice("abcdefghijklm") for _ in range(4))
    out = [None, "", " \n", "A b", "a B", "x y z", "X y\tz"]
    common = [w() for _ in range(60)]
    for _ in range(n):
        t = [w() for _ in range(r.randint(20, 120))]
        out.append(" ".join(t))
        out.append(" ".join([*t, *common]))  # a passage that many share
        for _ in range(r.randint(0, 4)):
            u = list(t)
            for _ in range(r.randint(0, 4)):
                u[r.randrange(len(u))] = w()
            out.append(" ".join(u))
    base = [w() for _ in range(200)]
    for _ in range(50):  # a large group of near copies
        u = list(base)
        for _ in range(r.randint(0, 9)):
            u[r.randrange(len(u))] = w()
        out.append(" ".join(u))
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(minhash_join, "CHUNK", 4)
    monkeypatch.setattr(minhash_join, "BLOCK", 16)
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component long").repartition(3)
    got = {r.doc_id: r for r in minhash_join.near_duplicates(docs, k, percent).collect()}
    sets = [brute.shingles(t, k) for t in texts]
    want = brute.near_components(list(range(len(texts))), sets, linked(percent))
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i), i


def test_near_duplicates_by_sampled_rounds(spark, monkeypatch):
    """The rounds that only spare work change nothing, nor do shuffled joins in place of broadcasts."""
    texts = near_texts(6, 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    plain = lambda **k: sorted(map(tuple, minhash_join.near_duplicates(docs, 3, 85, **k).collect()))
    want = plain()
    assert plain(few=-1) == want
    monkeypatch.setattr(minhash_join, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(components, "ONE_TASK_EDGES", 0)
    assert plain(few=-1) == want


def test_outsiders_meet_by_list_or_by_component(spark, monkeypatch):
    """Of each head the cheaper way is taken, and every other component that an outsider links with is found."""
    monkeypatch.setattr(minhash_join, "CHUNK", 2)
    monkeypatch.setattr(minhash_join, "BLOCK", 3)
    monkeypatch.setattr(minhash_join, "WIDE", 2)
    r = np.random.default_rng(3)
    base = {10: r.integers(0, 1 << 60, 100, dtype=np.uint64), 500: r.integers(0, 1 << 60, 100, dtype=np.uint64)}
    sets, comp, lists = {}, {}, {}

    def put(rep, component, of, changed, posts):
        s = base[of].copy()
        s[:changed] = r.integers(0, 1 << 60, changed, dtype=np.uint64)
        sets[rep], comp[rep] = np.unique(s), component
        for p in posts:
            lists.setdefault(p, []).append(rep)

    for i in range(20):  # head 10 is in four lists of all its members, so they meet as one component
        put(10 + i, 10, 10, i % 3, [1, 2, 3, 4])
        put(500 + i, 500, 500, i % 3, [5] if i < 4 else [6 + i])  # one list holds four of head 500's twenty
    for i in range(8):
        put(100 + i, 100 + i, 10, 2 if i < 5 else 60, [1, 2, 3, 4])
    put(600, 600, 500, 3, [5])
    put(601, 601, 500, 60, [5])
    mark = {k: minhash_join.signature(s).astype(np.int8).tolist() for k, s in sets.items()}
    met = [(p, k, mark[k], comp[k], 10 if p < 5 else 500, 20 if p < 5 else 4, 8 if p < 5 else 2) for p in (1, 2, 3, 4, 5) for k in lists[p]]
    met = spark.createDataFrame(met, "post long, rep long, mark array<tinyint>, component long, head long, size long, outside long").repartition(3)
    heads = met.select("post", "head", "size", "outside").distinct()
    reps = spark.createDataFrame([(k, mark[k]) for k in sets], "rep long, mark array<tinyint>")
    label = spark.createDataFrame([(k, c) for k, c in comp.items() if k != c], "id long, component long")
    scratch = Scratch()
    meet = minhash_join._meetings(met, heads, reps, label, scratch)
    assert {(x.whole, x.g) for x in meet.select("whole", "g").distinct().collect()} == {(True, 10), (False, 5)}
    bytes_of = spark.createDataFrame([(k, s.tobytes()) for k, s in sets.items()], "rep long, set binary")
    links = {(x.a, x.b) for x in minhash_join._outsiders(meet, bytes_of, 85, minhash_join.needed(85), scratch).collect()}
    alike = lambda x, y: minhash_join._alike(sets[x], sets[y], 85)
    assert all(alike(x, y) and comp[x] != comp[y] for x, y in links)
    found = {frozenset((comp[x], comp[y])) for x, y in links}
    want = {frozenset((comp[x], comp[y])) for x in comp for y in comp if comp[x] != comp[y] and alike(x, y)}
    assert found == want and frozenset((600, 500)) in want and len(want) == 1 + 5 + 10
    scratch.drop()


def test_near_duplicates_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "A b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash_join.near_duplicates(docs, 3, 85).collect())
    assert got == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert minhash_join.near_duplicates(docs.limit(0), 3, 85).count() == 0


def test_long_texts_hash_alike(monkeypatch):
    raw = " ".join(f"w{i} é{i}" for i in range(3000)).encode()
    whole = minhash_join.word_hashes(np.frombuffer(raw, np.uint8))[0]
    monkeypatch.setattr(minhash_join, "PIECE", 1000)
    assert (minhash_join._long_words(raw) == whole).all()


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components_of_a_chain(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
    e = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(200, 201)], "a long, b long")
    got = {r.id: r.component for r in components.components(e).collect()}
    assert set(got[i] for i in range(101)) == {0} and got[201] == 200
    assert components.components(e.limit(0)).count() == 0


def vectors(seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, 16))
    rows = [(i, centres[i % 30] + r.normal(size=16) * r.choice([0.02, 0.12, 0.25]), int(i % 3)) for i in range(900)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    rows += [(900 + i, rows[0][1], 0) for i in range(5)] + [(910, rows[0][1], None), (911, None, 0), (912, [0.0] * 16, 0), (913, [float("nan")] * 16, 0), (914, [None] * 16, 0)]
    return rows


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 64)
    rows = vectors()
    got = {r.vec_id: r for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    total = found = 0
    for i, v, y in ok:
        n = sum(1 for j, u, z in ok if z == y and j != i and (u @ v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93)
        total, found = total + n, found + got[i].n_links
        assert got[i].n_links <= n
    assert len(got) == len(rows) and total > 5000 and found >= 0.99 * total
    assert got[900].component_id == 0 and got[900].n_links >= 5
    for i in range(910, 915):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def brute_vectors(rows, least=0.93):
    """Links and smallest reachable id of each row, over all pairs."""
    from fractions import Fraction

    ok = [k for k, (i, v, y) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {}
    for k in ok:
        big = max(abs(Fraction(x)) for x in rows[k][1])
        x = np.array([float(Fraction(e) / big) for e in rows[k][1]])
        unit[k] = x / np.linalg.norm(x)
    links = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and unit[j] @ unit[k] >= least] for k in ok}
    out = []
    for k, (i, _, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        out.append((str(i), len(links.get(k, ())), str(i) if len(reach) == 1 else str(min(rows[j][0] for j in reach))))
    return sorted(out)


@pytest.mark.parametrize("longest,pivots", [(8192, 2048), (20, 64), (4, 1)])
def test_vectors_of_repeated_ids_and_extreme_lengths(spark, monkeypatch, longest, pivots):
    monkeypatch.setattr(pivot_index, "BLOCK", 8)
    monkeypatch.setattr(pivot_index, "LEAST_PIVOTS", min(pivots, 64))
    r = np.random.default_rng(7)
    e1, e2 = r.normal(size=8), r.normal(size=8)
    near = lambda e, s=0.02: [float(x) for x in e + r.normal(size=8) * s]
    rows = [(1, near(e1), 0), (1, near(e2), 0), (2, near(e1), 0), (3, near(e1), 0), (None, near(e1), 0)]
    rows += [(10, [1e200] + [0.0] * 7, 1), (11, [1e200, 1e195] + [0.0] * 6, 1), (12, [1e-200] + [0.0] * 7, 1), (12, [0.0, 1e-300] + [0.0] * 6, 1)]
    centres = r.normal(size=(6, 8))
    rows += [(int(r.integers(20, 90)), near(centres[k % 6], 0.1), 2) for k in range(90)]
    rows += [(100 + k, rows[20][1], 2) for k in range(3)] + [(100, rows[20][1], 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(x.vec_id), x.n_links, str(x.component_id)) for x in pivot_index.near_vectors(d, longest=longest, most_pivots=pivots).collect())
    want = brute_vectors(rows)
    if longest > 4:
        assert got == want
    else:  # one pivot: every pair is compared
        assert got == want


def test_vectors_with_ties(spark, monkeypatch):
    """Vectors as near to one pivot as to another, and copies in several lengths, take pivots in their order."""
    monkeypatch.setattr(pivot_index, "LEAST_PIVOTS", 4)
    rows = [(i, [float(b) for b in f"{i % 32:05b}"], 0) for i in range(1, 64)] + [(100 + i, [2.0 * int(b) for b in f"{i:05b}"], 0) for i in range(1, 32)]
    got = sorted((str(x.vec_id), x.n_links, str(x.component_id)) for x in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == brute_vectors(rows)


def test_links_at_the_threshold_with_many_pivots(spark, monkeypatch):
    """Planted pairs with cosines of 0.93 to 0.935 among 3,600 vectors and 1,024 pivots: at least 0.99 are found."""
    monkeypatch.setattr(pivot_index, "PER_PIVOT", 4)
    r = np.random.default_rng(11)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = r.normal(size=(600, 64))
    side -= (side * x[:600]).sum(axis=1)[:, None] * x[:600]
    side /= np.linalg.norm(side, axis=1)[:, None]
    c = r.uniform(0.9301, 0.935, size=(600, 1))
    rows = [(i, [float(e) for e in v], 0) for i, v in enumerate(np.concatenate([x, c * x[:600] + np.sqrt(1 - c * c) * side]))]
    seen = []
    old = pivot_index.prefix_of
    monkeypatch.setattr(pivot_index, "prefix_of", lambda n: (seen.append(n), old(n))[1])
    got = {v.vec_id: v for v in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(got[3000 + i].component_id == i for i in range(600))
    assert seen == [1024] and found >= 594 and sum(v.n_links for v in got.values()) == 2 * found


def test_vectors_empty(spark):
    assert pivot_index.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


ODD = [None, "", " ", "  two  spaces ", "\n", "a\nb c\nd", "▁x▁", "x<s>y</s>", "<|endoftext|> a", "日本語 テスト🎉", "the " * 500, "a" * 3000, "it's\n'll 's", "\t tab nbsp", "é"]


def odd_texts(n=400):
    r = random.Random(9)
    alphabet = "abc the  \n▁é日🎉'.,!1\t"
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_pieces_equal_the_library(spark, sf):
    import hashlib

    import sentencepiece

    texts = odd_texts() + [r.text for r in table(spark, sf, "documents").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in piece_codec.encode(docs, ids=True).collect():
        ids = sp.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    codec = piece_codec.PieceCodec(piece_codec.default_model())
    assert all(codec.decode(ids) == sp.decode(ids) for ids in (sp.encode(t or "", add_eos=True) for t in odd_texts(50)))
    assert piece_codec.encode(docs.limit(0)).count() == 0


def test_pieces_cache_is_emptied(monkeypatch):
    plain = lambda: [(a.tolist(), w, d) for a, w, d in piece_codec.encode_texts(odd_texts(50), piece_codec.default_model())]
    want = plain()
    monkeypatch.setattr(piece_codec, "CACHE_WORDS", 5)
    monkeypatch.setattr(piece_codec, "BLOCK_CHARS", 60)
    assert plain() == want


def test_pieces_of_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (None, None), (3, "one two"), (3, "one two"), (3, "other\ntext")]
    d = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.decoded, len(r.ids)) for r in piece_codec.encode(d, ids=True).collect())
    assert [g[:2] for g in got] == sorted((str(k), t or "") for k, t in rows) and min(g[2] for g in got) == 1


def test_pieces_of_very_long_words():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "x" * 100_000, "é🎉" * 20_000, " " * 5_000 + "a"]
    for t, (ids, _, decoded) in zip(texts, piece_codec.encode_texts(texts, piece_codec.default_model()), strict=True):
        assert ids.tolist() == sp.encode(t, add_eos=True) and decoded.decode() == sp.decode(ids.tolist())


def test_store_equals_the_library(spark, sf, monkeypatch):
    from tokenizers import Tokenizer

    texts = odd_texts() + [r.text for r in table(spark, sf, "documents").collect()]
    tok = Tokenizer.from_file(pfor_store.default_tokenizer())
    docs = spark.createDataFrame([(i * 3, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(5)
    got = sorted(pfor_store.read_store(pfor_store.write_store(docs), ids=True).collect())
    at = 0
    for i, (t, r) in enumerate(zip(texts, got, strict=True)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i * 3, at, len(ids), brute.crc(ids), ids)
        at += len(ids)
    assert pfor_store.read_store(pfor_store.write_store(docs.limit(0))).count() == 0


def test_store_of_null_and_repeated_ids(spark):
    """Rows without id and rows of one id stay, in order of id, and their starts leave no gap."""
    from collections import Counter

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pfor_store.default_tokenizer())
    rows = [(None, f"text {i} of none") for i in range(40)] + [(7, f"text {i % 20} of seven") for i in range(60)] + [(i, None) for i in range(5)] + [(9, "word " * 300_000)]
    got = pfor_store.read_store(pfor_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))).collect()
    want = Counter()
    for k, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[k, len(ids), brute.crc(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got[:-1], got[1:], strict=True)) and got[0].start == 0


@pytest.mark.parametrize("values", [[], [7], [0] * 300, list(range(5000)), [1] * 255 + [2**32 - 1], [2**31, 5] * 700])
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    keys, counts, back = pfor_store.unpack_file(pfor_store.pack_file([3, None], [len(ids), 0], ids))
    assert keys == [3, None] and counts.tolist() == [len(ids), 0] and back.tolist() == ids.tolist()


def test_classifier_on_the_held_out_fold(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = {r.doc_id: r for r in byte_cnn.score(docs, byte_cnn.train(docs, labels)).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in held)
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) >= 0.9


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x" * 3000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = byte_cnn.score(docs, byte_cnn.train(docs, none)).collect()
    assert [r.score for r in got] == [0.5] * 3 and byte_cnn.score(docs.limit(0), byte_cnn.ByteNet()).count() == 0


def test_long_texts_score_alike(monkeypatch):
    raw = " ".join(f"word{i} the of" for i in range(4000)).encode()
    net = byte_cnn.ByteNet()
    whole = net.score([raw])[0]
    monkeypatch.setattr(byte_cnn, "BLOCK_BYTES", 4096)
    assert abs(net.score([raw])[0] - whole) < 1e-3


def plain_score(net, raw):
    """The network's probability of one text by loops over its definition."""
    x = raw + b"\0" * (byte_cnn.PAD + -(len(raw) + byte_cnn.PAD) % byte_cnn.HALF)
    again = lambda i, lag: i - lag >= 0 and x[i] == x[i - lag] and x[i] > 32
    repeated = lambda i: any(all(again(i - j, lag) for j in range(byte_cnn.RUN)) for lag in byte_cnn.LAGS)
    vector = lambda i: [*(float(e) for e in net.p["emb"][x[i]]), float(repeated(i))]
    w = net.p["w"].astype(float)
    response = []
    for i in range(0, len(x) - byte_cnn.STEP, byte_cnn.STEP):  # the last step has no bytes after it
        v = [e for j in range(byte_cnn.WIDTH) for e in vector(i + j)]
        response.append([float(np.dot(v, w[:, f])) + float(net.p["b"][f]) for f in range(byte_cnn.FILTERS)])
    per = byte_cnn.HALF // byte_cnn.STEP
    halves = [np.max(response[i : i + per], axis=0) for i in range(0, len(response), per)]
    chunks = [np.maximum(np.maximum(h, halves[i + 1]) if i + 1 < len(halves) else h, 0) for i, h in enumerate(halves)]
    h = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + np.exp(-(float(h @ net.p["v"].astype(float)) + float(net.p["c"][0]))))


def test_scores_equal_plain_loops(spark, sf):
    docs, labels = (table(spark, sf, t) for t in ("documents", "labels"))
    net = byte_cnn.train(docs, labels)
    r = random.Random(8)
    texts = [b"", b"a", b"abc" * 85, b"x" * 251, b"x" * 252, b"x" * 253, bytes(r.randrange(256) for _ in range(1300)), *((d.text or "").encode()[:3000] for d in docs.limit(60).collect())]
    r.shuffle(texts)  # a score never depends on the texts beside it
    for t, p in zip(texts, net.score(texts), strict=True):
        assert abs(plain_score(net, t) - p) < 1e-4


def test_classifier_learns_repeated_ids_once(spark, monkeypatch):
    rows = [(i, f"good words number {i} here") for i in range(40)] + [(40 + i, "#%& " * (i + 1)) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    one = byte_cnn.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = byte_cnn.train(spark.createDataFrame(rows + rows[:5] * 50 + [(3, None)], "doc_id long, text string"), labels)
    assert all((one.p[k] == many.p[k]).all() for k in one.p)
    monkeypatch.setattr(byte_cnn, "GRADIENT_BYTES", 64)
    parts = byte_cnn.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert all(np.abs(parts.p[k] - one.p[k]).max() < 0.05 for k in one.p)


def test_gradients():
    r = np.random.default_rng(0)
    net = byte_cnn.ByteNet()
    raws = [bytes(r.integers(97, 110, 700).astype(np.uint8)), b"", b"abc" * 200]
    y = np.array([1, 0, 1], np.float32)
    g = net.gradients(raws, y)

    def loss():
        p = net.score(raws)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for name, at in (("v", (3,)), ("c", (0,)), ("b", (2,)), ("w", (5, 2)), ("emb", (100, 1))):
        keep, step = net.p[name][at], 1e-2
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3, name


@pytest.mark.parametrize("count", [64, 1024, 2048])
def test_recall_with_many_pivots(count):
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a, off = unit(r.normal(size=(10000, 64))), r.normal(size=(10000, 64))
    cosine = r.uniform(0.93, 0.935, 10000)[:, None]
    b = unit(cosine * a + np.sqrt(1 - cosine**2) * unit(off - (off * a).sum(1)[:, None] * a))
    pivots = pivot_index.choose_pivots(r.permutation(np.concatenate([a, b]))[: pivot_index.SAMPLE], count)
    near = [np.argsort(-(x @ pivots.T), axis=1)[:, : pivot_index.prefix_of(count)] for x in (a, b)]
    found = (near[0][:, :, None] == near[1][:, None, :]).sum((1, 2)) >= pivot_index.SHARED
    assert len(pivots) == count and found.mean() >= 0.99


def test_equal_rows_in_several_files(spark):
    """Rows without id and with one text are parted by ranges like others; their starts run on without a gap."""
    docs = spark.createDataFrame([(None, "one and the same text")], "doc_id long, text string").crossJoin(spark.range(4000).select()).unionByName(spark.createDataFrame([(1, "other"), (2, "")], "doc_id long, text string"))
    files = pfor_store.write_store(docs, partitions=4)
    assert max(r["n"] for r in files.groupBy("part").agg(F.sum("docs").alias("n")).collect()) < 2500
    got = sorted(pfor_store.read_store(files).collect(), key=lambda r: r.start)
    assert len(got) == 4002 and [r.doc_id for r in got[-2:]] == [1, 2]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
