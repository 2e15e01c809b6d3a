import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit, dedup, grading, graph, scoring, splits, telemetry
from corpusloom.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_first_owner_keeps_variants(spark):
    d = spark.createDataFrame([(0, "s", "1", 0, "k"), (1, "s", "1", 1, "k"), (2, "s", "2", 0, "k")], "ord long, source string, original_id string, variant int, key string")
    assert sorted(r.ord for r in dedup.first_owner(d).collect()) == [0, 1]
    assert [r.ord for r in dedup.first_row(d).collect()] == [0]


def test_groups_do_not_depend_on_order(spark):
    e = [(3, "title:x"), (1, "title:x"), (1, "ctx:y"), (2, "ctx:y"), (9, "z")]
    a = rows(graph.connected_groups(spark.createDataFrame(e, "ord long, key string")).select("ord", "group"), "ord")
    b = rows(graph.connected_groups(spark.createDataFrame([(10 - o, k) for o, k in reversed(e)], "ord long, key string")).select("ord", "group"), "ord")
    assert dict(a)[1] == dict(a)[2] == dict(a)[3] == dict(b)[7] and dict(a)[9] == dict(b)[1] != dict(a)[1]
    chain = [(i, f"k{i}") for i in range(60)] + [(i, f"k{i + 1}") for i in range(60)]
    assert graph.connected_groups(spark.createDataFrame(chain, "ord long, key string")).select("group").distinct().count() == 1


def test_near_duplicates_and_greedy(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    t = [base, base + " thanks", "something else entirely with enough words to shingle properly here", base, "too short"]
    d = spark.createDataFrame(list(enumerate(t)), "ord long, t string").select("ord", T.shingle_keys(T.words("t")).alias("shingles"))
    pairs = dedup.near_duplicate_pairs(d)
    assert rows(pairs.select("a", "b"), "a", "b") == [(0, 1), (0, 3)]
    assert sorted(r.ord for r in dedup.greedy_keep(d, pairs).collect()) == [0, 2, 4]


def test_only_near_sets_are_sent(spark, monkeypatch):
    """Rows that share a least key, most of them unlike: the pairs are those of brute force, and marks leave out the rest."""
    import random

    r = random.Random(3)
    key = lambda: f"{r.randrange(1 << 40, 1 << 64):016x}"
    sets = []
    for n in [3, 4, 5, 9, 10, 40, 200, 290, 330, 600, 1100] * 4:
        own = [key() for _ in range(n)]
        sets.append({"0" * 16, *own})
        for part in (9, 20):  # near copies, the first around the limit, of other sizes too
            sets.append({"0" * 16, *own[: n - max(1, n // part)], *(key() for _ in range(max(1, n // part)))})
            sets.append({"0" * 16, *own, *(key() for _ in range(max(1, n // 4)))})
    d = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "ord long, shingles array<string>")
    sent, old = {}, dedup.materialize

    def counted(df, name):
        out = old(df, name)
        sent[name] = out.count()
        return out

    monkeypatch.setattr(dedup, "materialize", counted)
    want = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert rows(dedup.near_duplicate_pairs(d).select("a", "b"), "a", "b") == want
    assert len(want) > 50 and sent["nd-pairs"] < len(want) + 60  # of 17,000 pairs that share a key


@pytest.mark.parametrize("tile", [4096, 40])
def test_common_keys_meet_in_tiles(spark, monkeypatch, tile):
    """Postings of common keys are compared by tiles, of one block or more, with sizes in one band, in adjacent ones and far apart."""
    import random

    r = random.Random(8)
    key = lambda: f"{r.randrange(1 << 40, 1 << 64):016x}"
    sets = []
    for n in [4, 5, 9, 10, 19, 20, 24, 40, 200, 255, 257, 290, 512, 600, 1100] * 6:
        own = [key() for _ in range(n)]
        sets.append({"0" * 16, "0" * 15 + "1", *own})
        for part in (9, 20):
            sets.append({"0" * 16, *own[: n - max(1, n // part)], *(key() for _ in range(max(1, n // part)))})
            sets.append({"0" * 15 + "1", *own, *(key() for _ in range(max(1, n // part)))})
    d = spark.createDataFrame([(i, bytes.fromhex("".join(sorted(s)))) for i, s in enumerate(sets)], "ord long, shingles binary")
    met = []
    old = dedup._met_in_tiles
    monkeypatch.setattr(dedup, "_met_in_tiles", lambda p, least: (met.append(p.count()), old(p, least))[1])
    monkeypatch.setattr(dedup, "COMMON", 8)
    monkeypatch.setattr(dedup, "TILE", tile)
    least16 = [set(sorted(s)[:16]) for s in sets]
    want = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if least16[a] & least16[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert rows(dedup.near_duplicate_pairs(d).select("a", "b"), "a", "b") == want
    assert len(want) > 150 and met[0] > len(sets)


def test_packed_shingle_keys_equal_those_of_the_expression(spark, monkeypatch):
    """Also of texts beyond ASCII, without words, with fewer words than a shingle, and of more shingles than are held at once."""
    t = [None, "", "a b c d", "A b_c D-e'f  g 1", "\x00a\x1cb\tc\nd\x7fe f", "a b c d e a b c d e a b", "\u00c4rger \u00dcber \u0130stanbul \u212a \u0663 x\u00a0y \u4e2d\u6587 \U00010400\u01c5 e\u0301 \u00bd", "\u00a0".join("vwxyz"), "-".join(map(str, range(40)))]
    d = spark.createDataFrame(list(enumerate(t)), "ord int, t string")
    plain = F.unhex(F.array_join(F.array_sort(T.shingle_keys(T.words(F.lower("t"), r"[\p{L}\p{N}_]+"))), ""))
    got = d.select("ord", plain.alias("plain"), T.word_bytes("t").alias("words")).orderBy("ord").collect()
    assert [len(r.plain) // 8 for r in got][:6] == [0, 0, 0, 3, 2, 5] and len(got[8].plain) == 8 * 36
    for held in (1 << 16, 3):
        monkeypatch.setattr(T, "SHINGLES", held)
        assert [T.packed_shingle_keys(None if r.words is None else bytes(r.words)) for r in got] == [r.plain for r in got]


def plain_greedy(n, pairs):
    kept = []
    for i in range(n):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("one_task", [200_000, 3])
def test_greedy_keep_of_chains_and_webs(spark, one_task, monkeypatch):
    """A chain of 2,000 near duplicates takes one round; components over the bound give the same by rounds."""
    import random

    from corpusloom.operators import graph

    rounds = []
    old = graph.connected_groups
    monkeypatch.setattr(dedup, "connected_groups", lambda e: (rounds.append(1), old(e))[1])
    r = random.Random(5)
    chain = {(i, i + 1) for i in range(1999)} if one_task > 3 else {(i, i + 1) for i in range(9)}
    web = {tuple(sorted(r.sample(range(2000, 2040), 2))) for _ in range(60)}
    pairs = spark.createDataFrame([(a, b, False) for a, b in chain | web] + [(1, 2050, True)], "a long, b long, copy boolean")
    got = sorted(x.ord for x in dedup.greedy_keep(spark.range(2060).withColumnRenamed("id", "ord"), pairs, one_task).collect())
    assert got == [x for x in plain_greedy(2060, chain | web) if x != 2050]
    assert len(rounds) == 1 if one_task > 3 else len(rounds) < 20


def test_many_small_components_are_decided_in_few_calls(spark, monkeypatch, tmp_path):
    old = dedup._first_come

    def counted(key, d):
        from uuid import uuid4

        (tmp_path / uuid4().hex).touch()
        return old(key, d)

    monkeypatch.setattr(dedup, "_first_come", counted)
    pairs = spark.range(400).selectExpr("3 * id AS a", "3 * id + 1 AS b", "false AS copy")
    got = sorted(x.ord for x in dedup.greedy_keep(spark.range(1200).withColumnRenamed("id", "ord"), pairs).collect())
    assert got == [x for x in range(1200) if x % 3 != 1]
    assert len(list(tmp_path.iterdir())) <= 8


def test_rows_in_sessions_of_all_lengths(spark):
    import random

    r = random.Random(4)
    spans = [("r", a, a + r.choice([0.0, 0.5, 60.0, 86_400.0, 3e7])) for a in (r.uniform(0, 1e8) for _ in range(60))] + [("q", 0.0, 5.0)]
    rows = [(r.choice("rq"), r.uniform(0, 1.4e8)) for _ in range(500)] + [("r", b) for _, _, b in spans] + [("r", a) for _, a, _ in spans]
    d = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "run string, ts double, i int")
    s = spark.createDataFrame([(k, a, b, i) for i, (k, a, b) in enumerate(spans)], "run string, start double, end double, session int")
    got = sorted((x.i, x.session) for x in telemetry.in_sessions(d, s, "run").collect())
    assert got == sorted((i, j) for i, (k, t) in enumerate(rows) for j, (m, a, b) in enumerate(spans) if k == m and a <= t <= b)


def test_rows_in_sessions_are_not_broadcast(spark, tmp_path):
    """Small files are no reason to send rows, one for each width of a session, through the driver."""
    rows_ = spark.range(1000).selectExpr("id % 5 AS run", "CAST(id AS double) AS ts")
    spans = spark.range(50).selectExpr("id % 5 AS run", "id AS session", "CAST(id * 17 AS double) AS start", "CAST(id * 17 + pow(2, id % 9) AS double) AS end")
    for name, d in (("rows", rows_), ("spans", spans)):
        d.write.parquet(f"{tmp_path}/{name}")
    out = telemetry.in_sessions(spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/spans"), "run")
    assert out.count() == rows_.join(spans, "run").filter("ts BETWEEN start AND end").count() > 0
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_liveness_by_buckets_of_runs(spark, monkeypatch):
    """Runs of one bucket share state and timer; each turns stale at its own time, and alive again with a new row."""
    from corpusloom.streaming import replay

    monkeypatch.setattr(replay, "BUCKETS", 2)
    at = [("a", 9000), ("a", 9990), ("b", 9500), ("c", 10000), ("b", 10050), ("d", 11000)]
    d = spark.createDataFrame(at, "run string, s long").select("run", F.timestamp_seconds("s").alias("ts"))
    cut = d.filter("run = 'c'").first()["ts"]
    out = replay.replay(d, F.col("ts"), [cut], lambda s: replay.liveness_stream(s, 100))
    got = sorted(tuple(r) for r in out.select("run", F.unix_seconds("last"), "rows", "state").collect())
    alive = [("a", 9990, 2), ("b", 9500, 1), ("b", 10050, 1), ("c", 10000, 1), ("d", 11000, 1)]
    assert got == sorted([(*x, "alive") for x in alive] + [(r, t, 0, "stale") for r, t, _ in alive if r != "d"])


def test_numbers_of_ids_are_those_of_the_ids(spark):
    """Ids are counted by small blocks in the task and never sent; the blocks are cut between texts."""
    from corpusloom.functions import tokens

    d = spark.createDataFrame([(None,), ("",), ("one two  three\n",), ("Grüße, 1,000 Straßen! " * 3000,), ("x",)], "t string").coalesce(1)
    got = [tuple(r) for r in d.select(tokens.token_counts("t"), F.size(tokens.encode_column("t"))).collect()]
    assert all(a == b for a, b in got) and got[0] == (0, 0) and got[3][0] > 3000


def test_final_answers_fold_only_what_is_asked(spark):
    """Texts whose source takes a number or a box are not sent to Python, and all are folded once."""
    d = spark.createDataFrame([("gsm8k", "x #### 1,500"), ("math", "so \\boxed{ {A} }"), ("qasc", "Answer: b Answer: STRASSE \n"), ("qasc", "none"), ("boolq", " Groß  TEXT"), (None, "ẞ")], "s string, t string")
    got = d.select(grading.final_answer("t", F.col("s")).alias("x"))
    assert [r.x for r in got.collect()] == ["1500", "{A}", "strasse", None, "gross text", "ss"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_fold(") == 1


def test_pack_in_slabs(spark, monkeypatch):
    """Packed rows are the same whether one call of Python makes two or all of them."""
    d = spark.range(60).selectExpr("IF(id % 3 = 0, 's', 't') AS source", "id AS ord", "transform(sequence(0, cast(id * 7 % 11 as int)), x -> cast(id + x as int)) AS ids", "cast(id % 2 as int) AS answer_start")
    packed = lambda slab: (monkeypatch.setattr(splits, "SLAB", slab), sorted(map(repr, splits.pack(d, context=19).collect())))[1]
    got = packed(2)
    assert got == packed(64) and len(got) > 10


def test_shingle_keys_are_made_once(spark, sf):
    """Keys and their number come from one evaluation of the digests of a text."""
    from corpusloom.plans import corpus

    plan = corpus.shingle_keys(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_running_measures_by_blocks(spark, monkeypatch):
    """Blocks of seven numbers give the sessions, segments, parts and values of one window over each run."""
    import random

    monkeypatch.setattr(telemetry, "BLOCK", 7)
    r = random.Random(6)
    rows = [(run, i, r.choice(["train"] * 6 + ["start", "finished"]), float(i * 60 + r.choice([0, 0, 400])), r.choice([1.0, None])) for run in "ab" for i in range(60)]
    d = spark.createDataFrame(rows, "run string, pos long, event string, ts double, v double")
    got = {(x.run, x.pos): (x.session, x.segment) for x in telemetry.segments(d).collect()}
    for run in "ab":
        session = segment = 0
        last, before = None, None
        for _, pos, event, ts, _ in [x for x in rows if x[0] == run]:
            if event == "start":
                session, last = session + 1, None
            if event == "start" or before == "finished" or (event == "train" and last is not None and ts - last > 180):
                segment += 1
            last, before = (ts if event == "train" else last), event
            assert got[run, pos] == (session, segment), (run, pos)
    right = d.filter("v IS NOT NULL").select("run", "pos", F.col("ts").alias("value"))
    left = d.filter("event = 'train'").select("run", "pos")
    asof = {(x.run, x.pos): x.value for x in telemetry.as_of(left, right, "run", "pos", "value", block=7).collect()}
    for (run, pos), value in asof.items():
        known = [x[3] for x in rows if x[0] == run and x[1] <= pos and x[4] is not None]
        assert value == (known[-1] if known else None)


def test_quarantine_takes_whole_groups(spark):
    d = spark.createDataFrame([("s", "1", "g"), ("s", "2", "g"), ("s", "3", "h")], "source string, original_id string, group string")
    x = spark.createDataFrame([("s", "1")], "source string, original_id string")
    assert [r.original_id for r in dedup.quarantine(d, x).collect()] == ["3"]


def test_balance_moves_two_groups(spark):
    ddl = "source string, group string, split string, labels array<string>, rank string"
    rows = [("cb", f"g{i}", "train", ["x"], f"{9 - i}") for i in range(5)]
    moved = lambda r: {x.group: x.split for x in splits.balance(spark.createDataFrame(r, ddl)).collect() if x.split != "train"}
    assert moved(rows) == {"g4": "dev", "g3": "confirmation"}
    with pytest.raises(Exception, match="fewer than two train groups"):
        moved(rows[:1])


def plain_balance(rows, pick=("dev", "confirmation")):
    where = {(s, g): split for s, g, split, _, _ in rows}
    for s in sorted({r[0] for r in rows}):
        for split in pick:
            for label in sorted({x for r in rows if r[0] == s for x in r[3]}):
                have = [r for r in rows if r[0] == s and label in r[3]]
                if not any(where[s, r[1]] == split for r in have):
                    free = sorted((r[4], r[1]) for r in have if where[s, r[1]] == "train")
                    assert len(free) > 1
                    where[s, free[0][1]] = split
    return where


def test_balance_equals_plain(spark):
    import random

    r = random.Random(3)
    rows = [(f"s{i % 3}", f"g{i}", r.choice(["train"] * 9 + ["dev"]), r.sample("abcd", r.randint(1, 3)), str(r.random())) for i in range(90)]
    got = splits.balance(spark.createDataFrame(rows, "source string, group string, split string, labels array<string>, rank string")).collect()
    assert {(x.source, x.group): x.split for x in got} == plain_balance(rows) and len(got) == 90


def test_next_fit_is_one_pass(spark):
    """Blocks of any size give the rows of one pass over each source."""
    import random

    r = random.Random(7)
    sizes = {s: [r.choice([0, 1, r.randint(1, 50), r.randint(1, 10)]) for _ in range(n)] for s, n in (("a", 300), ("b", 1), ("c", 17))}
    d = spark.createDataFrame([(s, i, n) for s, v in sizes.items() for i, n in enumerate(v)], "source string, place long, size int")
    want = {}
    for s, v in sizes.items():
        row, used = -1, -1
        for i, n in enumerate(v):
            if used < 0 or used + n > 50:
                row, used = row + 1, 0
            used += n
            want[s, i] = row
    for block in (3, 1000):
        assert {(x.source, x.place): x.row for x in splits.next_fit(d, 50, block).collect()} == want


def test_chosen_sources_follow_their_weights(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 7.0), ("d", None), ("e", 2.0)], "source string, weight double")
    got = [x.source for x in splits.chosen_sources(weights, 20_000).collect()]
    n = {s: got.count(s) for s in "abcde"}
    assert len(got) == 20_000 and n["b"] == n["d"] == 0
    assert all(abs(n[s] - 20_000 * w) < 4 * (20_000 * w) ** 0.5 for s, w in (("a", 0.1), ("c", 0.7), ("e", 0.2)))


def test_numbered_lines_over_splits(spark, tmp_path):
    """Files of many splits: numbers run on from split to split, blank lines have none."""
    from corpusloom.sources import readers

    texts = {"a": [f"line {i}" if i % 7 else " " for i in range(4000)], "b": ["x"], "c": []}
    for name, lines in texts.items():
        (tmp_path / f"{name}.txt").write_text("".join(x + "\n" for x in lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = readers.numbered_text(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, lines in texts.items():
        own = sorted((x.number, x.value) for x in got if x.path.endswith(f"/{name}.txt"))
        assert own == list(enumerate(x for x in lines if x.strip()))


def test_paired_lines_of_different_lengths(spark, tmp_path):
    from corpusloom.sources import readers

    (tmp_path / "a").write_text("1\n2\n")
    (tmp_path / "b").write_text("x\n")
    with pytest.raises(Exception, match="differ in length"):
        readers.paired_lines(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()


def test_large_files_by_ranges(spark, tmp_path):
    """A file over 2 GB (with holes, so it takes no room) is hashed in chunks; a flat array is read by ranges in order."""
    import hashlib

    import numpy as np

    from corpusloom.sources import ranges

    with open(tmp_path / "large", "wb") as f:
        f.truncate((1 << 31) + 5)
        f.seek(1 << 20)
        f.write(b"x" * 1000)
    (tmp_path / "empty").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in ranges.file_digests(spark, f"file://{tmp_path}").collect()}
    with open(tmp_path / "large", "rb") as f:
        assert got == {"large": ((1 << 31) + 5, hashlib.file_digest(f, "sha256").hexdigest()), "empty": (0, hashlib.sha256().hexdigest())}
    ids = np.arange(10_001) * 7 % 65_536
    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "ids").write_bytes(ids.astype("<u2").tobytes())
    read = ranges.flat_array(spark, str(flat), chunk=300, size=3000)
    assert read.rdd.getNumPartitions() > 5
    assert np.concatenate([r.ids for r in sorted(read.collect(), key=lambda r: r.start)]).tolist() == ids.tolist()
    (flat / "ids").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        ranges.flat_array(spark, str(flat)).collect()


def test_small_files_share_tasks(spark, tmp_path):
    """Tasks grow with files by dozens: one task for each file, or one for all of them, is neither."""
    import hashlib

    from pyspark.sql import functions as F

    from corpusloom.plans import stores
    from corpusloom.sources import ranges

    texts = {f"{i:03}": b"x" * i for i in range(150)} | {"large": b"y" * (ranges.RANGE + 1)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    files = ranges.file_digests(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 4
    assert {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in files.collect()} == {k: (len(x), hashlib.sha256(x).hexdigest()) for k, x in texts.items()}
    dealt = stores._by_part(spark.range(1000).select((F.col("id") % 160).alias("part"), "id"))
    tasks = dealt.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("part").alias("n")).collect()
    assert len(tasks) > 7 and sum(t.n for t in tasks) == 160
    assert stores._by_part(dealt.filter("id < 0")).count() == 0


def test_publish_table_once(spark, tmp_path):
    from corpusloom.sources import sinks

    path = f"{tmp_path}/out"
    d = spark.createDataFrame([(1, "a"), (2, None)], "x int, t string")
    assert sinks.publish_table(d, path) and not sinks.publish_table(d.orderBy("x", ascending=False), path)
    for other in (d.limit(1), d.unionAll(d)):
        with pytest.raises(FileExistsError):
            sinks.publish_table(other, path)
    assert spark.read.parquet(path).count() == 2 and not [x for x in tmp_path.iterdir() if x.name != "out"]


def test_published_batches_survive_a_lost_checkpoint(spark, tmp_path):
    from corpusloom.sources import sinks

    d = spark.createDataFrame([(1,), (2,)], "x int")
    d.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("x int").parquet(f"{tmp_path}/in")
    for checkpoint in ("c1", "c1", "c2"):  # the third forgets what it did; the same batch writes nothing
        sinks.publish_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}").start().awaitTermination()
    assert sorted(x.x for x in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
    d.write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.publish_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/c3").start().awaitTermination()


def test_pack(spark):
    d = spark.createDataFrame([("s", i, list(range(n)), 1) for i, n in enumerate([400, 400, 400, 2000, 100])], "source string, ord long, ids array<int>, answer_start int")
    r = splits.pack(d).orderBy("row").collect()
    assert [(x.used, x.records) for x in r] == [(800, [0, 1]), (500, [2, 4])] and all(len(x.ids) == 1025 == len(x.answer_mask) for x in r)
    a, b = (splits.pack(d, rows=3).orderBy("row").collect() for _ in range(2))
    assert a == b and len(a) == 3


def test_weights(spark):
    s = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "source string, family string")
    w = splits.sampling_weights(s)
    assert {r.source: r.weight for r in w.collect()} == {"a": 0.25, "b": 0.25, "c": 0.5}
    assert audit.wrong_weights(w).count() == 0 and audit.wrong_weights(w.filter("source <> 'c'")).count() > 0


@pytest.mark.parametrize("text,want", [("x \\boxed{\\frac{1}{2}} y", "\\frac{1}{2}"), ("\\boxed{1} \\boxed{2}", "2"), ("\\boxed{1", None), ("none", None)])
def test_boxed(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(grading.boxed("t")).first()[0] == want


@pytest.mark.parametrize("kind,answer,ref,want", [("number", "4.00", "4", ("correct", True)), ("number", "4 meters", "4", ("format_error", False)), ("text", "a\nb", "b", ("format_error", False)), ("text", "why\nFinal answer: Blue", "blue", ("correct", True)), ("choice", "(B)", "B", ("format_error", False)), ("choice", "B", "B", ("correct", True)), ("choice", "Q", "B", ("format_error", False)), ("external", "x", "y", ("unscored_external_grader_required", None)), ("text", "Final answer: a\nFinal answer: b", "b", ("format_error", False))])
def test_grade(spark, kind, answer, ref, want):
    d = spark.createDataFrame([(kind, answer, ref, ["x", "y"])], "k string, a string, r string, c array<string>")
    assert tuple(d.select(grading.grade("k", grading.contract_line("a"), "r", "c")).first()[0]) == want


def test_arithmetic_equals_python():
    """Random expressions against Python's own evaluation over exact fractions."""
    import random
    from fractions import Fraction

    r = random.Random(3)

    def expression(depth):
        if depth == 0 or r.random() < 0.2:
            return str(r.choice([0, 1, 2, 3, 10, 25]))
        kind = r.random()
        if kind < 0.15:
            return r.choice("+-") + expression(depth - 1)
        if kind < 0.3:
            return f"({expression(depth - 1)})"
        return expression(depth - 1) + r.choice([" + ", "-", "*", "/"]) + expression(depth - 1)

    for _ in range(2000):
        t = expression(3)
        try:
            want = eval(re.sub(r"([0-9]+)", r"Fraction(\1)", t), {"Fraction": Fraction})  # noqa: S307  built here
        except ZeroDivisionError:
            want = None
        assert grading.arithmetic_value(t) == want, t


def test_outputs_and_arithmetic(spark):
    d = spark.createDataFrame([("1 2", "1  2\n", True), ("1.0000001", "1", True), ("10", "11", False), ("a", "a b", False), ("x", "1", False)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in d.select(scoring.same_output("a", "b").alias("got"), "want").collect())
    e = spark.createDataFrame([("1/3+1/6", "1/2"), ("2*(3-5)", "-4/1"), ("1/0", None), ("__import__('os')", None)], "t string, want string")
    assert all(r.got == r.want for r in e.select(grading.arithmetic("t").alias("got"), "want").collect())


def test_null_is_not_wrong(spark):
    d = spark.createDataFrame([("a", True), ("a", None), ("b", None)], "source string, correct boolean").withColumn("reference_parseable", F.lit(True))
    assert rows(scoring.source_scores(d), "source") == [("a", 2, 1, 1, 1.0), ("b", 1, 0, 0, None)]


def test_gap_series_and_elapsed(spark):
    d = spark.createDataFrame([(1, 0.0, 1.0), (1, 15.0, 1.0), (1, 90.0, 1.0), (1, 105.0, None), (1, 120.0, 1.0)], "r int, ts double, v double")
    assert telemetry.gap_segments(d, ["r"], "ts", "v", 45).select("part").distinct().count() == 3
    t = spark.createDataFrame([(x,) for x in (150.0, 200.0, 500.0, 173050.0, 173100.0)], "t double")
    assert [r[0] for r in t.orderBy("t").select(telemetry.elapsed([(100, 200), (173000, 173100)], F.col("t"))).collect()] == [50, 100, 100, 150, 200]


def test_crossings_of_many_targets(spark):
    events = [("a", 10 * i, i * 7 % 3000) for i in range(400)] + [("b", 5, 1500), ("b", 3, None), ("c", None, 40), (None, 1, 8)]
    goals = [*range(0, 2600, 2), None]
    d = spark.createDataFrame(events, "run string, step long, tokens long")
    got = telemetry.crossings(d, spark.createDataFrame([(g,) for g in goals], "target long"), "run", "step", "tokens")
    want = {}
    for run, step, tokens in events:
        for g in goals:
            if tokens is not None and g is not None and tokens >= g:
                want.setdefault((run, g), []).append(step)
    want = {k: min((x for x in v if x is not None), default=None) for k, v in want.items()}
    assert got.columns == ["run", "target", "step"] and max(g for _, g in want) > 2000
    assert sorted(map(str, got.collect())) == sorted(f"Row(run={r!r}, target={g}, step={s})" for (r, g), s in want.items())


def test_self_time_and_work(spark):
    p = spark.createDataFrame([("a", 60.0), ("a/b", 20.0), ("a/b/c", 5.0)], "path string, inclusive double")
    assert {r.path: r.self for r in telemetry.self_time(p).collect()} == {"a": 40.0, "a/b": 15.0, "a/b/c": 5.0}
    x = spark.createDataFrame([("r", "a", 10), ("r", "b", 5)], "name string, source string, tokens long")
    y = spark.createDataFrame([("r", "a", 30), ("r", "b", 4)], "name string, source string, tokens long")
    assert rows(telemetry.work_delta(x, y), "source") == [("r", "a", 20, False), ("r", "b", -1, True)]


def test_locks(spark):
    ok = "0" * 64
    d = spark.createDataFrame([("data/train-1.parquet", "train", ok), ("../train.parquet", "train", ok), ("data/test.parquet", "train", ok), ("train.parquet", "dev", ok), ("train.parquet", "train", "x")], "path string, original_split string, sha256 string")
    assert rows(audit.bad_locks(d).select("violation"), "violation") == [("digest",), ("held-out file",), ("path escape",), ("split",)]
    with pytest.raises(ValueError):
        readers.checked_lock(d)


def test_bags_and_tasks(spark):
    a, b = (spark.createDataFrame(x, "v int") for x in ([(1,), (1,), (2,)], [(1,), (2,), (2,)]))
    assert audit.bag_equal(a, a) and not audit.bag_equal(a, b)
    t = spark.createDataFrame([("choice", "p", ["x", "y"], "B"), ("choice", "p", ["x", "y"], "C"), ("number", "p", None, "z"), ("odd", "p", None, None)], "kind string, prompt string, choices array<string>, reference string")
    assert sorted(r.violation for r in audit.bad_tasks(t).collect()) == ["kind", "reference", "reference"]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n{"x": 3')
    log = readers.log_lines(spark, str(tmp_path / "a.jsonl"), "x INT").cache()
    assert log.filter("_corrupt IS NOT NULL").count() == 1 and log.filter("_corrupt IS NULL").count() == 2
    (tmp_path / "o.json").write_text('{"k1": {"v": 1}, "k2": {"v": 2}}')
    assert rows(readers.json_objects(spark, str(tmp_path / "o.json"), "struct<v:int>"), "key") == [("k1", 1), ("k2", 2)]
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n')
    assert rows(readers.csv(spark, str(tmp_path / "c.csv")), "a") == [("1", "x\ny")]
    (tmp_path / "t.bin").write_bytes(bytes([1, 0, 2, 1]))
    assert readers.flat_tokens(spark, str(tmp_path / "t.bin")).first().ids == [1, 258]
    assert sinks.publish_once({"a": 1}, str(tmp_path / "m.json")) and not sinks.publish_once({"a": 1}, str(tmp_path / "m.json"))
    with pytest.raises(FileExistsError):
        sinks.publish_once({"a": 2}, str(tmp_path / "m.json"))
    assert sinks.markdown(spark.createDataFrame([(1, "x|y")], "a int, b string"), ["a"]).endswith("| 1 | x\\|y |")


def test_streams_equal_batch(spark, tmp_path):
    import json

    from corpusloom.streaming import telemetry as S

    t0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    ev = [("start", 0), ("train", 10), ("train", 70), ("train", 400), ("finished", 410), ("start", 500), ("train", 510), ("train", 515)]
    recs = [{"run": "r", "event": e, "time": (t0 + dt.timedelta(seconds=s)).isoformat(), "pos": i, "step": i, "tokens": i * 10, "speed": float(i)} for i, (e, s) in enumerate(ev)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(map(json.dumps, recs)) + '\n{"run": "r", "ev')
    stream = S.log_stream(spark, str(src))
    batch = spark.read.schema(f"{S.EVENT}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(str(src)).withColumn("ts", F.try_to_timestamp("time"))
    q = S.minute_buckets(stream).writeStream.format("memory").queryName("minutes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("minutes"), "minute") == rows(S.minute_buckets(batch), "minute")
    q = S.segments_stream(stream).writeStream.format("memory").queryName("segs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = telemetry.segments(batch.filter("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("double")))
    assert rows(spark.table("segs").select("pos", "session", "segment"), "pos") == rows(want.select("pos", "session", "segment"), "pos")
    assert S.incomplete_lines(batch.cache()) == 1


def test_bpe_pieces_equal_the_library():
    """Cuts at spaces, line ends and after letters never change ids, whatever the white space, scripts and special tokens."""
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from corpusloom.functions import bpe
    from corpusloom.functions.tokens import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    r = np.random.default_rng(1)
    letters = [*"ab1.'s&%,", "\n", "\t", "é", "“", "<|endoftext|>", "中", "\u0085", " ", "　", "×", "ß", "º", "\x1c", "😀", " ", " ", " "]
    texts = [None, "", " ", "\n", "isn't we'll 's a1b2,c&&d", *("".join(r.choice(letters, r.integers(0, 40))) for _ in range(800)), "long " * 50_000]
    def check(path, tok, texts):
        got = []
        for i, j, ids, counts in bpe.encode_array(pa.array(texts, pa.string()), path):
            assert len(counts) == j - i
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]

    check(default_tokenizer(), tok, texts)
    import public_tokenizers

    other = public_tokenizers.path("word_bpe_49k.json")  # lower case, white space dropped: texts are encoded whole
    check(other, Tokenizer.from_file(other), texts[:200])


def test_sqlite_bounds(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "t.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"x{i}") for i in range(5)])
    con.commit()
    con.close()
    assert rows(readers.sqlite_table(spark, path, "SELECT * FROM t"), "a") == [(i, f"x{i}") for i in range(5)]
    with pytest.raises(ValueError):
        readers.sqlite_table(spark, path, "SELECT * FROM t", limit=4)
    with pytest.raises(Exception, match="interrupted"):
        readers.sqlite_table(spark, path, "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT max(n) FROM r", seconds=0.2)


def test_sampled_rows_equal_plain_draws(spark):
    """Rows drawn with replacement, against the rule record by record."""
    from hashlib import sha256

    recs = [("a", i, list(range(1 + i * 37 % 300)), 1) for i in range(50)] + [("b", i, [1] * 1000, 3) for i in range(3)] + [("a", 99, [0] * 2000, 0)]
    got = {(r.source, r.row): r for r in splits.pack(spark.createDataFrame(recs, "source string, ord long, ids array<int>, answer_start int"), rows=7).collect()}
    for source, own in (("a", [r for r in recs if r[0] == "a" and len(r[2]) <= 1025]), ("b", [r for r in recs if r[0] == "b"])):
        for number in range(7):
            held, size = [], 0
            for draw in range(splits.DRAWS):
                r = own[int(sha256(f"pack-1:{source}:{number}:{draw}".encode()).hexdigest()[:12], 16) % len(own)]
                if size + len(r[2]) > 1025:
                    break
                held.append(r[1])
                size += len(r[2])
            g = got[source, number]
            assert (g.records, g.used, len(g.ids), sum(g.real_mask)) == (held, size, 1025, size)
    with pytest.raises(ValueError):
        splits.pack(spark.createDataFrame([("c", 1, [0] * 2000, 0)], "source string, ord long, ids array<int>, answer_start int"), rows=1)
