"""Operator 8: near-duplicate documents by an inverted join of signature coordinates.

1. Every document becomes its set of distinct word shingles (64-bit hashes) and a signature of COORDS minima. Documents
   with equal sets form one class, named by its smallest doc_id; only classes go on.
2. A class is posted under each (coordinate, value) pair. A pair of classes as similar as the threshold agrees in at
   least needed() coordinates but for a chance of at most MISS, and then shares one of its COORDS - needed() + 1
   rarest postings (prefix filter over the order by global frequency). Postings of one class and those past the prefix
   are skipped, so a passage that many documents share is not compared unless it makes up most of a signature.
3. Posting lists are merged by skips, never into all pairs. Every class is first compared to one pivot of its lists; where
   much is left, classes outside their list's largest component (its head) are compared, twice, to a few members of the
   head; agreements (of the low bytes, which travel with the postings) are counted, pairs below needed() dropped, the rest
   confirmed on full sets. What is still outside a head then is compared to the members of its lists (or, where that is
   less work, to all of the head's component) and to the others outside it: small cases as rows, larger ones in tiles of
   CHUNK outsiders and BLOCK members, marks first and then the sets of what agrees, with one row for each outsider and
   component found. Two classes of one list lie in one component, or one of them is outside the list's head, so no pair
   that could link two components is left out.
4. Components over confirmed links.

Defined cases: null or empty text has no set and links with nothing; fewer words than a shingle make one shingle of the
whole sequence; rows that repeat a doc_id are one document with several texts; null doc_id keeps its row with null
component; extra columns are ignored; an empty table gives an empty table; long texts are hashed in pieces.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, drop_path, materialize, small_side, table
from .components import components

COORDS = 32
#: Largest chance that the signature misses a pair at the threshold.
MISS = 1e-6
#: Rows of at most 64 bytes (ids, pairs, components) up to which a side of a join is broadcast; else it is shuffled.
BROADCAST_ROWS = 200_000
#: Comparisons between outsiders and their lists' heads up to which the sampled rounds, which only spare work, are left out.
FEW = 20_000_000
PIECE = 1 << 20
#: Outsiders and members whose sets meet in one task; marks meet by WIDE times as many of both.
CHUNK, BLOCK, WIDE = 64, 1024, 4

_R = np.random.default_rng(20240229)
_BYTE = _R.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _R.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _R.integers(1, 1 << 63, COORDS, dtype=np.uint64)
_MUL = _R.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each word of bytes, ASCII letters lowered."""
    low = _LOWER[flat]
    word = ~_SPACE[low]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(flat) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[low] * up[: len(low)])])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _shingle(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words."""
    n = len(words) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _MIX[j] if n > 0 else out
    return mix64(out)


def shingle_sets(raws: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    i = 0
    while i < len(raws):
        if len(raws[i]) > PIECE:
            yield _distinct(_long_words(raws[i]), k)
            i += 1
            continue
        j, held = i, 0
        while j < len(raws) and (j == i or held + len(raws[j]) <= PIECE) and len(raws[j]) <= PIECE:
            held += len(raws[j]) + 1
            j += 1
        words, starts = word_hashes(np.frombuffer(b" ".join(raws[i:j]), np.uint8)) if held > 1 else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cut = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws[i:j])]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield _distinct(words[a:b], k)
        i = j


def _distinct(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(_shingle(words, min(k, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _long_words(raw: bytes) -> np.ndarray:
    """Word hashes of a long text, cut at white space."""
    out, at = [], 0
    while at < len(raw):
        to = at + PIECE
        if to < len(raw):
            flat = np.frombuffer(raw, np.uint8, min(len(raw) - to, PIECE), to)
            gaps = np.flatnonzero(_SPACE[flat])
            while not len(gaps) and to + PIECE < len(raw):
                to += PIECE
                gaps = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, min(len(raw) - to, PIECE), to)])
            to = to + int(gaps[0]) if len(gaps) else len(raw)
        out.append(word_hashes(np.frombuffer(raw[at:to], np.uint8))[0])
        at = to
    return np.concatenate(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDS minima of hashes under fixed mixings, 32 bits each."""
    best = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 15):
        best = np.minimum(best, ((hashes[i : i + (1 << 15), None] ^ _XOR) * _MUL).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def needed(percent: int) -> int:
    """Coordinates in which a pair at the threshold agrees but for a chance of at most MISS (binomial tail)."""
    p, below = percent / 100, 0.0
    for m in range(COORDS + 1):
        below += math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)
        if below > MISS:
            return max(1, m)
    return COORDS


def _raw(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig, mark) of every row; mark: the low byte of each coordinate."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                n, digest, sig = [], [], []
                for s in shingle_sets(_raw(some.column(1)), k):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                    sig.append(signature(s) if len(s) else None)
                mark = [x if x is None else x.astype(np.int8) for x in sig]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(sig, pa.list_(pa.int32())), pa.array(mark, pa.list_(pa.int8()))], ["doc_id", "n_shingles", "digest", "sig", "mark"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest string, sig array<int>, mark array<tinyint>")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(rep, set) for the documents of ids."""
    part = docs.join(small_side(ids, BROADCAST_ROWS), docs["doc_id"] == ids["rep"], "left_semi")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in shingle_sets(_raw(some.column(1)), k)], pa.binary())], ["rep", "set"])

    return part.mapInArrow(run, "rep bigint, set binary")


def _agree(x: Column, y: Column, need: int) -> Column:
    """Whether two marks agree in at least `need` places."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e)) >= need


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(close: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; an id may stand in very many pairs as a."""

    def run(batches):
        for b in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    close = scratch(close, "mh-close")
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")).join(small_side(close, BROADCAST_ROWS), "b")
    both = right.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a")
    return scratch(both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"), "mh-links")


def _named(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with the component of rep (itself without a link)."""
    return rows.join(small_side(label, BROADCAST_ROWS), F.col("rep") == F.col("id"), "left").drop("id").withColumn("component", F.coalesce("component", "rep"))


def _heads(named: DataFrame) -> DataFrame:
    """(post, head, size, outside): the largest component of each list that has several, its members there and the others."""
    parts = named.groupBy("post", "component").agg(F.count(F.lit(1)).alias("n"))
    heads = parts.groupBy("post").agg(F.max_by("component", F.struct("n", "component")).alias("head"), F.max("n").alias("size"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"))
    return heads.filter("parts > 1").select("post", "head", "size", (F.col("all") - F.col("size")).alias("outside"))


def _meetings(met: DataFrame, heads: DataFrame, reps: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """(whole, g, rep, mark, component, asks): each row that asks has to be compared to the rows of its g of other components.

    g is a list, and its outsiders ask. Where the lists of one head together are more work than its outsiders with all of
    the head's component (many lists of about the same members), g is the head with that component instead. A row weighs as
    much as the comparisons it is sent for, WIDE * CHUNK.
    """
    work = lambda asks, rows: rows * (asks.cast("double") + WIDE * CHUNK)
    outside = scratch(met.filter("component <> head").select("head", "rep", "mark", "component").distinct(), "mh-outside")
    own = _named(reps, label).join(small_side(heads.select(F.col("head").alias("component")).distinct(), BROADCAST_ROWS), "component")
    inside = scratch(own.select(F.col("component").alias("head"), "rep", "mark", "component"), "mh-inside")
    cost = heads.groupBy("head").agg(F.sum(work(F.col("outside"), F.col("size") + F.col("outside"))).alias("lists"))
    cost = cost.join(outside.groupBy("head").agg(F.count(F.lit(1)).alias("o")), "head").join(inside.groupBy("head").agg(F.count(F.lit(1)).alias("i")), "head")
    choice = small_side(scratch(cost.select("head", (F.col("lists") > work(F.col("o"), F.col("i") + F.col("o"))).alias("whole")), "mh-choice"), BROADCAST_ROWS)
    lists = met.join(choice.filter("NOT whole"), "head").select("whole", F.col("post").alias("g"), "rep", "mark", "component", (F.col("component") != F.col("head")).alias("asks"))
    both = outside.withColumn("asks", F.lit(True)).unionByName(inside.withColumn("asks", F.lit(False)))
    return scratch(lists.unionByName(both.join(choice.filter("whole"), "head").select("whole", F.col("head").alias("g"), "rep", "mark", "component", "asks")), "mh-meet")


def _tiles(asks: np.ndarray, tells: np.ndarray, own: np.ndarray, others: np.ndarray, need: int, chunk: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, asking, told) of every tile of chunk by block marks: the places of those that agree with another component's."""
    wide = -(-len(tells) // block)
    for i in range(0, len(asks), chunk):
        some = slice(i, i + chunk)
        hits = np.stack([((tells == m).sum(axis=1) >= need) & (others != c) for m, c in zip(asks[some], own[some], strict=True)])
        for j in range(0, len(tells), block):
            hit = hits[:, j : j + block]
            if hit.any():
                yield i // chunk * wide + j // block, i + np.flatnonzero(hit.any(axis=1)), j + np.flatnonzero(hit.any(axis=0))


def _outsiders(meet: DataFrame, sets: DataFrame, percent: int, need: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the rows that ask with rows of their g of other components, one at least for each component linked.

    Small groups are compared as rows. In larger ones marks alone meet first; only rows whose mark agrees with another's in
    a tile of CHUNK asking and BLOCK told rows send their sets, to that tile.
    """
    by = ["whole", "g"]
    sizes = meet.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.count_if("asks").alias("outsiders"))
    sizes = scratch(sizes.withColumn("many", F.col("members") * F.col("outsiders") > CHUNK), "mh-sizes")
    few = small_side(sizes.filter("NOT many").select(*by), BROADCAST_ROWS)
    x = meet.filter("asks").join(few, by).select(*by, F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("mark").alias("mx"))
    y = meet.join(few, by).select(*by, F.col("rep").alias("y"), F.col("component").alias("cy"), F.col("mark").alias("my"))
    pairs = x.join(y, by).filter((F.col("cx") != F.col("cy")) & _agree(F.col("mx"), F.col("my"), need)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = _confirmed(pairs, sets, percent, scratch)
    plan = sizes.filter("many").select(*by, F.ceil(F.col("outsiders") / (WIDE * CHUNK)).cast("int").alias("chunks"), F.ceil(F.col("members") / (WIDE * BLOCK)).cast("int").alias("blocks"))
    if plan.isEmpty():
        return links
    plan = small_side(plan, BROADCAST_ROWS)
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    planned = meet.join(plan, by)
    asks = planned.filter("asks").select(*by, part("chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "mark", "component", F.lit(True).alias("asks"))
    told = planned.select(*by, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), part("blocks").alias("block"), "rep", "mark", "component", F.lit(False).alias("asks"))

    def agreeing(d: pd.DataFrame) -> pd.DataFrame:
        ask, tell = d[d["asks"]], d[~d["asks"]]
        if not len(ask) or not len(tell):
            return d.iloc[:0].assign(tile=0)
        marks = (np.stack(x["mark"].to_list()) for x in (ask, tell))
        tiles = _tiles(*marks, ask["component"].to_numpy(), tell["component"].to_numpy(), need, CHUNK, BLOCK)
        found = [pd.concat([ask.iloc[a], tell.iloc[t]]).assign(tile=n) for n, a, t in tiles]
        return pd.concat(found) if found else d.iloc[:0].assign(tile=0)

    def confirm(d: pd.DataFrame) -> pd.DataFrame:
        ask, tell = d[d["asks"]], d[~d["asks"]]
        out = []
        a, t = np.stack(ask["mark"].to_list()), np.stack(tell["mark"].to_list())
        ids, comps = tell["rep"].to_numpy(), tell["component"].to_numpy()
        told_sets = [np.frombuffer(s, np.uint64) for s in tell["set"]]
        for rep, comp, mark, raw in zip(ask["rep"], ask["component"], a, ask["set"], strict=True):
            own, found = np.frombuffer(raw, np.uint64), set()
            for k in np.flatnonzero(((t == mark).sum(axis=1) >= need) & (comps != comp)):
                if comps[k] not in found and _alike(own, told_sets[k], percent):
                    found.add(comps[k])
                    out.append((rep, ids[k]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    kinds = "whole boolean, g bigint, chunk int, block int, rep bigint, mark array<tinyint>, component bigint, asks boolean, tile int"
    close = scratch(asks.unionByName(told).groupBy(*by, "chunk", "block").applyInPandas(agreeing, kinds), "mh-tiles")
    more = close.join(sets, "rep").groupBy(*by, "chunk", "block", "tile").applyInPandas(confirm, "a bigint, b bigint")
    return links.unionByName(scratch(more, "mh-links"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", few: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    need, scratch = needed(percent), Scratch()
    rows = scratch(signed(docs, k), "mh-signed")
    sound = rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch(sound.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("mark").alias("mark")), "mh-classes")
    # postings, the rarest of each class, and lists with more than one class; counts are tables of their own, so that a
    # join with a very long list is a join of two exchanges, which adaptive execution can split
    posts = classes.select("rep", "mark", F.posexplode("sig").alias("c", "v")).select("rep", "mark", (F.shiftleft(F.col("c").cast("bigint"), 32) + F.col("v").cast("bigint") + F.lit(1 << 31)).alias("post"))
    often = scratch(posts.groupBy("post").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "mh-often")
    shared = posts.join(often, "post").groupBy("rep", "mark").agg(F.sort_array(F.collect_list(F.struct("n", "post"))).alias("l"))
    prefix = F.slice("l", F.lit(1), F.greatest(F.lit(0), F.lit(COORDS - need + 1) - (F.lit(COORDS) - F.size("l"))))
    lists = scratch(shared.select("rep", "mark", F.explode(prefix).alias("p")).select("rep", "mark", F.col("p.post").alias("post")), "mh-lists")
    stars = lists.groupBy("post").agg(F.min_by(F.struct(F.col("rep").alias("pivot"), F.col("mark").alias("own")), "rep").alias("star"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = scratch(stars.select("post", "star.*"), "mh-stars")
    near = F.when(F.col("rep") != F.col("pivot"), _agree(F.col("mark"), F.col("own"), need)).otherwise(False)
    live = scratch(lists.join(stars, "post").select("post", "rep", "mark", "pivot", near.alias("near")), "mh-live")
    reps = scratch(live.select("rep", "mark").distinct(), "mh-reps")
    sets = scratch(_sets(docs, reps.select("rep"), k), "mh-sets")
    links = _confirmed(live.filter("near").groupBy(F.col("rep").alias("b")).agg(F.min("pivot").alias("a")), sets, percent, scratch)
    label = components(links)
    live = live.select("post", "rep", "mark")

    def parted():
        """The lists' members by component, and the lists with several, where the components are those of label."""
        named = _named(live, label)
        heads = scratch(_heads(named), "mh-heads")
        return named.join(small_side(heads, BROADCAST_ROWS), "post"), heads

    met, heads = parted()
    for sampled in (2, 4):
        if (heads.agg(F.sum(F.col("size") * F.col("outside"))).first()[0] or 0) <= (FEW if few is None else few):
            break
        out = met.filter("component <> head").select("post", F.col("rep").alias("b"), F.col("mark").alias("mb"))
        some = met.filter((F.col("component") == F.col("head")) & (F.pmod(F.xxhash64("rep", F.lit(sampled)), F.col("size")) < sampled)).select("post", F.col("rep").alias("a"), F.col("mark").alias("ma"))
        pairs = out.join(some, "post").filter(_agree(F.col("ma"), F.col("mb"), need)).select("a", "b").distinct()
        links = links.unionByName(_confirmed(pairs, sets, percent, scratch))
        drop_path(label)
        label = components(links)
        met, heads = parted()
    if not heads.isEmpty():
        links = links.unionByName(_outsiders(_meetings(met, heads, reps, label, scratch), sets, percent, need, scratch))
        drop_path(label)
        label = components(links)
    named = _named(classes.select("digest", "rep"), label).select("digest", F.col("component").alias("component_id"))
    some = sound.join(named, "digest").select("doc_id", "n_shingles", "component_id")
    none = rows.filter("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = materialize(some.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "mh-result")
    scratch.drop()
    drop_path(label)
    return result


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


#: Brute force over all pairs that share a shingle; the signature misses a pair with a chance of MISS at most.
SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
p AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id WHERE r.c < p.b),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN k ON id = doc_id
"""
