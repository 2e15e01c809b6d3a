"""Duplicate, overlap and conflict handling over records with an explicit order column `ord`."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corpusloom.operators.graph import connected_groups
from corpusloom.storage import drop_path, materialize, small_side


def first_owner(df: DataFrame, prompt_key: str = "key") -> DataFrame:
    """Keep rows whose (source, original_id) is that of the key's first row; variants of one task stay.

    The owner is an aggregation joined back, not a window: a very common key is pre-aggregated and its join is split.
    """
    owner = df.groupBy(prompt_key).agg(F.min_by(F.struct("source", "original_id"), "ord").alias("owner"))
    return df.join(owner, prompt_key).filter(F.col("owner") == F.struct("source", "original_id")).drop("owner")


def first_row(df: DataFrame, prompt_key: str = "key", bad_groups: DataFrame | None = None) -> DataFrame:
    """Keep each key's first row among rows whose group is not bad (those do not claim a key)."""
    if bad_groups is not None:
        df = df.join(bad_groups.select("group").distinct(), "group", "left_anti")
    least = df.groupBy(prompt_key).agg(F.min("ord").alias("least"))
    return df.join(least, prompt_key).filter("ord = least").drop("least")


def first_row_against(base: DataFrame, new: DataFrame, prompt_key: str = "key") -> DataFrame:
    """New rows less the groups that touch a base key (even in rows that are duplicates), then first rows."""
    bad = new.join(base.select(prompt_key).distinct(), prompt_key, "left_semi").select("group")
    return first_row(new, prompt_key, bad)


def conflicting_groups(df: DataFrame, prompt_key: str, answer: Column) -> DataFrame:
    """Groups with one prompt and more than one normal answer."""
    conflict = df.groupBy(prompt_key).agg(F.min(answer).alias("a"), F.max(answer).alias("b")).filter("a <> b")
    return df.join(conflict, prompt_key, "left_semi").select("group").distinct()


def quarantine(df: DataFrame, exclusions: DataFrame) -> DataFrame:
    """P5: drop whole groups of which any row is on the exclusion list (source, original_id)."""
    bad = df.join(exclusions.select("source", "original_id").distinct(), ["source", "original_id"], "left_semi").select("group").distinct()
    return df.join(bad, "group", "left_anti")


def overlapping_groups(candidates: DataFrame, parent: DataFrame) -> DataFrame:
    """Groups of candidates (group, keys) that share any key with the parent (key)."""
    exploded = candidates.select("group", F.explode("keys").alias("key"))
    return exploded.join(parent.select("key").distinct(), "key", "left_semi").select("group").distinct()


def without_duplicates_of(df: DataFrame, corpus: DataFrame, prompt_key: str = "key") -> DataFrame:
    """Rows whose key is not in a corpus."""
    return df.join(corpus.select(prompt_key).distinct(), prompt_key, "left_anti")


def code_overlap(df: DataFrame, drop: str = "dev") -> DataFrame:
    """Drop whole groups of one split that share a program key with the other split."""
    other = "train" if drop == "dev" else "dev"
    keyed = df.filter(F.col("code_key").isNotNull())
    bad = keyed.filter(F.col("split") == drop).join(keyed.filter(F.col("split") == other).select("code_key").distinct(), "code_key", "left_semi").select("group").distinct()
    return df.join(bad.withColumn("split", F.lit(drop)), ["group", "split"], "left_anti") if drop == "dev" else df.join(bad, "group", "left_anti")


#: Cells of the first mark of a set, and set sizes above which a second mark, of at least one cell a key, goes with it.
FIRST_CELLS, FIRST_KEYS = 256, 256
#: Rows up to which the ids of rows whose sets are asked for, or common keys, are broadcast.
ASKED_ROWS = 200_000
#: Rows of a tile's left side that are compared at once.
ROWS = 16
#: Postings of a key up to which they meet in a join; those of commoner keys meet by tiles of at most TILE rows a side.
COMMON, TILE = 256, 4096


def _parities(flat: np.ndarray, cells: int) -> bytes:
    """Which cells (keys modulo a power of two) hold an odd number of keys, as bits."""
    return np.packbits(np.bincount((flat & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def _mark(flat: np.ndarray) -> np.ndarray:
    """Marks of a set of keys: words of the first, then, of a larger set, those of the second."""
    bits = _parities(flat, FIRST_CELLS)
    if len(flat) > FIRST_KEYS:
        bits += _parities(flat, 1 << (len(flat) - 1).bit_length())
    return np.frombuffer(bits, np.int64)


def _told(batches: Iterator[pa.RecordBatch], bottom: int, keys: Callable[[bytes], bytes] | None) -> Iterator[pa.RecordBatch]:
    """Rows (ord, s), s as keys() makes it, with sets that are not empty: their class (digest of the set), size, least keys and marks."""
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            b = whole.slice(i, 256)
            sets = b.column("s").to_pylist()
            sets = [keys(s) for s in sets] if keys else [s or b"" for s in sets]
            ords = b.column("ord").filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))
            sets = [s for s in sets if s]
            marks = [_mark(np.frombuffer(s, ">u8").astype(np.uint64)) for s in sets]
            ends = np.cumsum([0, *map(len, marks)]).astype(np.int32)
            m = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *marks])))
            columns = [ords, pa.array([sha256(s).digest() for s in sets], pa.binary()), pa.array([len(s) // 8 for s in sets], pa.int32()), pa.array([s[: 8 * bottom] for s in sets], pa.binary()), m, pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["ord", "class", "n", "low", "m", "s"])


def _in_both(x: pd.Series, y: pd.Series) -> pd.Series:
    """Keys that two sets of distinct 8-byte keys share."""
    keys = lambda s: np.frombuffer(s, np.uint64)
    return pd.Series([len(np.intersect1d(keys(a), keys(b), assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype="int64")


def _apart(x: Column, y: Column) -> Column:
    """Cells in which the second marks of two sets differ; the finer one is folded, as sizes in reach differ by one power of two."""
    first = FIRST_CELLS // 64
    low, high = F.least(F.size(x), F.size(y)) - first, F.greatest(F.size(x), F.size(y)) - first
    word = lambda m, i: F.get(m, i + first).bitwiseXOR(F.when(F.size(m) - first > low, F.get(m, i + first + low)).otherwise(F.lit(0).cast("bigint")))
    differ = F.aggregate(F.sequence(F.lit(0), low - 1), F.lit(0), lambda n, i: n + F.bit_count(word(x, i).bitwiseXOR(word(y, i))))
    return F.when((low > 0) & (high <= 2 * low), differ).otherwise(0)


def _met_in_join(posts: DataFrame, least: float) -> DataFrame:
    """(a, b) of postings (k, c, n, i, m) of one key whose sizes, places and marks are in reach."""
    word = [F.get("m", F.lit(i)).alias(f"m{i}") for i in range(FIRST_CELLS // 64)]
    more = F.when(F.size("m") > FIRST_CELLS // 64, F.col("m")).alias("m")
    posts = posts.select("k", "c", "n", "i", *word, more)
    x, y = posts.alias("x"), posts.alias("y")
    reach = (F.col("x.n") + F.col("y.n")) * ((1 - least) / (1 + least) * 1.001)  # a little wider against rounding
    differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"x.m{i}").bitwiseXOR(F.col(f"y.m{i}"))) for i in range(FIRST_CELLS // 64)])
    fits = (F.col("x.c") < F.col("y.c")) & (F.least("x.n", "y.n") >= least * 0.999 * F.greatest("x.n", "y.n")) & (F.col("x.i") + F.col("y.i") <= reach) & (differ <= reach)
    larger = F.when(F.col("x.m").isNotNull() & F.col("y.m").isNotNull(), _apart(F.col("x.m"), F.col("y.m")) <= reach).otherwise(True)
    return x.join(y, (F.col("x.k") == F.col("y.k")) & fits & larger).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


def _met_in_tiles(posts: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """_met_in_join() for common keys (with their number of `rows`), whose pairs are shared out; and the tables it reads.

    Postings of more than a tile are dealt by sizes, so that sizes in reach are of one band or two adjacent ones, and by
    blocks within a band; a tile has one block a side, and every pair in reach meets in one tile of its key.
    """
    posts = posts.withColumn("band", F.when(F.col("rows") > TILE, F.floor(F.log("n") / -math.log(least * 0.999)).cast("int")).otherwise(0))
    blocks = materialize(posts.groupBy("k", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks")), "nd-blocks")
    beside = lambda by, name: blocks.select("k", (F.col("band") - by).alias("band"), F.col("blocks").alias(name))
    sizes = materialize(blocks.join(beside(1, "above"), ["k", "band"], "left").join(beside(-1, "below"), ["k", "band"], "left").fillna(0), "nd-sizes")
    posts = posts.join(small_side(sizes, ASKED_ROWS), ["k", "band"]).withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    tile = lambda low, up, p, q, side: F.struct(low.alias("low"), up.alias("up"), p.alias("p"), q.alias("q"), side.alias("side"))
    band, own = F.col("band"), F.col("block")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    tiles = F.concat(
        F.transform(upto("blocks"), lambda q: tile(band, band, F.least(own, q), F.greatest(own, q), (own > q).cast("int"))),
        F.transform(upto("above"), lambda q: tile(band, band + 1, own, q, F.lit(0))),
        F.transform(upto("below"), lambda p: tile(band - 1, band, p, own, F.lit(1))),
    )
    dealt = posts.withColumn("t", F.explode(tiles)).select("k", "t.*", "c", "n", "i", "m")
    kind = dealt.schema["c"].dataType.simpleString()
    found = dealt.groupBy("k", "low", "up", "p", "q").applyInArrow(lambda t: _tile_pairs(t, least), f"a {kind}, b {kind}")
    return found, [blocks, sizes]


def _tile_pairs(t: pa.Table, least: float) -> pa.Table:
    """Pairs (a, b) of a tile, of rows of its two sides or, of one block, of any two, whose sizes, places and marks are in reach."""
    c, n, i, side = (t.column(x).to_numpy() for x in ("c", "n", "i", "side"))
    lists = t.column("m").combine_chunks()
    flat, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
    ends = at - at[0]
    one = all(t.column(x)[0] == t.column(y)[0] for x, y in (("low", "up"), ("p", "q")))
    order = np.lexsort((c, n))
    left, right = (order, order) if one else (order[side[order] == 0], order[side[order] == 1])
    band = np.floor(np.log(n) / -math.log(least * 0.999))
    found = [np.empty((2, 0), np.int64)]
    for v in np.unique(band[left]):  # marks are folded to the coarsest of rows whose sizes are near
        x, y = left[band[left] == v], right[(band[right] >= v - (not one)) & (band[right] <= v + 1)]
        if len(y):
            rows = np.concatenate([x, y])
            marks = _folded(flat, ends[rows], ends[rows + 1])
            found.append(_in_reach(x, y, n, i, marks[: len(x)], marks[len(x) :], one, least))
    p, q = np.concatenate(found, axis=1)
    return pa.table({"a": np.minimum(c[p], c[q]), "b": np.maximum(c[p], c[q])})


def _folded(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first marks if a set has no second one, else second ones, with as few cells: the parity of two cells is that of both."""
    first = FIRST_CELLS // 64
    words = int((ends - starts).min()) - first
    if words <= 0:
        return flat[starts[:, None] + np.arange(first)]
    return np.array([np.bitwise_xor.reduce(flat[a + first : b].reshape(-1, words), axis=0) for a, b in zip(starts, ends, strict=True)])


def _in_reach(left, right, n, i, mx, my, one: bool, least: float) -> np.ndarray:
    """Rows (left, right) in reach, both by size; of one block, `right` begins with `left` and a pair is taken once."""
    width, found = (1 - least) / (1 + least) * 1.001, [np.empty((2, 0), np.int64)]
    ny, iy, my = n[right], i[right], np.ascontiguousarray(my.T)
    for start in range(0, len(left), ROWS):
        x, m = left[start : start + ROWS], mx[start : start + ROWS]
        lo = start if one else np.searchsorted(ny, n[x[0]] * least * 0.999)
        hi = np.searchsorted(ny, n[x[-1]] / (least * 0.999), "right")
        if lo >= hi:
            continue
        reach = (n[x][:, None] + ny[lo:hi]) * width
        fits = i[x][:, None] + iy[lo:hi] <= reach
        if one:
            fits &= np.arange(lo, hi) > np.arange(start, start + len(x))[:, None]
        differ, w = np.zeros(reach.shape, np.int32), 0
        while w < len(my) and (w % 8 or not w or np.count_nonzero(fits) * 16 > fits.size):
            differ += np.bitwise_count(m[:, w, None] ^ my[w, lo:hi])
            w += 1
            if w % 8 == 0 or w == len(my):
                fits &= differ <= reach
        p, q = np.nonzero(fits)
        if w < len(my):  # few are left
            near = differ[p, q] + np.bitwise_count(m[p, w:] ^ my[w:, lo + q].T).sum(axis=1) <= reach[p, q]
            p, q = p[near], q[near]
        found.append(np.stack([x[p], right[lo + q]]))
    return np.concatenate(found, axis=1)


def _candidates(heads: DataFrame, least: float, bottom: int) -> DataFrame:
    """Distinct (a, b) of representatives (c, n, low, m) that share a least key and may reach the similarity."""
    # the least key that two rows share stands behind keys that only one of them has, so their places are in reach as well
    places = F.sequence(F.lit(0), F.least(F.lit(bottom) - 1, F.col("n") - 1, F.floor(F.col("n") * ((1 - least) * 1.001)).cast("int")))
    posts = heads.withColumn("i", F.explode(places)).withColumn("k", F.expr("substring(low, 8 * i + 1, 8)")).drop("low")
    common = materialize(posts.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > COMMON), "nd-common")
    keys = small_side(common, ASKED_ROWS)
    found, read = _met_in_join(posts.join(keys, "k", "left_anti"), least), [common]
    if not common.isEmpty():
        tiles, tables = _met_in_tiles(posts.join(keys, "k"), least)
        found, read = found.unionByName(tiles), read + tables
    out = materialize(found.distinct(), "nd-pairs")
    for t in read:
        drop_path(t)
    return out


def near_duplicate_pairs(df: DataFrame, shingles: str = "shingles", least: float = 0.8, bottom: int = 16, keys: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(a, b, copy): rows that share one of their least shingle keys (distinct, 16 hex digits; or all sorted, 8 bytes each, as they are or made by keys()) and reach the Jaccard similarity.

    Rows with equal key sets are one class, represented by its first row: `copy` rows join the representative to the
    others, the rest are pairs of representatives. A group of copies so gives rows in proportion to its size. The
    blocking by least keys is the result's definition, so no key is dropped. Postings carry marks of the sets: a cell whose
    parity differs holds a key that only one set has, so two sets at the similarity, of n and m keys, differ in at most
    (n + m) * (1 - least) / (1 + least) cells. Keys of many postings meet by tiles, each a group of its own. Others are left out where they meet, and sets, 8 bytes a key, are sent only
    for pairs that stay, which hardly any pair of unlike sets does.
    """
    s = F.col(shingles) if isinstance(df.schema[shingles].dataType, BinaryType) else F.unhex(F.array_join(F.array_sort(shingles), ""))
    d = df.select("ord", s.alias("s"))
    d = materialize(d.mapInArrow(lambda it: _told(it, bottom, keys), f"ord {d.schema['ord'].dataType.simpleString()}, class binary, n int, low binary, m array<bigint>, s binary"), "nd-rows")
    classes = materialize(d.groupBy("class").agg(F.min("ord").alias("c")), "nd-classes")
    heads = d.drop("s").join(classes, (d["class"] == classes["class"]) & (d["ord"] == classes["c"])).select("c", "n", "low", "m")
    heads = materialize(heads, "nd-heads")
    cand = _candidates(heads, least, bottom)
    asked = materialize(cand.select(F.explode(F.array("a", "b")).alias("ord")).distinct(), "nd-asked")
    sets = materialize(d.select("ord", "s").join(small_side(asked, ASKED_ROWS), "ord"), "nd-sets")
    near = cand.join(sets.select(F.col("ord").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("ord").alias("b"), F.col("s").alias("sb")), "b")
    both = F.pandas_udf(_in_both, "bigint")("sa", "sb")
    near = near.select("a", "b", (F.octet_length("sa") + F.octet_length("sb")).alias("all"), both.alias("both"))
    near = near.filter(F.col("both") / (F.col("all") / 8 - F.col("both")) >= least).select("a", "b", F.lit(False).alias("copy"))
    copies = d.select("ord", "class").join(classes.select("class", F.col("c").alias("a")), "class").filter("ord <> a").select("a", F.col("ord").alias("b"), F.lit(True).alias("copy"))
    out = materialize(near.unionByName(copies), "nd-out")
    for t in (d, classes, heads, cand, asked, sets):
        drop_path(t)
    return out


#: Pairs of one component that one task decides by itself: 16 bytes each. Smaller components are decided many at a time.
ONE_TASK_PAIRS = 200_000


def _first_come(key, d: pd.DataFrame) -> pd.DataFrame:
    """Of pairs (a before b) of whole components: their rows, each kept iff none kept stands before it in a pair."""
    before: dict[int, list[int]] = {}
    for a, b in zip(d["a"].tolist(), d["b"].tolist(), strict=True):
        before.setdefault(a, [])
        before.setdefault(b, []).append(a)
    kept: dict[int, bool] = {}
    for x in sorted(before):
        kept[x] = not any(kept[y] for y in before[x])
    return pd.DataFrame({"ord": list(kept), "kept": list(kept.values())}).astype({"ord": "int64", "kept": "bool"})


def _peeled(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are decided at once, and the pairs of the others: rows without an undecided one before them are kept, those behind
    them rejected, and rows whose pairs all go with these have no kept one before them."""
    free = near.select("a").distinct().join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    free = materialize(free.select(F.col("a").alias("ord")), "gk-free")
    gone = materialize(near.join(free, near["a"] == free["ord"], "left_semi").select(F.col("b").alias("ord")).distinct(), "gk-gone")
    out = free.unionByName(gone)
    left = near.join(out, near["a"] == out["ord"], "left_anti").join(out, F.col("b") == out["ord"], "left_anti").select("a", "b")
    left = materialize(left, "gk-near")
    ends = lambda t: t.select(F.explode(F.array("a", "b")).alias("ord")).distinct()
    alone = ends(near).join(out, "ord", "left_anti").join(ends(left), "ord", "left_anti")
    decided = free.unionByName(alone).withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))
    decided = materialize(decided, "gk-decided")
    drop_path(free)
    drop_path(gone)
    return decided, left


def greedy_keep(ids: DataFrame, pairs: DataFrame, one_task: int = ONE_TASK_PAIRS) -> DataFrame:
    """J12 greedy: keep i iff no kept j before it pairs with it, over the pairs of representatives.

    A copy is never kept: its representative comes first, and what rejects that rejects the copy. More pairs than `one_task`
    are first peeled, which dense groups shrink by, as long as a quarter of the pairs leaves. The rest is decided by connected
    components: one of at most `one_task` pairs in one task, as a chain needs one decision after the other, and many small
    ones in one call. Larger ones are peeled on and fall apart. Tables of a round are dropped after it.
    """
    pairs = materialize(pairs, "gk-pairs")
    near = materialize(pairs.filter("NOT copy").select("a", "b").distinct(), "gk-near")
    copies = pairs.filter("copy").select(F.col("b").alias("ord")).distinct()
    decided: list[DataFrame] = []
    n = near.count()
    while n:
        before = math.inf
        while n > one_task and n <= before * 3 / 4:
            some, left = _peeled(near)
            decided.append(some)
            drop_path(near)
            near, before, n = left, n, left.count()
        if not n:
            break
        first = F.col("a").cast("string").alias("key")  # a row and all that it stands before share a key
        ends = near.select(F.col("b").alias("ord"), first).unionByName(near.select(F.col("a").alias("ord"), first).distinct())
        named = materialize(connected_groups(ends).select(F.col("ord").alias("a"), "component"), "gk-components")
        own = materialize(near.join(named, "a"), "gk-own")
        size = own.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        small = own.join(size.filter(F.col("n") <= one_task).select("component"), "component", "left_semi")
        bucket = F.pmod(F.xxhash64("component"), F.lit(math.ceil(n * 8 / one_task))).alias("bucket")
        decided.append(materialize(small.groupBy(bucket).applyInPandas(_first_come, "ord bigint, kept boolean"), "gk-decided"))
        large = materialize(own.join(size.filter(F.col("n") > one_task).select("component"), "component", "left_semi").select("a", "b"), "gk-near")
        for t in (near, named, own):
            drop_path(t)
        near, n = large, large.count()
    rejected = copies
    for d in decided:
        rejected = rejected.unionByName(d.filter("NOT kept").select("ord"))
    result = materialize(ids.select("ord").join(rejected, "ord", "left_anti"), "gk-kept")
    for t in (pairs, near, *decided):
        drop_path(t)
    return result
