"""Operator 6: near-duplicate vectors by a pivot-permutation index.

Vectors of one label are linked if their cosine (double precision) is at least LEAST. A vector is described by the
PREFIX nearest of the reference points (one more for each doubling of their least number), in order; it is posted in the
inverted list of each of them, and two vectors are compared if they share at least SHARED of these pivots. A list of more
than LIST vectors is replaced by the lists of two pivots (and those by three) where that at least halves the pairs: a
pair shares SHARED pivots, so it meets in a longer key as well. A pair is looked at in the list of its first shared
pivots only, so no link counts twice. Lists are cut into blocks of at most BLOCK vectors; a task gets two blocks, counts
shared pivots and takes the cosines by matrix products, and returns one row for each vector: its number of links there
and the smallest class it reaches inside the task. Pairs are never rows.

Reference points: a greedy choice from at most SAMPLE vectors (by hash of the vector), each less similar than APART to
the ones before, so that a dense group takes few of them; their number grows with the vectors, as one for PER_PIVOT
vectors between LEAST_PIVOTS and MOST_PIVOTS. Every vector is indexed. Equal vectors of a label are one class whose
members link to each other; classes are numbered as they are written. Recall against brute force is measured in the
tests (at least 0.99 there).

Defined cases: null label, null vector, all zeros, null or non-finite components link with nothing; vectors are scaled by
their largest component before the norm, so none is too long or too short; vectors of different lengths are compared as
with zeros at the end; rows that repeat a vec_id are vectors of their own, with their own links and component; null vec_id
keeps its row with no links; pivots equally near are taken in their order; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, drop_path, materialize, small_side, table
from .components import components

LEAST = 0.93
PREFIX, SHARED = 8, 3
SAMPLE, APART = 4096, 0.7
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 128, 64, 2048
BLOCK = 1024
#: Vectors of a list beyond which it is replaced by lists of one more pivot, if that halves the pairs.
LIST = 8192
#: Lists up to which their lengths are broadcast (32 bytes each); else they meet their vectors in a shuffled join.
BROADCAST_LISTS = 500_000


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Rows of unit vectors, each less similar than APART to the chosen ones; the bound loosens if too few are left."""
    chosen = vectors[:0]
    for apart in (APART, 0.85, 0.95, 1.1):
        for v in vectors:
            if len(chosen) < count and (not len(chosen) or (chosen @ v).max() < apart):
                chosen = np.vstack([chosen, v])
    return chosen


def prefix_of(count: int) -> int:
    """Pivots that describe a vector, of count: among more, two near vectors share fewer of their nearest ones."""
    return min(PREFIX + int(np.ceil(np.log2(max(count / LEAST_PIVOTS, 1)))), count)


def _unit(rows: list, width: int) -> np.ndarray:
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _block(x: pd.DataFrame, y: pd.DataFrame, key: list[int], width: int, least: float, same: bool) -> pd.DataFrame:
    """Links between the rows of x and y whose first shared pivots are this list's."""

    def side(d):
        bits = np.zeros((len(d), width), np.float32)
        p = np.frombuffer(b"".join(d["prefix"]), np.int32).reshape(len(d), -1)
        np.put_along_axis(bits, p, 1, 1)
        return bits, np.frombuffer(b"".join(d["unit"]), np.float64).reshape(len(d), -1)

    (bx, ux), (by, uy) = side(x), side(y)
    upto = key[-1] + 1
    fits = (bx @ by.T >= min(SHARED, width)) & (bx[:, :upto] @ by[:, :upto].T == len(key))
    link = fits & (ux @ uy.T >= least)
    if same:
        np.fill_diagonal(link, False)
    n_x, n_y = link @ y["m"].to_numpy(), link.T @ x["m"].to_numpy()
    ids = np.concatenate([x["cid"].to_numpy(), y["cid"].to_numpy()])
    label, k = ids.copy(), len(x)
    rows, cols = np.nonzero(link)
    while len(rows):
        new = label.copy()
        np.minimum.at(new, rows, label[k + cols])
        np.minimum.at(new, k + cols, new[rows])
        if same:
            new[:k] = new[k:] = np.minimum(new[:k], new[k:])
        if (new == label).all():
            break
        label = new
    out = pd.DataFrame({"cid": ids, "links": np.concatenate([n_x, n_y * (not same)]).astype(np.int64), "reach": label})
    return out[(out["links"] > 0) | (out["reach"] != out["cid"])]


def _lists(posted: DataFrame, most: int, longest: int, scratch: Scratch) -> DataFrame:
    """Rows of posted with the key (pivots in order of their numbers) and length of each list that they are in."""
    rows = posted.withColumn("key", F.explode(F.transform("pivots", lambda p: F.array(p))))
    done = []
    for depth in range(1, most + 1):
        sizes = scratch(rows.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "pv-sizes")
        rows = rows.join(small_side(sizes, BROADCAST_LISTS), ["label", "key"])
        if depth == most or sizes.filter(F.col("n") > longest).isEmpty():
            done.append(rows)
            break
        longer = rows.filter(F.col("n") > longest)
        longer = longer.drop("n").withColumn("key", F.explode(F.transform(F.filter("pivots", lambda q: q > F.element_at("key", -1)), lambda q: F.concat("key", F.array(q)))))
        inner = longer.groupBy("label", "key").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("label", F.slice("key", 1, depth).alias("key")).agg(F.sum(F.col("k") * F.col("k")).alias("pairs"))
        split = scratch(sizes.join(inner, ["label", "key"]).filter(F.col("pairs") * 2 <= F.col("n").cast("double") * F.col("n")).select("label", "key"), "pv-split")
        done.append(rows.join(small_side(split, BROADCAST_LISTS), ["label", "key"], "left_anti"))
        on = [F.col("label"), F.slice("key", 1, depth)]
        split = split.select(F.col("label").alias("l"), F.col("key").alias("parent"))
        rows = longer.join(small_side(split, BROADCAST_LISTS), (on[0] == F.col("l")) & (on[1] == F.col("parent")), "left_semi")
    return reduce(DataFrame.unionByName, done)


def near_vectors(vectors: DataFrame, least: float = LEAST, key: str = "vec_id", column: str = "embedding", label: str = "label", longest: int = LIST, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    scratch = Scratch()
    v = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("x"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.coalesce(~F.exists("x", bad), F.lit(False)) & F.coalesce(F.exists("x", lambda e: e != 0), F.lit(False))
    v = scratch(v.withColumn("sound", F.coalesce(sound, F.lit(False))), "pv-vectors")
    # numbered once and read from a table from then on
    classes = v.filter("sound").groupBy("label", "x").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("m"))
    classes = scratch(classes.withColumn("cid", F.monotonically_increasing_id()), "pv-classes")
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return v.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.select("x").orderBy(F.xxhash64("x"), "label", "x").limit(SAMPLE).collect()
    pivots = choose_pivots(_unit([r["x"] for r in sample], width), int(np.clip(2 ** np.ceil(np.log2(n / PER_PIVOT)), LEAST_PIVOTS, most_pivots)))
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    count, prefix = len(pivots), prefix_of(len(pivots))

    def post(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                some = b.slice(i, 1024)
                u = _unit(some.column(1).to_pylist(), width)
                near = np.argsort(-(u @ shared.value.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), pa.array([r.tobytes() for r in u], pa.binary()), pa.array([r.tobytes() for r in near], pa.binary()), pa.array(list(near), pa.list_(pa.int32()))], ["label", "cid", "m", "unit", "prefix", "pivots"])

    kind = classes.schema["label"].dataType.simpleString()
    posted = scratch(classes.select("label", "x", "cid", "m").mapInArrow(post, f"label {kind}, cid bigint, m bigint, unit binary, prefix binary, pivots array<int>"), "pv-posted")
    # lists are made of numbers alone; vectors and prefixes are met by the rows of block tasks that are left
    placed = _lists(posted.select("label", "cid", "pivots"), min(SHARED, count), longest, scratch).drop("pivots").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # block pairs (i, j), i <= j: a vector of block b is in (b, j) and (i, b)
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "list": F.array_join("key", ",")}).select("label", "list", "i", "j", "own", "cid")
    tasks = tasks.join(posted.select("cid", "m", "unit", "prefix"), "cid")

    def run(key_, d: pd.DataFrame) -> pd.DataFrame:
        _, list_, i, j = key_
        d = d.sort_values("cid")
        x, y = d[d["own"] == i], d[d["own"] == j]
        return _block(x, y, [int(p) for p in list_.split(",")], count, least, i == j) if len(x) and len(y) else pd.DataFrame({"cid": [], "links": [], "reach": []}).astype("int64")

    hits = scratch(tasks.groupBy("label", "list", "i", "j").applyInPandas(run, "cid bigint, links bigint, reach bigint"), "pv-links")
    links = hits.groupBy("cid").agg(F.sum("links").alias("links"))
    label_of = components(hits.filter("reach <> cid").select(F.col("cid").alias("a"), F.col("reach").alias("b")))
    known = classes.join(links, "cid", "left").join(label_of.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = scratch(known.select("label", "x", "least_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "pv-known")
    names = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.join(names, "component").select("label", "x", "n_links", "component_id")
    some = v.filter("sound").join(known, ["label", "x"]).select("vec_id", "n_links", "component_id")
    none = v.filter("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = materialize(some.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "pv-result")
    scratch.drop()
    drop_path(label_of)
    return result


def op6_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Brute force over pairs; the index reaches every pair that these tables hold.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_sum(list_transform(embedding, lambda e: abs(e))) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id WHERE r.c < p.b),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN k ON k.id = vec_id
"""
