"""Splits, suites, weights, offsets, packing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.storage import drop_path, materialize, small_side

#: Sources up to which what a round asks of them is broadcast.
BROADCAST_SOURCES = 200_000
#: Context length of packed sequences and of records.
CONTEXT = 1024


def alternate(dev: DataFrame, rank: Column) -> DataFrame:
    """(group, split): groups of each source in hash order go to dev and confirmation by turns.

    A group of several sources takes the turn of its alphabetically first source, but uses a turn in each.
    """
    g = dev.select("source", "group").distinct().withColumn("rank", rank)
    i = F.row_number().over(Window.partitionBy("source").orderBy("rank", "group"))
    turns = g.withColumn("turn", F.when(i % 2 == 1, "dev").otherwise("confirmation"))
    return turns.groupBy("group").agg(F.min_by("turn", "source").alias("split"))


def suite(df: DataFrame, strata: list[str], rank: Column, size: int, ties: list) -> DataFrame:
    """Of each stratum the first `size` groups in rank order, each by its first row, with `pos` from 1."""
    d = df.withColumn("rank", rank)
    first = Window.partitionBy(*strata, "group").orderBy("rank", *ties)
    d = d.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    pos = F.row_number().over(Window.partitionBy(*strata).orderBy("rank", *ties))
    return d.withColumn("pos", pos).filter(F.col("pos") <= size)


def shortest_first(df: DataFrame, heap: int = 24, take: int = 4) -> DataFrame:
    """Per source, the `heap` cheapest train groups by prompt + 3 * answer length, then `take` of them; ties by id."""
    fits = (F.length("answer") <= 350) & (F.length("prompt") <= 2400) & (F.col("variant") == 0)
    d = df.filter(fits).withColumn("cost", F.length("prompt") + 3 * F.length("answer"))
    return suite(d, ["source"], F.col("cost"), heap, ["original_id"]).filter(F.col("pos") <= take)


def dev_controls(df: DataFrame, heap: int = 24, take: int = 6) -> DataFrame:
    """Per source, the `heap` dev groups that come first by the number in their digest, then `take` of them."""
    rank = F.conv(F.substring(T.digest("group"), 1, 12), 16, 10).cast("bigint")
    return suite(df.filter("variant = 0"), ["source"], rank, heap, ["original_id"]).filter(F.col("pos") <= take)


def first_samples(df: DataFrame, n: int = 2) -> DataFrame:
    """The first n rows of each source in the order of ord."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("source").orderBy("ord"))).filter(F.col("pos") <= n)


def shuffled(df: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    """O3: the rows in the order of a hash of a seed and their keys; a global sort by ranges."""
    return df.withColumn("rank", F.sha2(F.concat_ws("\u0001", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256)).orderBy("rank", *keys)


def sorted_tasks(df: DataFrame) -> DataFrame:
    """O1: tasks by source, then by their id as a number (ids that are none first)."""
    return df.orderBy("source", F.col("id").try_cast("bigint"), "id")


def sampling_weights(sources: DataFrame, mode: str = "families") -> DataFrame:
    """Weights of (source, family): equal over families, then over the family's sources; or equal over sources.

    A source without family is an error when the weights are read.
    """
    known = F.when(F.col("family").isNull(), F.raise_error(F.concat(F.lit("unmapped source: "), F.col("source"))).cast("string")).otherwise(F.col("family"))
    sources = sources.withColumn("family", known)
    everything = Window.partitionBy(F.lit(1))  # one row a source
    if mode == "sources":
        return sources.select("source", "family", (1.0 / F.count(F.lit(1)).over(everything)).alias("weight"))
    families = F.size(F.collect_set("family").over(everything))
    own = F.count(F.lit(1)).over(Window.partitionBy("family"))
    return sources.select("source", "family", (1.0 / families / own).alias("weight"))


def offsets(df: DataFrame, keys: list[str], length: str, order: list[str], block: int = 100_000) -> DataFrame:
    """Running start of each record in its partition, in the order of columns of which the first is a number.

    Blocks of `block` numbers of the first column are summed, their sums run over each partition (a row a block), and only
    inside a block records follow one another, so a large partition is many tasks.
    """
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    at = F.floor(F.col(order[0]) / block)
    sums = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], at.alias("__at")).agg(F.sum(length).alias("__sum"))
    names = [f"__{k}" for k in keys]
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before(*names).orderBy("__at")), F.lit(0))).drop("__sum")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], at.eqNullSafe(F.col("__at")))
    own = F.coalesce(F.sum(length).over(before(*names, "__at").orderBy(*order)), F.lit(0))
    return df.join(sums, on).withColumn("token_offset", (F.col("__base") + own).cast("bigint")).drop(*names, "__at", "__base")


def gaps(df: DataFrame, keys: list[str], offset: str, length: str) -> DataFrame:
    """Records whose offset is not the end of the one before (the first has to start at 0)."""
    w = Window.partitionBy(*keys).orderBy(offset)
    want = F.coalesce(F.lag(F.col(offset) + F.col(length)).over(w), F.lit(0))
    return df.withColumn("expected", want).filter(F.col(offset) != F.col("expected"))


def small_sources(groups: DataFrame, most: int = 3) -> DataFrame:
    """The sources with the fewest groups (the first by name of equals)."""
    return groups.select("source", "group").distinct().groupBy("source").count().orderBy("count", "source").limit(most).select("source")


def balance(groups: DataFrame, splits=("dev", "confirmation")) -> DataFrame:
    """(source, group, split): moves of whole train groups so that each label of a source is in each held-out split.

    groups: (source, group, split, labels, rank). Split by split and label by label, in order, a source without a group of
    that label there gives the first by (rank, group) of those in train; it needs two to choose from, else that is an error.
    A round takes one split and every source's next label; all sources go together, each round is two aggregations.
    """
    state = groups.select("source", "group", "split", "labels", "rank")
    labels = state.select("source", F.explode("labels").alias("label")).distinct()
    place = F.row_number().over(Window.partitionBy("source").orderBy("label"))  # a row a label
    labels = materialize(labels.withColumn("place", place), "balance-labels")
    rounds = labels.agg(F.max("place")).first()[0] or 0
    state = materialize(state, "balance-groups")
    for split in splits:
        for i in range(1, rounds + 1):
            asked = small_side(labels.filter(F.col("place") == i).select("source", "label"), BROADCAST_SOURCES)
            own = state.join(asked, "source").filter(F.array_contains("labels", F.col("label")))
            train = F.col("split") == "train"
            per = own.groupBy("source", "label").agg(F.max((F.col("split") == split).cast("int")).alias("there"), F.count_if(train).alias("free"), F.min(F.when(train, F.struct("rank", "group"))).alias("first"))
            short = F.raise_error(F.concat("source", F.lit(": fewer than two train groups with label "), "label")).cast("string")
            moved = per.filter("there = 0").select("source", F.when(F.col("free") < 2, short).otherwise(F.col("first.group")).alias("group"), F.lit(split).alias("to"))
            moved = small_side(materialize(moved, "balance-moves"), BROADCAST_SOURCES)
            before, state = state, materialize(state.join(moved, ["source", "group"], "left").withColumn("split", F.coalesce("to", "split")).drop("to"), "balance-groups")
            drop_path(before)
    drop_path(labels)
    return state.select("source", "group", "split")


#: Records that a sampled row may draw.
DRAWS = 128
#: Packed rows that one call of Python makes.
SLAB = 64
PACKED = "source string, row int, used int, ids array<int>, real_mask array<int>, answer_mask array<int>, records array<bigint>"


def _filled(sizes: np.ndarray, used: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Next-fit from several states at once: rows begun and tokens in the open row after records of these sizes.

    used: tokens in the open row, -1 without one.
    """
    begun, used = np.zeros(len(used), np.int64), used.copy()
    for n in sizes.tolist():
        new = (used < 0) | (used + n > room)
        begun += new
        used = np.where(new, n, used + n)
    return begun, used


_STEP = "source string, part bigint, begun array<bigint>, used array<bigint>"


def next_fit(sizes: DataFrame, room: int, block: int = 512) -> DataFrame:
    """(source, place, row): the row of each record (source, place, size) when rows are filled in order, each with all that
    still fits; a record that does not fit begins the next row. place runs from 0 in each source.

    What a block of records does to the open row is a function of its tokens, at most room + 2 of them. Blocks make their
    functions alone, `block` of them are composed to one, and those run over a source; then each block knows its open row.
    So the rows are those of one pass over a source, whatever `block` is, without a source in one task.
    """
    states = np.arange(-1, room + 1)

    def one(key, d: pd.DataFrame) -> pd.DataFrame:
        begun, used = _filled(d.sort_values("place")["size"].to_numpy(), states, room)
        return pd.DataFrame({"source": [key[0]], "part": [key[1]], "begun": [begun], "used": [used]})

    def compose(key, d: pd.DataFrame) -> pd.DataFrame:
        begun, used = np.zeros(len(states), np.int64), states
        for x, y in zip(*(d.sort_values("part")[c] for c in ("begun", "used")), strict=True):
            begun, used = begun + np.asarray(x)[used + 1], np.asarray(y)[used + 1]
        return pd.DataFrame({"source": [key[0]], "part": [key[1]], "begun": [begun], "used": [used]})

    def run(d: pd.DataFrame, begun: int, used: int) -> list:
        out = []
        for part, x, y in zip(*(d.sort_values("part")[c] for c in ("part", "begun", "used")), strict=True):
            out.append((int(part), begun, used))
            begun, used = begun + int(x[used + 1]), int(y[used + 1])
        return out

    def first(key, d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in run(d, 0, -1)], columns=["source", "upper", "begun0", "used0"])

    def then(key, d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in run(d, int(d["begun0"].iloc[0]), int(d["used0"].iloc[0]))], columns=["source", "part", "begun0", "used0"])

    def rows(key, d: pd.DataFrame) -> pd.DataFrame:
        row, used, out = int(d["begun0"].iloc[0]) - 1, int(d["used0"].iloc[0]), []
        d = d.sort_values("place")
        for n in d["size"].tolist():
            if used < 0 or used + n > room:
                row, used = row + 1, 0
            used += n
            out.append(row)
        return pd.DataFrame({"source": key[0], "place": d["place"], "row": out})

    upper = F.floor(F.col("part") / block)
    parted = sizes.withColumn("part", F.floor(F.col("place") / block))
    steps = materialize(parted.groupBy("source", "part").applyInPandas(one, _STEP), "next-fit-steps")
    wide = steps.groupBy("source", upper.alias("part")).applyInPandas(compose, _STEP)
    starts = wide.groupBy("source").applyInPandas(first, "source string, upper bigint, begun0 bigint, used0 bigint")
    each = steps.withColumn("upper", upper).join(starts, ["source", "upper"]).groupBy("source", "upper").applyInPandas(then, "source string, part bigint, begun0 bigint, used0 bigint")
    out = materialize(parted.join(each, ["source", "part"]).groupBy("source", "part").applyInPandas(rows, "source string, place bigint, row int"), "next-fit-rows")
    drop_path(steps)
    return out


def pack(df: DataFrame, rows: int | None = None, seed: str = "pack-1", context: int = CONTEXT) -> DataFrame:
    """Packed rows of at most context + 1 tokens from (source, ord, ids, answer_start).

    Without `rows`: sequential, each record once, next-fit in the order of ord over the whole source. With `rows`: that many
    rows a source, drawn with replacement by a hash of (seed, row, draw), at most DRAWS draws, ending at the first record
    that does not fit; draws meet their records by place, so no task holds a source. A source without a record that fits
    is an error then.
    """

    def emitted(order: str):
        def emit(key, d: pd.DataFrame) -> pd.DataFrame:
            d = d.sort_values(["row", order])
            row, texts, starts, ords = d["row"].to_numpy(), d["ids"].tolist(), d["answer_start"].tolist(), d["ord"].to_numpy()
            out = []
            for part in np.split(np.arange(len(d)), np.flatnonzero(np.diff(row)) + 1):
                ids, real, mask = (np.zeros(context + 1, np.int32) for _ in range(3))
                used = 0
                for i in part.tolist():
                    n = len(texts[i])
                    ids[used : used + n] = texts[i]
                    mask[used + int(starts[i]) : used + n] = 1
                    used += n
                real[:used] = 1
                out.append((key[0], int(row[part[0]]), used, ids, real, mask, ords[part]))
            return pd.DataFrame(out, columns=["source", "row", "used", "ids", "real_mask", "answer_mask", "records"])

        return emit

    slab = F.floor(F.col("row") / SLAB).alias("slab")
    fits = df.filter(F.size("ids") <= context + 1).select("source", "ord", "ids", "answer_start")
    placed = offsets(fits.withColumn("one", F.lit(1)), ["source"], "one", ["ord"]).withColumnRenamed("token_offset", "place").drop("one")
    if rows is None:
        met = next_fit(placed.select("source", "place", F.size("ids").alias("size")), context + 1)
        return placed.join(met, ["source", "place"]).groupBy("source", slab).applyInPandas(emitted("place"), PACKED)
    counts = fits.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    empty = df.select("source").distinct().join(counts, "source", "left_anti").limit(1).collect()
    if empty:
        raise ValueError(f"no record of {empty[0]['source']} fits")
    asked = counts.select("source").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return _held(asked, placed, counts, seed, context).groupBy("source", slab).applyInPandas(emitted("draw"), PACKED)


def _held(asked: DataFrame, placed: DataFrame, counts: DataFrame, seed: str, context: int) -> DataFrame:
    """Records (source, ord, ids, answer_start, draw) of each row asked for: hashed draws with replacement up to the first
    that does not fit; a draw meets its record by place, so no task holds a source."""
    draws = asked.join(counts, "source").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    number = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "source", "row", "draw"), 256), 1, 12), 16, 10).cast("bigint")
    met = draws.withColumn("place", number % F.col("n")).drop("n").join(placed, ["source", "place"])
    upto = F.sum(F.size("ids")).over(Window.partitionBy("source", "row").orderBy("draw"))
    return met.withColumn("upto", upto).filter(F.col("upto") <= context + 1).drop("upto", "place")


#: Parts of the unit interval in which row draws and sources meet, and resolution of weights.
CELLS, RESOLUTION = 4096, 1 << 40


def chosen_sources(weights: DataFrame, rows: int, seed: str = "pack-1") -> DataFrame:
    """(row, source): the source of each of `rows` rows, drawn with replacement by weight (source, weight).

    The inverse of the cumulative weights, in the order of source, at a hash of (seed, row). Sources and rows meet in cells
    of equal width, so neither is collected. Weights are rounded to RESOLUTION parts of their sum, so equal weights give
    equal draws on every machine; a source of weight 0 or null is never drawn, one below 0 is an error.
    """
    w = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    w = F.when(w < 0, F.raise_error(F.lit("weight below 0")).cast("double")).otherwise(w)
    everything = Window.partitionBy(F.lit(1))  # a row a source
    parts = weights.select("source", w.alias("w")).withColumn("parts", F.round(F.col("w") / F.sum("w").over(everything) * RESOLUTION).cast("bigint")).filter("parts > 0")
    high = F.sum("parts").over(everything.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    ends = parts.withColumn("high", high).withColumn("low", F.col("high") - F.col("parts")).withColumn("total", F.sum("parts").over(everything))
    cell = lambda c: F.floor(c / F.lit(RESOLUTION // CELLS)).cast("int")
    spread = ends.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit("row"), F.col("row").cast("string")), 256), 1, 13), 16, 10).cast("bigint")
    # the sum of the rounded parts may differ from RESOLUTION by half a part a source; draws are scaled to it
    total = spread.select("total").limit(1)
    asked = weights.sparkSession.range(rows).select(F.col("id").cast("int").alias("row")).withColumn("h", drawn)
    number = (F.col("h") % F.col("total")).alias("number")
    scaled = asked.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select("row", number)  # one number
    met = scaled.withColumn("cell", cell(F.col("number"))).join(spread, "cell").filter("number >= low AND number < high")
    return met.select("row", "source")


def sample_rows(df: DataFrame, weights: DataFrame, rows: int, seed: str = "pack-1", context: int = CONTEXT) -> DataFrame:
    """`rows` rows of at most context + 1 tokens: (row, source, used, draw, ord, ids, answer_start), a row for each
    record held, in the order of draw.

    The source of a row is drawn by weight, its records with replacement from those of the source that fit, until one does
    not fit behind the others (at most DRAWS). A source with weight but without a record that fits is an error.
    """
    fits = df.filter(F.size("ids") <= context + 1).select("source", "ord", "ids", "answer_start")
    counts = fits.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    empty = weights.filter("weight > 0").join(counts, "source", "left_anti").limit(1).collect()
    if empty:
        raise ValueError(f"no record of {empty[0]['source']} fits")
    placed = offsets(fits.withColumn("one", F.lit(1)), ["source"], "one", ["ord"]).withColumnRenamed("token_offset", "place").drop("one")
    held = _held(chosen_sources(weights, rows, seed), placed, counts, seed, context)
    return held.withColumn("used", F.sum(F.size("ids")).over(Window.partitionBy("row")))
