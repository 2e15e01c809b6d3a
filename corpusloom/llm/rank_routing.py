"""Operator 13: aggregates of groups kept up to date over batches of signed events, by dividing the domain of values.

Events (group, batch, value, +1 or -1) are summed to cells (group, batch, value, delta) before anything else. Counts and sums
run over the batches of a group (a row a batch). Distinct values come from zero crossings: a value counts from the batch
in which its own running count leaves zero to the batch in which it returns to it. Order statistics are ranks: 1, the
median's and n, for each batch. All batches of all groups are routed together down a tree over the values of the group:

1. a node (a range of values of one group) is split at the median of the values of its events;
2. the events at or below it are summed by node and batch, and their running sum is what stands left of the split;
3. a batch's rank goes left if that sum reaches it, else right, less the sum;
4. events of nodes that no rank has reached are dropped; nodes of at most LEAF cells, or of one value, are solved whole.

Every step is an aggregation with partial sums by (group, node, batch), so a group that holds most of the rows is spread
like any other; a window holds one value of a group, or the batches of one group or node; a leaf has at most LEAF cells
(a node of one value at most one for each batch).

Defined cases: null keys are the empty string; a null value counts as a row but has no part in the other aggregates; a group
without rows has counts and a total of 0 and null order statistics; events that cancel within a batch are no change; repeated
events add up; an empty table gives an empty table; other columns are not read. In a query over documents a null doc_id
hashes as the empty text. Events must never take more of a value than there is.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_side, table

#: Cells up to which a node is solved whole.
LEAF = 1024
#: Nodes up to which their splits are broadcast; beyond it they are joined by a shuffle.
BROADCAST_NODES = 20_000
STATE = ["n_rows", "n_distinct", "total", "least", "greatest", "median"]
BATCHES = 20


def _solve(cells: pd.DataFrame, ranks: pd.DataFrame) -> list:
    """The value at each rank of a leaf's (batch, rank): the first value up to which that many rows are present."""
    order = np.argsort(cells["value"].to_numpy(), kind="stable")
    value, batch, delta = (cells[c].to_numpy()[order] for c in ("value", "batch", "delta"))
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    out = np.empty(len(ranks), np.int64)
    at, rank = ranks["batch"].to_numpy(), ranks["rank"].to_numpy()
    for b in np.unique(at):
        upto = np.cumsum(np.add.reduceat(np.where(batch <= b, delta, 0), first))
        k = np.flatnonzero(at == b)
        out[k] = value[first[np.searchsorted(upto, rank[k])]]
    return out.tolist()


def _leaf(keys: list[str]):
    def leaf(key, cells: pd.DataFrame, ranks: pd.DataFrame) -> pd.DataFrame:
        out = ranks[[*keys, "batch", "kind"]].copy()
        out["value"] = np.array(_solve(cells, ranks) if len(ranks) else [], np.int64)
        return out

    return leaf


def _route(keys: list[str], cells: DataFrame, ranks: DataFrame, keep: Scratch, leaf: int) -> DataFrame:
    """(keys, batch, kind, value): the value at the rank of each (batch, kind)."""
    node = [*keys, "node"]
    cells, ranks = cells.withColumn("node", F.lit(1).cast("bigint")), ranks.withColumn("node", F.lit(1).cast("bigint"))
    solved = []
    while True:
        split = F.least(F.percentile_approx("value", 0.5, 1000), F.max("value") - 1)
        stats = cells.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), split.alias("split"))
        nodes = keep(stats.withColumn("whole", F.expr(f"n <= {leaf} OR low = high")), "rr-nodes")
        whole, divided = (small_side(nodes.filter(c).select(*node, "split"), BROADCAST_NODES) for c in ("whole", "NOT whole"))
        ready = cells.join(whole.drop("split"), node, "left_semi").groupBy(*node).cogroup(ranks.join(whole.drop("split"), node, "left_semi").groupBy(*node))
        schema = ", ".join([*[f"`{k}` string" for k in keys], "batch bigint", "kind string", "value bigint"])
        solved.append(keep(ready.applyInPandas(_leaf(keys), schema), "rr-solved"))
        if not nodes.filter("NOT whole").limit(1).count():
            return reduce(DataFrame.unionByName, solved)
        sides = cells.join(divided, node).withColumn("right", F.col("value") > F.col("split")).drop("split")
        left = sides.filter("NOT right").groupBy(*node, "batch").agg(F.sum("delta").alias("delta"))
        asked = ranks.join(divided.drop("split"), node, "left_semi")
        both = asked.unionByName(left, allowMissingColumns=True)
        # the sums of a batch stand before the ranks asked at it
        upto = F.coalesce(F.sum("delta").over(Window.partitionBy(*node).orderBy("batch", F.col("kind").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        routed = both.withColumn("upto", upto).filter("kind IS NOT NULL").withColumn("right", F.col("rank") > F.col("upto"))
        child = (F.col("node") * 2 + F.col("right").cast("int")).alias("node")
        ranks = keep(routed.select(*keys, "batch", "kind", F.expr("CASE WHEN right THEN rank - upto ELSE rank END").alias("rank"), child), "rr-ranks")
        reached = small_side(ranks.select(*node).distinct(), BROADCAST_NODES)
        cells = keep(sides.select(*keys, "batch", "value", "delta", child).join(reached, node, "left_semi"), "rr-cells")


def changes(events: DataFrame, keys: list[str], leaf: int = LEAF) -> DataFrame:
    """Each batch and group whose aggregates changed, with every aggregate before (old_) and after (new_) the batch.

    events: keys, batch, value (null or a whole number) and delta, the signed number of rows.
    """
    keep = Scratch()
    events = events.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], *[F.col(c).cast("bigint").alias(c) for c in ("batch", "value", "delta")])
    cells = keep(events.groupBy(*keys, "batch", "value").agg(F.sum("delta").alias("delta")).filter("delta <> 0"), "rr-events")
    valued = cells.filter("value IS NOT NULL")
    sums = cells.groupBy(*keys, "batch").agg(
        F.sum("delta").alias("n_rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("delta")).otherwise(0)).alias("n_values"),
        F.coalesce(F.sum(F.col("value") * F.col("delta")), F.lit(0)).alias("total"),
    )
    count = F.sum("delta").over(Window.partitionBy(*keys, "value").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    crossing = valued.withColumn("after", count).withColumn("cross", (F.col("after") > 0).cast("int") - (F.col("after") > F.col("delta")).cast("int"))
    distinct = crossing.groupBy(*keys, "batch").agg(F.sum("cross").cast("bigint").alias("n_distinct"))
    over = Window.partitionBy(*keys).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    running = [F.sum(c).over(over).alias(c) for c in ("n_rows", "n_values", "n_distinct", "total")]
    states = sums.join(distinct, [*keys, "batch"], "left").fillna(0, ["n_distinct"])
    states = keep(states.select(*keys, "batch", *running), "rr-states")
    kinds = F.map_from_arrays(F.array(*map(F.lit, ["least", "median", "greatest"])), F.array(F.lit(1).cast("bigint"), F.floor((F.col("n_values") + 1) / 2), F.col("n_values")))
    ranks = keep(states.filter("n_values > 0").select(*keys, "batch", F.explode(kinds).alias("kind", "rank")), "rr-asked")
    found = _route(keys, valued, ranks, keep, leaf)
    wide = found.groupBy(*keys, "batch").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("least", "greatest", "median")])
    after = states.join(wide, [*keys, "batch"], "left").select(*keys, "batch", *STATE)
    turn = Window.partitionBy(*keys).orderBy("batch")
    none = {c: F.lit(0) if c in STATE[:3] else F.lit(None) for c in STATE}
    old = lambda c: F.coalesce(F.lag(c).over(turn), none[c]).cast("bigint") if c in STATE[:3] else F.lag(c).over(turn)
    both = after.select("batch", *keys, *[x for c in STATE for x in (old(c).alias(f"old_{c}"), F.col(c).alias(f"new_{c}"))])
    same = reduce(lambda a, b: a & b, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in STATE])
    out = keep(both.filter(~same).withColumn("batch", F.col("batch").cast("int")), "rr-changes")
    keep.drop(out)
    return out


def document_events(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Signed events of documents: each enters, leaves, and some come back for good with more characters."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("source", "lang", F.col("n_chars").cast("bigint").alias("n"), (h % batches).alias("b"), (F.floor(h / batches) % 4).alias("q"))
    move = lambda batch, value, delta: F.struct(batch.alias("batch"), value.alias("value"), F.lit(delta).cast("bigint").alias("delta"))
    back = F.when(F.col("q") % 3 == 0, F.array(move(F.col("b") + F.col("q"), F.col("n") + F.col("q"), 1))).otherwise(F.array())
    moves = F.concat(F.array(move(F.col("b"), F.col("n"), 1), move(F.col("b") + F.col("q"), F.col("n"), -1)), back)
    return rows.select("source", "lang", F.inline(moves)).filter(F.col("batch") < batches)


def op13_rank_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(document_events(table(spark, sf_dir, "documents")), ["source", "lang"])


#: CRC-32 of short ASCII texts in SQL: the table of its reflected polynomial, then a step a character.
CRC = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v
  FROM (SELECT unnest(range(0, 256)) AS i)))"""
SQL = f"""
WITH {CRC},
d AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_chars AS n,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: c <> ''), lambda c: ord(c)::BIGINT)),
            lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM documents, crc),
r AS (SELECT source, lang, n, h % 20 AS b, (h // 20) % 4 AS q FROM d),
e AS (SELECT source, lang, b AS since, b + q AS until, n AS v FROM r
      UNION ALL SELECT source, lang, b + q, 20, n + q FROM r WHERE q % 3 = 0),
p AS (SELECT t.batch, source, lang, v FROM e JOIN (SELECT unnest(range(0, 20)) AS batch) t ON t.batch >= since AND t.batch < until),
m AS (SELECT batch, source, lang, v, row_number() OVER w AS k, count(v) OVER (PARTITION BY batch, source, lang) AS c FROM p
      WHERE v IS NOT NULL WINDOW w AS (PARTITION BY batch, source, lang ORDER BY v)),
s AS (SELECT batch, source, lang, count(*) AS n_rows, count(DISTINCT v) AS n_distinct, coalesce(sum(v), 0)::BIGINT AS total, min(v) AS least, max(v) AS greatest
      FROM p GROUP BY ALL),
f AS (SELECT t.batch, g.source, g.lang, coalesce(n_rows, 0) AS n_rows, coalesce(n_distinct, 0) AS n_distinct, coalesce(total, 0) AS total, least, greatest, median
      FROM (SELECT unnest(range(0, 20)) AS batch) t CROSS JOIN (SELECT DISTINCT source, lang FROM d) g
      LEFT JOIN s ON s.batch = t.batch AND s.source = g.source AND s.lang = g.lang
      LEFT JOIN (SELECT batch, source, lang, v AS median FROM m WHERE k = (c + 1) // 2) x ON x.batch = t.batch AND x.source = g.source AND x.lang = g.lang),
o AS (SELECT batch::INT AS batch, source, lang,
  {", ".join(f"{'coalesce(lag(' + c + ') OVER w, 0)' if c in STATE[:3] else 'lag(' + c + ') OVER w'}::BIGINT AS old_{c}, {c}::BIGINT AS new_{c}" for c in STATE)}
  FROM f WINDOW w AS (PARTITION BY source, lang ORDER BY batch))
SELECT * FROM o WHERE {" OR ".join(f"old_{c} IS DISTINCT FROM new_{c}" for c in STATE)}
"""
