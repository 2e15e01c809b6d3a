"""Connected components of an edge table, as rounds of joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, rows_bounded

#: Edges up to which one task finds the components by union-find: 16 bytes each.
ONE_TASK_EDGES = 200_000


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d in batches:
        for a, b in zip(d["id"].tolist(), d["to"].tolist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    ids = list(root)
    yield pd.DataFrame({"id": ids, "component": [find(i) for i in ids]}).astype("int64")


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """(id, component) of every vertex of edges (a, b): component is the smallest id reachable. Written to a table.

    Each round takes the least label of the neighbours, then the label's own label (pointer jumping), so long chains
    shorten geometrically; it ends when no label changed. Every step is an aggregation with partial sums or a join on a
    unique key, so a vertex with very many edges is split like any skewed join key. Where the edges are counted to be at
    most ONE_TASK_EDGES (or one_task), one task does the same by union-find, which spares the rounds their start-up.

    Defined cases: an edge from a vertex to itself is left out; repeated and turned edges count once; an edge with a null end is left out; an
    empty table gives an empty table.
    """
    edges = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    if rows_bounded(edges, ONE_TASK_EDGES if one_task is None else one_task):
        return materialize(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).coalesce(1).mapInPandas(_union_find, "id bigint, component bigint"), "cc-labels")
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
    both = materialize(both.distinct(), "cc-edges")
    label = materialize(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("component")), "cc-labels")
    total = _total(label)
    while True:
        near = both.join(label.select(F.col("id").alias("to"), "component"), "to").groupBy("id").agg(F.min("component").alias("m"))
        new = materialize(label.join(near, "id").select("id", F.least("component", "m").alias("component")), "cc-labels")
        above = new.select(F.col("id").alias("component"), F.col("component").alias("above"))
        jumped = materialize(new.join(above, "component").select("id", F.least("component", "above").alias("component")), "cc-labels")
        drop_path(label)
        drop_path(new)
        label, before = jumped, total
        total = _total(label)
        if total == before:
            drop_path(both)
            return label


def _total(label: DataFrame):
    return label.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]
