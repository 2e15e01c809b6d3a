"""U8: groups of records connected by identity keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import drop_path, materialize


def connected_groups(edges: DataFrame) -> DataFrame:
    """(ord, component, name, group) from (ord, key): rows that share a key, directly or over others, are one group.

    The component is named by its smallest key, so the result does not depend on row order. Rounds take the least label
    over each key, then over each row, then the label's own label; they end when no label changed.
    """
    edges = materialize(edges.select("ord", "key").distinct(), "cg-edges")
    label = materialize(edges.groupBy("ord").agg(F.min("ord").alias("c")), "cg-labels")
    total = None
    while True:
        by_key = edges.join(label, "ord").groupBy("key").agg(F.min("c").alias("m"))
        near = edges.join(by_key, "key").groupBy("ord").agg(F.min("m").alias("c"))
        near = materialize(near, "cg-labels")
        up = near.select(F.col("ord").alias("c"), F.col("c").alias("up"))
        new = materialize(near.join(up, "c").select("ord", F.least("c", "up").alias("c")), "cg-labels")
        drop_path(label)
        drop_path(near)
        label, before = new, total
        total = label.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
    names = edges.join(label, "ord").groupBy("c").agg(F.min("key").alias("name"))
    out = materialize(label.join(names, "c").select("ord", F.col("c").alias("component"), "name", F.sha2("name", 256).alias("group")), "cg-groups")
    drop_path(edges)
    drop_path(label)
    return out
