"""Shared folder, materialised intermediates and small helpers of the operators here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from corpusloom.session import table

__all__ = ["shared_dir", "materialize", "drop_path", "table", "text_of", "rows_bounded", "small_side", "Scratch", "row_digest", "repeated", "numbered"]

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only in local mode, where driver and executors are one process, a temporary one is made if the session has none; on a
    cluster that is an error, as no local folder is shared there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return _OWN[0]


def materialize(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at a table that outlives any executor.

    partition: a column of few values that is made to folders, so that a filter on it reads only those.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partition)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def drop_path(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_corpusloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written on the way to a result; drop() deletes those that it does not read."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
        self.made.append(materialize(df, name, partition))
        return self.made[-1]

    def drop(self, *keep: DataFrame) -> None:
        for t in self.made:
            if not any(t is k for k in keep):
                drop_path(t)
        self.made = list(keep)


def text_of(docs: DataFrame, column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(docs[column], F.lit(""))


def rows_bounded(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows: the check that has to stand before any broadcast."""
    return len(df.select(F.lit(1)).limit(limit + 1).groupBy().count().filter(F.col("count") <= limit).collect()) == 1


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """A side of a join: broadcast if it has at most limit rows, else left to a shuffled join. df should be a written table."""
    return F.broadcast(df) if rows_bounded(df, limit) else df


#: Equal rows that are numbered in one task, and kinds of equal rows up to which they are broadcast.
PART, BROADCAST_KINDS = 10_000, 200_000


def row_digest(df: DataFrame) -> Column:
    """MD5 of the MD5s of all columns; null is not the empty text."""

    def one(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, MapType):
            c = F.array_sort(F.map_entries(c))
        nested = isinstance(f.dataType, ArrayType | MapType | StructType)
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if nested else c if isinstance(f.dataType, BinaryType) else c.cast("string")
        return F.when(c.isNull(), F.lit("null")).otherwise(F.md5(text))

    return F.md5(F.concat_ws(":", *map(one, df.schema.fields)))


def repeated(keys: DataFrame, keep: Scratch) -> DataFrame | None:
    """(digest, n) of the rows that keys (digest, ...) has more than once, or None if there are none."""
    out = keep(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-rows")
    return out if out.limit(1).count() else None


def numbered(rows: DataFrame, some: DataFrame | None) -> DataFrame:
    """rows with `k`, a number among rows of one digest from 0; some: what repeated() found.

    Rows of one digest are equal, so one of them and their number stand for all; they are numbered in parts of PART, each
    of which can be another task's.
    """
    if some is None:
        return rows.withColumn("k", F.lit(0).cast("bigint"))
    hot = small_side(some, BROADCAST_KINDS)
    once = rows.join(hot.select("digest"), "digest", "left_anti").withColumn("k", F.lit(0).cast("bigint"))
    many = rows.join(hot.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]).join(hot, "digest")
    many = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PART)))).repartition("digest", "part")
    ends = F.least(F.col("n"), (F.col("part") + 1) * PART) - 1
    many = many.withColumn("k", F.explode(F.sequence(F.col("part") * PART, ends)))
    return once.unionByName(many.drop("n", "part"))
