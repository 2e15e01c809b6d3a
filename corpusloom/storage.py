"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at a table that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
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


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """A side of a join: broadcast if it has at most limit rows, else left to a shuffled join. df should be a written table."""
    return F.broadcast(df) if rows_bounded(df, limit) else df


def rows_bounded(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows: the check that has to stand before any broadcast."""
    return len(df.select(F.lit(1)).limit(limit + 1).groupBy().count().filter(F.col("count") <= limit).collect()) == 1
