"""Readers: Parquet, JSON lines, JSON objects, CSV, text pairs, tolerant logs, binary arrays, file digests, locks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.audit import bad_locks
from corpusloom.storage import materialize, small_side


def parquet(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Only the named columns are read."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def row_count(spark: SparkSession, path: str) -> int:
    """S3: no column is read for the count."""
    return spark.read.parquet(path).count()


def json_lines(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Rows of one or several files; blank lines are skipped."""
    return spark.read.schema(schema).json([paths] if isinstance(paths, str) else list(paths))


def json_objects(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object of rows by key; one document a file."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", f"map<string, {value_schema}>")
    return text.select(F.explode(m).alias("key", "row")).select("key", "row.*")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header, quoted line ends."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


#: Splits up to which the numbers of their first lines are broadcast.
BROADCAST_SPLITS = 200_000


def numbered_text(spark: SparkSession, path) -> DataFrame:
    """(path, number, value): the lines of each file that are not blank, numbered from 0 in the file's order.

    Each input split counts its lines; the number of a line is the sum of the splits before it and its place in its own, so
    a large file is as many tasks as it has splits. The lines are written once, so that both steps see the same splits.
    """
    text = spark.read.text([path] if isinstance(path, str) else list(path)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = materialize(text.filter(F.trim("value") != ""), "numbered-lines")
    ranks = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    starts = small_side(materialize(ranks.select("path", "block", F.coalesce(before, F.lit(0)).alias("start")), "numbered-splits"), BROADCAST_SPLITS)
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    return lines.withColumn("place", place).join(starts, ["path", "block"]).select("path", (F.col("start") + F.col("place")).alias("number"), "value")


def numbered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of files with their line number in their file."""
    rows = numbered_text(spark, path).select(F.col("number").alias("uid"), F.from_json("value", schema).alias("r"))
    return rows.select("uid", "r.*")


def paired_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(number, left, right): two files line by line; different lengths are an error when the result is read."""
    a = numbered_text(spark, left).select("number", F.col("value").alias("left"))
    b = numbered_text(spark, right).select("number", F.col("value").alias("right"))
    both = a.join(b, "number", "full_outer")
    short = F.col("left").isNull() | F.col("right").isNull()
    return both.withColumn("left", F.when(short, F.raise_error(F.lit("the files differ in length")).cast("string")).otherwise(F.col("left")))


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only log; a line that does not parse (a partial tail) has `_corrupt` set."""
    return spark.read.schema(f"{schema}, _corrupt STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def document(path: str, fallback=None):
    """A JSON file of the driver, or the fallback where it is missing or broken."""
    import json

    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return fallback


def arrow_metadata(path: str) -> dict[bytes, bytes]:
    """Metadata of a local Parquet file's schema (feature names)."""
    import pyarrow.parquet as pq

    return dict(pq.read_schema(path).metadata or {})


def sqlite_table(spark: SparkSession, path: str, query: str, limit: int = 100_000, seconds: float = 15.0) -> DataFrame:
    """At most `limit` rows of a read-only query of the driver's sqlite file; more rows, or more time than
    `seconds`, is an error, not a cut."""
    import sqlite3
    import time

    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    end = time.monotonic() + seconds
    con.set_progress_handler(lambda: int(time.monotonic() > end), 10_000)
    try:
        rows = pd.read_sql_query(f"SELECT * FROM ({query}) LIMIT {limit + 1}", con)
    finally:
        con.close()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return spark.createDataFrame(rows)


def flat_tokens(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(path, ids) of flat little-endian arrays of 1, 2, 4 or 8 bytes."""
    kind = f"<u{width}"

    @F.pandas_udf("array<bigint>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, kind).astype(np.int64))

    return spark.read.format("binaryFile").load(path).select("path", unpack("content").alias("ids"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def checked_lock(lock: DataFrame) -> DataFrame:
    """The lock table if every row is sound; downloads are not part of this library."""
    bad = bad_locks(lock).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['path']}: {bad[0]['violation']}")
    return lock


def schemas_of(schemas: DataFrame, rows: DataFrame) -> DataFrame:
    """Schemas of the databases that rows name; a missing one is an error."""
    names = rows.select("db_id").distinct()
    missing = names.join(schemas, "db_id", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no schema of {missing[0]['db_id']}")
    return schemas.join(names, "db_id", "left_semi")
