"""Operator 11: shards by a two-pass external shuffle.

Pass one scatters rows into buckets that fit into memory: the bucket is a hash of (seed, digest of the whole row, number
among equal rows), so it is uniform and depends neither on the layout of the input nor on retries. Pass two loads one
bucket at a time, puts its rows in the order of that hash and shuffles them by Fisher and Yates, with draws hashed from
(seed, bucket, place). The buckets in a row are one random permutation of all rows; shards are equal slices of it, so
their row counts are at most one apart (law `rows`), and a bucket lies in one or two shards.

Only digests and sizes are shuffled to find the equal rows, the number of buckets (all bytes by BUCKET_BYTES, at least
one for each shard) and where each bucket starts; the rows themselves move once. Rows equal in every column are kept as
one row and a count until they are numbered, and numbered in parts (common.numbered), so any number of them is spread like other rows.

Defined cases: null text has no bytes; rows that repeat a doc_id, or have none, are placed each by all its columns; equal
rows are interchangeable and spread; a table with fewer rows than shards leaves shards empty; an empty table gives an
empty table; a row larger than BUCKET_BYTES makes a larger bucket; extra columns are kept inside `row`, so no name clashes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import Scratch, drop_path, numbered, repeated, row_digest, small_side, table

SHARDS = 40
SEED = "shuffle-1"
#: Bytes of texts, and 16 for each row, that a bucket holds on average.
BUCKET_BYTES = 32 << 20
#: Buckets up to which their starts are broadcast.
BROADCAST_BUCKETS = 200_000
ROW_BYTES = 16


def _order(keys: list[str], seed: str, bucket: int) -> list[int]:
    """The rows of a bucket in shuffled order: sorted by key, then Fisher-Yates with hashed draws."""
    rows = sorted(range(len(keys)), key=keys.__getitem__)
    for i in range(len(rows) - 1, 0, -1):
        j = int(hashlib.md5(f"{seed}:{bucket}:{i}".encode()).hexdigest()[:15], 16) % (i + 1)
        rows[i], rows[j] = rows[j], rows[i]
    return rows


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, bucket_bytes: int = BUCKET_BYTES, column: str = "text") -> DataFrame:
    """(row, size, shard, slot): every row of docs as a struct, its bytes, its shard from 0 and its place in it from 0."""
    if shards < 1:
        raise ValueError("at least one shard")
    keep = Scratch()
    size = F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("bigint") + ROW_BYTES
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"), row_digest(docs).alias("digest"))
    keys = keep(rows.select("digest", "size"), "shuffle-keys")
    some = repeated(keys, keep)
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("digest"), F.col("k").cast("string")))
    total = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(shards, -(-(total["bytes"] or 0) // bucket_bytes))
    bucket = (F.conv(F.substring("key", 1, 15), 16, 10).cast("bigint") % buckets).alias("bucket")
    counts = numbered(keys, some).withColumn("key", place).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row a bucket
    starts = keep(counts.select("bucket", F.coalesce(before, F.lit(0)).alias("start")), "shuffle-starts")

    def shuffled(key, t):
        b = key[0].as_py()
        order = _order(t.column("key").to_pylist(), seed, b)
        held = t.select(["row", "size"]).take(pa.array(order, pa.int64()))
        return held.append_column("bucket", pa.array([b] * len(order), pa.int64())).append_column("place", pa.array(range(len(order)), pa.int64()))

    scattered = numbered(rows, some).withColumn("key", place).select("row", "size", "key", bucket)
    schema = StructType([scattered.schema["row"], scattered.schema["size"]]).add("bucket", LongType()).add("place", LongType())
    placed = scattered.groupBy("bucket").applyInArrow(shuffled, schema).join(small_side(starts, BROADCAST_BUCKETS), "bucket")
    at, (q, r) = F.col("start") + F.col("place"), divmod(total["n"], shards)
    long = r * (q + 1)  # rows of the shards that hold one more
    shard = F.when(at < long, F.floor(at / (q + 1))).otherwise(r + F.floor((at - long) / max(q, 1)))
    slot = F.when(at < long, at % (q + 1)).otherwise((at - long) % max(q, 1))
    drop_path(keys)
    return placed.select("row", "size", shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, bucket_bytes: int = BUCKET_BYTES, column: str = "text") -> None:
    """Write docs to path as folders shard=0, shard=1, ...; the rows of a shard by `slot`, a column beside those of docs."""
    out = shuffle(docs.drop("shard", "slot"), shards, seed, bucket_bytes, column)
    out.select("row.*", "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")))
    return out.select("row.doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v
  FROM (SELECT unnest(range(0, 256)) AS i))),
d AS (SELECT *, strlen(coalesce(text, ''))::BIGINT + {ROW_BYTES} AS size, md5(concat_ws(':', {", ".join(f"coalesce(md5({c}::VARCHAR), 'null')" for c in ("doc_id", "text", "lang", "source", "n_chars"))})) AS digest FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY digest) - 1 AS k FROM d),
t AS (SELECT greatest({SHARDS}, ceil(sum(size) / {BUCKET_BYTES}.0))::BIGINT AS buckets, count(*) AS rows FROM d),
b AS (SELECT n.*, md5('{SEED}:' || digest || ':' || k) AS key, ('0x' || substr(md5('{SEED}:' || digest || ':' || k), 1, 15))::BIGINT % buckets AS bucket FROM n, t),
f AS (SELECT bucket, list(key ORDER BY key) AS held, count(*) AS i FROM b GROUP BY bucket
  UNION ALL
  SELECT bucket, list_transform(held, lambda x, p: CASE WHEN p = i THEN held[j] WHEN p = j THEN held[i] ELSE x END), i - 1
  FROM (SELECT *, ('0x' || substr(md5('{SEED}:' || bucket || ':' || (i - 1)), 1, 15))::BIGINT % i + 1 AS j FROM f WHERE i > 1)),
g AS (SELECT bucket, unnest(held) AS key, unnest(range(0, len(held))) AS place FROM f WHERE i <= 1),
o AS (SELECT key, row_number() OVER (ORDER BY bucket, place) - 1 AS pos FROM g),
s AS (SELECT key, pos, rows // {SHARDS} AS q, rows % {SHARDS} AS r FROM o, t)
SELECT doc_id, size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32,
  'rows' AS law, (CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) ELSE r + (pos - r * (q + 1)) // greatest(q, 1) END)::INT AS shard,
  (CASE WHEN pos < r * (q + 1) THEN pos % (q + 1) ELSE (pos - r * (q + 1)) % greatest(q, 1) END)::BIGINT AS slot, NULL::INT AS grown_shard
FROM s JOIN b USING (key), crc
"""
