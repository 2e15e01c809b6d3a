"""Sinks: JSON lines, partitioned tables, manifests, reports, and publishing that never overwrites."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """K1/K7: one JSON object a line, characters as they are; an existing path is an error."""
    df.write.mode("errorifexists").json(path)


def partitioned(df: DataFrame, path: str, by=("source", "split")) -> None:
    """K2: one folder for each value; rows meet by a salted key first, so a large source is many files.

    The salt hashes the whole row, so a column that is the same in all rows does not undo it.
    """
    salted = df.repartition(*[F.col(b) for b in by], F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(16)))
    salted.write.mode("errorifexists").partitionBy(*by).parquet(path)


def token_store(encoded: DataFrame, path: str) -> None:
    """K3: ids, answer start, offset and length of each record."""
    encoded.select("source", "split", "ord", "ids", "answer_start", "token_offset", "token_length").write.mode("errorifexists").partitionBy("source", "split").parquet(path)


def parent_then_new(parent: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Parent rows first: new rows are placed after the parent's last."""
    last = parent.agg(F.max(order)).first()[0]
    start = 0 if last is None else last + 1
    return parent.unionByName(new.withColumn(order, F.col(order) + F.lit(start)), allowMissingColumns=True)


def publish_json(value, path: str) -> None:
    """K6: written beside the target, then renamed over it."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, tmp = tempfile.mkstemp(dir=folder, suffix=".partial")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(tmp, path)


def publish_once(value, path: str) -> bool:
    """K8: writes a new file; the same content again is fine (False), another is an error."""
    text = json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if hashlib.sha256(f.read().encode()).digest() != hashlib.sha256(text.encode()).digest():
                raise FileExistsError(path)
        return False
    publish_json(value, path)
    return True


def _file_system(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _read(spark, stream) -> str:
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def content_of(df: DataFrame) -> str:
    """Rows and the sum of two hashes of each, whatever their order: what two writes of one content share."""
    name = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0)).cast("string")
    r = df.agg(F.count(F.lit(1)).alias("n"), name(1).alias("a"), name(2).alias("b")).first()
    return f"{r['n']} {r['a']} {r['b']}"


def publish_table(df: DataFrame, path: str) -> bool:
    """K6/K8: a table that is there whole or not at all, on any file system that Spark reaches.

    It is written beside its place, marked with its content and renamed. The same content again writes nothing (False),
    another is an error; a write that was broken off leaves nothing at the place.
    """
    spark = df.sparkSession
    fs, at = _file_system(spark, path)
    beside = f"{path.rstrip('/')}.{uuid4().hex}.partial"
    df.write.parquet(beside)
    try:
        content, marker = content_of(spark.read.schema(df.schema).parquet(beside)), at(f"{path}/_content")
        if fs.exists(at(path)):
            if not fs.exists(marker) or _read(spark, fs.open(marker)) != content:
                raise FileExistsError(path)
            return False
        out = fs.create(at(f"{beside}/_content"), False)
        out.write(bytearray(content.encode()))
        out.close()
        if not fs.rename(at(beside), at(path)):
            raise FileExistsError(path)
        return True
    finally:
        fs.delete(at(beside), True)


def publish_batches(stream: DataFrame, folder: str, checkpoint: str):
    """Each batch of a stream as a published table of its number, so a batch that is replayed writes nothing twice."""
    return stream.writeStream.foreachBatch(lambda batch, i: publish_table(batch, f"{folder}/batch={i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def markdown(df: DataFrame, order: list[str], most: int = 1000) -> str:
    """K9: a table of a report; reports are small, more rows than `most` are an error."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def manifest(files: DataFrame, counts: DataFrame, version: str) -> dict:
    """Manifest of a corpus: digests of its files and counts by source.split (both small, a row for each file or split)."""
    return {"version": version, "files": {r["path"]: r["sha256"] for r in files.collect()}, "counts": {f"{r['source']}.{r['split']}": {k: r[k] for k in counts.columns if k not in ("source", "split")} for r in counts.collect()}}


def view_of(manifest: dict, weights: dict[str, float]) -> dict:
    """K5: the manifest of the same files under other weights; nothing is copied. A weight needs a source of the corpus."""
    unknown = set(weights) - {k.rsplit(".", 1)[0] for k in manifest["counts"]}
    if unknown:
        raise ValueError(f"no such source: {sorted(unknown)}")
    return {**manifest, "weights": dict(sorted(weights.items()))}


def merged_sources(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two maps, the right side wins."""
    return a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full_outer").select(key, F.coalesce("y", "x").alias(value))
