"""Operator 10: token ids in files of patched frame-of-reference blocks.

A file is one byte string (a row of a table that Spark writes to the shared folder, so it works on any store):

    header   magic, number of documents, ids, blocks, exceptions
    docs     doc_id, null flag and number of ids of each document
    blocks   for each block of BLOCK ids: minimum, bit width, word start (the index of block starts), exception start
    payload  ids less the block's minimum, packed at the block's width in 64-bit words; outliers' low bits only
    patches  for each outlier its place in the block and its high bits

The width is the smallest that holds PERCENTILE of the block's differences; what is wider goes to the exception list.

Documents are spread by ranges of doc_id and sorted inside, so files follow doc_id; the start of a document is the
number of ids before it in its partition plus the totals of earlier partitions (one number for each partition is all
that reaches the driver). Rows of one doc_id, or without one, are spread and sorted further by a hash of their text, and
rows equal in both by where they come from, so that none of them fill one task.
Encoding uses the tokenizers library on distinct pieces of texts (functions/bpe.py); texts that hold the special token
are encoded whole.

Defined cases: null or empty text has only the end id 0; null doc_id sorts first; rows that repeat a doc_id stay, in the
order of a hash of their text; extra columns are ignored; an empty table gives an empty table; a text longer than a file's usual
size makes a longer file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.bpe import encode_array

from .common import materialize, table

BLOCK = 256
PERCENTILE = 0.90
FILE_IDS = 1 << 20
MAGIC = b"PFOR0001"
HEAD = struct.Struct("<8sqqqq")
END = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- blocks ---------------------------------------------------------------------------------------------------------
def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values under 2 ** width as rows of 64-bit words."""
    out = np.zeros((BLOCK * width // 64, len(rows)), np.uint64)
    cols = np.ascontiguousarray(rows.T)
    for j in range(BLOCK):
        w, s = divmod(j * width, 64)
        out[w] |= cols[j] << np.uint64(s)
        if s + width > 64:
            out[w + 1] |= cols[j] >> np.uint64(64 - s)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _pack."""
    cols = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, words.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        w, s = divmod(j * width, 64)
        x = cols[w] >> np.uint64(s)
        if s + width > 64:
            x = x | (cols[w + 1] << np.uint64(64 - s))
        out[j] = x & mask
    return np.ascontiguousarray(out.T)


def pack_ids(ids: np.ndarray) -> tuple[int, int, bytes]:
    """Blocks of ids: number of blocks, of exceptions, and block index, payload and patches as bytes."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return 0, 0, b""
    v = np.empty(blocks * BLOCK, np.uint64)
    v[:n] = ids
    v[n:] = ids[-1]
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    need = _widths(v)
    width = np.partition(need, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))]
    over = need > width[:, None]
    rows, places = np.nonzero(over)
    high = v[rows, places] >> width[rows].astype(np.uint64)
    v &= (np.uint64(1) << width.astype(np.uint64))[:, None] - np.uint64(1)
    size = width * (BLOCK // 64)
    start = np.concatenate([[0], np.cumsum(size)])
    payload = np.zeros(int(start[-1]), np.uint64)
    for w in np.unique(width):
        if w:
            k = np.flatnonzero(width == w)
            payload[start[k][:, None] + np.arange(w * (BLOCK // 64))] = _pack(v[k], int(w))
    first = np.concatenate([[0], np.cumsum(over.sum(axis=1))])[:-1]
    index = b"".join([low.astype("<u4").tobytes(), width.astype("u1").tobytes(), start[:-1].astype("<u4").tobytes(), first.astype("<u4").tobytes()])
    return blocks, len(rows), b"".join([index, struct.pack("<q", len(payload)), payload.astype("<u8").tobytes(), places.astype("u1").tobytes(), high.astype("<u4").tobytes()])


def unpack_ids(n: int, blocks: int, exceptions: int, data: memoryview) -> np.ndarray:
    """The inverse of pack_ids."""
    if not blocks:
        return np.zeros(0, np.uint32)
    at = 0

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    low, width, start, first = take("<u4", blocks), take("u1", blocks), take("<u4", blocks), take("<u4", blocks)
    payload = take("<u8", int(take("<i8", 1)[0]))
    places, high = take("u1", exceptions), take("<u4", exceptions)
    v = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            k = np.flatnonzero(width == w)
            v[k] = _unpack(payload[start[k].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 64))], int(w))
    rows = np.repeat(np.arange(blocks), np.diff(np.append(first.astype(np.int64), exceptions)))
    v[rows, places] |= high.astype(np.uint64) << width[rows].astype(np.uint64)
    return (v + low[:, None].astype(np.uint64)).reshape(-1)[:n].astype(np.uint32)


def pack_file(doc_ids: list[int | None], counts: np.ndarray | list[int], ids: np.ndarray) -> bytes:
    """One file of the format."""
    blocks, exceptions, data = pack_ids(ids)
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + np.array(counts, "<i8").tobytes()
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), blocks, exceptions) + docs + data


def unpack_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, numbers of ids, and ids of a file."""
    magic, docs, n, blocks, exceptions = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a file of this format")
    at = HEAD.size
    keys = np.frombuffer(raw, "<i8", docs, at)
    nulls = np.frombuffer(raw, "u1", docs, at + 8 * docs)
    counts = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
    ids = unpack_ids(n, blocks, exceptions, memoryview(raw)[at + 17 * docs :])
    return [None if z else int(k) for k, z in zip(keys, nulls, strict=True)], counts, ids


# ---- files ----------------------------------------------------------------------------------------------------------
def write_store(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Write the files and return their table: part, seq, docs, ids, before (ids before the file in its part), data."""
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    # rows equal in both are interchangeable; a number of their place lets ranges part them
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order[:2], "tie").sortWithinPartitions(*order).drop("tie")

    def run(batches):
        from pyspark import TaskContext

        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        keys: list = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def file():
            nonlocal seq, before, held, keys, counts, parts
            data = pack_file(keys, np.concatenate(counts), np.concatenate(parts))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([before], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "docs", "ids", "before", "data"])
            seq, before, held, keys, counts, parts = seq + 1, before + held, 0, [], [], []
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, ids, n_ids in encode_array(batch.column(1), path):
                keys += names[i:j]
                counts.append(n_ids + 1)
                parts.append(np.insert(ids, np.cumsum(n_ids), END))
                held += len(parts[-1])
                if held >= FILE_IDS:
                    yield file()
        if keys:
            yield file()

    return materialize(rows.mapInArrow(run, "part int, seq int, docs bigint, ids bigint, before bigint, data binary"), "pfor-files")


def read_store(files: DataFrame, ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    spark = files.sparkSession
    totals = files.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()  # a row for each partition written
    offset, at = {}, 0
    for r in totals:
        offset[r["part"]] = at
        at += r["ids"]
    shared = spark.sparkContext.broadcast(offset)
    more = ", ids array<bigint>" if ids else ""

    def run(batches):
        for batch in batches:
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                keys, counts, flat = unpack_file(data.as_py())
                ends = np.cumsum(counts)
                begins = ends - counts
                raw = memoryview(flat.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(keys, pa.int64()), pa.array(begins + (shared.value[part] + before), pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.array([flat[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return files.select("part", "before", "data").mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint{more}")


def op10_pfor_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(write_store(table(spark, sf_dir, "documents")))
