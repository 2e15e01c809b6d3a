"""Byte-level BPE: batch encoding and answer masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.bpe import encode_array


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_column(c, path: str | None = None) -> Column:
    """Token ids of a text column in Arrow batches; the file's path is a parameter, the file stays where it is."""
    path = path or default_tokenizer()

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        out: list = []
        for _, _, ids, counts in encode_array(pa.array(s, pa.string(), from_pandas=True), path):
            out += np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])
        return pd.Series(out, dtype=object)

    return run(F.col(c) if isinstance(c, str) else c)


#: Bytes of texts that are encoded at once where only the ids' number is asked for.
COUNT_BYTES = 1 << 20


def token_counts(c, path: str | None = None) -> Column:
    """The number of token ids of a text column; ids stay in the task, those of one small block at a time."""
    path = path or default_tokenizer()

    def run(texts: pa.Array) -> pa.Array:
        counts = [n for i in range(0, len(texts), 256) for *_, n in encode_array(texts.slice(i, 256), path, COUNT_BYTES)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int32())

    return F.arrow_udf(run, "int")(F.col(c) if isinstance(c, str) else c)


def answer_start(ids, answer_id: int) -> Column:
    """Place after the first answer token; the mask is 0 before it and 1 from there."""
    return F.array_position(ids, answer_id).cast("int")


def answer_mask(ids, start) -> Column:
    return F.transform(ids, lambda _, i: F.when(i >= start, 1).otherwise(0))


def one_delimiter(ids, answer_id: int) -> Column:
    """Exactly one answer delimiter."""
    return F.size(F.filter(ids, lambda x: x == answer_id)) == 1


def stream_digest(df: DataFrame, column: str, order: str) -> str:
    """Digest of a text column in order, as a digest of ordered row digests in two levels."""
    part = df.select(F.col(order).alias("o"), F.sha2(column, 256).alias("d")).withColumn("b", F.floor(F.col("o") / 10000))
    leaf = part.groupBy("b").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    import hashlib

    h = hashlib.sha256()
    for r in leaf.orderBy("b").toLocalIterator():
        h.update(r["d"].encode())
    return h.hexdigest()


def ordered_digest(df: DataFrame, column: str, order: str, block: int = 10_000) -> DataFrame:
    """(digest): one digest of a text column in the order of a number, in three levels, each made by Spark.

    Digests of rows are digested by blocks of `block` numbers, those by blocks of blocks, and the few that are left at once.
    """
    digests = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "d"))), lambda x: x["d"]), "")
    level = lambda d: d.groupBy(F.floor(F.col("o") / block).alias("b")).agg(F.sha2(digests, 256).alias("d")).select(F.col("b").alias("o"), "d")
    rows = df.select(F.col(order).cast("bigint").alias("o"), F.sha2(column, 256).alias("d"))
    return level(level(rows)).agg(F.sha2(digests, 256).alias("digest"))
