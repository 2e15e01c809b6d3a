"""Five operators in a row over documents: each stage is a table that the next one reads.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import minhash_join, pii, piece_codec, poisson_mix, quality_rules
from corpusloom.llm.common import drop_path, materialize, table


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the length of its text, where it has that column."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more).

    Equal rows (one doc_id with one text) are one document; rows without doc_id stay.
    """
    kept = minhash_join.near_duplicates(docs, k=5, percent=80).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    some = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return some.unionByName(docs.filter("doc_id IS NULL"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in the order of the mixture."""
    return poisson_mix.mix_rows(docs).select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, and digests of what they decode to."""
    return piece_codec.encode(docs)


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("pii", private), ("poisson_mix", mixing), ("sentencepiece", pieces)]

#: SentencePiece encoding can't be stated in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_path(docs)  # the stage before, once this one is written; nothing for the input
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
