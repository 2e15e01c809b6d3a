"""Operator 7: mix sources to target weights by Poisson replication.

Each source s gets the mean repetition rate  rate_s = T * w_s / (W * n_s)  (T: rows wanted, n_s: rows of the
source). A document's count is the inverse of the Poisson distribution with that mean at a hash of
(seed, digest of the row, number among equal rows), so it depends neither on partitioning nor on retries; documents are
exploded by their counts and shuffled by a second hash of the same parts. Large means are drawn as sums of means of at most MAX_MEAN, which
is exact.

Defined cases: null source is a source of its own; rows that repeat a doc_id, or have none, are drawn and placed each by
all its columns; rows equal in every column are numbered, so that each is drawn and placed on its own; null text is not the
empty text; weight 0 or a source without weight drops its rows; an empty table gives an empty table; extra columns pass
through (names clash only with `copy` and `shuffle_key`, which are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import let

from .common import Scratch, drop_path, materialize, numbered, repeated, row_digest, rows_bounded, table

#: Poisson means above this are split into equal parts, each drawn on its own.
MAX_MEAN = 200.0
#: Sources up to which the rate table is broadcast; beyond it the join is salted and shuffled.
BROADCAST_SOURCES = 20_000
SALTS = 64


def _unit(*parts):
    """A number in [0, 1) with 52 bits from SHA-256 of the joined parts; bind it (let) where a lambda uses it."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def rate_table(docs: DataFrame, total_rows: int | None = None, weights: dict | None = None, power: float = 0.5) -> DataFrame:
    """(source_key, n, rate, parts, cdf) for each source; weights default to n ** power."""
    key = F.coalesce(F.col("source").cast("string"), F.lit("\u0000null"))
    stats = docs.groupBy(key.alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source_key") == ("\u0000null" if name is None else name), F.lit(float(value))).otherwise(w)
    stats = materialize(stats.withColumn("w", w), "mix-sources")
    total = stats.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    wanted, whole = float(total_rows if total_rows is not None else total["n"] or 0), float(total["w"] or 0.0)
    rate = F.lit(wanted) * F.col("w") / F.lit(whole or 1.0) / F.col("n")
    s = stats.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int"))
    s = s.withColumn("mean", F.col("rate") / F.col("parts"))
    s = s.withColumn("top", F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 24).cast("int"))
    # log of the probability, running sum and the sums so far
    start = F.struct((-F.col("mean")).alias("lp"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("all"))

    def grow(a, k):
        lp = a["lp"] + F.log(F.col("mean")) - F.log(k.cast("double"))
        c = a["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.concat(a["all"], F.array(c)).alias("all"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.col("top")), start, grow, lambda a: a["all"])
    return s.select("source_key", "n", "rate", "parts", F.when(F.col("mean") > 0, cdf).otherwise(F.array(F.lit(2.0))).alias("cdf"))


def mix_rows(docs: DataFrame, seed: str = "mix-1", total_rows: int | None = None, weights: dict | None = None, power: float = 0.5) -> DataFrame:
    """(row, copy, shuffle_key): each input row as a struct with its copy number (from 0) and its place in the order."""
    keep = Scratch()
    source = F.coalesce(F.col("source").cast("string"), F.lit("\u0000null"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("key"), row_digest(docs).alias("digest"))
    keys = keep(keyed.select("digest", F.col("row.source").alias("source")), "mix-keys")
    rates = materialize(rate_table(keys, total_rows, weights, power), "mix-rates")
    some = repeated(keys, keep)
    drop_path(keys)
    keyed = numbered(keyed, some).select("row", "key", F.concat_ws(":", "digest", F.col("k").cast("string")).alias("id"))
    r = rates.select(F.col("source_key").alias("key"), "parts", "cdf")
    if rows_bounded(rates, BROADCAST_SOURCES):
        joined = keyed.join(F.broadcast(r), "key")
    else:
        r = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(r, ["key", "salt"])
    one = lambda j: let(_unit(F.lit(seed), F.col("id"), j.cast("string")), lambda u: F.size(F.filter("cdf", lambda c: c <= u)))
    count = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda a, j: a + one(j))
    counted = joined.select("row", "id", count.alias("n")).filter("n > 0")
    out = counted.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("id"), F.col("copy").cast("string")), 256)
    out = out.select("row", "copy", F.conv(F.substring(order, 1, 15), 16, 10).cast("bigint").alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, seed: str = "mix-1", total_rows: int | None = None, weights: dict | None = None, power: float = 0.5) -> DataFrame:
    """mix_rows() with the columns of docs (less `copy` and `shuffle_key`, which are this operator's)."""
    return mix_rows(docs.drop("copy", "shuffle_key"), seed, total_rows, weights, power).select("row.*", "copy", "shuffle_key")


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mix(docs).select("doc_id", "source", "lang", "copy", "shuffle_key", "text")


SQL = """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS total, sum(w) AS whole FROM s),
r AS (SELECT source, total * w / whole / n AS rate FROM s, t),
p AS (SELECT source, rate, greatest(1, ceil(rate / 200.0))::INT AS parts, rate / greatest(1, ceil(rate / 200.0)) AS mean FROM r),
k AS (SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS pmf
      FROM (SELECT source, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 24)::BIGINT + 1)) AS k FROM p)),
c AS (SELECT source, k, sum(pmf) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
n AS (SELECT *, md5(concat_ws(':', coalesce(md5(doc_id::VARCHAR), 'null'), coalesce(md5(source), 'null'), coalesce(md5(lang), 'null'), coalesce(md5(text), 'null'))) AS digest FROM documents),
i AS (SELECT doc_id, source, lang, text, digest || ':' || (row_number() OVER (PARTITION BY digest) - 1) AS id FROM n),
u AS (SELECT id, d.source, ('0x' || substr(sha256('mix-1:' || id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM (SELECT i.*, unnest(range(0, parts)) AS j FROM i JOIN p USING (source)) d),
m AS (SELECT id, count(*) AS copies FROM u JOIN c ON c.source = u.source AND c.cdf <= u.u GROUP BY ALL),
x AS (SELECT id, unnest(range(0, copies))::INT AS copy FROM m)
SELECT doc_id, source, lang, copy, ('0x' || substr(sha256('mix-1:order:' || id || ':' || copy), 1, 15))::BIGINT AS shuffle_key, text FROM x JOIN i USING (id)
"""
