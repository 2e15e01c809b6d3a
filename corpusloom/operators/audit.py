"""Integrity checks as tables of violations: an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.grading import number


def shared_across(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """V1/U4: keys that more than one split holds."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(split).alias("first"), F.max(split).alias("last")).filter("first <> last")


def counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """A1: records, tokens, groups and over-long records of each (source, split)."""
    return df.groupBy("source", "split").agg(F.count(F.lit(1)).alias("records"), F.sum(tokens).alias("tokens"), F.countDistinct("group").alias("groups"), F.count_if(F.col(tokens) > 1024).alias("excluded_over_1024"))


def counts_differ(actual: DataFrame, manifest: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that one side lacks or that differ in a value."""
    a = actual.select(*keys, F.struct(*values).alias("actual"))
    m = manifest.select(*keys, F.struct(*values).alias("manifest"))
    return a.join(m, keys, "full_outer").filter(~F.col("actual").eqNullSafe(F.col("manifest")))


def unreconciled(raw: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """Sources whose kept and rejected rows do not add up to the raw ones."""
    one = lambda d, c: d.groupBy("source").agg(F.count(F.lit(1)).alias(c))
    j = one(raw, "raw").join(one(kept, "kept"), "source", "full_outer").join(one(rejected, "rejected"), "source", "full_outer").na.fill(0, ["raw", "kept", "rejected"])
    return j.filter("raw <> kept + rejected")


def prefix_changed(parent: DataFrame, child: DataFrame, ordinal: str, content: str) -> DataFrame:
    """V4: parent rows that the child does not hold at the same place with the same content."""
    return parent.select(ordinal, F.col(content).alias("want")).join(child.select(ordinal, F.col(content).alias("got")), ordinal, "left").filter(~F.col("want").eqNullSafe(F.col("got")))


def files_changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose SHA-256 is not the manifest's; files: (path, content) of a binary scan."""
    got = files.select("path", F.sha2("content", 256).alias("got"))
    return manifest.select("path", "sha256").join(got, "path", "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("got")))


def digests_changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose SHA-256 is not the manifest's, from (path, sha256) of either; works on files of any size."""
    return manifest.select("path", "sha256").join(files.select("path", F.col("sha256").alias("got")), "path", "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("got")))


def content_key(prompt: str = "prompt", answer: str = "answer") -> Column:
    """V8: digest of prompt, a zero character, answer."""
    return F.sha2(F.concat(F.col(prompt), F.lit("\0"), F.col(answer)), 256)


def held_out_overlap(df: DataFrame) -> DataFrame:
    """V8: contents that more than one of train, dev, confirmation holds."""
    return shared_across(df.withColumn("content", content_key()), "content")


def absent_from(suite: DataFrame, partition: DataFrame, keys: list[str]) -> DataFrame:
    """Suite rows without an equal row in their partition."""
    return suite.join(partition.select(*keys).distinct(), keys, "left_anti")


def lost_classes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, label) of before that after has not; labels is an array column."""
    one = lambda d: d.select("source", F.explode("labels").alias("label")).distinct()
    return one(before).join(one(after), ["source", "label"], "left_anti")


def wrong_weights(weights: DataFrame) -> DataFrame:
    """Families whose weight is not an equal share (a row `*` if the sum is not 1)."""
    fam = weights.groupBy("family").agg(F.sum("weight").alias("weight"))
    n = fam.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("s")).first()
    share = 1.0 / n["n"] if n["n"] else 0.0
    bad = fam.filter(F.abs(F.col("weight") - share) > 1e-9)
    whole = fam.agg(F.lit("*").alias("family"), F.sum("weight").alias("weight")).filter(F.abs(F.col("weight") - 1.0) > 1e-9)
    return bad.unionByName(whole)


def bad_locks(lock: DataFrame) -> DataFrame:
    """Lock rows that are not train, name a test file, leave the folder, or have no digest."""
    p = F.lower("path")
    reason = (
        F.when(F.col("original_split") != "train", "split")
        .when(p.rlike(r"(^|[^a-z])(test|validation|valid|dev)([^a-z]|$)"), "held-out file")
        .when(F.col("path").rlike(r"(^/)|(^|/)\.\.(/|$)"), "path escape")
        .when(~p.contains("train"), "not a train file")
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest")
    )
    return lock.withColumn("violation", reason).filter("violation IS NOT NULL")


def empty_partitions(df: DataFrame, splits=("train", "dev")) -> DataFrame:
    """(source, split) without rows."""
    want = df.select("source").distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    return want.join(df.select("source", "split").distinct(), ["source", "split"], "left_anti")


def order_differs(a: DataFrame, b: DataFrame, pos: str, key: str) -> DataFrame:
    """Places where two ordered lists differ or one ends."""
    j = a.select(pos, F.col(key).alias("left")).join(b.select(pos, F.col(key).alias("right")), pos, "full_outer")
    return j.filter(~F.col("left").eqNullSafe(F.col("right")))


def answer_kinds(contexts: DataFrame, tokens: Column, limit: int = 1024) -> DataFrame:
    """(kind, value, n) of a screened source whose rows hold arrays of questions (answer_type, scale).

    Kinds: answer_type and scale with their counts, and totals: questions, contexts, and questions whose `tokens` (a
    Column over the exploded question `q`) are within the limit.
    """
    q = contexts.select("*", F.explode("questions").alias("q")).withColumn("tokens", tokens)
    counts = [q.groupBy(F.lit(k).alias("kind"), F.col(f"q.{k}").alias("value")).agg(F.count(F.lit(1)).alias("n")) for k in ("answer_type", "scale")]
    whole = q.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("tokens") <= limit).alias("within"))
    unpivot = lambda d: d.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in d.columns]), F.array(*d.columns))).alias("value", "n")).select(F.lit("total").alias("kind"), "value", "n")
    groups = contexts.agg(F.count(F.lit(1)).alias("contexts"))
    return counts[0].unionByName(counts[1]).unionByName(unpivot(whole)).unionByName(unpivot(groups))


def campaign_totals(files: DataFrame) -> DataFrame:
    """Rows, bytes and sources of collected files (source, rows, bytes)."""
    return files.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.countDistinct("source").alias("sources"))


def bag_equal(a: DataFrame, b: DataFrame) -> bool:
    """The same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def bag_differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side holds more often, with `extra` (above 0: the left side)."""
    marked = a.withColumn("extra", F.lit(1)).unionByName(b.withColumn("extra", F.lit(-1)))
    return marked.groupBy(*a.columns).agg(F.sum("extra").alias("extra")).filter("extra <> 0")


def set_differs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def raw_labels_differ(kept: DataFrame, raw: DataFrame) -> DataFrame:
    """Kept rows whose answer is in no raw reference of the same prompt; both: (prompt_key, answer_key)."""
    keys = ["prompt_key", "answer_key"]
    return kept.select(*keys, "original_id").distinct().join(raw.select(*keys).distinct(), keys, "left_anti")


def mask_differs(encoded: DataFrame, again: DataFrame) -> DataFrame:
    """V6: records whose stored ids or answer start are not those of encoding anew."""
    keys = ["source", "ord"]
    j = encoded.select(*keys, F.col("ids").alias("a"), F.col("answer_start").alias("s")).join(again.select(*keys, F.col("ids").alias("b"), F.col("answer_start").alias("t")), keys, "full_outer")
    return j.filter(~(F.col("a").eqNullSafe(F.col("b")) & F.col("s").eqNullSafe(F.col("t"))))


def duplicate_identity(tasks: DataFrame, keys=("source", "id")) -> DataFrame:
    """P8."""
    return tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def bad_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with an unknown kind, too few or many choices or a blank one, a reference outside them or of another
    form, or an empty prompt."""
    n = F.coalesce(F.size("choices"), F.lit(0))
    reason = (
        F.when(~F.col("kind").isin("choice", "number", "text", "external", "legacy_proxy"), "kind")
        .when(F.trim(F.coalesce("prompt", F.lit(""))) == "", "prompt")
        .when((F.col("kind") == "choice") & (~n.between(2, 26) | F.exists("choices", lambda x: F.trim(x) == "")), "choices")
        .when((F.col("kind") == "choice") & ~F.coalesce((F.length("reference") == 1) & (F.ascii("reference") - 65).between(0, n - 1), F.lit(False)), "reference")
        .when((F.col("kind") != "external") & F.col("reference").isNull(), "reference")
        .when((F.col("kind") == "number") & number(F.col("reference")).isNull(), "reference")
    )
    return tasks.withColumn("violation", reason).filter("violation IS NOT NULL")


def rejections(df: DataFrame) -> DataFrame:
    """Rejected rows by source, reason and language."""
    return df.filter("reason IS NOT NULL").groupBy("source", "reason", "language").agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, by: list[str], length: str, limit: int = 1024) -> DataFrame:
    """A3: number, number within the limit, exact median and 95th percentile, largest."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(length) <= limit).alias("within"), F.expr(f"percentile({length}, 0.5)").alias("median"), F.expr(f"percentile({length}, 0.95)").alias("p95"), F.max(length).alias("largest"))
