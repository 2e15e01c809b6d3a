"""Queries of readers, sinks, token stores and samplers: the tables written in each form, read back and computed on."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import tokens as K
from corpusloom.operators import audit, splits
from corpusloom.plans.corpus import REC_SQL, records
from corpusloom.session import table
from corpusloom.sources import ranges, readers, sinks
from corpusloom.storage import materialize, shared_dir

#: Documents by ranges of doc_id that share a file, and files that one task writes.
FILE_DOCS, TASK_FILES = 1000, 16


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusloom/files-{uuid4().hex}"


def _by_part(d: DataFrame) -> DataFrame:
    """Rows dealt by their file, `part`, so that a task has a few files at any size: files take time, not bytes, and tasks
    left to adaptive execution are joined by bytes until one task writes thousands of files."""
    files = d.select("part").distinct().count()
    return d.repartition(max(1, -(-files // TASK_FILES)), "part")


def _split(c):
    return T.split_of(c, "split-1:", 5)


SPLIT_SQL = "CASE WHEN ('0x' || substr(sha256('split-1:' || {0}), 1, 8))::BIGINT % 100 < 5 THEN 'dev' ELSE 'train' END"


# ---- readers and sinks ----------------------------------------------------------------------------------------------
def documents_as_json(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each side of a language written as JSON lines, both folders read as one table."""
    d, paths = table(spark, sf, "documents"), [_folder(spark), _folder(spark)]
    sinks.json_lines(d.filter("lang = 'en'"), paths[0])
    sinks.json_lines(d.filter("lang IS DISTINCT FROM 'en'"), paths[1])
    back = readers.json_lines(spark, paths, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


def documents_as_json_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of documents by id, one for each range of ids and file."""
    d, path = table(spark, sf, "documents"), _folder(spark)
    entry = F.struct(F.col("doc_id").cast("string"), F.struct("lang", "n_chars"))
    rows = _by_part(d.withColumn("part", F.floor(F.col("doc_id") / FILE_DOCS)))
    objects = rows.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    objects.write.partitionBy("part").text(path)
    return readers.json_objects(spark, path, "struct<lang:string,n_chars:bigint>")


def documents_as_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with quotes and line ends through CSV."""
    path = _folder(spark)
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\r", " ").alias("text"), "lang")
    d.write.option("header", True).option("escape", '"').csv(path)
    return readers.csv(spark, path, "doc_id BIGINT, text STRING, lang STRING").select("doc_id", "lang", F.md5("text").alias("digest"))


def numbered_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers of files of documents, each a range of ids."""
    path = _folder(spark)
    part = F.floor(F.col("doc_id") / FILE_DOCS)
    d = table(spark, sf, "documents").select("doc_id", part.alias("part"), F.to_json(F.struct("doc_id", "text")).alias("value"))
    _by_part(d).sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    lines = readers.numbered_text(spark, path)
    row = F.from_json("value", "doc_id BIGINT, text STRING")
    return lines.select(row["doc_id"].alias("doc_id"), F.md5(row["text"]).alias("digest"), F.regexp_extract("path", "part=(-?[0-9]+)", 1).cast("bigint").alias("part"), F.col("number").cast("bigint").alias("number"))


def paired_items(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and texts of the benchmark as two files, paired line by line."""
    d = table(spark, sf, "benchmark").coalesce(1).sortWithinPartitions("item_id")  # one file each; the table is fixed
    paths = [_folder(spark), _folder(spark)]
    d.select(F.col("item_id").cast("string").alias("value")).write.text(paths[0])
    d.select(T.collapse("text").alias("value")).write.text(paths[1])
    return readers.paired_lines(spark, *paths).select(F.col("left").cast("bigint").alias("item_id"), F.col("right").alias("text"), F.col("number").cast("bigint").alias("number"))


def events_in_a_broken_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log of which every tenth line is cut off; what parses is counted, what does not is too."""
    path = _folder(spark)
    line = F.to_json(F.struct("event_id", "event_type"))
    d = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value"))
    d.write.text(path)
    log = readers.log_lines(spark, path, "event_id BIGINT, event_type STRING")
    return log.groupBy(F.col("_corrupt").isNotNull().alias("broken"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def counted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by metadata, and one column as a set, from a table written here."""
    path = _folder(spark)
    table(spark, sf, "documents").write.parquet(path)
    names = readers.parquet(spark, path, ["source"]).distinct()
    return names.withColumn("rows", F.lit(readers.row_count(spark, path)).cast("bigint"))


def file_digests_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Text files of ranges of documents: their length and digest, and whether a manifest of the ids' own lines,
    in which ranges that hold a toxic document are wrong, says the same."""
    path = _folder(spark)
    part = F.floor(F.col("doc_id") / 100)
    d = table(spark, sf, "documents").select("doc_id", part.alias("part"), F.concat_ws(" ", F.col("doc_id").cast("string"), "lang", "source").alias("value"))
    _by_part(d).sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    files = ranges.file_digests(spark, path).select(F.regexp_extract("path", "part=(-?[0-9]+)", 1).alias("path"), "length", "sha256")
    files = materialize(files, "file-digests")  # read twice below
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit("!").alias("mark")).distinct()
    line = F.concat(F.col("value"), F.coalesce("mark", F.lit("")), F.lit("\n"))
    lines = d.join(toxic, "doc_id", "left").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("line")))).alias("lines"))
    manifest = lines.select(F.col("part").cast("string").alias("path"), F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), ""), 256).alias("sha256"))
    wrong = audit.digests_changed(files, manifest).select("path", F.lit(True).alias("changed"))
    return files.join(wrong, "path", "left").select("path", "length", "sha256", F.coalesce("changed", F.lit(False)).alias("changed"))


DIGESTS_SQL = """WITH f AS (SELECT d.doc_id, d.doc_id // 100 AS part, concat_ws(' ', d.doc_id::VARCHAR, lang, source) AS line, t.doc_id IS NOT NULL AS toxic
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = d.doc_id)
SELECT part::VARCHAR AS path, sum(strlen(line) + 1)::BIGINT AS length, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS sha256, bool_or(toxic) AS changed FROM f GROUP BY part"""


def bytes_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as flat files of bytes, read by ranges: how often each byte stands."""
    path = _folder(spark)
    table(spark, sf, "documents").select(F.concat_ws(" ", F.col("doc_id").cast("string"), "lang", "source", "text")).write.text(path)
    flat = ranges.flat_array(spark, path, "u1", chunk=1 << 16)
    counted = flat.select(F.explode("ids").alias("byte")).groupBy("byte").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("byte").cast("int").alias("byte"), "n")


# ---- token stores ---------------------------------------------------------------------------------------------------
#: The token that stands for the answer's begin: a word of nine letters.
DELIMITER = 9


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as ids: a token is the length of a word."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    d = records(spark, sf).select("source", _split("original_id").alias("split"), "ord", ids.alias("ids"))
    d = d.withColumn("answer_start", K.answer_start(F.col("ids"), DELIMITER)).withColumn("token_length", F.size("ids").cast("bigint"))
    return splits.offsets(d, ["source", "split"], "token_length", ["ord"])


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with answer place and running offset written as a store and read back; the mask is rebuilt."""
    path = _folder(spark)
    sinks.token_store(_encoded(spark, sf), path)
    back = readers.parquet(spark, path)
    mask = F.aggregate(K.answer_mask(F.col("ids"), F.col("answer_start")), F.lit(0), lambda a, x: a + x)
    return back.select("source", "split", "ord", "answer_start", "token_offset", "token_length", K.one_delimiter(F.col("ids"), DELIMITER).alias("one"), mask.alias("in_answer"))


STORED_SQL = f"""WITH {REC_SQL},
t AS (SELECT source, {SPLIT_SQL.format('original_id')} AS split, ord, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM rec),
a AS (SELECT *, coalesce(list_position(ids, 9), 0) AS place FROM t)
SELECT source, split, ord, place::INT AS answer_start, coalesce(sum(len(ids)) OVER (PARTITION BY source, split ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_offset,
       len(ids)::BIGINT AS token_length, len(list_filter(ids, lambda x: x = 9)) = 1 AS one, greatest(len(ids) - place, 0)::INT AS in_answer FROM a"""


def stored_ids_checked(spark: SparkSession, sf: str) -> DataFrame:
    """V6: stored records whose ids are not those of encoding anew, after the texts of toxic documents changed."""
    d = _encoded(spark, sf)
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("ord"), F.lit(True).alias("toxic")).distinct()
    again = d.join(toxic, "ord", "left").withColumn("ids", F.when(F.col("toxic"), F.reverse("ids")).otherwise(F.col("ids"))).withColumn("answer_start", K.answer_start(F.col("ids"), DELIMITER))
    return audit.mask_differs(d, again).select("source", "ord")


CHECKED_SQL = """WITH t AS (SELECT source, doc_id AS ord, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) USING (doc_id))
SELECT source, ord FROM t WHERE ids <> list_reverse(ids)"""


def partitioned_documents(spark: SparkSession, sf: str) -> DataFrame:
    """K2: documents written by source and split, read back."""
    path = _folder(spark)
    sinks.partitioned(table(spark, sf, "documents").withColumn("split", _split(F.col("doc_id").cast("string"))), path)
    return readers.parquet(spark, path).select("doc_id", "source", "split", F.md5("text").alias("digest"))


def parent_and_new_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents keep their places, the others follow; no place of the parent has changed."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.md5("text").alias("t"))
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("ord")).distinct()
    parent = d.join(known, "ord", "left_semi")
    child = sinks.parent_then_new(parent, d.join(known, "ord", "left_anti"))
    return child.join(audit.prefix_changed(parent, child, "ord", "t").select("ord"), "ord", "left_anti")


PARENT_SQL = """WITH d AS (SELECT doc_id AS ord, md5(text) AS t, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents)
SELECT CASE WHEN known THEN ord ELSE ord + 1 + (SELECT max(ord) FROM d WHERE known) END AS ord, t FROM d"""


def changed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """V4: places whose document a child without the toxic ones and with lower-case texts does not hold as it was."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("ord"))
    child = d.join(toxic, "ord", "left_anti").withColumn("text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return audit.prefix_changed(d, child, "ord", "text").select("ord", F.col("got").isNull().alias("gone"))


CHANGED_SQL = """SELECT doc_id AS ord, t AS gone FROM (SELECT doc_id, text, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS t FROM documents)
WHERE t OR regexp_matches(text, '[A-Z]')"""


# ---- samplers -------------------------------------------------------------------------------------------------------
ROWS = 2000


def weighted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of at most 1,025 words sampled from sources by weight, the square root of their documents rounded up."""
    d = records(spark, sf).select("source", "ord", F.split("text", " ").alias("ids")).withColumn("answer_start", F.lit(0))
    weights = d.groupBy("source").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("weight"))
    held = splits.sample_rows(d, weights, ROWS)
    return held.groupBy("row", "source").agg(F.max("used").cast("bigint").alias("used"), F.count(F.lit(1)).alias("n_records"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("draw", "ord"))), lambda x: x["ord"].cast("string")), ",").alias("records"))


WEIGHTED_SQL = f"""WITH f AS (SELECT source, doc_id AS ord, len(string_split(text, ' ')) AS n FROM documents),
w AS (SELECT source, ceil(sqrt(count(*)))::DOUBLE AS w FROM f GROUP BY source),
p AS (SELECT source, round(w / sum(w) OVER () * {1 << 40})::BIGINT AS parts FROM w),
e AS (SELECT source, sum(parts) OVER (ORDER BY source) - parts AS low, sum(parts) OVER (ORDER BY source) AS high, sum(parts) OVER () AS total FROM p),
r AS (SELECT row, ('0x' || substr(sha256('pack-1:row:' || row), 1, 13))::BIGINT AS h FROM (SELECT unnest(range(0, {ROWS})) AS row)),
c AS (SELECT row, source FROM r JOIN e ON h % total >= low AND h % total < high),
g AS (SELECT source, ord, n, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS place, count(*) OVER (PARTITION BY source) AS many FROM f WHERE n <= 1025),
t AS (SELECT DISTINCT source, many FROM g),
d AS (SELECT c.row, c.source, draw, ('0x' || substr(sha256('pack-1:' || c.source || ':' || c.row || ':' || draw), 1, 12))::BIGINT % many AS place
      FROM c JOIN t USING (source), (SELECT unnest(range(0, 128)) AS draw)),
m AS (SELECT d.*, ord, n, sum(n) OVER (PARTITION BY row ORDER BY draw) AS upto FROM d JOIN g USING (source, place))
SELECT row::INT AS row, source, sum(n)::BIGINT AS used, count(*) AS n_records, string_agg(ord::VARCHAR, ',' ORDER BY draw) AS records FROM m WHERE upto <= 1025 GROUP BY row, source"""


HELD_OUT, LABELS = ("dev", "confirmation"), ("even", "odd")


def balanced_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the three smallest languages as sources, moved until each label (of even or odd length) is in each held-out split."""
    rank = F.sha2(F.concat(F.lit("balance:"), F.col("doc_id").cast("string")), 256)
    split = T.split_of(F.col("doc_id").cast("string"), "split-1:", 5, 5)
    label = F.when(F.length("text") % 2 == 0, "even").otherwise("odd")
    d = table(spark, sf, "documents").select(F.col("lang").alias("source"), F.col("doc_id").cast("string").alias("group"), split.alias("split"), F.array(label).alias("labels"), rank.alias("rank"))
    return splits.balance(d.join(splits.small_sources(d), "source", "left_semi"))


def _balance_sql() -> str:
    b = SPLIT_SQL.format("doc_id::VARCHAR").replace("< 5 THEN 'dev' ELSE 'train' END", "")
    bucket = b.removeprefix("CASE WHEN ")
    steps, last = [], "g0"
    for split in HELD_OUT:
        for label in LABELS:
            new = f"g{len(steps) + 1}"
            steps.append(f"""{new} AS (SELECT x.* REPLACE (CASE WHEN x.split = 'train' AND x."group" = m."group" THEN '{split}' ELSE x.split END AS split) FROM {last} x LEFT JOIN
  (SELECT source, arg_min("group", (rank, "group")) FILTER (split = 'train') AS "group" FROM {last} WHERE label = '{label}' GROUP BY source HAVING count(*) FILTER (split = '{split}') = 0) m USING (source))""")
            last = new
    return f"""WITH d AS (SELECT lang AS source, doc_id::VARCHAR AS "group", CASE WHEN {bucket} < 5 THEN 'dev' WHEN {bucket} < 10 THEN 'confirmation' ELSE 'train' END AS split, CASE WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS label, sha256('balance:' || doc_id) AS rank FROM documents),
g0 AS (SELECT * FROM d WHERE source IN (SELECT source FROM d GROUP BY source ORDER BY count(*), source LIMIT 3)), {', '.join(steps)} SELECT source, "group", split FROM {last}"""


def published_counts(spark: SparkSession, sf: str) -> DataFrame:
    """K6, K8: counts of documents published twice; the second time nothing is written."""
    path = _folder(spark)
    counts = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    wrote = [sinks.publish_table(counts, path), sinks.publish_table(counts, path)]
    return readers.parquet(spark, path).withColumn("writes", F.lit(sum(wrote)))


QUERIES = {
    "balanced_sources": (balanced_sources, _balance_sql()),
    "published_counts": (published_counts, "SELECT source, lang, count(*) AS n, 1 AS writes FROM documents GROUP BY ALL"),
    "documents_as_json": (documents_as_json, "SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents"),
    "documents_as_json_objects": (documents_as_json_objects, "SELECT doc_id::VARCHAR AS key, lang, n_chars FROM documents"),
    "documents_as_csv": (documents_as_csv, "SELECT doc_id, lang, md5(replace(text, chr(13), ' ')) AS digest FROM documents"),
    "numbered_documents": (numbered_documents, f"SELECT doc_id, md5(text) AS digest, doc_id // {FILE_DOCS} AS part, row_number() OVER (PARTITION BY doc_id // {FILE_DOCS} ORDER BY doc_id) - 1 AS number FROM documents"),
    "paired_items": (paired_items, "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, row_number() OVER (ORDER BY item_id) - 1 AS number FROM benchmark"),
    "events_in_a_broken_log": (events_in_a_broken_log, "SELECT event_id % 10 = 0 AS broken, CASE WHEN event_id % 10 <> 0 THEN event_type END AS event_type, count(*) AS n, sum(CASE WHEN event_id % 10 <> 0 THEN event_id END)::BIGINT AS ids FROM events GROUP BY ALL"),
    "counted_documents": (counted_documents, "SELECT DISTINCT source, (SELECT count(*) FROM documents) AS rows FROM documents"),
    "bytes_of_documents": (bytes_of_documents, "SELECT ('0x' || b)::INT AS byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(concat_ws(' ', doc_id::VARCHAR, lang, source, text) || chr(10)), '..')) AS b FROM documents) GROUP BY b"),
    "file_digests_of_documents": (file_digests_of_documents, DIGESTS_SQL),
    "stored_documents": (stored_documents, STORED_SQL),
    "stored_ids_checked": (stored_ids_checked, CHECKED_SQL),
    "partitioned_documents": (partitioned_documents, f"SELECT doc_id, source, {SPLIT_SQL.format('doc_id::VARCHAR')} AS split, md5(text) AS digest FROM documents"),
    "parent_and_new_documents": (parent_and_new_documents, PARENT_SQL),
    "changed_documents": (changed_documents, CHANGED_SQL),
    "weighted_rows": (weighted_rows, WEIGHTED_SQL),
}
