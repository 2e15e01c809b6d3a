from corpusloom.functions import text as T
from corpusloom.sources import converters as C


def one(spark, name, row, ddl):
    return C.convert(spark.createDataFrame([row], ddl), name).collect()[0]


NLI = "pairID string, promptID int, premise string, hypothesis string, label int"


def test_identities_and_splits(spark):
    """Every record has a group and a split; rows of the joined waves name what they share (values: tests/rule_sources.py)."""
    r = one(spark, "multinli", ("i", 4, "A <b>premise</b>", "h", 0), NLI)
    assert [k.split(":")[0] for k in r.identities] == ["context", "multinli-prompt", "multinli-id", "prompt"] and [k.split(":")[0] for k in r.checks] == ["context", "prompt"]
    other = one(spark, "multinli", ("j", 5, "a  PREMISE", "g", 1), NLI)
    assert r.identities[0] == other.identities[0] and r.identities[1] != other.identities[1]
    for name, row, ddl in (("gsm8k", ("q?", "a"), "question string, answer string"), ("snli", ("p", "h", 1), "premise string, hypothesis string, label int")):
        x = one(spark, name, row, ddl)
        assert len(x.group) == 64 and x.split in ("train", "dev") and x.original_split == "train" and x.identities is None
    tydi = one(spark, "tydiqa", ("english-1", "T", "aé bc", "q", (["bc"], [2])), "id string, title string, context string, question string, answers struct<text:array<string>,answer_start:array<int>>")
    assert tydi.original_answer_offsets_match is False and tydi.reason is None and any(k.startswith("base-group:") for k in tydi.checks)


def test_groups_of_the_first_wave(spark):
    import hashlib

    r = one(spark, "squad", ("i", "A_Title", "ctx", "q", (["x"],)), "id string, title string, context string, question string, answers struct<text:array<string>>")
    assert r.group == hashlib.sha256(b"article:A_Title").hexdigest()
    bucket = int(hashlib.sha256(b"pilot-v1:article:A_Title").hexdigest()[:8], 16) % 100
    assert r.split == ("dev" if bucket < 5 else "train")


def test_spider_schema(spark):
    schemas = spark.createDataFrame([("d", ["t", "u"], [(-1, "*"), (0, "a"), (1, "b")], ["text", "number", "text"], [[1, 2]])], "db_id string, table_names_original array<string>, column_names_original array<struct<t:int,c:string>>, column_types array<string>, foreign_keys array<array<int>>")
    rows = spark.createDataFrame([("d", "q", "SELECT 1")], "db_id string, question string, query string")
    r = C.convert(C.with_schema(rows, schemas), "spider").collect()[0]
    assert r.prompt == "Write a SQL query. Output SQL only.\n\nSchema:\nt(a number)\nu(b text)\nForeign keys: t.a = u.b\n\nQuestion: q"


def test_programs_by_syntax_tree(spark):
    import json

    d = spark.createDataFrame([("1", "1", "q", "", json.dumps(["print(1)", "print( 1 )", "def bad(", "print(2)"])), ("2", "2", "q2", "", "not json")], "id string, problem_id string, question string, starter_code string, solutions string")
    got = [(r.variant, r.answer) for r in C.apps(d).orderBy("variant").collect()]
    assert got == [(0, "print(1)"), (1, "print(2)")]


def test_normalizers_differ(spark):
    d = spark.createDataFrame([("  The ﬁne,  STRASSE ß ",)], "t string")
    r = d.select(T.normal("t").alias("a"), T.norm("t").alias("b"), T.qa("t").alias("c"), T.contract("t").alias("d")).collect()[0]
    assert (r.a, r.b, r.c, r.d) == ("the ﬁne, strasse ß", "the fine, strasse ss", "ﬁne strasse ß", "the fine, strasse ss")


def test_a_wave_is_one_pass(spark, sf):
    """Every source of a wave comes from the same reading of the documents."""
    from corpusloom.plans import adapters

    for name in ("records_of_first_wave", "records_of_second_wave", "records_of_broad_wave", "records_of_languages", "records_of_items"):
        plan = adapters.QUERIES[name][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and "pythonUDF" not in plan


def test_strip_and_words_as_the_patterns_have_them(spark):
    """strip_ends() and word_at() take for white space what the patterns take, for every character and at both ends."""
    from pyspark.sql import functions as F

    chars = spark.createDataFrame([(chr(i),) for i in range(0x11000) if not 0xD800 <= i < 0xE000], "x string")
    texts = chars.select(F.explode(F.array(F.col("x"), F.concat("x", F.lit("aé"), "x"), F.concat(F.lit("😀 b"), "x", "x"), F.concat("x", F.lit("\x1c 　c")))).alias("t"))
    assert texts.filter(~T.strip_ends("t").eqNullSafe(T.strip("t"))).count() == 0
    n = F.size(T.words("t", r"(?U)[^\s]+"))
    at = texts.crossJoin(spark.createDataFrame([(-1,), (0,), (1,), (2,), (40,)], "i int"))
    assert at.filter(~T.word_at("t", "i").eqNullSafe(F.col("i").between(0, n - 1))).count() == 0
    long = spark.createDataFrame([("a " * 200_000, 199_999), ("a " * 200_000, 200_000), ("", 0), (" 　", 0), ("a", 2**31 - 1), (None, 0), ("a", None)], "t string, i int")
    assert [r[0] for r in long.select(T.word_at("t", "i"), T.strip_ends("t")).collect()] == [True, False, False, False, False, None, None]
    marks = spark.createDataFrame([("a < b",), ("<pad>",), ("x<answer>y",), ("pad>",), ("",), (None,)], "t string")
    assert [r[0] for r in marks.select(T.has_control_token("t")).collect()] == [False, True, True, False, False, None]
