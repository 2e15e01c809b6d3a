"""Text functions as Columns: four normalizers, digests, buckets, keys, extractors and cleaners.

The four normalizers are different on purpose:
    normal    white space to one space, trimmed, lower case
    norm      NFKC, casefold, white space to one space (needs Python; an Arrow UDF)
    qa        lower case, ASCII punctuation dropped, articles dropped, white space to one space
    contract  trimmed, casefold, white space to one space
"""

from __future__ import annotations

import ast
import hashlib
import html
import string
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

SPACE = r"(?U)\s+"
#: What `(?U)\s` and `\x1c-\x1f` match.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x1c\x1d\x1e\x1f"
#: Everything that ends a line, as str.splitlines() has it.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Control tokens of the record template and the template's parts.
CONTROL_TOKENS = ["<pad>", "<bos>", "<eos>", "<question>", "<answer>"]
PROMPT_HEAD, ANSWER_HEAD, RECORD_END = "<bos><question>\n", "\n<answer>\n", "<eos>\n"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c, body) -> Column:
    """body(x) with x bound to c once a row; without it an expression inside a lambda is computed for each element."""
    return F.get(F.transform(F.array(_col(c)), body), 0)


def strip(c) -> Column:
    """The text without outer white space of any kind."""
    return F.regexp_replace(_col(c), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def strip_ends(c) -> Column:
    """strip() of a long text that is cheap to name, as it stands here four times: trimming reads all of a text, so only those
    that begin or end with white space are trimmed. The last character stands in the last four bytes."""
    t, spaces, one = _col(c), F.lit(SPACES), F.lit(1)
    last = F.right(F.substring(t.cast("binary"), -4, 4).cast("string"), one)
    return F.when(F.contains(spaces, F.left(t, one)) | F.contains(spaces, last), F.btrim(t, spaces)).otherwise(t)


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), SPACE, " "))


def normal(c) -> Column:
    return F.lower(collapse(c))


@F.pandas_udf(StringType())
def _norm(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def norm(c) -> Column:
    return _norm(_col(c))


@F.pandas_udf(ArrayType(StringType()))
def norm_all(s: pd.Series) -> pd.Series:
    """norm of every text of an array."""
    return s.map(lambda ts: None if ts is None else [None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in ts])


#: Texts that stand in Python's memory at once, of a batch that may hold thousands.
STEP = 256


@F.arrow_udf(StringType())
def _fold(s: pa.Array) -> pa.Array:
    fold = lambda part: pa.array([None if t is None else t.casefold() for t in part.to_pylist()], pa.string())
    return pa.concat_arrays([fold(s.slice(i, STEP)) for i in range(0, max(len(s), 1), STEP)])


def casefold(c) -> Column:
    return _fold(_col(c))


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(t.casefold().split()))


def contract(c) -> Column:
    return _casefold(_col(c))


def qa(c) -> Column:
    bare = F.translate(F.lower(_col(c)), string.punctuation, "")
    return collapse(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def digest(c) -> Column:
    """Lower-case SHA-256 of the UTF-8 bytes."""
    return F.sha2(_col(c), 256)


def bucket(hexdigest) -> Column:
    """The first 32 bits of a hex digest, mod 100."""
    return F.conv(F.substring(_col(hexdigest), 1, 8), 16, 10).cast("bigint") % 100


def split_of(c, salt: str, dev: int = 5, confirmation: int = 0) -> Column:
    """train, dev or confirmation by the bucket of salt and text; dev and confirmation take the first buckets."""
    b = bucket(digest(F.concat(F.lit(salt), _col(c))))
    out = F.when(b < dev, "dev")
    if confirmation:
        out = out.when(b < dev + confirmation, "confirmation")
    return out.otherwise("train")


def key(kind: str, c) -> Column:
    """An identity key: its kind and the digest of the text."""
    return F.concat(F.lit(kind + ":"), digest(c))


def text_of(prompt, answer) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), _col(prompt), F.lit(ANSWER_HEAD), _col(answer), F.lit(RECORD_END))


def has_control_token(c) -> Column:
    """Texts without `<`, told by their bytes, never meet the pattern."""
    return F.contains(_col(c), F.lit("<")) & _col(c).rlike("<(pad|bos|eos|question|answer)>")


def words(c, pattern: str = r"[^\s]+") -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"({pattern})"), F.lit(1))


def word_at(c, i) -> Column:
    """Whether the text has a word of that number, from 0; what follows that word is not read."""
    return (_col(i) >= 0) & F.rlike(_col(c), F.concat(F.lit(r"(?U)\A\s*+(?:[^\s]++\s++){"), _col(i).cast("string"), F.lit(r"}+[^\s]")))


def shingle_keys(ws, k: int = 5) -> Column:
    """Distinct 16-hex keys of the k-word shingles of an array of words; none for shorter arrays."""

    def keys(w):
        one = lambda i: F.substring(F.sha2(F.array_join(F.array(*[F.get(w, i + j) for j in range(k)]), " "), 256), 1, 16)
        return F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), one))).otherwise(F.array().cast("array<string>"))

    return let(ws, keys)


#: Bytes of texts as words have them: ASCII letters in lower case, digits and underscores; of other ASCII, spaces.
_WORD_BYTES = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256))
#: Shingles whose bytes stand in Python's memory at once.
SHINGLES = 1 << 16


def packed_shingle_keys(text: bytes | None, k: int = 5) -> bytes:
    """shingle_keys() of the words of a text's word_bytes(), sorted, 8 bytes each: hashed in a task's Python, in less than half the
    time of an expression for each shingle."""
    text = text or b""
    words = b" ".join(text.translate(_WORD_BYTES).split())
    ends = np.append(np.flatnonzero(np.frombuffer(words, np.uint8) == 32), len(words))
    starts = np.append(0, ends[:-1] + 1)[: max(len(ends) - k + 1, 0)]
    keys = [np.empty(0, np.uint64)]
    for i in range(0, len(starts), SHINGLES):
        some = starts[i : i + SHINGLES].tolist()
        shingles = [words[a:b] for a, b in zip(some, ends[i + k - 1 : i + k - 1 + len(some)].tolist(), strict=True)]
        digests = b"".join([hashlib.sha256(x).digest() for x in shingles])
        keys.append(np.frombuffer(digests, ">u8")[::4].astype(np.uint64))
    return np.unique(np.concatenate(keys)).astype(">u8").tobytes()


def word_bytes(c) -> Column:
    """Bytes of a text for packed_shingle_keys(); a text beyond ASCII comes in lower case with its words `[\\p{L}\\p{N}_]+` told."""
    t = _col(c)
    told = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_]+", " ")
    return F.when(F.octet_length(t) > F.length(t), told).otherwise(t).cast("binary")


def bottom(keys, n: int = 16) -> Column:
    return F.slice(F.array_sort(_col(keys)), 1, n)


def jaccard(a, b) -> Column:
    a, b = _col(a), _col(b)
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def between(c, begin: str, end: str) -> Column:
    """The text between the first begin and the next end; null where either is missing."""
    t = _col(c)
    at = F.instr(t, begin)
    rest = F.substring(t, at + len(begin), F.length(t))
    stop = F.instr(rest, end)
    return F.when((at > 0) & (stop > 0), F.substring(rest, F.lit(1), stop - 1))


def section(c, begin: str, end: str) -> Column:
    """What follows the first begin, up to the next end (or the text's end); null without begin."""
    t = _col(c)
    return F.when(F.contains(t, F.lit(begin)), F.substring_index(F.substring(t, F.instr(t, begin) + len(begin), F.length(t)), end, 1))


def after_blank(c) -> Column:
    """What follows the first blank line; the whole text without one."""
    return F.coalesce(section(c, "\n\n", "\x00"), _col(c))


def context_key(c, markers: list[tuple[str, str]]) -> Column:
    """digest of the normal text between the first marker pair that is present; null without one."""
    return digest(normal(F.coalesce(*[between(c, a, b) for a, b in markers])))


def question_of(c) -> Column:
    """The line after the last `Question: `, else the first line after the first blank line (or of the text)."""
    t = _col(c)
    last = F.substring_index(F.substring_index(t, "Question: ", -1), "\n", 1)
    return F.when(F.contains(t, F.lit("Question: ")), last).otherwise(F.substring_index(after_blank(t), "\n", 1))


#: Where the context stands in prompts, and in those of the later sources.
CONTEXTS = [("Passage: ", "\n\nQuestion:"), ("Premise: ", "\nHypothesis:"), ("Context: ", "\n\nQuestion:"), ("Background: ", "\nSituation:")]
LATER_CONTEXTS = [("Dialogue:\n", "\n\nQuestion:"), ("First: ", "\nSecond:"), ("Second: ", "\x00"), ("Comment: ", "\x00")]


def keys_of(named: list[tuple[str, Column]]) -> Column:
    """Identity keys of (kind, text), by norm(); texts that are null have none."""
    return _keys([k for k, _ in named], [t for _, t in named])


def _keys(kinds: list[str], texts: list[Column]) -> Column:
    named = F.zip_with(F.array(*[F.lit(k) for k in kinds]), norm_all(F.array(*texts)), lambda k, t: F.concat(k, F.lit(":"), digest(t)))
    return F.array_compact(named)


def old_keys(prompt, group, title) -> Column:
    """a row's overlap keys: its prompt, group, contexts, question and article."""
    p, article = _col(prompt), F.when(_col(title) != "", _col(title))
    keys = _keys(["prompt", *["context"] * len(CONTEXTS), "question", "article"], [p, *[section(p, a, b) for a, b in CONTEXTS], question_of(p), article])
    return F.concat(keys, F.array(F.concat(F.lit("base-group:"), _col(group))))


def extra_old_keys(prompt, source) -> Column:
    """overlap keys of prompts of the later sources: contexts without mark-up, dialogues without speakers, questions."""
    p = _col(prompt)
    asked = F.when((_col(source) == "triviaqa") & F.contains(p, F.lit("Question: ")), F.substring_index(p, "Question: ", -1))
    parts = [section(p, a, b) for a, b in LATER_CONTEXTS]
    return _keys(["context", *["context"] * len(parts), "dialogue-content"], [asked, *[clean(x) for x in parts], spoken(parts[0])])


def question_core(prompt, source) -> Column:
    """the question of a prompt, without instruction, starter code, options and interface."""
    body = F.substring_index(after_blank(prompt), "\n\nRequired function name:", 1)
    body = F.substring_index(body, "Question: ", -1)
    body = F.when(_col(source) == "arc", F.substring_index(body, "\n", 1)).otherwise(body)
    return F.substring_index(F.substring_index(body, "\n\nStarter code:", 1), "\nOptions:", 1)


def task_core(prompt) -> Column:
    """The statement of a code task: what follows the instruction, without starter code and interface."""
    return F.substring_index(F.substring_index(after_blank(prompt), "\n\nStarter code:", 1), "\n\nRequired function name:", 1)


def spoken(c) -> Column:
    """A dialogue (also with written line ends) without the speaker before each line, its lines joined by spaces."""
    lines = F.split(F.replace(_col(c), F.lit("\\n"), F.lit("\n")), LINE_ENDS)
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^[^:\n]{1,60}:\s*", "")), " ")


def dialogue_key(c) -> Column:
    """F8: key of a dialogue's words, whoever speaks them."""
    return key("dialogue-content", norm(spoken(c)))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def strip_tags(c) -> Column:
    return F.regexp_replace(_col(c), r"<[^>]+>", " ")


def clean(c) -> Column:
    """Tags to spaces, entities to characters."""
    return _unescape(strip_tags(c))


@F.pandas_udf(StringType())
def code_key(s: pd.Series) -> pd.Series:
    """SHA-256 of the program's syntax tree; null where it does not parse."""

    def one(t):
        try:
            return None if t is None else hashlib.sha256(ast.dump(ast.parse(t)).encode()).hexdigest()
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None

    return s.map(one)


@F.pandas_udf(StringType())
def called_name(assertion: pd.Series, program: pd.Series) -> pd.Series:
    """The first name that an assertion calls and the program defines."""

    def one(a, p):
        try:
            defined = {n.name for n in ast.walk(ast.parse(p)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)}
            calls = [n for n in ast.walk(ast.parse(a)) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)]
            return next((n.func.id for n in sorted(calls, key=lambda n: (n.lineno, n.col_offset)) if n.func.id in defined), None)
        except (SyntaxError, ValueError, TypeError, RecursionError):
            return None

    return pd.Series([one(a, p) for a, p in zip(assertion, program, strict=True)], dtype=object)


def with_interface(rows: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Rows with the function name that their task requires appended to the prompt; interfaces: (source,
    original_id, name). Rows without one stay as they are."""
    named = interfaces.filter("name IS NOT NULL").groupBy("source", "original_id").agg(F.min("name").alias("__name"))
    add = F.coalesce(F.concat(F.lit("\n\nRequired function name: "), F.col("__name")), F.lit(""))
    return rows.join(named, ["source", "original_id"], "left").withColumn("prompt", F.concat("prompt", add)).drop("__name")


def word_bag(c) -> Column:
    """The text's words in sorted order, one space between."""
    return F.array_join(F.array_sort(words(F.lower(_col(c)), r"[\p{L}\p{N}_]+")), " ")


def lettered(choices) -> Column:
    """Choices as lines `A. text`."""
    c = _col(choices)
    return F.array_join(F.transform(c, lambda x, i: F.concat(F.chr((i + 65).cast("bigint")), F.lit(". "), x)), "\n")


def letter_index(c) -> Column:
    return F.ascii(_col(c)) - 65


def sql_text(sel, agg, columns, ops, values, header) -> Column:
    """A one-table SELECT with quoted names and values; null if the condition lists differ in length or point outside."""
    h = _col(header)
    name = lambda i: F.concat(F.lit('"'), F.replace(F.get(h, i), F.lit('"'), F.lit('""')), F.lit('"'))
    fn = F.get(F.array(*[F.lit(x) for x in ("", "MAX", "MIN", "COUNT", "SUM", "AVG")]), _col(agg))
    op = F.array(*[F.lit(x) for x in ("=", ">", "<")])
    target = F.when(fn == "", name(_col(sel))).otherwise(F.concat(fn, F.lit("("), name(_col(sel)), F.lit(")")))
    quoted = lambda v: F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))
    conds = F.transform(F.arrays_zip(_col(columns).alias("c"), _col(ops).alias("o"), _col(values).alias("v")), lambda x: F.concat(name(x["c"]), F.lit(" "), F.get(op, x["o"]), F.lit(" "), quoted(x["v"])))
    even = (F.size(_col(columns)) == F.size(_col(ops))) & (F.size(_col(ops)) == F.size(_col(values))) & ~F.exists(conds, lambda x: x.isNull())
    where = F.when(F.size(conds) > 0, F.concat(F.lit(" WHERE "), F.array_join(conds, " AND "))).otherwise("")
    return F.when(even, F.concat(F.lit("SELECT "), target, F.lit(" FROM data"), where))


def bounded_bytes(c, limit: int, overhead: int = 0) -> Column:
    return F.octet_length(_col(c)) + overhead <= limit


def signature(*columns: str, chained: tuple[tuple[str, ...], ...] = ()) -> Column:
    """F32: digest of the named columns as JSON with sorted keys; each further group is digested with the digest so far
    where any of its columns is not null, so that rows without it keep their old signature."""
    out = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    for group in chained:
        more = F.sha2(F.to_json(F.struct(out.alias("base_signature"), *sorted(group))), 256)
        out = F.when(F.coalesce(*[F.col(c).cast("string") for c in group]).isNotNull(), more).otherwise(out)
    return out

