"""Operator 12: ranked lexical search over a tiered index.

Index. Equal texts are one document of the index with the number of its rows. Documents come in blocks; a block is cut into
words, counted and turned into posting segments, all in numpy: a segment is one term of one block, with the places of its
documents and their impacts, the factor of the score that a posting has beside its term's weight. The postings of a
frequent term are divided at levels of impact: the highest go to tier 0, then tier 1, ...; TIERS caps them, the last tier
takes what is left, so no posting is lost. A term's residual bound for a depth is its highest impact below it. Tiers are
folders of one table, so a search reads the high-impact folder only. A term that fits into tier 0 stays in the first table.

Search. Items are taken in chunks of CHUNK. Each item starts with tier 0 of its terms. A block sums what it has read; the
20th best sum of all blocks is a score that an item's 20th document surely has. The item is proved if the residual bounds
of its terms sum up to less, for then no document that was not met can be among the best. An item without proof falls
through: the terms whose bounds fit below that score, the longest lists first, stay where they are, all others go one tier
down. In the last tier nothing is left and everything is proved. Documents whose sum and open bounds reach the 20th best
are then completed from the lower tiers by joins on (block, term), so the scores returned are exact.

Scores are 64-bit integers; equal scores are ordered by doc_id (none last). Equal texts share a score, so at most the 20
smallest ids of each are expanded.

Defined cases: null or empty text has no terms and is never found; an item without terms, or none of whose terms occurs,
has no rows; items that repeat an id are one item with all their words; a null item_id is an item; rows that repeat a doc_id
are documents of their own; an empty table gives an empty result; other columns are not read; a block holds at least one
document, so a text beyond BLOCK_BYTES makes a larger block.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_side, table

#: Postings of a term up to which a tier is filled: at least so many, or that share of the documents; what is left makes
#: the last tier.
TIERS = ((1_024, 1 / 64), (4_096, 1 / 16), (16_384, 1 / 4))
#: Impacts that share a level; impacts are below 1,000,000.
LEVEL = 8_192
BLOCK_DOCS, BLOCK_BYTES = 16_384, 32 << 20
#: Items that are searched at once: their terms are on the driver and in each task.
CHUNK = 1_000
TOP = 20
BROADCAST_ROWS = 200_000
NO_ID = np.iinfo(np.int64).max

#: What becomes of each byte: separators to 0, A-Z to a-z, all others as they are.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)

SEGMENTS = "block bigint, term string, docs array<int>, tfs array<int>, lengths array<int>, n_rows bigint, n_words bigint, digests array<string>, ids array<bigint>"


# ---- words ----------------------------------------------------------------------------------------------------------
def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, one after the other, and the number of the text of each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    data, offsets = BYTES[raw], offsets - offsets[0]
    inside = data > 0
    edge = np.zeros(len(data) + 1, bool)  # a text ends whatever stands at its last byte
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    held = data[inside]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
    return words, np.searchsorted(offsets, starts, "right") - 1


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _segments(block: int, t: pa.Table) -> pa.RecordBatch:
    """Segments of a block of documents (digest, text, id, n), and one for the empty term that describes the block."""
    ids = t.column("id").fill_null(NO_ID).to_numpy()
    order = np.lexsort([ids])  # places follow ids, so that ties within a block do
    t = t.take(pa.array(order))
    ids, n, texts = ids[order], t.column("n").to_numpy(), t.column("text").combine_chunks()
    words, doc = _words(pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts)
    coded = words.dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    key, tf = np.unique(codes * len(t) + doc, return_counts=True)
    term, doc_of = key // max(len(t), 1), key % max(len(t), 1)
    length = np.bincount(doc, minlength=len(t))
    bounds = np.concatenate([np.searchsorted(term, np.arange(len(terms))), [len(key)]])
    total = np.concatenate([[0], np.cumsum(n[doc_of])])
    some = length > 0
    k = len(terms) + 1
    ends = np.append(bounds, len(key) + len(t))
    with_block = lambda a, own: np.concatenate([a, own])
    only_last = lambda values, kind: pa.concat_arrays([pa.nulls(k - 1, pa.list_(kind)), _lists(values, np.array([0, len(t)]), kind)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(k, block), pa.int64()),
            pa.concat_arrays([terms, pa.array([""])]),
            _lists(with_block(doc_of, np.arange(len(t))), ends, pa.int32()),
            _lists(with_block(tf, length), ends, pa.int32()),
            _lists(with_block(length[doc_of], length), ends, pa.int32()),
            pa.array(np.append(np.diff(total[bounds]), n[some].sum()), pa.int64()),
            pa.array(np.append(np.zeros(k - 1, np.int64), (n * length).sum()), pa.int64()),
            only_last(t.column("digest").to_pylist(), pa.string()),
            only_last(ids, pa.int64()),
        ],
        names=["block", "term", "docs", "tfs", "lengths", "n_rows", "n_words", "digests", "ids"],
    )


def _index_blocks(batches):
    """Documents in blocks of BLOCK_DOCS and BLOCK_BYTES at most, unless one document is larger."""
    number = TaskContext.get().partitionId() << 32
    held, rows, size = [], 0, 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        first = 0
        for i, x in enumerate(lengths.tolist()):
            if rows and (rows == BLOCK_DOCS or size + x > BLOCK_BYTES):
                if i > first:
                    held.append(batch.slice(first, i - first))
                yield _segments(number, pa.Table.from_batches(held))
                number, held, first, rows, size = number + 1, [], i, 0, 0
            rows, size = rows + 1, size + x
        if len(batch) > first:
            held.append(batch.slice(first))
    if held:
        yield _segments(number, pa.Table.from_batches(held))


# ---- index ----------------------------------------------------------------------------------------------------------
def _weighed(n: int, words: int):
    """Segments with impacts in place of counts and lengths."""

    def weighed(batches):
        for batch in batches:
            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
            tf, m = flat("tfs"), 75 + 25 * flat("lengths") * n // max(words, 1)
            bounds = np.concatenate([[0], np.cumsum(batch.column("docs").value_lengths().to_numpy())])
            impacts = _lists(1_000_000_000 * tf // (1000 * tf + 12 * m), bounds, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("term"), batch.column("docs"), impacts], names=["block", "term", "docs", "impacts"])

    return weighed


def _histogram(batches):
    """Postings and highest impact by level of the segments of each batch."""
    levels = 1_000_000 // LEVEL + 1
    for batch in batches:
        coded = batch.column("term").dictionary_encode()
        impact = batch.column("impacts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column("impacts").value_lengths().to_numpy())
        key, inverse, count = np.unique(row * levels + impact // LEVEL, return_inverse=True, return_counts=True)
        top = np.zeros(len(key), np.int64)
        np.maximum.at(top, inverse, impact)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key // levels)), pa.array(key % levels, pa.int32()), pa.array(count, pa.int64()), pa.array(top)], names=["term", "level", "n", "top"])


def _tiered(depths: int):
    """Segments divided into tiers by their terms' levels."""

    def tiered(batches):
        for batch in batches:
            docs, impact = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("docs", "impacts"))
            row = np.repeat(np.arange(len(batch)), batch.column("docs").value_lengths().to_numpy())
            tier = sum((impact // LEVEL < batch.column(f"level{k}").to_numpy(zero_copy_only=False)[row]).astype(int) for k in range(depths - 1))
            for k in range(depths):
                some = np.flatnonzero(tier == k)
                if len(some):
                    own, first = np.unique(row[some], return_index=True)
                    at, bounds = pa.array(own), np.append(first, len(some))
                    yield pa.RecordBatch.from_arrays([batch.column("block").take(at), batch.column("term").take(at), _lists(docs[some], bounds, pa.int32()), _lists(impact[some], bounds, pa.int32()), pa.array(np.full(len(own), k), pa.int32())], names=["block", "term", "docs", "impacts", "tier"])

    return tiered


class Index:
    """A tiered index of documents as tables: postings and, of frequent terms, tiers; terms, levels, blocks, members; n, words."""

    def __init__(self, docs: DataFrame, keep: Scratch, doc_id: str = "doc_id", column: str = "text", tiers=TIERS):
        rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
        rows = rows.withColumn("digest", F.md5("text"))
        self.members = keep(rows.select("digest", "id"), "search-members")
        texts = rows.groupBy("digest").agg(F.first("text").alias("text"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        raw = keep(texts.select("digest", "text", "id", "n").mapInArrow(_index_blocks, SEGMENTS), "search-blocks")
        self.blocks = raw.filter("term = ''").select("block", "digests", "ids")
        self.postings = raw.filter("term <> ''").select("block", "term", "docs", "tfs", "lengths", "n_rows")
        total = raw.filter("term = ''").agg(F.sum("n_rows").alias("n"), F.sum("n_words").alias("words")).first()
        self.n, self.words = total["n"] or 0, total["words"] or 0
        self.terms = keep(self.postings.groupBy("term").agg(F.sum("n_rows").alias("df"), F.sum(F.size("docs")).alias("postings")), "search-terms")
        caps = np.cumsum([max(least, int(share * self.n)) for least, share in tiers]).tolist()
        self.depths = len(caps) + 1
        frequent = keep(self.terms.filter(F.col("postings") > caps[0]).select("term"), "search-frequent")
        many = self.postings.join(small_side(frequent, BROADCAST_ROWS), "term", "left_semi").select("block", "term", "docs", "tfs", "lengths")
        many = keep(many.mapInArrow(_weighed(self.n, self.words), "block bigint, term string, docs array<int>, impacts array<int>"), "search-many")
        levels = many.select("term", "impacts").mapInArrow(_histogram, "term string, level int, n bigint, top bigint")
        levels = levels.groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        down = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
        levels = levels.withColumn("upto", F.sum("n").over(down))
        # a tier holds the highest levels whose postings are within its cap, and those of the tiers above it
        lowest = [F.coalesce(F.min(F.when(F.col("upto") <= cap, F.col("level"))), F.lit(1_000_000 // LEVEL + 1)).alias(f"level{k}") for k, cap in enumerate(caps)]
        bounds = [F.coalesce(F.max(F.when(F.col("upto") > cap, F.col("top"))), F.lit(0)).alias(f"bound{k}") for k, cap in enumerate(caps)]
        held = [F.coalesce(F.max(F.when(F.col("upto") <= cap, F.col("upto"))), F.lit(0)).alias(f"held{k}") for k, cap in enumerate(caps)]
        self.levels = keep(levels.groupBy("term").agg(*lowest, *bounds, *held), "search-levels")
        names = [f"level{k}" for k in range(len(caps))]
        divided = many.join(small_side(self.levels.select("term", *names), BROADCAST_ROWS), "term").select("block", "term", "docs", "impacts", *names)
        self.tiers = keep(divided.mapInArrow(_tiered(self.depths), "block bigint, term string, docs array<int>, impacts array<int>, tier int"), "search-tiers", partition="tier")

    def read(self, asked: DataFrame) -> DataFrame:
        """Segments of terms that have one tier."""
        few = self.postings.join(asked, "term", "left_semi").select("block", "term", "docs", "tfs", "lengths")
        return few.mapInArrow(_weighed(self.n, self.words), "block bigint, term string, docs array<int>, impacts array<int>").withColumn("tier", F.lit(0))


# ---- search ---------------------------------------------------------------------------------------------------------
class _Item:
    """An item's terms: weight, bounds and lengths by depth; how deep each is read."""

    def __init__(self, terms: dict, frequent: set):
        self.terms = terms  # term -> (weight, bounds by depth, postings by depth)
        self.frequent = frequent  # terms that have tiers
        self.depth = dict.fromkeys(terms, 1)
        self.floor = 0

    def open(self, term: str) -> int:
        """What a posting of the term that has not been read can add at most."""
        w, bounds, _ = self.terms[term]
        return w * bounds[self.depth[term]]

    def proved(self) -> bool:
        left = sum(map(self.open, self.terms))
        return left == 0 or left < self.floor

    def fall(self) -> None:
        """One tier down for the terms that are needed for a proof; the longest lists stay as long as their bounds allow."""
        left = 0
        for term in sorted(self.terms, key=lambda t: (-self.terms[t][2][-1], t)):
            if left + self.open(term) < self.floor:
                left += self.open(term)
            elif self.open(term):
                self.depth[term] += 1


def _sums(segments, items: dict):
    """(item, sum, open) of a block for each item: what was read, and the bounds of terms met, by document."""
    docs, impacts, by = segments.column("docs").combine_chunks(), segments.column("impacts").combine_chunks(), defaultdict(list)
    at, flat, values = docs.offsets.to_numpy(), docs.values.to_numpy(), impacts.values.to_numpy().astype(np.int64)
    for i, (term, tier) in enumerate(zip(segments.column("term").to_pylist(), segments.column("tier").to_pylist(), strict=True)):
        by[term].append((tier, slice(int(at[i]), int(at[i + 1]))))
    n = int(flat.max()) + 1 if len(flat) else 0
    for name, terms in items.items():
        total, met, some = np.zeros(n, np.int64), np.zeros(n, np.int64), False
        for term, (weight, bound, depth) in terms.items():
            for tier, part in by.get(term, ()):
                if tier < depth:
                    some = True
                    total[flat[part]] += weight * values[part]
                    met[flat[part]] += bound
        if some:
            yield name, total, met


def _best(items: dict):
    """The TOP highest sums of each item in a block."""

    def best(key, segments):
        names, out = [], []
        for name, total, _ in _sums(segments, items):
            top = np.partition(total, len(total) - TOP)[-TOP:] if len(total) > TOP else total
            top = top[top > 0]
            names += [name] * len(top)
            out.append(top)
        return pa.table({"item": pa.array(names, pa.int32()), "sum": pa.array(np.concatenate([*out, np.zeros(0, np.int64)]), pa.int64())})

    return best


def _candidates(items: dict):
    """The documents of a block whose sums and open bounds reach the floor of an item: items is name -> (terms, left, floor)."""
    plain = {name: terms for name, (terms, _, _) in items.items()}

    def candidates(key, segments):
        names, docs, sums = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, total, met in _sums(segments, plain):
            _, left, floor = items[name]
            some = np.flatnonzero((total > 0) & (total + left - met >= max(floor, 1)))
            names += [name] * len(some)
            docs.append(some)
            sums.append(total[some])
        k = len(names)
        return pa.table({"block": pa.array([key[0].as_py()] * k, pa.int64()), "item": pa.array(names, pa.int32()), "doc": pa.array(np.concatenate(docs), pa.int32()), "sum": pa.array(np.concatenate(sums), pa.int64())})

    return candidates


def _complete(items: dict):
    """Scores of candidates: what lower tiers hold of the terms not read to their end is added. items: name -> {term: (weight, depth)}."""

    def complete(key, found, segments):
        names, docs = found.column("item").to_numpy(), found.column("doc").to_numpy()
        total = found.column("sum").to_numpy().copy()
        n = int(docs.max()) + 1 if len(docs) else 0
        ids = np.full(n, NO_ID)
        by = defaultdict(list)
        for term, tier, at, values in zip(*(segments.column(c).to_pylist() for c in ("term", "tier")), segments.column("docs"), segments.column("impacts"), strict=True):
            at, values = at.values.to_numpy(), values.values.to_numpy()
            own = at < n
            if term == "":
                ids[at[own]] = values[own]
            else:
                by[term].append((tier, at[own], values[own]))
        rows_of = {name: np.flatnonzero(names == name) for name in np.unique(names).tolist()}
        impact = np.zeros(n, np.int64)
        out = []
        for name, rows in rows_of.items():
            for term, (weight, depth) in items[name].items():
                for tier, at, values in by.get(term, ()):
                    if tier >= depth:
                        impact[at] = values
                        total[rows] += weight * impact[docs[rows]]
                        impact[at] = 0
            order = rows[np.lexsort([docs[rows], -total[rows]])][:TOP]  # places of documents follow their ids
            out.append(order)
        keep = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({"item": pa.array(names[keep], pa.int32()), "score": pa.array(total[keep]), "id": pa.array(ids[docs[keep]]), "block": pa.array([key[0].as_py()] * len(keep), pa.int64()), "doc": pa.array(docs[keep], pa.int32())})

    return complete


def _terms_of(items: DataFrame, item_id: str, column: str) -> DataFrame:
    """(item, term, n): the words of items with their number."""

    def split(batches):
        for batch in batches:
            words, at = _words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(at)), words], names=["item", "term"])

    rows = items.select(F.col(item_id).cast("bigint").alias("item"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    return rows.mapInArrow(split, "item bigint, term string").groupBy("item", "term").agg(F.count(F.lit(1)).alias("n"))


def _chunk(index: Index, rows: list) -> dict[int, _Item]:
    """Items of one chunk with the weight, bounds and lengths of their terms."""
    terms: dict[int, dict] = defaultdict(dict)
    frequent = {r["term"] for r in rows if r["bound0"] is not None}
    for r in rows:
        weight = r["n"] * math.floor(1000 * math.log((2 * index.n + 2) / (2 * r["df"] + 1)))
        k = range(index.depths - 1)
        bounds, held = [r[f"bound{i}"] or 0 for i in k], [r[f"held{i}"] if r[f"held{i}"] is not None else r["postings"] for i in k]
        terms[r["number"]][r["term"]] = (weight, [1_000_000, *bounds, 0], [0, *held, r["postings"]])
    return {i: _Item(t, frequent) for i, t in terms.items()}


def _asked(spark: SparkSession, items: dict[int, _Item]) -> DataFrame:
    """(term, depth) of a chunk's items, the deepest of each term."""
    depth: dict[str, int] = {}
    for x in items.values():
        for term, d in x.depth.items():
            depth[term] = max(depth.get(term, 0), d)
    return F.broadcast(spark.createDataFrame(list(depth.items()), "term string, depth int"))


def _search_chunk(index: Index, items: dict[int, _Item], keep: Scratch) -> DataFrame:
    spark = index.tiers.sparkSession
    few = spark.createDataFrame([(t,) for t in {t for x in items.values() for t in x.terms if t not in x.frequent}], "term string")
    whole = keep(index.read(F.broadcast(few)), "search-whole")  # terms of one tier
    upto = lambda some: index.tiers.filter(F.col("tier") < max(d for x in some.values() for d in x.depth.values())).join(_asked(spark, some), "term").filter("tier < depth").select("block", "term", "docs", "impacts", "tier")
    open_items = dict(items)
    while open_items:
        plain = {i: {t: (w, w * b[x.depth[t]], x.depth[t]) for t, (w, b, _) in x.terms.items()} for i, x in open_items.items()}
        sums = whole.unionByName(upto(open_items)).groupBy("block").applyInArrow(_best(plain), "item int, sum bigint")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sum")))
        floors = sums.withColumn("place", place).filter(F.col("place") <= TOP).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("sum").alias("floor")).collect()
        for r in floors:
            if r["n"] == TOP:
                items[r["item"]].floor = r["floor"]
        open_items = {i: x for i, x in open_items.items() if not x.proved()}
        for x in open_items.values():
            x.fall()
    plain = {i: ({t: (w, w * b[x.depth[t]], x.depth[t]) for t, (w, b, _) in x.terms.items()}, sum(map(x.open, x.terms)), x.floor) for i, x in items.items()}
    found = keep(whole.unionByName(upto(items)).groupBy("block").applyInArrow(_candidates(plain), "block bigint, item int, doc int, sum bigint"), "search-found")
    rest = {i: {t: (w, x.depth[t]) for t, (w, b, _) in x.terms.items() if x.open(t)} for i, x in items.items()}
    lower = spark.createDataFrame([(i, t, d) for i, terms in rest.items() for t, (_, d) in terms.items()], "item int, term string, depth int")
    pairs = found.select("block", "item").distinct().join(F.broadcast(lower), "item").groupBy("block", "term").agg(F.min("depth").alias("depth"))
    pairs = keep(pairs, "search-pairs")
    missing = index.tiers.filter("tier > 0").join(small_side(pairs, BROADCAST_ROWS), ["block", "term"]).filter("tier >= depth").select("block", "term", "docs", F.col("impacts").cast("array<bigint>").alias("impacts"), "tier")
    some = small_side(keep(found.select("block").distinct(), "search-some"), BROADCAST_ROWS)
    own = index.blocks.join(some, "block", "left_semi").select("block", F.lit("").alias("term"), F.sequence(F.lit(0), F.size("ids") - 1).alias("docs"), F.col("ids").alias("impacts"), F.lit(0).alias("tier"))
    scored = found.groupBy("block").cogroup(missing.unionByName(own).groupBy("block")).applyInArrow(_complete(rest), "item int, score bigint, id bigint, block bigint, doc int")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= TOP).drop("place")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", column: str = "text", item_column: str = "text", tiers=TIERS, chunk: int = CHUNK) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of each item with a score above 0."""
    keep = Scratch()
    index = Index(docs, keep, doc_id, column, tiers)
    terms = keep(_terms_of(items, item_id, item_column), "search-items")
    numbers = terms.select("item").distinct()
    per = terms.join(index.terms, "term").join(index.levels, "term", "left")
    count = numbers.count()
    chunks = max(1, -(-count // chunk))
    out = []
    for c in range(chunks):
        own = per.filter(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c).orderBy("item", "term").collect()
        named = {item: i for i, item in enumerate(dict.fromkeys(r["item"] for r in own))}
        names = index.tiers.sparkSession.createDataFrame([(i, item) for item, i in named.items()], "item int, item_id bigint")
        if not own:
            continue
        found = _search_chunk(index, _chunk(index, [r.asDict() | {"number": named[r["item"]]} for r in own]), keep)
        out.append(keep(found.join(F.broadcast(names), "item").drop("item"), "search-best"))
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    if not out:
        keep.drop()
        return index.tiers.sparkSession.createDataFrame([], schema)
    best = out[0]
    for x in out[1:]:
        best = best.unionByName(x)
    named = best.join(index.blocks.select("block", "digests"), "block").select("item_id", "score", F.get("digests", F.col("doc")).alias("digest"))
    named = keep(named, "search-named")
    first = F.row_number().over(Window.partitionBy("digest").orderBy(F.asc_nulls_last("id")))
    wanted = small_side(keep(named.select("digest").distinct(), "search-digests"), BROADCAST_ROWS)
    ids = index.members.join(wanted, "digest", "left_semi").withColumn("place", first).filter(F.col("place") <= TOP).drop("place")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = named.join(ids, "digest").withColumn("rank", rank).filter(F.col("rank") <= TOP)
    result = keep(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"), "search-result")
    keep.drop(result)
    return result


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n, sum(len(words))::BIGINT AS l FROM d WHERE len(words) > 0),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL),
x AS (SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(words) * n) // l))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY ALL),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
