"""Operator 2: removal of repeated passages by bucket-pointer refinement over a sample of suffixes.

A bucket of suffixes is named by a 64-bit number. The first buckets are the 8-byte grams; a bucket is refined by the
bucket of the suffix that starts as many bytes later (8, 16, 32, 64 bytes), each round reusing the names of the round
before: two suffixes with equal names share twice as many bytes. Names are hashes of pairs of names rather than ranks, so
refinement needs no global sort and works inside a document; only comparing names is global.

Only suffixes that matter become rows. Of the windows of WINDOW bytes, consecutive ones choose the same anchor: the
suffix with the least GRAM-byte name inside the window (the leftmost of equals), a choice that equal windows make alike.
One row for each anchor carries its bucket g (the name of GRAM bytes) and its zone z (the name of all bytes of the
windows that chose it).

    bucket with one row                  none of its windows is repeated
    zone with two rows or more           all of its windows are repeated
    zone alone in a bucket with others   its windows are compared one by one, by their WINDOW bytes, with one
                                         representative of each other zone of the bucket

Counts are aggregations with partial sums and joins on unique keys, so a passage with very many copies is split like any
skewed key; copies of a zone are one representative in the last step. There, the bytes of the zones of a bucket meet in
one task if they are at most TOGETHER, and all their suffixes are sorted by bucket-pointer refinement: buckets of equal
8-byte grams, as pointers into the sorted order, are refined by sorting each one's suffixes on the pointers of the
suffixes 8, 16, 32, 64 and 72 bytes later; the new pointers are what the next round sorts on, and buckets of one suffix
leave. Nothing is hashed there: windows with one pointer are equal bytes. In larger buckets, a row is a slice of SLICE windows at one distance from the
anchor (equal windows have equal distances): slices whose bytes repeat are settled whole; of the others only those whose
common core repeats are opened, and their windows counted one by one. Texts are shuffled only to meet their own findings.

Defined cases: null or empty text has 0 bytes and the hash of the empty string; texts shorter than WINDOW keep all bytes;
rows that repeat a doc_id, or have none, are texts of their own (a row is known by its doc_id and a 64-bit hash of its
text), and equal texts repeat each other whatever their ids; extra columns are ignored and an empty table gives an empty
table; long texts are named in overlapping pieces.

Zones count as equal if the names of their anchor's GRAM bytes and of the whole zone, 64 bits each, are equal: among n
different zones around one anchor a wrong pair has a chance of n * n / 2 ** 65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, drop_path, materialize, table

WINDOW, GRAM = 200, 64
SPAN = WINDOW - GRAM + 1
PIECE = 1 << 20
PLACE_BITS = 22
#: Zones of one bucket that may meet in one task; the windows of larger buckets are counted as rows.
TOGETHER = 512
SLICE = 8
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def refine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bucket names from the names of two places."""
    x = a * _A
    x ^= x >> np.uint64(32)
    x += b * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def names(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of GRAM (64) bytes and of 128 bytes at each place (those that reach past the end are meaningless)."""

    def later(x, k):
        out = np.zeros_like(x)
        out[:-k] = x[k:]
        return out

    x = flat.astype(np.uint64)
    for k in (1, 2, 4):
        x |= later(x, k) << np.uint64(8 * k)
    for k in (8, 16, 32):
        x = refine(x, later(x, k))
    return x, refine(x, later(x, 64))


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values."""
    n = len(v) - width + 1
    pad = -len(v) % width
    m = np.concatenate([v, np.full(pad, _TOP)]).reshape(-1, width)
    ahead = np.minimum.accumulate(m, axis=1).reshape(-1)
    back = np.minimum.accumulate(m[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Zones:
    """Anchors of texts laid out one after another: text, first and last window, bucket and zone of each."""

    def __init__(self, raws: list[bytes]):
        flat = np.frombuffer(b"".join(raws), np.uint8)
        lengths = np.array([len(r) for r in raws], np.int64)
        self.begin = np.cumsum(lengths) - lengths
        empty = np.zeros(0, np.int64)
        self.text, self.lo, self.hi, self.at, self.g, self.z = empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(flat) < WINDOW:
            return
        gram, long = names(flat)
        left = np.repeat(self.begin + lengths, lengths) - np.arange(len(flat))  # bytes to the text's end
        low = np.uint64((1 << PLACE_BITS) - 1)
        v = np.where(left >= GRAM, (gram & ~low) | np.arange(len(flat)).astype(np.uint64), _TOP)
        anchor = (sliding_least(v, SPAN) & low).astype(np.int64)
        q = np.flatnonzero(left[: len(anchor)] >= WINDOW)
        if not len(q):
            return
        a = anchor[q]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (q[1:] != q[:-1] + 1)]))
        self.lo, self.hi = q[cut], q[np.append(cut[1:], len(q)) - 1]
        self.g, self.at = gram[a[cut]], a[cut] - self.lo
        size = self.hi - self.lo + WINDOW
        self.z = refine(refine(long[self.lo] ^ size.astype(np.uint64), long[self.lo + (size - 128) // 2]), long[self.lo + size - 128])
        self.text = np.searchsorted(self.begin, self.lo, side="right") - 1
        # several empty texts may begin where one does: the last of them holds the bytes
        self.lo, self.hi = self.lo - self.begin[self.text], self.hi - self.begin[self.text]


def pieces(raw: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """Parts of a long text: offset, bytes, and the windows (of the text) that are the part's own."""
    margin = 2 * WINDOW
    for at in range(0, max(len(raw), 1), PIECE):
        a = max(0, at - margin)
        yield a, raw[a : at + PIECE + WINDOW + margin], at, at + PIECE


def zones_of(raws: list[bytes]) -> Iterator[tuple[int, int, Zones]]:
    """Blocks of texts (first, end) with their zones; a text longer than a piece comes alone (see long_zones)."""
    i = 0
    while i < len(raws):
        j, held = i, 0
        while j < len(raws) and (j == i or held + len(raws[j]) <= PIECE) and (len(raws[j]) <= PIECE or j == i):
            held += len(raws[j])
            j += 1
            if held > PIECE:
                break
        yield i, j, Zones(raws[i:j]) if held <= PIECE else LongZones(raws[i])
        i = j


class LongZones:
    """Zones of one long text, from overlapping pieces: a zone belongs to the piece that its first window is in."""

    def __init__(self, raw: bytes):
        self.raw = raw
        parts = []
        for off, part, own, end in pieces(raw):
            z = Zones([part])
            keep = (z.lo + off >= own) & (z.lo + off < end)
            parts.append((z.lo[keep] + off, z.hi[keep] + off, z.at[keep], z.g[keep], z.z[keep]))
        lo, hi, at, g, z = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.text, self.lo, self.hi, self.at, self.g, self.z = np.zeros(len(lo), np.int64), lo, hi, at, g, z


def _raw(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def anchors(docs: DataFrame) -> DataFrame:
    """(g, z, doc, sub, lo) of every anchor; docs: (doc, sub, text)."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                some = b.slice(s, 512)
                keys, subs = (np.array(some.column(c).to_pylist(), np.int64) for c in (0, 1))
                for i, _, z in zones_of(_raw(some.column(2))):
                    if len(z.lo):
                        yield pa.RecordBatch.from_arrays([pa.array(z.g.view(np.int64)), pa.array(z.z.view(np.int64)), pa.array(keys[i + z.text]), pa.array(subs[i + z.text]), pa.array(z.lo.astype(np.int32))], ["g", "z", "doc", "sub", "lo"])

    return docs.select("doc", "sub", "text").mapInArrow(run, "g bigint, z bigint, doc bigint, sub bigint, lo int")


def _outcome(raw: bytes, gone: np.ndarray) -> tuple[int, int, str, bytes]:
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept


FIRST = "doc_id bigint, doc bigint, sub bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, raw binary, cover array<int>, asked array<struct<g:bigint,lo:int,at:int,own:boolean,many:boolean,zone:binary>>"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.struct([("g", pa.int64()), ("lo", pa.int32()), ("at", pa.int32()), ("own", pa.bool_()), ("many", pa.bool_()), ("zone", pa.binary())]))]


def first_pass(met: DataFrame, keep_text: bool) -> DataFrame:
    """Outcomes of texts whose zones are all settled; the others with their settled cover and the zones to compare.

    met has (doc_id, doc, sub, text, told); told lists (lo, z, kind), kind 1: settled, 2: to compare, 3: so in a large bucket.
    """

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 64):
                some = b.slice(s, 64)
                ids, keys, subs, raws = some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist(), _raw(some.column(3))
                told = [np.array([(x["lo"], x["z"], x["kind"]) for x in t or ()], np.int64).reshape(-1, 3) for t in some.column(4).to_pylist()]
                todo = [k for k, t in enumerate(told) if len(t)]
                zoned: dict = {}
                for i, j, z in zones_of([raws[k] for k in todo]):
                    cut = np.searchsorted(z.text, np.arange(j - i + 1))
                    for n in range(i, j):
                        zoned[todo[n]] = (z, cut[n - i], cut[n - i + 1])
                out = []
                for k, raw in enumerate(raws):
                    gone, asked, pending = np.zeros(len(raw), bool), [], False
                    if k in zoned:
                        z, p, e = zoned[k]
                        own_z = z.z[p:e].view(np.int64)
                        at = np.minimum(np.searchsorted(z.lo[p:e], told[k][:, 0]), max(e - p - 1, 0))
                        fits = (z.lo[p:e][at] == told[k][:, 0]) & (own_z[at] == told[k][:, 1]) if e > p else np.zeros(len(at), bool)
                        settled = np.zeros(e - p, bool)
                        settled[at[fits & (told[k][:, 2] == 1)]] = True
                        for lo, hi in zip(z.lo[p:e][settled].tolist(), z.hi[p:e][settled].tolist(), strict=True):
                            gone[lo : hi + WINDOW] = True
                        for kind in (2, 3):
                            for m in np.unique(at[fits & (told[k][:, 2] == kind)]).tolist():
                                pending |= not settled[m]
                                lo = int(z.lo[p + m])
                                asked.append({"g": int(z.g[p + m].view(np.int64)), "lo": lo, "at": int(z.at[p + m]), "own": not settled[m], "many": kind == 3, "zone": raw[lo : int(z.hi[p + m]) + WINDOW]})
                    if pending:
                        out.append((ids[k], keys[k], subs[k], len(raw), None, None, None, None, raw, np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).astype(np.int32), asked))
                    else:
                        n_gone, runs, sha, kept = _outcome(raw, gone)
                        out.append((ids[k], keys[k], subs[k], len(raw), n_gone, runs, sha, kept if keep_text else None, None, None, asked))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], [x.split(" ")[0] for x in FIRST.split(", ")])

    return met.mapInArrow(run, FIRST)


def _window_names(zones: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all windows of zones, the zone of each and its place in the zone."""
    _, long = names(np.frombuffer(b"".join(zones), np.uint8))
    sizes = np.array([len(x) for x in zones], np.int64)
    counts = sizes - WINDOW + 1
    zone = np.repeat(np.arange(len(zones)), counts)
    place = np.arange(len(zone)) - np.repeat(np.cumsum(counts) - counts, counts)
    p = place + np.repeat(np.cumsum(sizes) - sizes, counts)
    return refine(long[p], long[p + WINDOW - 128]), zone, place


def bucket_pointers(flat: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Bucket pointer of every suffix of flat: equal for two suffixes if their first length (128 to 256) bytes are equal.

    What lies past the end counts as zero bytes, so the pointers of suffixes shorter than length mean nothing.
    """
    n = len(flat)
    gram = np.zeros(n, np.uint64)
    for k in range(8):
        gram[: n - k] |= flat[k:].astype(np.uint64) << np.uint64(8 * (7 - k))
    places = np.argsort(gram)
    fresh = np.concatenate([[True], gram[places[1:]] != gram[places[:-1]]])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    pointer = np.empty(n + length, np.int64)
    pointer[n:] = -1
    pointer[places] = begin
    shared = 8
    while shared < length:
        later = min(shared, length - shared)
        size = np.diff(np.append(np.flatnonzero(fresh), len(places)))
        several = np.repeat(size > 1, size)
        places, begin = places[several], begin[several]
        if not len(places):
            break
        by = pointer[places + later]
        order = np.argsort(begin * (n + 1) + by + 1)  # buckets stay where they are, their suffixes are sorted
        places, begin, by = places[order], begin[order], by[order]
        edge = np.concatenate([[True], begin[1:] != begin[:-1]])
        fresh = edge | np.concatenate([[True], by[1:] != by[:-1]])
        at = np.arange(len(places))
        begin = begin + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(edge, at, 0))
        pointer[places] = begin
        shared += later
    return pointer[:n]


def compare_together(asked: DataFrame) -> DataFrame:
    """(doc, sub, qs): repeated windows of zones whose bucket is small; equal windows always have one bucket."""

    def settle(rows):
        zones = [r[5] for r in rows]
        sizes = np.array([len(x) for x in zones], np.int64)
        counts = sizes - WINDOW + 1
        zone = np.repeat(np.arange(len(zones)), counts)
        place = np.arange(len(zone)) - np.repeat(np.cumsum(counts) - counts, counts)
        pointer = bucket_pointers(np.frombuffer(b"".join(zones), np.uint8))[place + np.repeat(np.cumsum(sizes) - sizes, counts)]
        hit = (np.bincount(pointer)[pointer] > 1) & np.array([r[4] for r in rows], bool)[zone]
        cut = np.searchsorted(zone[hit], np.arange(len(rows) + 1))
        qs = (place[hit] + np.array([r[3] for r in rows], np.int64)[zone[hit]]).astype(np.int32)
        some = np.flatnonzero(cut[1:] > cut[:-1])
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in some], pa.int64()), pa.array([rows[k][1] for k in some], pa.int64()), pa.array([qs[cut[k] : cut[k + 1]] for k in some], pa.list_(pa.int32()))], ["doc", "sub", "qs"])

    def run(batches):
        held: list = []
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                held += zip(*(c.to_pylist() for c in b.slice(s, 1024).columns), strict=True)
                if len(held) >= 1024:  # what follows the last complete bucket waits
                    end = len(held)
                    while end and held[end - 1][2] == held[-1][2]:
                        end -= 1
                    if end:
                        yield settle(held[:end])
                        held = held[end:]
        if held:
            yield settle(held)

    rows = asked.filter("NOT many").select("doc", "sub", "g", "lo", "own", "zone").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, "doc bigint, sub bigint, qs array<int>")


SLICES = "doc bigint, sub bigint, g bigint, s int, q int, own boolean, u bigint, c bigint, ws array<bigint>"


def slices(asked: DataFrame) -> DataFrame:
    """Zones cut into slices: windows from place q with names ws; u names all their bytes, c the bytes common to the slice."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                rows = list(zip(*(x.to_pylist() for x in b.slice(start, 1024).columns), strict=True))
                zones = [r[6] for r in rows]
                _, long = names(np.frombuffer(b"".join(zones), np.uint8))
                w, zone, place = _window_names(zones)
                sizes = np.array([len(x) for x in zones], np.int64)
                first = (np.cumsum(sizes) - sizes)[zone]  # of the zone's bytes
                anchor = np.array([r[4] for r in rows], np.int64)[zone]
                s = (anchor - place) // SLICE
                cut = np.flatnonzero(np.concatenate([[True], (zone[1:] != zone[:-1]) | (s[1:] != s[:-1])]))
                last = np.append(cut[1:], len(w)) - 1
                z, q1, q2, sl = zone[cut], place[cut], place[last], s[cut]
                shape = ((anchor[cut] - q1) * 1024 + (q2 - q1)).astype(np.uint64)
                u = refine(refine(long[first[cut] + q1], long[first[cut] + q2 + WINDOW - 128]), shape)
                core = first[cut] + anchor[cut] - sl * SLICE
                c = refine(long[core], long[core + WINDOW - SLICE + 1 - 128])
                col = lambda i, t: np.array([r[i] for r in rows], t)[z]  # noqa: B023, E731
                ws = pa.ListArray.from_arrays(pa.array(np.append(cut, len(w)).astype(np.int32)), pa.array(w.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(col(0, np.int64)), pa.array(col(1, np.int64)), pa.array(col(2, np.int64)), pa.array(sl.astype(np.int32)), pa.array((col(3, np.int64) + q1).astype(np.int32)), pa.array(col(5, bool)), pa.array(u.view(np.int64)), pa.array(c.view(np.int64)), ws], [x.split(" ")[0] for x in SLICES.split(", ")])

    return asked.filter("many").select("doc", "sub", "g", "lo", "at", "own", "zone").mapInArrow(run, SLICES)


def compare_rows(asked: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, sub, qs): repeated windows of zones of large buckets, by slices, then by windows where slices differ."""
    rows = scratch(slices(asked), "sd-slices")
    whole = rows.groupBy("g", "s", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "sub", "q", "own")).alias("first"), F.first("c").alias("c"), F.first("ws").alias("ws"))
    whole = scratch(whole, "sd-whole")
    places = F.transform("ws", lambda _, i: F.col("q") + i)
    settled = rows.filter("own").join(whole.filter("n > 1").select("g", "s", "u"), ["g", "s", "u"]).select("doc", "sub", places.alias("qs"))
    cores = whole.groupBy("g", "s", "c").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1").select("g", "s", "c")
    opened = whole.join(cores, ["g", "s", "c"]).select("g", "n", "first", F.posexplode("ws").alias("i", "w"))
    opened = scratch(opened.select("g", "w", "first.doc", "first.sub", (F.col("first.q") + F.col("i")).alias("q"), (F.col("first.own") & (F.col("n") == 1)).alias("own")), "sd-windows")
    twice = opened.groupBy("g", "w").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g", "w")
    return settled.unionByName(opened.filter("own").join(twice, ["g", "w"]).select("doc", "sub", F.array("q").alias("qs")))


SECOND = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def second_pass(met: DataFrame, keep_text: bool) -> DataFrame:
    """Outcomes of the texts that had windows to compare; met: (doc_id, raw, cover, qs)."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 64):
                out = []
                for r in b.slice(s, 64).to_pylist():
                    gone = np.zeros(len(r["raw"]), bool)
                    for x, y in np.array(r["cover"], np.int64).reshape(-1, 2).tolist():
                        gone[x:y] = True
                    for q in r["qs"] or ():
                        gone[q : q + WINDOW] = True
                    n_gone, runs, sha, kept = _outcome(r["raw"], gone)
                    out.append((r["doc_id"], len(r["raw"]), n_gone, runs, sha, kept if keep_text else None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split(" ")[0] for x in SECOND.split(", ")])

    return met.mapInArrow(run, SECOND)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep_text: bool = True, together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row."""
    # two 64-bit numbers name a row: its id (without one, a hash of its text) and another hash of its text
    id_ = F.col(key).cast("bigint")
    source = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.xxhash64(F.lit(1), text)).alias("doc"), F.xxhash64(text).alias("sub"), F.col(text).alias("text"))
    scratch, row = Scratch(), ["doc", "sub"]
    rows = scratch(anchors(source), "sd-anchors")
    # a table of its own, so that the join is one of two exchanges, of which a large bucket's can be split
    buckets = scratch(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.min("z") != F.max("z")).alias("mixed")).filter("n > 1").drop("n"), "sd-buckets")
    hits = scratch(rows.join(buckets, "g"), "sd-hits")
    drop_path(rows)
    mixed = hits.filter("mixed").drop("mixed")
    zones = mixed.groupBy("g", "z").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*row, "lo")).alias("first"))
    zones = scratch(zones.select("g", "z", "n", "first.*"), "sd-zones")
    settled = hits.filter("NOT mixed").select(*row, "lo", "z").unionByName(mixed.join(zones.filter("n > 1").select("g", "z"), ["g", "z"]).select(*row, "lo", "z"))
    open_ = zones.groupBy("g").agg(F.min("n").alias("least"), F.when(F.count(F.lit(1)) > together, 3).otherwise(2).alias("kind")).filter("least = 1").select("g", "kind")
    open_ = scratch(open_, "sd-open")
    told = settled.withColumn("kind", F.lit(1)).unionByName(zones.join(open_, "g").select(*row, "lo", "z", "kind"))
    # a set: rows equal in id and text say the same
    told = told.groupBy(*row).agg(F.collect_set(F.struct("lo", "z", "kind")).alias("told"))
    first = scratch(first_pass(source.join(told, row, "left").select("doc_id", *row, "text", "told"), keep_text), "sd-first")
    for t in (hits, zones, buckets, open_):
        drop_path(t)
    # rows equal in id and text ask the same: one of them is enough, or they would all meet in their bucket's task
    asked = first.select(*row, F.explode("asked").alias("x")).select(*row, "x.*").dropDuplicates([*row, "g", "lo"])
    found = compare_together(asked).unionByName(compare_rows(asked, scratch)).groupBy(*row).agg(F.flatten(F.collect_list("qs")).alias("qs"))
    pending = first.filter("raw IS NOT NULL").select(*row, "doc_id", "raw", "cover")
    second = second_pass(pending.join(found, row, "left").select("doc_id", "raw", "cover", "qs"), keep_text)
    done = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    result = materialize(first.filter("raw IS NULL").select(*done).unionByName(second.select(*done)), "sd-result")
    scratch.drop()
    return result


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
