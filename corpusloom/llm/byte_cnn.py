"""Operator 3: quality classifier, a byte-level convolutional network in numpy.

Bytes are embedded, plus one input that marks bytes inside a run of at least RUN bytes repeated within the last LAGS
bytes. Filters of WIDTH bytes slide in steps of STEP; their largest response is taken in every chunk of CHUNK bytes,
and chunks overlap by half, so the whole text is covered whatever its length. A document's vector holds, for each
filter, the mean and the largest over its chunks; a logistic unit turns it into one probability.

The network is fitted on the driver with Adam from a bounded sample of the labelled rows outside the held-out fold
(crc32 of the id as text, mod 3, is 1): of each label, in the order of a hash of their ids, at most SAMPLE rows with texts
of at most LONGEST bytes and SAMPLE_BYTES together; every text in it is learnt whole. Nothing but the text's bytes enters a
score. Scoring reads every text whole in blocks of bounded size.

Defined cases: null text scores as the empty text, which is one chunk of padding; rows that repeat a doc_id are scored
each on its own, and learnt once, by the least of their texts; labels that are null, or repeated with different values, are left out; without labels of both kinds every
score is the share of label 1 seen (0.5 without labels); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

STEP, WIDTH, HALF = 4, 8, 256
CHUNK = 2 * HALF
EMBED, FILTERS = 8, 32
RUN, LAGS = 4, (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)
PAD = max(LAGS)
EPOCHS, BATCH = 8, 32
#: The sample that is fitted: rows of each label, bytes of their texts together, and bytes of a text that is taken.
SAMPLE, SAMPLE_BYTES, LONGEST = 1500, 1 << 23, 1 << 20
#: Bytes of texts that gradients are taken of at once.
GRADIENT_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20
OVERLAP = 64


def lay_out(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one flat array, each padded with at least PAD zero bytes to whole half chunks, and their half chunks.

    PAD is the largest lag, so that no text is compared to the one before it.
    """
    halves = np.array([-(-(len(r) + PAD) // HALF) for r in raws], np.int64)
    flat = np.zeros(int(halves.sum()) * HALF, np.uint8)
    at = 0
    for r, h in zip(raws, halves.tolist(), strict=True):
        flat[at : at + len(r)] = np.frombuffer(r, np.uint8)
        at += h * HALF
    return flat, halves


def repeated(flat: np.ndarray) -> np.ndarray:
    """1 where a byte ends RUN bytes that equal those a small lag before, else 0."""
    out = np.zeros(len(flat), bool)
    for lag in LAGS:
        if len(flat) > lag + RUN:
            same = np.zeros(len(flat), bool)
            same[lag:] = (flat[lag:] == flat[:-lag]) & (flat[lag:] > 32)
            run = same.copy()
            for k in range(1, RUN):
                run[k:] &= same[:-k]
            out |= run
    return out.astype(np.float32)


class ByteNet:
    """Weights and both passes of the network."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        inputs = EMBED + 1
        self.p = {"emb": r.normal(0, 0.5, (256, EMBED)), "w": r.normal(0, 1 / np.sqrt(WIDTH * inputs), (WIDTH * inputs, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.1, 2 * FILTERS), "c": np.zeros(1)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def maxima(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response and its place for each half chunk and filter, and the inputs by steps; ends: last steps of texts."""
        x = np.concatenate([self.p["emb"][flat], repeated(flat)[:, None]], axis=1).reshape(len(flat) // STEP, -1)
        k = x.shape[1]
        out = x @ self.p["w"][:k]
        out[:-1] += (x @ self.p["w"][k:])[1:]
        out[ends] = -1e9
        out = out.reshape(-1, HALF // STEP, FILTERS)
        at = out.argmax(axis=1)
        return np.take_along_axis(out, at[:, None, :], 1)[:, 0, :] + self.p["b"], at, x

    @staticmethod
    def chunks(top: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk maxima (a half chunk and its next in the same text), the halves they came from, and each half's text."""
        text = np.repeat(np.arange(len(halves)), halves)
        nxt = np.arange(len(top)) + 1
        nxt[np.cumsum(halves) - 1] -= 1  # the last half stands alone
        later = top[nxt] > top
        return np.where(later, top[nxt], top), np.where(later, nxt[:, None], np.arange(len(top))[:, None]), text

    @staticmethod
    def pooled(act: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Mean and largest activation of each text."""
        begin = np.cumsum(halves) - halves
        return np.concatenate([np.add.reduceat(act, begin) / halves[:, None], np.maximum.reduceat(act, begin)], axis=1)

    def score(self, raws: list[bytes]) -> np.ndarray:
        """Probabilities of texts; long ones go through in overlapping pieces."""
        out = np.zeros(len(raws))
        i = 0
        while i < len(raws):
            if len(raws[i]) > BLOCK_BYTES:
                out[i] = self._score_long(raws[i])
                i += 1
                continue
            j, held = i, 0
            while j < len(raws) and (j == i or held + len(raws[j]) <= BLOCK_BYTES) and len(raws[j]) <= BLOCK_BYTES:
                held += len(raws[j])
                j += 1
            flat, halves = lay_out(raws[i:j])
            top, _, _ = self.maxima(flat, np.cumsum(halves) * (HALF // STEP) - 1)
            act = np.maximum(self.chunks(top, halves)[0], 0)
            out[i:j] = self._probability(self.pooled(act, halves))
            i = j
        return out

    def _score_long(self, raw: bytes) -> float:
        """One text in blocks of whole half chunks: half-chunk maxima are gathered, then pooled as for any text."""
        tops = []
        for at in range(0, len(raw), BLOCK_BYTES):
            before = min(at, HALF)
            piece = raw[at - before : at + BLOCK_BYTES + HALF]
            flat, halves = lay_out([piece])
            top, _, _ = self.maxima(flat, np.cumsum(halves) * (HALF // STEP) - 1)
            tops.append(top[before // HALF :][: BLOCK_BYTES // HALF] if at + BLOCK_BYTES < len(raw) else top[before // HALF :])
        top = np.concatenate(tops)
        halves = np.array([len(top)])
        return float(self._probability(self.pooled(np.maximum(self.chunks(top, halves)[0], 0), halves))[0])

    def _probability(self, h: np.ndarray) -> np.ndarray:
        z = np.clip((h @ self.p["v"] + self.p["c"]).astype(np.float64), -30, 30)
        return 1 / (1 + np.exp(-z))

    def gradients_in_parts(self, raws: list[bytes], y: np.ndarray) -> dict:
        """gradients() with memory for GRADIENT_BYTES of texts: the mean over a batch is the weighted mean over its parts."""
        out: dict = {}
        for i, j in _parts([len(r) for r in raws], GRADIENT_BYTES):
            for name, g in self.gradients(raws[i:j], y[i:j]).items():
                out[name] = out.get(name, 0) + g * np.float32((j - i) / len(raws))
        return out

    def gradients(self, raws: list[bytes], y: np.ndarray) -> dict:
        flat, halves = lay_out(raws)
        top, at, x = self.maxima(flat, np.cumsum(halves) * (HALF // STEP) - 1)
        best, origin, text = self.chunks(top, halves)
        act = np.maximum(best, 0)
        h = self.pooled(act, halves)
        d = (self._probability(h) - y).astype(np.float32) / len(y)
        g = {"v": h.T @ d, "c": np.array([d.sum()], np.float32)}
        dh = d[:, None] * self.p["v"]
        mean, largest = dh[:, :FILTERS], dh[:, FILTERS:]
        da = mean[text] / halves[text][:, None]
        hit = act == h[:, FILTERS:][text]
        share = np.add.reduceat(hit.astype(np.float32), np.cumsum(halves) - halves)
        da = (da + hit * largest[text] / share[text]) * (best > 0)
        dt = np.zeros_like(top)
        np.add.at(dt, (origin, np.arange(FILTERS)[None, :]), da)
        g["b"] = dt.sum(0)
        place = at + np.arange(len(top))[:, None] * (HALF // STEP)
        after = np.minimum(place + 1, len(x) - 1)
        k = x.shape[1]
        g["w"] = np.concatenate([np.einsum("hf,hfk->kf", dt, x[place]), np.einsum("hf,hfk->kf", dt, x[after])])
        dx = np.concatenate([dt[..., None] * self.p["w"][:k].T, dt[..., None] * self.p["w"][k:].T], axis=2).reshape(len(top), FILTERS, WIDTH, EMBED + 1)[..., :EMBED]
        groups = flat.reshape(-1, STEP)
        byte = np.concatenate([groups[place], groups[after]], axis=2).reshape(-1)
        dx = dx.reshape(-1, EMBED)
        g["emb"] = np.stack([np.bincount(byte, dx[:, e], 256) for e in range(EMBED)], axis=1).astype(np.float32)
        return g


def _parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of sizes that add up to at most `most` (or hold one)."""
    i = 0
    while i < len(sizes):
        j, held = i, 0
        while j < len(sizes) and (j == i or held + sizes[j] <= most):
            held += sizes[j]
            j += 1
        yield i, j
        i = j


def fit(raws: list[bytes], y: np.ndarray, seed: int = 3) -> ByteNet:
    """A network fitted to texts and labels; the same input gives the same weights."""
    net = ByteNet(seed)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        net.p["v"][:] = 0
        net.p["c"][:] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return net
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(x) for k, x in net.p.items()}
    s = {k: np.zeros_like(x) for k, x in net.p.items()}
    t, steps = 0, EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for i in range(0, len(y), BATCH):
            k = order[i : i + BATCH]
            g = net.gradients_in_parts([raws[j] for j in k], y[k])
            t += 1
            rate = 0.01 * (1 - 0.95 * t / steps)
            for name, x in net.p.items():
                d = g[name] + 1e-4 * x * (name in ("v", "w"))
                m[name] = 0.9 * m[name] + 0.1 * d
                s[name] = 0.999 * s[name] + 0.001 * d * d
                net.p[name] = (x - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> ByteNet:
    """Fit on a bounded sample of labelled rows outside the held-out fold."""
    fold = F.crc32(F.col(key).cast("string")) % 3 != 1
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & fold).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("y2")).filter("y = y2")
    order = [F.xxhash64(F.col(key)), F.col(key)]
    chosen = known.filter("y = 0").orderBy(*order).limit(sample).unionByName(known.filter("y = 1").orderBy(*order).limit(sample)).select(F.col(key).alias("k"), "y")
    part = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")  # 2 * sample rows at most
    # a row for each id, however often it is repeated; then what the budget of bytes holds, in the same order
    once = part.groupBy("k", "y").agg(F.min("text").alias("text")).withColumn("raw", F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    once = once.withColumn("n", F.length("raw")).filter(F.col("n") <= LONGEST)
    upto = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("k"), "k"))
    rows = once.withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_BYTES).select("k", "raw", "y").collect()
    rows.sort(key=lambda r: (r["k"], bytes(r["raw"])))
    return fit([bytes(r["raw"]) for r in rows], np.array([r["y"] for r in rows], np.float32))


def score(docs: DataFrame, net: ByteNet, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    source = docs.select(F.col(key), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = ByteNet()
        own.p = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                p = own.score([(t or "").encode() for t in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())], [key, "score", "predicted"])

    out = source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, score double, predicted int")
    return out.select(key, F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
