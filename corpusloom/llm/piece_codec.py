"""Operator 9: SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of the vocabulary has a word mark after another character, so merges never cross the start of a run of marks
and every word (a run of marks and what follows) can be encoded on its own. The distinct words of a block that the
cache does not hold are laid out as one flat symbol array. A round finds the smallest pair rank of each segment
(segmented minimum), merges its occurrences from the left at once, and compacts; rounds end when no pair is left.
Segments are words cut further where two characters stand together in no piece. Merging all occurrences at once equals
the library's order only if the merged piece cannot begin a better pair; ranks for which the vocabulary has such a
piece, and tied ranks, merge one occurrence a round.

Words are cut as offsets into a block's bytes and kept as an Arrow dictionary, so Python runs once for each distinct word;
ids of the texts are gathered from a pool. Characters outside the vocabulary fall back to bytes. Decoding starts from the
ids alone: their pieces are gathered, bytes joined as UTF-8, marks turned into spaces, the mark that encoding puts first
dropped.

Memory is bounded: blocks of BLOCK_CHARS characters (or one longer text), a cache of CACHE_WORDS words that is emptied when full. Workers
share nothing, so a lost executor only repeats its own partitions.

Defined cases: null or empty text has only the end id and decodes to the empty text; repeated rows are encoded each on
its own; extra columns are ignored; an empty table gives an empty table; very long words only mean longer segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK_CHARS = 1 << 21
CACHE_WORDS = 500_000
STEP = 2048
NONE = np.int32(2**31 - 1)
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder over the pieces and scores of a model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.end = sp.eos_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = np.zeros(256, np.int32)
        for i, b in self.byte_of.items():
            self.byte_id[b] = i
        self.first_byte, self.last_byte = min(self.byte_of), max(self.byte_of)
        if any(re.search(f"[^{MARK}]{MARK}", self.piece[i]) for i in plain):
            raise ValueError("a piece has a word mark inside; words cannot be encoded on their own")
        sym = {self.piece[i]: k for k, i in enumerate(plain)}
        ids = list(plain)
        for i in plain:
            for c in self.piece[i]:
                if c not in sym:
                    sym[c] = len(ids)
                    ids.append(-1)
        self.id_of = np.array(ids, np.int32)
        self.n_sym = len(ids)
        self.char = np.full(0x110000, -1, np.int32)
        for s, k in sym.items():
            if len(s) == 1:
                self.char[ord(s)] = k
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs, bigrams, ranked, worse = [], set(), {}, {}
        for i in plain:
            p, r = self.piece[i], rank_of[sp.get_score(i)]
            if len(p) < 2:
                continue
            ranked.setdefault(r, []).append(p)
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                bigrams.add(sym[p[cut - 1]] * self.n_sym + sym[p[cut]])
                if a in sym and b in sym:
                    pairs.append((sym[a] * self.n_sym + sym[b], r, sym[p]))
                    for part in (a, b):
                        worse[part] = min(worse.get(part, NONE), r)
        pairs.sort()
        self.keys = np.array([x[0] for x in pairs], np.int64)
        self.ranks = np.array([x[1] for x in pairs], np.int32)
        self.merged = np.array([x[2] for x in pairs], np.int32)
        self.bigrams = np.array(sorted(bigrams), np.int64)
        #: A rank's occurrences may merge at once if no pair that the merged piece can enter is better.
        self.at_once = np.zeros(len(scores) + 1, bool)
        for r, ps in ranked.items():
            self.at_once[r] = len(ps) == 1 and worse.get(ps[0], NONE) > r
        #: Written ids with a space after each, and what pieces show (nothing at 0, for ids that show nothing).
        self.names = pa.array([f"{i} " for i in range(n)], pa.large_string())
        self.shown = pa.array([b"" if i < 3 else bytes([self.byte_of[i]]) if i in self.byte_of else self.piece[i].encode() for i in range(n)], pa.large_binary())

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.n_sym + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char[cps]
        sym = np.where(sym >= 0, sym, -1 - cps).astype(np.int64)
        n = len(sym)
        starts_word = np.zeros(n, bool)
        starts_word[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
        joint = sym[:-1] * self.n_sym + sym[1:]
        at = np.minimum(np.searchsorted(self.bigrams, joint), len(self.bigrams) - 1)
        fresh = starts_word.copy()
        fresh[1:] |= (self.bigrams[at] != joint) | (sym[:-1] < 0) | (sym[1:] < 0)
        pos, seg = np.arange(n), np.cumsum(fresh) - 1
        done_pos, done_sym = [], []
        rank, into = np.full(n, NONE, np.int32), np.full(n, -1, np.int64)
        inner = np.flatnonzero(~fresh) - 1  # pairs inside a segment
        rank[inner], into[inner] = self._rank(sym[inner], sym[inner + 1])
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(sym)))
            alive = np.repeat(least != NONE, size)
            if not alive.all():
                done_pos.append(pos[~alive])
                done_sym.append(sym[~alive])
                pos, seg, sym, rank, into = (x[alive] for x in (pos, seg, sym, rank, into))
                least, size = least[least != NONE], size[least != NONE]
                if not len(sym):
                    break
            chosen = rank == np.repeat(least, size)
            # from the left: in a run of adjacent places every second one; for the other ranks the first of a segment
            k = np.flatnonzero(chosen)
            head = np.concatenate([[True], k[1:] != k[:-1] + 1])
            since = np.arange(len(k)) - np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
            first = np.concatenate([[True], seg[k][1:] != seg[k][:-1]])
            k = k[np.where(self.at_once[rank[k]], since % 2 == 0, first)]
            sym[k] = into[k]
            gone = np.zeros(len(sym), bool)
            gone[k + 1] = True
            stay = ~gone
            new = np.cumsum(stay)[k] - 1
            pos, seg, sym, rank, into = (x[stay] for x in (pos, seg, sym, rank, into))
            near = np.zeros(len(sym) + 1, bool)  # the merged places and those before them; the last place takes what is before 0
            near[new] = True
            near[new - 1] = True
            touched = np.flatnonzero(near[:-1])
            last = touched + 1 >= len(sym)
            nxt = np.where(last, touched, touched + 1)
            r, m = self._rank(sym[touched], sym[nxt])
            off = last | (seg[touched] != seg[nxt])
            rank[touched], into[touched] = np.where(off, NONE, r), m
        pos, sym = np.concatenate(done_pos), np.concatenate(done_sym)
        order = np.argsort(pos, kind="stable")
        pos, sym = pos[order], sym[order]
        word = np.repeat(np.arange(len(words)), lengths)[pos]
        ids = np.where(sym >= 0, self.id_of[np.maximum(sym, 0)], -1)
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # bytes of characters that no piece has
            raw = [chr(cps[pos[i]]).encode() for i in odd]
            width = np.ones(len(ids), np.int64)
            width[odd] = [len(b) for b in raw]
            out = np.repeat(ids, width)
            out[out < 0] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            ids, word = out, np.repeat(word, width)
        return ids, np.bincount(word, minlength=len(words))

    def decode(self, ids) -> str:
        """Text of ids, as the library's decode()."""
        parts, run = [], bytearray()
        for i in ids:
            if self.first_byte <= i <= self.last_byte:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i > 2:
                parts.append(self.piece[i])
        if run:
            parts.append(run.decode("utf-8", "replace"))
        return "".join(parts)[1:].replace(MARK, " ")

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 texts of the ids between bounds: pieces and bytes are gathered, marks become spaces, the first mark goes.

        Bytes that make no characters, which encoding never gives, are replaced as decode() does.
        """
        raw, at = _gathered(self.shown, np.where(ids > 2, ids, 0), bounds)
        places = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return [self.decode(ids[a:b].tolist()).encode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return [raw[a:b].replace(_MARK, b" ")[1:] for a, b in places]

    def written(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The ids between bounds as decimal numbers, one space between."""
        raw, at = _gathered(self.names, ids, bounds)
        return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_MARK = MARK.encode()


def _gathered(texts: pa.Array, at: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts at places, one after another, and where in them the stretches between bounds begin and end."""
    taken = texts.take(pa.array(at))
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    return taken.buffers()[2].to_pybytes() if len(taken) else b"", offsets[bounds]


class WordCache:
    """Ids of distinct words: code of each word, and the ids of each code in a pool."""

    def __init__(self, codec: PieceCodec):
        self.codec = codec
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.pool, self.held = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.codec.merge_words(words)
        n, total = len(self.codes), len(ids)
        for name, need in (("pool", self.held + total), ("start", n + len(words)), ("count", n + len(words))):
            x = getattr(self, name)
            if need > len(x):
                setattr(self, name, np.concatenate([x, np.zeros(max(need - len(x), len(x)), x.dtype)]))
        self.pool[self.held : self.held + total] = ids
        self.start[n : n + len(words)] = self.held + np.cumsum(counts) - counts
        self.count[n : n + len(words)] = counts
        self.held += total
        self.codes.update(zip(words, range(n, n + len(words)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, each with the end id, and the bounds of each text's ids."""
        raws = [(MARK + t.replace(" ", MARK)).encode() if t else b"" for t in texts]
        begins = np.concatenate([[0], np.cumsum([len(r) for r in raws], dtype=np.int64)])
        flat = np.frombuffer(b"".join(raws), np.uint8)
        ids, upto = np.zeros(0, np.int32), np.zeros(len(begins), np.int64)
        if len(flat):
            mark = np.zeros(len(flat) + 3, bool)  # places 3 further on, so that the place before is always there
            mark[3:-2] = (flat[:-2] == _MARK[0]) & (flat[1:-1] == _MARK[1]) & (flat[2:] == _MARK[2])
            first = np.zeros(len(flat) + 1, bool)
            first[begins[:-1]] = True
            starts = np.flatnonzero(mark[3:] & (~mark[:-3] | first[:-1]))
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(flat)).astype(np.int64)), pa.py_buffer(flat)).dictionary_encode()
            known = words.dictionary.to_pylist()
            find = lambda: np.fromiter(map(self.codes.get, known, repeat(-1)), np.int64, len(known))
            code = find()
            if len(self.codes) + (code < 0).sum() > CACHE_WORDS:
                self.forget()
                code = find()
            fresh = np.flatnonzero(code < 0)
            if len(fresh):
                code[fresh] = len(self.codes) + np.arange(len(fresh))
                self._learn([known[i] for i in fresh.tolist()])
            code = code[words.indices.to_numpy()]
            count = self.count[code]
            ends = np.cumsum(count)
            ids = self.pool[np.repeat(self.start[code] - (ends - count), count) + np.arange(ends[-1])]
            upto = np.concatenate([[0], ends])[np.searchsorted(starts, begins)]
        return np.insert(ids, upto[1:], self.codec.end), upto + np.arange(len(begins))


_CODECS: dict[str, WordCache] = {}


def _cache(model_file: str) -> WordCache:
    if model_file not in _CODECS:
        _CODECS[model_file] = WordCache(PieceCodec(model_file))
    return _CODECS[model_file]


def encode_texts(texts: list[str | None], model_file: str) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
    """For each text its ids, end id included, the same written in decimals, and the text decoded from them as UTF-8."""
    cache = _cache(model_file)
    at = 0
    while at < len(texts):
        block, chars = [], 0
        while at < len(texts) and (not block or chars < BLOCK_CHARS):
            block.append(texts[at] or "")
            chars += len(block[-1])
            at += 1
        ids, bounds = cache.encode(block)
        own = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield from zip(own, cache.codec.written(ids, bounds), cache.codec.decode_all(ids, bounds), strict=True)


def encode(docs: DataFrame, model_file: str | None = None, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), with `ids` as an array of integers and `decoded` if asked for."""
    model_file = model_file or default_model()
    source = docs.select(F.col(key), F.col(text).alias("text"))
    kind = source.schema[key].dataType.simpleString()
    more = ", ids array<int>, decoded string" if ids else ""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, STEP):
                rows = list(encode_texts(texts.slice(i, STEP).to_pylist(), model_file))
                out = [keys.slice(i, STEP), pa.array([len(a) for a, _, _ in rows], pa.int64()), pa.array([hashlib.sha256(w).hexdigest() for _, w, _ in rows], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for _, _, d in rows], pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    out += [pa.array([a.astype(np.int32) for a, _, _ in rows], pa.list_(pa.int32())), pa.array([d.decode() for _, _, d in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
