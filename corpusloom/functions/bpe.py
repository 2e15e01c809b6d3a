"""Byte-level BPE ids of a column of texts, by distinct pieces.

The byte-level pattern always cuts before a single space and around a single line end that stand between characters
other than white space, and where a letter is followed by neither a letter nor white space, so what lies between such
places can be encoded on its own. The pieces of a block of texts are
cut as offsets into the block's bytes, encoded as an Arrow dictionary, and only the distinct pieces that the cache does
not hold reach the tokenizers library; ids of the texts are then gathered from a pool. Python code runs once for each
distinct piece of a block, everything else is numpy or Arrow.

Memory is bounded: blocks of BLOCK_BYTES bytes (or one longer text), and a cache that is emptied at CACHE_PIECES pieces.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 23
CACHE_PIECES = 500_000
LINE, BLANK = 10, 32
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Letters of one byte, and bytes of one-byte characters that are neither letters nor white space.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = ~_ASCII_SPACE & ~_LETTER & (np.arange(256) > 32) & (np.arange(256) < 127)
#: The character that stands for each byte: itself where it can be printed, else the next one from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SHOWN = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_WORD = re.compile("\x20?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
_ENCODERS: dict[str, PieceEncoder] = {}


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    """x moved by places, with zeros where nothing comes in."""
    out = np.zeros_like(x)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def space_bytes(flat: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a white space character of Unicode."""
    space = _ASCII_SPACE[flat]
    if flat.max(initial=0) < 0x80:
        return space
    a, b = _shift(flat, -1), _shift(flat, -2)
    two = (flat == 0xC2) & ((a == 0x85) | (a == 0xA0))
    general = (a == 0x80) & ((b >= 0x80) & (b <= 0x8A) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF)) | (a == 0x81) & (b == 0x9F)
    three = (flat == 0xE1) & (a == 0x9A) & (b == 0x80) | (flat == 0xE2) & general | (flat == 0xE3) & (a == 0x80) & (b == 0x80)
    return space | two | _shift(two, 1) | three | _shift(three, 1) | _shift(three, 2)


def piece_starts(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places at which pieces start, among bytes of texts that begin (and are not empty) at begins."""
    space = space_bytes(flat)
    first = np.zeros(len(flat) + 1, bool)
    first[begins] = True
    first[-1] = True
    # white space with other characters of the same text on both sides
    alone = space & ~_shift(space, 1) & ~_shift(space, -1) & ~first[:-1] & ~first[1:]
    line = alone & (flat == LINE)
    latin = (_shift(flat, 1) == 0xC3) & (flat != 0x97) & (flat != 0xB7)  # the Latin letters of two bytes from 0xC3 on
    ended = _shift(_LETTER[flat] | latin, 1) & _OTHER[flat]
    return np.flatnonzero(first[:-1] | alone & (flat == BLANK) | line | _shift(line, 1) | ended)


class PieceEncoder:
    """Encoder of one tokenizer file with its cache: code of each piece, and the ids of each code in a pool."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter = spec["pre_tokenizer"] or {}
        #: Whether the file is byte-level BPE with the usual pattern and nothing before it; other files encode whole texts.
        self.cuts = spec["normalizer"] is None and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True) and spec["model"]["type"] == "BPE"
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.pool, self.held = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece.

        A run of Latin letters, after a space or not, is one match of the pattern, so the library's model takes its bytes at
        once (in the characters that stand for them); other pieces go through the whole tokenizer.
        """
        words = list(map(_WORD, pieces))
        merged = self.tok.model.tokenize
        rest = iter(self.tok.encode_batch_fast([p for p, w in zip(pieces, words, strict=True) if w is None], add_special_tokens=False))
        return [next(rest).ids if w is None else [t.id for t in merged(p.encode().decode("latin-1").translate(_SHOWN))] for p, w in zip(pieces, words, strict=True)]

    def _learn(self, pieces: list[str]) -> None:
        ids = self._ids(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.codes), int(sizes.sum())
        for name, need in (("pool", self.held + total), ("start", n + len(ids)), ("count", n + len(ids))):
            x = getattr(self, name)
            if need > len(x):
                setattr(self, name, np.concatenate([x, np.zeros(max(need - len(x), len(x)), x.dtype)]))
        self.pool[self.held : self.held + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.start[n : n + len(ids)] = self.held + np.cumsum(sizes) - sizes
        self.count[n : n + len(ids)] = sizes
        self.held += total
        self.codes.update(zip(pieces, range(n, n + len(ids)), strict=True))

    def _plain(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(bounds)
        starts = piece_starts(flat, bounds[:-1][sizes > 0])
        offsets = np.append(starts, len(flat)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(flat)).dictionary_encode()
        known = pieces.dictionary.to_pylist()
        find = lambda: np.fromiter(map(self.codes.get, known, repeat(-1)), np.int64, len(known))
        code = find()
        if len(self.codes) + (code < 0).sum() > CACHE_PIECES:
            self._forget()
            code = find()
        fresh = np.flatnonzero(code < 0)
        if len(fresh):
            code[fresh] = len(self.codes) + np.arange(len(fresh))
            self._learn([known[i] for i in fresh.tolist()])
        code = code[pieces.indices.to_numpy()]
        count = self.count[code]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(self.start[code] - (ends - count), count) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]
        return ids, np.diff(upto)

    def encode(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another and the number of ids of each; flat: their bytes, bounds: where they begin and end."""
        none = np.zeros(0, np.uint32)
        if not len(flat):
            return none, np.zeros(len(bounds) - 1, np.int64)
        raw = flat.tobytes()
        if self.cuts and not any(s in raw for s in self.special):
            return self._plain(flat, bounds)
        out, counts = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if not self.cuts or any(s in raw[a:b] for s in self.special):
                out.append(np.array(self.tok.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32))
            else:
                out.append(self._plain(flat[a:b], np.array([0, b - a]))[0] if b > a else none)
            counts.append(len(out[-1]))
        return np.concatenate(out), np.array(counts, np.int64)


def encoder(path: str) -> PieceEncoder:
    """The encoder of a file; one for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_array(texts: pa.Array, path: str, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first, end, ids, counts) of a string array; null counts as the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + block, side="right")) - 1)
        j = min(j, len(texts))
        ids, counts = encoder(path).encode(np.ascontiguousarray(flat[bounds[i] : bounds[j]]), bounds[i : j + 1] - bounds[i])
        yield i, j, ids, counts
        i = j
