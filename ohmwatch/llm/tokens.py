"""Token ids of whole texts with a public vocabulary of the tokenizers library."""

from __future__ import annotations

import itertools
import os
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ohmwatch.llm.arrays import BLANKS, LOWER, U64, distinct, positions, ragged, row_sums, span_hashes, spans, texts

END = 1
#: Known chunks after which a worker starts anew.
KNOWN = 1 << 20

# Byte classes for cutting: 0 blank, 1 ASCII letter or digit, 2 other ASCII mark, 3 the rest.
_KIND = np.full(256, 3, np.uint8)
_KIND[0x21:0x7F] = 2
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _KIND[_low:_high] = 1
_KIND[0x27] = 3  # an apostrophe may begin a contraction
_KIND[list(BLANKS)] = 0


class Encoder:
    """Ids of texts as ``encode(text, add_special_tokens=False)`` gives them.

    The vocabulary's rules lower-case, drop blanks and never join a letter or digit to a
    mark, so texts are lower-cased (A-Z) and cut at blanks and between ASCII letters or digits and
    ASCII marks other than the apostrophe.  Each distinct chunk is encoded by the library
    once and remembered by a 64-bit hash.  A text with ``<|``, where a special token may begin, is encoded
    whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place = np.zeros(0, U64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Encode new chunks; their hashes are sorted."""
        found = [code.ids for code in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
        place = len(self.first) + np.arange(len(found))
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.place = np.insert(self.hashes, at, hashes), np.insert(self.place, at, place)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END after each text, and the number of ids of each text."""
        if len(self.hashes) > KNOWN:
            self._forget()
        data, offsets = texts(column)
        low = LOWER[data]
        kind = _KIND[data]
        starts, ends = spans(kind != 0, offsets)
        cut = np.flatnonzero(((kind[1:] == 1) & (kind[:-1] == 2)) | ((kind[1:] == 2) & (kind[:-1] == 1))) + 1
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        cut = cut[~edge[cut]]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        raw = low.tobytes()
        whole = self._special(data, offsets)
        h = span_hashes(low, starts, ends)
        order = np.argsort(h)
        ordered = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        own, where = ordered[new], order[new]
        index = np.empty(len(h), np.int64)
        index[order] = np.cumsum(new) - 1
        _, known = positions(self.hashes, own)
        if not known.all():
            new = where[~known]
            self._learn(own[~known], [raw[s:e].decode() for s, e in zip(starts[new].tolist(), ends[new].tolist())])
        at, _ = positions(self.hashes, own)
        place = self.place[at][index]
        sizes = self.size[place]
        bounds = np.searchsorted(starts, offsets)
        n_ids = row_sums(sizes, bounds)
        ids = self.pool[ragged(self.first[place], sizes)]
        if len(whole):
            ids, n_ids = self._replace(ids, n_ids, whole, data, offsets)
        return np.insert(ids, np.cumsum(n_ids), END).astype(np.uint32), n_ids + 1

    def _special(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = np.flatnonzero((data[1:] == ord("|")) & (data[:-1] == ord("<")))
        return distinct(np.searchsorted(offsets, at, "right") - 1)

    def _replace(self, ids, n_ids, whole, data, offsets):
        raw = [data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in whole.tolist()]
        own = dict(zip(whole.tolist(), (c.ids for c in self.tokenizer.encode_batch(raw, add_special_tokens=False))))
        ends = np.cumsum(n_ids)
        parts = [np.array(own[r], np.uint32) if r in own else ids[e - n : e] for r, (e, n) in enumerate(zip(ends.tolist(), n_ids.tolist()))]
        return np.concatenate(parts), np.array([len(p) for p in parts])


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder; it keeps what it knows for the worker's next tasks."""
    held = sys.modules.setdefault("_known_token_chunks", types.ModuleType("_known_token_chunks"))
    if getattr(held, "vocabulary", None) != vocabulary:
        held.encoder, held.vocabulary = Encoder(vocabulary), vocabulary
    return held.encoder


def shared_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast (a few MB), so that only the driver needs it."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())
