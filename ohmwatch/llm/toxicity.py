"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the presence of words, word pairs, and pairs with one or two words between,
hashed to 2 ** BITS places.  Every coordinate has its own learning rate, and the L1
term keeps most weights at zero, so the model is a short list that is broadcast whole.

``fit`` uses at most about ``max_rows`` labelled documents: with more labels, those whose id
hashes below the matching rate.  They are dealt to shards of about ``shard_rows`` by
id; each shard learns on its own and the shards' weights are averaged.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Null and empty texts score
the bias alone.  Labels with a null id or label are left out, an id with several labels
counts as toxic if one says so.  Without labels every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmwatch.llm.arrays import LOWER, U64, WORD, distinct, mixed, per_row, pieces, row_sums, span_hashes, spans, texts, with_struct

BITS = 22
MAX_ROWS = 20_000
SHARD_ROWS = 5_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 5.0, 1.0, 4.0, 0.1
THRESHOLD = 0.7

_SHIFT = U64(64 - BITS)
#: (words apart, salt of the pair)
_PAIRS = ((1, U64(0xA24BAED4963EE407)), (2, U64(0x9FB21C651E98DF25)), (3, U64(0xC13FA9A902A6328F)))


def features(column) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of all features, the row of each, and the number of rows."""
    data, offsets = texts(column)
    low = LOWER[data]
    starts, ends = spans(WORD[data], offsets)
    first = per_row(starts, offsets)
    h = span_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    places, rows = [h >> _SHIFT], [row]
    for apart, salt in _PAIRS:
        inside = row[apart:] == row[:-apart]
        places.append((mixed(h[:-apart] * salt + h[apart:]) >> _SHIFT)[inside])
        rows.append(row[apart:][inside])
    return np.concatenate(places).astype(np.int64), np.concatenate(rows), len(first) - 1


def train(samples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not zero; place 2 ** BITS is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    order = np.arange(len(samples))
    rng = np.random.default_rng(17)

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            at = samples[k]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    at = np.flatnonzero(np.abs(z) > L1)
    return at, weights(at)


def _train_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row_hash", kind="stable")
    samples: list[np.ndarray] = []
    texts_ = pa.RecordBatch.from_arrays([pa.array(rows["text"], pa.string())], names=["text"])
    for piece in pieces([texts_], 0):
        places, row, n = features(piece.column(0))
        order = np.argsort(row, kind="stable")
        places, bounds = places[order], np.searchsorted(row[order], np.arange(n + 1))
        samples += [np.append(distinct(places[a:b]), 1 << BITS).astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])]
    at, weight = train(samples, rows["toxic"].to_numpy())
    return pd.DataFrame({"place": at, "weight": weight.astype(float)})


@dataclass
class Model:
    bias: float
    places: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BITS)
        full[self.places] = self.weights
        return full


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, shard_rows: int = SHARD_ROWS) -> Model:
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    n = known.count()
    if n == 0:
        return Model(-40.0, np.zeros(0, np.int64), np.zeros(0))
    scale = 1 << 20
    taken = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.lit(min(scale, scale * max_rows // n)))
    shards = max(1, -(-min(n, max_rows) // shard_rows))
    # Bounded by max_rows, so a small broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    # One row per id, or the equal rows of a repeated id would all meet in one shard.
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).withColumn("row_hash", F.xxhash64("doc_id", "text"))
    dealt = rows.withColumn("shard", F.pmod(F.shiftright("row_hash", 20), F.lit(shards)))
    parts = dealt.select("shard", "row_hash", "toxic", "text").groupBy("shard").applyInPandas(_train_shard, "place long, weight double")
    mean = parts.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).orderBy("place").toPandas()
    places, weights = mean["place"].to_numpy(np.int64), mean["weight"].to_numpy(float)
    bias = float(weights[places == 1 << BITS].sum())
    return Model(bias, places[places < 1 << BITS], weights[places < 1 << BITS])


def _scorer(shared):
    def start():
        model = shared.value
        table = model.table()

        def score(column):
            places, row, n = features(column)
            some = np.flatnonzero(table[places] != 0)
            pairs = distinct(row[some] * (1 << BITS) + places[some])
            bounds = np.searchsorted(pairs, np.arange(n + 1) << BITS)
            total = model.bias + row_sums(table[pairs & ((1 << BITS) - 1)], bounds)
            return [1 / (1 + np.exp(-np.clip(total, -500, 500)))]

        return score

    return start


def scored(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column that holds the score, and its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_struct(docs, text, "toxicity", {"score": "double"}, _scorer(shared))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    frame, name = scored(docs.select("doc_id", "text"), fit(docs, labels))
    score = F.col(f"{name}.score")
    return frame.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    frame, name = scored(docs, fit(docs, labels), text)
    return frame.filter(F.col(f"`{name}`.score") < THRESHOLD).drop(name)
