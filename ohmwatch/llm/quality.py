"""Quality rules by weak supervision: rules vote or abstain, EM finds how far to trust each.

Every rule votes 1 (keep), -1 (reject) or 0 (abstain) on measures of the whole text.
Documents with the same votes are counted together in Spark, so expectation-maximisation
sees at most 3 ** rules vote patterns, whatever the corpus.  It estimates
how right each rule's votes are, and the share of good documents; a document's
posterior is the sum of its votes' log odds, a plain column expression.

A null or empty text has no words and lines.  Words are ``[^\\x20\\x09-\\x0D]+``.  Repeated rows
are judged alike.  An empty table leaves the starting values as the model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmwatch.llm.arrays import (
    NOT_BLANK, U64, mixed, per_row, row_sums, span_hashes, spans, stored, texts, window_hashes, with_struct,
)

WINDOW = 5
ROUNDS = 50
#: Posterior from which a document stays.
KEEP = 0.5
#: Beliefs: a reject is right so often; so many texts that no rule rejects are good.
RIGHT, SILENT = 0.95, 0.97

FIELDS = dict.fromkeys(
    ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_stops"], "long"
)

# The byte classes of the measures.
SYMBOLS, UPPER, LETTERS, SHOUTS, STOPS = (np.zeros(256, bool) for _ in range(5))
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER[65:91] = True
LETTERS[65:91] = LETTERS[97:123] = True
SHOUTS[ord("!")] = True
STOPS[list(b".!?")] = True

_ROW = U64(0xD6E8FEB86659FD93)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and which of them (in order) equal the one before."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    return order, same


def measures(column) -> list[np.ndarray]:
    data, offsets = texts(column)
    inside = NOT_BLANK[data]
    starts, ends = spans(inside, offsets)
    first = per_row(starts, offsets)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(n_words)), n_words)

    def count(flags):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_end = np.sort(np.concatenate([breaks, offsets[1:]]))
    some = filled[line_end] > filled[line_start]
    line_start, line_end = line_start[some], line_end[some]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    order, same = _repeated(mixed(span_hashes(data, line_start, line_end) + line_row.astype(U64) * _ROW))
    n_rows = len(n_words)
    dup_lines = np.bincount(line_row[order][same], minlength=n_rows)

    words = span_hashes(data, starts, ends)
    at = np.arange(len(words))
    at = at[at + WINDOW <= first[1:][row]]
    order, same = _repeated(mixed(window_hashes(words, at, WINDOW) + row[at].astype(U64) * _ROW))
    again = same.copy()
    again[:-1] |= same[1:]
    hit = at[order][again]
    edge = np.bincount(hit, minlength=len(words) + 1) - np.bincount(hit + WINDOW, minlength=len(words) + 1)
    covered = np.cumsum(edge)[:-1] > 0
    return [
        n_words, count(inside & ((data & 0xC0) != 0x80)), count(SYMBOLS[data]), dup_lines, row_sums(covered, first),
        np.bincount(line_row, minlength=n_rows), count(UPPER[data]), count(LETTERS[data]), count(SHOUTS[data]), count(STOPS[data]),
    ]


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column of the measures, and its name."""
    return with_struct(docs, text, "measures", FIELDS, lambda: measures)


def votes(m) -> dict[str, Column]:
    """The rules; ``m`` gives the column of a measure.

    A rule that looks for one fault abstains where it finds none; the last three also
    speak for a text.
    """
    words, lines = m("n_words"), m("n_lines")
    mean = m("word_chars") / F.greatest(words, F.lit(1))
    return {
        "symbols": F.when(10 * m("n_symbols") > words, -1).otherwise(0),
        "lines": F.when(2 * m("n_dup_lines") > lines, -1).otherwise(0),
        "repeats": F.when(5 * m("n_repeat_words") > words, -1).otherwise(0),
        "capitals": F.when(2 * m("n_upper") > m("n_letters"), -1).otherwise(0),
        "shouting": F.when(3 * m("n_shouts") > words, -1).otherwise(0),
        "length": F.when(words < 10, -1).when(words >= 50, 1).otherwise(0),
        "word_length": F.when(~mean.between(2.5, 12.0), -1).when(mean.between(3.5, 8.0), 1).otherwise(0),
        "sentences": F.when(200 * m("n_stops") < words, -1).when(50 * m("n_stops") >= words, 1).otherwise(0),
    }


@dataclass
class Model:
    """Log odds of good against bad: of any document, and what each vote adds."""

    prior: float
    reject: list[float]
    keep: list[float]
    silent: float

    def posterior(self, m) -> Column:
        cast = votes(m).values()
        rejected = F.lit(False)
        odds = F.lit(self.prior)
        for vote, reject, keep in zip(cast, self.reject, self.keep):
            odds = odds + F.when(vote == 1, keep).when(vote == -1, reject).otherwise(0.0)
            rejected = rejected | (vote == -1)
        return 1 / (1 + F.exp(-(odds + F.when(rejected, 0.0).otherwise(self.silent))))


def _logit(share):
    return np.log(share) - np.log1p(-share)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """EM over vote patterns (rows of -1, 0, 1) and their counts.

    What a vote adds is the log odds of good among the texts that got it, less those of
    all texts.  Faults exclude each other, so their rules' abstentions count once: as the
    event that no rule rejects.  Beliefs (RIGHT, SILENT) weigh as much as the counted texts,
    for a fault that no second rule sees cannot be judged by agreement.
    """
    n_rules = len(votes(F.col))
    patterns = patterns.reshape(-1, n_rules)
    rejects, keeps = (patterns == -1).astype(float), (patterns == 1).astype(float)
    silent = ~rejects.any(axis=1)
    good = np.where(silent, SILENT, 1 - RIGHT)
    total = counts.sum()
    for _ in range(rounds):
        prior = float(_logit((counts @ good + SILENT) / (total + 1)))
        n = counts @ rejects
        share = (((counts * good) @ rejects) + (n + 1) * (1 - RIGHT)) / (2 * n + 1)
        reject = np.minimum(_logit(share) - prior, 0)
        n = counts @ keeps
        share = ((counts * good) @ keeps + SILENT) / (n + 1)
        keep = np.clip(_logit(np.minimum(share, 1 - 1e-9)) - prior, 0, 1)
        n = counts[silent].sum()
        quiet = float(_logit(((counts * good)[silent].sum() + (n + 1) * SILENT) / (2 * n + 1)) - prior)
        good = 1 / (1 + np.exp(-np.clip(prior + rejects @ reject + keeps @ keep + silent * quiet, -500, 500)))
    return Model(prior, reject.tolist(), keep.tolist(), quiet)


def fit(frame: DataFrame, m) -> Model:
    """Count the vote patterns of all rows in Spark and estimate the model from them."""
    rules = votes(m)
    rows = frame.groupBy(*[v.alias(k) for k, v in rules.items()]).count().collect()
    return estimate(np.array([r[:-1] for r in rows], np.int64), np.array([r[-1] for r in rows], float))


def base_failed(m) -> Column:
    return (m("n_words") < 10) | (100 * m("n_repeat_words") > 20 * m("n_words"))


def digest(docs: DataFrame) -> DataFrame:
    """Measures and verdict for each document."""
    frame, name = measured(docs.select("doc_id", "text"))
    frame = stored(frame.select("doc_id", f"{name}.*"), "quality")
    posterior = fit(frame, F.col).posterior(F.col)
    return frame.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed(F.col).alias("base_failed"),
        (~base_failed(F.col) & (posterior >= KEEP)).alias("kept"),
        posterior.alias("posterior"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged; the texts are measured twice, not stored."""
    frame, name = measured(docs, text)

    def m(field):
        return F.col(f"`{name}`.{field}")

    narrow, own = measured(docs.select(text), text)
    model = fit(narrow, lambda field: F.col(f"`{own}`.{field}"))
    return frame.filter(~base_failed(m) & (model.posterior(m) >= KEEP)).drop(name)
