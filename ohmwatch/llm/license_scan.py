"""Licence scan with a positional index of rare words; column expressions only.

The templates' words are weighted by inverse document frequency among the templates; each
template's ANCHORS rarest words are indexed with their positions.  A text's words are looked up
in the index; a hit at word i of a posting (template, p) proposes that the template
starts at word i - p.  Proposals on which at least two anchors agree by relative position
(or all, if a template has fewer) are verified by the template's mandatory phrase.  The score
is the weighted share of a verified template's words that stand at their places.

Beside the templates' labels, base labels mark every place of a few fixed phrases.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing; beyond A-Z the case of a letter
decides no label, for all phrases are plain ASCII.  Null and empty texts have no words,
no labels and score 0.  A row never leaves its task, so repeated rows and hot sources
cost nothing extra.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

ANCHORS = 3

# Base phrases with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices in common use, as (label, words, mandatory phrase).
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this program is free software licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)

#: Words too common in any text to be worth a lookup.
COMMON = frozenset("a and any are by for in is of or the this to under with 0 2 3 4".split())


def _array(values) -> str:
    return "array(" + ", ".join(values) + ")"


def _stands(at: str, words: list[str]) -> str:
    """The words stand one after the other from word ``at`` of the text."""
    return " AND ".join(f"get(words, {at} + {k}) = '{w}'" for k, w in enumerate(words))


class Index:
    """Weights, anchors, postings and mandatory phrases of the templates, as SQL literals."""

    def __init__(self, templates=TEMPLATES):
        self.names = [name for name, _, _ in templates]
        self.words = [text.split() for _, text, _ in templates]
        seen = Counter(w for words in self.words for w in set(words))
        self.weight = {w: math.log((1 + len(templates)) / n) for w, n in seen.items()}
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.anchors: list[list[tuple[int, str]]] = []
        for t, words in enumerate(self.words):
            rare = sorted(set(words) - COMMON, key=lambda w: (-self.weight[w], -len(w), w))[:ANCHORS]
            self.anchors.append([(p, w) for p, w in enumerate(words) if w in rare])
            for p, w in self.anchors[-1]:
                self.postings.setdefault(w, []).append((t, p))
        self.phrases = [phrase.split() for _, _, phrase in templates]
        self.phrase_at = [
            next(i for i in range(len(w)) if w[i : i + len(ph)] == ph) for w, ph in zip(self.words, self.phrases)
        ]

    def lookup(self, word: str) -> str:
        """Postings of a word as SQL: templates and positions."""
        cases = " ".join(
            f"WHEN '{w}' THEN {_array(f'named_struct({chr(39)}t{chr(39)}, {t}L, {chr(39)}p{chr(39)}, {p}L)' for t, p in places)}"
            for w, places in self.postings.items()
        )
        return f"CASE {word} {cases} ELSE CAST(array() AS array<struct<t: bigint, p: bigint>>) END"

    def each(self, t: str, values) -> str:
        return f"CASE {t} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: Room for templates that would start before the text does.
_BEFORE = 1 << 20
_TEMPLATE = 1 << 44


def scan(docs: DataFrame, text: str = "text", index: Index | None = None) -> DataFrame:
    """``doc_id`` and the digest of each text: places of the base phrases, labels, score."""
    index = index or Index()
    wanted = sorted({phrase.split()[0] for phrase in BASE} | set(index.postings))
    split = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    t, at = f"(c div {_TEMPLATE}L)", f"(int(c % {_TEMPLATE}L) - {_BEFORE})"
    base = " ".join(
        f"WHEN {_stands('i', p.split())} THEN '{label}'" for p, label in BASE.items()
    )
    needed = index.each(t, (min(2, len({w for _, w in a})) for a in index.anchors))
    agreeing = index.each(t, (" + ".join(f"int(coalesce(get(words, {at} + {p}) = '{w}', false))" for p, w in a) for a in index.anchors))
    phrase = index.each(t, (_stands(f"{at} + {p}", ph) for p, ph in zip(index.phrase_at, index.phrases)))
    share = index.each(
        t,
        (
            "(" + " + ".join(f"if(get(words, {at} + {p}) = '{w}', {index.weight[w]!r}D, 0D)" for p, w in enumerate(words))
            + f") / {sum(index.weight[w] for w in words)!r}D"
            for words in index.words
        ),
    )
    names = index.each(t, (f"'{n}'" for n in index.names))
    return (
        docs.selectExpr("doc_id", f"array_remove(split(lower(coalesce(`{text}`, '')), '{split}'), '') AS words")
        .selectExpr(
            "doc_id", "words",
            f"filter(if(size(words) = 0, array(), sequence(0, size(words) - 1)), i -> words[i] IN ({', '.join(f'{chr(39)}{w}{chr(39)}' for w in wanted)})) AS hits",
        )
        .selectExpr(
            "doc_id", "words",
            f"filter(transform(hits, i -> named_struct('i', bigint(i), 'label', CASE {base} END)), x -> x.label IS NOT NULL) AS base",
            f"array_distinct(flatten(transform(hits, i -> transform({index.lookup('words[i]')}, x -> x.t * {_TEMPLATE}L + i - x.p + {_BEFORE})))) AS proposed",
        )
        .selectExpr("doc_id", "words", "base", f"filter(filter(proposed, c -> {agreeing} >= {needed}), c -> {phrase}) AS found")
        # Behind a generator, so that no later filter is pushed below and repeats the scan.
        .selectExpr(
            "doc_id",
            "inline(array(struct(bigint(size(words)) AS n_words, bigint(size(base)) AS n_base, "
            "array_min(transform(base, x -> x.i)) AS first_word, array_max(transform(base, x -> x.i)) AS last_word, "
            "array_join(array_sort(array_distinct(transform(base, x -> x.label))), ',') AS base_labels, "
            f"array_join(array_sort(array_union(transform(base, x -> x.label), transform(found, c -> {names}))), ',') AS labels, "
            f"least(1D, coalesce(array_max(transform(found, c -> {share})), 0D)) AS score)))",
        )
    )
