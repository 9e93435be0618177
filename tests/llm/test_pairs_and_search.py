"""MinHash links, collocations and ranked search against brute force, on given tables and on awkward rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import database, difference
from ohmwatch.llm import collocations, lexical_search, minhash
from ohmwatch.llm.queries import table

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "One"), (None, "two words"), (5, "é. " * 30_000), (6, "the mit license " * 300),
    (7, "a<|endoftext|>b it's THE 's'. x\x1cy É.è ***"), (8, "Licensed under the Apache License, Version 2.0."), (9, "\n\n.\n.\n"), (10, "one"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, None if k % 2 else "en", "x", 1, 2) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, score int, n_shingles int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.mark.parametrize("name", ["op11_collocations", "op12_search", "op13_minhash"])
def test_twins(spark, sf, name):
    assert difference(spark, database(sf), sf, name) is None


# -- MinHash -----------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(pairs):
    """(id, set size, least id of the component) of each (id, text)."""
    sets, root = [shingles(t) for _, t in pairs], list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(pairs):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return sorted(((x, len(sets[i]), least.get(find(i))) for i, (x, _) in enumerate(pairs)), key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_minhash_on_awkward_and_empty_tables(awkward, empty):
    assert rows(minhash.digest(awkward)) == linked(AWKWARD)
    kept = {(r.doc_id, r.kept) for r in minhash.digest(awkward).collect()}
    assert {(1, True), (4, True), (10, False), (None, True)} <= kept and minhash.digest(awkward).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash.digest(empty).count() == 0


@pytest.mark.parametrize("group", [1024, 8])
def test_a_crowded_family_near_the_bound(spark, group):
    """A hundred copies of one text whose pairs lie on both sides of the bound, and strangers."""
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 4000, 160)]
    made = []
    for k in range(100):
        text = list(base)
        for at in rng.choice(160, int(rng.integers(1, 6)), replace=False):
            text[at] = f"new{k}x{at}"
        made.append((k, " ".join(text)))
    made += [(100 + k, " ".join(f"s{x}" for x in rng.integers(0, 4000, 80))) for k in range(20)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(minhash.near_groups(df, group=group)) == linked(made)


def test_estimates_are_corrected_for_collisions():
    rng = np.random.default_rng(2)
    for fields, bits in ((minhash._FIELDS, minhash.BITS), (minhash.LONG, 1)):
        for shared in (0, 500, 850, 1000):
            h = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            sets = [np.sort(h[:1000]), np.sort(h[1000 - shared : 2000 - shared])]
            least = minhash.minima(np.concatenate(sets), np.array([0, 1000, 2000]), fields)
            one, two = minhash.packed(least, bits)
            apart = int(minhash.differing(one[None], two[None], bits)[0])
            true = shared / (2000 - shared)
            assert abs(minhash.estimate(apart, fields, bits) - true) < 5 * math.sqrt(1 / fields / (1 - 2.0**-bits))
            assert true < 0.85 or apart <= minhash.most_apart(85, fields, bits)


def test_texts_at_the_bound_share_a_band():
    """The recall that the docstring states, at just 0.85."""
    rng = np.random.default_rng(3)
    sets, bounds = [], [0]
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        for own in (np.sort(h[:185]), np.sort(h[15:200])):
            sets.append(own)
            bounds.append(bounds[-1] + len(own))
    keys = minhash.band_keys(minhash.minima(np.concatenate(sets), np.array(bounds)))
    assert (keys[::2] == keys[1::2]).any(axis=1).all()


def test_spanning_forests_join_what_pairs_join():
    rng = np.random.default_rng(4)
    i, j = np.sort(rng.integers(0, 50, (2, 120)), axis=0)
    i, j = i[i < j], j[i < j]
    chosen = minhash.spanning(50, i, j, rng.integers(0, 9, len(i)))
    nodes, roots = minhash.forest(i, j)
    again, same = minhash.forest(i[chosen], j[chosen])
    assert (nodes == again).all() and (roots == same).all() and len(chosen) == len(set(chosen.tolist())) < 100


# -- collocations ------------------------------------------------------------------------------


def ranked(pairs, least, top=2000):
    words, counts = Counter(), defaultdict(Counter)
    for lang, text in pairs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in cand.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * f[q]}
        found = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min(((1_000_000 * a * a) // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, left, r, words[lang], -s) for n, (s, a, p, left, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("budget, top", [(1 << 20, 2000), (150, 2000), (20, 7)])
def test_collocations_equal_brute_force_for_any_budget(spark, budget, top):
    """Down to groups of 20 suffixes: hot words are extended to two and three words."""
    rng = np.random.default_rng(6)
    vocabulary = ["The", "the", "of", "É", "é", "x\x1cy", "it's", *[f"w{i}" for i in range(30)]]
    odds = np.array([1 / (k + 1) for k in range(len(vocabulary))])
    texts = []
    for k in range(60):
        w = rng.choice(vocabulary, int(rng.integers(1, 90)), p=odds / odds.sum())
        texts.append((["en", "fr", None, "und"][k % 4], "".join(x + str(rng.choice([" ", " ", "\t ", ". ", "\n"])) for x in w)))
    df = spark.createDataFrame([(l, t, 1, 2) for l, t in texts], "lang string, text string, rank int, c int")
    got = sorted(map(tuple, collocations.collocations(df, least=4, top=top, budget=budget).collect()))
    assert got == ranked(texts, 4, top) and len(got) > 15


def test_collocations_of_awkward_and_empty_tables(awkward, empty):
    pairs = [("en" if k % 2 == 0 else None, t) for k, (_, t) in enumerate(AWKWARD)]
    assert sorted(map(tuple, collocations.collocations(awkward).collect())) == ranked(pairs, 10)
    assert collocations.collocations(empty).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    """1,000,000 * a * a passes 64 bits from three million occurrences on; counted here by one text's copies."""
    text = "a b " * 2000
    df = spark.range(1600).selectExpr("'en' AS lang", f"'{text}' AS text")
    first = collocations.collocations(df, top=3).collect()
    a = 1600 * 2000
    f = {"a": a, "b": a, "a b": a, "b a": a - 1600, "a b a": a - 1600, "b a b": a - 1600}
    for r in first:
        w = r.phrase.split()
        cuts = [((10**6 * f[r.phrase] ** 2) // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
        assert r.a == f[r.phrase] and r.score == min(cuts)[0]


@pytest.mark.parametrize("high", [1, 300, 1 << 20, 1 << 40])
def test_blocks_keep_their_suffixes(high):
    rng = np.random.default_rng(high % 97)
    columns = [rng.integers(0, 1 << 63, 50, dtype=np.uint64)[rng.integers(0, 50, 500)] for _ in range(3)]
    counts = rng.integers(1, high + 1, 500)
    back = collocations.unpack_block(collocations.pack_block(tuple(columns), counts))
    assert all((a == b).all() for a, b in zip(back, [*columns, counts]))


# -- ranked search ------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def searched(docs, items, top=20):
    bags = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(bool(b) for b in bags), sum(map(Counter.total, bags))
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (i, _), b in zip(docs, bags):
            m = 75 + (25 * b.total() * n_docs) // max(1, total)
            score = 0
            for t in terms(text):
                if b[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, n, i, -s) for n, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"size": 60, "block": 9}, {"limit": 12, "size": 100, "block": 4}])
def test_search_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(80)]
    odds = np.array([1 / (k + 1) for k in range(80)])
    draw = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(i, draw(int(rng.integers(0, 60)))) for i in range(400)]
    docs += [(500, docs[3][1]), (501, docs[3][1]), (None, docs[3][1]), (502, None), (3, docs[3][1])]
    items = [(k, draw(12)) for k in range(9)] + [(20, None), (21, "unknown"), (22, docs[3][1]), (22, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("terms", F.lit("x")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit(2))
    got = lexical_search.ranked(df, asked, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == searched(docs, items)


def test_search_on_awkward_and_empty_tables(spark, awkward, empty, sf):
    items = [(1, "The MIT license"), (2, "one"), (3, "É è"), (4, "")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical_search.ranked(awkward, asked).collect()), key=repr) == searched(AWKWARD, items)
    assert lexical_search.ranked(empty, asked).count() == 0
    none = asked.limit(0)
    assert lexical_search.ranked(table(spark, sf, "documents"), none).count() == 0


def test_bounds_hold_and_blocks_are_skipped():
    """No text of a block scores above its bound, and most blocks of a selective query are never read."""
    rng = np.random.default_rng(8)
    n, width = 3000, 200
    ptr = np.arange(n + 1) * 12
    term = np.concatenate([np.sort(rng.choice(width, 12, replace=False)) for _ in range(n)])
    impact = rng.integers(1, 900_000, len(term))
    segment = lexical_search.Segment.made(np.arange(n), np.zeros(n, bool), ptr, term, impact, rng.integers(0, 5000, width), 16)
    back = lexical_search.Segment.unpacked(segment.packed())
    own, value = np.array([3, 50, 120]), np.array([4000, 900, 10])
    full = np.zeros(width, np.int64)
    full[own] = value
    blocks = np.arange(len(back.block_ptr) - 1)
    bound = back.bounds(blocks, own, value)
    top = np.array([back.scores(back.block_docs[back.block_ptr[b] : back.block_ptr[b + 1]], full).max() for b in blocks])
    assert (top <= bound).all()
    best, seen = lexical_search.Best(5), np.zeros(n, bool)
    read = []
    scores = back.scores
    back.scores = lambda docs, value: read.append(len(docs)) or scores(docs, value)
    lexical_search._find(back, best, own, value, full, back.most(), seen)
    every = scores(np.arange(n), full)
    assert best.score.tolist() == np.sort(every)[::-1][:5].tolist() and sum(read) < n / 4 and not seen.any()
