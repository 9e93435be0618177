"""The corpus operators against brute force, on given tables and on awkward rows."""

import collections
import html
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
from compare import database, difference
from ohmwatch.llm import (
    chat, decontamination, license_scan, main_text, packing, quality, simhash, suffix_tree, token_blocks, toxicity,
)
from ohmwatch.llm.queries import table, vocabulary

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (4, "One"), (None, "two words"), (5, "é. " * 60_000), (6, "the mit license " * 1000),
    (7, "a<|endoftext|>b it's THE 's'. x\x1cy É.è ***"), (8, "Licensed under the Apache License, Version 2.0."), (9, "\n\n.\n.\n"),
]
OPS = [q for q in contract.queries() if re.match(r"op\d+_", q)]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "x", 1, 2.0) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score int, matches double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def blank(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(vocabulary())
    return lambda text: [*known.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["op1_decontaminate", "op6_chat_format"])
def test_twins(spark, sf, name):
    assert difference(spark, database(sf), sf, name) is None


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(re.match(r"op(\d+)", q)[1]) for q in OPS) == list(range(1, 14))
    assert "pipeline" in contract.queries()


# -- decontamination ---------------------------------------------------------------


def _hits(text, items):
    w, hit, ids = alnum(text), set(), set()
    for i, t in items:
        v = alnum(t)
        k = min(10, len(v))
        for p in range(len(v) - k + 1 if k else 0):
            for x in range(len(w) - k + 1):
                if w[x : x + k] == v[p : p + k]:
                    hit.update(range(x, x + k))
                    ids.add(str(i) if i is not None else "null")
    return len(w), len(hit), len(ids)


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 40, "block_bytes": 20}])
def test_decontamination_on_awkward_rows(spark, limits):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "a b c"), (3, None), (4, "..."), (None, "x y"), (5, "a b c"), (6, "Ü ü")]
    texts = [long, f"{long} {long}", "A, b; c a b c", "x y x y", None, "", " ".join(long.split()[3:14]), " ".join(long.split()[3:12]), "ü Ü ü", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.digest(df, tests, **limits).collect()}
    assert got == {i: _hits(t, items) for i, t in enumerate(texts)}
    kept = decontamination.remove_contaminated(df.withColumn("matches", F.lit(1)), tests, **limits)
    assert kept.columns == ["doc_id", "text", "matches"]
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not _hits(t, items)[1]}


def test_longest_matches_and_places(spark):
    df = spark.createDataFrame([(1, "z z " + " ".join(f"w{i}" for i in range(4, 19)) + " z")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    scored, name = decontamination.with_matches(df, tests)
    assert [tuple(m) for m in scored.first()[name].matches] == [("9", 4, 2, 15)]


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(1)
    sizes = [40, 1, 30, 30]
    rank = np.concatenate([rng.integers(1, 3, n) for n in sizes])
    rank[71:] = rank[41:71]
    stop = np.repeat(np.cumsum(sizes), sizes)
    order = decontamination.suffix_array(rank, stop)
    suffixes = [rank[i : stop[i]].tolist() for i in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(len(rank)))


# -- main text -------------------------------------------------------------------------


def test_main_text_of_given_pages(spark, sf):
    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in contract.queries()["op2_main_text"](spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        cut = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in cut if x) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p", ""), ("<!-- x", ""), ("<script>var a='</p>'", ""),
        ("<article><h1>T</h1><p>a &amp; b&nbsp;&#233;<br>c\n d<aside>no</aside><form>no</form></article>", "T\na & b é c d"),
        ("<main><p>x</p><section id='comments'><p>no</p></section><div class='cookie-notice'>no</div></main>", "x"),
        ("<header><h1>no</h1></header><article><header><h1>T</h1></header><p>x<p>y</article><footer>no</footer>", "T\nx\ny"),
        ("<article><p>x</p><article class=comment><p>no</p></article></article>", "x"),
        ("<body><div class='nav'><a href=x>a</a></div><div><p>A long sentence, with marks; it goes on and on.</p><p>Another one, here it is.</p></div>"
         "<div><a href=y>link</a></div></body>", "A long sentence, with marks; it goes on and on.\nAnother one, here it is."),
    ],
)
def test_main_text_cases(page, text):
    assert main_text.main_text(page) == text


LONG = "A long sentence, with marks; it goes on and on."
COMMENT = "A reader says this, and then that; it is of some length, too."


@pytest.mark.parametrize(
    "page, text",
    [
        # Elements whose names begin like those without text, and some that close themselves.
        ("<article><p>x</p><svg-icon></svg-icon><style-guide>y</style-guide><svg class=i /><p>z</p><!--><p>w</p></article>", "x\ny\nz\nw"),
        ("<article><svg><path d='M0'/></svg><p>x</p></article>", "x"),
        # Quotes inside an unquoted value, and a greater-than sign inside a quoted one.
        ("<article><p title=don't>it's here</p><p title='a > b'>so</p></article>", "it's here\nso"),
        # Reader comments, however many there are.
        (f"<article><p>{LONG}</p><ol class='comment-list'><li>{COMMENT}</li><li>{COMMENT}</li></ol></article>", LONG),
        (f"<article><p>{LONG}</p></article><div class='comments-area'><p>{COMMENT}</p></div>", LONG),
        (f"<div><p>{LONG}</p></div><div id=comments>{f'<p>{COMMENT}</p>' * 3}</div>", LONG),
        (f"<body class='has-comments comments-open'><article><p>{LONG}</p></article></body>", LONG),
        # A page in one form; a form in a page.
        (f"<form><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><form><p>Your name, please.</p></form></article>", LONG),
    ],
)
def test_main_text_of_awkward_markup(page, text):
    assert main_text.main_text(page) == text


def test_main_text_of_an_empty_table_and_of_repeated_and_long_rows(spark):
    page = f"<article>{f'<p>{LONG}</p>' * 20_000}</article>"
    made = [(1, "u", page), (2, "u", None), (2, "u", None), (None, None, "<p>x</p>")]
    df = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = rows(main_text.extract(df))
    assert got == sorted([(1, "u", "\n".join([LONG] * 20_000), 20_000 * (len(LONG) + 1) - 1), (2, "u", "", 0), (2, "u", "", 0), (None, None, "x", 1)], key=repr)
    assert main_text.extract(df.limit(0)).count() == 0


# -- tokens ----------------------------------------------------------------------------


def _expected(pairs, encode):
    return {(i, len(ids), crc(ids)) for i, t in pairs for ids in [encode(t)]}


def test_token_blocks_round_trip(spark, docs, texts, encode):
    at, want = 0, []
    for i in sorted(texts):
        ids = encode(texts[i])
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert rows(token_blocks.round_trip(docs, vocabulary())) == sorted(want, key=repr)


def test_token_blocks_awkward_and_empty(awkward, empty, encode):
    got = token_blocks.round_trip(awkward, vocabulary()).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == _expected(AWKWARD, encode) and len(got) == len(AWKWARD)
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in ends] == np.cumsum([0, *(n for _, n in ends[:-1])]).tolist()
    assert token_blocks.round_trip(empty, vocabulary()).count() == 0


@pytest.mark.parametrize("high", [1, 2, 300, 1 << 16, (1 << 32) - 1])
def test_segments_keep_any_ids(high):
    rng = np.random.default_rng(high)
    ids = np.where(rng.random(5000) < 0.02, high, rng.integers(0, min(high, 200) + 1, 5000)).astype(np.uint32)
    raw = token_blocks.pack_segment(ids)
    assert (token_blocks.unpack_segment(raw) == ids).all()
    assert (token_blocks.unpack_segment(raw, 1000, 2100) == ids[1000:2100]).all()
    assert len(token_blocks.unpack_segment(token_blocks.pack_segment(ids[:0]))) == 0


def test_packing(spark, docs, awkward, empty, texts, encode):
    for df, pairs in ((docs, list(texts.items())), (awkward, AWKWARD)):
        parts = packing.pack(df, vocabulary(), ids=True).collect()
        own = collections.defaultdict(list)
        places = collections.defaultdict(list)
        for r in parts:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length and crc(ids) == r.ids_crc32
            own[r.doc_id, r.doc_tokens].append((r.start, ids))
            places[r.sequence_id].append((r.offset, r.length))
        want = collections.Counter((i, tuple(encode(t))) for i, t in pairs)
        for (i, n), found in own.items():
            whole = next(ids for d, ids in want if d == i and len(ids) == n)
            assert all(tuple(ids) == whole[s : s + len(ids)] for s, ids in found)
            assert sum(len(ids) for _, ids in found) == n * want[i, whole]
        for k, x in places.items():
            x.sort()
            assert [o for o, _ in x] == np.cumsum([0, *(n for _, n in x[:-1])]).tolist()
            assert sum(n for _, n in x) == 2048 or k == max(places)
    assert packing.pack(empty, vocabulary()).count() == 0
    filled = packing.sequences(packing.pack(docs.limit(3), vocabulary(), ids=True)).collect()
    flat = [x for r in sorted(filled) for x in r.ids[: r.n_ids]]
    assert all(len(r.ids) == 2048 for r in filled) and sorted(flat) == sorted(x for r in docs.limit(3).collect() for x in encode(r.text))


_LONG = "".join(f"<p>A long sentence of the body, number {i}, with marks; it goes on and on, as such bodies do.</p>" for i in range(6))
_BODY = "\n".join(f"A long sentence of the body, number {i}, with marks; it goes on and on, as such bodies do." for i in range(6))


def test_main_text_ratio_decides_beside_article_elements():
    cards = "".join(f"<article class=card><h3>Card {i}</h3><p><a href=x>More</a> here.</p></article>" for i in range(4))
    assert main_text.main_text(f"<body><div><div class=body>{_LONG}</div></div><div class=cards>{cards}</div></body>") == _BODY


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "elementor-widget-container", "widget"])
def test_main_text_one_class_word_does_not_bar_the_page(name):
    assert main_text.main_text(f"<body><div class='{name}'><article>{_LONG}</article></div></body>") == _BODY
    assert main_text.main_text(f"<body><div class='{name}'><div>{_LONG}</div></div><div class=sidebar>no, no.</div></body>") == _BODY


def test_main_text_keeps_lists_and_tables_of_the_body():
    page = f"<body><div><div>{_LONG}<ul><li>one</li><li>two</li></ul><table><tr><td>3</td></tr></table></div><div><ul><li><a href=x>no</a></li></ul></div></div></body>"
    assert main_text.main_text(page) == f"{_BODY}\none\ntwo\n3"


# -- licences, toxicity, quality --------------------------------------------------------


def test_license_scan(docs, awkward, texts, empty):
    for df, pairs in ((docs, list(texts.items())), (awkward, AWKWARD)):
        want = []
        for i, t in pairs:
            w = alnum(t)
            at = [(p, label) for k, label in license_scan.BASE.items() for p in range(len(w)) if w[p : p + len(k.split())] == k.split()]
            first, last = (min(at)[0], max(at)[0]) if at else (None, None)
            want.append((i, len(w), len(at), first, last, ",".join(sorted({label for _, label in at}))))
        got = license_scan.scan(df)
        assert rows(got.drop("labels", "score")) == sorted(want, key=repr)
        assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert license_scan.scan(empty).count() == 0
    labels = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(awkward).collect()}
    assert labels[8] == ("apache,apache-2.0", 1.0) and labels[2] == ("", 0.0)


def test_toxicity_learns_and_holds_out(spark, sf, docs, awkward, empty):
    bad = ["vile", "rotten", "foul"]
    words = [f"word{i}" for i in range(50)]
    rng = np.random.default_rng(3)
    made = [(i, " ".join([*rng.choice(words, 60), *(rng.choice(bad, 3) if i % 5 == 0 else [])]), int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    got = toxicity.digest(df, df.select("doc_id", "toxic")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got if r.held_out)
    labels = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 0), (8, 0)], "doc_id long, toxic int")
    found = toxicity.digest(awkward, labels).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.digest(empty, labels).count() == 0 and toxicity.remove_toxic(awkward, labels.limit(0)).count() == len(AWKWARD)


def test_toxicity_takes_a_labelled_id_once(spark, sf, docs):
    labels = table(spark, sf, "labels")
    known = labels.filter("toxic IS NOT NULL").filter(~toxicity.held_out()).join(docs, "doc_id").select("doc_id").first()[0]
    again = docs.filter(F.col("doc_id") == known).crossJoin(spark.range(200)).drop("id")
    once, often = toxicity.fit(docs, labels), toxicity.fit(docs.union(again), labels)
    assert once.bias == often.bias and (once.places == often.places).all() and (once.weights == often.weights).all()


def test_quality_measures_and_verdict(docs, awkward, texts, empty, spark, sf):
    for df, pairs in ((docs, list(texts.items())), (awkward, AWKWARD)):
        want = []
        for i, t in pairs:
            t = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            repeated = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
            lines = collections.Counter(x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
            failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
            want.append((i, len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), sum(n - 1 for n in lines.values()), len(repeated), failed))
        got = quality.digest(df)
        assert rows(got.drop("kept", "posterior")) == sorted(want, key=repr)
        assert got.filter("base_failed AND kept").count() == 0
    assert quality.digest(empty).count() == 0 and quality.keep_good(awkward).columns == awkward.columns
    judged = quality.digest(docs).join(table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    assert judged.filter("kept <> (quality = 1)").count() <= 0.03 * judged.count()


# -- chat ---------------------------------------------------------------------------------


def test_chat_round_trip_of_awkward_turns(spark):
    parts = ["", "<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\/INST]", "\\\\[INST]\\", "<", "[", "/INST]", "é\n", None]
    turns = [(k, j, r, "".join(x or "" for x in (a, b)) if a is not None or b is not None else None)
             for k, a in enumerate(parts) for j, (r, b) in enumerate([("user", a), ("assistant", "</s>[INST] ok"), (None, "<"), ("a[", None), ("assistant", a)])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    back = {r.conv_id: r for r in chat.read(chat.formatted(chat.canonical(df))).collect()}
    for k in range(len(parts)):
        own = [(r or "", t or "") for i, _, r, t in turns if i == k]
        assert [tuple(t) for t in back[k].turns] == own
        assert back[k].learnt == "".join(t for r, t in own if r == "assistant")
        assert back[k].formatted.count("</s>") == 5 and back[k].formatted.count("[INST]") == 5
    assert chat.digest(df.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    pair = [("user", "q"), ("assistant", "a")]
    cases = {
        '{"prompt": "q", "response": "a", "extra": [1]}': pair,
        '{"prompt": "q", "completion": "a"}': pair,
        '{"instruction": "q", "input": "", "output": "a"}': pair,
        '{"instruction": "q", "input": "i", "output": "a"}': [("user", "q\ni"), ("assistant", "a")],
        '{"instruction": "q", "output": "a"}': pair,
        '{"system": "s", "prompt": "q", "response": "a"}': [("system", "s"), *pair],
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}': pair,
        '{"id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}': pair,
        '{"other": 1}': None, "no json": None, None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "conv_id long, record string")
    got = {r.conv_id: r.turns for r in chat.canonical_json(df, "conv_id", "record").collect()}
    assert [got[i] and [tuple(t) for t in got[i]] for i in range(len(cases))] == list(cases.values())
    typed = spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string")
    assert [tuple(t) for t in chat.canonical(typed).first().turns] == pair
    with pytest.raises(ValueError, match="layout"):
        chat.canonical(spark.createDataFrame([(1,)], "conv_id long"))


# -- suffix tree ------------------------------------------------------------------------------


def test_suffix_tree_base_and_gain(docs, awkward, texts, empty):
    for df, pairs in ((docs, list(texts.items())), (awkward, AWKWARD)):
        count, want = collections.Counter(), collections.defaultdict(list)
        out = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in pairs}
        for i, t in pairs:
            if not out[i]:
                count.update([*blank(t), None])
        n, v = sum(count.values()), len(count)
        for i, t in pairs:
            w = [*blank(t), None]
            want[i].append((len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
        got = suffix_tree.digest(df).collect()
        assert len(got) == len(pairs)
        for r in got:
            assert r.held_out == out[r.doc_id] and r.train_tokens == n
            assert any((r.n_tokens, r.n_known) == x[:2] and math.isclose(r.base_score, x[2], rel_tol=1e-9, abs_tol=1e-9) for x in want[r.doc_id])
    assert suffix_tree.digest(empty).count() == 0
    held = [r for r in suffix_tree.digest(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_suffix_tree_is_a_distribution_and_ignores_the_head(spark, docs):
    lines = [(i, "a b c a b d a b c") for i in range(40)] + [(100 + i, "b x a y") for i in range(40)]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    tree, vocabulary_ = suffix_tree.learn(df.select("text"))
    assert tree.levels and len(tree.levels[0]["contexts"])
    every = np.arange(len(tree.frequent))
    for c in tree.levels[0]["contexts"]:
        known = suffix_tree._shares(tree, np.full(len(every), c), every, 1).sum()
        other = 0.1 / (tree.n + 0.1 * (tree.v + 1)) * tree.levels[0]["rest"][tree.levels[0]["contexts"] == c][0]
        assert math.isclose(known + other, 1, rel_tol=1e-9)
    marked = docs.select("doc_id", suffix_tree.held_out().alias("held_out"), "text")
    train = marked.filter("NOT held_out").select("text")
    small = suffix_tree.score(marked, *suffix_tree.learn(train, head=50))
    whole = suffix_tree.score(marked, *suffix_tree.learn(train))
    for a, b in zip(rows(small), rows(whole)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def _suffix_tree_scores(train, every):
    """log10 P of each text by a plain suffix tree over dictionaries."""
    depth, least, discount = suffix_tree.DEPTH, suffix_tree.LEAST, 0.5
    after = collections.defaultdict(collections.Counter)
    for w in train:
        for i, x in enumerate(w):
            for k in range(min(depth, i) + 1):
                after[tuple(w[i - k : i])][x] += 1
    n, v = sum(after[()].values()), len(after[()])

    def share(s, x):
        if not s:
            return (after[s][x] + 0.1) / (n + 0.1 * (v + 1))
        lower = share(s[1:], x)
        if s not in kept:
            return lower
        c = after[s].get(x, 0)
        return (c - discount) / kept[s][0] * (c >= least) + kept[s][1] * lower

    kept = {}
    for s in sorted((s for s in after if s), key=len):
        total = sum(after[s].values())
        often = {x: c for x, c in after[s].items() if c >= least}
        if not often:
            continue
        lower = {x: share(s[1:], x) for x in often}
        gain = sum(c * math.log(c / total / lower[x]) for x, c in often.items())
        if rest := total - sum(often.values()):
            gain += rest * math.log(rest / total / max(1 - sum(lower.values()), 1e-12))
        if 2 * gain > len(often) + 4 * math.sqrt(2 * len(often)):
            kept[s] = total, 1 - sum(c - discount for c in often.values()) / total
    return [sum(math.log10(share(tuple(w[max(0, i - depth) : i]), x)) for i, x in enumerate(w)) for w in every], kept


def test_suffix_tree_keeps_rare_and_long_contexts(spark, docs, texts):
    """Contexts count from a few occurrences, however large the corpus, and beyond two words."""
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    words = {i: [*blank(t), None] for i, t in texts.items()}
    want, kept = _suffix_tree_scores([words[i] for i in words if not out[i]], list(words.values()))
    marked = docs.select("doc_id", suffix_tree.held_out().alias("held_out"), "text")
    train = marked.filter("NOT held_out").select("text")
    for head in (50, suffix_tree.HEAD):
        tree, vocabulary_ = suffix_tree.learn(train, head=head)
        assert [len(level["contexts"]) for level in tree.levels] == [sum(len(s) == k for s in kept) for k in range(1, 1 + len(tree.levels))]
        got = {r.doc_id: r.score for r in suffix_tree.score(marked, tree, vocabulary_).collect()}
        assert all(math.isclose(got[i], x, rel_tol=1e-9, abs_tol=1e-9) for i, x in zip(words, want))
    assert max(map(len, kept)) > 2
    rare = [(i, f"w{i} x{i}") for i in range(30_000)] + [(i, "the rare pair of words") for i in range(30_000, 30_005)]
    tree, _ = suffix_tree.learn(spark.createDataFrame(rare, "doc_id long, text string").select("text"))
    assert {int(x) for x in tree.frequent[tree.frequent_count == 5]} >= {int(x) for x in tree.levels[0]["contexts"]} != set()


def test_suffix_tree_lets_its_shuffles_go(spark, docs):
    def files():
        every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {every.apply(i).getName() for i in range(every.size()) if every.apply(i).getName().startswith("shuffle_")}

    old = files()
    tree, _ = suffix_tree.learn(docs.select("text"))
    assert len(tree.states) > 1
    for _ in range(50):  # executors delete in their own time
        if not (left := files() - old):
            break
        time.sleep(0.2)
    assert not left


def test_suffix_tree_counts_pairs_over_blocks(spark, docs, texts, monkeypatch):
    """Pairs handed on early, in many blocks, count as in one."""
    monkeypatch.setattr(suffix_tree, "HELD_PAIRS", 1000)
    monkeypatch.setattr(suffix_tree, "BLOCK_PAIRS", 100)
    tree, _ = suffix_tree.learn(docs.select("text").repartition(3))
    for length, (_, pairs) in enumerate(tree.states[:3], 2):
        count = collections.Counter(tuple(w[i : i + length]) for t in texts.values() for w in [[*blank(t), None]] for i in range(len(w) - length + 1))
        assert sorted(r.c for r in pairs.collect()) == sorted(c for c in count.values() if c >= suffix_tree.LEAST)


def test_suffix_tree_does_not_depend_on_what_its_filters_let_through(spark, docs, monkeypatch):
    marked = docs.select("doc_id", suffix_tree.held_out().alias("held_out"), "text")
    tree, vocabulary_ = suffix_tree.learn(marked.filter("NOT held_out").select("text"), head=50)
    want = {r.doc_id: r.score for r in suffix_tree.score(marked, tree, vocabulary_).collect()}
    monkeypatch.setattr(suffix_tree, "BLOCKS", 1)
    got = {r.doc_id: r.score for r in suffix_tree.score(marked, tree, vocabulary_).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def test_suffix_tree_texts_meet_states_without_joined_rows(spark, docs, monkeypatch):
    """A row for each state in each text grew faster than the texts; ranges of packed keys take their place, whatever their number."""
    plans, kept = [], suffix_tree.stored
    monkeypatch.setattr(suffix_tree, "stored", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or kept(df, label))
    marked = docs.select("doc_id", suffix_tree.held_out().alias("held_out"), "text")
    tree, vocabulary_ = suffix_tree.learn(marked.filter("NOT held_out").select("text"), head=50)
    del plans[:]
    want = {r.doc_id: r for r in suffix_tree.score(marked, tree, vocabulary_).collect()}
    assert plans and not any("Join" in plan for plan in plans)
    monkeypatch.setattr(suffix_tree, "HELD_ASKED", 1000)
    monkeypatch.setattr(suffix_tree, "ROWS", 7)
    monkeypatch.setattr(suffix_tree, "PER_RANGE", 50)
    got = {r.doc_id: r for r in suffix_tree.score(marked.repartition(3), tree, vocabulary_).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert r[:5] == want[i][:5] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(r[5:], want[i][5:]))


def test_suffix_tree_deletes_the_levels_it_no_longer_needs(docs, monkeypatch):
    """What lies in the shared folder while texts are scored counts as disk."""
    made, kept = [], suffix_tree.stored
    monkeypatch.setattr(suffix_tree, "stored", lambda df, label: made.append(kept(df, label)) or made[-1])
    assert suffix_tree.digest(docs).count() == docs.count()
    vocabulary_, *levels, states, scores = [sum(os.path.exists(f.removeprefix("file://")) for f in table_.inputFiles()) for table_ in made]
    assert vocabulary_ and states and scores and len(levels) > 2 and not any(levels)


def test_suffix_tree_knows_words_of_any_length():
    """Words take equal hashes wherever they stand, and different words different ones."""
    rng = random.Random(1)
    every = ["".join(rng.choices("abAZz[@`{é\x00\x08\x0e\x1f!", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(2000)]
    lines = [None, "", " ", *(rng.choice([" ", "\n", "\x0b ", "\r"]).join(rng.choices(every, k=rng.randint(0, 30))) for _ in range(500))]
    hashes, bounds = suffix_tree.tokens(pa.array(lines))
    seen = {}
    for line, a, b in zip(lines, bounds, bounds[1:]):
        w = [*blank(line), None]
        assert len(w) == b - a and all(seen.setdefault(x, h) == h for x, h in zip(w, hashes[a:b]))
    assert len(set(seen.values())) == len(seen)


def test_filter_refuses_no_key(spark):
    keys = np.random.default_rng(3).integers(0, 1 << 64, 40_000, dtype=np.uint64)
    made = suffix_tree.Filter(spark.createDataFrame([(int(k),) for k in keys[:20_000].view(np.int64)], "k long"))
    assert made.blocks > 1 and made.has(keys[:20_000]).all() and made.has(keys[20_000:]).mean() < 0.1


# -- near copies ---------------------------------------------------------------------------------


def _fingerprint(text):
    w = blank(text)
    parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_simhash(docs, awkward, texts, empty):
    for df, pairs in ((docs, list(texts.items())), (awkward, AWKWARD)):
        fps = [_fingerprint(t) for _, t in pairs]
        roots = _components(len(pairs), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
        least = {}
        for (i, _), r in zip(pairs, roots):
            least[r] = min(x for x in (i, least.get(r)) if x is not None) if (i, least.get(r)) != (None, None) else None
        want = [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(pairs, fps, roots)]
        assert rows(simhash.digest(df)) == sorted(want, key=repr)
    assert simhash.digest(empty).count() == 0


@pytest.mark.parametrize("limit", [4096, 16])
def test_links_of_dense_and_planted_fingerprints(spark, limit):
    rng = np.random.default_rng(11)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for s in seeds for _ in range(30)]
    fps = sorted({*near, *rng.integers(0, 1 << 63, 200).tolist()})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.groups(df, limit=limit).collect()}
    roots = _components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {r: min(i for i, x in enumerate(roots) if x == r) for r in set(roots)}
    assert got == {f: least[r] for f, r in zip(signed, roots)}


def test_every_pair_within_four_bits_shares_a_key():
    golay, rng = simhash.Golay(), np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for own, fp in zip(keys, (a, b)):
        for k, r in zip(*(x.tolist() for x in simhash.fingerprint_keys(fp, golay))):
            own[r].add(k)
    assert all(keys[0][i] & keys[1][i] for i in range(len(a)))


def test_one_row_of_each_component_stays(spark, docs, texts, awkward, empty):
    made = [(10_000 + i, " ".join(f"w{x + (x == 40 + i)}" for x in range(400))) for i in range(9)]
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [*made, made[0]]], docs.schema)
    pairs = [*texts.items(), *made, made[0]]
    for df, own in ((docs.union(extra), pairs), (awkward, AWKWARD)):
        kept = simhash.keep_one(df)
        fps = [_fingerprint(t) for _, t in own]
        roots = _components(len(own), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
        want = [min(((i is None, i) for (i, _), x in zip(own, roots) if x == r), default=None)[1] for r in set(roots)]
        assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)
    clash = docs.withColumn("row", F.lit(1)).withColumn("simhash", F.lit("x"))
    assert simhash.keep_one(clash).columns == clash.columns
    assert simhash.keep_one(empty).count() == 0


def test_pipeline_stages_are_the_operators(spark, sf, docs):
    import corpus_pipeline as pipeline
    from ohmwatch.llm.arrays import stored

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "decontamination", "packing"]
    left, before = docs, None
    for _, stage in pipeline.STAGES[:-1]:
        before, left = left, stored(stage(spark, left, sf), "test")
        assert left.columns == docs.columns and left.join(before, "doc_id", "left_anti").count() == 0
    hit = {r.doc_id for r in decontamination.digest(before, table(spark, sf, "benchmark")).collect() if r.contaminated}
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in before.collect()} - hit
    packed = pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in left.collect()}
