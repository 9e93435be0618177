"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ohmwatch.llm import (
    chat,
    collocations,
    decontamination,
    lexical_search,
    license_scan,
    main_text,
    minhash,
    packing,
    quality,
    simhash,
    suffix_tree,
    token_blocks,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
LOWER = "'abcdefghijklmnopqrstuvwxyz'"
WORDS = rf"coalesce(regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

SQL1 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS gram
  FROM i WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT doc_id, width, unnest(range(1, len(w) - width + 2)) AS p,
    unnest(list_transform(range(1, len(w) - width + 2), lambda p: array_to_string(w[p:p + width - 1], ' '))) AS gram
  FROM d, widths WHERE len(w) >= width),
hits AS (SELECT doc_id, p, width, item_id FROM places JOIN windows USING (width, gram)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + width)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_decontaminate", SQL1)
def op1(spark, sf):
    return decontamination.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_main_text")
def op2(spark, sf):
    return main_text.extract(table(spark, sf, "pages"))


@query("op3_token_blocks")
def op3(spark, sf):
    return token_blocks.round_trip(table(spark, sf, "documents"), vocabulary())


@query("op4_license_scan")
def op4(spark, sf):
    return license_scan.scan(table(spark, sf, "documents"))


@query("op5_toxicity")
def op5(spark, sf):
    return toxicity.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


SAFE = r"""regexp_replace(regexp_replace(replace(coalesce({0}, ''), '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"""
SQL6 = f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
  coalesce(role, '') AS role, coalesce(text, '') AS text, {SAFE.format("role")} AS safe_role, {SAFE.format("text")} AS safe_text FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(17 + length(safe_role) + length(safe_text)) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


@query("op6_chat_format", SQL6)
def op6(spark, sf):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digest(rows)


@query("op7_pack")
def op7(spark, sf):
    return packing.pack(table(spark, sf, "documents"), vocabulary())


@query("op8_suffix_tree")
def op8(spark, sf):
    return suffix_tree.digest(table(spark, sf, "documents"))


@query("op9_quality_rules")
def op9(spark, sf):
    return quality.digest(table(spark, sf, "documents"))


@query("op10_simhash")
def op10(spark, sf):
    return simhash.digest(table(spark, sf, "documents"))


SQL11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, g, count(*) AS f, string_split(g, ' ') AS s FROM g GROUP BY lang, k, g),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
inner_ AS (SELECT lang, array_to_string(s[1:2], ' ') AS g, f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(s[2:3], ' '), f FROM c WHERE k = 3),
longest AS (SELECT lang, g, max(f) AS f FROM inner_ GROUP BY lang, g),
kept AS (SELECT c.* FROM c LEFT JOIN longest o ON c.k = 2 AND c.lang = o.lang AND c.g = o.g WHERE o.f IS NULL OR 100 * o.f < 50 * c.f),
cuts AS (
  SELECT kept.lang, kept.g, kept.f AS a, x.f AS l, y.f AS r, cut,
    CAST((1000000::HUGEINT * kept.f * kept.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM kept, (VALUES (1), (2)) t(cut)
  JOIN f x ON x.lang = kept.lang AND x.g = array_to_string(kept.s[1:cut], ' ')
  JOIN f y ON y.lang = kept.lang AND y.g = array_to_string(kept.s[cut + 1:], ' ')
  WHERE cut < kept.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op11_collocations", SQL11)
def op11(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


TERMS = rf"regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL12 = rf"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents), q AS (SELECT item_id, {TERMS} AS w FROM benchmark),
t AS (SELECT doc_id, unnest(w) AS t FROM d), qt AS (SELECT item_id, unnest(w) AS t FROM q),
total AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf FROM t WHERE t IN (SELECT t FROM qt) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
size AS (SELECT doc_id, CAST(75 + (25 * len(d.w) * n) // l AS BIGINT) AS m FROM d, total),
impact AS (SELECT tf.doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS part FROM tf JOIN size USING (doc_id) JOIN weight USING (t)),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM qt JOIN impact USING (t) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


@query("op12_search", SQL12)
def op12(spark, sf):
    return lexical_search.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


BLANK = rf"coalesce(regexp_extract_all(translate(text, {UPPER}, {LOWER}), '[^\x20\x09-\x0D]+'), [])"
SQL13 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {BLANK} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN n USING (doc_id)
"""


@query("op13_minhash", SQL13)
def op13(spark, sf):
    return minhash.digest(table(spark, sf, "documents"))
