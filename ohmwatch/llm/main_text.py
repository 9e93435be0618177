"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text; a block's path is the list of block elements from the
root to it.  Per path: characters, punctuation marks, linked characters, blocks.  A
path's ratio grows with text and punctuation per block and falls with links.  Ratios are smoothed
over the path tree: a path gets the mean of its own and of its container's, which is the mean
weighted by text of all paths below the container.  Lists, tables, paragraphs and headings are no containers of
their own, and below ``article`` or ``main`` the innermost of these is the container.  The smoothed ratio is
fused with what elements and class words say, as weights: more for a path below ``article`` or ``main``, less for one
below a node of few of the page's characters with a name that only contains a word of menus,
notices, adverts, comments and the like.  On every page the fused score decides, against a share of its
mean weighted by text.

Ruled out are elements such as ``nav``, and nodes that are named by such words alone, unless they hold most of
the page's text, and an ``article`` or ``main`` if the page has one.

White space inside a block is one space, ``br`` too; blocks are joined by a line end.  Null and empty
pages give an empty text, as do pages without content.  What stands after an unclosed script,
style or comment belongs to it.  Repeated rows stay.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from ohmwatch.llm.arrays import batch_of, pieces

#: Share of the text-weighted mean ratio from which a path is content.
SHARE = 0.3
#: What a path below article or main weighs, and one below a small node whose name contains a skipped word.
CONTENT_WEIGHT, NAMED_WEIGHT = 4.0, 0.3
#: Shares of the page's characters: a node with more is not ruled out by its name, nor weighed by a part of it.
MOST, FEW = 0.7, 1 / 3

# Elements by their part in a page, and class words of what is not content.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form menu dialog button noscript template iframe head title object svg select textarea".split())
CONTENT = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select".split())
#: Elements that are parts of a container's text.
PARTS = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hgroup address details summary".split()
)
SKIPPED_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal "
    "nav navbar navigation newsletter notice notification pagination popup promo promoted related replies reply share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget alert contentinfo complementary search".split()
)
# What class words of reader comments consist of beside "comment" itself.
COMMENT_WORDS = frozenset("comment comments list area section wrap wrapper body content thread container box item children form respond reply replies".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")
#: Attributes up to the end of a tag; a quote counts only right behind an equals sign.
_INNER = r"(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<svg(?=[\s/>]){_INNER}(?<=/)>"
    rf"|<(script|style|textarea|title|noscript|iframe|svg|template)(?=[\s/>]){_INNER}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_INNER})>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z/!?][^<]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")


def _named(tag: str, attributes: str) -> int:
    """3 if a class, id or role speaks of reader comments only, 2 if it consists of skipped words, 1 if it contains such a word, else 0."""
    if "=" not in attributes or tag in ("html", "body", "main"):
        return 0
    found = 0
    for names in _NAMES.findall(attributes):
        for token in " ".join(names).lower().split():
            words = _PART.findall(token)
            if words and words[0] in ("comment", "comments") and COMMENT_WORDS.issuperset(words):
                return 3
            parts = [part in SKIPPED_WORDS for part in words]
            found = max(found, 2 if parts and all(parts) else int(any(parts)))
    return found


class _Page:
    """Blocks of a page in order: (node, text, linked characters); nodes: (parent, element, how it is named)."""

    def __init__(self):
        self.nodes: list[tuple[int, str, int]] = [(-1, "", 0)]
        self.stack: list[tuple[str, int]] = []  # element, node
        self.blocks: list[tuple[int, str, int]] = []
        self.runs: list[str] = []
        self.linked, self.links = 0, 0

    def end_block(self) -> None:
        if self.runs:
            text = " ".join("".join(self.runs).split())
            if text:
                self.blocks.append((self.stack[-1][1] if self.stack else 0, text, self.linked))
            self.runs, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            run = entities.unescape(raw) if "&" in raw else raw
            self.runs.append(run)
            if self.links:
                self.linked += len(run)

    def close(self, tags: set[str], stop: frozenset = frozenset()) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links = 1
        if tag == "br":
            self.runs.append(" ")
        if tag in INLINE:
            return
        self.end_block()
        if tag in CLOSES_P:
            self.close({"p"}, SCOPES | CONTENT | {"div", "section", "td", "th", "li"})
        if tag in SIBLINGS:
            self.close(SIBLINGS[tag], SCOPES - {tag})
        if tag in VOID or attributes.endswith("/"):
            return
        self.nodes.append((self.stack[-1][1] if self.stack else 0, tag, _named(tag, attributes)))
        self.stack.append((tag, len(self.nodes) - 1))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag not in INLINE:
            self.end_block()
            self.close({tag})


def blocks(page: str) -> _Page:
    out, at = _Page(), 0
    for m in _TOKEN.finditer(page):
        out.text(page[at : m.start()])
        at = m.end()
        if m[3]:
            tag = m[3].lower()
            out.end(tag) if m[2] else out.start(tag, m[4])
        elif m[1]:
            out.end_block()
    out.text(page[at:])
    out.end_block()
    return out


class _Node:
    """What a node's place in the page says: its path, container, weight, whether it is ruled out."""

    __slots__ = ("barred", "container", "content", "path", "weight")


def _places(page: _Page) -> list[_Node]:
    held = [0] * len(page.nodes)
    for node, text, _ in page.blocks:
        held[node] += len(text)
    every = list(held)
    for i in range(len(page.nodes) - 1, 0, -1):
        every[page.nodes[i][0]] += every[i]
    skipped = [False] * len(page.nodes)
    for i, (parent, tag, _) in enumerate(page.nodes[1:], 1):
        # A form around most of the page is its frame.
        skipped[i] = skipped[parent] or (tag in SKIPPED and not (tag == "form" and every[i] > MOST * every[0]))
    says = [tag in CONTENT and not out for (_, tag, _), out in zip(page.nodes, skipped)]  # holds article or main
    for i in range(len(page.nodes) - 1, 0, -1):
        if not skipped[i]:
            held[page.nodes[i][0]] += held[i]
            says[page.nodes[i][0]] |= says[i]
    total = held[0]
    out = []
    for i, (parent, tag, named) in enumerate(page.nodes):
        own = _Node()
        if i == 0:
            own.barred, own.container, own.content, own.path, own.weight = False, (), False, (), 1.0
        else:
            above = out[parent]
            own.barred = above.barred or skipped[i] or (tag == "header" and not above.content)
            own.barred |= named == 3 or named == 2 and (held[i] <= MOST * total or says[0] > says[i])
            few = named == 1 and held[i] <= FEW * total
            own.weight = min(above.weight, NAMED_WEIGHT) if few else above.weight
            # Paths of other weight are other paths, though their elements are the same.
            own.path = (*above.path, (tag, few))
            own.content = above.content or tag in CONTENT
            inside = tag in PARTS or (above.content and tag not in CONTENT and not few)
            own.container = above.container if inside else own.path
        out.append(own)
    return out


def main_text(page: str | None) -> str:
    parsed = blocks(page or "")
    places = _places(parsed)
    found = [(places[node], text, linked) for node, text, linked in parsed.blocks if not places[node].barred]
    sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    of: dict[tuple, _Node] = {}
    for place, text, linked in found:
        own = sums[place.path]
        of[place.path] = place
        for i, x in enumerate((len(text), len(PUNCTUATION.findall(text)), linked, 1)):
            own[i] += x
    ratio = {p: n / k * (1 + marks / k) * max(0.0, 1 - linked / n) for p, (n, marks, linked, k) in sums.items()}
    below: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0])
    for p, r in ratio.items():
        for container in {p[:i] for i in range(len(p) + 1)}:
            below[container][0] += r * sums[p][0]
            below[container][1] += sums[p][0]
    smooth = {p: (r + below[of[p].container][0] / below[of[p].container][1]) / 2 * of[p].weight for p, r in ratio.items()}
    # Among links, only what article or main says can make content.
    score = [smooth[o.path] * (CONTENT_WEIGHT if o.content else max(0.0, 1 - linked / len(text))) for o, text, linked in found]
    size = sum(len(text) for _, text, _ in found)
    bar = SHARE * sum(x * len(text) for x, (_, text, _) in zip(score, found)) / size if size else 0.0
    return "\n".join(text for x, (_, text, _) in zip(score, found) if x > 0 and x >= bar)


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches):
    for piece in pieces(batches, 2):
        found = [main_text(page) for page in piece.column(2).to_pylist()]
        yield batch_of(_TEXTS, [piece.column(0), piece.column(1), found, [len(t) for t in found]])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
