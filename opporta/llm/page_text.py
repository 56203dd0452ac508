"""Main text of web pages: flat text blocks, their neighbours' word counts and link density, and a decision tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm import common
from opporta.llm.page_labels import LABELLED, MARK

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED_TAGS = frozenset("head script style noscript template title iframe object svg math canvas select option button textarea label datalist audio video map".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_SAME = frozenset("p li dd dt tr td th h1 h2 h3 h4 h5 h6".split())  # an open one ends where the next begins
FRAME_TAGS = frozenset("nav menu aside form dialog search fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())  # any other start tag ends a head
HINTS = frozenset(
    "ad ads advert advertisement adverts adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice alert popup modal overlay "
    "sidebar side widget widgets related recommended recommendations share sharing social follow comment comments disqus reply replies respond breadcrumb "
    "breadcrumbs nav navbar navigation menu toolbar footer copyright legal masthead newsletter subscribe subscription signup login pagination pager skip search "
    "complementary contentinfo dialog teaser".split())
WITH = ("has-", "with-", "no-", "is-")  # a class that tells of another element
ARTICLE_WORDS = frozenset("article content entry main post section story".split())  # their header is the article's
FEATURES = ("words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density", "framed", "hinted", "in_article", "outside_article")
DEPTH, LEAST_LEAF = 10, 5
PAGE_FORM = 0.9  # share of a page's words from which a form is the page and frames nothing


RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())  # hold text only, up to their end tag
_TAG, _GAP, _ATTRIBUTE, _EQUALS, _BARE = (re.compile(x) for x in (r"</?([a-zA-Z][^\s/>]*)", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))


def _attributes(html: str, at: int) -> tuple[int, dict[str, str]]:
    """Place after the tag's end, or -1 if the page ends inside the tag, and the attributes."""
    own: dict[str, str] = {}
    while True:
        at = _GAP.match(html, at).end()
        if at >= len(html):
            return -1, own
        if html[at] == ">":
            return at + 1, own
        name = _ATTRIBUTE.match(html, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(html, at):
            at = equals.end()
            if html[at:at + 1] in ('"', "'"):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return -1, own
                value, at = html[at + 1:end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare.group(), bare.end()
        own.setdefault(name.group().lower(), unescape(value))


def markup(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Texts ("text", ...), start and end tags in order; every character is looked at a fixed number of times."""
    at = 0
    while at < len(html):
        less = html.find("<", at)
        if less < 0:
            less = len(html)
        if less > at:
            yield "text", unescape(html[at:less]), {}
        at = less
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            at = len(html) if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = len(html) if end < 0 else end + 1
        elif tag := _TAG.match(html, at):
            name = tag.group(1).lower()
            after, own = _attributes(html, tag.end())
            if after < 0:
                return
            closing, at = html[at + 1] == "/", after
            yield "end" if closing else "start", name, own
            if name in RAW_TAGS and not closing:
                end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                if end is None:
                    return
                at = end.start()
        elif at < len(html):
            yield "text", "<", {}
            at += 1


class _Blocks:
    """Blocks `[text, words, linked words, framed, hinted, in_article, form, outer form]` in page order, in one pass.

    `framed` is without forms; `form` is the number of the form around a block, within its article or main if it is in one,
    and `outer form` that of the outermost form.
    """

    def __init__(self):
        self.blocks: list[list] = []
        self.stack: list[tuple] = [("", False, False, False, False, 0, 0)]  # tag, framed, hinted, in article, dropped, form, outer form
        self.forms = 0
        self.open: dict[str, int] = {}
        self.parts: list[tuple[str, bool]] = []
        self.link = 0  # depth of the stack at which a link is open

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            linked = sum(len(t.split()) for t, in_link in self.parts if in_link)
            self.blocks.append([text, text.count(" ") + 1, linked, *self.stack[-1][1:4], *self.stack[-1][5:]])
        self.parts = []

    def pop_to(self, tag: str) -> None:
        self.flush()
        while True:
            top = self.stack.pop()[0]
            self.open[top] -= 1
            if top == tag:
                break
        if self.link > len(self.stack):
            self.link = 0

    def start(self, tag: str, own: dict[str, str]) -> None:
        block, dropped = tag in BLOCK_TAGS, tag in DROPPED_TAGS
        if self.stack[-1][0] == "head" and tag not in HEAD_TAGS and tag not in ("head", "html"):
            self.pop_to("head")
        if tag == "br":
            self.parts.append(("\n", False))
        elif tag == "a":
            self.link = len(self.stack)
        if tag == "body" and self.open.get("head"):
            self.pop_to("head")
        if not block and not dropped:
            return
        if tag in VOID_TAGS:
            self.flush() if block else None
            return
        if block:
            self.flush()
            if self.open.get("p") and tag != "p" and self.stack[-1][0] == "p":
                self.pop_to("p")
            if tag in CLOSES_SAME and self.stack[-1][0] == tag:
                self.pop_to(tag)
        _, framed, hinted, article, gone, form, outer = self.stack[-1]
        names = f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}".split()
        named = {x for n in names if not n.lower().startswith(WITH) for x in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", n).lower())}
        if "header" in named and not article and not named & ARTICLE_WORDS:
            named.add("masthead")
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", ""))
        if tag == "form":
            self.forms += not form  # a form in a form is no form
            form = form or self.forms
            outer = outer or form
        elif tag in ARTICLE_TAGS:
            form = 0
        framed = framed or (tag in FRAME_TAGS and tag != "form") or tag == "footer" or (tag == "header" and not article)
        self.stack.append((tag, framed, bool(hinted or (named & HINTS and tag not in ("body", "html")) or hidden), article or tag in ARTICLE_TAGS, gone or dropped, form, outer))
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        elif tag == "p" and not self.open.get("p"):
            self.flush()
        elif self.open.get(tag):
            self.pop_to(tag)

    def data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self.pop_to("head")
        if not self.stack[-1][4]:
            self.parts.append((data, bool(self.link)))


def blocks(html: str) -> list[list]:
    """Blocks `[text, words, linked words, framed, hinted, in_article]` in page order; a form round the page frames none."""
    reader = _Blocks()
    for kind, what, own in markup(html):
        if kind == "text":
            reader.data(what)
        elif kind == "start":
            reader.start(what, own)
        else:
            reader.end(what)
    reader.flush()
    held = [0] * (reader.forms + 1)
    for b in reader.blocks:
        for form in {b[6], b[7]}:
            held[form] += b[1]
    most = PAGE_FORM * sum(b[1] for b in reader.blocks)
    return [[*b[:3], bool(b[3] or (b[6] and held[b[6]] < most)), *b[4:6]] for b in reader.blocks]


def features(found: list[list]) -> np.ndarray:
    """One row of `FEATURES` for each block."""
    words = np.array([b[1] for b in found], dtype=float)
    density = np.array([b[2] for b in found], dtype=float) / np.maximum(words, 1)
    flags = np.array([b[3:6] for b in found], dtype=float).reshape(-1, 3)
    before = lambda x: np.r_[0.0, x[:-1]]
    after = lambda x: np.r_[x[1:], 0.0]
    outside = (1 - flags[:, 2]) * flags[:, 2].max(initial=0)
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), flags, outside])


def grown(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """Decision tree by Gini impurity: `(share of 1,)` at a leaf, `(feature, cut, low, high)` elsewhere."""
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, ones, n = x[order, k], np.cumsum(y[order]), np.arange(1, len(y) + 1)
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= LEAST_LEAF) & (len(y) - at - 1 >= LEAST_LEAF)]
        if len(at):
            left, right = ones[at] / n[at], (ones[-1] - ones[at]) / (len(y) - n[at])
            cost = n[at] * left * (1 - left) + (len(y) - n[at]) * right * (1 - right)
            i = int(cost.argmin())
            if best is None or cost[i] < best[0] - 1e-12:
                best = cost[i], k, (v[at[i]] + v[at[i] + 1]) / 2
    if best is None:
        return (float(y.mean()),)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grown(x[low], y[low], depth - 1), grown(x[~low], y[~low], depth - 1)


def judged(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Share of main text in the leaf that each row falls into."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    out, low = np.empty(len(x)), x[:, tree[0]] <= tree[1]
    out[low], out[~low] = judged(tree[2], x[low]), judged(tree[3], x[~low])
    return out


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the blocks of marked pages."""
    x, y = [], []
    for html in pages:
        x.append(features(blocks(html.replace(MARK, ""))))
        y += [float(MARK in b[0]) for b in blocks(html)]
    return np.vstack(x), np.array(y)


def trained() -> tuple:
    """The tree of the labelled pages of `page_labels`."""
    return grown(*labelled(LABELLED))


def main_text(html: str, tree: tuple) -> str:
    found = blocks(html)
    if not found:
        return ""
    return "\n".join(b[0] for b, share in zip(found, judged(tree, features(found)), strict=True) if share > 0.5)


def extracted(pages: DataFrame, html: str = "html") -> tuple[DataFrame, str]:
    """Add the main text to every row; frame and column name. Null and textless pages give the empty text."""
    tree = trained()
    common.bound_batches(pages.sparkSession)

    def text_of(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py() or "", tree) for h in batch], pa.string())
    name = common.free_name(pages, "main_text")
    return pages.withColumn(name, F.arrow_udf(text_of, "string").asNondeterministic()(F.col(html))), name


def report(pages: DataFrame) -> DataFrame:
    out, name = extracted(pages)
    return out.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("bigint").alias("n_chars"))


# The given pages are regular: an article of headings and paragraphs, five character references.
ORACLE_SQL = r"""
WITH body AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '\s+', ' ', 'g'), '<br>', ' ', 'g') AS h FROM pages),
part AS (SELECT page_id, url, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS x
         FROM (SELECT page_id, url, regexp_split_to_array(h, '</?(?:p|h1)>') AS xs FROM body), unnest(xs) WITH ORDINALITY AS t(x, i)),
text AS (SELECT page_id, string_agg(x, chr(10) ORDER BY i) AS t FROM part WHERE x <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(t, '') AS text, CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN text USING (page_id)
"""
