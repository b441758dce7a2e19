"""The main text of HTML pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import python_ready, python_task, slices

#: Fixed values of HTML: elements without content, with raw text, within a line of text, and those whose start ends an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("html body table ul ol dl menu article section div main nav aside footer header form blockquote td th select".split())

#: Elements, roles and class or id words whose text is never the article's, and those that hold the article.
NEVER = frozenset("script style noscript template textarea title head nav footer aside button select option input iframe object svg math dialog menu canvas audio video datalist label".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar tooltip".split())
#: What speaks against an element's text, unless the element holds most of the page's or of its articles' text.
DOUBTED = frozenset("form fieldset header".split())
JUNK = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer sidebar aside rail widget widgets "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register paywall comment comments commentlist reply replies respond discussion disqus "
    "share sharing social related recommended recommendations trending pagination pager toolbar skip hidden masthead topbar copyright form search toc".split()
)
ARTICLE = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article post entry content story articlebody postcontent entrycontent maincontent".split())

#: Reach of the smoothing in text nodes; the least share of the page's best fused ratio that makes content.
REACH, SHARE = 2, 0.25
#: Characters and punctuation marks of a text node that count at most, so that long paragraphs leave an article's short lines their share.
LONG, POINTS = 200, 4
#: The share of a page's text that clears a doubted element where article elements hold other text.
MOST = 0.8
#: How much a path within an article element weighs, and one within an element whose class or id only says so.
WEIGHTS = {"element": 8.0, "word": 2.0, "": 1.0}

# a quote that nothing closes is a character like others, so the tag ends at the next >
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_MARK = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?…。、，；：！？]")


@dataclass
class Open:
    """An open element: its path, whether its text is never the article's, what trusts it, and the doubted elements around it."""

    tag: str
    path: int
    junk: bool
    trust: str
    block: int
    doubts: tuple[int, ...] = ()
    linked: bool = False


@dataclass
class Node:
    """A run of text without block boundary; path: the number of its root-to-leaf path."""

    path: int
    trust: str
    block: int
    doubts: tuple[int, ...] = ()
    parts: list[str] = field(default_factory=list)
    links: int = 0
    text: str = ""


class Paths(dict):
    """Numbers for root-to-leaf paths: by the parent's number and the last element's label."""

    def __missing__(self, step: tuple[int, str]) -> int:
        self[step] = len(self) + 1
        return self[step]

    def name(self, path: int) -> str:
        parents = {number: step for step, number in self.items()}
        labels = []
        while path:
            path, label = parents[path]
            labels.append(label)
        return "".join(f"/{x}" for x in reversed(labels))


def _marks(tag: str, attributes: str, trust: str) -> tuple[bool, bool, str, str]:
    """Whether an element is never content, whether that is doubted, what trusts it, and its first class."""
    if tag in NEVER:
        return True, False, "", ""
    doubted = tag in DOUBTED and not (tag == "header" and trust)
    words: list[str] = []
    first = ""
    for name, *values in _MARK.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            for token in value.split():
                first = first or token
                words += [w for w in _WORD.findall(token.lower())] + [re.sub(r"[^a-z]", "", token.lower())]
        elif name == "role" and value.lower() == "form":
            doubted = True
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, "", first
    junk = not JUNK.isdisjoint(words)
    doubted = doubted or junk and tag not in ("html", "body") and tag not in ARTICLE
    return False, doubted, "element" if tag in ARTICLE else "word" if not ARTICLE_WORDS.isdisjoint(words) and not junk else "", first


def text_nodes(page: str, paths: Paths | None = None) -> list[Node]:
    """The page's text by blocks, with root-to-leaf paths of block elements; text that is never content is left out.

    Open elements end as HTML lets them: p before a block, li before li, and so on; stray ends are passed over. Elements
    may be nested as deep as they are.
    """
    paths = Paths() if paths is None else paths
    stack, open_tags, endless = [Open("", 0, False, "", 0)], Counter(), set()
    nodes: list[Node] = []
    block, at, size, doubts = 0, 0, len(page), 0

    def text(raw: str) -> None:
        top = stack[-1]
        if top.junk:
            return
        if not nodes or nodes[-1].block != block:
            if not raw.strip():
                return
            nodes.append(Node(top.path, top.trust, block, top.doubts))
        nodes[-1].parts.append(raw)
        nodes[-1].links += len(raw.strip()) if top.linked else 0

    def close(to: int) -> None:
        nonlocal block
        if any(x.tag not in INLINE for x in stack[to:]):
            block += 1
        open_tags.subtract(x.tag for x in stack[to:])
        del stack[to:]

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        ending, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if not open_tags[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in SCOPES and tag in INLINE:
                    break
            continue
        if tag in RAW and not (tag in ("svg", "math") and attributes.endswith("/")):
            end = None if tag in endless else _RAW_END[tag].search(page, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else size if tag in ("script", "style") else at
            if end or tag in ("script", "style"):
                if tag not in INLINE:
                    block += tag != "script" and tag != "style" and tag != "noscript"
                continue
        elif tag in RAW:
            continue
        if tag in ENDS_P and open_tags["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        if tag in ENDS_SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS_SAME[tag]:
                    close(k)
                    break
                if stack[k].tag in SCOPES - ENDS_SAME[tag]:
                    break
        if tag in ("br", "hr"):
            block += 1
            continue
        if tag in VOID:
            continue
        top = stack[-1]
        junk, doubted, trust, first = (True, False, "", "") if top.junk else _marks(tag, attributes, top.trust)
        doubts += doubted
        inline = tag in INLINE
        block += not inline
        path = top.path if inline else paths[top.path, tag + (f".{first}" if first else "")]
        trust = max(top.trust, trust, key=WEIGHTS.__getitem__)
        open_tags[tag] += 1
        stack.append(Open(tag, path, junk, trust, block, (*top.doubts, doubts) if doubted else top.doubts, top.linked or tag == "a"))
    for n in nodes:
        n.text = " ".join(html.unescape("".join(n.parts)).split())
    return _undoubted([n for n in nodes if n.text])


def _undoubted(nodes: list[Node]) -> list[Node]:
    """The nodes outside doubted elements; one is cleared by half of the articles' text, by most of the page's, or over half where no article is."""
    texts, articles = Counter(), Counter()
    for n in nodes:
        for d in (0, *n.doubts):
            texts[d] += len(n.text)
            articles[d] += len(n.text) if n.trust == "element" else 0
    share = MOST if articles[0] else 0.5
    cleared = {d for d in texts if texts[d] > share * texts[0] or articles[0] and 2 * articles[d] >= articles[0]}
    return [n for n in nodes if cleared.issuperset(n.doubts)]


def content(nodes: list[Node]) -> list[Node]:
    """The nodes on content paths.

    Per path: text length over nodes, and punctuation over nodes. Both ratios, by node in page order, are smoothed by
    a Gaussian within REACH nodes and fused with the path's own; its mean is held against SHARE of the page's best path.
    A link's text counts little. All paths stand for election: the mean of one that an article element or a class
    trusts counts WEIGHTS times, both against the best mean and as what the paths with less trust are held against.
    """
    sums: dict[int, list[float]] = {}
    for n in nodes:
        own = sums.setdefault(n.path, [0, 0, 0])
        own[0] += min(max(len(n.text) - n.links, len(n.text) / 50), LONG)
        own[1] += min(len(_PUNCT.findall(n.text)), POINTS)
        own[2] += 1
    raw = [[sums[n.path][k] / sums[n.path][2] for n in nodes] for k in (0, 1)]
    weights = [exp(-(d * d) / (2 * (REACH / 2) ** 2)) for d in range(REACH + 1)]
    fused = []
    for i in range(len(nodes)):
        near = range(max(0, i - REACH), min(len(nodes), i + REACH + 1))
        total = sum(weights[abs(i - j)] for j in near)
        length, points = (sum(r[j] * weights[abs(i - j)] for j in near) / total for r in raw)
        own = raw[0][i] * (0.5 + raw[1][i])
        fused.append(sqrt(length * (0.5 + points) * own))  # so a menu beside the article gains little from it
    by_path: dict[int, list[float]] = {}
    for n, x in zip(nodes, fused, strict=True):
        by_path.setdefault(n.path, []).append(x)
    means = {p: sum(x) / len(x) for p, x in by_path.items()}
    weight = {n.path: WEIGHTS[n.trust] for n in nodes}
    least = {w: SHARE * max((m * max(1.0, weight[p] / w) for p, m in means.items()), default=0) / w for w in WEIGHTS.values()}
    return [n for n in nodes if means[n.path] >= least[weight[n.path]]]


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by newlines; empty for a null page or one without content."""
    return "\n".join(n.text for n in content(text_nodes(page or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each page; other columns are left out.

    A null or empty html has empty text; broken markup is read as far as it goes; very long pages are read whole.
    Repeated rows get equal texts, empty tables empty results. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with python_task():
            for batch in slices(batches):
                texts = [main_text(x.as_py()) for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    python_ready(pages)
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, schema)
