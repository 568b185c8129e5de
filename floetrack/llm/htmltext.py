"""Main text of web pages by tag-path ratios.

A lenient parse yields the page's text nodes in order, each with its root-to-leaf path of tags (with
class and id). Per path, the text length and the punctuation for each node are aggregated; the ratios
are smoothed along the page, by how much of their paths neighbouring nodes share, fused into one score,
and paths at or above a threshold set by the scores' spread are selected. The deepest element that holds
nearly all of the selected text is the article, or an <article> above it; all of its blocks count, short
paragraphs and headings included, but those in containers that are never article text. Selected text beside
it counts as well, with all of the branch it stands in, and so do headings and paragraphs right above it.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas noembed noframes title".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td textarea tfoot th thead tr ul".split())
NEVER = frozenset("nav aside footer header menu button select textarea input label fieldset dialog search head".split())
CLOSES_P = BLOCK - frozenset("br body html head option caption tbody td tfoot th thead tr legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = HEADINGS | frozenset("p li pre blockquote td dd dt ul ol table tbody tr".split())
# Parts of class names, ids and roles that mark containers other than article text.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies copyright discussion disqus dialog feedback footer footnav gdpr header legal masthead menu menubar modal nav navbar navigation newsletter notice notices pagination pager paywall popup promo promoted promotion recommended related replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget alert complementary contentinfo".split()
)
# Parts that may stand beside those in a name without changing what it marks; of those, talk about the page.
PLACES = frozenset("site page main global top bottom left right center primary secondary inner outer box bar block area section container wrapper wrap content list item items link links button buttons post posts form title text module panel group row col column".split())
TALK = frozenset("comment comments commentlist discussion disqus replies reply responses".split())
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile("[\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[a-z]+")
_STOPS = re.compile(r"[.,;:!?…。、，]")
#: Neighbours on either side; threshold in standard deviations; share of the selected text within the article.
SMOOTH, THRESHOLD, COVER = 2, 0.5, 0.8


class Paths:
    """Root-to-leaf paths as numbers: each is the path above it and one more step."""

    def __init__(self) -> None:
        self._known: dict[tuple[int, str], int] = {}
        self.up, self.depth = [0], [0]

    def below(self, path: int, step: str) -> int:
        found = self._known.setdefault((path, step), len(self.up))
        if found == len(self.up):
            self.up.append(path)
            self.depth.append(self.depth[path] + 1)
        return found

    def alike(self, a: int, b: int) -> float:
        """The share of steps that two paths have in common from the root."""
        longest = max(self.depth[a], self.depth[b]) + 1
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.up[a]
            else:
                b = self.up[b]
        return (self.depth[a] + 1) / longest


class Node:
    """An open element: its tag, path, number in page order, whether it can hold article text, and what a name or a form marks."""

    __slots__ = ("article", "form", "mark", "marks", "never", "number", "path", "tag", "up")

    def __init__(self, tag: str, path: int, number: int, never: bool, mark: str, up: Node | None):
        self.tag, self.path, self.number, self.never, self.mark, self.up = tag, path, number, never, mark, up
        #: Marked elements from the root to here; whether one of them is an article or a form.
        self.marks = (up.marks if up is not None else 0) + bool(mark)
        self.article = tag in ("article", "main") or up is not None and up.article
        self.form = tag == "form" or up is not None and up.form


class Tags:
    """The tags of a page in order, each met once, however broken: what is never closed is looked for once only."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in (">", '"', "'", "-->", "]]>")}
        self._unclosed: set[str] = set()

    def end(self, at: int) -> int:
        """Where the tag that begins at a place ends; 0 if nowhere. A quote that is not closed is an ordinary character."""
        page, first = self.page, self.page.find(">", at) if at <= self.last[">"] else -1
        if first < 0:
            return 0
        stop, q = first, at
        while m := _QUOTE.search(page, q, stop):
            if m.end() > self.last[m[0]]:
                return first + 1
            q = page.find(m[0], m.end()) + 1
            if q > stop:
                if q > self.last[">"]:
                    return first + 1
                stop = page.find(">", q)
        return stop + 1

    def after(self, mark: str, at: int) -> int:
        """Where the next ``mark`` has ended; 0 if there is none."""
        return self.page.find(mark, at) + len(mark) if at <= self.last[mark] else 0

    def closing(self, tag: str, at: int) -> re.Match | None:
        """The next end tag of a name."""
        if tag in self._unclosed:
            return None
        found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if found is None:
            self._unclosed.add(tag)
        return found


def _named(names: list[str]) -> str:
    """"talk" or "name" if a whole name of an element marks it: one with a hint and nothing but hints and places."""
    found = ""
    for token in (t for n in names for t in n.split()):
        parts = set(_PARTS.findall(token))
        if parts & HINTS and parts <= HINTS | PLACES:
            if parts & TALK:
                return "talk"
            found = "name"
    return found


def _hinted(tag: str, attributes: str) -> tuple[str, bool, str]:
    """The path's step for a tag, whether it is hidden, and the mark of its names."""
    if not attributes.strip() or tag in ("html", "body"):
        return tag, False, ""
    names, hidden = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role", "itemprop"):
            names.append(value)
        hidden |= name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true"
    hidden |= re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) is not None
    parts = {p for n in names for p in _PARTS.findall(n)}
    mark = _named(names) if parts & HINTS and not (tag == "main" or parts & {"article", "content", "body"} and tag == "article") else ""
    return f"{tag}.{'.'.join(sorted(parts))}" if parts else tag, hidden, mark


def blocks(page: str) -> tuple[list[tuple[str, Node, int]], Paths]:
    """((text, innermost block element, characters within links) of each block with text, in page order; the paths)."""
    paths, tags = Paths(), Tags(page)
    top = Node("", 0, 0, False, "", None)
    at, number, links = top, 0, 0
    out: list[tuple[str, Node, int]] = []
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, at, min(linked, len(joined))))
            text.clear()
        linked = 0

    pos, size, look = 0, len(page), 0
    while pos < size:
        lt = page.find("<", look)
        m, end, inner = None, 0, ""
        if lt >= 0:
            if page.startswith("<!--", lt):
                end = tags.after("-->", lt + 4) or size
            elif page.startswith("<![CDATA[", lt) and (end := tags.after("]]>", lt + 9)):
                inner = html.escape(page[lt + 9 : end - 3])
            elif page[lt + 1 : lt + 2] in ("!", "?"):
                end = tags.after(">", lt)
            elif m := _NAME.match(page, lt + 1):
                end = tags.end(m.end())
            if not end and lt < tags.last[">"]:
                look = lt + 1  # no tag: text
                continue
        run = page[pos:lt] if end else page[pos:]
        if run:
            text.append(run)
            linked += len(run.strip()) if links else 0
        if not end:
            break
        pos = look = end
        if m is None:
            text.append(inner)
            continue
        attributes, empty = page[m.end() : end - 1], page[end - 2] == "/"
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                node = at
                while node is not None and node.tag != tag:
                    node = node.up
                flush()
                if node is not None and node.up is not None:
                    at = node.up
            continue
        if tag in RAW and not empty:
            close = tags.closing(tag, pos)
            pos = look = close.end() if close else size if tag in ("script", "style") else pos
            continue
        if tag == "a":
            links = 1
        if tag not in BLOCK:
            _, never, mark = _hinted(tag, attributes)
            control = tag in NEVER and (tag != "label" or at.form)  # a label within a sentence is text
            if never or mark or control:
                # An inline element that is no article text is skipped to its end; by its name only if it is no wrapper of the page.
                if not empty and tag not in VOID and (close := tags.closing(tag, pos)):
                    if never or control or 2 * (close.start() - pos) < size:
                        pos = look = close.end()
            continue
        flush()
        if tag in ("br", "hr"):
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            closing = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}.get(tag, ("p",))
            walls = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}.get(tag, ("div", "section", "article", "td", "li", "blockquote", "main"))
            node, last = at, None
            while node is not None and node.tag not in walls:
                if node.tag in closing:
                    last = node
                node = node.up
            if last is not None:
                at = last.up
        number += 1
        step, never, mark = _hinted(tag, attributes)
        at = Node(tag, paths.below(at.path, step), number, at.never or never or tag in NEVER, mark or ("form" if tag == "form" else ""), at)
    flush()
    return out, paths


def _selected(found: list[tuple[str, Node, int]], paths: Paths) -> np.ndarray:
    """Which blocks the ratios of their paths select."""
    # Ratios for each path: characters outside links, and punctuation marks, by node.
    length, stops, nodes = defaultdict(float), defaultdict(float), defaultdict(int)
    for text, node, linked in found:
        length[node.path] += len(text) - linked
        stops[node.path] += len(_STOPS.findall(text)) if linked * 2 < len(text) else 0
        nodes[node.path] += 1
    ratio = np.array([length[n.path] / nodes[n.path] for _, n, _ in found])
    mark = np.array([stops[n.path] / nodes[n.path] for _, n, _ in found])
    own = [n.path for _, n, _ in found]
    alike = [np.array([paths.alike(a, b) for a, b in zip(own, own[d:])]) for d in range(1, SMOOTH + 1)]

    def smooth(values: np.ndarray) -> np.ndarray:
        total, weight = values.copy(), np.ones(len(values))
        for d in range(1, SMOOTH + 1):
            w = alike[d - 1] ** 2 / (d + 1)
            if len(w):
                total[:-d] += w * values[d:]
                weight[:-d] += w
                total[d:] += w * values[:-d]
                weight[d:] += w
        return total / weight

    fused = smooth(ratio) * (0.5 + smooth(mark))
    return fused >= min(THRESHOLD * fused.std(), fused.max()) if fused.max() > 0 else np.ones(len(found), bool)


def _tree(found: list[tuple[str, Node, int]]) -> tuple[dict[int, Node], dict[int, int]]:
    """(the elements above some blocks by number, in page order; the greatest number within each)."""
    nodes: dict[int, Node] = {}
    for _, node, _ in found:
        while node is not None and node.number not in nodes:
            nodes[node.number] = node
            node = node.up
    nodes = dict(sorted(nodes.items()))
    last = {k: k for k in nodes}
    for k in reversed(nodes):
        if (up := nodes[k].up) is not None:
            last[up.number] = max(last[up.number], last[k])
    return nodes, last


def _unmarked(found: list[tuple[str, Node, int]], paths: Paths) -> list[tuple[str, Node, int]]:
    """The blocks outside marked containers. A mark does not hold for a container of most of the page's selected text.

    Beside such a container less than a share 1 - COVER of the text may stand unmarked, none in an article of
    its own, and beside talk none at all: a long thread of comments, or an advert longer than a short article, is
    not the page.
    """
    marks = np.array([node.marks for _, node, _ in found])
    if not marks.any():
        return found
    nodes, last = _tree(found)
    at = np.array([node.number for _, node, _ in found])
    article = np.array([node.article for _, node, _ in found])
    plain = np.array([len(t) - linked for t, _, linked in found], float)
    weight = np.where(_selected(found, paths), plain, 0.0)
    held = dict.fromkeys(nodes, 0.0)
    for k, w in zip(at.tolist(), weight.tolist(), strict=True):
        held[k] += w
    for k in reversed(nodes):
        if (up := nodes[k].up) is not None:
            held[up.number] += held[k]
    cleared: list[int] = []
    for k, node in nodes.items():  # outer ones first; those with most of the text lie in one another
        if not node.mark or 2 * held[k] <= held[0] or node.marks - 1 > sum(c <= k <= last[c] for c in cleared):
            continue
        inside = (at >= k) & (at <= last[k])
        # Beside a form only selected text counts; a name gives way to any text outside links.
        rest = ~inside & (marks == 0)
        beside = (weight if node.mark == "form" else plain)[rest].sum()
        if (rest & article & (plain > 0)).any() and not node.article:
            continue
        own = weight[inside].sum()
        if beside <= (0 if node.mark == "talk" else (1 - COVER) * (own + beside)):
            marks[inside] -= 1
            cleared.append(k)
    return [b for b, m in zip(found, marks, strict=True) if m == 0]


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    found, paths = blocks(page)
    found = _unmarked([b for b in found if not b[1].never], paths)
    if not found:
        return ""
    chosen = _selected(found, paths)
    # The deepest element with nearly all selected text, from the root down.
    nodes, last = _tree(found)
    held = dict.fromkeys(nodes, 0)
    for (text, node, _), ok in zip(found, chosen, strict=True):
        held[node.number] += len(text) if ok else 0
    best: dict[int, int] = {}
    for k in reversed(nodes):
        if (up := nodes[k].up) is not None:
            held[up.number] += held[k]
    for k in nodes:
        if (up := nodes[k].up) is not None and held[k] > held.get(best.get(up.number, -1), 0):
            best[up.number] = k
    total, now = sum(len(t) for (t, _, _), ok in zip(found, chosen, strict=True) if ok), 0
    # A lone paragraph is no article: its parent's other blocks belong to the text as well.
    while now in best and held[best[now]] >= COVER * total and nodes[now].tag != "article" and nodes[best[now]].tag not in PARTS:
        now = best[now]
    at = np.array([node.number for _, node, _ in found])
    inside = (at >= now) & (at <= last[now])
    if not inside.all():
        inside |= _beside(found, nodes, inside, chosen, now)
    return " ".join(t for (t, _, _), ok in zip(found, inside, strict=True) if ok)


def _beside(found: list, nodes: dict[int, Node], inside: np.ndarray, chosen: np.ndarray, now: int) -> np.ndarray:
    """Which blocks outside the article belong to it: branches with selected paths, headings and paragraphs beside its ancestors."""
    first = int(np.flatnonzero(inside)[0])
    line, node = set(), nodes[now]
    while node is not None:
        line.add(node.number)
        node = node.up
    # Of each element outside the line, the ancestor of it, or it itself, that stands next to the line.
    next_to: dict[int, int] = {}
    for k, node in nodes.items():
        if k not in line:
            next_to[k] = k if node.up.number in line else next_to[node.up.number]
    paths = {found[i][1].path for i in np.flatnonzero(chosen)}
    branch, taken = [], set()
    for i, (text, node, linked) in enumerate(found):
        # Text right in an ancestor is its own branch.
        own = next_to.get(node.number, -1 - i)
        branch.append(own)
        if inside[i]:
            continue
        near = nodes[own] if own >= 0 else None
        if node.path in paths or near is not None and linked * 2 < len(text) and (near.tag in HEADINGS and i < first or near.tag == "p" and near.up.tag not in ("", "html", "body")):
            taken.add(own)
    return np.array([b in taken for b in branch])


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points); columns of these names are replaced.

    Null and empty pages, and pages without text, have an empty text; broken markup is read leniently;
    long pages are read whole; rows are treated one by one, so repeated rows get equal results.
    """
    kept = pages.drop("text", "n_chars")
    schema = kept.select("*", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    place = kept.columns.index(html_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(v.as_py()) for v in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    return kept.mapInArrow(run, schema)
