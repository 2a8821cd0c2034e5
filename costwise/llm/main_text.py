"""Main text of web pages by scoring the element tree.

Each paragraph gives points for its length and commas to its ancestors, fewer the further up; an
ancestor's points count by the share of its text that is no link. The container with most points is
kept, and so are the siblings of it and of its ancestors that hold text of the same kind, with what lies
between them; inside an ``article`` or ``main`` the whole of that element is, as its sections belong
together. Parts that by their element or role are menus, page headers and footers, sidebars are
left out wherever they stand, and so are lists that are mostly links. A form, ``aria-hidden``, and a class or id that names
such a part, a notice, an advert or readers' comments lower the points inside; the element is left out if
then it does not hold the best container and, but for readers' comments, has few paragraphs or many links.

Text is given by blocks in page order: character references decoded, white space inside a block made one
space, trimmed, blocks joined by one line feed. Defined cases: a null or blank page has an empty text; a
page without any paragraph gives what is left after the parts above; markup that is never closed ends
with its parent; repeated rows are extracted each; null ids and urls are kept; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from costwise.llm.storage import map_batches, prefixed

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(script|style|noscript|template|iframe|svg|math|textarea|select|title|object|canvas|audio|video)\b"
    r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of the first set unless one of the second stands before it.
_ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dd": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "dt": (frozenset({"dd", "dt"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr"}), frozenset({"tbody", "table"})),
    "option": (frozenset({"option"}), frozenset()),
}
#: Any other block's start tag ends an open paragraph in the same container.
_PARAGRAPH = (frozenset({"p"}), _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6"})
_LEFT_OUT = frozenset("nav footer aside button dialog menu fieldset legend label input head search option".split())
_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that make an element no part of the article.
_NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted banner "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer foot sidebar sidenav aside rail "
    "comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr newsletter subscribe "
    "subscription signup login popup modal overlay toast paywall related recommended recommendations trending popular "
    "share sharing social widget widgets toolbar masthead topbar sitemap skip search form".split()
)
#: These do so too unless a word for the article stands beside them.
_PERHAPS = frozenset("header head notice notices alert notification announcement tags copyright legal disclaimer byline meta print".split())
_ARTICLE = frozenset("article main content post entry story text body page blog".split())
#: Of those the words for what has paragraphs of its own.
_READERS = frozenset("comment comments commentlist disqus reply replies respond discussion related recommended recommendations".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(frozen=True)
class Params:
    #: Blocks with fewer characters give no points.
    paragraph: int = 25
    #: Share of a container's points that reaches the next one up.
    up: tuple[float, ...] = (1.0, 0.5, 0.25, 0.125)
    #: A sibling with few links stays with this share of the best container's points for each paragraph.
    sibling: float = 0.2
    #: Points inside an element whose class or id names no part of the article, and one for readers' comments.
    named: float = 0.2
    readers: float = 0.1
    #: Such an element stays with so many paragraphs and this share of the best container's points.
    named_paragraphs: int = 3
    named_share: float = 0.3
    links: float = 0.33
    link_list: float = 0.6


class _Page:
    """Elements in page order: tag, parent, whether left out, innermost element around with a doubtful name or -1;
    blocks: (element, text, characters in links, that doubtful element)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.out, self.last = ["html"], [-1], [False], [0]
        self.doubt, self.readers = [-1], set()
        self.blocks: list[tuple[int, str, int, int]] = []
        self._open, self._parts, self._link, self._linked = [0], [], 0, 0
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            name = m[3]
            if name:
                name = name.lower()
                if m[2]:
                    self._end(name)
                else:
                    self._start(name, m[4])
        self._text(html[at:])
        self._flush()
        while self._open:
            self._close()

    def _text(self, raw: str) -> None:
        if self._link and not self.out[self._open[-1]]:
            self._linked += len(raw.strip())
        self._parts.append(raw)

    def _flush(self) -> None:
        if self._parts:
            own = self._open[-1]
            if not self.out[own]:
                text = " ".join(unescape("".join(self._parts)).split())
                if text:
                    doubt = self.doubt[own]
                    while self.tag[own] not in _BLOCK:
                        own = self.parent[own]
                    self.blocks.append((own, text, min(len(text), self._linked), doubt))
            self._parts, self._linked = [], 0

    def _close(self) -> None:
        own = self._open.pop()
        self.last[own] = len(self.tag) - 1
        if self.tag[own] == "a":
            self._link = max(0, self._link - 1)

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._parts.append(" ")
            return
        if name in _BLOCK:
            self._flush()
            self._end_open(*_PARAGRAPH)
            if name in _ENDS:
                self._end_open(*_ENDS[name])
        if name in _VOID:
            return
        if name == "a" and self._link:
            self._end("a")
        above = self._open[-1]
        left_out = self.out[above] or name in _LEFT_OUT or self._unwanted(name, attributes)
        named = not left_out and self._named(name, attributes)
        if (left_out or named) and not self.out[above]:
            self._flush()
        if name == "header" and not left_out:
            # a page's header goes, that of an article stays
            left_out = not any(self.tag[i] in ("article", "main") for i in self._open)
        self.tag.append(name)
        self.parent.append(above)
        self.out.append(left_out)
        self.doubt.append(len(self.tag) - 1 if named else self.doubt[above])
        if named and named & _READERS:
            self.readers.add(len(self.tag) - 1)
        self.last.append(len(self.tag) - 1)
        self._open.append(len(self.tag) - 1)
        if name == "a":
            self._link += 1

    def _end_open(self, kinds, scope) -> None:
        """Close the innermost open element of ``kinds`` unless one of ``scope`` stands before it."""
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[k]]
            if tag in kinds:
                while len(self._open) > k:
                    self._close()
                return
            if tag in scope:
                return

    def _end(self, name: str) -> None:
        if name in _VOID:
            if name == "br":
                self._parts.append(" ")
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[k]]
            if tag == name:
                if any(self.tag[i] in _BLOCK for i in self._open[k:]) or self.out[self._open[k]] or self.doubt[self._open[k]] == self._open[k]:
                    self._flush()
                while len(self._open) > k:
                    self._close()
                return
            if tag in _BLOCK and name not in _BLOCK:
                return  # an inline end tag reaches no further than its block

    @staticmethod
    def _unwanted(name: str, attributes: str) -> bool:
        if not attributes or name in ("html", "body"):
            return False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden":
                return True
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
            if key == "role" and value.lower() in _ROLES:
                return True
        return False

    @staticmethod
    def _named(name: str, attributes: str) -> set[str]:
        """What class, id, role and element name that is something other than the article."""
        found: set[str] = {"form"} if name == "form" else set()  # a form may be around the whole page
        if not attributes or name in ("html", "body"):
            return found
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "role" and value.lower() == "form" or key == "aria-hidden" and value.lower() == "true":
                found.add("form" if key == "role" else "hidden")  # the page behind an open dialog is hidden from readers' aids
            if key not in ("class", "id"):
                continue
            if name in ("article", "main"):
                found |= {w.lower() for w in _WORD.findall(value)} & {"comment", "comments", "reply", "ad", "promo", "related"}
                continue
            for one in value.split():
                words = {w.lower() for w in _WORD.findall(one)}
                found |= words & _NOT_ARTICLE
                if not words & _ARTICLE:
                    found |= words & _PERHAPS
        return found


class _Scores:
    """By element: points, characters, those in links, paragraphs and their worth, all of its subtree."""

    def __init__(self, page: _Page, blocks, p: Params, weight=lambda _: 1.0):
        self.points, self.length, self.linked, self.paragraphs, self.worth = {}, {}, {}, {}, {}
        for own, text, in_links, doubt in blocks:
            worth = 0.0
            if len(text) >= p.paragraph and page.tag[own] not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                worth = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - in_links / len(text)) * weight(doubt)
                node = page.parent[own] if page.tag[own] in ("p", "pre", "blockquote", "li", "td", "th", "dd", "dt", "figcaption") else own
                for share in p.up:
                    if node < 0:
                        break
                    self.points[node] = self.points.get(node, 0.0) + worth * share
                    node = page.parent[node]
            node = own
            while node >= 0:
                self.length[node] = self.length.get(node, 0) + len(text)
                self.linked[node] = self.linked.get(node, 0) + in_links
                self.paragraphs[node] = self.paragraphs.get(node, 0) + (worth > 0)
                self.worth[node] = self.worth.get(node, 0.0) + worth
                node = page.parent[node]

    def links(self, n: int) -> float:
        return self.linked[n] / self.length[n]

    def best(self) -> int | None:
        score = {n: s * (1 - self.links(n)) for n, s in self.points.items()}
        return max(score, key=lambda n: (score[n], -n)) if score else None


def _without_doubtful(page: _Page, blocks, p: Params):
    """The blocks, less those of elements that by name and content are no part of the article."""
    if all(b[3] < 0 for b in blocks):
        return blocks
    named = [n for n, doubt in enumerate(page.doubt) if n == doubt]  # those around before those inside
    weight = {-1: 1.0}
    for n in named:
        weight[n] = max(1e-6, (p.readers if n in page.readers else p.named) * weight[page.doubt[page.parent[n]]])
    best = _Scores(page, blocks, p, weight.__getitem__).best()
    plain = _Scores(page, blocks, p)
    kept = {-1: True}
    for n in named:
        kept[n] = best is not None and kept[page.doubt[page.parent[n]]] and (
            n <= best <= page.last[n]
            or n not in page.readers and plain.paragraphs.get(n, 0) >= p.named_paragraphs
            and plain.worth[n] >= p.named_share * plain.worth[best] and plain.links(n) < p.links
        )
    return [b for b in blocks if kept[b[3]]]


def main_text(html: str | None, p: Params = Params()) -> str:
    """The article of one whole page."""
    if not html or not html.strip():
        return ""
    page = _Page(html)
    blocks = _without_link_lists(page, p)
    blocks = _without_doubtful(page, blocks, p)
    scores = _Scores(page, blocks, p)
    best = scores.best()
    if best is None:
        return "\n".join(b[1] for b in blocks)
    kept = [best]
    node = best
    while node >= 0 and page.tag[node] not in ("article", "main"):
        node = page.parent[node]
    if node >= 0:
        kept = [node]
    else:
        least = p.sibling * scores.worth[best] / max(1, scores.paragraphs[best])
        children: dict[int, list[int]] = {}
        for n in scores.length:
            children.setdefault(page.parent[n], []).append(n)
        inner = best
        while page.parent[inner] >= 0:
            few = [n for n in sorted(children[page.parent[inner]]) if n == inner or scores.links(n) < p.links]
            own = [
                k for k, n in enumerate(few)
                if n == inner or page.tag[n] in ("p", "h1", "h2", "h3", "blockquote", "pre")
                or scores.paragraphs[n] and scores.worth[n] >= least * scores.paragraphs[n]
            ]
            kept += [n for n in few[own[0] : own[-1] + 1] if n != inner]  # lists, tables and headings between them too
            inner = page.parent[inner]
        # text directly in an element around stays as well
        around = {n for n in scores.length if n < best <= page.last[n]}
        return "\n".join(b[1] for b in blocks if b[0] in around or any(n <= b[0] <= page.last[n] for n in kept))
    spans = [(n, page.last[n]) for n in kept]
    return "\n".join(b[1] for b in blocks if any(x <= b[0] <= y for x, y in spans))


def _without_link_lists(page: _Page, p: Params) -> list[tuple[int, str, int, int]]:
    """The blocks, less those of lists whose text is mostly links."""
    length, linked, items = {}, {}, {}

    def lists(node):
        while node >= 0:
            if page.tag[node] in ("ul", "ol", "dl"):
                yield node
            node = page.parent[node]

    for own, text, in_links, _ in page.blocks:
        for n in lists(own):
            length[n] = length.get(n, 0) + len(text)
            linked[n] = linked.get(n, 0) + in_links
            items[n] = items.get(n, 0) + 1
    drop = {n for n in length if items[n] > 1 and linked[n] > p.link_list * length[n]}
    return [b for b in page.blocks if not drop or not any(n in drop for n in lists(b[0]))]


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """page_id, url, text, n_chars of every row of page_id, url, html."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), p) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return map_batches(prefixed(pages, "page_id", "url", "html"), run, f"page_id {kind}, url string, text string, n_chars long")
