"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted by the share of characters
and tags in links; a node's density sum is that of its children. The node with
the largest sum is the main one, the least density on its path to the body is
the threshold, and below each node that reaches it the largest-sum subtree is
content. Elements that are never part of an article, as scripts or navigation,
are left out first. A class, id or role decides nothing by itself: what is
called a menu or an advert counts like links, unless it holds the page's article
or most of its text, and goes where its density then is below the threshold.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[^a-z0-9]+")

# HTML element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_DROPPED = frozenset("head nav footer aside form script style textarea title noscript iframe template svg canvas button select option object audio video dialog menu annotation annotation-xml map".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCKS - frozenset("caption dd dt li tbody td tfoot th thead tr html body legend".split()) | frozenset(["dd", "dt", "li"])
_ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("body main article section div td".split())
_KEPT = frozenset(["html", "body", "main", "article"])
#: MathML elements: part of the text around them, not nodes of their own.
_MATH = frozenset("math semantics maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split())
#: In a compound name, what follows is said of the element's surroundings: has-sidebar, page-with-sidebar, no-comments.
_ABOUT = frozenset("has no with without".split())
#: Part of the main node's density that a node around it must have to be content as a whole.
AROUND = 0.5
#: Links from which a block of nothing but links is a menu, though it stands among content.
MENU_LINKS = 3
#: Words of a class, id or role whose text counts like links.
FURNITURE = frozenset(
    (
        "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar footer masthead"
        " comment comments reply replies disqus cookie cookies consent gdpr notice notices banner alert newsletter subscribe subscription signup login share sharing social related recommended"
        " widget popup modal overlay pager pagination toolbar complementary contentinfo search"
    ).split()
)


def _dropped(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Never part of an article, by element or because it isn't shown."""
    if tag in _DROPPED or (tag == "header" and not inside):
        return True
    return tag not in _KEPT and attributes.get("hidden", "until-found").lower() != "until-found"


def _furniture(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Furniture by a word of its class, id or role; in an article, where names say what the text is about, by half of a name's words."""
    if tag in _KEPT:
        return False
    for name in ("class", "id", "role"):
        # the id of a heading, and of a section or paragraph of an article, is a slug of what it says
        if name not in attributes or (name == "id" and (tag in _HEADINGS or (inside and tag in ("section", "p")))):
            continue
        for compound in attributes[name].lower().split():
            parts = [x for x in _WORDS.split(compound) if x]
            parts = parts[: next((i for i, x in enumerate(parts) if x in _ABOUT), len(parts))]
            known = sum(x in FURNITURE or (not inside and x == "header" and tag != "h1") for x in parts)
            if known and (not inside or 2 * known >= len(parts)):
                return True
    return False


class _Page:
    """Nodes of a page in document order, without elements that are never part of an article."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end = ["body"], [-1], [0]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        self.proposed: list[int] = []  # nodes that are furniture by name
        self.named: list[int] = []  # those of them that count like links
        self.open = [0]
        self.block = self.skip = self.inside = self.linked = 0
        self._read(source)
        while len(self.open) > 1:
            self._close()
        self.end[0] = len(self.tag)
        self._as_links(self._by_name())

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.pieces.append((self.open[-1], self.block, text))
        n = len(" ".join(text.split()))
        self.chars[self.open[-1]] += n
        if self.linked:
            self.link_chars[self.open[-1]] += n

    def _by_name(self) -> list[int]:
        """The nodes named like furniture that count like links; inner ones come first.

        Not the one with the page's article, nor one with most of the text outside
        links that is left, unless an article with a tenth of it stands beside.
        """
        text = [c - lc for c, lc in zip(self.chars, self.link_chars, strict=True)]
        article = max((k for k, tag in enumerate(self.tag) if tag in ("article", "main") and text[k]), key=lambda k: (text[k], -k), default=0)
        gone = self.named
        for k in reversed(self.proposed):
            real = article and 10 * text[article] >= text[0]
            inside = article < k < self.end[article]
            if (article and k < article < self.end[k]) or (2 * text[k] > text[0] and (inside or not real)):
                continue
            gone.append(k)
            out, up = text[k], k
            while up >= 0:
                text[up] -= out
                up = self.parent[up]
        if not text[0]:
            gone.clear()
        return gone

    def _as_links(self, named: list[int]) -> None:
        """Count all text and tags of the nodes as links, for them and the nodes around them."""
        for k in named:
            chars, tags = self.chars[k] - self.link_chars[k], self.tags[k] + 1 - self.link_tags[k] - (self.tag[k] == "a")
            up = self.parent[k]
            while up >= 0:
                self.link_chars[up] += chars
                self.link_tags[up] += tags
                up = self.parent[up]
            for below in range(k, self.end[k]):
                self.link_chars[below], self.link_tags[below] = self.chars[below], self.tags[below]

    def _start(self, tag: str) -> None:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.end.append(node + 1)
        for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
            counts.append(0)
        self.linked += tag == "a"
        self.inside += tag in ("article", "main")
        self.open.append(node)

    def _close(self) -> None:
        node = self.open.pop()
        tag, up = self.tag[node], self.parent[node]
        self.end[node] = len(self.tag)
        self.linked -= tag == "a"
        self.inside -= tag in ("article", "main")
        self.chars[up] += self.chars[node]
        self.link_chars[up] += self.link_chars[node]
        self.tags[up] += self.tags[node] + 1
        self.link_tags[up] += self.link_tags[node] + (tag == "a")

    def _close_to(self, wanted, scope=frozenset()) -> bool:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[k]]
            if tag in wanted:
                while len(self.open) > k:
                    self._close()
                return True
            if tag in scope:
                return False
        return False

    def _read(self, source: str) -> None:
        at, skipped = 0, []  # skipped: open tags below a furniture element
        while at < len(source):
            m = _TOKEN.search(source, at)
            until = m.start() if m else len(source)
            if until > at and not skipped:
                self._text(source[at:until])
            if not m:
                break
            at = max(m.end(), at + 1)
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in _MATH:
                    continue
                if skipped:
                    if tag in skipped:
                        while skipped.pop() != tag:
                            pass
                    elif tag in ("body", "html", "article", "main") and tag in (self.tag[k] for k in self.open):
                        skipped.clear()  # the element around the furniture ends, so it does too
                        self._close_to({tag})
                    self.block += tag in _BLOCKS
                    continue
                self.block += tag in _BLOCKS
                if tag not in ("body", "html"):
                    self._close_to({tag})
                continue
            self.block += tag in _BLOCKS
            if tag == "br" and not skipped:
                self._text(" ")
            if tag in _VOID or m[3].endswith("/") and tag not in _BLOCKS and tag not in _RAW:
                if not skipped:
                    self.tags[self.open[-1]] += 1
                continue
            if tag in _MATH:
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if skipped:
                skipped.append(tag)
                continue
            if tag in ("html", "body"):
                continue
            if tag in _ENDS_P:
                self._close_to({"p"}, {"td", "th", "button", "article", "section", "div"})
            if tag in _ENDS_SAME:
                self._close_to(_ENDS_SAME[tag], _SCOPE[tag])
            attributes = {}
            for name, *values in _ATTRIBUTE.findall(m[3]):
                attributes.setdefault(name.lower(), "".join(values))
            if _dropped(tag, attributes, self.inside > 0):
                skipped.append(tag)
                continue
            if _furniture(tag, attributes, self.inside > 0):
                self.proposed.append(len(self.tag))
            self._start(tag)

    def densities(self) -> list[float]:
        """Composite text density of every node."""
        c_body, lc_body = max(1, self.chars[0]), self.link_chars[0]
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True):
            if not c:
                out.append(0.0)
                continue
            t, rest = max(1, t), max(1, c - lc)
            base = math.log(c / rest * lc + lc_body / c_body * c + math.e)
            ratio = (c / max(1, lc)) * (t / max(1, lt))
            if lc >= c:  # nothing but links
                out.append(0.0)
                continue
            out.append(c / t * max(0.0, math.log(max(1.0, ratio)) / math.log(base) if base > 1.0 + 1e-12 else math.log(max(1.0, ratio))))
        return out

    def content(self) -> list[bool]:
        """Which nodes are content."""
        density = self.densities()
        n = len(density)
        sums = [0.0] * n
        for k in range(1, n):
            sums[self.parent[k]] += density[k]
        for k in range(n):  # text of its own counts like a child without tags
            if self.end[k] == k + 1:
                sums[k] = density[k]
        best = list(range(n))  # largest sum at or below; the first of equals
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            if sums[best[k]] > sums[best[up]] or (sums[best[k]] == sums[best[up]] and best[k] < best[up]):
                best[up] = best[k]
        main, threshold = best[0], density[best[0]]
        k = main
        while k >= 0:
            threshold = min(threshold, density[k])
            k = self.parent[k]
        found: list[int] = []
        k = 0
        while k < n:
            if density[k] < threshold or not self.chars[k]:
                k = self.end[k]
                continue
            if best[k] == k or (k > 0 and self.end[k] == k + 1):
                found.append(k)
                k = self.end[k]
            else:
                k += 1
        around = {self._whole(k, AROUND * density[k], density) for k in found}
        held = set()  # nodes around content: their headings belong to it
        for k in around:
            up = self.parent[k]
            while up >= 0 and up not in held:
                held.add(up)
                up = self.parent[up]
        around |= {k for k in range(1, n) if self.tag[k] in _HEADINGS and self.parent[k] in held}
        out = [False] * n
        for k in around:
            out[k : self.end[k]] = [True] * (self.end[k] - k)
        own = [False] * n  # the subtrees that reach the threshold themselves
        for k in found:
            own[k : self.end[k]] = [True] * (self.end[k] - k)
        written = [False] * n  # in an article by its element, where a list of links can be part of it
        for k in range(1, n):
            written[k] = written[self.parent[k]] or self.tag[k] in ("article", "main")
        named = set(self.named)
        for k in range(1, n):  # furniture in content, blocks of links that only stand beside it, and lists of links
            links = self.tag[k] in _BLOCKS and self.link_chars[k] == self.chars[k] > 0
            if out[k] and density[k] < threshold and (k in named or (links and (not own[k] or (self.link_tags[k] >= MENU_LINKS and not written[k])))):
                out[k : self.end[k]] = [False] * (self.end[k] - k)
        return out

    def _whole(self, node: int, least: float, density: list[float]) -> int:
        """The container of a paragraph or an inline element, and what is around it as long as that is as dense."""
        k = node
        while k > 0 and self.tag[k] not in _CONTAINERS:
            k = self.parent[k]
        k = k or node
        while self.parent[k] > 0 and density[self.parent[k]] >= least:
            k = self.parent[k]
        return k


def main_text(source: str) -> str:
    """Blocks of the main content, one a line, white space made one space."""
    page = _Page(source)
    content = page.content()
    out: list[str] = []
    last, held, r = -1, [], 0
    for node, block, text in page.pieces:
        if not content[node]:
            continue
        if block != last:
            out.append(" ".join("".join(held).split()))
            last, held = block, []
        held.append(text)
    out.append(" ".join("".join(held).split()))
    return "\n".join(x for x in out if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page has the text ''. Broken markup is read as browsers do:
    open elements end with their parent, a new paragraph ends the one before.
    Each row is read whole and on its own, however long; repeated rows give
    repeated results, an empty table an empty one. Of nodes with equal density
    sums the first is taken. Other columns, whatever their names, are left alone.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
