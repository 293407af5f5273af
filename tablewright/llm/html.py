"""Main text of HTML pages by tag-path ratios.

A page is a list of text blocks, each with the path of tags from the root to it
(elements with their class). What a page never shows, and page furniture that names
itself by its element, is no candidate. A name in a class or id, or a form or aside, may
as well belong to a wrapper of the article: such a subtree is no candidate only if it
has no article, main or h1 and holds the minor share of the page's text, or if an
article or main outside of it weighs more. For the rest, path ratios decide:

1. per path: text length, punctuation and number of text nodes, and the share of the
   length that lies in links; ratio = length / nodes, weighed by 1 + punctuation / nodes
   and by the share outside of links;
2. smoothing: the paths are put in page order of their first block and each ratio takes
   a share of its neighbours' (weights 1, 2, 1);
3. fusion: a container's strength is the sum of its blocks' smoothed ratios times their
   length; walking down from the root into the strongest child while it holds most of
   its parent's strength gives the content container;
4. threshold: a path is content if it lies in that container, or if its smoothed ratio
   is at least half of the container's mean ratio and its own text is of that kind.

So a short heading or paragraph of the article is kept by its container, not by its
length, and a long notice outside it does not come in by its length alone.

Blocks are the text between the borders of block elements and line breaks; white space
inside is one space. Character references are decoded, once, as browsers do.

Defined cases: null, empty and tagless pages: the text of a page without tags is its
own; a page with nothing but furniture has an empty text; unclosed and crossed tags
close as browsers close them (p, li and the like by their successors, the rest by their
parents' end); repeated rows give repeated results; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt rtc ruby s samp small"
    " span strike strong sub sup time tt u var wbr nobr".split()
)
UNSEEN = RAW | set("head object svg math audio video canvas applet map datalist".split())
FURNITURE = set("nav footer button select dialog menu option".split())
#: Furniture as a rule, but also wrappers of whole pages.
LIKELY_FURNITURE = set("aside form fieldset".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names, as whole words, that name page furniture.
FURNITURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments"
    r"|consent|cookie|cookies|disqus|dropdown|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice"
    r"|pager|pagination|popup|promo|promoted|promotion|related|reply|replies|respond|share|sharing|sidebar|sidebars|sitenav"
    r"|skip|social|sponsor|sponsored|subscribe|toolbar|topbar|widget|widgets|header|site-header|page-header|alert"
    r"|discussion|reactions)(?:$|[\s_-])",
    re.I,
)
#: Names that hold such a word but belong to an article: its own header, and its opening.
ARTICLE_HEADER = re.compile(r"(?:^|[\s_-])(?:entry|post|article|story)[_-](?:header|heading|title|head)(?:$|\s)", re.I)
OPENING = re.compile(r"[^\s]*(?:^|[\s_-])(?:lead|intro|standfirst|summary|abstract)(?:$|\s)", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
STOPS_AT = {"ul", "ol", "dl", "table", "select", "menu"}
MAIN = {"article", "main"}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
SPACE = re.compile(r"\s+")
KEEPS_MOST = 0.6
#: A named subtree with this share of the page's text or more is a wrapper.
WRAPS = 0.5
#: Share of a named subtree's text that an article outside of it needs to be the page's own.
RIVAL = 0.1
NEAR_RATIO = 0.5


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text.strip(" /\n\t") else {}


def _is_furniture(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not inside_main and not _is_article_header(tag, attrs):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if attrs.get("role", "").lower() in FURNITURE_ROLES or HIDDEN_STYLE.search(attrs.get("style", "")):
        return True
    return False


def _is_article_header(tag: str, attrs: dict[str, str]) -> bool:
    return tag in ("header", "div", "hgroup") and any(ARTICLE_HEADER.search(attrs.get(k, "")) for k in ("class", "id"))


def _is_named(tag: str, attrs: dict[str, str]) -> bool:
    """Whether the element calls itself furniture, which a wrapper of the article may do too."""
    if tag in ("html", "body") or tag in MAIN:
        return tag == "article" and bool(re.search(r"\bcomments?\b", attrs.get("class", ""), re.I))
    if tag in LIKELY_FURNITURE or attrs.get("role", "").lower() == "form":
        return True
    if _is_article_header(tag, attrs):
        return False
    # a name is one word of a class; the opening of an article may be called after what it is like
    names = [name for k in ("class", "id") for name in attrs.get(k, "").split()]
    return any(FURNITURE_WORDS.search(name) and not OPENING.search(name) for name in names)


def _left_out(nodes: list[tuple[int, bool, bool, bool]], own: list[int]) -> list[bool]:
    """Which nodes are furniture or lie in it.

    Nodes are (parent, named, heads, is main), in page order; -1 is the page. ``own`` is
    the length of the text right inside each, the last one that of the page.
    """
    n = len(nodes)
    size, last, heads = list(own), list(range(n)), [False] * (n + 1)
    for i in range(n - 1, -1, -1):
        parent, _, is_head, _ = nodes[i]
        size[parent] += size[i]
        heads[parent] |= is_head or heads[i]
        if parent >= 0:
            last[parent] = max(last[parent], last[i])
    # the longest article or main that ends before a node, or starts behind it
    before, behind = [0] * (n + 1), [0] * (n + 1)
    for i in range(n):
        if nodes[i][3]:
            before[last[i] + 1] = max(before[last[i] + 1], size[i])
    for i in range(1, n + 1):
        before[i] = max(before[i], before[i - 1])
    for i in range(n - 1, -1, -1):
        behind[i] = max(behind[i + 1], size[i] if nodes[i][3] else 0)
    out = [False] * (n + 1)
    for i, (parent, named, _, _) in enumerate(nodes):
        rival = max(before[i], behind[last[i] + 1])
        if heads[i]:
            furniture = rival > size[i]
        else:
            furniture = size[i] < WRAPS * size[-1] or rival > RIVAL * size[i]
        out[i] = parent >= 0 and out[parent] or named and furniture
    return out


@dataclass
class Paths:
    """The page's tag paths as a tree: a path is its parent and the label of its last element."""

    parent: list[int] = field(default_factory=lambda: [-1])
    label: list[str] = field(default_factory=lambda: [""])
    #: Whether the last element is the header of an article.
    heading: list[bool] = field(default_factory=lambda: [False])
    known: dict[tuple[int, str], int] = field(default_factory=dict)

    def below(self, parent: int, label: str, heading: bool) -> int:
        found = self.known.get((parent, label))
        if found is None:
            found = self.known[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
            self.heading.append(heading)
        return found


@dataclass
class Page:
    """What is open while a page is read. Each open element has (tag, dropped, node, path).

    ``node`` is the nearest one that may be furniture, ``path`` that of the nearest block
    element. Counts of what is open save going through it: ``open`` of all tags, ``runs`` of
    the inline ones inside each open block.
    """

    stack: list[tuple[str, bool, int, int]] = field(default_factory=list)
    open: Counter = field(default_factory=Counter)
    runs: list[Counter] = field(default_factory=lambda: [Counter()])

    def push(self, tag: str, dropped: bool, node: int, path: int) -> None:
        self.stack.append((tag, dropped, node, path))
        self.open[tag] += 1
        if tag in INLINE:
            self.runs[-1][tag] += 1
        else:
            self.runs.append(Counter())

    def pop_to(self, i: int) -> None:
        for tag, *_ in reversed(self.stack[i:]):
            self.open[tag] -= 1
            if tag in INLINE:
                self.runs[-1][tag] -= 1
            else:
                self.runs.pop()
        del self.stack[i:]

    def find(self, tag: str) -> int | None:
        """Place of the element that an end tag closes; an inline one only inside its block."""
        if not (self.runs[-1][tag] if tag in INLINE else self.open[tag]):
            return None
        i = len(self.stack) - 1
        while self.stack[i][0] != tag:
            i -= 1
        return i


Found = list[tuple[int, str, int]]


def blocks(html: str) -> tuple[Found, Paths]:
    """(path, text, characters in links) of the candidate blocks, in page order, and the paths."""
    page, paths = Page(), Paths()
    stack = page.stack
    out: Found = []
    nodes: list[tuple[int, bool, bool, bool]] = []
    places: list[int] = []
    parts: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal parts, linked
        text = SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            path, node = (stack[-1][3], stack[-1][2]) if stack else (0, -1)
            out.append((path, text, min(linked, len(text))))
            places.append(node)
        parts, linked = [], 0

    def pop_to(i: int) -> None:
        if any(entry[0] not in INLINE for entry in stack[i:]):
            close_block()
        page.pop_to(i)

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][1]):
            parts.append(raw)
            if page.open["a"]:
                linked += len(raw)

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        # behind the last > only a comment can start
        found = TOKEN.search(html, at) if at <= last else None
        start_at = found.start() if found else html.find("<!--", at)
        text(html[at : start_at if start_at >= 0 else n])
        if not found:
            break
        at = found.end()
        end, start, rest = found.group(1), found.group(2), found.group(3)
        if end:
            tag = end.lower()
            if tag == "br" or tag == "p" and not page.open["p"]:
                close_block()
            elif (i := page.find(tag)) is not None:
                pop_to(i)
        elif start:
            tag = start.lower()
            attrs = _attributes(rest or "")
            if tag in ("br", "hr"):
                close_block()
                continue
            if tag in VOID:
                continue
            if tag not in INLINE:
                close_block()
                # elements that the new one ends: an open p, and its own kind in lists and tables
                if page.open["p"] or any(page.open[t] for t in CLOSED_BY.get(tag, ())):
                    for i in range(len(stack) - 1, -1, -1):
                        t = stack[i][0]
                        if t == "p" or t in CLOSED_BY.get(tag, ()):
                            pop_to(i)
                            if t != "p":
                                break
                        elif t in STOPS_AT or t not in INLINE and t not in ("tr", "td", "th", "tbody", "thead"):
                            break
            if tag in RAW:
                closing = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                at = closing.start() if closing else n
                if closing:
                    at = html.find(">", at) + 1 or n
                continue
            _, dropped, node, path = stack[-1] if stack else ("", False, -1, 0)
            inside_main = any(page.open[t] for t in MAIN)
            dropped = dropped or tag in UNSEEN or _is_furniture(tag, attrs, inside_main)
            if tag not in ("svg", "math") or not (rest or "").endswith("/"):
                if tag not in INLINE:
                    named, head = _is_named(tag, attrs), tag in MAIN or tag == "h1"
                    if not dropped and (named or head):
                        nodes.append((node, named, head and not named, tag in MAIN and not named))
                        node = len(nodes) - 1
                    label = tag + ("." + ".".join(sorted(attrs["class"].lower().split())) if attrs.get("class") else "")
                    path = paths.below(path, label, _is_article_header(tag, attrs))
                page.push(tag, dropped, node, path)
    close_block()
    own = [0] * (len(nodes) + 1)
    for (_, text_, _), node in zip(out, places, strict=True):
        own[node] += len(text_)
    left_out = _left_out(nodes, own)
    return [block for block, node in zip(out, places, strict=True) if not left_out[node]], paths


def content(found: Found, tree: Paths) -> list[bool]:
    """Which blocks are content."""
    if not found:
        return []
    stats: dict[int, list[float]] = {}
    for path, text, linked in found:
        s = stats.setdefault(path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
        s[3] += linked
    paths = list(stats)
    ratio = {q: n / k * (1 + p / k) * (1 - linked / n) for q, (n, p, k, linked) in stats.items()}
    smooth = {}
    for i, path in enumerate(paths):
        near = [(2, ratio[path])] + [(1, ratio[paths[j]]) for j in (i - 1, i + 1) if 0 <= j < len(paths)]
        smooth[path] = sum(w * r for w, r in near) / sum(w for w, _ in near)
    # a container's strength is that of all paths in it; parents come before their children
    size = len(tree.parent)
    strength, used = [0.0] * size, [False] * size
    for path in paths:
        strength[path] += min(ratio[path], smooth[path]) * stats[path][0]
        used[path] = True
    inner: list[list[int]] = [[] for _ in range(size)]
    for path in range(size - 1, 0, -1):
        if used[path]:
            up = tree.parent[path]
            strength[up] += strength[path]
            used[up] = True
            inner[up].append(path)
    root = 0
    while inner[root]:
        best = max(inner[root], key=lambda p: (strength[p], tree.label[p]))
        # a run of paragraphs is not narrowed to one kind of them
        if strength[best] < KEEPS_MOST * strength[root] or not inner[best]:
            break
        root = best
    inside, above = [False] * size, [False] * size
    up = root
    while up >= 0:
        above[up], up = True, tree.parent[up]
    # the header of an article beside the container, or beside what holds it, belongs to it
    titled = [False] * size
    for path in range(size):
        up = tree.parent[path]
        inside[path] = path == root or up >= 0 and inside[up]
        titled[path] = up >= 0 and (titled[up] or tree.heading[path] and above[up])
    own = [p for p in paths if inside[p]]
    mean = sum(smooth[p] * stats[p][0] for p in own) / sum(stats[p][0] for p in own)

    def like_content(p: int) -> bool:
        n, marks, k, linked = stats[p]
        return smooth[p] >= NEAR_RATIO * mean and ratio[p] >= NEAR_RATIO * mean and linked < 0.3 * n

    keep = {p: inside[p] or titled[p] or like_content(p) for p in paths}
    return [keep[path] for path, _, _ in found]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found, paths = blocks(html)
    return "\n".join(text for (_, text, _), kept in zip(found, content(found, paths), strict=True) if kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    texts = rows.mapInArrow(_extracted, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
