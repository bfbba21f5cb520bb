"""Main-text extraction by composite text density.

Every node of the page's tree gets the density of its text: characters per tag, weighed
down by the share of link characters and link tags.  The densities of a node's children
add up to its density sum; the node with the largest sum holds the densest part of the article.  The
smallest density on the path from that node up to the body is the threshold.

Furniture is taken out before: elements that never hold text of an article (scripts, styles, controls), blocks that
are links for the most part, and elements whose tag, role, class or id names a menu, header, footer,
sidebar, notice, advert, form or reader comments.  A name alone is not enough: an element that holds the article or main
element, or more than half of the page's text outside links, is none of these whatever it is called (comments by name,
and elements whose tag says so, may be longer than the article).  Names count as whole words at the start of a class or id, or at its end for words
that mean nothing else there, so ``market-share`` is no share bar.  Within an article or main element, names that its own sections may have
too (``AMBIGUOUS``) count only where the element is thinner than the path to the densest node, or links for the half of it.

What is kept: the article or main element around the densest node, or else the branch of the body around it.  Branches
that hang off the path within it are kept if they are text, headings, lists or tables, or containers that reach the
threshold, hold a heading, or stand between kept ones.  Beyond it, under the body, branches that reach the
threshold and headings that lead up to a kept branch are kept.

Text is cut into blocks at block-level tags; white space in a block becomes one space,
blocks are trimmed and joined by a blank line.  Nothing else is dropped or shortened.

Defined results: null or empty html, and pages without text, give an empty text; rows are
independent, so repeated rows give repeated results; other columns are ignored.  The tree
is walked with loops, so deep nesting does not exhaust the stack.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element classes and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html title option optgroup".split())
CONTROLS = frozenset(
    "script style noscript template head title iframe object svg select textarea input canvas audio video map datalist button".split()
)
SECTIONS = frozenset("nav footer aside form menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset("address article aside body center details div fieldset footer form header main section".split())
COMMENTS = frozenset("comment comments commenting disqus respond reply replies discussion".split())
FURNITURE = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promos promotion sponsor"
    " sponsored nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer footers header"
    " masthead topbar cookie cookies consent gdpr privacy notice notices disclaimer popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended recommendations widget widgets toolbar pager pagination copyright hidden".split()
)
AT_END = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers ad ads advert adverts advertisement banner"
    " banners cookie cookies consent notice notices popup modal newsletter widget widgets masthead topbar toolbar comments disqus pagination".split()
)
#: Names that sections and sentences of an article have too: within one they count only where the density agrees.
AMBIGUOUS = frozenset("discussion related recommended recommendations social share sharing privacy disclaimer copyright consent gdpr".split())
#: Words before a name that do not change it; those of an article make a header its own.
OF_ARTICLE = frozenset("article content entry post story text".split())
QUALIFIERS = OF_ARTICLE | frozenset("site page main global top bottom left right primary secondary blog web user reader js wp block".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
LINKS_LEAST, LINKS_IN_ARTICLE, LINK_SHARE = 2, 3, 0.75
OPEN_SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("ul ol dl table tbody select body html".split())
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def furniture_name(value: str) -> tuple[str, bool]:
    """The furniture that a class or id names (or none), and whether it is named as part of an article."""
    for token in _HUMP.sub("-", value).lower().split():
        names = _WORD.findall(token)
        own = False
        while len(names) > 1 and names[0] in QUALIFIERS:
            own |= names.pop(0) in OF_ARTICLE
        if names and (found := names[0] if names[0] in FURNITURE else names[-1] if names[-1] in AT_END else ""):
            return found, own
    return "", False


class _Tree(HTMLParser):
    """Nodes in document order: tag, parent, whether the node never holds text of an article, and which furniture it
    is by name.  Texts keep the node they stand in and the number of the block they belong to."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.control, self.named = ["#root"], [-1], [False], [""]
        self.texts: list[tuple[int, int, str]] = []
        self.stack, self.block = [0], 0
        self.opened: Counter[str] = Counter()

    def _furniture(self, tag: str, attrs) -> str:
        in_article = self.opened["article"] > 0 or self.opened["main"] > 0
        if tag in SECTIONS or tag == "header" and not in_article:
            return tag if tag == "form" else f"<{tag}>"  # a form may be around the whole page
        if tag in ("html", "body", "main"):
            return ""
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id"):
                found, own = furniture_name(value)
                if found and not (found == "header" and (own or in_article)) and (tag != "article" or found in COMMENTS):
                    return found
            if tag != "article" and (name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true"):
                return name
        return ""

    def _close_to(self, depth: int) -> None:
        closed = [self.tags[i] for i in self.stack[depth:]]
        self.block += any(t in BLOCK for t in closed)
        self.opened.subtract(closed)
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P or tag == "p":  # an open paragraph ends here
            for d in range(len(self.stack) - 1, 0, -1):
                open_tag = self.tags[self.stack[d]]
                if open_tag == "p":
                    self._close_to(d)
                    break
                if open_tag in BLOCK:
                    break
        for d in range(len(self.stack) - 1, 0, -1) if tag in OPEN_SIBLINGS else ():
            open_tag = self.tags[self.stack[d]]
            if open_tag in OPEN_SIBLINGS[tag]:
                self._close_to(d)
                break
            if open_tag in SCOPES:
                break
        parent = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        in_sentence = tag == "button" and self.opened["p"] > 0
        self.control.append(tag in CONTROLS and not in_sentence)
        self.named.append(self._furniture(tag, attrs))
        if tag in BLOCK:
            self.block += 1
        if tag == "br":
            self.texts.append((len(self.tags) - 1, self.block, " "))
        if tag not in VOID:
            self.stack.append(len(self.tags) - 1)
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for d in range(len(self.stack) - 1, 0, -1) if self.opened[tag] > 0 else ():
            if self.tags[self.stack[d]] == tag:
                self._close_to(d)
                return
            if self.tags[self.stack[d]] in ("article", "main", "td", "table") and tag in ("p", "b", "i", "em", "span", "a"):
                return

    def handle_data(self, data):
        self.texts.append((self.stack[-1], self.block, data))


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters per tag, times the logarithm of how much denser in text than in links the
    node is; the logarithm's base grows with the share of link characters."""
    if chars <= 0:
        return 0.0
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + body_ratio * chars + math.e)
    gain = (chars / max(link_chars, 1)) * (max(tags, 1) / max(link_tags, 1))
    scale = math.log(base) if base > 1.0 else 1.0  # a page without any link
    return chars / max(tags, 1) * max(math.log(gain), 0.0) / scale


def _gathered(tree: _Tree, out: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each node's branch without what is ``out``: characters, tags, characters in links, link tags."""
    n = len(tree.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parents[i]] or tree.tags[i] == "a"
    for node, _, text in tree.texts:
        if not out[node]:
            size = len(text) - text.count(" ") - text.count("\n")
            chars[node] += size
            link_chars[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):  # children come after their parents
        if not out[i]:
            p = tree.parents[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.tags[i] == "a")
    return chars, tags, link_chars, link_tags


def _in_article(tree: _Tree) -> list[bool]:
    found = [False] * len(tree.tags)
    for i in range(1, len(found)):
        p = tree.parents[i]
        found[i] = found[p] or tree.tags[p] in ("article", "main") and not tree.named[p]
    return found


def _furniture(tree: _Tree, spared: frozenset[int] = frozenset()) -> tuple[list[bool], float]:
    """Which nodes are furniture or lie in it, and the share of link characters in the whole page.  The names of spared nodes do not count."""
    n, parents = len(tree.tags), tree.parents
    out = [False] * n
    for i in range(1, n):
        out[i] = out[parents[i]] or tree.control[i]
    chars, _, link_chars, link_tags = _gathered(tree, out)
    core = [0] * n  # article and main elements below
    for i in range(n - 1, 0, -1):
        core[parents[i]] += core[i] + (tree.tags[i] in ("article", "main") and not tree.named[i] and not out[i])
    page = chars[0] - link_chars[0]
    sentence, inside = [False] * n, _in_article(tree)
    for i in range(1, n):
        sentence[i] = sentence[parents[i]] or tree.tags[i] == "p"
        named = tree.named[i] and i not in spared and not core[i] and (tree.named[i] in COMMENTS or tree.named[i].startswith("<") or 2 * (chars[i] - link_chars[i]) <= page)
        links = tree.tags[i] in BLOCK and not sentence[i] and tree.tags[i] not in ("html", "body", "main", "article")
        links = links and link_tags[i] >= (LINKS_IN_ARTICLE if inside[i] else LINKS_LEAST) and link_chars[i] >= LINK_SHARE * chars[i]
        out[i] = out[i] or out[parents[i]] or bool(named) or links
    return out, link_chars[0] / max(chars[0], 1)


def densities(tree: _Tree, out: list[bool], ratio: float) -> list[float]:
    """The density of every node; none for furniture."""
    figures = zip(*_gathered(tree, out))
    return [0.0 if out[i] else composite_density(*f, ratio) for i, f in enumerate(figures)]


def _path(tree: _Tree, out: list[bool], density: list[float]) -> tuple[list[list[int]], list[int], int, float]:
    """The children of each node, the path up from the node with the largest density sum, the place of the body in it, and the
    smallest density up to there."""
    n, parents = len(tree.tags), tree.parents
    sums, children = [0.0] * n, [[] for _ in range(n)]
    for i in range(1, n):
        sums[parents[i]] += density[i]
        if not out[i]:
            children[parents[i]].append(i)
    best = max(range(n), key=lambda i: (sums[i], i)) if any(sums) else 0
    path = [best]
    while parents[path[-1]] >= 0:
        path.append(parents[path[-1]])
    body = next((k for k, i in enumerate(path) if tree.tags[i] == "body"), len(path) - 1)
    return children, path, body, min(density[i] for i in path[: body + 1])


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    n, parents = len(tree.tags), tree.parents
    out, ratio = _furniture(tree)
    if doubtful := [i for i, (name, inside) in enumerate(zip(tree.named, _in_article(tree))) if inside and name in AMBIGUOUS]:
        threshold = _path(tree, out, densities(tree, out, ratio))[3]
        maybe, _ = _furniture(tree, frozenset(doubtful))
        density, (chars, _, links, _) = densities(tree, maybe, ratio), _gathered(tree, maybe)
        out, ratio = _furniture(tree, frozenset(i for i in doubtful if density[i] >= threshold > 0 and 2 * links[i] < chars[i]))
    if all(out[node] or not text.strip() for node, _, text in tree.texts):
        return ""
    density = densities(tree, out, ratio)
    children, path, body, threshold = _path(tree, out, density)
    whole = next((k for t in ("article", "main") for k, i in enumerate(path) if tree.tags[i] == t), None)
    titled = [tree.tags[i] in HEADINGS for i in range(n)]  # nodes with a heading, themselves or below
    for i in range(n - 1, 0, -1):
        titled[parents[i]] = titled[parents[i]] or titled[i] and not out[i]
    kept = [False] * n
    kept[path[whole or 0]] = True
    for k in range(1 + (whole or 0), body + 1):
        here = children[path[k]]
        on_path, under_body = here.index(path[k - 1]), k == body
        good = [i == path[k - 1] for i in here]
        for at, i in enumerate(here):
            container = tree.tags[i] in CONTAINERS
            if whole is None:
                good[at] = good[at] or (density[i] >= threshold > 0 and tree.tags[i] in BLOCK) or not under_body and (not container or titled[i])
        inside = _between(good)
        for at, i in enumerate(here):
            leads = at < on_path and titled[i] and (tree.tags[i] in HEADINGS or whole is None) and not (whole is not None and titled[path[whole]] and tree.tags[i] != "h1")
            if good[at] or whole is None and inside[at] or leads:
                kept[i] = kept[i] or i != path[k - 1]
    on_path = set(path[(whole or 0) + 1 : body + 1]) if whole is None else set()
    for i in range(1, n):
        kept[i] = kept[i] or kept[parents[i]]
    blocks: list[list[str]] = []
    last = -1
    for node, block, text in tree.texts:
        if (kept[node] or node in on_path and node != path[body]) and not out[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    found = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in found if b)


def _between(good: list[bool]) -> list[bool]:
    """Places with good ones before and behind."""
    at = [k for k, g in enumerate(good) if g]
    return [bool(at) and at[0] < k < at[-1] for k in range(len(good))]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
