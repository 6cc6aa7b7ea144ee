"""Main text of web pages by composite text density.

Every node of the page's tree has its characters and tags, and those that are noise: inside links, or in elements that by kind, role
or class serve navigation, adverts, notices, forms or reader comments. A node's composite text density is its characters per tag, weighed down
as noise makes up more of it and the page as a whole holds little. A node's sum is that of its children's densities; the
subtree with the largest sum is the main text. The least density on its path up to the body is the threshold: a block inside the subtree of which
more than half is noise must reach it to stay. Beside the path, what belongs to the same text is taken by the same rule: all of an
enclosing article or main element; headings before the path, paragraphs, lists, quotations and tables; and parts whose own density reaches
the threshold and whose largest sum is a quarter of the main one; and the sections that stand beside one on the path.

A hint never removes anything by itself, it only makes noise of characters; it is void for headings, for ids (but for a div's whole id such
as `comments`), and for an element that holds nine tenths of the page's text outside links and other hints, such as a form
around the whole page. Inside article and main elements, asides, and words that also name parts of articles or are about links (legal, tags, related, social,
share, ...) count only where most characters are links. Links alone don't make noise of a heading, of a paragraph, or of what an article holds: a linked title
or a list of references is text. Only what is never shown as text goes first: scripts, styles, templates, controls, hidden elements.

Defined results: null or empty html gives an empty text. Character references are decoded; white space in a block becomes one
space; blocks are joined by one line feed in page order; nothing is cut off. Of equal sums the first node in page order wins.
Each row gives one row; broken markup is read as far as it goes. Only page_id, url and html are read.
"""

from __future__ import annotations

import heapq
import math
import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

#: Fixed values of HTML: elements with no end tag; elements that stand as blocks; those whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCKS - frozenset("body caption html legend option tbody td tfoot th thead title tr".split())
#: An element of the key's kind ends an open one of these kinds.
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An open element of these kinds hides what is outside it from the two rules above.
SCOPES = frozenset("table ul ol dl div article section main aside nav body td th".split())
#: Never shown as text of the page.
DROPPED = frozenset("head script style noscript template button select textarea input option datalist iframe object svg canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Kinds that stand for prose beside the main subtree.
PROSE = frozenset("p blockquote pre ul ol dl table figure".split())
#: Kinds whose text is their own, also where it is all a link: a linked title, or a paragraph that is one link.
OWN_TEXT = HEADINGS | {"p", "blockquote", "pre"}
#: Kinds and roles that are noise (a header only outside article and main).
NOISE_KINDS = frozenset("nav aside footer form dialog menu label".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Parts of class names that are noise anywhere; those that are for what they link to, and whole class names that
#: also name parts of articles, are noise inside article and main only where most characters are links.
_EDGES = r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?<!without[_-])(?:{})(?:$|[\s_](?!open|closed)|-(?!open|closed|status|count))"
NOISE_PARTS = re.compile(_EDGES.format("ads?|adverts?|advertisements?|sponsored|promos?|banners?|sidebars?|cookies?|consent|gdpr|popups?|newsletter|subscribe|signup|comments?|replies|disqus|respond|masthead"), re.I)
LINK_PARTS = re.compile(_EDGES.format("navbar|navigation|breadcrumbs?|share|sharing|social|toolbar|pagination|pager"), re.I)
NOISE_NAMES = re.compile(
    r"(?:^|\s)(?:side|menu|nav|foot|footer|header|notices?|alerts?|modal|overlay|login|related|recommend(?:ed|ations)?|widgets?|tags|skip|copyright|legal|sponsors?|promotions?)(?:[_-](?:box|bar|block|section|wrapper|container|list|links|area|posts|articles|inner|content|menu|nav))?(?:$|\s)",
    re.I,
)
NOISE_IDS = re.compile(r"(?:comments|respond|disqus_thread|sidebar|footer|header|masthead|nav|navigation|menu|cookie-?banner)$", re.I)
#: Share of the text outside links and other hints from which an element's own hint is void; share of the largest sum for parts beside it.
WHOLE, PART = 0.9, 0.25


#: A comment, declaration or tag; a `<` that starts none of these is text. Attributes may hold `>` in quotes.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTES = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
#: What these hold is not markup up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())


class Tree:
    """Nodes in page order as parallel lists; text pieces with the node and the block they lie in."""

    def __init__(self) -> None:
        self.tag, self.up, self.off, self.hint = ["#root"], [-1], [False], [False]
        self.art, self.weak = [False], [False]  # inside article or main; hinted there to be links
        self.open = [0]
        #: Places in `open` of each kind, and of the kinds that are scopes.
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0

    def feed(self, html: str) -> None:
        at, data, start, end = 0, self.handle_data, self.handle_starttag, self.handle_endtag
        while m := MARKUP.search(html, at):
            if m.start() > at:
                data(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, attributes = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                end(name)
                continue
            start(name, attributes)
            if name in RAW:
                close = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(html, at)
                data(html[at : close.start() if close else len(html)])
                at = close.end() if close else len(html)
                end(name)
            elif attributes.endswith("/") and name not in VOID and name not in BLOCKS:
                end(name)
        if at < len(html):
            data(html[at:])

    def kind_of(self, tag: str, attributes: str, within: bool) -> tuple[bool, bool, bool]:
        """Whether an element is dropped, whether it is hinted to be noise, and whether it is so only if it is links. within: inside article or main."""
        if tag in DROPPED:
            return True, False, False
        if tag in ("html", "body", "article", "main"):
            return False, False, False
        weak = within and tag == "aside"
        hint = tag in NOISE_KINDS and not weak or tag == "header" and not within
        for m in ATTRIBUTES.finditer(attributes) if attributes else ():
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False, False
            if name == "role":
                hint = hint or value in NOISE_ROLES
            elif name == "class":
                hint = hint or bool(NOISE_PARTS.search(value))
                if not hint and (LINK_PARTS.search(value) or NOISE_NAMES.search(value)):
                    hint, weak = not within, within
            elif name == "id" and tag == "div":
                hint = hint or bool(NOISE_IDS.match(value))
        return False, hint and tag not in HEADINGS, weak and not hint and tag not in HEADINGS

    def close(self, place: int) -> None:
        """End the open elements from a place on."""
        while len(self.open) > place:
            tag = self.tag[self.open.pop()]
            self.at[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def cut(self, kinds: tuple[str, ...]) -> None:
        """End the innermost open element of one of these kinds, if no scope hides it."""
        place = max((self.at[k][-1] for k in kinds if self.at.get(k)), default=0)
        if place and not (self.scopes and self.scopes[-1] > place):
            self.close(place)

    def handle_starttag(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self.cut(("p",))
        if tag in ENDS_OWN:
            self.cut(ENDS_OWN[tag])
        if tag in BLOCKS:
            self.block += 1
        top = self.open[-1]
        self.tag.append(tag)
        self.up.append(top)
        off, hint, weak = self.kind_of(tag, attributes, self.art[top])
        self.off.append(off or self.off[top])
        self.hint.append(hint)
        self.weak.append(weak)
        self.art.append(self.art[top] or tag in ("article", "main"))
        if tag in VOID:
            if tag == "br":
                self.pieces.append((top, self.block, " "))
        else:
            self.at.setdefault(tag, []).append(len(self.open))
            if tag in SCOPES:
                self.scopes.append(len(self.open))
            self.open.append(len(self.tag) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        if self.at.get(tag):
            place = self.at[tag][-1]
            if tag in BLOCKS or not (self.scopes and self.scopes[-1] > place):
                self.close(place)

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if not self.off[top]:
            self.pieces.append((top, self.block, unescape(data) if "&" in data else data))


def summed(tree: Tree, own: list[int]) -> list[int]:
    """For each node, the sum over its subtree, without what is off."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        if not tree.off[i]:
            out[tree.up[i]] += out[i]
    return out


def hinted(tree: Tree, chars: list[int], free: list[int]) -> list[bool]:
    """The nodes under a hint that holds. free: characters outside links, by subtree. A hint that holds nearly all free text outside the other outermost
    hints is void, and the hints right below it count in its place; largest first, so each hint is looked at once."""
    n = len(tree.tag)
    hint = [h or w and 2 * free[i] < chars[i] for i, (h, w) in enumerate(zip(tree.hint, tree.weak))]
    above, below, tops = [-1] * n, {}, []  # the nearest hint above each node, and the hints right below each hint
    for i in range(1, n):
        up = tree.up[i]
        above[i] = up if hint[up] else above[up]
        if hint[i] and not tree.off[i]:
            if above[i] < 0:
                heapq.heappush(tops, (-free[i], i))
            else:
                below.setdefault(above[i], []).append(i)
    rest, void = free[0] + sum(f for f, _ in tops), set()
    while tops and free[tops[0][1]] and free[tops[0][1]] >= WHOLE * (rest + free[tops[0][1]]):
        _, i = heapq.heappop(tops)
        rest += free[i]
        void.add(i)
        for j in below.get(i, ()):
            heapq.heappush(tops, (-free[j], j))
            rest -= free[j]
    under = [False] * n
    for i in range(1, n):
        under[i] = under[tree.up[i]] or hint[i] and i not in void
    return under


def densities(tree: Tree) -> tuple[list[int], list[int], list[int], list[float], list[float]]:
    """For each node: characters, characters that are noise, those of them under hints, composite density, sum of its children's densities."""
    n = len(tree.tag)
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.up[i]] or tree.tag[i] == "a"
    own, own_free = [0] * n, [0] * n
    for node, _, text in tree.pieces:
        size = len(text) - text.count(" ")
        own[node] += size
        if not linked[node]:
            own_free[node] += size
    chars = summed(tree, own)
    under = hinted(tree, chars, summed(tree, own_free))
    void = [a or b for a, b in zip(linked, under)]
    noisy, under_hints = (summed(tree, [c if v else 0 for c, v in zip(own, flags)]) for flags in (void, under))
    tags = summed(tree, [int(i > 0) for i in range(n)])
    noise_tags = summed(tree, [int(i > 0 and v and (tree.tag[i] == "a" or not linked[i])) for i, v in enumerate(void)])
    page_chars, page_noise = max(chars[0], 1), noisy[0]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if tree.off[i] or not chars[i]:
            continue
        inner = 1 if i else 0  # a node is not a tag of its own
        c, t, lc, lt = chars[i], max(tags[i] - inner, 1), noisy[i], noise_tags[i] - (inner and void[i] and (tree.tag[i] == "a" or not linked[i]))
        base = math.log(c / max(c - lc, 1) * lc + page_noise / page_chars * c + math.e)
        density[i] = c / t * math.log(max(c / max(lc, 1) * (t / max(lt, 1)), 1.0000001)) / base
    for i in range(1, n):
        total[tree.up[i]] += density[i]
    return chars, noisy, under_hints, density, total


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    n = len(tree.tag)
    chars, noisy, under_hints, density, total = densities(tree)
    if not chars[0]:
        return ""
    body = next((i for i in range(n) if tree.tag[i] == "body" and chars[i]), 0)
    inside, largest = [False] * n, list(total)
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[tree.up[i]] and not tree.off[i]
    for i in range(n - 1, 0, -1):
        if not tree.off[i]:
            largest[tree.up[i]] = max(largest[tree.up[i]], largest[i])
    best = max((i for i in range(n) if inside[i]), key=lambda i: (total[i], -i))
    if total[best] <= 0:
        best = body
    path, at = [best], best
    while at != body:
        at = tree.up[at]
        path.append(at)
    threshold, on_path = min(density[i] for i in path), dict(zip(path[1:], path))
    whole = {i for i in path if tree.art[i] or tree.tag[i] in ("article", "main")}

    def stays(i: int) -> bool:
        lost = under_hints[i] if tree.art[i] or tree.tag[i] in OWN_TEXT else noisy[i]
        return tree.tag[i] not in BLOCKS and not tree.hint[i] or density[i] >= threshold or 2 * lost <= chars[i]

    def belongs(i: int, up: int) -> bool:
        """A part beside the path."""
        if up in whole or tree.tag[i] in PROSE:
            return stays(i)
        if tree.tag[i] in HEADINGS:
            return i < on_path[up] and stays(i)
        if tree.tag[i] == "section" == tree.tag[on_path[up]]:
            return stays(i)
        return density[i] >= threshold and largest[i] >= PART * total[best] and 2 * noisy[i] <= chars[i]

    taken = [False] * n
    taken[best] = True
    for i in range(body + 1, n):
        up = tree.up[i]
        if i == best or tree.off[i]:
            continue
        if up in on_path:
            taken[i] = on_path[up] != i and belongs(i, up)
        else:
            taken[i] = taken[up] and stays(i)
    for i in whole:
        taken[i] = True  # text right in an article or main element
    blocks: dict[int, list[str]] = {}
    for node, block, text in tree.pieces:
        if taken[node]:
            blocks.setdefault(block, []).append(text)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""

    def factory():
        def run(columns):
            texts = [main_text(x) for x in columns[2]]
            return {"page_id": columns[0], "url": columns[1], "text": texts, "n_chars": list(map(len, texts))}

        return run

    return map_slices(pages.select(F.col("page_id").cast("long"), "url", "html"), "page_id long, url string, text string, n_chars long", factory, 2)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
