"""Main text of web pages by composite text density.

A page becomes a tree: tags that HTML closes implicitly are closed (a new block ends an open paragraph, a list item ends the last one,
formatting left open ends with its block), raw text of scripts and styles is kept apart, character references are decoded.
Parts that are not the article are set aside: elements that by tag hold no article text (scripts, styles, forms, navigation, site
headers and footers, asides ...), and elements whose class, id or role names an advert, menu, notice, sidebar, sharing bar or
comments: by a whole class (`left-sidebar`), not by a part of one that says something else (`with-sidebar`). What wraps the page is not set
aside, whatever its tag or name (`settle`).

For every other node, with c characters, t tags, lc characters and lt tags in links in its subtree, the composite text density is
characters per tag times the logarithm of (c / lc) * (t / lt), to a base that grows with the links' part of the text (`density`).
A node's score is the sum of the densities of its children, where formatting inside a block is part of the block's own text. The threshold is the
least density on the path from the body to the densest node. The node of the highest score among those at or above the threshold is chosen; it
grows to an ancestor that has further children at or above the threshold (sections of one text), but not beyond an `article` or `main`. If it has no
heading, the last one before it among its siblings and its ancestors' siblings belongs to it. Ties go to the node that begins first.
Blocks of text are joined in page order by one space, white space inside a block is one space.

Nulls: null or empty html gives an empty text. Pages without markup are one block. Deep nesting is handled without recursion and in linear time; very long
pages are read whole. Broken declarations are comments. Repeated rows are extracted each; null ids and urls stay. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.llm.runtime import table

# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NOT_TEXT = frozenset("script style noscript template svg math canvas object iframe audio video head title select textarea".split())
NOT_ARTICLE = frozenset("nav footer aside form menu button dialog fieldset input".split())
IN_LINES = frozenset("button input".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl select div section article main body html".split())
# Classes, ids and roles that name what is not the article: one of the names, alone or with other names and words of place or form.
READERS = r"comments?|commentlist|disqus|replies|respond"
NAMES = (
    rf"ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|{READERS}|consent|contentinfo|cookies?|disclaimer|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|navigationmenu|newsletter|notice|notification"
    r"|pager|pagination|popup|promo|promoted|promotion|related|share|sharing|sidebar|site-header|skip|social|sponsor|sponsored|subscribe|toolbar|widget"
)
PLACES = (
    r"\d+|all|area|articles?|author|bar|body|bottom|box|block|buttons?|center|col|column|container|content|desktop|entry|footer|form|global|google|group|header|icons?|inner|inline|items?|label|left|links?|list|main|media|meta|mobile"
    r"|module|news|outer|overlay|page|panel|policy|posts?|primary|right|row|secondary|section|site|slot|small|sticky|stories|story|sub|text|thread|title|to|top|unit|user|wrap|wrapper|zone"
)
NOT_ARTICLE_NAME = re.compile(rf"(?:(?:{PLACES})[_-]+)*(?:{NAMES})(?:[_-]+(?:{NAMES}|{PLACES}))*", re.IGNORECASE)
READERS_NAME = re.compile(rf"(?:^|[\s_-])(?:{READERS})(?:$|[\s_-])", re.IGNORECASE)
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
NEVER, BY_TAG, BY_NAME, OF_READERS = 1, 2, 3, 4  # why an element is set aside
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "why", "aside", "chars", "tags", "link_chars", "link_tags", "density", "score")

    def __init__(self, tag: str, parent: Node | None, why: int):
        """why: its own reason to be set aside, 0 if none; `settle` decides."""
        self.tag, self.parent, self.why, self.aside = tag, parent, why, False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.score = 0.0


class Tree(HTMLParser):
    """Builds the tree; `order` lists the nodes, parents first. `depths` has the depths of a tag's open elements, `blocks` those of all that are not inline,
    so that no tag walks up the page; an element is left once."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None, 0)
        self.order, self.stack = [self.root], [self.root]
        self.depths: dict[str, list[int]] = {}
        self.blocks = [0]

    @property
    def open(self) -> Node:
        return self.stack[-1]

    def _enter(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def _leave(self, depth: int) -> None:
        """Ends the open element at this depth, and all in it."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.depths[node.tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def _innermost(self, tags) -> int:
        """Depth of the innermost open element of `tags`, 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def parse_marked_section(self, i, report=1):
        """A marked section (CDATA, conditional, or an unknown one) is a comment up to the next >, as in browsers."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(n.tag == tag for n in self.order[:8]):
            return
        if tag == "head" and self.open is not self.root:
            return
        if tag not in IN_HEAD:
            self._end_head()
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, stop=SCOPE)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], stop=SCOPE)
        node = Node(tag, self.open, self._why(tag, attrs))
        self.open.children.append(node)
        self.order.append(node)
        if tag not in VOID:
            self._enter(node)

    def _why(self, tag, attrs):
        if tag in NOT_TEXT:
            return NEVER
        if tag in NOT_ARTICLE or (tag == "header" and not self._innermost(["article", "main"])):
            return BY_TAG
        if tag in ("html", "body", "article", "main"):
            return 0
        why = 0
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                why = why or BY_NAME
            elif k in ("class", "id", "role") and v and any(NOT_ARTICLE_NAME.fullmatch(x) for x in v.split()):
                why = OF_READERS if READERS_NAME.search(v) else why or BY_NAME
        return why

    def _end_head(self):
        """What may not stand in a head ends an open one."""
        depth = self._innermost(["head"])
        if depth and all(n.tag == "noscript" for n in self.stack[depth + 1 :]):
            self._leave(depth)

    def _close(self, tags, stop):
        """End the innermost open element of `tags`, and all in it, unless an element of `stop` is open inside."""
        depth = self._innermost(tags)
        if depth > self._innermost(stop):
            self._leave(depth)

    def handle_endtag(self, tag):
        depth = self._innermost([tag])
        if depth and not (tag in INLINE and self.blocks[-1] > depth):  # a stray end of formatting doesn't end blocks
            self._leave(depth)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.open.tag == "head" and data.strip():
            self._end_head()
        self.open.children.append(data)


def settle(tree: Tree) -> None:
    """Decides which nodes are set aside: those with a reason, and all in them, unless that would take the page itself.

    A reason doesn't count for an element that holds the page's `main`; nor, if every `article` and `main` would be set aside, for one that
    holds an article or more than half of the body's text outside links. Elements of readers' comments, and asides, footers and menus around
    articles (teasers), are no such wrappers of articles. Scripts and the like never hold text.
    """
    if any(n.why > NEVER for n in tree.order):
        _lift(tree)
    for n in tree.order:
        n.aside = n.why > 0 or (n.parent is not None and n.parent.aside)


def _lift(tree: Tree) -> None:
    never, linked, inside, plain = set(), set(), set(), {}
    for n in tree.order:  # parents first
        up = n.parent
        if n.why == NEVER or up in never:
            never.add(n)
        if n.tag == "a" or up in linked:
            linked.add(n)
        if n.why > NEVER or up in inside:
            inside.add(n)
        plain[n] = 0 if n in never or n in linked else sum(len(x.strip()) for x in n.children if isinstance(x, str))
    for n in reversed(tree.order):
        if n.parent:
            plain[n.parent] += plain[n]
    marks = [n for n in tree.order if n.tag in ("article", "main") and n not in never]
    marked = any(n not in inside for n in marks)
    around: dict[Node, str] = {}
    for n in marks:
        up = n.parent
        while up and around.get(up) not in (n.tag, "main"):
            around[up] = n.tag
            up = up.parent
    for n in tree.order:
        if n.why in (BY_TAG, BY_NAME) and (
            around.get(n) == "main"
            or not marked
            and (around.get(n) == "article" and n.tag not in ("aside", "footer", "nav", "menu") or 2 * plain[n] > plain[tree.root])
        ):
            n.why = 0


def measure(tree: Tree) -> None:
    """Counts, densities and scores of all nodes that are not set aside."""
    live = [n for n in tree.order if not n.aside]
    for n in live:
        n.chars += sum(len(SPACES.sub(" ", x).strip()) for x in n.children if isinstance(x, str))
    for n in reversed(live):
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if n.parent:
            up = n.parent
            up.chars += n.chars
            up.tags += n.tags + 1
            up.link_chars += n.link_chars
            up.link_tags += n.link_tags
    body = tree.root
    share = body.link_chars / max(body.chars, 1)
    for n in live:
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        if n.parent and n.tag not in INLINE:
            n.parent.score += n.density


def density(c: int, t: int, lc: int, lt: int, body_share: float) -> float:
    """Characters per tag, adjusted for links: the logarithm's argument falls, and its base grows, with the part that links take."""
    if not c:
        return 0.0
    t = max(t, 1)
    plain = max(c - lc, 1)
    base = math.log(c / plain * lc + body_share * c + math.e)
    return c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / max(math.log(base + math.e - 1), 1.0)


def main_part(tree: Tree) -> list[Node]:
    """The chosen node, after its heading if that is outside."""
    live = [n for n in tree.order if not n.aside and n.tag not in INLINE]
    densest = max(live, key=lambda n: n.density)
    threshold, node = densest.density, densest
    while node:
        if node.density > 0:
            threshold = min(threshold, node.density)
        node = node.parent
    best = node = max((n for n in live if n.density >= threshold), key=lambda n: n.score, default=tree.root)
    while node.parent and node.tag not in ("article", "main"):
        if any(x is not node and x.chars and x.density >= threshold for x in parts_of(node.parent) if x.tag not in HEADINGS):
            best = node.parent
        node = node.parent
    return [*heading_before(best), best]


def parts_of(node: Node) -> list[Node]:
    """Its child blocks that are not set aside."""
    return [x for x in node.children if isinstance(x, Node) and not x.aside and x.tag not in INLINE]


def heading_before(best: Node) -> list[Node]:
    """The nearest first- or second-level heading before a node that has none."""
    stack = [best]
    while stack:
        n = stack.pop()
        if n.tag in ("h1", "h2"):
            return []
        stack.extend(parts_of(n))
    node = best
    while node.parent:
        beside = parts_of(node.parent)
        for x in reversed(beside[: beside.index(node)] if node in beside else []):
            if x.tag in ("h1", "h2"):
                return [x]
        node = node.parent
    return []


def blocks(part: Node) -> list[str]:
    """Texts of the blocks of a subtree, in page order, without what is set aside."""
    out, run, stack = [], [], [iter(part.children)]
    ends: list[bool] = [True]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            elif x.tag not in VOID and not x.aside:
                block = x.tag not in INLINE
                if block:
                    out.append("".join(run))
                    run = []
                stack.append(iter(x.children))
                ends.append(block)
                break
            elif x.tag == "hr" or (x.aside and x.tag not in INLINE and x.tag not in NOT_TEXT and x.tag not in IN_LINES):  # a script in a word leaves it whole
                out.append("".join(run))
                run = []
        else:
            stack.pop()
            if ends.pop():
                out.append("".join(run))
                run = []
    return [t for x in out if (t := SPACES.sub(" ", x).strip())]


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    tree = Tree()
    try:
        tree.feed(html)
        tree.close()
    except (AssertionError, ValueError, IndexError):  # the parser gave up on broken markup; what it has read so far counts, the rest is text
        tree.handle_data(re.sub(r"<[^<>]*>", " ", tree.rawdata))
    settle(tree)
    measure(tree)
    return " ".join(text for part in main_part(tree) for text in blocks(part))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text of every page."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([extract(x) for x in batch.column(2).to_pylist()], pa.string())], ["key", "url", "text"])

    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, "key long, url string, text string")


def op3_text_density(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return main_text(table(spark, sf_dir, "pages")).select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
