"""Main text of web pages by site template removal.

Every page is parsed into a tree and its block subtrees are hashed.  Spark counts on how many different
pages of a host each hash occurs; a subtree that recurs is template and is deleted.  Outside the article a
tenth of the host's pages make a template; inside it, where licences and quotations recur rightly, three
quarters do.  What a page declares to be no article text (navigation, forms, adverts, comments) goes too; inside the article names of
headings, paragraphs and list items declare nothing, nor does the name of a container that holds most of the text.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import discard, map_rows, materialize, table

#: A subtree is template if it occurs on this many different pages of the host, and on this share of them; one
#: inside the article needs more of both.
LEAST_PAGES, LEAST_SHARE = 5, 0.1
ARTICLE_PAGES, ARTICLE_SHARE = 10, 0.75
#: Most templates (host and hash) that are broadcast, about 100 bytes each.
BROADCAST_ROWS = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas textarea title select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of the first kind, unless one of the second kind is nearer.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
DROP = frozenset("head nav footer aside form button dialog menu input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Whole class names and ids of what is no article text; ``notice-text`` or ``article-header`` is none of them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies cookie-notice cookie-banner consent gdpr notice notices newsletter subscribe signup login"
    " sidebar nav navbar navigation menu breadcrumb breadcrumbs header footer masthead comment comments reply replies disqus_thread share sharing social related popup modal overlay"
    " widget toolbar pagination pager copyright".split()
)
#: Inside the article these alone count, and on containers alone: a heading, paragraph or list item may be named after what it tells.
INSIDE = frozenset("ad ads advert adverts advertisement advertising sponsored comments comment-list disqus_thread".split())
CONTAINERS = frozenset("div section ul ol dl table details".split())
NAME = r"<(/?)([a-zA-Z][^\s/>]*)"
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)()()", re.S)
TOKEN = re.compile(NAME + r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
#: The same for the rest of a page in which a quote is never closed: a tag ends at the next ``>``.
BROKEN = re.compile(NAME + r"([^>]*)>|<[!?/][^>]*>", re.S)
START = re.compile(r"<(?=[a-zA-Z!?/])")
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("attrs", "children", "dead", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.dead = tag, attrs, [], False


class Stack:
    """The open elements; where each tag and each block stands is known without a search."""

    def __init__(self, root: Node):
        self.nodes, self.blocks, self.at = [root], [0], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, *tags: str) -> int:
        """The place of the nearest open element of the tags, 0 if there is none."""
        return max((x[-1] for t in tags if (x := self.at.get(t))), default=0)

    def close(self, i: int) -> None:
        while len(self.nodes) > i:
            self.at[self.nodes.pop().tag].pop()
        while self.blocks[-1] >= i:
            self.blocks.pop()


def parse(page: str) -> Node:
    """A tree of elements and decoded texts.  Broken markup never fails: what is left open ends with
    its parent, a stray end tag counts for nothing, a cut-off tag is dropped.  The steps grow with the length
    of the page alone."""
    root = Node("#root")
    stack = Stack(root)
    at, n = 0, len(page)
    end = page.rfind(">") + 1
    token = TOKEN

    def following(at: int):
        nonlocal token
        while start := START.search(page, at):
            at = start.start()
            if m := COMMENT.match(page, at) or token.match(page, at, end):
                return m
            if at >= end:
                return None
            if token is TOKEN:
                token = BROKEN  # a quote that is never closed
            else:
                at += 1
        return None

    while at < n:
        m = following(at)
        text = page[at : m.start() if m else n]
        if not m and (cut := re.search(r"<(?:[a-zA-Z/!?][^<>]*)\Z", text)):
            text = text[: cut.start()]
        if text:
            stack.nodes[-1].children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            i = stack.last(name)
            if i and (name not in INLINE or i > stack.blocks[-1]):
                stack.close(i)
            continue
        if name in ENDS_P and stack.nodes[stack.blocks[-1]].tag == "p":
            stack.close(stack.blocks[-1])
        if name in ENDS:
            kinds, bar = ENDS[name]
            i = stack.last(*kinds)
            if i and i > stack.last(*bar):
                stack.close(i)
        node = Node(name, m[3])
        stack.nodes[-1].children.append(node)
        if name in RAW and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at, end)
            at = close.end() if close else n
        elif name not in VOID:
            stack.push(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(node.attrs)} if "=" in node.attrs or node.attrs.strip() else {}


def is_marked(node: Node, in_article: bool) -> bool:
    """Whether an element says by itself that it is no article text."""
    if node.tag in RAW or node.tag in DROP or (node.tag == "header" and not in_article):
        return True
    a = attributes(node)
    if not a:
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if node.tag in ("html", "body", "main", "article"):
        return False
    words = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    if in_article:
        return node.tag in CONTAINERS and any(w in INSIDE or w.endswith(("-comments", "_comments")) for w in words)
    return any(w in MARKS or w.endswith(("-comments", "_comments")) for w in words)


def letter_counts(roots: list[Node]) -> dict[int, int]:
    """Code points of the text below each element, by the element's id."""
    out: dict[int, int] = {}
    todo = [(r, False) for r in roots]
    while todo:
        node, back = todo.pop()
        below = [c for c in node.children if isinstance(c, Node)]
        if back:
            out[id(node)] = sum(len(c) for c in node.children if isinstance(c, str)) + sum(out[id(c)] for c in below)
        else:
            todo.append((node, True))
            todo += [(c, False) for c in below]
    return out


def find_roots(root: Node) -> list[Node]:
    """The outermost unmarked articles, or else the main element, or else the whole page."""
    for wanted in ("article", "main"):
        out, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == wanted or (wanted == "main" and "main" in node.attrs and attributes(node).get("role") == "main"):
                out.append(node)
            elif not is_marked(node, False):
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if out:
            return out
    return [root]


def hash_subtrees(root: Node, roots: list[Node]) -> list[tuple[int, Node]]:
    """(hash, element) of every block subtree that may be template: all that don't hold the article or its
    root.  The lowest bit of a hash tells whether the element is inside the article."""
    import xxhash

    article = {id(a) for a in roots} if roots[0] is not root else set()
    out: list[tuple[int, Node]] = []
    done: dict[int, tuple[str, bool]] = {}  # digest of each finished element; whether it is or holds the article
    todo = [(root, False, False)]
    while todo:
        node, back, inside = todo.pop()
        if not back:
            todo.append((node, True, inside))
            within = inside or id(node) in article
            todo += [(c, False, within) for c in node.children if isinstance(c, Node)]
            continue
        parts, holds = [node.tag, " ".join(node.attrs.split())], id(node) in article
        for c in node.children:
            if isinstance(c, Node):
                digest, h = done.pop(id(c))
                parts.append(digest)
                holds = holds or h
            else:
                parts.append(" ".join(c.split()))
        h = xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))
        done[id(node)] = (f"{h:016x}", holds)
        if not holds and node is not root and node.tag not in INLINE and node.tag not in ("html", "body", "head") and node.tag not in RAW and node.tag not in VOID:
            h = h & ~1 | inside
            out.append((h - (1 << 64) if h >= 1 << 63 else h, node))
    return out


def block_texts(roots: list[Node]) -> list[str]:
    """The texts of the blocks in page order, white space folded; deleted and marked subtrees left out."""
    out: list[str] = []
    run: list[str] = []
    own = {id(r) for r in roots}
    sizes: dict[int, int] = {}

    def left_out(x: Node) -> bool:
        """Marked, unless it is only by a name and the element holds most of the text."""
        if not is_marked(x, True):
            return False
        if x.tag not in CONTAINERS or is_marked(Node("p", x.attrs), True):
            return True
        if not sizes:
            sizes.update(letter_counts(roots))
        return 2 * sizes[id(x)] <= sum(sizes[i] for i in own)

    def close():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    for root in roots:
        todo: list = [root]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                run.append(x)
            elif x.dead or (id(x) not in own and left_out(x)):
                if x.tag not in INLINE:
                    close()
            elif x.tag in ("br", "wbr"):
                run.append(" " if x.tag == "br" else "")
            else:
                block = x.tag not in INLINE
                if block:
                    close()
                    todo.append(None)
                todo += reversed(x.children)
        close()
    return out


def main_text(page: str | None, template: frozenset | set = frozenset()) -> str:
    root = parse(page or "")
    roots = find_roots(root)
    if template:
        for h, node in hash_subtrees(root, roots):
            node.dead = h in template
    if roots[0] is root:  # without an article a header is the page's own
        todo = [root]
        while todo:
            node = todo.pop()
            node.dead = node.dead or node.tag == "header"
            todo += [c for c in node.children if isinstance(c, Node)]
    return "\n".join(block_texts(roots))


def page_host(url) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def find_templates(pages: DataFrame, least: int = LEAST_PAGES, share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(subtrees, templates): (page_id, th, host, hs) of each page, th being xxhash64 of the html and hs the hashes of its
    subtrees, and (host, h) of the hashes that occur on ``least`` different pages of a host or more and on
    ``share`` of its different pages or more; ARTICLE_PAGES and ARTICLE_SHARE inside the article.  Copies of a
    page count once.

    Counts are made per (host, hash) over distinct pages, so a host with a third of all pages is
    spread over its hashes."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def rows(batch):
        out = []
        for page_id, th, host, page in batch:
            root = parse(page or "")
            out.append((page_id, th, host, sorted({h for h, _ in hash_subtrees(root, find_roots(root))})))
        return out

    found = map_rows(pages.select("page_id", F.xxhash64("html").alias("th"), page_host(F.col("url")).alias("host"), "html"), rows, f"page_id {kind}, th long, host string, hs array<long>")
    subtrees = materialize(found, "subtrees")
    pages_once = subtrees.select("host", "th", "hs").dropDuplicates(["host", "th"])
    often = pages_once.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("c"))
    hosts = pages_once.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("h").bitwiseAND(1) == 1
    enough = F.when(inside, (F.col("c") >= max(least, ARTICLE_PAGES)) & (F.col("c") >= F.col("n") * ARTICLE_SHARE)).otherwise(F.col("c") >= F.col("n") * share)
    return subtrees, materialize(often.where(F.col("c") >= least).join(hosts, "host").where(enough).select("host", "h"), "templates")


def extract(pages: DataFrame, least: int = LEAST_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars of each page; empty text where there is no article text.

    Up to ``broadcast_rows`` templates are broadcast and no page moves; more are joined to the pages that have
    them.  A null html counts as empty, a null url as a host of its own name.  Rows that repeat a page whole
    give a row each, an empty table none; other columns are not read.  A subtree on exactly the least share of pages is template.  A page is one row however long; markup that
    is broken or nested deep takes no more steps than its length."""
    subtrees, templates = find_templates(pages, least)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    p = pages.select("page_id", "url", "html", F.xxhash64("html").alias("_th"), page_host(F.col("url")).alias("_host"))
    if templates.count() <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for host, h in templates.collect():
            by_host.setdefault(host, set()).add(h)
        discard(subtrees)
        discard(templates)
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def rows(batch):
            known = shared.value
            texts = [main_text(page, known.get(host, ())) for _, _, page, host in batch]
            return [(page_id, url, text, len(text)) for (page_id, url, _, _), text in zip(batch, texts, strict=True)]

        return map_rows(p.select("page_id", "url", "html", "_host"), rows, schema)

    hits = subtrees.select("page_id", "th", "host", F.explode("hs").alias("h")).join(templates, ["host", "h"]).groupBy("page_id", "th", "host").agg(F.collect_set("h").alias("template"))
    hits = hits.select(F.col("page_id").alias("_p"), F.col("th").alias("_t"), F.col("host").alias("_h"), "template")
    # Copies of a page on another host have that host's templates.
    joined = p.join(hits, p["page_id"].eqNullSafe(hits["_p"]) & p["_th"].eqNullSafe(hits["_t"]) & (p["_host"] == hits["_h"]), "left").select("page_id", "url", "html", "template")

    def joined_rows(batch):
        out = []
        for page_id, url, page, template in batch:
            text = main_text(page, set(template or ()))
            out.append((page_id, url, text, len(text)))
        return out

    return map_rows(joined, joined_rows, schema)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
