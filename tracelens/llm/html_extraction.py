"""HTML main text by consensus paths of each host.

1. Each page is parsed into blocks of text under a tree of containers. A container's score is the text of its blocks, less what is
   in links: a block counts in full for its own container and by half less for each container further up; boilerplate
   (navigation, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) counts for nothing.
2. Containers vote: scores are summed in Spark for each host and generalised path (tags with their classes, digits made ``#``); the
   highest sum wins the host.
3. Each page is read again: the blocks under containers on the host's winning path are its text; a page that has none, or none
   with text, takes its own best container, and a page without containers all its blocks that are not boilerplate. From the winning container
   the page's reader climbs to the one around it as long as what that adds is mostly text without links, so that a headline, a lead or a
   second section beside the longest part stay; it stops at an article or main element and below the body.

Tags are found by one scan from left to right, and no step looks back over the page or up the whole tree, so that a page takes time in proportion to its
length however its quotes, elements and nesting are left open. A script or style that is never closed runs to the end; other elements
whose content is no text (object, noscript, iframe and the like) are passed over only if they are closed.

A block ends at a block tag or a line break. Character references are decoded, runs of white space become one space.

Edge cases: a null or empty page has the empty text. Pages whose url is null or has no host vote together. Equal sums go to the
smaller path. Repeated rows each get a row and a vote. An empty table gives no rows. All columns are kept; a column named like a
result gives way to it. A host that holds many of the pages does not end in one task (see ``extract``).
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import cut, over, small_batches

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""[^<>"']*""")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "iframe", "object", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center"}
_BLOCKS = _CONTAINERS | set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr th caption nav header footer aside form fieldset figure figcaption address details summary hr br head dialog menu select option button legend".split())
_BAD_TAGS = {"nav", "header", "footer", "aside", "form", "head", "dialog", "menu", "select", "button", "svg", "canvas", "video", "audio", "fieldset"}
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Words in class or id that mark boilerplate.
_BAD_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription "
    "newsletter signup signin login sidebar sidenav aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments commentlist adslot adbox adsbygoogle sharebar reply replies disqus respond "
    "share sharing social related recommended recommendations widget widgets search form hidden skip paywall".split()
)
_LEFT_OPEN = {"head", "nav", "header", "menu", "select", "button"}
#: Elements that a tag of the same kind ends.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}, "p": _CONTAINERS | {"li", "blockquote"}, "option": {"select"}}


@dataclass
class Node:
    """A container or boilerplate element."""

    tag: str
    path: str
    up: Node | None
    bad: bool
    weight: float = 1.0
    score: float = 0.0

    def __post_init__(self) -> None:
        self.buried = self.bad or (self.up is not None and self.up.buried)  # in boilerplate, itself or further up


@dataclass
class Page:
    """Blocks in page order as (text, node, code points of text that count for it), and the containers, outer ones first."""

    blocks: list[tuple[str, Node, int]] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)


def _boilerplate(tag: str, attributes: dict[str, str]) -> bool:
    if tag in _BAD_TAGS or attributes.get("role", "").lower() in _BAD_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return any(map(_bad_name, f"{attributes.get('class', '')} {attributes.get('id', '')}".split()))


def _bad_name(name: str) -> bool:
    """Whether a class or id names boilerplate: by its first word, or by its last one unless it says with or without which the element is."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    return bool(words) and (words[0] in _BAD_WORDS or words[-1] in _BAD_WORDS and (len(words) < 2 or words[-2] not in ("with", "has", "no", "without")))


class Tags:
    """The tags of a page from left to right. What is once not found behind a place is not looked for again."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.absent: set[str] = set()

    def find(self, text: str, at: int) -> int:
        """Place of ``text`` from ``at`` on, or -1; calls go from left to right."""
        if text in self.absent:
            return -1
        found = self.source.find(text, at)
        if found < 0:
            self.absent.add(text)
        return found

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag: quotes may hold one; where they are left open or a ``<`` comes first, the next ``>``."""
        source, i = self.source, at
        while True:
            i = _PLAIN.match(source, i).end()
            if i >= len(source) or source[i] == "<":
                break
            if source[i] == ">":
                return i
            close = self.find(source[i], i + 1)
            if close < 0:
                break
            i = close + 1
        return self.find(">", at)

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the next tag, name empty for comments and declarations; None at the end."""
        source = self.source
        while (start := self.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                close = self.find("-->", start + 4)
                return start, len(source) if close < 0 else close + 3, False, "", ""
            if source[start + 1 : start + 2] in ("!", "?"):
                close = self.find(">", start)
                if close >= 0:
                    return start, close + 1, False, "", ""
            elif m := _NAME.match(source, start + 1):
                close = self.end(m.end())
                if close >= 0:
                    return start, close + 1, bool(m[1]), m[2].lower(), source[m.end() : close]
            at = start + 1
        return None


def _path(parent: str, name: str) -> str:
    """Path of a container; the upper part of a very long one is a hash."""
    return f"{parent if len(parent) <= 512 else '#' + xxhash.xxh64_hexdigest(parent)}>{name}"


def parse(source: str | None) -> Page:
    """Blocks and containers of a page."""
    page, root = Page(), Node("", "", None, False)
    stack: list[tuple[str, Node]] = [("", root)]
    text: list[str] = []
    linked, in_link, at = 0, 0, 0
    source = source or ""
    unclosed: set[str] = set()

    tags, held = Tags(source), Counter()  # how often each tag is on the stack

    def cut_back(to: int) -> None:
        for t, _ in stack[to:]:
            held[t] -= 1
        del stack[to:]

    def flush() -> None:
        nonlocal linked
        whole = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if whole:
            node = stack[-1][1]
            worth = max(0, len(whole) - 2 * linked)
            page.blocks.append((whole, node, worth))
            up = None if node.buried else node
            while up is not None and worth >= 1e-3:
                up.score += worth
                worth, up = worth / 2, up.up
        linked = 0

    while at < len(source):
        found = tags.next(at)
        piece = source[at : found[0]] if found else source[at:]
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece)
        if not found:
            break
        _, at, closing, tag, rest = found
        if not tag:
            continue
        if tag in _BLOCKS:
            flush()
        if tag == "a":
            in_link = 0 if closing else 1
        if closing:
            if held[tag] > 0:
                cut_back(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in _RAW:
            end = None if tag in unclosed else re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(source, at)
            if end:
                at = end.end()
            else:
                unclosed.add(tag)
                at = len(source) if tag in ("script", "style") else at
            continue
        if tag in _VOID or (tag not in _BLOCKS and tag not in _BAD_TAGS):
            continue
        if tag in ("body", "main", "article"):  # ends what cannot hold it and was left open
            if any(held[t] > 0 for t in _LEFT_OPEN):
                cut_back(next(i for i, (t, _) in enumerate(stack) if t in _LEFT_OPEN))
        if tag in _CLOSES and any(held[t] > 0 for t in _CLOSES[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _CLOSES[tag]:
                    cut_back(i)
                    break
                if stack[i][0] in _FENCE[tag]:
                    break
        elif tag not in _CLOSES and any(s[0] == "p" for s in stack[-2:]):
            while len(stack) > 1 and stack[-1][0] == "p":
                cut_back(len(stack) - 1)
        attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(rest)} if rest.strip() else {}
        parent, bad = stack[-1][1], _boilerplate(tag, attributes)
        if bad or tag in _CONTAINERS:
            name = ".".join([tag, *sorted(re.sub(r"\d+", "#", attributes.get("class", "")).split())])
            node = Node(tag, _path(parent.path, name), parent, bad, {"article": 2.0, "main": 1.5, "body": 0.8, "html": 0.4}.get(tag, 1.0))
            page.nodes.append(node)
        else:
            node = parent
        stack.append((tag, node))
        held[tag] += 1
    flush()
    return page


def votes(page: Page) -> dict[str, float]:
    """Score of each container path of a page."""
    out: dict[str, float] = {}
    for n in page.nodes:
        if n.score > 0 and n.tag in _CONTAINERS and not n.buried:
            out[n.path] = out.get(n.path, 0.0) + n.score * n.weight
    return out


def _climbed(page: Page, tops: set[int]) -> set[int]:
    """Containers (by place in the page's list) around the winning ones, as far up as what they add is mostly text without links."""
    place = {id(n): i for i, n in enumerate(page.nodes)}
    whole, free = [0] * len(page.nodes), [0] * len(page.nodes)  # code points below each container, and those that count
    for text, node, worth in page.blocks:
        if not node.buried and id(node) in place:
            whole[place[id(node)]] += len(text)
            free[place[id(node)]] += worth
    up = [place.get(id(n.up), -1) for n in page.nodes]
    for i in range(len(page.nodes) - 1, -1, -1):  # inner ones come later
        if up[i] >= 0:
            whole[up[i]] += whole[i]
            free[up[i]] += free[i]
    out = set()
    for i in tops:
        while page.nodes[i].tag not in ("article", "main") and up[i] >= 0 and i not in out:
            around = page.nodes[up[i]]
            more, counts = whole[up[i]] - whole[i], free[up[i]] - free[i]
            if around.tag in ("body", "html") or around.buried or 2 * counts < more:
                break
            i = up[i]
        out.add(i)
    return out


def under(page: Page, path: str | None) -> list[str]:
    """Blocks, boilerplate left out, that lie under a container with the path, or under what is around it and belongs to it (None: anywhere)."""
    if path is None:
        return [text for text, node, _ in page.blocks if not node.buried]
    tops = _climbed(page, {i for i, n in enumerate(page.nodes) if n.path == path and not n.buried})
    inside: set[int] = set()
    for i, n in enumerate(page.nodes):
        if i in tops or id(n.up) in inside:
            inside.add(id(n))
    return [text for text, node, _ in page.blocks if id(node) in inside and not node.buried]


def main_text(source: str | None, winner: str | None) -> tuple[str, str]:
    """Main text of a page and the path it came from (empty: the whole page)."""
    page = parse(source)
    if winner and (found := under(page, winner)):
        return "\n".join(found), winner
    own = votes(page)
    best = min(own, key=lambda p: (-own[p], p)) if own else None
    return "\n".join(under(page, best)), best or ""


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", hot_share: int = 10_000) -> DataFrame:
    """``pages`` with text, n_chars and path.

    Winners of hosts with more than one page in ``hot_share`` are broadcast: there are fewer than ``hot_share`` such hosts, whatever the number of pages.
    Their pages then meet no one in the join by host and are dealt evenly; every other host is small.
    """
    small_batches(pages.sparkSession, 500)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[^:/?#]*://([^/?#]*)", 1), F.lit("")))
    per_host = pages.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    n_pages = per_host.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("array<struct<path:string,score:double>>")
    def scored(pages: pd.Series) -> pd.Series:
        return pd.Series([list(votes(parse(p)).items()) for p in pages], dtype=object)

    # Scores are rounded to whole numbers, so that their sums do not depend on the order of tasks.
    cast = pages.select(host.alias("host"), F.explode(scored(F.col(html_col))).alias("v"))
    sums = cast.groupBy("host", F.col("v.path").alias("path")).agg(F.sum(F.round(F.col("v.score") * 8).cast("long")).alias("votes"))
    winners = cut(sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("n"), "path"))["path"].alias("winner")))

    @F.pandas_udf("text string, path string")
    def read(pages: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(p, w) for p, w in zip(pages, paths, strict=True)], columns=["text", "path"])

    hot = winners.join(per_host.where(F.col("n") * hot_share > n_pages), "host").select("host", F.col("winner").alias("hot_winner"))
    paged = pages.select(F.struct("*").alias("row"), host.alias("host")).join(F.broadcast(hot), "host", "left")
    own = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in pages.schema.fields if not re.search("map<|variant", f.dataType.simpleString())])
    key = F.when(F.col("hot_winner").isNotNull(), F.concat(F.lit(" "), own.cast("string"))).otherwise(F.col("host"))
    joined = paged.withColumn("host", key).join(winners, "host", "left").withColumn("winner", F.coalesce("hot_winner", "winner"))
    done = joined.select("row", read(F.col(f"row.`{html_col}`"), "winner").alias("s"))
    return over("row", done, {"text": F.col("s.text"), "n_chars": F.length("s.text").cast("long"), "path": F.col("s.path")})
