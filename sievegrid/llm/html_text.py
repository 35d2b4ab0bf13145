"""Main text of web pages by consensus paths of their hosts.

First pass: every page scores its containers (text outside boilerplate and links) and votes
for the generalised tag-class path of the best; it also names the doubtful parts of that container.
Votes are summed by (host, path), partly in each task, so a host with a third of all pages is no
burden.  Second pass: each page is read again and its text taken from the host's winning path, or from
its own best container where that path holds less than half of what the page has or leaves article blocks
out; a title before an article or main element belongs to it.

Inside the container go: elements that are never text of an article (menus, forms, asides, scripts); adverts and
reader comments by their class or id, and all that follows a heading that announces comments within its element;
outside of article and main elements, boxes whose class or id consists of boilerplate words only.  Inside those
elements such boxes are doubtful, as are boxes whose class merely resembles them ("related-work") anywhere.  A
doubtful box goes where a consensus of the host's pages (half of them, three at least) has it in the same
place, but for boxes that show themselves to be text; these go where the host's pages have the very same words in
them.  A box of boilerplate words shows itself to be text by a main heading, by any heading if it is a header, or by a
block of prose that is not mostly links; a page without a host that speaks for it keeps such boxes and drops the
others.  Boxes that merely resemble boilerplate stay without votes.  Everything else stays, MathML, fallbacks of
objects and noscript included.

Null and empty html give an empty text, as do pages of boilerplate only; a null url counts
as a host of its own; equal votes are settled by text length, then by path; repeated rows
are extracted each; an empty table gives an empty result; texts are never cut; other columns
are never read.  Work grows with the length of a page, however deep it nests.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = frozenset("script style template textarea title xmp iframe noembed noframes svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside base blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li link main menu meta nav noscript object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_DROP = frozenset("nav footer aside form button select fieldset dialog menu head datalist".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSERS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSERS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSERS.items()}
_P = frozenset(("p",)), frozenset(("td", "th", "li", "div", "article", "section", "body"))
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored promo promos promoted promotion sidebar sidebars nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer foot header masthead topbar comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification notifications alert alerts "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended recommendation recommendations teaser teasers widget widgets pagination pager search skip skiplink "
    "toolbar disclaimer copyright paywall".split()
)
# words that with a hint still name the hint's own kind of box
_SHAPES = frozenset("# area bar block blocks body bottom box button buttons card cards column container content count feed form frame group icon icons inner item items left link links list main outer page panel post posts article articles rail reader region right row section sections side site slot slots stories thread top title unit user wrap wrapper".split())
# hints that name what is excluded, wherever it stands
_ALWAYS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored comment comments commentlist disqus respond reply replies".split())
_TITLED = frozenset("header masthead banner banners".split())
_COMMENTS = re.compile(r"\W*(?:\d+\W+)?(?:(?:reader|user) )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?:\W*\d+)?\W*", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SMALL = frozenset("p pre h1 h2 h3 h4 h5 h6 li td th dd dt blockquote".split())
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[a-z]+|#")
ARTICLE_BLOCK = 80  # characters from which a block outside a container is text of the article


@functools.lru_cache(maxsize=4096)
def _described(tag: str, attrs: str) -> tuple[str, bool, int]:
    """The element's name in a path, whether it is no article text, and what its class and id say.

    0: nothing, 1: they resemble boilerplate, 2: they consist of its words, 3: of those of a header.
    """
    name, out, doubt = tag, tag in _DROP, 0
    if attrs.strip():
        a = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attrs)}
        classes = _DIGITS.sub("#", a.get("class", "").lower()).split()
        if classes:
            name += "." + ".".join(sorted(classes)).replace(">", "&gt;")
        if not out and tag not in ("html", "body", "article", "main"):
            tokens = [t for t in (_PARTS.findall(x) for x in [*classes, *_DIGITS.sub("#", a.get("id", "").lower()).split()]) if not _HINTS.isdisjoint(t)]
            named = [t for t in tokens if all(w in _HINTS or w in _SHAPES for w in t)]
            doubt = (3 if any(not _TITLED.isdisjoint(t) for t in named) else 2) if named else 1 if tokens else 0
            out = a.get("role", "").lower() in _ROLES or any(not _ALWAYS.isdisjoint(t) for t in named)
        out = out or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    return name, out, doubt


class _Node:
    __slots__ = ("tag", "path", "parent", "out", "maybe", "doubt", "block", "depth", "at", "last", "good", "article", "title", "prose", "digest")


class Page:
    """The elements of a page and its text blocks in order."""

    def __init__(self, page: str):
        self.names: dict[tuple[int, str], int] = {}
        self.ends: list[int] = []
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.nodes: list[_Node] = []
        self.blocks: list[tuple[_Node, _Node | None, str, int]] = []
        self._open("", "", None)
        self._read(page)
        self._announced()
        for holder, maybe, text, linked in self.blocks:
            holder.good += max(0, len(text) - 2 * linked)
            if maybe is not None:
                own = 2 * linked < len(text)
                maybe.title = maybe.title or own and (holder.tag == "h1" or maybe.doubt == 3 and holder.tag in _HEADINGS)
                maybe.prose = maybe.prose or own and len(text) >= ARTICLE_BLOCK
                maybe.digest = hashlib.md5(text.encode() + (maybe.digest or b"")).digest()
        for node in reversed(self.nodes[1:]):
            node.parent.good += node.good
            node.parent.last = max(node.parent.last, node.last)

    def _open(self, tag: str, attrs: str, parent: _Node | None) -> _Node:
        node = _Node()
        node.tag, node.parent, node.at, node.last, node.good = tag, parent, len(self.nodes), len(self.nodes), 0
        node.doubt, node.title, node.prose, node.digest = 0, False, False, None
        self.nodes.append(node)
        if parent is None:
            node.path, node.out, node.maybe, node.depth, node.block, node.article = 0, False, None, 0, node, False
            return node
        node.depth, node.maybe, node.article = parent.depth + 1, parent.maybe, parent.article or tag in ("article", "main")
        name, out, node.doubt = _described(tag, attrs)
        out = out or parent.out or node.doubt > 1 and not parent.article
        if tag == "header" and not parent.article:  # a page's header; an article may have its own
            out = True
        node.out = out
        node.path = self.names.setdefault((parent.path, name), len(self.steps))
        if node.path == len(self.steps):
            self.steps.append((parent.path, name))
        # a box of boilerplate words is settled apart from what it stands in
        if node.doubt and (node.maybe is None or node.doubt > 1 and node.maybe.doubt == 1):
            node.maybe = node
        node.block = node if tag in _BLOCK else parent.block
        return node

    def _read(self, page: str) -> None:
        stack, parts, opened = [self.nodes[0]], [], Counter()
        linked, at, n = 0, 0, len(page)

        def cut(k: int) -> None:
            for x in stack[k:]:
                opened[x.tag] -= 1
            del stack[k:]

        def close(tags: frozenset[str], within: frozenset[str]) -> None:
            """End the innermost open element of ``tags``, unless one of ``within`` stands in between."""
            if not any(opened[t] for t in tags):
                return
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    cut(k)
                    return
                if stack[k].tag in within:
                    return

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                holder = stack[-1].block
                self.blocks.append((holder, stack[-1].maybe, text, linked))
            linked = 0

        while at < n:
            to = page.find("<", at)
            if to < 0:
                to = n
            if to > at and not stack[-1].out:
                run = html.unescape(page[at:to]) if "&" in page[at:to] else page[at:to]
                parts.append(run)
                if opened["a"]:
                    linked += len(run.strip())
            if to == n:
                break
            at = to
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(page, at) or _LOOSE_TAG.match(page, at)
            if not m:
                if not stack[-1].out:
                    parts.append("<")
                at += 1
                continue
            at, closing, tag = m.end(), m[1], m[2].lower()
            if tag == "br":
                parts.append(" ")
                continue
            block = tag in _BLOCK
            if closing:
                if block:
                    flush()
                if opened[tag]:
                    k = len(stack) - 1
                    while k > 0 and stack[k].tag != tag and (block or stack[k].tag not in _BLOCK):
                        k -= 1
                    if k > 0 and stack[k].tag == tag:  # an inline end tag never ends a block
                        cut(k)
                continue
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                shut = page.find(">", end.end()) if end else -1
                at = n if shut < 0 else shut + 1
                continue
            if block:
                flush()
                if tag in _CLOSES_P:
                    close(*_P)
                elif tag in _CLOSERS:
                    close(*_CLOSERS[tag])
            if tag in _VOID:
                continue
            stack.append(self._open(tag, m[3], stack[-1]))
            opened[tag] += 1
        flush()

    def _announced(self) -> None:
        """Without reader comments: a heading that announces them, and what follows in its element."""
        kept, until = [], -1
        for block in self.blocks:
            holder, text = block[0], block[2]
            if holder.at <= until:
                continue
            if holder.tag in _HEADINGS and len(text) < ARTICLE_BLOCK and _COMMENTS.fullmatch(text):
                around = holder.parent
                end = around
                while end is not None and end.at + 1 == holder.at:  # a heading alone in its box speaks for what follows the box
                    around = end = end.parent
                until = self._ends(around) if around is not None else len(self.nodes)
                continue
            kept.append(block)
        self.blocks = kept

    def _ends(self, node: _Node) -> int:
        """The last element inside ``node``; elements are numbered as they open."""
        if not self.ends:
            self.ends = list(range(len(self.nodes)))
            for x in reversed(self.nodes[1:]):
                self.ends[x.parent.at] = max(self.ends[x.parent.at], self.ends[x.at])
        return self.ends[node.at]

    def path(self, number: int) -> str:
        names = []
        while number > 0:
            number, name = self.steps[number]
            names.append(name)
        return ">".join(reversed(names))

    def number(self, path: str | None) -> int:
        """The number of a path, -1 where the page lacks it."""
        if path is None:
            return -1
        at = 0
        for name in path.split(">") if path else []:
            at = self.names.get((at, name), -1)
            if at < 0:
                return -1
        return at

    def best(self) -> _Node | None:
        """The article or main element with most text, else the deepest element with most of the page's."""
        for tag in ("article", "main"):
            named = [x for x in self.nodes if x.tag == tag and x.good > 0]
            if named:
                return max(named, key=lambda x: x.good)
        total = self.nodes[0].good
        if not total:
            return None
        return max((x for x in self.nodes if x.good >= 0.7 * total and x.tag not in _SMALL and x.block is x), key=lambda x: x.depth)

    def under(self, path: int) -> list[bool]:
        """For every element, whether it or one around it has this path."""
        inside = [False] * len(self.nodes)
        for node in self.nodes:
            inside[node.at] = node.path == path or node.parent is not None and inside[node.parent.at]
        return inside

    def whole(self, node: _Node) -> _Node:
        """The least element around ``node`` that holds all article blocks; an article or main element is whole."""
        if node.tag not in ("article", "main"):
            for holder, _, text, _ in self.blocks:
                while len(text) >= ARTICLE_BLOCK and holder.good > 0 and not node.at <= holder.at <= node.last:
                    node = node.parent
        return node


def _shown(node: _Node) -> bool:
    """Whether a doubtful box shows itself to be text of the article."""
    return node.title or node.doubt > 1 and node.prose


def vote(page: str) -> tuple[str, int, list[str]] | None:
    """The path of the page's best container, its amount of text, and its doubtful parts' paths.

    Parts that show themselves to be text have the digest of their words behind the path.
    """
    read = Page(page)
    node = read.best()
    if node is None:
        return None
    inside = read.under(node.path)
    parts = {(x.path, x.digest if _shown(x) else b"") for _, x, *_ in read.blocks if x is not None and inside[x.at]}
    return read.path(node.path), node.good, sorted(read.path(x) + ("\n" + d.hex() if d else "") for x, d in parts)


def main_text(page: str, path: str | None, furniture: list[str] | None = None) -> str:
    """The text under ``path``, or under the page's own container where ``path`` has too little or is a part of it.

    ``furniture``: paths of doubtful parts that the host's pages agree to be no article text, some with a digest.
    """
    read = Page(page)
    gone = {(read.number(x), d) for x, _, d in (f.partition("\n") for f in furniture or [])}
    lost = [False] * len(read.nodes)
    for node in read.nodes[1:]:
        lost[node.at] = lost[node.parent.at]
        if node.maybe is node:
            shown = _shown(node)
            agreed = (node.path, node.digest.hex() if shown and node.digest else "") in gone
            lost[node.at] = lost[node.at] or agreed or node.doubt > 1 and not shown
    found = [(holder, text, linked) for holder, _, text, linked in read.blocks if not lost[holder.at]]
    own = read.best()
    if own is None:
        return "\n\n".join(x for _, x, _ in found)
    own = read.whole(own)
    mine, at = read.under(own.path), read.number(path)
    inside, holds = mine, own
    if at >= 0 and at != own.path:
        theirs = read.under(at)
        held = sum(len(x) for node, x, _ in found if theirs[node.at])
        articles = lambda flags: sum(len(x) >= ARTICLE_BLOCK and node.good > 0 and flags[node.at] for node, x, _ in found)
        around = at  # is the host's path a part of the page's own container?
        while around > 0 and around != own.path:
            around = read.steps[around][0]
        part = around == own.path and articles(theirs) < articles(mine)
        if not part and 2 * held >= own.good:
            inside, holds = theirs, None
    kept = [i for i, (node, *_) in enumerate(found) if inside[node.at]]
    named = holds is not None and holds.tag in ("article", "main")
    if kept and named and not any(found[i][0].tag == "h1" for i in kept):
        # a title before the article; one that is a link is the site's
        titles = [i for i in range(kept[0]) if found[i][0].tag == "h1" and 2 * found[i][2] < len(found[i][1])]
        kept = titles[-1:] + kept
    return "\n\n".join(found[i][1] for i in kept)


def _host(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes, furniture): each host's winning path, and the parts that its pages agree to be none of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = vote(page.as_py()) if page.is_valid and len(page.as_buffer()) else None
                if found:
                    rows += [(host, found[0], found[1], False), *((host, x, 0, True) for x in found[2])]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["host", "path", "good", "doubt"])

    votes = pages.select(_host(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "host string, path string, good long, doubt boolean")
    # a table, as three steps read it and each would read all pages again
    sums = store.keep(votes.groupBy("host", "path", "doubt").agg(F.count("*").alias("votes"), F.sum("good").alias("good")), "votes")
    hosts = sums.where("NOT doubt").groupBy("host").agg(F.max(F.struct("votes", "good", "path")).alias("w"), F.sum("votes").alias("pages"))
    # a part counts once a page, so twice a page's number of parts bounds what half of the pages agree on
    parts = sums.where("doubt AND votes >= 3").select("host", F.col("path").alias("part"), F.col("votes").alias("n"))
    agreed = parts.join(hosts.select("host", "pages"), "host").where("2 * n >= pages").groupBy("host").agg(F.array_sort(F.collect_list("part")).alias("furniture"))
    return hosts.join(agreed, "host", "left").select("host", "w.path", "w.votes", F.coalesce("furniture", F.array().cast("array<string>")).alias("furniture"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    # kept as a table, so that its size decides between a broadcast and a shuffle
    paths = store.keep(host_paths(pages, url_col, html_col).select("host", "path", "furniture"), "host-paths")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), _host(url_col).alias("host")).join(paths, "host", "left").select("page_id", "url", "html", "path", "furniture")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, p, f) if x else "" for x, p, f in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
