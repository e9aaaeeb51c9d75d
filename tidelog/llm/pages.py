"""Main text of web pages, with removal of site templates.

Every page becomes a tree; each block element's subtree gets a hash of its tag, class and content.  Spark counts the pages
of a host that hold a subtree, and subtrees of many pages (at least ``least`` and a ``share`` of the host's pages, or
``enough`` pages of different main text, so on hosts of any size) are deleted from that host's pages before anything else.

Blocks of running text inside an ``article`` or ``main`` element recur for other reasons too: copies and versions of a
text, quoted passages, short sentences by chance.  They are a template only if they also have ``words`` words or more, lie
on ``least`` pages of different main text, and hardly (``elsewhere`` of their pages) on any other host.

What is left is judged block by block: elements, classes and roles of page furniture go, and so do blocks of links.  A
``main`` element holds all of the main text, by its definition; where a page only has articles, paragraphs, headings and the
like outside of them stay too.  A form that holds an article or most of the page's paragraphs is no furniture.

The counts hold one small row for each subtree of a page; what recurs is broadcast up to ``most`` rows and joined to the
pages beyond.

A null or empty page has the text ''; a null url is a host of its own; rows of equal ids stay apart; an unclosed element
ends with its parent; bytes after the last tag count as text; columns of other names are ignored; an empty table gives an
empty result.  Pages are read in linear time, whatever is in them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

# Fixed values of HTML: element names by how they nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends open elements of these names, up to the nearest holder.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
HOLDERS = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())
# What is page furniture by element, class or id word, and role.
FURNITURE = frozenset("aside button dialog footer head iframe input menu nav noembed noframes noscript object script select style svg template textarea title xmp".split())
NAMES = frozenset("ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr login mainnav masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related respond reply replies search share sharing sidebar signup social sponsor sponsored subnav subscribe subscription toolbar topbar topnav widget widgets".split())
#: What other words a class or id of furniture may hold: "site-footer" is one, "market-share" isn't.
BESIDES = frozenset("area bar block bottom box button buttons col column container content fixed global group header home icon icons inner item items left link links list main mobile module outer page panel primary right secondary section site slot small sticky sub top unit wrap wrapper".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption li dt dd td th tr table ul ol dl".split())

#: Blocks that stay outside of an article.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption dl dt dd table tr td th".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass(frozen=True)
class Rule:
    least: int = 8
    share: float = 0.05
    enough: int = 200
    words: int = 3
    elsewhere: float = 0.01
    most: int = 2_000_000


class Node:
    """letters: of its text; linked: of those in links; links; prose: letters in paragraphs and headings; holds: whether an
    article or main element is below.  All but the first three are set by :func:`weigh` and :func:`hashed`."""

    __slots__ = ("tag", "attrs", "children", "hash", "parent", "letters", "linked", "links", "prose", "holds", "words")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.hash = self.letters = self.linked = self.links = self.prose = self.words = 0
        self.holds = False


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, kind ('', '/' or '!'), name and attributes of each tag, comment and declaration, in linear time.

    A consumer may send a place from which to go on."""
    at, end, strict = 0, len(page), True
    last = {q: page.rfind(q) for q in "\"'"}
    close = page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        at = start + 1
        sign = page[at : at + 1]
        if sign in ("!", "?"):
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                stop = end if stop < 0 else stop + 3
                text = ""
            elif page.startswith("<![CDATA[", start):
                stop = page.find("]]>", start + 9)
                text, stop = (page[start + 9 :], end) if stop < 0 else (page[start + 9 : stop], stop + 3)
            else:
                stop = page.find(">", at)
                text, stop = "", end if stop < 0 else stop + 1
            at = (yield start, stop, "!", "", text) or stop
            continue
        closing = sign == "/"
        name = _NAME.match(page, at + closing)
        if name is None or name.end() > close:
            continue
        k, stop = name.end(), -1
        while strict:  # quoted values may hold ">"
            m = _STOP.search(page, k)
            if m is None:
                break
            if m[0] == ">":
                stop = m.start()
                break
            k = page.find(m[0], m.end()) + 1 if m.end() <= last[m[0]] else 0
            if not k:
                break
        if stop < 0:
            strict = False  # a quote is never closed: from here on, tags end with the next ">"
            stop = page.find(">", name.end())
        at = (yield start, stop + 1, "/" if closing else "", name[0].lower(), page[name.end() : stop]) or stop + 1


def parse(page: str) -> Node:
    """The page's tree; text has its character references decoded."""
    root = at = Node("#root", "", None)
    place, end = 0, len(page)
    low = None
    open_: Counter = Counter()  # names of the open elements

    def leave(to: Node) -> Node:
        node = at
        while node is not to:
            open_[node.tag] -= 1
            node = node.parent
        return to

    found, go_on = tags(page), None
    while True:
        try:
            start, stop, kind, tag, attrs = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > place:
            at.children.append(entities.unescape(page[place:start]))
        place = stop
        if kind == "!":
            if attrs:
                at.children.append(attrs)
            continue
        if kind == "/":
            node = root
            if open_[tag] > 0:
                node = at
                while node is not root and node.tag != tag:
                    if tag in INLINE and node.tag not in INLINE:  # a stray end tag of a phrase closes no block
                        node = root
                        break
                    node = node.parent
            if node is not root:
                at = leave(node.parent)
            elif tag in ("p", "br"):
                at.children.append(Node(tag, "", at))
            continue
        over = {"p"} if tag in CLOSES_P else ENDS.get(tag)
        if over and any(open_[t] > 0 for t in over):
            node, found_at = at, None
            while node is not root and (node.tag not in HOLDERS or node.tag in over):
                if node.tag in over:
                    found_at = node
                node = node.parent
            if found_at is not None:
                at = leave(found_at.parent)
        node = Node(tag, attrs, at)
        at.children.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in HOLDERS and tag not in RAW and tag not in INLINE and tag not in TEXT_BLOCKS:
            continue
        if tag in RAW:
            low = page.lower() if low is None else low
            stop = low.find(f"</{tag}", place) if len(low) == end else page.find(f"</{tag}", place)
            stop = end if stop < 0 else stop
            node.children.append(page[place:stop])
            place = go_on = page.find(">", stop) + 1 or end
        else:
            at = node
            open_[tag] += 1
    if place < end:
        at.children.append(entities.unescape(page[place:]))
    return root


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in _ATTRIBUTE.finditer(text)}


def _downwards(root: Node) -> list[Node]:
    """All nodes, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if not isinstance(c, str)]
    return order


def hashed(root: Node) -> Iterator[Node]:
    """Hashes subtrees bottom-up and gives every block element but the root, html and body."""
    for node in reversed(_downwards(root)):
        kinds = attributes(node.attrs) if node.attrs else {}
        parts = [node.tag, kinds.get("class", ""), kinds.get("id", "")]
        parts += [" ".join(c.split()) if isinstance(c, str) else f"\0{c.hash:x}" for c in node.children]
        node.hash = xxhash.xxh3_64_intdigest("\1".join(p for p in parts)) >> 1
        node.words = sum(len(c.split()) if isinstance(c, str) else c.words for c in node.children)
        if node.tag not in INLINE and node.tag not in VOID and node.tag not in ("#root", "html", "head", "body", "article", "main") and node.children:
            yield node


def weigh(root: Node) -> None:
    for node in reversed(_downwards(root)):
        if node.tag in RAW:
            continue
        for c in node.children:
            if isinstance(c, str):
                node.letters += len(c.replace(" ", ""))
            else:
                node.letters, node.linked, node.links, node.prose = node.letters + c.letters, node.linked + c.linked, node.links + c.links, node.prose + c.prose
                node.holds = node.holds or c.holds or _is_main(c)
        if node.tag == "a":
            node.linked, node.links = node.letters, 1
        elif node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            node.prose = node.letters


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or "main" in node.attrs and attributes(node.attrs).get("role") == "main"


def host_of(url: str | None) -> int:
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2]
    return xxhash.xxh3_64_intdigest(host) >> 1


def _named(kinds: dict[str, str]) -> bool:
    """Whether a class or id is that of furniture: words of NAMES, and at most such of BESIDES or numbers between them."""
    for token in f"{kinds.get('class', '')} {kinds.get('id', '')}".split():
        words = [w for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if not w.isdigit()]
        if any(w in NAMES for w in words) and all(w in NAMES or w in BESIDES or any(c.isdigit() for c in w) for w in words):
            return True
    return False


def furniture(node: Node, inside: bool, prose: int) -> bool:
    """inside: within an article or main element; prose: letters in paragraphs and headings of the page."""
    if node.tag in FURNITURE or node.tag == "header" and not inside:
        return True
    if node.tag == "form" and not node.holds and not (prose and 2 * node.prose > prose):
        return True
    if node.tag not in INLINE and node.links >= 3 and 4 * node.linked >= 3 * node.letters and node.tag not in ("#root", "html", "body", "article", "main"):
        return True
    if not node.attrs:
        return False
    kinds = attributes(node.attrs)
    if "hidden" in kinds or kinds.get("aria-hidden") == "true" or _HIDDEN.search(kinds.get("style", "")):
        return True
    role = kinds.get("role", "").lower()
    if role in ROLES:
        return True
    if node.tag in ("html", "body", "article", "main") or role == "main":
        return bool({"comment", "comments", "reply"} & set(_WORD.findall(kinds.get("class", "").lower()))) and node.tag == "article"
    if node.holds:
        return False
    return _named(kinds) or not inside and "header" in _WORD.findall(f"{kinds.get('class', '')} {kinds.get('id', '')}".lower())


def main_text(root: Node, recurring=frozenset(), in_articles=frozenset()) -> str:
    """Text blocks of the page in order, joined by one space, without ``recurring`` subtrees and, of text blocks of
    articles, those ``in_articles``; :func:`weigh` must have been here, and :func:`hashed` if there are any."""

    def gone(node: Node, inside: bool) -> bool:
        return node.hash in (in_articles if inside and node.tag in TEXT_BLOCKS else recurring) or furniture(node, inside, root.prose)

    kinds: set[str] = set()
    todo = [root] if root.holds else []
    while todo:
        for c in todo.pop().children:
            if not isinstance(c, str) and (c.holds or _is_main(c)) and not gone(c, False):
                if _is_main(c):
                    kinds.add("article" if c.tag == "article" else "main")
                if c.tag != "article":
                    todo.append(c)
    beside = PROSE if "main" not in kinds else frozenset()
    out: list[str] = []
    # inside an article; in a block that stays
    rest: list[tuple[Node | str, bool, bool]] = [(root, False, not kinds)]
    while rest:
        node, inside, stays = rest.pop()
        if isinstance(node, str):
            if stays:
                out.append(node)
        elif not gone(node, inside):
            inside = inside or _is_main(node)
            if node.tag not in INLINE:
                stays = not kinds or inside or node.tag in beside
                out.append(" ")
                rest.append((" ", True, True))
            rest += [(c, inside, stays) for c in reversed(node.children)]
    return " ".join("".join(out).split())


def _tree(page: str | None) -> Node:
    root = parse(page or "")
    weigh(root)
    return root


def _found(root: Node, words: int) -> set[tuple[int, bool]]:
    """The subtrees of a page, and whether they are text blocks of at least ``words`` words inside an article."""
    out: set[tuple[int, bool]] = set()
    nodes = list(hashed(root))
    inside: dict[int, bool] = {}
    for node in _downwards(root):
        inside[id(node)] = _is_main(node) or node.parent is not None and inside[id(node.parent)]
    for node in nodes:
        if not (inside[id(node.parent)] and node.tag in TEXT_BLOCKS):
            out.add((node.hash, False))
        elif node.words >= words:
            out.add((node.hash, True))
    return out


def subtree_counts(pages: DataFrame, url: str = "url", page: str = "html", rule: Rule = Rule()) -> DataFrame:
    """host, subtree, inside, pages, contents: on how many of the host's pages, and of their different main texts, each
    subtree is, apart by whether it is a text block inside an article; subtree 0 counts the pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes, insides, texts = [], [], [], []
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = _tree(h)
                mine = _found(root, rule.words) | {(0, False)}
                hashes += [m[0] for m in mine]
                insides += [m[1] for m in mine]
                hosts += [host_of(u)] * len(mine)
                texts += [xxhash.xxh3_64_intdigest(main_text(root)) >> 1] * len(mine)
            columns = (pa.array(hosts, pa.int64()), pa.array(hashes, pa.int64()), pa.array(insides, pa.bool_()), pa.array(texts, pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns), names=["host", "subtree", "inside", "content"])

    found = frames.in_batches(pages).select(url, page).mapInArrow(run, "host bigint, subtree bigint, inside boolean, content bigint")
    once = found.groupBy("host", "subtree", "inside", "content").agg(F.count("*").alias("n"))
    return once.groupBy("host", "subtree", "inside").agg(F.sum("n").alias("pages"), F.count("*").alias("contents"))


def recurring(pages: DataFrame, rule: Rule = Rule(), url: str = "url", page: str = "html") -> DataFrame:
    """host, subtree, inside of what recurs on many pages of a host."""
    counts = frames.written(subtree_counts(pages, url, page, rule))
    hosts = counts.where("subtree = 0").select("host", F.col("pages").alias("of"))
    often = F.col("pages") >= rule.least
    many = (F.col("pages") >= rule.share * F.col("of")) | (F.col("contents") >= rule.enough)
    found = frames.join_small(counts.where(often & (F.col("subtree") != 0)), hosts, ["host"], "inner").where(many)
    outside = found.where("not inside").select("host", "subtree", "inside")
    mine = found.where(F.col("inside") & (F.col("contents") >= rule.least))
    everywhere = counts.where("inside").join(mine.select("subtree").distinct(), "subtree", "left_semi").groupBy("subtree").agg(F.sum("pages").alias("all"))
    own = mine.join(everywhere, "subtree").where(F.col("all") - F.col("pages") <= rule.elsewhere * F.col("pages"))
    return outside.unionByName(own.select("host", "subtree", "inside"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", rule: Rule = Rule()) -> DataFrame:
    """key, url, text and n_chars of every page."""
    found = frames.written(recurring(pages, rule, url, page))
    small = frames.small_enough(found, rule.most)
    spark = pages.sparkSession
    known = None
    source = pages.select(F.col(key), F.col(url), F.col(page).alias("_page"))
    if small:
        by_host: dict[int, list[int]] = {}
        signed = F.when(F.col("inside"), -F.col("subtree")).otherwise(F.col("subtree"))  # subtrees are positive
        for r in found.groupBy("host").agg(F.collect_list(signed).alias("s")).toLocalIterator():
            by_host[r.host] = r.s
        known = spark.sparkContext.broadcast({h: np.unique(np.array(s, np.int64)) for h, s in by_host.items()})
    else:  # each page's own subtrees that recur, by a join on host and subtree
        source = source.withColumn("_row", F.xxhash64(key, url, "_page"))
        mine = found.join(_page_subtrees(source, url, rule), ["host", "subtree", "inside"])
        mine = mine.groupBy("_row").agg(F.collect_set(F.when(F.col("inside"), -F.col("subtree")).otherwise(F.col("subtree"))).alias("_gone"))
        source = source.join(mine, "_row", "left").drop("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, tuple[frozenset, frozenset]] = {}

        def parted(subtrees) -> tuple[frozenset, frozenset]:
            return frozenset(s for s in subtrees if s > 0), frozenset(-s for s in subtrees if s < 0)

        for batch in batches:
            texts = []
            for k, (u, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if known is not None:
                    host = host_of(u)
                    if host not in cache:
                        if len(cache) > 1000:
                            cache.clear()
                        cache[host] = parted(known.value.get(host, np.zeros(0, np.int64)).tolist())
                    gone = cache[host]
                else:
                    gone = parted(batch.column(3)[k].as_py() or ())
                root = _tree(h)
                if gone[0] or gone[1]:
                    for _ in hashed(root):
                        pass
                texts.append(main_text(root, *gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    kinds = dict(pages.select(key, url).dtypes)
    return frames.in_batches(source).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")


def _page_subtrees(source: DataFrame, url: str, rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row, host_of(u), *s) for row, u, h in zip(*(c.to_pylist() for c in batch.columns)) for s in _found(_tree(h), rule.words)]
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["_row", "host", "subtree", "inside"])

    return frames.in_batches(source).select("_row", url, "_page").mapInArrow(run, "_row bigint, host bigint, subtree bigint, inside boolean").distinct()
