"""Main text of web pages: site template removal by counting element subtrees per host.

Every element subtree is hashed (tag, class, children, text) together with its page's host. Spark counts in how many
different pages of a host each hash stands; pages with equal main text count once. A subtree that recurs goes first:
furniture (no prose block) from RECUR pages of its host, prose from PROSE_RECUR pages. Syndicated passages recur more
often than menus do, so prose inside the article, and elsewhere prose among siblings of its kind (headings, paragraphs
and the like, else the same tag; the same class, id and role) that don't recur, goes only when PROSE_RECUR and MOST of the host's pages have it; and so on a page that would lose most of its
prose, which is a copy. Elements that HTML itself marks as no content (script, nav, form, a role, hidden) go
too, and so do containers whose whole class or id consists of NAMES (OUTER: outside the article only), and articles
of class COMMENT: readers' comments and adverts differ from page to page, so no count finds them. What is left inside
the article (else main, else body) is the text. Formulas are text.

Template hashes are sent to executors only while they are at most TEMPLATES; beyond that they are joined with the
pages' own hashes and come back as a list for each page. Defined results: a null html counts as empty (text empty); a
null url is a host of its own; repeated rows get equal results; of pages with equal main text the one with the
smallest hash of its subtrees is counted; unclosed and stray tags are tolerated, and a tag without an end is text;
pages of any length are read whole in time that grows with their length; elements nested deeper than DEPTH become
siblings; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evidentia.llm.common import map_text, materialize

#: Pages of a host that furniture and prose recur on at least, and the share from which prose among content goes.
RECUR, PROSE_RECUR, MOST = 3, 10, 0.6
#: Nesting of elements, as in browsers.
DEPTH = 512
#: Template hashes that are broadcast at most (8 bytes each).
TEMPLATES = 2_000_000
NAME, STOP = re.compile(r"[a-zA-Z][^\s>/]*"), re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption td th tr table caption".split())
#: Opening one of these closes an open one of the named kinds.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in BLOCK - {"body", "html", "li", "dt", "dd", "tr", "option", "p"}}
#: These bound the search for something to close.
SCOPE = frozenset("article section div table ul ol dl body main aside nav header footer form blockquote td th figure".split())
DROP = frozenset("annotation annotation-xml aside button dialog footer form frameset head iframe input label menu nav noscript object option script select style svg template textarea title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Whole classes and ids (fixed values) of containers for adverts, readers' comments and notices; and of articles.
NAMES = frozenset("ad ads advert adverts advertisement sponsored comments comment-list commentlist respond cookie-notice cookie-banner sidebar newsletter breadcrumbs pagination".split())
OUTER = frozenset(["notice"])
COMMENT = frozenset("comment comment-body comment-item reader-comment user-comment".split())
NAMED = frozenset("div section ul ol aside table dl".split())


class Node:
    __slots__ = ("tag", "label", "parent", "children", "drop", "hash", "chars", "linked", "depth", "safe")

    def __init__(self, tag: str, label: str, parent: Node | None, drop: bool):
        self.tag, self.label, self.parent, self.drop = tag, label, parent, drop
        self.children: list = []
        self.depth = parent.depth + 1 if parent else 0
        self.hash = self.chars = self.linked = 0
        self.safe = False


def within(n: Node | None, tags: tuple[str, ...]) -> bool:
    while n is not None and n.tag not in tags:
        n = n.parent
    return n is not None


def named(tag: str, classes: list[str], name: str, parent: Node) -> bool:
    """Whether class or id, as a whole, name an advert, comments or a notice."""
    if tag == "article":
        return not COMMENT.isdisjoint(classes)
    if tag not in NAMED:
        return False
    whole = [set(x) for x in (classes, [name]) if x and x[0]]
    return any(x <= NAMES for x in whole) or any(x <= NAMES | OUTER for x in whole) and not within(parent, ("article", "main"))


def opened(tag: str, attributes: str, parent: Node) -> Node:
    label, drop = "", tag in DROP
    if attributes and attributes.strip(" /\n\t"):
        known = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
        label = " ".join((known.get("class", ""), known.get("id", ""), known.get("role", ""))).lower().strip()
        if label and tag not in ("html", "body", "main"):
            drop |= named(tag, known.get("class", "").lower().split(), known.get("id", "").lower().strip(), parent)
            drop |= tag != "article" and known.get("role", "").lower() in ROLES
        drop |= "hidden" in known or known.get("aria-hidden", "").lower() == "true" and tag in BLOCK or "display:none" in known.get("style", "").replace(" ", "").lower()
    return Node(tag, label, parent, drop)


def tags(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, whether it closes) of every tag, and of comments and declarations with no name.
    One pass: what was looked for in vain is not looked for again. send() moves on to another place."""
    pos, quoted, missing = 0, True, set()
    while (lt := html.find("<", pos)) >= 0:
        pos = lt + 1
        head = html[pos : pos + 1]
        if head in ("!", "?"):
            if html.startswith("!--", pos):
                end = html.find("-->", pos + 3)
                end = len(html) if end < 0 else end + 3
            else:
                end = html.find(">", pos) + 1
            if not end:
                return
            pos = (yield lt, end, "", "", False) or end
            continue
        closing = head == "/"
        m = NAME.match(html, pos + closing)
        if not m:
            continue
        at = m.end()
        while not closing and quoted:
            stop = STOP.search(html, at)
            if stop is None:  # only quoted ends follow: from here on they count
                quoted = False
            elif stop[0] == ">":
                at = stop.start()
                break
            else:
                at, close = stop.end(), -1 if stop[0] in missing else html.find(stop[0], stop.end())
                if close < 0:
                    missing.add(stop[0])
                else:
                    at = close + 1
        end = html.find(">", at if quoted else m.end()) + 1
        if not end:
            return
        pos = (yield lt, end, m[0].lower(), "" if closing else html[m.end() : end - 1], closing) or end


def parse(html: str) -> Node:
    root = Node("html", "", None, False)
    node, pos, low, open_ended = root, 0, None, set()
    source, move = tags(html), None
    while True:
        try:
            start, end, tag, attributes, closing = source.send(move)
        except StopIteration:
            break
        move = None
        if start > pos:
            node.children.append(html[pos:start])
        pos = end
        if not tag or tag in ("html", "body"):
            continue
        if closing:
            up = node
            while up is not root and up.tag != tag:
                if up.tag in SCOPE and tag not in SCOPE:
                    break
                up = up.parent
            if up is not root and up.tag == tag:
                node = up.parent
            continue
        shut = CLOSES.get(tag)
        if shut:
            up = node
            while up is not root and up.tag not in shut and up.tag not in SCOPE:
                up = up.parent
            if up is not root and up.tag in shut:
                node = up.parent
        new = opened(tag, attributes, node)
        node.children.append(new)
        if tag in RAW:
            if low is None:
                low = html.lower()
                low = low if len(low) == len(html) else html
            close = -1 if tag in open_ended else low.find("</" + tag, pos)
            if close >= 0:
                close = html.find(">", close) + 1
                move = pos = close or len(html)
            else:
                open_ended.add(tag)
                if tag in ("script", "style"):
                    move = pos = len(html)
        elif tag not in VOID and not attributes.endswith("/") and new.depth < DEPTH:
            node = new
    if pos < len(html):
        node.children.append(html[pos:])
    return root


def walk(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.children if type(c) is Node]
    return out


def measure(root: Node, host: str) -> list[Node]:
    """Sets the hash, number of characters and of linked characters of every element."""
    nodes = walk(root)
    for n in reversed(nodes):
        parts = [n.tag, n.label]
        for c in n.children:
            if type(c) is str:
                if t := " ".join(c.split()):
                    parts.append(t)
                    n.chars += len(t)
            else:
                parts.append(f"\x00{c.hash}")
                n.chars += c.chars
                n.linked += c.linked
        if n.tag == "a":
            n.linked = n.chars
        n.hash = xxh64_intdigest(host + "\x01" + "\x02".join(parts))
    return nodes


def region(root: Node, nodes: list[Node]) -> list[Node]:
    """The elements that hold the main text: outermost articles, else main, else all."""

    def free(n: Node) -> bool:
        while n is not None:
            if n.drop:
                return False
            n = n.parent
        return True

    def outer(n: Node, tag: str) -> bool:
        up = n.parent
        while up is not None:
            if up.tag == tag:
                return False
            up = up.parent
        return True

    for tag in ("article", "main"):
        found = [n for n in nodes if n.tag == tag and n.chars and outer(n, tag) and free(n)]
        if found:
            place = {id(n): k for k, n in enumerate(in_order(root))}
            return sorted(found, key=lambda n: place[id(n)])
    return [root]


def in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if type(c) is Node]
    return out


def countable(nodes: list[Node]) -> list[Node]:
    """The elements whose recurrence is counted: blocks with text, no whole page or article."""
    return [n for n in nodes if n.chars and n.tag in BLOCK and n.tag not in ("html", "article", "main")]


def prose(n: Node) -> bool:
    return 2 * n.linked <= n.chars and (n.tag in PROSE or any(type(c) is Node and c.tag in PROSE for c in n.children))


def kind(n: Node) -> tuple[str, str]:
    return "p" if n.tag in PROSE else n.tag, n.label


def spare(nodes: list[Node], recurring: dict[int, int]) -> None:
    """Marks as safe the recurring prose that stands among content: it has siblings of its kind that don't recur, or
    lies in such an element, or the page would lose most of its prose."""
    again = {id(n) for n in nodes if recurring.get(n.hash, 0) > 1}
    fresh: dict[int, set] = {}
    for n in nodes:
        up = n.parent
        if id(n) in again and up is not None:
            if id(up) not in fresh:
                fresh[id(up)] = {kind(c) for c in up.children if type(c) is Node and c.chars and not c.drop and id(c) not in again}
            n.safe = up.safe or kind(n) in fresh[id(up)]
    own = [n for n in nodes if n.tag in PROSE and not n.drop and n.parent.tag not in PROSE]
    if 2 * sum(n.chars for n in own if id(n) in again and not n.safe) > sum(n.chars for n in own):
        for n in nodes:
            n.safe |= id(n) in again


def text_of(root: Node, nodes: list[Node], recurring: dict[int, int]) -> str:
    """The page's text without dropped and recurring elements; recurring: 1, 2, 3 for hashes from RECUR, PROSE_RECUR and
    MOST pages. nodes has parents before children."""
    for n in nodes:  # templates go first, so that no recurring teaser passes for the page's article
        level = recurring.get(n.hash, 0)
        n.drop |= level > 0 and n.tag in BLOCK and not prose(n)
    areas = region(root, nodes)
    inside = areas[0] is not root
    if not inside and recurring:
        spare(nodes, recurring)
    blocks: list[str] = []
    piece: list[str] = []

    def cut() -> None:
        if piece:
            if t := " ".join(unescape("".join(piece)).split()):
                blocks.append(t)
            piece.clear()

    for area in areas:
        cut()
        todo: list = [area]
        while todo:
            n = todo.pop()
            if type(n) is str:
                piece.append(n)
            elif n is None:
                cut()
            elif n.drop or n.tag == "header" and not inside or recurring.get(n.hash, 0) > (2 if inside or n.safe else 1):
                cut() if n.tag in BLOCK else piece.append(" ")
            else:
                block = n.tag in BLOCK
                if block:
                    cut()
                    todo.append(None)
                elif n.tag in ("br", "td", "th"):
                    piece.append(" ")
                todo += reversed(n.children)
        cut()
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][-+.\w]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def signed(values) -> np.ndarray:
    return np.array(list(values), np.uint64).view(np.int64)


def page_hashes(pages: DataFrame) -> DataFrame:
    """host, content (a hash of the page's own text), hashes of its countable subtrees."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hosts, contents, own = [], [], []
        for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            host = host_of(url)
            root = parse(html or "")
            nodes = measure(root, host)
            hosts.append(host)
            contents.append(xxh64_intdigest("\x00".join(str(a.hash) for a in region(root, nodes))))
            own.append(signed({n.hash for n in countable(nodes)}))
        at = np.cumsum([0, *map(len, own)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(signed(contents)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own)))], names=["host", "content", "hashes"])

    return map_text(pages, ["url", "html"], run, "host string, content bigint, hashes array<bigint>")


def templates(pages: DataFrame) -> DataFrame:
    """hash, level: subtrees that recur on a host's different pages (1), on PROSE_RECUR (2), and on most of them (3)."""
    different = page_hashes(pages).groupBy("host", "content").agg(F.min(F.struct(F.xxhash64(F.array_sort("hashes")).alias("h"), "hashes")).alias("x")).select("host", "x.hashes")
    different = materialize(different, "subtrees")
    sizes = materialize(different.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    counted = different.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RECUR)
    level = F.when((F.col("n") >= MOST * F.col("pages")) & (F.col("n") >= PROSE_RECUR), 3).when(F.col("n") >= PROSE_RECUR, 2).otherwise(1)
    return counted.join(sizes, "host").groupBy("hash").agg(F.max(level).alias("level"))


def extract(pages: DataFrame, most_broadcast: int = TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = materialize(templates(pages), "templates")
    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    if found.count() <= most_broadcast:
        rows = found.toArrow()
        at, level = rows["hash"].to_numpy(), rows["level"].to_numpy()
        order = np.argsort(at)
        model = pages.sparkSession.sparkContext.broadcast((at[order], level[order]))

        def known(b: pa.RecordBatch, k: int, nodes: list[Node]) -> dict[int, int]:
            at, level = model.value
            own = signed(n.hash for n in nodes)
            if not len(at) or not len(own):
                return {}
            place = np.minimum(np.searchsorted(at, own), len(at) - 1)
            hit = at[place] == own
            return {n.hash: int(x) for n, h, x in zip(nodes, hit, level[place], strict=True) if h}

        source = pages.select("page_id", "url", "html")
    else:
        key = [F.xxhash64("url", "html").alias("k1"), F.xxhash64("html", "url").alias("k2")]
        source = pages.select("page_id", "url", "html", *key)
        own = map_text(source, ["k1", "k2", "url", "html"], listed, "k1 bigint, k2 bigint, hashes array<bigint>").distinct()
        lists = own.select("k1", "k2", F.explode("hashes").alias("hash")).join(found, "hash").groupBy("k1", "k2").agg(F.collect_list(F.struct("hash", "level")).alias("hit"))
        source = source.join(lists, ["k1", "k2"], "left").select("page_id", "url", "html", "hit")

        def known(b: pa.RecordBatch, k: int, nodes: list[Node]) -> dict[int, int]:
            return {x["hash"] & (2**64 - 1): x["level"] for x in b.column(3)[k].as_py() or []}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for k, (url, html) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            root = parse(html or "")
            nodes = measure(root, host_of(url))
            texts.append(text_of(root, nodes, known(b, k, countable(nodes))))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_text(source, source.columns, run, kinds)


def listed(b: pa.RecordBatch) -> pa.RecordBatch:
    own = []
    for url, html in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
        own.append(signed({n.hash for n in countable(measure(parse(html or ""), host_of(url)))}).tolist())
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.list_(pa.int64()))], names=["k1", "k2", "hashes"])
