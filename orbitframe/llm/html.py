"""Main text of HTML pages, by union-free wrappers inferred from the pages of a host.

A page's tokens are folded into balanced units. Texts with their inline markup are leaves; neighbours of one kind fold into one repeated unit, and
runs such as (h2 p)(h2 p) into one repeated group. The wrapper of a group of pages of one host starts as the first page and is aligned with
one page after another: texts that differ become slots, units that only one side has become optional, neighbours of one kind become
repeated. No alternatives (unions) arise. Every text of every page belongs to one leaf of the wrapper, and the wrapper decides about it:

* a leaf that is neither optional nor repeated and has one text on all of three pages or more is template text, which is dropped unless it
  is most of a page's text (then the pages are copies);
* the content is the wrapper's article units, else its main units, if they hold at least `least_share` of the slot text, else the whole page
  without lists of links;
* units whose tag, class, id or role names boilerplate are not content, unless the wrapper shows that there is next to nothing else.

Groups have about `pages_per_wrapper` pages: a host with more is dealt over several by a hash of the page id, so no host meets in one task.
Pages travel compressed, in one shuffle, and are streamed group by group. The page counts of hosts with more than one group are broadcast up
to MOST_BROADCAST hosts of 16 bytes each; beyond it a shuffle join takes their place, with the same rows.

Any markup takes time in proportion to its length and any depth: tags are found by one scan, trees are walked with stacks, and lists of units that
are too long for a table of common subsequences are aligned at the kinds that occur once on either side.

Defined cases: a null html is empty and gives an empty text; a null url has the host ''; markup that is cut off or not closed is read to the
end, an unfinished tag at the end is dropped; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm.common import chunks, stage, table

# HTML vocabulary.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics object canvas".split())
RAW = set("script style noscript template textarea title iframe svg select annotation annotation-xml".split())
SOURCE = set("annotation annotation-xml".split())
BOILERPLATE = set("nav header footer aside menu form fieldset button label dialog head".split())
CLOSED_BY = {"p": set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
NAMES = set(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments discussion disqus replies reply respond share sharing social related recommended recommendations "
    "widget toolbar login signin signup search pagination pager copyright legal disclaimer complementary contentinfo skip".split()
)
SECTIONS = ("article", "main", "body")
REGIONS = ("article", "main")
LISTS = {"ul", "ol", "dl", "table", "div", "section"}
NAMED = set("div section ul ol table td p form main article".split())

MOST_BROADCAST = 200_000
MOST_CELLS = 40_000

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('', text, ''), ('/', tag, '') and ('<', tag, attributes) in page order; comments, declarations and raw elements are skipped."""
    at, n, ended = 0, len(page), set()  # ended: quotes that do not occur any more
    while at < n:
        i = page.find("<", at)
        if i < 0:
            yield "", page[at:], ""
            return
        sign = page[i + 1 : i + 2]
        name = NAME.match(page, i + 2 if sign == "/" else i + 1)
        if not name and sign not in ("!", "?", "/"):
            yield "", page[at : i + 1], ""  # a lone sign is text
            at = i + 1
            continue
        if i > at:
            yield "", page[at:i], ""
        if not name:
            end = page.find("-->", i + 4) + 2 if page.startswith("<!--", i) else page.find(">", i + 1)
            if end < i:
                return
            at = end + 1
            continue
        k = name.end()
        while stop := STOP.search(page, k):
            k = stop.end()
            if stop[0] == ">":
                break
            if stop[0] not in ended and page[max(i, stop.start() - 40) : stop.start()].rstrip().endswith("="):
                close = page.find(stop[0], k)
                if close < 0:
                    ended.add(stop[0])
                else:
                    k = close + 1
        if not stop:
            return
        at, tag, attributes = k, name[0].lower(), page[name.end() : k - 1]
        if sign == "/":
            yield "/", tag, ""
            continue
        yield "<", tag, attributes
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(f"</{tag}(?=[\\s/>]|$)", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or n
            yield "/", tag, ""


class Element:
    """A balanced unit; kind is its tag with the names in its class, junk whether tag or attributes name boilerplate."""

    __slots__ = ("tag", "kind", "children", "junk")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.junk, names = described(tag, attributes)
        self.kind = ".".join([tag, *names]) + "!" * self.junk


def described(tag: str, attributes: str) -> tuple[bool, list[str]]:
    """Whether a unit is boilerplate by its tag and attributes, and the words of its class."""
    junk, names = tag in BOILERPLATE or tag in RAW, []
    if tag in ("html", "body") or not attributes.strip(" /\n\t"):
        return junk, names
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            junk = True
        elif name in ("class", "id", "role"):
            words = re.findall(r"[a-z]+", value)
            junk = junk or bool(NAMES.intersection(words)) or "header" in words and not {"article", "entry", "post"}.intersection(words)
            if name == "class" and tag in NAMED:
                names = sorted(set(words))[:4]
    return junk, names


def parse(page: str) -> Element:
    """The page as a tree of balanced units; texts are str children. Unclosed units end where their parent ends."""
    root = Element("#root")
    stack, places, blocks = [root], defaultdict(list), []  # where each tag and where blocks stand in the stack

    def close(k: int) -> None:
        for j in range(len(stack) - 1, k - 1, -1):
            places[stack[j].tag].pop()
            if blocks and blocks[-1] == j:
                blocks.pop()
        del stack[k:]

    for sign, value, attributes in tokens(page):
        if not sign:
            stack[-1].children.append(entities.unescape(value))
        elif sign == "/":
            if places[value]:
                k = places[value][-1]
                if value not in INLINE or k > max((places[s][-1] for s in SECTIONS if places[s]), default=0):  # a stray end tag closes no section
                    close(k)
        else:
            for k in reversed(blocks):
                above = stack[k].tag
                if value in CLOSED_BY.get(above, ()):
                    close(k)
                    break
                if above in ("ul", "ol", "table", "dl") or above != "p" and value not in SCOPES.get(above, ()):
                    break
            unit = Element(value, attributes)
            stack[-1].children.append(unit)
            if value not in VOID and not attributes.rstrip().endswith("/"):
                places[value].append(len(stack))
                if value not in INLINE:
                    blocks.append(len(stack))
                stack.append(unit)
    return root


def clean(text: str) -> str:
    return " ".join(text.split())


class Node:
    """A unit of a wrapper: kind '#' is a leaf whose text is a constant or None (a slot), kind '(' a group, others are elements. `slot` counts the
    characters that its texts have outside links, `all` all of them. Nodes that were found to be one unit refer to the one that stands for them."""

    __slots__ = ("kind", "tag", "junk", "items", "text", "optional", "repeated", "is_", "own", "linked")

    def __init__(self, kind: str, tag: str, junk: bool = False, text: str | None = None, linked: int = 0):
        self.kind, self.tag, self.junk, self.text = kind, tag, junk, text
        self.items: list[Node] = []
        self.optional = self.repeated = False
        self.is_: Node | None = None
        self.own, self.linked = len(text or ""), linked

    def root(self) -> Node:
        node = self
        while node.is_ is not None:
            node = node.is_
        while self.is_ is not None and self.is_ is not node:
            self.is_, self = node, self.is_
        return node


def merge(pairs: list[tuple[Node, Node]]) -> None:
    """Make one of each pair of nodes, and of what is aligned inside them."""
    while pairs:
        a, b = (x.root() for x in pairs.pop())
        if a is b:
            continue
        b.is_ = a
        a.own, a.linked = a.own + b.own, a.linked + b.linked
        a.optional, a.repeated, a.junk = a.optional or b.optional, a.repeated or b.repeated, a.junk and b.junk
        if a.kind == "#":
            a.text = a.text if a.text == b.text else None
        elif a.items or b.items:
            a.items = align(a.items, b.items, pairs)
        b.items = []


def fold(items: list[Node], pairs: list[tuple[Node, Node]]) -> list[Node]:
    """Neighbours of one kind become one repeated unit, equal neighbouring runs of two to four units a repeated group."""
    out: list[Node] = []
    for item in items:
        if out and out[-1].kind == item.kind:
            out[-1].repeated = True
            pairs.append((out[-1], item))
        else:
            out.append(item)
    for period in (2, 3, 4):
        kinds, rest, k = [x.kind for x in out], [], 0
        while k < len(out):
            end = k + period
            while end + period <= len(out) and kinds[end : end + period] == kinds[k : k + period]:
                end += period
            if end - k < 2 * period or not any(x.kind != "#" for x in out[k : k + period]):
                rest.append(out[k])
                k += 1
                continue
            group = Node("(" + " ".join(kinds[k : k + period]), "(")
            group.items, group.repeated = out[k : k + period], True
            pairs += [(out[j - period], out[j]) for j in range(end - 1, k + period - 1, -1)]
            rest.append(group)
            k = end
        out = rest
    return out


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A common subsequence: the longest one where a table of MOST_CELLS holds it, else along the kinds that occur once on either side."""
    n, head, tail = min(len(a), len(b)), 0, 0
    while head < n and a[head] == b[head]:
        head += 1
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    middle: list[tuple[int, int]] = []
    if len(x) * len(y) <= MOST_CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                middle.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        once_x, once_y = Counter(x), Counter(y)
        there = {k: j for j, k in enumerate(y) if once_y[k] == 1}
        last = -1
        for i, k in enumerate(x):
            if once_x[k] == 1 and there.get(k, -1) > last:
                last = there[k]
                middle.append((i, last))
    return [(i, i) for i in range(head)] + [(head + i, head + j) for i, j in middle] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def align(a: list[Node], b: list[Node], pairs: list[tuple[Node, Node]]) -> list[Node]:
    """The items of a wrapper without alternatives that covers both; what they have in common is left in pairs."""
    a, b = [x.root() for x in a], [x.root() for x in b]
    out, i, j = [], 0, 0
    for p, q in [*matches([x.kind for x in a], [x.kind for x in b]), (len(a), len(b))]:
        for extra in (*a[i:p], *b[j:q]):
            extra.optional = True
            out.append(extra)
        if p < len(a):
            pairs.append((a[p], b[q]))
            out.append(a[p])
        i, j = p + 1, q + 1
    return fold(out, pairs)


def wrap(page: Element) -> tuple[Node, list[tuple[Node, str]]]:
    """The wrapper of one page, and its leaves with their texts in page order."""
    top, leaves, run, linked = Node("#root", "#root"), [], [], 0

    def flush(node: Node) -> None:
        nonlocal linked
        if text := clean("".join(run)):
            leaf = Node("#", "#", text=text, linked=min(linked, len(text)))
            node.items.append(leaf)
            leaves.append((leaf, text))
        run.clear()
        linked = 0

    # (element, its node, its next child, whether in a link); inline elements go with the node they stand in
    stack, order = [(page, top, 0, False)], [top]
    while stack:
        unit, node, k, link = stack.pop()
        if k == len(unit.children):
            if unit.tag not in INLINE:
                flush(node)
            continue
        stack.append((unit, node, k + 1, link))
        child = unit.children[k]
        if isinstance(child, str):
            run.append(child)
            linked += len(clean(child)) * link
        elif child.tag in RAW or child.tag in ("br", "img", "wbr") or child.junk and child.tag in INLINE:
            run.append(" " if child.tag == "br" else "")
            if child.tag in RAW - SOURCE:
                flush(node)
        elif child.tag in INLINE:
            stack.append((child, node, 0, link or child.tag == "a"))
        else:
            flush(node)
            own = Node(child.kind, child.tag, child.junk)
            node.items.append(own)
            order.append(own)
            stack.append((child, own, 0, link))
    pairs: list[tuple[Node, Node]] = []
    for node in reversed(order):
        node.items = fold([x.root() for x in node.items], pairs)
        merge(pairs)
    return top, leaves


def infer(pages: list[str]) -> tuple[Node, list[list[tuple[Node, str]]]]:
    """The wrapper of the pages, and of each page its leaves and texts."""
    top, leaves = wrap(parse(pages[0]))
    every, known = [leaves], {pages[0]: leaves}
    for page in pages[1:]:
        if page not in known:
            other, known[page] = wrap(parse(page))
            merge([(top, other)])
        every.append(known[page])
    return top, every


def expression(top: Node) -> str:
    """The wrapper as a regular expression over tokens: slots are #PCDATA, groups end in ? or +."""
    out, stack = [], [x.root() for x in reversed(top.items)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        sign = "+" * item.repeated + "?" * item.optional
        first, last = ("(", ")" + sign) if sign else ("", "")
        if item.kind == "#":
            out.append(first + (re.escape(item.text) if item.text is not None else "#PCDATA") + last)
        else:
            tag = "" if item.tag == "(" else item.tag
            out.append(first + (f"<{tag}>" if tag else ""))
            stack += [(f"</{tag}>" if tag else "") + last, *(x.root() for x in reversed(item.items))]
    return "".join(out)


def decide(top: Node, pages: int, least: int, least_share: float, most_junk: float) -> tuple[dict[int, str], set[int]]:
    """Of each leaf, by id, whether it is 'text', 'junk' or, in a page without a region, in a 'list' of links; and which leaves are template text."""
    order, stack = [], [(top, False, False, frozenset())]  # parents before what they hold
    while stack:
        node, marked, loose, inside = stack.pop()
        inside = inside | {node.tag} if node.tag in REGIONS else inside
        order.append((node, marked, loose, inside))
        stack += [(x, marked or x.junk, loose or x.optional or x.repeated, inside) for x in map(Node.root, node.items)]
    fixed = {id(x) for x, _, loose, _ in order if x.kind == "#" and x.text is not None and not loose} if pages >= least else set()
    leaves = [(x, marked, inside) for x, marked, _, inside in order if x.kind == "#"]
    slots = [(x.own - x.linked, marked, inside) for x, marked, inside in leaves if id(x) not in fixed]
    bare = sum(n for n, marked, _ in slots if not marked)
    trusted = bare >= most_junk * sum(n for n, _, _ in slots)  # else marked units are all there is
    region = None
    for held in (slots, [(x.own - x.linked, marked, inside) for x, marked, inside in leaves]):  # all texts where no slot is in a region
        parts = {tag: sum(n for n, marked, inside in held if tag in inside and not (marked and trusted)) for tag in REGIONS}
        whole = sum(n for n, marked, _ in held if not (marked and trusted))
        region = next((tag for tag in REGIONS if parts[tag] and parts[tag] >= least_share * whole), None)
        if any(parts.values()):
            break
    sizes: dict[int, tuple[int, int]] = {}
    for node, _, _, _ in reversed(order):
        inner = [sizes[id(x)] for x in map(Node.root, node.items)]
        sizes[id(node)] = (node.own, node.linked) if node.kind == "#" else (sum(x for x, _ in inner), sum(x for _, x in inner))
    lists = {id(x) for x, _, _, _ in order if x.tag in LISTS and sizes[id(x)][1] > 0.8 * sizes[id(x)][0]} if region is None else set()
    verdict, stack = {}, [(top, False)]
    listed = set()
    while stack:
        node, links = stack.pop()
        links = links or id(node) in lists
        if links:
            listed.add(id(node))
        stack += [(x, links) for x in map(Node.root, node.items)]
    for node, marked, _, inside in order:
        if node.kind == "#":
            away = region is not None and region not in inside
            verdict[id(node)] = "junk" if away or marked and trusted else "list" if id(node) in listed else "text"
    return verdict, fixed


def extract(pages: list[str], least: int = 3, most: float = 0.3, least_share: float = 0.3, most_junk: float = 0.02) -> tuple[list[str], Node]:
    """The main text of each page of one host, and their wrapper. Where the wrapper finds no content in a page that has texts (a page unlike the
    others), the page is its own wrapper."""
    top, every = infer(pages)
    said, fixed = decide(top, len(set(pages)), least, least_share, most_junk)
    out, known = [], {}
    for page, leaves in zip(pages, every, strict=True):
        if page not in known:
            own = [(id(leaf.root()), text) for leaf, text in leaves]
            parts = [(k, text) for k, text in own if said[k] == "text"]
            if own and not parts:
                alone, other = wrap(parse(page))
                verdict, _ = decide(alone, 1, least, least_share, most_junk)
                parts = [(0, text) for leaf, text in other if verdict[id(leaf.root())] == "text"]
            kept = [(k, text) for k, text in parts if k not in fixed]
            size = sum(len(t) for _, t in parts)
            known[page] = "\n".join(t for _, t in (parts if size - sum(len(t) for _, t in kept) > most * size else kept))
        out.append(known[page])
    return out, top


def _groups(batches):
    """Rows of one (host, part) after another, from sorted batches."""
    key, rows, unpack = None, [], zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            if key != (here := (row["host"], row["part"])) and rows:
                yield rows
                rows = []
            key = here
            row["html"] = unpack.decompress(row.pop("z")).decode("utf-8", "replace")
            rows.append(row)
    if rows:
        yield rows


def _texts(batches):
    for rows in _groups(batches):
        texts, _ = extract([r["html"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in rows], pa.int64()), pa.array([r["url"] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _wrappers(batches):
    for rows in _groups(batches):
        yield pa.RecordBatch.from_pydict({"host": [rows[0]["host"]], "part": pa.array([rows[0]["part"]], pa.int64()), "pages": pa.array([len(rows)], pa.int64()), "wrapper": [expression(extract([r["html"] for r in rows])[1])]})


def _pack(batches):
    packer = zstandard.ZstdCompressor(level=3)
    for batch in chunks(batches, "html"):
        z = [packer.compress(x) for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["host"], pa.array(z, pa.binary())], names=["page_id", "url", "host", "z"])


def grouped(pages: DataFrame, pages_per_wrapper: int = 12) -> DataFrame:
    """Pages dealt by host and part, each group in one run of a partition."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    own = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    counts = own.groupBy(F.xxhash64("host").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") > pages_per_wrapper)
    crowded = stage(counts)
    if crowded.count() <= MOST_BROADCAST:
        crowded = F.broadcast(crowded)
    packed = own.mapInArrow(_pack, "page_id long, url string, host string, z binary").withColumn("h", F.xxhash64("host")).join(crowded, "h", "left").drop("h")
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce(F.ceil(F.col("n") / pages_per_wrapper), F.lit(1)))
    return packed.withColumn("part", part).drop("n").repartition("host", "part").sortWithinPartitions("host", "part", "page_id")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return grouped(pages).mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, part, pages, wrapper): the inferred expressions."""
    return grouped(pages).mapInArrow(_wrappers, "host string, part long, pages long, wrapper string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
