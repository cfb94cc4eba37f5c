"""Main text of pages by wrapper induction.

All pages of a host are reduced to folded trees: repeated siblings of one label (paragraphs, list
items, rows) are one node, containers without a class are told apart by their place. Siblings of a
folded tree then differ in their labels, so that simple tree matching aligns the trees of all pages
of a host by the paths of their labels, and the wrapper is what the pages' paths add up to.
Nodes whose text is the same on most pages are the template; nodes with varying text are slots, and
the content is the slots of the lowest container that holds them all. Links only and boilerplate
marks (elements, roles, class names made of marking words) break ties: they tell menus, adverts and
comments, which vary too, from content; article and main elements do where they hold most of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.llm.scratch import materialize

#: The wrappers' size up to which they are broadcast.
BROADCAST_BYTES = 16 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("table ul ol dl select article section body div td th".split())
#: Elements, roles and words of class and id that mark parts which are not main text.
_BOILERPLATE_TAGS = frozenset("nav header footer aside form script style noscript template iframe button select textarea input svg canvas object dialog menu title".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that may stand beside those in a name; any other one makes it another thing ("product-notice").
_NEUTRAL_WORDS = frozenset("area article bar block body bottom box btn button buttons col column container content desktop div element fixed footer global group header holder id inner item items js left links list main mobile module nav old outer overlay page panel post posts primary region right row secondary section signup site sticky top unit user wrap wrapper".split())
#: Parts of a text that are no containers of one.
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table blockquote pre figure figcaption address details hr".split())
#: Elements that two of which are two things, unless they share a class.
_CONTAINERS = frozenset("div section article main table tbody".split())
#: Elements whose text is never read.
_SILENT = frozenset("head script style noscript template iframe svg canvas object".split())

#: Possessive repeats: each sign is looked at once, and a quote that is never closed is a plain sign.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<",
    re.S,
)
#: Elements nested deeper than this are read as their ancestor's children, as browsers do.
MAX_NESTING = 500
#: Classes and ids whose words carry digits are made by machines and name nothing.
_NAME = re.compile(r"[a-zA-Z][a-zA-Z_-]*")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}


@dataclass
class Node:
    """An element: its label for alignment, whether it is marked as boilerplate or as main text, and its children and texts in order."""

    tag: str
    label: str
    boilerplate: bool = False
    main: bool = False
    children: list = field(default_factory=list)


def _names_boilerplate(name: str) -> bool:
    """Whether a class or id is made of marking words and neutral ones only. What heads or foots an article's own parts is no page header."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    marking = [w for w in words if w in _BOILERPLATE_WORDS]
    if not marking or any(w not in _BOILERPLATE_WORDS and w not in _NEUTRAL_WORDS for w in words):
        return False
    return not (set(marking) <= {"header", "footer", "banner", "masthead"} and not {"article", "post", "content", "body", "section", "item"}.isdisjoint(words))


def _element(tag: str, attributes: str) -> Node:
    if "=" not in attributes:
        return Node(tag, tag, tag in _BOILERPLATE_TAGS, tag in ("article", "main"))
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = (found.get("class", "") + " " + found.get("id", "")).lower()
    role = found.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "") == "articleBody"
    page = tag in ("html", "body")
    boilerplate = tag in _BOILERPLATE_TAGS or not page and (role in _BOILERPLATE_ROLES or not main and any(map(_names_boilerplate, names.split())))
    stable = sorted({n for n in names.split() if _NAME.fullmatch(n)})[:3] if tag in _CONTAINERS and not page else []
    return Node(tag, ".".join([tag, *stable]), boilerplate, main)


def parse(source: str) -> Node:
    """The page's tree; unclosed and stray tags are repaired by the usual implied ends."""
    root = Node("#", "#")
    stack = [root]
    # open elements by tag, and those beyond MAX_NESTING that were not opened
    held: Counter[str] = Counter()
    unopened: Counter[str] = Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            held[x.tag] -= 1
        del stack[k:]

    at, n, last = 0, len(source), source.rfind(">")
    while at < n:
        if at > last:
            stack[-1].children.append(source[at:])
            break
        m = _TOKEN.match(source, at)
        at = m.end()
        tag, ending, attributes = (m[2], m[1], m[3]) if m[2] else (m[5], m[4], m[6])
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack[-1].children.append(text)
            elif text.startswith("<![CDATA["):
                stack[-1].children.append(text[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if ending:
            if unopened[tag]:
                unopened[tag] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1) if held[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("article", "body", "td", "table") and tag in _INLINE | {"p"}:
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if held["p"] else ():
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in _INLINE:
                    break
        elif tag in _SELF_CLOSING:
            ends = _SELF_CLOSING[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in _SCOPES:
                    break
        node = _element(tag, attributes)
        if len(stack) > MAX_NESTING:
            if tag not in _RAW and tag not in _VOID and not attributes.rstrip().endswith("/"):
                unopened[tag] += 1
                stack[-1].children.append(" ")
                continue
        stack[-1].children.append(node)
        if tag in _RAW:
            end = _RAW_END[tag].search(source, at)
            if tag in ("title", "textarea"):
                node.children.append(source[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            held[tag] += 1
    return root


def labelled(node: Node) -> Iterator[tuple[str, Node | str]]:
    """The node's children, seen through inline elements, with their labels in a folded tree; texts have an empty one.

    Containers without a stable class get their place among their kind, since two of them are two things; other
    siblings of one label are records of one thing.
    """
    todo = list(reversed(node.children))
    places: Counter[str] = Counter()
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            yield "", child
        elif child.tag in _INLINE and not child.boilerplate:
            if child.tag == "a":
                yield "<a", child
            todo += reversed(child.children)
            if child.tag == "a":
                todo.insert(len(todo) - len(child.children), _LINK_END)
        elif child is _LINK_END:
            yield "a>", child
        elif child.label == child.tag and child.tag in _CONTAINERS:
            places[child.tag] += 1
            yield f"{child.label}~{places[child.tag]}", child
        else:
            yield child.label, child


_LINK_END = Node("/a", "/a")


def text_of(nodes: list[Node], path: str = "", dropped: frozenset[str] = frozenset()) -> str:
    """The nodes' text without marked parts and without the wrapper's ``dropped`` paths: references decoded, white space as one space, blocks joined by one space."""
    out: list[str] = []
    for node in nodes:
        todo = [(labelled(node), path)]
        while todo:
            rest, here = todo[-1]
            for label, child in rest:
                if label == "":
                    out.append(html.unescape(child) if "&" in child else child)
                elif label in ("<a", "a>"):
                    continue
                elif child.boilerplate:
                    if child.tag not in _INLINE:
                        out.append(" ")
                else:
                    out.append(" ")
                    if f"{here}/{label}" not in dropped:
                        todo.append((labelled(child), f"{here}/{label}"))
                        break
            else:
                todo.pop()
                out.append(" ")
        out.append(" ")
    return " ".join("".join(out).split())


@dataclass
class Folded:
    """A node of a folded tree or of a wrapper. chars, links (those of them in links) and varies are those of its own text."""

    label: str
    children: list[Folded] = field(default_factory=list)
    chars: int = 0
    links: int = 0
    digest: int = 0
    varies: bool = False
    template: bool = False
    marked: bool = False


def fold(*same: Node) -> Folded:
    """Siblings of the same label become one node with all their children; a marked part is one node with the digest of all its text.

    Inline elements count as their parent's text, so that style does not tell trees apart. Parts that
    never hold text to read, such as scripts and the head, are left out.
    """
    out = Folded(same[0].label)
    groups: dict[str, list[Node]] = {}
    texts, linked = [], 0
    for label, child in (pair for node in same for pair in labelled(node)):
        if label == "<a":
            linked += 1
        elif label == "a>":
            linked -= 1
        elif label == "":
            if not child.isspace():
                texts.append(child)
                out.links += len(child) if linked else 0
        elif child.tag not in _VOID and child.tag not in _SILENT:
            groups.setdefault(label, []).append(child)
    if texts:
        joined = "".join(texts)
        out.chars, out.digest = len(joined), hash_of(joined)
    for label, nodes in groups.items():
        if nodes[0].boilerplate:
            whole = _all_text(nodes)
            out.children.append(Folded(f"{label}!", chars=len(whole), digest=hash_of(whole), marked=True))
        else:
            inner = fold(*nodes)
            inner.label = label
            out.children.append(inner)
    return out


def _all_text(nodes: list[Node]) -> str:
    out, todo = [], list(reversed(nodes))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag not in _SILENT:
            todo += reversed(node.children)
    return "".join(out)


def hash_of(text: str) -> int:
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint64)
    weights = np.arange(1, len(raw) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int((weights * (raw + np.uint64(1)) ^ (weights >> np.uint64(29))).sum(dtype=np.uint64).view(np.int64))


def skeleton(node: Folded) -> str:
    return node.label + ("(" + ",".join(skeleton(c) for c in node.children) + ")" if node.children else "")


def _read_skeleton(text: str) -> Folded:
    root = Folded("")
    stack, last = [root], root
    for token in re.findall(r"[(),]|[^(),]+", text):
        if token == "(":
            stack.append(last)
        elif token == ")":
            stack.pop()
        elif token != ",":
            last = Folded(token)
            stack[-1].children.append(last)
    return root.children[0]


def _nodes(node: Folded) -> Iterator[Folded]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.children)


def simple_tree_match(a: Folded, b: Folded) -> tuple[int, list[tuple[Folded, Folded]]]:
    """Size of the largest top-down, order-preserving match of two trees, and its pairs of nodes."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.children), len(b.children)
    w = {(i, j): simple_tree_match(a.children[i], b.children[j]) for i in range(m) for j in range(n) if a.children[i].label == b.children[j].label}
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (w[i - 1, j - 1][0] if (i - 1, j - 1) in w else 0))
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs += w[i, j][1]
    return 1 + best[m][n], pairs


#: Share of a node's text in links from which it is a menu, and of a host's pages that a template stands on.
LINK_SHARE = 0.6
TEMPLATE_SHARE = 0.5
#: Distinct pages that have to agree before a text is a template.
TEMPLATE_PAGES = 3


def _weigh(wrapper: Folded) -> dict[int, tuple[int, int, int]]:
    """For each node: varying text, all text and text in links of its subtree, marked parts aside."""
    order = list(_nodes(wrapper))
    out: dict[int, tuple[int, int, int]] = {}
    for n in reversed(order):
        own = (0, 0, 0) if n.marked else (n.chars if n.varies else 0, n.chars, n.links)
        out[id(n)] = tuple(x + sum(out[id(c)][k] for c in n.children) for k, x in enumerate(own))
    return out


#: Share of all slots from which articles are the content and what varies beside them is not.
ARTICLE_SHARE = 0.5


def content_of(wrapper: Folded) -> tuple[str, list[str]]:
    """Path to the content node, and the paths below it of containers that are template, of menus, and of what stands beside articles.

    The content node is the lowest container that holds all slots. Only a tie is broken by names: where article and main
    elements hold ARTICLE_SHARE of all slots, they are the content, all of them, and other varying containers beside
    them are comments, teasers or adverts; where they hold less, everything that varies is content. Text that is all links
    is a menu, but not in such an element.
    """
    mass = _weigh(wrapper)
    slot = (lambda n: mass[id(n)][0]) if mass[id(wrapper)][0] else (lambda n: mass[id(n)][1])
    menu = lambda n: mass[id(n)][1] > 0 and mass[id(n)][2] >= LINK_SHARE * mass[id(n)][1]
    named: list[tuple[list[Folded], int]] = []
    todo: list[list[Folded]] = [[wrapper]]
    while todo:
        line = todo.pop()
        node = line[-1]
        if node is not wrapper and not node.marked and slot(node) and node.label.split(".")[0].split("~")[0] in ("article", "main"):
            named.append((line, slot(node)))
        else:
            todo += [[*line, c] for c in reversed(node.children)]
    chosen = named if sum(n for _, n in named) >= ARTICLE_SHARE * slot(wrapper) and named else []
    dropped: list[str] = []
    if chosen:
        lines = [line for line, _ in chosen]
        depth = 0
        while all(len(x) > depth for x in lines) and len({id(x[depth]) for x in lines}) == 1:
            depth += 1
        node, path = lines[0][depth - 1], "/" + "/".join(n.label for n in lines[0][:depth])
        inside, ways = {id(x[-1]) for x in lines}, {id(n) for x in lines for n in x}
        beside = [(node, path)] if id(node) not in inside else []
        while beside:
            n, here = beside.pop()
            for c in n.children:
                if id(c) not in ways and not c.marked and c.label.split(".")[0].split("~")[0] in _CONTAINERS:
                    dropped.append(f"{here}/{c.label}")
                elif id(c) in ways and id(c) not in inside:
                    beside.append((c, f"{here}/{c.label}"))
    else:
        node, path = wrapper, f"/{wrapper.label}"
        while True:
            inner = [c for c in node.children if not c.marked and slot(c) and not menu(c)]
            own = node.varies and node.chars
            if len(inner) != 1 or own or inner[0].label.split(".")[0].split("~")[0] in _BLOCKS:
                break
            node, path = inner[0], f"{path}/{inner[0].label}"
    todo = [(c, f"{path}/{c.label}") for c in node.children]
    while todo:
        n, here = todo.pop()
        constant = n.label.split(".")[0].split("~")[0] in _CONTAINERS and mass[id(n)][1] > 0 and all(x.template or not x.chars for x in _nodes(n))
        if not n.marked and (constant or (not chosen and menu(n))):
            dropped.append(here)
        else:
            todo += [(c, f"{here}/{c.label}") for c in n.children]
    return path, sorted(set(dropped))


def find(root: Node, path: str) -> list[Node]:
    """The page's nodes that align with the wrapper's path, seen through inline elements."""
    level = [root]
    for label in path.split("/")[2:]:
        level = [c for n in level for name, c in labelled(n) if name == label and not c.boilerplate]
    return level


def extract(source: str, path: str | None, dropped: frozenset[str] = frozenset()) -> str:
    """A page's main text at the wrapper's content path; a page that has no such node is its own wrapper."""
    root = parse(source)
    nodes = find(root, path) if path else []
    text = text_of(nodes, path or "", dropped) if nodes else ""
    if not text:
        own = fold(root)
        for n in _nodes(own):
            n.varies = n.chars > 0
        path, menus = content_of(own)
        text = text_of(find(root, path), path, frozenset(menus))
    return text


def host_of(url: str) -> Column:
    """The lower-cased host of a URL column, empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]*)", 1)), F.lit(""))


def _paths(node: Folded) -> Iterator[tuple[str, Folded]]:
    todo = [(node, f"/{node.label}")]
    while todo:
        n, here = todo.pop()
        yield here, n
        todo += [(c, f"{here}/{c.label}") for c in reversed(n.children)]


_SLOT_SCHEMA = "host string, path string, place int, digest long, chars long, links long, marked boolean, page long"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node with text of each page's folded tree, and one for the tree itself; page is the digest of all its text."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    names = [c.split()[0] for c in _SLOT_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            nodes = list(_paths(fold(parse(source or ""))))
            page = hash_of(" ".join(f"{path}:{n.digest}" for path, n in nodes if n.chars and not n.marked))
            rows += [(host, path, k, n.digest, n.chars, n.links, n.marked, page) for k, (path, n) in enumerate(nodes) if n.chars or k == 0]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def aligned(slots: Iterable[tuple]) -> Folded:
    """The wrapper of all (path, chars, links, varies, template, marked)."""
    wrapper = Folded("#")
    at = {"/#": wrapper}
    for path, chars, links, varies, template, marked in slots:
        node, here = wrapper, "/#"
        for label in path.split("/")[2:]:
            here = f"{here}/{label}"
            if here not in at:
                at[here] = Folded(label)
                node.children.append(at[here])
            node = at[here]
        node.chars, node.links, node.varies, node.template, node.marked = int(chars), int(links), bool(varies), bool(template), bool(marked)
    return wrapper


def _induce(pdf: pd.DataFrame) -> pd.DataFrame:
    """One host's wrapper from the sums of its paths. A text counts as template if it is the same on all its pages, which are enough and most of the host's."""
    rows = pdf.sort_values(["place", "path"])
    whole = rows.loc[rows["path"] == "/#", "pages"].max()
    same = rows["least"] == rows["most"]
    template = same & (rows["pages"] >= max(TEMPLATE_PAGES, TEMPLATE_SHARE * whole))
    path, dropped = content_of(aligned(zip(rows["path"], rows["chars"], rows["links"], ~same | (rows["pages"] <= 1), template, rows["marked"], strict=True)))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "path": [path], "dropped": [dropped]})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, path, dropped): the content path of each host's wrapper, and the template and menu paths in it.

    The texts of all pages make a host's wrapper, added up per host and path of labels before they
    are shuffled, so that a host has as many rows as its wrapper has nodes. Copies of a page count
    once for a template (by an approximate distinct count of pages, exact for the few that matter).
    """
    slots = pages.select(host_of("url").alias("host"), "html").mapInArrow(_slots, _SLOT_SCHEMA)
    counted = slots.groupBy("host", "path").agg(
        F.approx_count_distinct("page", 0.02).alias("pages"), F.min("place").alias("place"), F.min("digest").alias("least"), F.max("digest").alias("most"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("marked").alias("marked"),
    )
    return counted.groupBy("host").applyInPandas(_induce, "host string, path string, dropped array<string>")


def _fresh(names: list[str], wanted: str) -> str:
    """A column name that is not among ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while wanted in taken:
        wanted = f"_{wanted}"
    return wanted


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html; other columns pass through).

    Returns page_id, url, text (empty if there is none) and n_chars (its code points), with the
    other columns but html. A null html is empty; pages without a host form a group of their
    own; a page without its wrapper's content node, such as the first of its kind, is its own
    wrapper, in which all text varies. Repeated rows each give their row; an empty table gives no
    rows. Elements nested beyond MAX_NESTING are read as their ancestor's text; tags that never
    end are text; both take linear time.

    Text inside the content node goes only where a whole container is template, that is the same on
    at least TEMPLATE_PAGES distinct pages and TEMPLATE_SHARE of the host's; paragraphs and lists
    that pages share, and copies of pages, are content. Wrappers are broadcast up to BROADCAST_BYTES
    and joined by host beyond that.
    """
    host, path, cuts, key = (_fresh(pages.columns, n) for n in ("_host", "_path", "_cuts", "_key"))
    found = materialize(wrappers(pages), "wrappers").toDF(host, path, cuts)
    held = found.agg(F.sum(F.octet_length(host) + F.octet_length(path) + F.octet_length(F.array_join(cuts, "")) + 64)).first()[0]
    small = (held or 0) <= BROADCAST_BYTES
    joined = pages.withColumn(key, host_of("url")).join(F.broadcast(found) if small else found, F.col(key) == F.col(host), "left").drop(key, host)
    at, way, out = (joined.columns.index(c) for c in ("html", path, cuts))
    keep = [i for i, c in enumerate(joined.columns) if c not in ("html", path, cuts, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(at).to_pylist(), batch.column(way).to_pylist(), batch.column(out).to_pylist(), strict=True)
            texts = [extract(h or "", p, frozenset(d or ())) for h, p, d in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(batch.schema.names[i] for i in keep), "text", "n_chars"])

    return joined.mapInArrow(run, T.StructType([*(joined.schema.fields[i] for i in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
