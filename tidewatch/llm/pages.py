"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page becomes a tree of elements
(siblings with the same tag and class are one node, which holds the texts of
all), and trees of a host are merged by simple tree matching: the alignment of
ordered children, node by node from the root, that matches most nodes. A merged
node keeps the texts that all its pages have in common: those are constant and
belong to the template; the others fill its slots. From a host's merged tree
follow the region of the main text, which is the article if it holds all of the
varying text outside of links and of elements that are marked as something
else, or else the smallest node that does, and the constant texts to leave out
in it.

A constant text is template only if it stands on at least half of a host's pages
and these differ in most of the region: near copies of one article keep what they
share. Names of classes, ids and roles count as whole names, and some of them only
where a part is template or made of links, so that an article's own parts stay.

Trees are merged within each task, then in two steps per host, so what is
shuffled are trees, which do not grow with the number of pages. Pages are not
grouped: they look up the rules of their host.

Cases: null and empty html give the empty text; a page whose host has no rules
(null url, few pages) or another layout is judged by its own tree; unclosed and
crossed tags are closed as browsers do; elements below the 200th level are siblings
there; equal pages get equal texts; page ids
may be null or repeat; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise

from .urls import host_of

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that never hold main text.
OTHER = frozenset(
    "aside button canvas dialog footer form head iframe input label menu nav noscript object option script select style svg template "
    "textarea title".split())
#: Whole names (of class, id or role) that mark an element as something else wherever it is.
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead "
    "menu nav navbar navigation newsletter reply replies sidebar signup sponsor sponsored subscribe".split())
#: Names that an article's own parts may have too: inside the region they count only for template or links.
SOFT_NAMES = frozenset("alert banner header modal notice popup promo promoted related respond share sharing social toolbar widget".split())
#: Words that may stand beside those in a compound name, as in "site-footer".
FILLERS = frozenset("area bar block bottom box buttons container form icons left links list main page posts right section site top wrap wrapper".split())
#: A new one of these closes an open one of the others, up to the elements at the end.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"body", "head", "html", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}

#: Quotes delimit only what stands after an equals sign.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)?+|[^=>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Whether attributes may have one of the names that matter.
NAMED = re.compile(r"(?:class|id|role)\s*=", re.I)
LETTERS = re.compile(r"[^a-z]+")

#: Elements nested deeper are read as siblings on this level, as browsers do.
MOST_LEVELS = 200
#: Hosts whose trees a task holds before it passes them on.
HELD_HOSTS = 1000


def name_kind(names: str) -> str | None:
    """"other" or "soft" if one of the names, by itself or as a compound with fillers, marks an element."""
    soft = False
    for name in names.lower().split():
        words = {w for w in LETTERS.split(name) if w}
        if words and words <= (OTHER_NAMES | SOFT_NAMES | FILLERS):
            if words & OTHER_NAMES:
                return "other"
            soft = soft or bool(words & SOFT_NAMES)
    return "soft" if soft else None


class Element:
    """An element with its children: elements and texts in order.

    ``other``: it never holds main text; ``soft``: its name says so, which counts less.
    """

    __slots__ = ("tag", "key", "other", "soft", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        names: dict[str, str] = {}
        if NAMED.search(attributes) is None:
            self.other, self.soft, self.key = tag in OTHER, False, tag
            return
        for n, a, b, c in ATTRIBUTE.findall(attributes):
            names.setdefault(n.lower(), a or b or c)
        kind = name_kind(" ".join(names[n] for n in ("class", "id", "role") if n in names)) if names else None
        whole = tag in ("html", "body", "article", "main")
        self.other = tag in OTHER or (kind == "other" and not whole) or (
            tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(LETTERS.split(names.get("class", "").lower())))
        self.soft = kind == "soft" and not whole and not self.other
        shown = sorted({w for w in LETTERS.split(names.get("class", "").lower()) if w})
        self.key = ".".join([tag, *shown])


def parse(html: str) -> Element:
    """The tree of a page, with unclosed elements closed."""
    root = Element("#")
    stack, at = [root], 0
    lower = None
    # Open elements below the deepest level, which are not nested any more, and how many of them hold no main text.
    deep: list[Element] = []
    hidden, forms = 0, False

    def add(text: str) -> None:
        if text and not hidden:
            stack[-1].children.append(unescape(text) if "&" in text else text)

    def close(tags, until) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in until:
                return
            if stack[k].tag in tags:
                del stack[k:]
                return

    for found in iter(lambda: TAG.search(html, at), None):
        add(html[at:found.start()])
        at = found.end()
        end, start, attributes = found.group(1), found.group(2), found.group(3)
        if start:
            tag = start.lower()
            if not deep:
                if tag in ENDS_P:
                    close({"p"}, {"td", "th", "table", "button"})
                if tag in CLOSES:
                    close(*CLOSES[tag])
            element = Element(tag, attributes)
            forms = forms or tag == "form"
            stack[-1].children.append(element)
            if tag in RAW:
                lower = lower or html.lower()
                stop = lower.find("</" + tag, at)
                at = len(html) if stop < 0 else stop
                if stop >= 0:
                    at = html.find(">", stop) + 1 or len(html)
            elif tag not in VOID and not attributes.endswith("/"):
                if len(stack) < MOST_LEVELS:
                    stack.append(element)
                else:
                    deep.append(element)
                    hidden += element.other
        elif end:
            tag = end.lower()
            if deep:
                if deep[-1].tag == tag:
                    hidden -= deep.pop().other
                # The end of a block ends its line on the deepest level too.
                if tag in BLOCKS:
                    stack[-1].children.append(Element(tag))
            elif any(e.tag == tag for e in stack[1:]):
                close({tag}, set() if tag in BLOCKS else BLOCKS)
    add(html[at:])
    if forms:
        _open_forms(root)
    return root


def _open_forms(root: Element) -> None:
    """A form that holds most of its page's text, or its article, is not one to leave out: some pages are one form."""
    forms = []

    def count(element: Element) -> tuple[int, bool]:
        n, article = 0, element.tag in ("article", "main", "h1")
        for child in element.children:
            if isinstance(child, str):
                n += _length(child)
            elif not child.other or child.tag == "form":
                more, holds = count(child)
                n, article = n + more, article or holds
        if element.tag == "form":
            forms.append((element, n, article))
        return n, article

    total, _ = count(root)
    for form, n, article in forms:
        if article or 2 * n > total:
            form.other = False


def _own_text(element: Element) -> str:
    """The text of an element's line of words: its own and that of inline elements in it."""
    parts = []
    for child in element.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append(" ")
        elif child.tag not in BLOCKS and not child.other:
            parts.append(_own_text(child))
        else:
            parts.append(" ")
    return "".join(parts)


def plain(text: str) -> str:
    """The text with one space for every run of white space, and none at its ends."""
    return " ".join(text.split())


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(plain(text).encode("utf-8", "replace")) >> 1


def _length(text: str) -> int:
    return len(plain(text))


def tree_of(element: Element, linked: bool = False) -> dict:
    """The mergeable tree of an element: key, other, pages, texts in common with their lengths, whether its texts vary, characters, characters in links,
    characters of its lines, children."""
    node = {"k": element.key, "o": element.other or element.soft, "n": 1, "t": [], "v": False, "c": 0, "l": 0, "w": 0, "x": []}
    texts, byname = {}, {}
    linked = linked or element.tag == "a"
    if element.tag in BLOCKS or element.tag == "#":
        own = plain(_own_text(element))
        if own:
            texts[xxhash.xxh3_64_intdigest(own.encode("utf-8", "replace")) >> 1] = node["w"] = len(own)
    for child in element.children:
        if isinstance(child, str):
            n = _length(child)
            node["c"] += n
            node["l"] += n if linked else 0
        elif child.tag not in RAW:
            sub = tree_of(child, linked)
            if sub["k"] in byname:
                _merge_alike(byname[sub["k"]], sub)
            else:
                byname[sub["k"]] = sub
                node["x"].append(sub)
    node["t"] = sorted(map(list, texts.items()))
    return node


def _merge_alike(one: dict, two: dict) -> None:
    """Take the sibling ``two`` of the same page into ``one``: the texts of both, and their aligned children."""
    one["t"] = sorted(map(list, {*map(tuple, one["t"]), *map(tuple, two["t"])}))
    for field in "clw":
        one[field] += two[field]
    one["x"] = _aligned(one["x"], two["x"], lambda a, b: _merge_alike(a, b))


def matched(one: dict, two: dict) -> int:
    """Simple tree matching: the most pairs of nodes that two trees with equal roots have in order."""
    if one["k"] != two["k"]:
        return 0
    return 1 + _table(one["x"], two["x"])[-1][-1]


def _table(one: list, two: list) -> list[list[int]]:
    best = [[0] * (len(two) + 1)]
    for a in one:
        row, above = [0], best[-1]
        for j, b in enumerate(two):
            row.append(max(row[j], above[j + 1], above[j] + matched(a, b)))
        best.append(row)
    return best


def _aligned(one: list, two: list, merge) -> list:
    """Children of both lists in order: matched ones merged into the first's, the others kept."""
    if [a["k"] for a in one] == [b["k"] for b in two]:
        for a, b in zip(one, two):
            merge(a, b)
        return one
    best, i, j, out = _table(one, two), len(one), len(two), []
    while i or j:
        if i and j and one[i - 1]["k"] == two[j - 1]["k"] and best[i][j] == best[i - 1][j - 1] + matched(one[i - 1], two[j - 1]):
            merge(one[i - 1], two[j - 1])
            out.append(one[i - 1])
            i, j = i - 1, j - 1
        elif i and best[i][j] == best[i - 1][j]:
            i -= 1
            out.append(one[i])
        else:
            j -= 1
            out.append(two[j])
    # Nodes that crossed over in the two orders are the same node.
    seen: dict[str, dict] = {}
    for node in reversed(out):
        if node["k"] in seen:
            merge(seen[node["k"]], node)
        else:
            seen[node["k"]] = node
    return list(seen.values())


def merge_pages(one: dict, two: dict) -> dict:
    """Merge the trees of different pages: constant texts stay, numbers are added."""
    one["v"] = one["v"] or two["v"] or one["t"] != two["t"]
    one["t"] = sorted(map(list, {*map(tuple, one["t"])} & {*map(tuple, two["t"])}))
    for field in "nclw":
        one[field] += two[field]
    one["x"] = _aligned(one["x"], two["x"], merge_pages)
    return one


def _own(node: dict) -> int:
    """Characters of a node's own lines and the inline elements in them, outside of links and marked elements."""
    return node["c"] - node["l"] + sum(_own(x) for x in node["x"] if not x["o"] and x["k"].split(".")[0] not in BLOCKS)


def _template(node: dict, pages: int) -> bool:
    """Whether the node's texts are constant: the same on all pages that have it, which are several and at least half of the host's."""
    return not node["v"] and node["n"] > 1 and 2 * node["n"] >= pages


def _varying(node: dict, pages: int, left: frozenset = frozenset(), path: str = "") -> int:
    """Characters of a subtree that are not known as template, outside of links, marked elements and the paths ``left``."""
    if node["o"] or path in left:
        return 0
    block = node["k"].split(".")[0] in BLOCKS or node["k"] == "#"
    constant = _template(node, pages)
    own = node["c"] - node["l"] if not block or not constant else 0
    for x in node["x"]:
        if block and not own and x["k"].split(".")[0] not in BLOCKS and constant:
            # The inline elements of a constant line are constant, the blocks in them may vary.
            own += _varying(x, pages, left, f"{path}>{x['k']}") - _own(x) if not x["o"] else 0
        else:
            own += _varying(x, pages, left, f"{path}>{x['k']}")
    return own


def region(tree: dict) -> list[str]:
    """Paths of the main text: articles, else main elements, else the smallest node, with all varying text outside of links and marked elements."""
    pages = tree["n"]
    for name in ("article", "main"):
        found = []

        def look(node, path):
            if node["o"]:
                return
            if node["k"].split(".")[0] == name:
                found.append(path)
                return
            for x in node["x"]:
                look(x, f"{path}>{x['k']}")

        look(tree, tree["k"])
        if found and _varying(tree, pages) and not _varying(tree, pages, frozenset(found), tree["k"]):
            return found
    path, node = tree["k"], tree
    while True:
        total = _varying(node, pages)
        inner = next((x for x in node["x"] if total and _varying(x, pages) == total), None)
        if inner is None or inner["k"].split(".")[0] not in BLOCKS or inner["k"].split(".")[0] in ("p", "li", "h1"):
            return [path]
        path, node = f"{path}>{inner['k']}", inner


def rules_of(tree: dict) -> dict:
    """What pages of a host need: the paths of the region, and the constant texts of nodes in it.

    A text is template if it stands on all pages that have its node, which are at
    least half of the host's, and if the pages differ in most of their other text:
    pages that share most of the region are copies, whose common text is theirs.
    """
    paths = region(tree)
    constant: dict[str, list[int]] = {}
    same = whole = 0

    def look(node, path):
        nonlocal same, whole
        if any(path == p or path.startswith(p + ">") for p in paths) and not node["o"]:
            whole += node["w"]
            same += node["n"] * sum(n for _, n in node["t"])
            if node["n"] > 1 and 2 * node["n"] >= tree["n"] and node["t"]:
                constant[path] = [key for key, _ in node["t"]]
        for x in node["x"]:
            look(x, f"{path}>{x['k']}")

    look(tree, tree["k"])
    return {"region": paths, "constant": constant if 2 * same < whole else {}}


def _has(element: Element, tag: str) -> bool:
    return any(isinstance(c, Element) and (c.tag == tag or _has(c, tag)) for c in element.children)


def _counts(element: Element, linked: bool = False) -> tuple[int, int]:
    """Characters of an element, and those in links."""
    n = links = 0
    linked = linked or element.tag == "a"
    for child in element.children:
        if isinstance(child, str):
            more = _length(child)
            n, links = n + more, links + (more if linked else 0)
        elif child.tag not in RAW:
            more, inside = _counts(child, linked)
            n, links = n + more, links + inside
    return n, links


def extract(root: Element, rules: dict | None) -> str:
    """The main text of a parsed page: its blocks, one per line."""
    paths, constant = (set(rules["region"]), rules["constant"]) if rules else (set(), {})

    def blocks_of(wanted: set[str], leave: dict, soft: bool = True) -> list[str]:
        out: list[str] = []
        line: list[str] = []

        def flush() -> None:
            text = plain("".join(line))
            line.clear()
            if text:
                out.append(text)

        def left_out(element: Element, inside: bool) -> bool:
            if element.tag == "header":
                return not _has(element, "h1")
            if element.other:
                return True
            if element.soft and inside and soft:
                # Constant parts go with the texts to leave out; here only links are judged.
                n, links = _counts(element)
                return 2 * links >= n > 0
            return False

        def walk(element: Element, path: str, inside: bool) -> None:
            inside = inside or path in wanted
            if left_out(element, inside):
                return
            block = element.tag in BLOCKS
            inside_text = inside
            if block:
                flush()
                dropped = leave.get(path)
                if dropped and inside and text_key(_own_text(element)) in dropped:
                    inside_text = False
            for child in element.children:
                if isinstance(child, str):
                    if inside_text:
                        line.append(child)
                elif child.tag == "br":
                    line.append(" ")
                elif inside and not inside_text and child.tag not in BLOCKS:
                    continue
                else:
                    walk(child, f"{path}>{child.key}", inside)
            if block:
                flush()

        walk(root, root.key, False)
        flush()
        return out

    found = blocks_of(paths, constant) if paths else []
    if not found and paths:
        found = blocks_of(paths, {})
    if not found:
        own = tree_of(root)
        found = blocks_of(set(region(own)), {})
        if not found:
            # Nothing but parts with soft names: they are the text.
            found = blocks_of({root.key}, {}, soft=False)
    return "\n".join(found)


def host_rules(pages: DataFrame) -> DataFrame:
    """host, rules (JSON) of ``pages`` (host, html)."""
    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: dict[str, dict] = {}

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([task // 64] * len(held), pa.int32()),
                 pa.array([json.dumps(t) for t in held.values()], pa.string())], names=["host", "part", "tree"])

        for batch in batches:
            for host, html in zip(batch.column(0), batch.column(1)):
                host, tree = host.as_py(), tree_of(parse(html.as_py()))
                held[host] = merge_pages(held[host], tree) if host in held else tree
                if len(held) > HELD_HOSTS:
                    yield passed()
                    held.clear()
        yield passed()

    def merge(group: pa.Table, last: bool) -> pa.Table:
        trees = [json.loads(t) for t in sorted(group.column("tree").to_pylist())]
        merged = trees[0]
        for tree in trees[1:]:
            merged = merge_pages(merged, tree)
        return pa.table({"host": pa.array([group.column("host")[0].as_py()], pa.string()),
                         "tree": pa.array([json.dumps(rules_of(merged) if last else merged)], pa.string())})

    trees = pages.where("host <> '' and html is not null").select("host", "html").mapInArrow(induce, "host string, part int, tree string")
    some = trees.groupBy("host", "part").applyInArrow(lambda g: merge(g, False), "host string, tree string")
    return some.groupBy("host").applyInArrow(lambda g: merge(g, True), "host string, tree string").withColumnRenamed("tree", "rules")


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), F.col(html).alias("html"))
    rules = materialise(host_rules(rows), "page-rules")
    both = rows.join(rules, "host", "left").select("page_id", "url", "html", "rules")
    kind = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            out = []
            for page, rule in zip(batch.column(2), batch.column(3)):
                rule = rule.as_py()
                if rule is not None and rule not in known:
                    known.clear() if len(known) > HELD_HOSTS else None
                    known[rule] = json.loads(rule)
                out.append(extract(parse(page.as_py() or ""), known.get(rule)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return both.mapInArrow(texts, kind)


def op4_main_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
