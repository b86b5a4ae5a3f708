"""Main-text extraction by wrapper induction.

Pages of one host are aligned by simple tree matching (ordered, top-down, maximum
number of matched nodes). A tree has the block elements only; a run of siblings with one
label is one node with several members, so lists and paragraphs of any length align, and an
element with more than ``_LIST`` runs is a list whose children are taken by label. The
outlines of all pages of a host are merged into its template, whose nodes are the slots.
Every page is then aligned with the template, and for each slot the texts of its members
are counted over all pages: a text that ``CONSTANT_SHARE`` of the pages with that slot have
is constant and belongs to the template, what varies is content. A place is also counted by
its path of labels alone, for members that no single slot holds on most pages.

The template decides first. Of what it leaves, elements that by tag or role are menus,
headers, footers, side bars, forms, scripts, comments and the like go, and only what is
inside an article or main element counts if the page marks one. Class and id names are a
supplement: a name hides an element only if all its words are such names (``ad-slot``, but
neither ``has-sidebar`` nor ``share-price-notice``), and not if it holds most of the
page's text that varies; so is a form, which may be the whole page. Links are text like any other: only
the template, a tag or a name tells a menu. Inside an article element, what is constant goes at its edges only
(a notice at its end): a heading that all articles have, with text of their own on both sides, is part of each.

Nothing is sampled: outlines are counted as they are distinct and merged level by level, at
most ``_FAN`` at once, in an order that only contents decide, so a host with a third of all
pages is spread over many tasks. Slots of fewer than ``MIN_SUPPORT`` pages can't be constant
and leave the template when it is whole. Pages of equal content count once, so copies don't
vote for themselves.

Defined cases: null html is empty text; a page without a host has no template; a page
that would be empty without its constant nodes keeps them; elements nest to any depth;
repeated rows give repeated results and a null id is passed on; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import join_checked, materialize, release

MIN_SUPPORT, CONSTANT_SHARE = 5, 0.6
_LIST, _FAN = 64, 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_SKIP = set("script style noscript template nav footer aside button select textarea input iframe object embed svg canvas audio video dialog menu head title map datalist noembed noframes xmp".split())
_CLOSES_P = _BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}, "p": {"td", "th", "table", "button"}}
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of names of what is not the page's text; ``_NEVER`` ones can be longer than it.
_NEVER = set("comment comments commentlist disqus respond replies reply related recommend recommended recommendation recommendations ad ads advert adverts advertisement advertisements advertising adsense adslot adbox cookie cookies consent gdpr outbrain taboola".split())
_NAMES = _NEVER | set(
    "banner banners sponsor sponsors sponsored promo promos promoted notice notices notification notifications alert alerts nav navbar navigation menu menus topbar masthead breadcrumb breadcrumbs sidebar sidebars sidenav widget widgets footer footers share sharing social newsletter subscribe subscription popup popups modal overlay paywall login signin signup register search searchbox copyright disclaimer toolbar pagination pager skiplink".split()
)
_HEADER = {"header", "headers", "siteheader", "pageheader"}
#: Words that a name may have beside those.
_ABOUT = set("post posts article articles story stories entry entries".split())
_BESIDE = _ABOUT | set("box block slot list lists container wrapper wrap section area bar item items link links button buttons btn top bottom left right inner outer site page global main primary secondary module unit panel group form field icon icons count id".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANK = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _named(names: str) -> set[str]:
    """The words of the class and id names that say what an element is for."""
    out = set()
    for name in names.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & _NAMES and words <= _NAMES | _HEADER | _BESIDE:
            out |= words & _NAMES
        elif words & _HEADER and words <= _HEADER | _BESIDE - _ABOUT:
            out |= words & _HEADER
    return out


class Node:
    """A block element; ``texts`` are (position, text) of its own blocks. After collapsing,
    ``members`` has those of each element of a run."""

    __slots__ = ("label", "children", "texts", "members")

    def __init__(self, label: str):
        self.label, self.children, self.texts, self.members = label, [], [], []


class Page:
    """The block tree of one page and its text blocks in page order."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int]] = []  # text, and whether in a main (1) or an article (2)
        self.hidden: list[int] = []  # of each block, the name or form that hides it, or 0
        self.never: list[bool] = [False]  # of each of these, whether it is final
        self.forms: set[int] = set()
        self.articles = False
        root = Node("#")
        # open elements: tag, node of the nearest block, skipped, in article, is a block
        stack = [("#", root, False, 0, True)]
        words: list[str] = []
        deepest = 1

        def flush():
            nonlocal words
            if words:
                text = _BLANK.sub(" ", "".join(words)).strip()
                if text:
                    _, node, skip, inside, _ = stack[-1]
                    self.hidden.append(int(skip))
                    node.texts.append((len(self.blocks), text))
                    self.blocks.append((text, inside))
                words = []

        def say(raw):
            if stack[-1][2] is not True and raw:
                words.append(entities.unescape(raw))

        def pop_to(k):
            if any(e[4] for e in stack[k:]):
                flush()
            del stack[k:]

        at, n, scan = 0, len(source), _TOKEN.search
        while at < n:
            m = scan(source, at)
            if m is None:
                say(source[at:])
                break
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if tag == "p" or tag in _BLOCK:
                    flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    if tag not in _BLOCK and stack[k][4]:
                        break  # an inline end tag doesn't close a block
                continue
            if tag == "br":
                if words:
                    words.append(" ")
                continue
            block = tag in _BLOCK
            if block and tag in _CLOSES_P:
                self._close(stack, {"p"}, _SCOPE["p"], pop_to)
            if tag in _SELF:
                self._close(stack, _SELF[tag], _SCOPE[tag], pop_to)
            if block:
                flush()
            _, parent, skip, inside, _ = stack[-1]
            attrs = (m[3] or m[6] or "").strip()
            name = ""
            if attrs and attrs != "/":
                given = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
                name = f"{given.get('class', '')} {given.get('id', '')}".strip()
                role = given.get("role", "").lower()
                if skip is not True and tag not in ("html", "body", "article", "main"):
                    gone = role in _ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "style" in given and bool(_HIDDEN.search(given["style"].lower()))
                    named = _named(name) if name and not gone and (not skip or skip in self.forms) else set()
                    if inside:
                        named -= _HEADER
                    if gone or named and not block:
                        skip = True
                    elif named:  # a block's text is kept, for a name alone can be wrong
                        skip = len(self.never)
                        self.never.append(bool(named & _NEVER))
                if role in ("main", "article") and skip is not True:
                    inside = max(inside, 1 + (role == "article"))
            if tag == "form" and not skip:
                skip = len(self.never)
                self.forms.add(skip)
                self.never.append(False)
            if tag in _SKIP or tag == "header" and not inside:
                skip = True
            if tag in ("article", "main") and skip is not True:
                inside = max(inside, 1 + (tag == "article"))
            self.articles |= bool(inside) and not skip
            if tag in _RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag in _VOID or attrs.endswith("/") and not block:
                continue
            node = parent
            if block:
                node = Node(tag if not name else tag + "." + re.sub(r"[^a-z]+", "-", name.lower())[:40])
                parent.children.append(node)
            stack.append((tag, node, skip, inside, block))
            deepest = max(deepest, len(stack))
        flush()
        _room(deepest)
        self.root = _collapsed([root])
        self.nodes: list[Node] = []  # from the root on, parents first
        outline, todo = [], [(self.root, 0)]
        while todo:
            node, depth = todo.pop()
            self.nodes.append(node)
            outline.append(f"{depth}:{node.label}")
            todo += [(c, depth + 1) for c in reversed(node.children)]
        self.outline = " ".join(outline)

    @staticmethod
    def _close(stack, tags, scope, pop_to):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                pop_to(k)
                return
            if stack[k][0] in scope or stack[k][0] in ("article", "section", "div", "main", "body") and "p" not in tags:
                return
            if "p" in tags and stack[k][4]:
                return


def _room(depth: int) -> None:
    """Let functions call themselves for each level of a tree."""
    if sys.getrecursionlimit() < 8 * depth + 1000:
        sys.setrecursionlimit(8 * depth + 1000)


def _collapsed(run: list[Node]) -> Node:
    """The elements of one run as a node with members, whose children are collapsed: runs of
    siblings with one label become one, and so do all children of one label if the run has
    several elements or the element is a long list."""
    first = run[0]
    first.members = [n.texts for n in run if n.texts]
    children = [c for n in run for c in n.children]
    runs: list[list[Node]] = []
    for child in children:
        if runs and runs[-1][0].label == child.label:
            runs[-1].append(child)
        else:
            runs.append([child])
    if len(run) > 1 or len(runs) > _LIST:
        runs = _by(runs, lambda label: label)
        if len(runs) > _LIST:
            runs = _by(runs, lambda label: label.partition(".")[0])
            for r in runs:
                r[0].label = r[0].label.partition(".")[0]
    first.children = [_collapsed(r) for r in runs]
    return first


def _by(runs: list[list[Node]], key) -> list[list[Node]]:
    """Runs of one key together, in order of first appearance."""
    out: dict[str, list[Node]] = {}
    for r in runs:
        out.setdefault(key(r[0].label), []).extend(r)
    return list(out.values())


class Shape:
    """A node of an outline: a label, the pages that have it, and children."""

    __slots__ = ("label", "pages", "children")

    def __init__(self, label: str, pages: int):
        self.label, self.pages, self.children = label, pages, []

    @classmethod
    def parse(cls, outline: str, pages: int | None = None) -> Shape:
        """Of ``depth:label`` for each node, or ``depth:label:pages`` if not given."""
        path: list[Shape] = []
        root = None
        for token in outline.split(" "):
            depth, _, label = token.partition(":")
            if pages is None:
                label, _, n = label.rpartition(":")
            node = cls(label, int(n) if pages is None else pages)
            del path[int(depth) :]
            if path:
                path[-1].children.append(node)
            else:
                root = node
            path.append(node)
        return root

    def walk(self):
        """Nodes with their depth and path of labels, parents first."""
        todo = [(self, 0, "")]
        while todo:
            node, depth, path = todo.pop()
            path = f"{path}/{node.label}"
            yield node, depth, path
            todo += [(c, depth + 1, path) for c in reversed(node.children)]

    def dump(self) -> str:
        return " ".join(f"{depth}:{node.label}:{node.pages}" for node, depth, _ in self.walk())


class Matching:
    """Simple tree matching of two trees. Sizes are kept, so each pair of nodes that can
    match is looked at once."""

    def __init__(self):
        self.sizes: dict[tuple[int, int], int] = {}

    def size(self, a, b) -> int:
        """The largest number of matched nodes of two trees whose roots match."""
        if a.label != b.label:
            return 0
        key = (id(a), id(b))
        if key not in self.sizes:
            self.sizes[key] = 1 + self._best(a.children, b.children)[-1][-1]
        return self.sizes[key]

    def _best(self, a: list, b: list) -> list[list[int]]:
        best = [[0] * (len(b) + 1)]
        for x in a:
            row, above = [0], best[-1]
            for j, y in enumerate(b):
                row.append(max(above[j + 1], row[j], above[j] + self.size(x, y)))
            best.append(row)
        return best

    def pairs(self, a: list, b: list) -> list[tuple[int, int]]:
        """The ordered pairs of two lists of children, of equal label, with the largest
        number of matched nodes below."""
        names = [x.label for x in a]
        if names == [y.label for y in b] and len(set(names)) == len(names):
            return [(i, i) for i in range(len(a))]  # no other pairs have equal labels
        best, out, i, j = self._best(a, b), [], len(a), len(b)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                out.append((i - 1, j - 1))
                i, j = i - 1, j - 1
        return out[::-1]


def merge(into: Shape, other: Shape) -> None:
    """Merge a tree into a template: matched nodes add up, others take their place."""
    matching, todo = Matching(), [(into, other)]
    while todo:
        t, o = todo.pop()
        t.pages += o.pages
        to = {j: i for i, j in matching.pairs(t.children, o.children)}
        out, at = [], 0
        for j, child in enumerate(o.children):
            if j in to:
                out += t.children[at : to[j] + 1]
                at = to[j] + 1
                todo.append((out[-1], child))
            else:
                out.append(child)
        t.children = out + t.children[at:]


def places(outline: str, template: Shape | None) -> list[tuple[int, str]]:
    """For each node of an outline, the template's slot that it is aligned with, or -1, and
    its path of labels."""
    root = Shape.parse(outline, 1)
    slot: dict[int, int] = {}
    if template is not None and template.label == root.label:
        number = {id(node): k for k, (node, _, _) in enumerate(template.walk())}
        matching, todo = Matching(), [(template, root)]
        while todo:
            t, o = todo.pop()
            slot[id(o)] = number[id(t)]
            todo += [(t.children[i], o.children[j]) for i, j in matching.pairs(t.children, o.children)]
    return [(slot.get(id(node), -1), path) for node, _, path in root.walk()]


class Host:
    """A host's template, with the places of the outlines seen last."""

    def __init__(self, template: str | None):
        self.template, self.seen = Shape.parse(template) if template else None, {}
        if self.template is not None:
            _room(max(d for _, d, _ in self.template.walk()))

    def placed(self, page: Page) -> list[tuple[int, int, int, list[int]]]:
        """``slot, path, text`` as hashes and the blocks of every member with text."""
        at = self.seen.get(page.outline)
        if at is None:
            if len(self.seen) > 2000:
                self.seen.clear()
            at = [(_hash(f"slot {k}") if k >= 0 else 0, _hash(path)) for k, path in places(page.outline, self.template)]
            self.seen[page.outline] = at
        return [(slot, path, _hash("\n".join(t for _, t in m)), [i for i, _ in m]) for node, (slot, path) in zip(page.nodes, at, strict=True) for m in node.members]


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    n = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def _joint(place: int, text: int) -> int:
    """One signed long of a place and a text, as a constant is remembered."""
    return _hash(f"{place}\0{text}")


def _chosen(page: Page, fixed: set[int] | None = None) -> list[int]:
    """The blocks to take. What a name or a form alone hides is taken if no article is marked outside
    and else the page would be empty, or if it is most of the text that isn't ``fixed``
    (of an article marked in it, or of a form, with or without a template)."""
    chosen = [i for i, (_, inside) in enumerate(page.blocks) if not page.hidden[i] and (inside or not page.articles)]
    if page.articles and not chosen:
        chosen = [i for i in range(len(page.blocks)) if not page.hidden[i]]
    if not page.articles and any(page.hidden):
        size: dict[int, int] = {}
        for i, (text, _) in enumerate(page.blocks):
            if not page.never[page.hidden[i]]:
                size[page.hidden[i]] = size.get(page.hidden[i], 0) + (0 if fixed and i in fixed else len(text))
        rule = max((r for r in size if r), key=lambda r: size[r], default=0)
        if rule and size[rule]:
            own = [i for i in range(len(page.blocks)) if page.hidden[i] == rule]
            marked = [i for i in own if page.blocks[i][1]]
            most = 2 * size[rule] > sum(size.values())
            if marked and (most or not chosen):
                chosen = marked
            elif most and (fixed or rule in page.forms) or not chosen:
                chosen = sorted(chosen + own)
    return chosen


def extract(source: str | None, host: Host | None = None, constant: set[int] | None = None) -> str:
    """The main text of one page, blocks joined by newlines. ``constant`` has the places with
    their texts that :func:`constants` found."""
    if not source:
        return ""
    page = Page(source)
    fixed: set[int] = set()
    if constant:
        for slot, path, text, blocks in (host or Host(None)).placed(page):
            if slot and _joint(slot, text) in constant or _joint(path, text) in constant:
                fixed.update(blocks)
    chosen = _chosen(page, fixed)
    own = [i for i in chosen if i not in fixed]
    within = [i for i in own if page.blocks[i][1] == 2]
    chosen = [i for i in chosen if i not in fixed or within and page.blocks[i][1] == 2 and within[0] < i < within[-1]] if own else chosen
    return "\n".join(page.blocks[i][0] for i in chosen)


_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)"


def _hosted(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), _HOST, 1)
    return pages.select(host.alias("host"), F.col(html_col).cast("string").alias("html")).where("host <> '' and html is not null")


def _merged(rows: DataFrame) -> DataFrame:
    """One template for each ``host`` and ``part`` of ``host, part, rank, template``, of
    which a part has about ``_FAN``."""

    def one(pdf):
        pdf = pdf.sort_values(["rank", "template"], kind="stable")
        shapes = [Shape.parse(t) for t in pdf.template]
        for s in shapes:
            _room(max(d for _, d, _ in s.walk()))
        for s in shapes[1:]:
            merge(shapes[0], s)
        return pdf.iloc[:1].assign(rank=pdf.part.iloc[0], template=shapes[0].dump())

    return rows.groupBy("host", "part").applyInPandas(one, "host string, part long, rank long, template string")


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, template``: the outlines of all pages of a host in one."""

    def outlines(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Page(t.as_py()).outline for t in batch.column(1)], pa.string())], ["host", "outline"])

    rows = _hosted(pages, url_col, html_col).mapInArrow(outlines, "host string, outline string")
    rows = materialize(rows.groupBy("host", "outline").agg(F.count("*").alias("pages")), "outlines")
    hosts = materialize(rows.groupBy("host").agg(F.count("*").alias("of")), "outline-counts")
    most = hosts.agg(F.max("of")).first()[0] or 0
    part = F.expr(f"pmod(xxhash64(outline), (of + {_FAN - 1}) div {_FAN})")
    parts = join_checked(rows, hosts, "host").select("host", part.alias("part"), (-F.col("pages")).alias("rank"), F.regexp_replace("outline", "( |$)", F.concat(F.lit(":"), F.col("pages").cast("string"), F.lit("$1"))).alias("template"))
    parts, left = materialize(_merged(parts), "templates"), -(-most // _FAN)
    while left > 1:
        left = -(-left // _FAN)
        parts, last = materialize(_merged(parts.withColumn("part", F.expr(f"part div {_FAN}"))), "templates"), parts
        release(last)
    release(rows, hosts)

    def supported(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1):
                root = Shape.parse(raw.as_py())
                for node, _, _ in root.walk():
                    node.children = [c for c in node.children if c.pages >= MIN_SUPPORT]
                out.append(root.dump())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "template"])

    return materialize(parts.select("host", "template").mapInArrow(supported, "host string, template string"), "host-templates")


def _with_templates(rows: DataFrame, templates: DataFrame, broadcast_chars: int) -> DataFrame:
    """``rows`` with their host's columns, which are broadcast if they are counted to be few."""
    size = sum(F.length(c) if t == "string" else 8 * F.size(c) for c, t in templates.dtypes)
    size = templates.agg(F.coalesce(F.sum(F.coalesce(size, F.lit(0)) + 100), F.lit(0))).first()[0]
    return rows.join(F.broadcast(templates) if size <= broadcast_chars else templates, "host", "left")


class _Hosts(dict):
    """Templates and constants by host, of some hundred hosts at once."""

    def of(self, name: str | None, template, constant=None) -> tuple[Host, set[int]]:
        if name not in self:
            if len(self) > 500:
                self.clear()
            self[name] = Host(template.as_py()), set(constant.as_py() or ()) if constant is not None else set()
        return self[name]


def constants(pages: DataFrame, templates: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_chars: int = 16 << 20) -> DataFrame:
    """``host, constant``: the places with texts that ``CONSTANT_SHARE`` of a host's different
    page contents with that place have, as hashes."""
    rows = _with_templates(_hosted(pages, url_col, html_col), templates, broadcast_chars)

    def seen(batches):
        hosts = _Hosts()
        for batch in batches:
            out: set[tuple] = set()
            for host, source, template in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                page = Page(source.as_py())
                # the marked article's text or, without one, what no final rule hides
                own = [i for i in range(len(page.blocks)) if not page.never[page.hidden[i]]]
                own = [i for i in own if page.blocks[i][1]] or own
                content = _hash("\n".join(page.blocks[i][0] for i in own))
                for slot, path, text, _ in hosts.of(host, template)[0].placed(page):
                    for place in (slot, path) if slot else (path,):
                        out |= {(host, place, _joint(place, text), content), (host, place, None, content)}
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], ["host", "place", "text", "content"])

    found = rows.select("host", "html", "template").mapInArrow(seen, "host string, place long, text long, content long").distinct()
    counts = materialize(found.groupBy("host", "place", "text").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT * CONSTANT_SHARE), "placed-texts")
    whole = counts.where("text is null").where(F.col("n") >= MIN_SUPPORT).select("host", "place", F.col("n").alias("of"))
    fixed = counts.where("text is not null").join(whole, ["host", "place"]).where(F.col("n") >= F.col("of") * CONSTANT_SHARE)
    out = materialize(fixed.groupBy("host").agg(F.sort_array(F.collect_set("text")).alias("constant")), "constants")
    release(counts)
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_chars: int = 16 << 20) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    templates = induce(pages, url_col, html_col)
    # a host without a constant text needs no template
    known = materialize(constants(pages, templates, url_col, html_col, broadcast_chars).join(templates, "host"), "wrappers")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = _with_templates(rows.withColumn("host", F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), _HOST, 1)), known, broadcast_chars)

    def run(batches):
        hosts = _Hosts()
        for batch in batches:
            out = []
            for source, host, template, constant in zip(*batch.columns[2:], strict=True):
                out.append(extract(source.as_py(), *hosts.of(host.as_py(), template, constant)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "host", "template", "constant").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
