"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over the tokens of a host's pages: elements, text
slots (`#`), repeated groups `( )+` and optional groups `( )?`. It starts as the token stream
of one page with tandem repeats folded; each further page of the host is aligned with it
element by element. Where the streams differ, a side that repeats what the other has once
makes a repeated group, what only one side has becomes optional, and text that differs is a
slot. Every node counts its pages, and every slot its text, its link text, and whether it
ever differed.

A host's wrapper then gives its plan: which node holds the article, and which nodes in it are
left out or kept against first sight. Extraction aligns every whole page with the plan: text
in slots of the article belongs to it, text in slots of left-out nodes does not, and elements
that the wrapper does not know are judged by their own tag.

Wrappers are folded within each task, page by page, then merged per host in two steps, so no
task holds the pages of a host. A wrapper is whole: every element that holds text on some page
of the host is a node, however few pages have it. What grows beyond `NODES_KEPT` in a task is
handed on and merged, not cut; the merging task holds the distinct nodes of a host. The
table of plans has one short row per host; it is broadcast only if its measured size is
small, else joined with the host's pages spread over salts.

Defined results: null html counts as empty and gives empty text; a null url is a host of its
own; pages that lack the article node of their host's plan are judged by a wrapper of their
own; of nodes that look alike the later and inner one holds the article; repeated rows each
get their row; pages without any article give the text of the body outside the left-out
parts; elements nested deeper than `DEPTH` belong to the one at that depth. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import all_salts, read_table, salt, small_batches, written

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe svg math object canvas textarea title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold menus, page headers and footers, sidebars, notices, adverts and forms.
OUTSIDE = frozenset("nav header footer aside form button select menu dialog label fieldset".split())
#: The same, and reader comments, by a word of a class, id or role.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar aside "
    "footer masthead topbar header notice notices alert cookie cookies consent gdpr newsletter subscribe signup login search social share sharing "
    "related recommended widget popup modal overlay comment comments reply replies respond disqus pagination pager toolbar skip copyright legal "
    "complementary contentinfo search dialog".split()
)
#: Elements whose start or end bounds a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the second kind ends an open element of the first.
ENDED_BY = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Start tags that do not reach out of these elements.
SCOPES = frozenset("table td th body html article main section div".split())
INLINE = frozenset("a b i u s em strong small big span font br wbr sub sup code tt mark abbr cite q time img".split())
#: Elements that hold the text itself; a doubtful mark alone does not rule them out.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption td th caption span a b i em strong header".split())
#: Elements without a mark that are alike only if their children are.
BARE = frozenset("div section table ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that cannot be the article's container.
NO_CONTAINER = frozenset("html p li ul ol dl dt dd tr td th h1 h2 h3 h4 h5 h6 hr pre caption figcaption legend summary".split())
MAIN_WORDS = frozenset("article main content post entry story body-text articlebody".split())
#: Start tags that end some other open element.
ENDERS = BLOCKS | {"optgroup", "option"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^\"'>]|\"[^\"]*\"|'[^']*')*>", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
#: Levels of elements that a wrapper knows.
DEPTH = 100
#: Nodes of a wrapper, and of all wrappers of a task, from which wrappers are handed on.
NODES_KEPT, TASK_NODES = 20_000, 200_000
#: Pages from which text that never differs is told from text that does.
SURE_PAGES = 3
#: Share of a container's text from which a container inside it is preferred.
NEARLY_ALL = 0.8
#: A plan table of at most this many bytes is broadcast.
BROADCAST_BYTES = 8 << 20
SALTS = 32
SLOT = "#"


@lru_cache(4096)
def signature(tag: str) -> tuple[str, str]:
    """Name and signature of a start tag: the name, its first mark without digits, and `!` or `?`
    if a whole mark or a word of one is that of a part outside the article."""
    name = NAME.match(tag)[1].lower()
    marks = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in MARKS.finditer(tag)}
    tokens = {t for v in marks.values() for t in v.split()}
    words = {w for t in tokens for w in WORDS.findall(t)}
    doubt = "" if name in ("html", "body") else "!" if tokens & OUTSIDE_WORDS else "?" if words & OUTSIDE_WORDS else ""
    first = (marks.get("id") or marks.get("class") or marks.get("role") or "").split()
    return name, f"{name}.{DIGITS.sub('0', first[0].rstrip('!?'))}{doubt}" if first else name


def parts_of(sign: str) -> tuple[str, str, str]:
    """Name, mark and doubt of a signature."""
    doubt = sign[-1] if sign[-1:] in ("!", "?") else ""
    name, _, mark = sign.removesuffix(doubt).partition(".")
    return name, mark, doubt


@lru_cache(4096)
def leaves(sign: str) -> bool:
    """Whether an element is outside the article by itself, wherever it stands."""
    name, _, doubt = parts_of(sign)
    if name in OUTSIDE or name in RAW:
        return name != "header"
    return doubt == "!" or (doubt == "?" and name not in PROSE and name not in ("article", "main"))


def walk(page: str) -> Iterator[tuple[str, object]]:
    """Events of a page: ("open", (name, signature)), ("void", the same), ("close", name), ("text", str).

    Elements end where HTML ends them: at their end tag, at the end of an element around
    them, or where a tag that they cannot hold begins. Raw elements give no text.
    """
    stack: list[str] = []
    open_: Counter[str] = Counter()
    at, n = 0, len(page)

    def pop() -> tuple[str, str]:
        open_[stack[-1]] -= 1
        return "close", stack.pop()

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            yield "text", page[at:]
            break
        if m.start() > at:
            yield "text", page[at : m.start()]
        tag, at = m[0], m.end()
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                yield "text", tag[9:-3]
            continue
        name = NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if open_[name]:
                ended = None
                while ended != name:
                    closed = pop()
                    ended = closed[1]
                    yield closed
            elif name == "br":
                yield "text", " "
            continue
        seen = signature(tag)
        for k in range(len(stack) - 1, -1, -1) if name in ENDERS else ():
            if name in ENDED_BY.get(stack[k], ()):
                while len(stack) > k:
                    yield pop()
                break
            if stack[k] in SCOPES:
                break
        if name in VOID or tag.endswith("/>"):
            yield "text" if name == "br" else "void", " " if name == "br" else seen
            continue
        if name in RAW and name != "head":
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            yield "void", seen
            at = end.end() if end else n
            continue
        stack.append(name)
        open_[name] += 1
        yield "open", seen
    while stack:
        yield pop()


# ---------------------------------------------------------------- wrappers


class Node:
    """A part of a wrapper: an element, a text slot, or a group of several (its signature in brackets).

    pages counts the pages that have it; chars, links, low and high are a slot's characters,
    those in links, and the least and largest digest of its text on a page.
    """

    __slots__ = ("sign", "many", "pages", "chars", "links", "low", "high", "items")

    def __init__(self, sign: str, items: list | None = None, many: bool = False, pages: int = 1, chars: int = 0, links: int = 0, low: int = 0, high: int = 0):
        self.sign, self.many, self.pages, self.chars, self.links, self.low, self.high = sign, many, pages, chars, links, low, high
        self.items: list[Node] = [] if items is None else items

    def as_list(self) -> list:
        return [self.sign, int(self.many), self.pages, self.chars, self.links, self.low, self.high, [n.as_list() for n in self.items]]

    @classmethod
    def of_list(cls, x: list) -> Node:
        return cls(x[0], [cls.of_list(n) for n in x[7]], bool(x[1]), *x[2:7])

    def size(self) -> int:
        return 1 + sum(n.size() for n in self.items)

    def show(self, above: int = 0) -> str:
        """Readable form: tokens by spaces, ( )+ repeated and ( )? optional groups."""
        inner = " ".join(n.show(self.pages) for n in self.items)
        text = SLOT if self.sign == SLOT else inner if self.sign[:1] in ("", "(") else f"<{self.sign} {inner} </{parts_of(self.sign)[0]}".replace("  ", " ")
        text = f"( {text} )+" if self.many else text
        return f"( {text} )?" if self.pages < above else text


def absorb(a: Node, b: Node, one_page: bool) -> None:
    """Make a accept what b accepts; both have one signature."""
    a.many |= b.many
    a.chars += b.chars
    a.links += b.links
    if one_page:  # parts of one page: its text is what both hold
        a.low = a.high = crc32(b.low.to_bytes(4, "little"), a.low)
    else:
        a.pages += b.pages
        a.low, a.high = min(a.low, b.low), max(a.high, b.high)
    if b.items:
        a.items = align(a.items, b.items, one_page) if a.items else b.items


def align(left: list[Node], right: list[Node], one_page: bool) -> list[Node]:
    """Items that accept what either list accepts, as far as union-free expressions can."""
    if [n.sign for n in left] != [n.sign for n in right]:
        left, right = regroup(left, right), regroup(right, left)
    a, b = [n.sign for n in left], [n.sign for n in right]
    out: list[Node] = []
    for kind, i, j, k, m in [("equal", 0, len(a), 0, len(b))] if a == b else difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(left[i:j], right[k:m]):
                absorb(x, y, one_page)
                out.append(x)
        else:
            out += left[i:j] + right[k:m]
    return out


def regroup(items: list[Node], other: list[Node]) -> list[Node]:
    """Items in which a group that only the other list has stands as that group, even once."""
    for group in other:
        unit = [n.sign for n in group.items]
        if group.sign[:1] != "(" or any(n.sign == group.sign for n in items):
            continue
        signs, k, out = [n.sign for n in items], 0, []
        while k < len(items):
            if signs[k : k + len(unit)] == unit:
                out.append(Node(group.sign, items[k : k + len(unit)], pages=items[k].pages))
                k += len(unit)
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def alike(a: Node, b: Node) -> bool:
    return a.sign == b.sign != SLOT and (a.sign not in BARE or [n.sign for n in a.items] == [n.sign for n in b.items])


def fold(items: list[Node]) -> list[Node]:
    """Tandem repeats become repeated groups: of one element first, then of longer units."""
    if len({n.sign for n in items}) == len(items):
        return items
    out: list[Node] = []
    for n in items:
        if out and alike(out[-1], n):
            absorb(out[-1], n, True)
            out[-1].many = True
        else:
            out.append(n)
    while len({n.sign for n in out}) < len(out):
        numbers: dict[str, int] = {}
        codes = np.array([numbers.setdefault(n.sign, len(numbers)) for n in out])
        last: dict[int, int] = {}
        steps = set()
        for k, c in enumerate(codes.tolist()):
            steps.add(k - last.get(c, k))
            last[c] = k
        found = None
        for step in sorted(x for x in steps if 2 <= x <= len(out) // 2):
            same = np.concatenate([[0], codes[:-step] == codes[step:], [0]]).astype(np.int8)
            edges = np.flatnonzero(np.diff(same))
            long = np.flatnonzero(edges[1::2] - edges[::2] >= step)
            if len(long):
                found = step, int(edges[::2][long[0]]), int((edges[1::2] - edges[::2])[long[0]]) // step + 1
                break
        if not found:
            break
        step, at, times = found
        group = Node("(" + " ".join(n.sign for n in out[at : at + step]) + ")", out[at : at + step], many=True)
        for k in range(1, times):
            absorb(group, Node(group.sign, out[at + k * step : at + (k + 1) * step]), True)
        out[at : at + times * step] = [group]
    return out


def page_tree(page: str) -> Node:
    """The folded token stream of a page; inline elements are no tokens, link text is marked.

    Elements without text say nothing of a page and are no tokens either, but for headings,
    by which a header is known.
    """
    root = Node("")
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]  # node, whether its own, inside a link
    for kind, x in walk(page):
        top, _, link = stack[-1]
        if kind == "open":
            name, sign = x
            if name in INLINE or len(stack) > DEPTH:
                stack.append((top, False, link or name == "a"))
            else:
                top.items.append(node := Node(sign))
                stack.append((node, True, link))
        elif kind == "close":
            node, own, _ = stack.pop()
            if own and not node.items and parts_of(node.sign)[0] not in HEADINGS:
                stack[-1][0].items.pop()
            elif own:
                node.items = fold(node.items)
        elif kind == "text" and x and not x.isspace():
            if not top.items or top.items[-1].sign != SLOT:
                top.items.append(Node(SLOT))
            slot = top.items[-1]
            slot.chars += len(x)
            slot.links += len(x) * link
            slot.low = slot.high = crc32(x.encode("utf-8", "replace"), slot.low)
    root.items = fold(root.items)
    return root


class HostWrapper:
    """Wrapper of a host under construction."""

    def __init__(self, root: Node | None = None):
        self.root = root
        self.nodes = root.size() if root else 0

    def add(self, root: Node) -> None:
        size = root.size()
        if self.root is None:
            self.root, self.nodes = root, size
            return
        absorb(self.root, root, False)
        self.nodes += size  # at most

    def add_page(self, page: str) -> None:
        self.add(page_tree(page))

    def is_full(self) -> bool:
        """Whether there are too many nodes for further pages; counted when it seems so."""
        if self.nodes > NODES_KEPT:
            self.nodes = self.root.size()
        return self.nodes > NODES_KEPT

    def as_row(self) -> str:
        return json.dumps(self.root.as_list(), separators=(",", ":"))


# ---------------------------------------------------------------- plans

#: What a plan says of a node: nothing, it holds the article, it is left out, it is kept.
PLAIN, ARTICLE, LEFT, KEPT = range(4)


def plan(root: Node) -> str:
    """Plan of a wrapper, as JSON of [signature, what it says, [nodes]]; "" if no node holds an article.

    Articles and main parts by name come first, then the container with the most text that is
    not link text and differs between pages. A container inside it with nearly all its text
    is preferred.
    """
    known: list[tuple] = []  # node, chars, links, whether text differs, first and last place inside

    def sums(node: Node, out: bool) -> tuple[int, int, bool]:
        out = out or (node.sign not in ("", SLOT) and node.sign[0] != "(" and leaves(node.sign)) or parts_of(node.sign)[0] == "header"
        if node.sign == SLOT:
            return (0, 0, False) if out else (node.chars, node.links, node.low != node.high)
        place = len(known)
        known.append(())
        chars, links, differs = 0, 0, False
        for n in node.items:
            c, link, d = sums(n, out)
            chars, links, differs = chars + c, links + link, differs or d
        known[place] = (node, chars, links, differs, place, len(known), out)
        return chars, links, differs

    sums(root, False)
    best: tuple = ()
    for node, chars, links, differs, first, last, out in known:
        name, mark, _ = parts_of(node.sign)
        if out or name not in BLOCKS or name in NO_CONTAINER or chars <= 2 * links:
            continue
        named = 3 if name == "article" else 2 if name == "main" else 1 if set(WORDS.findall(mark)) & MAIN_WORDS else 0
        text = chars - 2 * links
        inner = best and best[0] == named and best[1] == differs and first < best[5] and text >= NEARLY_ALL * best[2]
        if not best or inner or (named, differs, text) >= best[:3]:
            best = (named, differs, text, node, first, last)
    if not best:
        return ""
    sign, sure = best[3].sign, best[1]

    def told(node: Node, inside: bool, out: bool) -> list:
        says, name = PLAIN, parts_of(node.sign)[0]
        if node.sign[:1] == "(":
            items = [told(n, inside, out) for n in node.items]
        else:
            if not inside and not out and node.sign == sign:
                says = ARTICLE
            elif inside and not out:
                if leaves(node.sign) and has_heading(node) and "header" in WORDS.findall(node.sign) and name not in OUTSIDE:
                    says = KEPT
                elif not leaves(node.sign) and node.sign[-1] == "?" and no_prose(node, sure):
                    says = LEFT
            gone = out or says == LEFT or (says not in (ARTICLE, KEPT) and (leaves(node.sign) or (name == "header" and not inside)) if node.sign else False)
            items = [told(n, inside or says == ARTICLE, gone) for n in node.items if n.sign != SLOT]
        flat = [x for i in items for x in (i[2] if i[0][:1] == "(" else [i])]
        needed = {i[0] for i in flat if i[1] != PLAIN or i[2]}
        return [node.sign, says, [i for i in flat if i[0] in needed]]

    return json.dumps([sign, told(root, False, False)[2]], separators=(",", ":"))


def has_heading(node: Node) -> bool:
    return any(parts_of(n.sign)[0] in HEADINGS or has_heading(n) for n in node.items)


def slots(node: Node) -> Iterator[Node]:
    for n in node.items:
        if n.sign == SLOT:
            yield n
        else:
            yield from slots(n)


def no_prose(node: Node, sure: bool) -> bool:
    """Whether a doubtful node is mostly links, or the same on many pages whose articles differ."""
    held = list(slots(node))
    chars, links = sum(s.chars for s in held), sum(s.links for s in held)
    same = sure and node.pages >= SURE_PAGES and all(s.low == s.high for s in held)
    return 2 * links >= chars > 0 or same


# ---------------------------------------------------------------- extraction


class Told:
    """A node of a plan, with its nodes by signature in their order."""

    __slots__ = ("says", "by")

    def __init__(self, says: int, items: list):
        self.says = says
        self.by: dict[str, list[tuple[int, Told]]] = {}
        for k, (sign, what, inner) in enumerate(items):
            self.by.setdefault(sign, []).append((k, Told(what, inner)))


@lru_cache(256)
def read_plan(text: str) -> tuple[str, Told]:
    sign, items = json.loads(text)
    return sign, Told(PLAIN, items)


def extract_text(page: str | None, host_plan: str | None = None) -> str:
    """Blocks of the article, in page order, without the left-out parts in it."""
    if not page:
        return ""
    text, found = _blocks(page, host_plan or "")
    if not found:
        own = plan(page_tree(page))
        if own != host_plan:
            text, found = _blocks(page, own)
    return text


def _blocks(page: str, host_plan: str) -> tuple[str, bool]:
    container, root = read_plan(host_plan) if host_plan else ("", Told(PLAIN, []))
    blocks, parts, found = [], [], False
    # inside the article, inside a left-out part, node of the plan, place reached among its nodes
    stack: list[list] = [[not container, False, root, -1]]

    def end() -> None:
        if parts and (block := " ".join(htmllib.unescape("".join(parts)).split())):
            blocks.append(block)
        parts.clear()

    for kind, x in walk(page):
        inside, out, node, reached = top = stack[-1]
        if kind == "text":
            if inside and not out:
                parts.append(x)
        elif kind == "close":
            stack.pop()
            if x in BLOCKS:
                end()
        else:
            name, sign = x
            if name in BLOCKS:
                end()
            if kind != "open":
                continue
            if name in INLINE or len(stack) > DEPTH:
                stack.append([inside, out or leaves(sign), node if name in INLINE else None, reached])
                continue
            told = None
            if node is not None and sign in node.by:
                # the same node again (a repeated one), else the next of its kind, else the last
                same = node.by[sign]
                k, told = next((n for n in same if n[0] >= reached), same[-1])
                top[3] = k
            says = told.says if told else PLAIN
            here = not inside and not out and (says == ARTICLE or (says == PLAIN and sign == container))
            found = found or here
            gone = says == LEFT or (says != KEPT and not here and (leaves(sign) or (name == "header" and not inside)))
            stack.append([inside or here, out or gone, told, -1])
    end()
    return "\n".join(blocks), found


# ---------------------------------------------------------------- DataFrames

PARTIAL = "host string, part int, wrapper string"
PLANS = "host string, wrapper string, plan string"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null and odd URLs share the empty host."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: host, wrapper (JSON), plan."""
    small_batches(pages.sparkSession)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts: dict[str, HostWrapper] = {}
        part, nodes = TaskContext.get().partitionId() % 32, 0

        def rows(done: dict[str, HostWrapper]) -> pd.DataFrame:
            return pd.DataFrame([(h, part, w.as_row()) for h, w in sorted(done.items())], columns=["host", "part", "wrapper"])

        for batch in batches:
            for host, page in zip(batch["host"], batch["html"]):
                if page:
                    w = hosts.setdefault(host, HostWrapper())
                    nodes -= w.nodes
                    w.add_page(page)
                    if w.is_full():
                        yield rows({host: hosts.pop(host)})
                        continue
                    nodes += w.nodes
                    if nodes > TASK_NODES:  # a task holds so many at most, and one page
                        yield rows(hosts)
                        hosts.clear()
                        nodes = 0
        yield rows(hosts)

    def merged(group: Iterator[pd.DataFrame]) -> HostWrapper:
        whole = HostWrapper()
        for rows in group:
            for wrapper in sorted(rows["wrapper"]):
                whole.add(Node.of_list(json.loads(wrapper)))
        return whole

    def some(key: tuple, group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], key[1], merged(group).as_row())], columns=["host", "part", "wrapper"])

    def one(key: tuple, group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = merged(group)
        yield pd.DataFrame([(key[0], whole.as_row(), plan(whole.root))], columns=["host", "wrapper", "plan"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(partial, PARTIAL)
    return rows.groupBy("host", "part").applyInPandas(some, PARTIAL).groupBy("host").applyInPandas(one, PLANS)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host for every row of pages."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    plans = written(infer_wrappers(pages), "wrappers").select("host", "plan")
    size = plans.agg(F.sum(F.octet_length("host") + F.octet_length("plan") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(plans), "host", "left")
    else:
        spread = rows.withColumn("salt", salt([F.col("page_id"), F.col("url")], SALTS))
        joined = spread.join(plans.withColumn("salt", all_salts(SALTS)), ["host", "salt"], "left")

    @F.pandas_udf("string")
    def text(htmls: pd.Series, plans: pd.Series) -> pd.Series:
        return pd.Series([extract_text(h, p) for h, p in zip(htmls, plans)], dtype=object)

    out = joined.select("page_id", "url", text("html", "plan").alias("text"), "host")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
