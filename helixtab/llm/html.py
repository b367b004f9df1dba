"""Main text of web pages by equivalence classes of tokens that deduce each host's template.

Tokens of a page: its elements, each known by its path with class names (start and end tag, so two tokens), the words
of its short blocks and its long blocks as a whole, each with its path. A token's occurrence vector says how often each
page of the host has it; tokens with the same vector form an equivalence class. Vectors are kept as sums of page hashes
times counts, so classes come out of aggregations that combine before the shuffle, and a host with a third of all pages
is no task of its own. A class is valid if it has an element, is on SUPPORT pages and on SHARE of its host's, and these
pages are not all copies of one; so a text that pages copy from each other is no template. Valid classes are nested by
the paths of their elements. Their text tokens are the template's constant text, and what is left at their elements are
its slots, with the characters that all pages of the host have there.

The slots decide what is extracted: from the root of the nested classes the way goes down to the class whose slots
hold most of what its parent holds, or to several if they take turns on different pages (page types). Article and main
elements that hold half are taken at once; a page's h1 stays. The main text is what a page has in these slots,
without constant blocks and without what is marked as a menu, header, footer, sidebar, notice, advert, form or comment
by its element or by a whole class name. A form that the page's content is in (an article, main or h1 element, or as a child
of body half of the text, with paragraphs) is none. A button or choice that isn't closed ends where a block begins that it can't hold. A page that has none of the host's content elements, or whose host has no
template, is a host of its own here: the same way down, over its own elements.

Nulls: a null html is empty (no text), a null url has the empty host. Repeated rows count as pages. Hosts of fewer than
SUPPORT pages, or of copies only, have no template. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtab.llm.shared import join_small, written

#: Pages and share of its host's pages that a class must be on; words of a block that are tokens apart.
SUPPORT, SHARE, SHORT = 3, 0.05, 12
#: Share of a class's slot text that a nested one must hold for the way to go on there, and for article or main.
MOST, HALF = 0.7, 0.5
#: Tokens of pages that a task sums before it passes them on, paths whose hashes a worker remembers, and hashes in all hosts'
#: templates up to which they are broadcast.
HELD, PATHS, SMALL = 500_000, 200_000, 4_000_000

# Element names of HTML by what they mean here, and class names of what is no main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
OUTSIDE = set("aside button canvas datalist dialog footer head iframe map menu nav object option select svg title video audio".split())
CONTROLS = set("button datalist option select title".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HOLDS = set("article body center div html main section table tbody td tr".split())
LABELS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promotion promoted recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
PLACES = set("area bar block box bottom container form global inner item items left links list main outer page policy post posts primary right secondary section site thread top wrap wrapper".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|textarea|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</\s*([a-zA-Z][\w:-]*)[^>]*>"
    r"|<([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/][^<>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)


class Hashes(dict):
    """text -> XXH64 as a signed long, remembered for up to PATHS texts."""

    def __missing__(self, text: str) -> int:
        if len(self) >= PATHS:
            self.clear()
        h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
        self[text] = h = h - (1 << 64) if h >> 63 else h
        return h


_hashes = Hashes()


@dataclass
class Element:
    """An element path of a page: its parent path's hash, how often it is there, the characters of main text right in
    it, and what it is: an article or main, an h1, one that holds blocks."""

    up: int
    depth: int
    main: bool
    head: bool
    holds: bool
    times: int = 0
    chars: int = 0


@dataclass
class Block:
    path: int  #: hash of the element path
    outside: bool  #: marked as no main text
    inside: bool  #: in one of the content elements asked for
    text: str


@dataclass
class Page:
    elements: dict[int, Element] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)


def labelled(names: list[str], in_main: bool) -> bool:
    """If a whole class name says that an element is no main text: its last part does, or its first and the others
    only say where it is. Names such as has-sidebar speak of something else."""
    for name in names:
        parts = [x for x in re.split(r"[^a-z]+", name.lower()) if len(x) > 1]
        if not parts or parts[0] in ("has", "with", "no", "is", "not"):
            continue
        if (parts[-1] in LABELS or (parts[0] in LABELS and all(x in PLACES or x in LABELS for x in parts))) and not (in_main and parts[-1] == "header"):
            return True
    return False


def parse(text: str, content: frozenset[int] = frozenset()) -> Page:
    """The page's elements and its blocks in page order; content: hashes of the paths that blocks are `inside` of."""
    page, held = Page(), []
    root = _hashes[""]
    page.elements[root] = Element(0, 0, False, False, True, 1)
    # element, path, its hash, outside (1: by a name, 2: by what it is), in article or main, inside content, number of its form
    stack = [("", "", root, 0, False, root in content, 0)]
    forms: list[int] = [0]  # characters in each form that only the form speaks against; -1 if it has content elements
    in_forms: list[tuple[int, Block]] = []
    top: set[int] = set()  # forms right in the body
    told: set[int] = set()  # those with paragraphs

    def flush():
        if held:
            block = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if block:
                _, _, at, outside, _, inside, form = stack[-1]
                page.blocks.append(Block(at, outside > 0 or form > 0, inside, block))
                if form and not outside:
                    in_forms.append((form, page.blocks[-1]))
                elif not outside:
                    page.elements[at].chars += len(block)

    for m in _TOKEN.finditer(text):
        closed, opened, piece = m[2], m[3], m[0]
        if opened:
            tag, attributes = opened.lower(), m[4]
            if tag in VOID:
                if tag in ("br", "hr"):
                    flush()
                continue
            inline = tag in INLINE
            if not inline:
                flush()
                if tag in CLOSES_P and tag != "div":
                    i = next((i for i, x in enumerate(stack) if x[0] in CONTROLS), 0)
                    if i:
                        del stack[i:]
                shuts = "p" if tag in CLOSES_P else tag if tag in ("li", "dt", "dd", "tr", "td", "th") else None
                if shuts:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == shuts:
                            del stack[i:]
                            break
                        if stack[i][0] not in INLINE and stack[i][0] != "p":
                            break
            above, path, at, outside, in_main, inside, form = stack[-1]
            names = "".join("".join(g) + " " for g in _NAMED.findall(attributes)).split() if attributes else []
            marked = bool(names) and tag not in ("html", "body") and not (inline and tag == "a") and labelled(names, in_main)
            is_main = tag in ("article", "main") or (tag == "div" and "main" in names)
            if not inline:
                up, path = at, f"{path}/{tag}" + (f".{'.'.join(names)}" if names else "")
                at = _hashes[path]
                if (known := page.elements.get(at)) is None:
                    known = page.elements[at] = Element(up, len(stack), is_main, tag == "h1", tag in HOLDS)
                known.times += 1
                inside = inside or at in content
            if tag == "form" and not form:
                form = len(forms)
                forms.append(0)
                if above in ("", "html", "body"):
                    top.add(form)
            elif form and not outside and (is_main or tag == "h1"):
                forms[form] = -1
            elif tag == "p" and form in top:
                told.add(form)
            if tag in OUTSIDE or (tag == "header" and not in_main):
                outside = 2
            elif is_main and outside == 1 and not marked:
                outside = 0  # a whole article in something that only its name speaks against
            elif not outside and (marked or (attributes and _HIDDEN.search(attributes))):
                if inline:
                    flush()
                outside = 1
            stack.append((tag, path, at, outside, in_main or is_main, inside, form))
        elif closed:
            tag = closed.lower()
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag not in INLINE or (i and stack[i][3] != stack[i - 1][3]):
                flush()
            if i:
                del stack[i:]
        elif piece[0] != "<" or piece == "<":
            held.append(piece)
    flush()
    if in_forms:
        for form, block in in_forms:
            if forms[form] >= 0:
                forms[form] += len(block.text)
        whole = sum(len(b.text) for _, b in in_forms) + sum(len(b.text) for b in page.blocks if not b.outside)
        for form, block in in_forms:
            if forms[form] < 0 or (form in told and forms[form] >= HALF * whole):
                block.outside = False
                page.elements[block.path].chars += len(block.text)
    return page


def text_tokens(path: int, text: str) -> list[tuple[int, int]]:
    """Hash and characters of a block's tokens: its words, or a long block as a whole."""
    w = text.split(" ")
    if len(w) > SHORT:
        return [(_hashes[f"{path} {xxhash.xxh64_hexdigest(text.encode('utf-8', 'replace'))} {len(text)}"], len(text))]
    return [(_hashes[f"{path} {x}"], len(x)) for x in w]


def host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _source(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(host()).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


PAGE, ELEMENT, TEXT = 0, 1, 2
_COLUMNS = ["host", "token", "kind", "up", "depth", "flags", "pages", "times", "low", "high", "first", "last", "chars"]


def occurrences(pages: DataFrame) -> DataFrame:
    """A row for each host and token. kind: the host's pages, an element or a text token; up: the hash of the parent's
    path, or of a text's own; flags: 1 article or main, 2 h1, 4 holds blocks; pages and times it occurs; low and high:
    the occurrence vector's hash; first and last: the least and largest of its pages' hashes; chars: those of main text
    right in an element, or of a text token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int, int, int]] = []  # token, kind, up, depth, flags, times, chars
        whose: list[tuple[int, int, int]] = []  # host, page hash, tokens of each page

        def out():
            token, kind, up, depth, flags, times, chars = np.array(held, np.int64).reshape(-1, 7).T
            name, key, size = np.array([(a, b, c) for a, b, c in whose], np.int64).reshape(-1, 3).T
            name, key = np.repeat(name, size), np.repeat(key.view(np.uint64), size)
            order = np.lexsort((token, name))
            starts = np.flatnonzero(np.diff(name[order], prepend=~name[order[:1]]) | np.diff(token[order], prepend=token[order[:1]]))
            one = order[starts]
            low, high, short = times * (key & np.uint64(0xFFFFFFF)).astype(np.int64), times * (key >> np.uint64(36)).astype(np.int64), (key >> np.uint64(28) & np.uint64(0xFFFF)).astype(np.int64)
            total = lambda x: np.add.reduceat(x[order], starts)
            columns = [name[one], token[one], kind[one], up[one], depth[one], flags[one], np.diff(starts, append=len(order)), total(times), total(low), total(high), np.minimum.reduceat(short[order], starts), np.maximum.reduceat(short[order], starts), total(chars)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _COLUMNS)

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page, before = parse(text), len(held)
                held.append((0, PAGE, 0, 0, 0, 1, 0))
                held += [(at, ELEMENT, e.up, e.depth, e.main + 2 * e.head + 4 * e.holds, e.times, e.chars) for at, e in page.elements.items()]
                found: dict[int, list[int]] = {}
                for block in page.blocks:
                    for t, chars in text_tokens(block.path, block.text):
                        row = found.setdefault(t, [block.path, 0, 0])
                        row[1] += 1
                        row[2] += 0 if block.outside else chars
                held += [(t, TEXT, at, 0, 0, times, chars) for t, (at, times, chars) in found.items()]
                whose.append((name, int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))).view(np.int64)), len(held) - before))
                if len(held) > HELD:
                    yield out()
                    held.clear()
                    whose.clear()
        if held:
            yield out()

    parts = _source(pages).select("host", "html").mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))
    most = {"kind": F.max, "up": F.max, "depth": F.min, "flags": F.max, "first": F.min, "last": F.max}
    return parts.groupBy("host", "token").agg(*[most.get(c, F.sum)(c).alias(c) for c in _COLUMNS[2:]])


def content_of(elements: dict[int, tuple[int, int, int, bool, bool, bool]]) -> list[int]:
    """Where the way down from the root ends. elements: hash -> (parent, characters in its slots, pages, article or
    main, h1, holds blocks)."""
    below: dict[int, list[int]] = {}
    for at, e in elements.items():
        below.setdefault(e[0], []).append(at)
    total: dict[int, int] = {}
    order, todo = [], [at for at, e in elements.items() if e[0] not in elements]
    roots = list(todo)
    while todo:
        at = todo.pop()
        order.append(at)
        todo += below.get(at, ())
    for at in reversed(order):
        total[at] = elements[at][1] + sum(total[x] for x in below.get(at, ()))

    def within(at: int, what: int) -> list[int]:
        """The uppermost elements with text under one that are an article or main (3), or an h1 (4)."""
        found, todo = [], list(below.get(at, ()))
        while todo:
            x = todo.pop()
            if total[x] and elements[x][what]:
                found.append(x)
            else:
                todo += below.get(x, ())
        return sorted(found)

    content, todo = [], roots
    while todo:
        at = todo.pop()
        kids = [x for x in below.get(at, ()) if total[x]]
        main = within(at, 3)
        most: list[int] = []
        for x in sorted(kids, key=lambda x: (-total[x], x)):
            if sum(total[y] for y in most) < MOST * total[at]:
                most.append(x)
        taking_turns = len(most) == 1 or sum(elements[x][2] for x in most) <= elements[at][2]
        if elements[at][3] or not kids:
            content.append(at)
        elif main and sum(total[x] for x in main) >= HALF * total[at]:
            content += main
        elif taking_turns and all(elements[x][5] for x in most) and sum(total[x] for x in most) >= MOST * total[at]:
            content += set(within(at, 4)) - {y for x in most for y in within(x, 4)}  # the title stays
            todo += most
        else:
            content.append(at)
    return sorted(set(content))


def nested(rows: pd.DataFrame) -> tuple[list[dict], list[int], list[int]]:
    """Of a host's frequent tokens: the nested valid classes (class, parent, elements, texts, slot_chars), the constant
    text tokens, the content elements."""
    elements = rows[rows.kind == ELEMENT]
    up, depth = dict(zip(elements.token, elements.up)), dict(zip(elements.token, elements.depth))
    vector = lambda part: zip(part.pages, part.times, part.low, part.high)
    by_vector: dict[tuple, tuple[list[int], list[int]]] = {}
    varied = elements[elements["first"] != elements["last"]]
    for token, v in zip(varied.token, vector(varied)):
        by_vector.setdefault(v, ([], []))[0].append(token)
    fixed: dict[int, int] = {}
    texts = rows[rows.kind == TEXT]
    for token, at, chars, v in zip(texts.token, texts.up, texts.chars, vector(texts)):
        if v in by_vector:
            by_vector[v][1].append(token)
            fixed[at] = fixed.get(at, 0) + chars
    classes = [(sorted(own, key=lambda e: (depth[e], e)), sorted(its)) for own, its in by_vector.values()]
    classes.sort(key=lambda c: (depth[c[0][0]], c[0][0]))
    of = {e: i for i, c in enumerate(classes) for e in c[0]}
    constant = sorted(t for c in classes for t in c[1])
    slots = {at: (above, max(0, chars - fixed.get(at, 0)), pages, bool(flags & 1), bool(flags & 2), bool(flags & 4)) for at, above, chars, pages, flags in zip(elements.token, elements.up, elements.chars, elements.pages, elements["flags"]) if at in of}
    tree = []
    for i, (own, fixed_texts) in enumerate(classes):
        above = up[own[0]]
        while above in up and of.get(above, i) == i:
            above = up[above]
        tree.append({"class": i, "parent": of.get(above), "elements": own, "texts": fixed_texts, "slot_chars": sum(slots[e][1] for e in own)})
    return tree, constant, content_of(slots) if any(s[1] for s in slots.values()) else []


_TEMPLATE = "host long, classes array<struct<class: int, parent: int, elements: array<long>, texts: array<long>, slot_chars: long>>, constant array<long>, content array<long>"


def templates(found: DataFrame) -> DataFrame:
    """host, classes, constant, content: see nested(). Only tokens on SHARE of a host's pages come together in its
    group, which are no more than 1 / SHARE times the tokens of a page."""
    sizes = written(found.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("host_pages")).where(F.col("host_pages") >= SUPPORT), "html-hosts")
    often = join_small(found.where((F.col("kind") != PAGE) & (F.col("pages") >= SUPPORT)), sizes, ["host"]).where(F.col("pages") >= SHARE * F.col("host_pages"))

    def nest(rows: pd.DataFrame) -> pd.DataFrame:
        tree, constant, content = nested(rows)
        return pd.DataFrame([{"host": rows.host.iloc[0], "classes": tree, "constant": constant, "content": content}])

    return often.groupBy("host").applyInPandas(nest, _TEMPLATE)


def main_text(text: str, constant: set[int] | frozenset[int], content: frozenset[int]) -> str:
    page = parse(text, content)
    if not any(b.inside and not b.outside for b in page.blocks):
        own = frozenset(content_of({at: (e.up, e.chars, 1, e.main, e.head, e.holds) for at, e in page.elements.items()}))
        page = parse(text, own)
    return " ".join(b.text for b in page.blocks if b.inside and not b.outside and not (constant and all(t in constant for t, _ in text_tokens(b.path, b.text))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if there is none) of every page. Templates come to the pages by a broadcast if they are
    few enough, else the join is by host, which Spark splits where a host is hot."""
    template = written(templates(written(occurrences(pages), "html-tokens")).select("host", "constant", "content"), "html-templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[frozenset[int], frozenset[int]]] = {}
        for b in batches:
            texts = []
            hosts, constants, contents = b.column(3).to_pylist(), b.column(4), b.column(5)
            for i, (text, name) in enumerate(zip(b.column(2).to_pylist(), hosts)):
                if name not in known:
                    if len(known) >= 10_000:
                        known.clear()
                    known[name] = frozenset(constants[i].as_py() or ()), frozenset(contents[i].as_py() or ())
                texts.append(main_text(text, *known[name]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    cells = template.agg(F.coalesce(F.sum(1 + F.size("constant") + F.size("content")), F.lit(0))).first()[0]
    joined = join_small(_source(pages), template, ["host"], "left", SMALL if cells <= SMALL else -1).select("page_id", "url", "html", "host", "constant", "content")
    return joined.mapInArrow(run, "page_id long, url string, text string")
