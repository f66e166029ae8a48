"""Main text of web pages by template deduction over equivalence classes.

The tokens of a page are its tags, told apart by their path of elements, and its texts at their paths. The pages of a
host give every token an occurrence vector: how often it occurs on each page. Tokens of the same vector, on at least
SUPPORT pages and on half of the host's pages, form an equivalence class; vectors are compared by an exclusive-or of
hashes of (page, count). Classes that hold tags and nest (the members' nearest outer tags belong to one class) make the
host's template; texts in them are constant. What a page has besides its template are the slots, each named by the
template tag it stands in. Pages whose texts are all the same count as one page in the vectors, so that copies do not
make a page its own template.

The template says which slots are the main text. Its region is found from the root down: of the template tags that occur
once on a page the one that holds most of the text that varies over the host's pages, as long as that is REGION of it;
it is not left for a part of itself at an article or main element, or where a heading stands beside the part. The main
text is what the region holds without its constant texts, unless those are more than half of it, as on a page that is a
copy of others. Menus, headers, footers, sidebars, notices, adverts, forms and reader comments, by element, role or class
name, are no part of it, and their texts do not count for the region. Pages that have no template, or nothing in its
region, give what their article or main elements hold, or all other texts if they have none. Blocks keep page order.

Null or empty html gives an empty text. Very long pages, and elements nested to any depth, take time and memory in
proportion to their length. Pages of hosts with fewer than SUPPORT different pages have no template. Null and odd urls are
hosts of their own kind (the empty name). Repeated rows are pages of their own. Of equally large parts of a region the
one of the smaller number is taken. Unclosed elements and comments end with the page; a tag that is not closed is
dropped, as browsers do. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_to_groups, on_workers, stored

#: Pages that a token of a template must occur on.
SUPPORT = 3
#: The share of a region's text for which a part of it is taken, and for which an article or main element is.
REGION = 0.6
MAIN_REGION = 0.3

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body br caption head html legend option select tbody td textarea tfoot th thead title tr".split())
#: An element ends open ones of these names, unless one of the names behind the bar stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# What marks a part of a page that is no main text.
ASIDE_ELEMENTS = frozenset(
    "aside button datalist dialog footer form head header iframe input menu nav noscript object script search select style "
    "svg template textarea title".split()
)
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies discussion disqus footer gdpr header login menu menubar modal nav navbar navigation newsletter notice "
    "notices notification pagination pager popup promo promoted promotion related replies reply respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
MAIN_ELEMENTS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2"))

_OPEN = re.compile(r"<([A-Za-z][^\s>/]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_CLOSE = re.compile(r"</([A-Za-z][^\s>/]*+)[^>]*+>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s>/])", re.I) for n in RAW}


class Node:
    """An element that is open: the number of its path of labels, and whether it stands aside or in the main part."""

    __slots__ = ("name", "id", "parent", "aside", "main")

    def __init__(self, name: str, label: str, aside: bool, parent: Node | None):
        self.name, self.parent = name, parent
        self.id = token_of(parent.id if parent else 0, label)
        self.main = bool(parent and parent.main) or (name in MAIN_ELEMENTS and not aside and not (parent and parent.aside))
        self.aside = bool(parent and parent.aside) or aside


def token_of(path: int, text: str) -> int:
    """Number of a tag (by its label) or of a text at the path of that number, signed as Spark's longs are."""
    h = xxhash.xxh64_intdigest(text, path & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def _opened(name: str, attributes: str, parent: Node | None) -> Node:
    label, aside = name, name in ASIDE_ELEMENTS
    if attributes and not attributes.isspace():
        own = {}
        for m in _ATTRIBUTE.finditer(attributes):
            own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = own.get("class", "").split()
        label += "".join(f".{n}" for n in names) + (f"#{own['id']}" if own.get("id") else "")
        if name not in ("html", "body", *MAIN_ELEMENTS):
            aside |= own.get("role", "").lower() in ASIDE_ROLES
            for n in (*names, own.get("id", "")):
                parts = re.split(r"[-_]+", n.lower())
                aside |= parts[0] not in ("has", "no", "with", "without") and not ASIDE_NAMES.isdisjoint(parts)
        elif name in MAIN_ELEMENTS:  # a reader's comment may be an article too
            aside |= any("comment" in n.lower() for n in names)
    return Node(name, label, aside, parent)


def parse(page: str | None) -> Iterator[tuple[str, Node | None, str]]:
    """("open", element, ""), ("text", element it stands in, the text with references decoded) and ("break", None, "")
    where a block begins or ends, in page order."""
    if not page:
        return
    stack: list[Node] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of each name in the stack
    at, n = 0, len(page)
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            text = page[at : end if end >= 0 else n]
            at += len(text)
            yield "text", stack[-1] if stack else None, entities.unescape(text) if "&" in text else text
        elif m := _OPEN.match(page, at):
            at = m.end()
            name, attributes = m[1].lower(), m[2]
            if name in CLOSES_P and places["p"]:
                _end(stack, places, {"p"}, {"article", "body", "div", "td", "th", "section", "main", "button", "object"})
            if name in ENDS and any(places[x] for x in ENDS[name][0]):
                _end(stack, places, *ENDS[name])
            if name in BLOCKS:
                yield "break", None, ""
            node = _opened(name, attributes, stack[-1] if stack else None)
            yield "open", node, ""
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else n
            # HTML ignores the slash that ends a tag, but for the elements of drawings
            if name not in VOID and not (name in ("svg", "path") and attributes.rstrip().endswith("/")):
                places[name].append(len(stack))
                stack.append(node)
        elif m := _CLOSE.match(page, at):
            at = m.end()
            name = m[1].lower()
            if places[name]:
                _close(stack, places, places[name][-1])
            if name in BLOCKS:
                yield "break", None, ""
        elif page.startswith("<!--", at):
            end = _COMMENT_END.search(page, at + 2)
            at = end.end() if end else n
        elif page[at + 1 : at + 2] in ("!", "?", "/") or page[at + 1 : at + 2].isascii() and page[at + 1 : at + 2].isalpha():
            # declarations; and tags that the page does not close
            end = page.find(">", at) if page[at + 1] in "!?/" else -1
            at = end + 1 if end >= 0 else n
        else:
            at += 1
            yield "text", stack[-1] if stack else None, "<"


def _close(stack: list[Node], places: dict[str, list[int]], at: int) -> None:
    """Ends the open elements from place `at` on."""
    while len(stack) > at:
        places[stack.pop().name].pop()


def _end(stack: list[Node], places: dict[str, list[int]], names: set, walls: set) -> None:
    """Ends the innermost element of these names, if none of the walls stands in it."""
    innermost = lambda kinds: max((places[x][-1] for x in kinds if places[x]), default=-1)
    if (at := innermost(names)) >= 0 and at >= innermost(walls):
        _close(stack, places, at)


class Token:
    """What a page has of a token: its count and characters (of a tag those of the texts right inside, if they do not stand
    aside), its kind (0 a text; of a tag 1, 2 for an article or main element, 3 for a heading) and the tag around it."""

    __slots__ = ("k", "chars", "kind", "parent")

    def __init__(self, kind: int, parent: int):
        self.k, self.chars, self.kind, self.parent = 0, 0, kind, parent


def page_tokens(page: str | None) -> tuple[dict[int, Token], int]:
    """The tokens of a page by number, and a number of all its texts that do not stand aside."""
    out: dict[int, Token] = {}
    content = 0
    for kind, node, text in parse(page):
        if kind == "open":
            one = out.get(node.id)
            if one is None:
                what = 2 if node.name in MAIN_ELEMENTS else 3 if node.name in HEADINGS else 1
                one = out[node.id] = Token(what, node.parent.id if node.parent else 0)
            one.k += 1
        elif kind == "text" and not text.isspace():
            path = node.id if node else 0
            words = " ".join(text.split())
            number = token_of(path, "\n" + words)
            one = out.get(number)
            if one is None:
                one = out[number] = Token(0, path)
            one.k += 1
            if node is None or not node.aside:
                one.chars += len(words)
                content = token_of(content, words)
                if node is not None:
                    out[path].chars += len(words)
    return out, content


HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


TEMPLATE = pa.schema([("host", pa.string()), ("region", pa.int64()), ("tags", pa.list_(pa.int64())), ("texts", pa.list_(pa.int64()))])
_FOUND = [("host", pa.string()), ("content", pa.int64()), ("token", pa.int64()), ("k", pa.int64()), ("chars", pa.int64()), ("kind", pa.int32()), ("parent", pa.int64())]


def classes(pages: DataFrame) -> DataFrame:
    """The tokens of all hosts' equivalence classes: host, token, kind, parent, chars (on all pages), once (never twice on a
    page), vector and support (which tell classes apart)."""
    on_workers(pages.sparkSession)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in _FOUND]
            for host, page in zip(*b.columns, strict=True):
                found, content = page_tokens(page.as_py())
                for number, x in found.items():
                    for column, value in zip(out, (host.as_py(), content, number, x.k, x.chars, x.kind, x.parent), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, _FOUND, strict=True)], names=[n for n, _ in _FOUND])

    own = _pages(pages)
    found = own.select("host", "html").mapInArrow(tokens, "host string, content long, token long, k long, chars long, kind int, parent long")
    # pages of the same texts count once, with their smaller count of a token should they differ
    each = found.groupBy("host", "token", "content").agg(
        F.min("k").alias("k"), F.min("chars").alias("chars"), F.min("kind").alias("kind"), F.min("parent").alias("parent")
    )
    vectors = (
        each.groupBy("host", "token")
        .agg(
            F.count(F.lit(1)).alias("support"),
            F.bit_xor(F.xxhash64("content", "k")).alias("vector"),
            (F.max("k") == 1).alias("once"),
            F.sum("chars").alias("chars"),
            F.min("kind").alias("kind"),
            F.min("parent").alias("parent"),
        )
        .where(F.col("support") >= SUPPORT)
    )
    vectors = stored(vectors, "vectors")
    # every page of a host has its outermost tag or text, so the largest support is about the number of different pages
    sizes = vectors.groupBy("host").agg(F.max("support").alias("most"))
    held = vectors.join(sizes, "host").where(F.col("support") * 2 >= F.col("most")).drop("most")
    tags = held.where("kind > 0")
    texts = held.where("kind = 0").join(tags.select("host", "support", "vector").distinct(), ["host", "support", "vector"], "left_semi")
    return tags.unionByName(texts.select(*tags.columns))


def templates(pages: DataFrame) -> DataFrame:
    """One row per host that has a template: host, region (a tag), tags and texts (tokens). As a token of it is on half of
    the host's pages, a template has at most twice as many as its pages have on average, however many those are."""
    columns = ("token", "kind", "parent", "chars", "once", "vector", "support")
    by_host = classes(pages).groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("tokens"))

    def deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, tokens in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.append((host, *template([tuple(t[c] for c in columns) for t in tokens.as_py()])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, TEMPLATE, strict=True)], schema=TEMPLATE)

    return stored(by_host.mapInArrow(deduce, "host string, region long, tags array<long>, texts array<long>"), "templates")


def template(tokens: list[tuple]) -> tuple[int | None, list[int], list[int]]:
    """From a host's classes: the region (None if there are no tags), the tags of the classes that nest, the constant texts.
    tokens: (token, kind, parent, chars, once, vector, support)."""
    tags = {t[0]: t for t in tokens if t[1]}
    outer: dict[tuple, set] = {}
    for number, _, parent, _, _, *own in tags.values():
        above = tags[parent][5:] if parent in tags else ()
        if tuple(above) != tuple(own):
            outer.setdefault(tuple(own), set()).add(tuple(above))
    valid = {n for n, t in tags.items() if len(outer.get(tuple(t[5:]), ())) <= 1}
    kept = {tuple(tags[n][5:]) for n in valid}
    texts = [t for t in tokens if not t[1] and tuple(t[5:]) in kept]
    # characters that vary, by tag and summed over what it holds; where none do, pages are copies and name no region
    own = {n: t[3] for n, t in tags.items()}
    for _, _, parent, chars, *_ in texts:
        if parent in own:
            own[parent] -= chars
    inner: dict[int, list[int]] = {}
    for n, t in tags.items():
        inner.setdefault(t[2] if t[2] in tags else 0, []).append(n)
    order = [0]
    for n in order:
        order += inner.get(n, ())
    mass = dict(own)
    for n in reversed(order[1:]):
        up = tags[n][2]
        if up in mass:
            mass[up] += mass[n]
    region, weight = None, sum(mass[n] for n in inner.get(0, ()))
    while True:
        parts = [n for n in inner.get(region or 0, ()) if n in valid and tags[n][4]]
        if region is not None and (tags[region][1] == 2 or any(tags[n][1] == 3 for n in inner.get(region, ()))):
            break
        best = max(parts, key=lambda n: (mass[n], -n), default=None)
        if best is None or tags[best][1] == 3 or not mass[best]:
            break
        if mass[best] < (MAIN_REGION if tags[best][1] == 2 else REGION) * weight:
            break
        region, weight = best, mass[best]
    return region, sorted(valid), sorted(t[0] for t in texts)


def slots(page: str | None, region: int | None, tags: frozenset[int], texts: frozenset[int]) -> list[tuple[int, str]]:
    """The main slots of a page, a block each: the template tag that it stands in (0 for none) and its text."""
    inside: list[tuple[int, str, bool]] = []  # in the region: template tag, text, constant
    main: list[tuple[int, str]] = []
    rest: list[tuple[int, str, bool]] = []
    block: list[str] = []
    has_main = False
    where: dict[Node, tuple[int, bool]] = {}
    at = (0, False, False)  # of the block: template tag, in the region, in a main element
    constant = True

    def flush():
        nonlocal block, constant
        if block and (text := " ".join("".join(block).split())):
            if at[1]:
                inside.append((at[0], text, constant))
            if at[2]:
                main.append((at[0], text))
            else:
                rest.append((at[0], text, constant))
        block, constant = [], True

    for kind, node, text in parse(page):
        if kind == "break":
            flush()
        elif kind == "open":
            has_main |= node.main
            above = where.get(node.parent, (0, False)) if node.parent else (0, False)
            where[node] = (node.id if node.id in tags else above[0], above[1] or node.id == region)
        elif node is None or not node.aside:
            here = (*(where[node] if node else (0, False)), node is not None and node.main)
            if block and here[1:] != at[1:]:
                flush()
            if not block:
                at = here
            block.append(text)
            if not text.isspace():
                constant &= token_of(node.id if node else 0, "\n" + " ".join(text.split())) in texts
        elif block and block[-1] != " ":
            block.append(" ")  # what stands aside parts the words around it
    flush()
    if not inside:
        return main if has_main else [x[:2] for x in rest if not x[2]] or [x[:2] for x in rest]
    fixed = sum(len(t) for _, t, c in inside if c)
    spare = 2 * fixed > sum(len(t) for _, t, _ in inside)
    return [(w, t) for w, t, c in inside if spare or not c]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, slots (array of template tag and text) of every page."""
    on_workers(pages.sparkSession)
    own = _pages(pages)
    by_host = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(templates(pages), "host", "left")
    by_host = stored(by_host, "hosts")
    total = by_host.agg(F.sum("pages")).first()[0] or 0
    joined = join_to_groups(own, by_host, "host", "pages", total).select("page_id", "url", "html", "host", "region", "tags", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            out = []
            for html, host, region, tags, texts in zip(*b.columns[2:], strict=True):
                name = host.as_py()
                if name not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[name] = (region.as_py(), frozenset(tags.as_py() or ()), frozenset(texts.as_py() or ()))
                out.append([{"slot": s, "text": t} for s, t in slots(html.as_py(), *known[name])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _SLOTS)], names=["page_id", "url", "slots"])

    return joined.mapInArrow(run, "page_id long, url string, slots array<struct<slot: long, text: string>>")


_SLOTS = pa.list_(pa.struct([("slot", pa.int64()), ("text", pa.string())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the main text of every page from its whole html."""
    found = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    text = F.array_join(F.transform("slots", lambda s: s["text"]), " ")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
