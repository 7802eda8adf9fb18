"""Operator 3: main text of web pages by site template removal.

A page is parsed once, into blocks of text and the elements that hold them. Each element's subtree
is hashed twice: with its texts (tag, texts and child hashes), and as a shape without them (tag,
class and child shapes, runs of one shape taken once). Spark counts the different pages of each
host that have a hash; pages of equal blocks count as one. What recurs is template and goes:

* a subtree outside the content (article or main element) on MIN_PAGES pages or more, and a share
  MIN_SHARE of the host's pages; inside it, or on pages without one, on MAIN_PAGES and MAIN_SHARE;
* outside the content, the shape of a menu (half of its words or more are links), on MIN_PAGES pages
  and a share MAIN_SHARE of them, if it holds less than half of the host's words.

What holds all of a page's text, or all of its content element's, is never template, and a page of
nothing but templates keeps its text. Beside recurrence, fixed tags and roles go (menus, footers,
forms, hidden parts, reader comments). Where a host has too few pages, class and id words that name
a menu, notice, advert and so on are a fallback; they never remove what holds most of the text of
the content, or of a page without one. If what is left inside the article elements, or else inside
article and main elements, has half of the words left or more, it is the text; else all that is left.

Rows: null or textless html gives empty text. A null url has the empty host. Broken markup is read
as far as it goes, in time that grows with its length; an element that is not closed ends with its
parent. Repeated rows are pages each, and count as one for templates. Pages of any length are parsed
whole. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import namedtuple
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small_batches
from .urlfilter import host_of

MIN_PAGES, MIN_SHARE, MAIN_PAGES, MAIN_SHARE = 3, 0.2, 8, 0.5
#: Templates up to this many are broadcast with their pages' hosts; more are joined with pages whose hosts are dealt over SALTS parts.
BROADCAST_ROWS, SALTS = 50_000, 16

# Fixed values of HTML: elements without end tag, elements of raw text, elements that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html head legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr ul option select button".split())
CLOSES_P = BLOCK - {"option", "select", "button", "html", "head", "body", "tbody", "thead", "tfoot", "tr", "caption", "legend", "summary"}
# Fixed values of HTML: elements that an element of the same kind closes, and those that shield them.
CLOSED = [(frozenset(["p"]), frozenset("div article section td li body".split())), (frozenset(["li"]), frozenset("ul ol menu".split())), (frozenset("dt dd".split()), frozenset(["dl"])), (frozenset(["tr"]), frozenset("table tbody thead tfoot".split())), (frozenset(["option"]), frozenset(["select"]))]
#: For each tag, which places of Node.nearest it takes (True) or shields, and which elements it closes.
_NEAR = {tag: [(k, tag in same) for k, (same, shields) in enumerate(CLOSED) if tag in same | shields] for tag in frozenset().union(*(a | b for a, b in CLOSED))}
_CLOSES = {tag: [k for k, (same, _) in enumerate(CLOSED) if (tag in CLOSES_P if k == 0 else tag in same)] for tag in BLOCK}
# Tags that are never content, and words of role, id and class that say so.
DROP_TAGS = frozenset("nav footer aside form head button select option dialog menu fieldset label".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar status".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay nav navbar navigation navi menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments commentlist "
    "disqus replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager".split()
)
#: Elements whose class and id say nothing about their text.
HOLDERS = frozenset("html body main article".split())

_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
_plain_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_attribute = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_split = re.compile(r"[^a-z0-9]+")
_hump = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_hides = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_ends = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}


def says(tag: str, attributes: str, inside: bool) -> tuple[int, bool, str]:
    """2 if the element is never content, 1 if its class or id says that it is none, else 0; whether its role is main; its class words."""
    said = 2 if tag in DROP_TAGS or (tag == "header" and not inside) else 0
    main, classes = tag == "main", ""
    if not attributes or attributes.isspace():
        return said, main, classes
    for m in _attribute.finditer(attributes):
        name = m[1].lower()
        value = next((v for v in m.groups()[1:] if v is not None), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _hides.search(value)):
            said = 2
        elif name == "role":
            main = main or value.lower() == "main"
            if value.lower() in DROP_ROLES:
                said = 2
        elif name in ("class", "id"):
            words = _split.split(_hump.sub("-", value).lower())
            if name == "class":
                classes = " ".join(sorted({w for w in words if w and not w.isdigit()}))
            if tag not in HOLDERS:
                words += [a + b for a, b in zip(words, words[1:], strict=False)]  # side-bar is sidebar
                if not COMMENT_WORDS.isdisjoint(words):
                    said = 2
                elif not DROP_WORDS.isdisjoint(words) or ("header" in words and (not inside or "site" in words)):
                    said = max(said, 1)
    return said, main, classes


class Node:
    """An open or closed element. root: 2 for an article, 1 for a main element, that lies in none of its kind or above; level: the highest root over it."""

    __slots__ = ("tag", "said", "root", "level", "classes", "begin", "end", "parts", "shapes", "nearest", "hash", "shape", "links")

    def __init__(self, tag: str, said: int, root: int, level: int, classes: str, begin: int, nearest: tuple[int, ...]):
        self.tag, self.said, self.root, self.level, self.classes = tag, said, root, level, classes
        self.begin, self.end, self.parts, self.shapes, self.nearest = begin, begin, [], [], nearest
        self.hash = self.shape = self.links = 0


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


class _Next:
    """The next place of a mark; searched anew only behind the last one found."""

    def __init__(self, page: str, mark: str):
        self.page, self.mark, self.at = page, mark, -2

    def __call__(self, start: int) -> int:
        if self.at == -2 or -1 < self.at < start:
            self.at = self.page.find(self.mark, start)
        return self.at


def parse(page: str) -> tuple[list[str], list[Node]]:
    """All blocks of text, and the closed elements over them, inner ones first."""
    blocks: list[str] = []
    linked = [0]  # words in links up to each block
    nodes: list[Node] = []
    stack = [Node("", 0, 0, 0, "", 0, (0,) * len(CLOSED))]
    opened: dict[str, int] = {}  # how many elements of a tag are open
    buffer: list[str] = []
    mark: tuple[str, int] | None = None  # an inline element that is no content, and where its text begins in the buffer
    depth = in_link = link_words = 0
    at, size = 0, len(page)
    next_tag, next_end, next_comment = _Next(page, "<"), _Next(page, ">"), _Next(page, "-->")
    quotes = True  # until a tag's quotes do not close

    def put(upto: int | None = None) -> None:
        nonlocal link_words
        text = " ".join(html.unescape("".join(buffer[:upto])).split())
        del buffer[:upto]
        if text:
            stack[-1].parts.append(text)
            stack[-1].shapes.append("T")
            blocks.append(text)
            linked.append(linked[-1] + link_words)
            link_words = 0

    def push(tag: str, said: int, root: int, classes: str) -> None:
        top, k = stack[-1], len(stack)
        nearest = top.nearest
        if tag in _NEAR:
            places = list(nearest)
            for at, own in _NEAR[tag]:
                places[at] = k if own else 0
            nearest = tuple(places)
        level = max(top.level, root)
        stack.append(Node(tag, said, root if root > top.level else 0, level, classes, len(blocks), nearest))
        opened[tag] = opened.get(tag, 0) + 1

    def flush() -> None:
        nonlocal mark
        if mark:  # a block inside an inline element that is no content: it holds what follows
            tag, start = mark
            mark = None
            if start:
                put(start)
            push(tag, 1, 0, "")
        if buffer:
            put()

    def close() -> None:
        node = stack.pop()
        opened[node.tag] -= 1
        node.end = len(blocks)
        if node.end > node.begin:
            node.hash = _hash(node.tag + "\0" + "\0".join(node.parts))
            kinds = [s for k, s in enumerate(node.shapes) if not k or s != node.shapes[k - 1]]
            node.shape = _hash("\1".join([node.tag, node.classes, *kinds]))
            node.links = linked[node.end] - linked[node.begin]
            stack[-1].parts.append(f"<{node.hash:x}>")
            stack[-1].shapes.append(f"{node.shape:x}")
            nodes.append(node)
        node.parts, node.shapes = [], []

    def say(text: str) -> None:
        nonlocal link_words
        buffer.append(text)
        if in_link:
            link_words += len(text.split())

    while at < size:
        start = next_tag(at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        at = start
        if page.startswith("<!--", at):
            end = next_comment(at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = next_end(at)
            if end < 0:
                say("<")
                at += 1
            else:
                at = end + 1
            continue
        m = None
        if next_end(at) >= 0:
            m = _tag.match(page, at) if quotes else _plain_tag.match(page, at)
            if not m and quotes and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                quotes = False
                m = _plain_tag.match(page, at)
        if not m:
            if next_end(at) < 0 and page[at + 1 : at + 3].lstrip("/")[:1].isalpha() and next_tag(at + 1) < 0:
                break  # a tag that the page's end cuts
            say("<")
            at += 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                if opened.get(tag):
                    while stack[-1].tag != tag:
                        close()
                    close()
            elif tag in ("td", "th"):
                buffer.append(" ")
            elif tag == "a":
                in_link = 0
            if mark and mark[0] == tag:
                depth -= 1
                if not depth:
                    del buffer[mark[1] :]
                    mark = None
            elif tag not in BLOCK and opened.get(tag):  # an inline element that holds blocks
                flush()
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = _ends[tag].search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br" or tag in ("td", "th", "img"):
            buffer.append(" ")
            continue
        if tag not in BLOCK:
            if tag == "a":
                in_link = 1
            if mark:
                depth += mark[0] == tag
            elif tag not in VOID and m[3] and says(tag, m[3], stack[-1].level > 0)[0]:  # an inline advert or hidden part
                mark, depth = (tag, len(buffer)), 1
            continue
        flush()
        for k in _CLOSES[tag]:
            while len(stack) > stack[-1].nearest[k] > 0:
                close()
        if tag in VOID:
            continue
        said, main, classes = says(tag, m[3], stack[-1].level > 0)
        push(tag, said, 2 if tag == "article" else 1 if main else 0, classes)
    flush()
    while len(stack) > 1:
        close()
    return blocks, nodes


def text_of(blocks: list[str], nodes: list, templates: set[int] | frozenset = frozenset()) -> str:
    """The page's text without `templates` (hashes and shapes) and what is no content."""
    n = len(blocks)
    if not n:
        return ""
    words = np.array([len(b.split()) for b in blocks], np.int64)

    def covered(some: list) -> np.ndarray:
        edges = np.zeros(n + 1, np.int64)
        for x in some:
            edges[x.begin] += 1
            edges[x.end] -= 1
        return np.cumsum(edges[:n]) > 0

    level = np.maximum(2 * covered([x for x in nodes if x.root == 2]), covered([x for x in nodes if x.root == 1]))
    left = ~covered([x for x in nodes if x.said == 2])
    if templates:
        wholes = [w for part in (left, left & (level > 0), left & (level == 2)) if len(w := np.flatnonzero(part))]
        gone = covered([x for x in nodes if (x.hash in templates or x.shape in templates) and not any(x.begin <= w[0] and w[-1] < x.end for w in wholes)])
        left = left & ~gone if (left & ~gone).any() else left
    doubtful = [x for x in nodes if x.said == 1]
    if doubtful:
        known = left & (level > 0)
        base, upto = words[known].sum(), np.concatenate([[0], np.cumsum(words * left)])
        total = upto[-1]
        held = lambda x: upto[x.end] - upto[x.begin]
        left = left & ~covered([x for x in doubtful if (2 * held(x) < base if x.level else base > 0 or 2 * held(x) < total)])
    for least in (2, 1):
        own = left & (level >= least)
        if own.any() and 2 * words[own].sum() >= words[left].sum():
            left = own
            break
    return "\n".join(blocks[k] for k in np.flatnonzero(left))


_Row = namedtuple("_Row", "begin end hash shape said root level")
_LISTS = {"begin": T.IntegerType(), "end": T.IntegerType(), "hash": T.LongType(), "shape": T.LongType(), "said": T.IntegerType(), "root": T.IntegerType(), "level": T.IntegerType(), "inside": T.BooleanType(), "menu": T.IntegerType()}


def _nested(rows: list[list], kinds: dict[str, T.DataType]) -> pa.ListArray:
    """Lists of tuples as a list array of structs."""
    flat = [x for r in rows for x in r]
    arrow = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.BooleanType: pa.bool_()}
    fields = [pa.array([x[k] for x in flat], arrow[type(t)]) for k, t in enumerate(kinds.values())]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.StructArray.from_arrays(fields, names=list(kinds)))


def _told(blocks: list[str], nodes: list[Node]) -> list[tuple]:
    """The fields of _LISTS of each node: whether it lies in the content, and the words of a menu outside of it (else -1)."""
    upto = list(accumulate((len(b.split()) for b in blocks), initial=0))
    lone = not any(x.root for x in nodes)
    out = []
    for x in nodes:
        held = upto[x.end] - upto[x.begin]
        out.append((x.begin, x.end, x.hash, x.shape, x.said, x.root, x.level, lone or x.level > 0, held if not x.level and 2 * x.links >= held else -1))
    return out


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (a hash of its blocks), words, blocks and nodes of each page."""
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    struct = lambda kinds: T.ArrayType(T.StructType([T.StructField(n, t) for n, t in kinds.items()]))
    schema = T.StructType([*source.schema.fields[:3], T.StructField("page", T.LongType()), T.StructField("words", T.LongType()), T.StructField("blocks", T.ArrayType(T.StringType())), T.StructField("nodes", struct(_LISTS))])
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                got = [parse(page or "") for page in part.column(3).to_pylist()]
                marks = [_hash("\0".join(b)) for b, _ in got]
                words = [sum(len(x.split()) for x in b) for b, _ in got]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(marks, pa.int64()), pa.array(words, pa.int64()), pa.array([b for b, _ in got], pa.list_(pa.string())), _nested([_told(*g) for g in got], _LISTS)], names=schema.names)

    return source.mapInArrow(run, schema)


def templates(read: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, main_pages: int = MAIN_PAGES, main_share: float = MAIN_SHARE) -> DataFrame:
    """host and hash of what recurs across the host's pages; read: the output of parsed."""
    # each page tells itself (hash 0), its subtrees, and the shapes of its menus
    told = lambda x: F.array_compact(F.array(F.struct(x.hash.alias("hash"), F.lit(False).alias("menu"), x.inside.alias("inside"), F.lit(0).cast("long").alias("words")), F.when(x.menu >= 0, F.struct(x.shape.alias("hash"), F.lit(True).alias("menu"), F.lit(False).alias("inside"), x.menu.cast("long").alias("words")))))
    own = F.array(F.struct(F.lit(0).cast("long").alias("hash"), F.lit(False).alias("menu"), F.lit(False).alias("inside"), F.col("words").alias("words")))
    rows = read.select("host", "page", F.inline(F.concat(own, F.flatten(F.transform("nodes", told)))))
    # a page that comes twice counts once; of several menus of one shape on a page the longest does
    once = rows.groupBy("host", "hash", "page", "menu").agg(F.max("inside").alias("inside"), F.max("words").alias("words"))
    counts = saved(once.groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("menu").alias("menu"), F.max("inside").alias("inside"), F.sum("words").alias("words")).where((F.col("n") >= min_pages) | (F.col("hash") == 0)))
    hosts = counts.where("hash = 0").select("host", F.col("n").alias("pages"), F.col("words").alias("all_words"))
    n, pages = F.col("n"), F.col("pages")
    recurs = F.when(F.col("menu"), (n >= main_share * pages) & (2 * F.col("words") < F.col("all_words"))).when(F.col("inside"), (n >= main_pages) & (n >= main_share * pages)).otherwise(n >= min_share * pages)
    return counts.where("hash <> 0").join(hosts, "host").where(recurs).select("host", "hash")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, main_pages: int = MAIN_PAGES, main_share: float = MAIN_SHARE) -> DataFrame:
    """page_id, url and main text of each page."""
    read = saved(parsed(pages))
    found = saved(templates(read, min_pages, min_share, main_pages, main_share))
    per_host = found.groupBy("host").agg(F.collect_list("hash").alias("gone"))
    source = read.select("page_id", "url", "host", "blocks", "nodes")
    if found.count() <= BROADCAST_ROWS:
        joined = source.join(F.broadcast(per_host), "host", "left")
    else:  # a hot host's pages go to several tasks
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = source.withColumn("salt", salt).join(per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "blocks", "nodes", "gone")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = [], batch.column(3)
            flat = [c.to_pylist() for c in lists.flatten().flatten()]
            ends = np.cumsum([0, *(len(x) for x in lists)]).tolist()
            for i, (blocks, gone) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                rows = map(_Row._make, zip(*(c[ends[i] : ends[i + 1]] for c in flat[:7]), strict=True))
                out = frozenset(gone or ())
                texts.append(text_of(blocks, [x for x in rows if x.said or x.root or x.hash in out or x.shape in out], out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, schema)


def digests(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
