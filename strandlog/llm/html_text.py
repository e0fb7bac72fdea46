"""Main text of web pages by a site style tree.

Each page's elements are merged with those of the same host by their path (tag and first class). A branch has two importances, both
entropies over the host's pages: of its presentation (which children it has, in runs of about so many) and of its content (which text it
holds). What looks and reads the same on all pages is a site's frame and has importance near 0: branches below `LEAST` are removed from each
page, paragraphs and headings included. Where a page declares an article, its paragraphs are fixed, as is every branch that holds one or most
of its text; what stands outside needs the tree's word to stay: a branch that both looks different from page to page (`OUTSIDE`) and reads so.

Elements whose tag says that they are no article (navigation, footers, forms, scripts) go; words in class, id or role are a prior only: an
element that calls itself "ad" or "comments" goes unless it holds most of the article's text (of the page's, if no element is an article).
Pages of a host with the same text count once, so that copies of an article, declared as one or not, are not taken for the host's frame.

Rows: null or empty html gives the empty text; broken markup is closed as browsers do, in time linear in the page, whatever its length;
a quote that never ends ends with its tag; references are decoded; a null url is a host of its own name. Hosts with fewer than `LEAST_PAGES`
pages of different text have no tree and are judged by their elements; a page of which the tree would leave nothing keeps its text. An empty table gives an empty result. Repeated rows give repeated rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, texts, written

LEAST, LEAST_PAGES, GAMMA, OUTSIDE = 0.3, 4, 0.9, 0.6
#: Pages beyond which an entropy's scale stays as it is, so that a branch of some ten looks is no frame on a host of many pages.
SCALE = 32
#: Rows of the table of judged branches up to which it is broadcast; beyond it is joined by host and salt.
MOST_BROADCAST, SALTS = 100_000, 32
#: How a branch is judged: fixed, removed if low, removed unless high.
FIXED, JUDGED, APART = 0, 1, 2

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: One attribute's name and its equals sign, after what parts attributes.
ATTRIBUTE = re.compile(r"[\s/]*(?:(=?[^\s/>=]+|=)(\s*=\s*)?)?")
BARE = re.compile(r"[^\s>]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw until their end tag, none of it article.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: Of those, the ones that take the rest of the page if they have no end tag.
ENDLESS = frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img label".split())
#: Elements that are never part of an article.
OUT = frozenset("nav footer aside form button menu dialog head fieldset select datalist template".split())
IN = frozenset("article main".split())
#: Those, and a page's header, in which an article of its own is none of the page.
HARD = OUT - {"form", "fieldset"} | {"header"}
#: Elements that may stand in a head.
HEAD = frozenset("base link meta noscript script style template title".split())
#: Words in class, id or role that name what is not article.
OUT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead notice cookie cookies consent popup modal overlay comment comments respond disqus related share sharing social newsletter subscribe signup login search pagination toolbar widget complementary contentinfo".split())
#: Words that may stand beside those in a compound such as site-footer or comment-list; has-sidebar and entry-header are none.
PLACES = frozenset("site page main global top bottom left right primary secondary area list section block box bar buttons links wrapper container".split())
#: Names of a head, which an article may have as its own.
HEADS = frozenset("header masthead banner".split())
#: What readers and notices say is no article, however long, unless a page has nothing else.
ASIDES = frozenset("ad ads comment comments respond disqus related cookie cookies consent".split())
#: Elements whose id is an anchor made from their heading.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
PLAIN = frozenset("article main p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table tbody thead tr td th figure body html".split())
#: A start tag ends an open element of its row, unless one that holds rows of its own has begun since.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "table")), "dt": (("dt", "dd"), ("dl", "table")), "dd": (("dt", "dd"), ("dl", "table")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "option": (("option",), ("select", "datalist"))}
SCOPE = frozenset("html body article main section div td th table ul ol dl li blockquote nav footer header aside form".split())
CELLS = ("td", "th", "caption")
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
NAME = re.compile(r"[a-z]+")
PRIME, FIELD = 1_000_003, 1 << 61


class Page:
    """Elements by path, and the blocks of text that the elements' tags and names let stay."""

    def __init__(self, html: str):
        self.path: list[int] = []  # of each element kind: hash of its path
        self.parent: list[int] = []  # those above come first
        self.plain: list[bool] = []
        self.root: list[bool] = []
        self.style: list[int] = []
        self.content: list[int] = []
        self.blocks: list[tuple[int, str, bool, int]] = []  # element kind, text, inside an article, innermost element with a frame's name
        self.named: list[tuple[int, bool]] = []  # of each element with a frame's name: the one around it or -1, of ASIDES
        self.run: dict[int, tuple[int, int]] = {}  # the last child of each kind and how often it came in a row
        self.place: dict[tuple[int, str], int] = {}
        self._read(html)
        for parent in self.run:
            self._ended(parent)
        for k in range(len(self.path) - 1, -1, -1):
            up = self.parent[k]
            if up >= 0:
                self.content[up] = (self.content[up] * PRIME + self.content[k]) % FIELD

    def _ended(self, parent: int) -> None:
        child, n = self.run[parent]
        self.style[parent] = (self.style[parent] * PRIME + self.path[child] + n.bit_length()) % FIELD

    def _kind(self, parent: int, name: str, tag: str) -> int:
        at = self.place.get((parent, name))
        if at is None:
            at = self.place[parent, name] = len(self.path)
            above = self.path[parent] if parent >= 0 else 0
            self.path.append((above * PRIME + zlib.crc32(name.encode("utf-8", "replace"))) % FIELD)
            self.parent.append(parent)
            self.plain.append(tag in PLAIN)
            self.root.append(tag in ("html", "body"))
            self.style.append(0)
            self.content.append(0)
        if parent >= 0:
            last = self.run.get(parent)
            if last is not None and last[0] == at:
                self.run[parent] = at, last[1] + 1
            else:
                if last is not None:
                    self._ended(parent)
                self.run[parent] = at, 1
        return at

    @staticmethod
    def _attributes(html: str, at: int, last: dict[str, int]) -> tuple[list[tuple[str, str]], int, bool]:
        """(name and value of each, place after the tag or -1 if it never ends, ended by a slash)."""
        out: list[tuple[str, str]] = []
        size = len(html)
        while True:
            m = ATTRIBUTE.match(html, at)
            at = m.end()
            if m[1] is None:
                if at >= size:
                    return out, -1, False
                return out, at + 1, html[at - 1] == "/"
            value = ""
            if m[2] is not None:
                quote = html[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = html.find(quote, at + 1) if at < last[quote] else html.find(">", at)
                    if end < 0:
                        return out, -1, False
                    value, at = html[at + 1 : end], end + (html[end] == quote)
                else:
                    v = BARE.match(html, at)
                    value, at = v[0], v.end()
            out.append((m[1].lower(), unescape(value) if "&" in value else value))

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool, int]] = []  # tag, kind, dropped, in an article, innermost element with a frame's name
        where: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each tag
        scopes: list[int] = []
        solid: list[int] = []  # places of those that are not inline
        veils: list[int] = []  # places of hidden ones
        kind, dropped, inside, frame = -1, False, False, -1
        text: list[str] = []
        last = {x: html.rfind(x) for x in ('"', "'", ">", "-->")}
        endless: set[str] = set()
        at, size = 0, len(html)

        def flush() -> None:
            if text:
                said = " ".join("".join(text).split())
                text.clear()
                if said:
                    if kind >= 0:
                        self.content[kind] = (self.content[kind] * PRIME + zlib.crc32(said.encode("utf-8", "replace"))) % FIELD
                    if not dropped:
                        self.blocks.append((kind, said, inside, frame))

        def cut(n: int) -> None:
            nonlocal kind, dropped, inside, frame
            while len(stack) > n:
                own = stack.pop()[0]
                where[own].pop()
                if own in SCOPE:
                    scopes.pop()
                if own not in INLINE:
                    solid.pop()
            while veils and veils[-1] >= n:
                veils.pop()
            kind, dropped, inside, frame = stack[-1][1:] if stack else (-1, False, False, -1)

        def push(tag: str) -> None:
            where[tag].append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            if tag not in INLINE:
                solid.append(len(stack))
            stack.append((tag, kind, dropped, inside, frame))

        def latest(tags: tuple[str, ...]) -> int:
            return max((where[t][-1] for t in tags if where[t]), default=-1)

        while at < size:
            k = html.find("<", at)
            if k < 0:
                k = size
            if k > at:
                said = html[at:k]
                text.append(unescape(said) if "&" in said else said)
            if k == size:
                break
            m = TAG.match(html, k)
            if m is None:
                after = html[k + 1 : k + 2]
                if html.startswith("<!--", k):
                    end = k + 4 if html.startswith(">", k + 4) else k + 5 if html.startswith("->", k + 4) else html.find("-->", k + 4) + 2 if k + 4 <= last["-->"] else size
                    at = end + 1
                elif after and after in "!?/":
                    end = html.find(">", k + 2) if k + 2 <= last[">"] else -1
                    at = size if end < 0 else end + 1
                else:
                    text.append("<")
                    at = k + 1
                continue
            tag, at = m[2].lower(), m.end()
            if html.startswith(">", at):
                attributes, at, slash = [], at + 1, False
            else:
                attributes, at, slash = self._attributes(html, at, last)
                if at < 0:
                    break
            if m[1]:  # an end tag
                own = where[tag][-1] if where[tag] else -1
                if own < 0:
                    if tag in ("br", "p"):
                        text.append(" ")
                    continue
                if tag in INLINE:
                    if solid and solid[-1] > own:
                        continue
                elif tag == "p" and scopes and scopes[-1] > own or tag not in TABLE and latest(CELLS) > own:
                    continue
                if tag not in INLINE:
                    flush()
                if tag in INLINE and (stack[own][1:] != (stack[own - 1][1:] if own else (-1, False, False, -1))):
                    flush()
                cut(own)
                continue
            if tag in RAW and not slash:
                end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                if end is not None:
                    at = end.start()
                    close = html.find(">", at)
                    at = size if close < 0 else close + 1
                elif tag in ENDLESS:
                    break
                else:
                    endless.add(tag)
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    text.append(" ")
                continue
            if where["head"] and tag not in HEAD and tag != "head":
                flush()
                cut(where["head"][0])
            if tag in INLINE:
                if attributes and not dropped:
                    names, hidden, out = self._names(attributes, tag, inside)
                    if hidden or out and not where["pre"] and not where["code"]:  # highlighted code has comments of its own
                        flush()
                        before = kind, dropped, inside, frame
                        kind = self._kind(kind, f"{tag}.{'.'.join(sorted(names))}", tag)
                        dropped = hidden
                        if hidden:
                            veils.append(len(stack))
                        else:
                            frame = self._frame(frame, out)
                        push(tag)
                        if slash:
                            cut(len(stack) - 1)
                            kind, dropped, inside, frame = before
                        continue
                push(tag)
                continue
            flush()
            if tag in SCOPE and where["select"]:
                cut(where["select"][0])
            paragraph = where["p"][-1] if where["p"] else -1
            if paragraph >= 0 and not (scopes and scopes[-1] > paragraph):
                cut(paragraph)
            if tag in ENDS:
                own, around = (latest(x) for x in ENDS[tag])
                if own > around:
                    cut(own)
            while stack and stack[-1][0] in INLINE and tag in SCOPE:
                cut(len(stack) - 1)
            names, hidden, out = self._names(attributes, tag, inside) if attributes else (frozenset(), False, frozenset())
            first = min(names) if names else ""
            if tag in ("html", "body") and where[tag]:
                continue  # a second one adds nothing
            kind = self._kind(kind, f"{tag}.{first}", tag)
            inside = inside or tag in IN or "main" in names and not out
            if tag in IN and dropped and not veils and not any(where[x] for x in HARD):
                dropped = False  # a form around the page's article is no part of it
            dropped = dropped or hidden or tag in OUT or (tag == "header" and not inside)
            if hidden:
                veils.append(len(stack))
            if out and not dropped and tag not in ("body", "html", "main") and not (tag == "article" and not out & {"comment", "comments", "ad", "related"}):
                frame = self._frame(frame, out)
            push(tag)
            if slash and tag not in SCOPE and tag not in PLAIN:
                cut(len(stack) - 1)
        flush()

    @staticmethod
    def _names(attributes: list[tuple[str, str]], tag: str, inside: bool) -> tuple[frozenset[str], bool, frozenset[str]]:
        """Words of class, id and role; whether the element is hidden; the words of OUT_NAMES that name it as a whole."""
        names: set[str] = set()
        out: set[str] = set()
        hidden = False
        for key, said in attributes:
            value = said.lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                hidden = True
            elif key in ("class", "id", "role"):
                names.update(NAME.findall(value))
                if key == "id" and tag in ANCHORED:
                    continue
                for token in value.split():
                    parts = frozenset(NAME.findall(token))
                    own = parts & OUT_NAMES
                    if own and parts <= OUT_NAMES | PLACES and not (inside and own <= HEADS):
                        out |= own
        return frozenset(names), hidden, frozenset(out)

    def _frame(self, around: int, out: frozenset[str]) -> int:
        self.named.append((around, bool(out & ASIDES)))
        return len(self.named) - 1

    def judged(self) -> tuple[list[tuple[int, str, bool]], list[int]]:
        """(element kind, text, part of the text unless the tree objects) of each block that names leave, and how each kind is judged."""
        blocks = self._unframed() if self.named else self.blocks
        inside = [x for x in blocks if x[2]]
        zone = [FIXED if x else JUDGED for x in self.root]
        if inside:
            within, size = [0] * len(self.path), [0] * len(self.path)
            total = sum(len(x[1]) for x in inside)
            for kind, said, _, _ in inside:
                within[kind] += 1
                size[kind] += total + 1 if self.plain[kind] else len(said)
            for k in range(len(size) - 1, -1, -1):
                if not within[k]:
                    zone[k] = APART if zone[k] else FIXED
                elif 2 * size[k] > total:
                    zone[k] = FIXED  # it holds a paragraph of the article, or most of its text
                if self.parent[k] >= 0:
                    within[self.parent[k]] += within[k]
                    size[self.parent[k]] += size[k]
        return [(kind, said, own or not inside) for kind, said, own, _ in blocks], zone

    def _unframed(self) -> list[tuple[int, str, bool, int]]:
        aside: list[bool] = []  # it or one around it; those around come first
        for up, own in self.named:
            aside.append(own or up >= 0 and aside[up])
        said = [x for x in self.blocks if x[3] < 0 or not aside[x[3]]]
        if not said:
            return self.blocks
        said = [x for x in said if x[2]] or said
        size = [0] * len(self.named)
        for _, text, _, frame in said:
            if frame >= 0:
                size[frame] += len(text)
        for k in range(len(size) - 1, -1, -1):
            if self.named[k][0] >= 0:
                size[self.named[k][0]] += size[k]
        total = sum(len(x[1]) for x in said)
        out: list[bool] = []
        for k, (up, _) in enumerate(self.named):
            out.append(up >= 0 and out[up] or aside[k] or 2 * size[k] <= total)
        return [x for x in self.blocks if x[3] < 0 or not out[x[3]]]


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


PARSED = "page_id {}, url string, host string, said long, nodes array<struct<path: long, style: long, content: long, zone: int>>, above array<int>, blocks array<struct<node: int, text: string, own: boolean>>"


def _lists(rows: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """Lists of structs, from rows that are lists of tuples."""
    ends = np.cumsum([0, *(len(x) for x in rows)]).astype(np.int32)
    columns = list(zip(*(t for row in rows for t in row), strict=True)) or [() for _ in fields]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]))


NODE = [("path", pa.int64()), ("style", pa.int64()), ("content", pa.int64()), ("zone", pa.int32())]
BLOCK = [("node", pa.int32()), ("text", pa.string()), ("own", pa.bool_())]


def parsed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> elements and blocks of each page, a hash of what they say and a number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                hosts, said, nodes, above, blocks = [], [], [], [], []
                for url, html in zip(texts(batch.column(1)), texts(batch.column(2)), strict=True):
                    page = Page(html)
                    kept, zone = page.judged()
                    hosts.append(host_of(url))
                    said.append(int.from_bytes(blake2b("\n".join(t for _, t, own in kept if own).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True))
                    nodes.append(list(zip(page.path, page.style, page.content, zone, strict=True)))
                    above.append(page.parent)
                    blocks.append([(k, t.encode("utf-8", "replace").decode(), own) for k, t, own in kept])
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(said, pa.int64()), _lists(nodes, NODE), pa.array(above, pa.list_(pa.int32())), _lists(blocks, BLOCK)], names=["page_id", "url", "host", "said", "nodes", "above", "blocks"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, PARSED.format(dict(rows.dtypes)["page_id"])).withColumn("row", F.monotonically_increasing_id())


def salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "row", F.lit(5)), F.lit(SALTS)).cast("int"))


def every_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def distinct_pages(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Written pages -> one of those of a host that say the same."""
    again = written(pages.groupBy("host", "said").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if again.count() <= most_broadcast:
        both = pages.join(F.broadcast(again), ["host", "said"], "left")
    else:
        both = salted(pages).join(every_salt(again), ["host", "said", "salt"], "left")
    return both.where("first is null or first = row")


def judged_branches(pages: DataFrame, least: float = LEAST, outside: float = OUTSIDE) -> DataFrame:
    """Distinct parsed pages -> (host, path, high): the branches to remove, and those outside an article to keep. Counts are combined before each shuffle."""
    node = pages.select("host", F.explode("nodes").alias("node")).select("host", "node.*").where(F.col("zone") > FIXED)

    def entropy(of: str, *more) -> DataFrame:
        n = node.groupBy("host", "path", of).agg(F.count("*").alias("n"), F.max("zone").alias("zone"))
        by = n.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max("zone").alias("zone"))
        scale = F.log(F.least("m", F.lit(SCALE)))
        return by.where(F.col("m") >= LEAST_PAGES).select("host", "path", F.least((F.log("m") - F.col("s") / F.col("m")) / scale, F.lit(1.0)).alias(of), *more)

    both = entropy("style", "zone").join(entropy("content"), ["host", "path"])
    low = (1 - GAMMA) * F.col("style") + GAMMA * F.col("content") < least
    high = (F.col("zone") == APART) & (F.col("style") >= outside) & (F.col("content") >= outside)
    return both.select("host", "path", low.alias("low"), high.alias("high")).where("low or high").select("host", "path", F.expr("high and not low").alias("high"))


def _joined(node: list[dict], above: list[int], blocks: list[dict], low: set[int] | frozenset[int], high: set[int] | frozenset[int]) -> str:
    if not low and not high:
        return " ".join(b["text"] for b in blocks if b["own"])
    gone: list[bool] = []
    back: list[bool] = []
    for x, up in zip(node, above, strict=True):
        gone.append(x["zone"] != FIXED and x["path"] in low or up >= 0 and gone[up])
        back.append(x["zone"] == APART and x["path"] in high or up >= 0 and back[up])
    kept = [b["text"] for b in blocks if b["node"] < 0 and b["own"] or b["node"] >= 0 and not gone[b["node"]] and (b["own"] or back[b["node"]])]
    return " ".join(kept or [b["text"] for b in blocks if b["own"]])  # a tree that takes all a page has says nothing of it


def extracted(pages: DataFrame, least: float = LEAST, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    own = written(parsed(pages))
    found = written(judged_branches(distinct_pages(own, most_broadcast), least))
    id_type = dict(own.dtypes)["page_id"]
    if found.count() <= most_broadcast:
        sets: dict[str, tuple[set[int], set[int]]] = {}
        for r in found.collect():  # MOST_BROADCAST rows at most
            sets.setdefault(r["host"], (set(), set()))[r["high"]].add(r["path"])
        shared = own.sparkSession.sparkContext.broadcast(sets)
        rows = own
    else:
        shared = None
        of_host = every_salt(found.groupBy("host").agg(F.collect_set(F.expr("case when not high then path end")).alias("low"), F.collect_set(F.expr("case when high then path end")).alias("high")))
        rows = salted(own).join(of_host, ["host", "salt"], "left").drop("salt")
    rows = rows.select("page_id", "url", "host", "nodes", "above", "blocks", *([] if shared else ["low", "high"]))
    none: tuple[frozenset[int], frozenset[int]] = (frozenset(), frozenset())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small(whole):
                if shared:
                    sets = [shared.value.get(h, none) for h in batch.column(2).to_pylist()]
                else:
                    sets = [(frozenset(x or ()), frozenset(y or ())) for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)]
                nodes, above, blocks = batch.column(3), batch.column(4), batch.column(5).to_pylist()
                text = [_joined(nodes[i].as_py() if any(x) else [], above[i].as_py() if any(x) else [], blocks[i], *x) for i, x in enumerate(sets)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(np.array([len(t) for t in text], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
