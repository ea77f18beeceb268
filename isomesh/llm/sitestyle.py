"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a style node is a path of elements, each with its class and id.
Copies of a page on a host count once. A node's presentations are the sequences of child elements it has on the host's
pages, its contents the texts of its branch. Its importance is the larger entropy of the two, with logarithms to the number of pages that have the node, so a
branch that looks and reads alike on all pages of a host (menus, notices, footers) comes near 0, and one that
differs comes near 1. Branches under LEAST_IMPORTANT, on MIN_PAGES pages or more, are cut from each page, but never one
that holds all blocks or most of the text of the page: there its lower branches decide.

Explicit marks are priors. Elements and names that mark page furniture are cut, as comments and links differ from page
to page and entropy can't tell them. An article or main element adds LANDMARK to the importance of itself and of the
branches in it: what is alike on all pages is cut there too, and text outside of it stays if it differs.

Trees are merged by grouped aggregation over (host, path): a host's pages never meet in one task.

Defined results: null html counts as empty, with an empty text. A null or unreadable address is a host of its own.
Unclosed and unknown elements, truncated pages and bare text are read as far as they go. A line break is white space
inside its block. Repeated rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isomesh.llm.work import chosen, written

#: Production parameters.
LEAST_IMPORTANT, MIN_PAGES = 0.2, 8
#: Elements nested deeper than this belong to the branch around them.
DEEPEST = 512
#: What an article or main element adds to the importance of its branches.
LANDMARK = 0.1
#: Lists of low nodes are broadcast up to so many bytes; beyond, hosts are dealt out over so many tasks each.
BROADCAST, SALTS = 32 << 20, 16

# Fixed values of the HTML standard: elements by how they are read.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements that an opening tag of the same kind closes, and those that a block element closes.
CLOSES_ITSELF = {"li", "option", "tr", "td", "th", "dt", "dd", "p"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "head", "fieldset", "map"}
LANDMARKS = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "status"}
#: Words that name page furniture in a class or id, and words that may stand beside them in one name.
NAMED = "ad ads advert adverts advertisement advertising adv sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification notifications alert alerts sidebar side aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commentlist replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay paywall pagination pager copyright legal disclaimer skip hidden search searchbar form"
BESIDE = "site page main top bottom left right global primary secondary local bar box list lists wrap wrapper container section area block panel link links item items group inner outer content row col column user reader readers button buttons icon icons posts stories articles to unit slot policy message by in with the and of"
FURNITURE_WORDS, PLAIN_WORDS = frozenset(NAMED.split()), frozenset(BESIDE.split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(\"|'|[^\s>\"'][^\s>]*)?)?")
GAP = re.compile(r"[\s/]*")
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
SPACE = re.compile(r"\s+")


def attributes_at(source: str, place: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from ``place`` on, the first of each name, and where the tag ends. A quote opens a value
    only behind an equals sign; one that nothing closes takes the rest of the page."""
    out: dict[str, str] = {}
    while True:
        place = GAP.match(source, place).end()
        if place >= len(source):
            return out, place
        if source[place] == ">":
            return out, place + 1
        m = ATTRIBUTE.match(source, place)
        place, value = m.end(), m[2] or ""
        if value in ('"', "'"):
            end = source.find(value, place)
            value, place = (source[place:end], end + 1) if end >= 0 else ("", len(source))
        out.setdefault(m[1].lower(), value)


class Block(NamedTuple):
    """Text of one block: the hashed paths of the style nodes that hold it, from the root, and its marks."""

    text: str
    path: tuple[int, ...]
    cut: bool
    inside: bool


class Frame(NamedTuple):
    name: str
    node: int
    cut: bool
    inside: bool


def furniture(names: str) -> bool:
    """True if a class or id among them names page furniture as a whole: "site-footer" does, "has-sidebar" and
    "article-form" don't."""
    for token in names.split():
        words = [w.lower() for w in WORD.findall(token)]
        if not FURNITURE_WORDS.isdisjoint(words) and all(w in FURNITURE_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


def marked(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """True for page furniture by its element, role or names. A header inside an article is the article's."""
    if name in FURNITURE or name == "header" and not inside:
        return True
    if not attributes or name in ("body", "html"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES or UNSEEN.search(attributes.get("style", "")):
        return True
    return name not in LANDMARKS and furniture(f"{attributes.get('class', '')} {attributes.get('id', '')}")


def child(parent: int, label: str) -> int:
    """The style node below a style node."""
    return xxhash.xxh3_64_intdigest(f"{parent}/{label}".encode("utf-8", "surrogatepass")) >> 1


class Page:
    """A page read once: its blocks of text, and the presentations of its style nodes."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.children: dict[int, list[str]] = {}
        self.within: set[int] = set()
        self.open = [Frame("", 0, False, False)]
        self.parts: list[str] = []
        self.at: tuple[Frame, tuple[int, ...]] | None = None
        place = 0
        while (at := source.find("<", place)) >= 0:
            if at > place:
                self.say(source[place:at])
            place = self.markup(source, at)
        if place < len(source):
            self.say(source[place:])
        self.end_block()

    def markup(self, source: str, at: int) -> int:
        """Reads what begins with the "<" at a place, and gives where it ends."""
        behind = lambda end, n: end + n if end >= 0 else len(source)
        if source.startswith("<!--", at):
            return behind(source.find("-->", at + 4), 3)
        if source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            self.say(source[at + 9 : end if end >= 0 else len(source)])
            return behind(end, 3)
        closing = source.startswith("</", at)
        m = TAG_NAME.match(source, at + 1 + closing)
        if not m:
            if closing or source.startswith(("<!", "<?"), at):
                return behind(source.find(">", at), 1)
            self.say("<")
            return at + 1
        name = m[0].lower()
        attributes, place = attributes_at(source, m.end())
        if closing:
            self.close(name)
        elif name in RAW:
            self.end_block()
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, place)
            return end.end() if end else len(source)
        else:
            self.start(name, attributes)
        return place

    def say(self, raw: str) -> None:
        if self.parts and self.open[-1].cut and not self.at[0].cut:
            return  # furniture inside a line of text
        if not self.parts:
            if raw.isspace():
                return
            self.at = self.open[-1], tuple(f.node for f in self.open[1:])
        self.parts.append(raw)

    def end_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
            frame, path = self.at
            if text:
                self.blocks.append(Block(text, path, frame.cut, frame.inside))
            self.parts = []

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "br":
            self.say(" ")
            return
        if name in INLINE and not (attributes and marked(name, attributes, True)):
            return
        if name not in INLINE:
            self.end_block()
        if name in VOID:
            return
        if name not in INLINE:
            while len(self.open) > 1 and (self.open[-1].name == "p" or self.open[-1].name == name and name in CLOSES_ITSELF):
                self.open.pop()
        if len(self.open) > DEEPEST:
            return
        top = self.open[-1]
        label = ".".join([name, *sorted(attributes.get("class", "").split()), *filter(None, [attributes.get("id")])])
        inside = top.inside or name in LANDMARKS or attributes.get("role", "").lower() in LANDMARKS
        cut = top.cut or marked(name, attributes, top.inside)
        node = child(top.node, label)
        self.children.setdefault(top.node, []).append(label)
        self.children.setdefault(node, [])
        if inside and not cut:
            self.within.add(node)
        self.open.append(Frame(name, node, cut, inside and not cut))

    def close(self, name: str) -> None:
        if name == "br":
            self.say(" ")
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == name:
                if name not in INLINE or self.parts and self.at[0].cut:
                    self.end_block()
                del self.open[i:]
                return
        if name not in INLINE:
            self.end_block()

    def presentations(self) -> dict[int, str]:
        """By style node, the sequence of its children, repeats of one child as one."""
        return {n: ">".join(a for a, b in zip(labels, [None, *labels], strict=False) if a != b) for n, labels in self.children.items()}

    def contents(self) -> dict[int, int]:
        """By style node, a hash of all texts in its branch."""
        held: dict[int, list[str]] = {}
        for b in self.blocks:
            one = xxhash.xxh3_64_hexdigest(b.text.encode("utf-8", "surrogatepass"))
            for n in b.path:
                held.setdefault(n, []).append(one)
        return {n: xxhash.xxh3_64_intdigest(" ".join(t)) >> 1 for n, t in held.items()}

    def text(self, low: set[int]) -> str:
        """The main text, without the branches of low importance."""
        kept = [b for b in self.blocks if not b.cut]
        chars, blocks = Counter(), Counter()
        for b in kept if low else ():
            for n in low.intersection(b.path):
                chars[n] += len(b.text)
                blocks[n] += 1
        total = sum(len(b.text) for b in kept)
        cut = {n for n in chars if blocks[n] < len(kept) and 2 * chars[n] <= total}
        return "\n".join(b.text for b in kept if cut.isdisjoint(b.path))


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, node, kind, feature, inside: of each page's nodes outside furniture, the presentation and the content, and
    whether the node is in an article or main element."""
    for batch in batches:
        rows: list[tuple[str, int, str, int, bool]] = []
        for source, host in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True):
            page = Page(source)
            free = {n for b in page.blocks if not b.cut for n in b.path}
            rows += [(host, n, "p", xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) >> 1, n in page.within) for n, p in page.presentations().items() if n in free]
            rows += [(host, n, "c", c, n in page.within) for n, c in page.contents().items() if n in free]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["host", "node", "kind", "feature", "inside"])


def pages_of(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))
    return chosen(pages, ("page_id", "bigint"), ("url", "string"), ("html", "string")).fillna("", ["html"]).withColumn("host", host)


def unimportant(pages: DataFrame) -> DataFrame:
    """host, node: the style nodes whose composite importance is low. pages: host, html."""
    features = pages.select("html", "host").dropDuplicates().mapInArrow(feature_batches, "host string, node bigint, kind string, feature bigint, inside boolean")
    counts = features.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n"), F.max("inside").alias("inside"))
    kinds = counts.groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max("inside").alias("inside"))
    # -sum p log p with p = n / m, to the base m.
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
    nodes = kinds.groupBy("host", "node").agg(F.max("m").alias("m"), (F.max(entropy) + F.when(F.max("inside"), LANDMARK).otherwise(0.0)).alias("importance"))
    return nodes.where((F.col("m") >= MIN_PAGES) & (F.col("importance") < LEAST_IMPORTANT)).select("host", "node")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the main text of every page."""
    rows = pages_of(pages)
    low = written(unimportant(rows), "unimportant")
    # Low nodes of a host are few (its templates); they come to the pages as one list.
    lists = low.groupBy("host").agg(F.collect_set("node").alias("low")).select(F.col("host").alias("l_host"), "low")
    size = low.agg(F.count("*"), F.sum(F.length("host"))).first()
    same = F.col("host") == F.col("l_host")
    if 16 * size[0] + 4 * (size[1] or 0) <= BROADCAST:
        joined = rows.join(F.broadcast(lists), same, "left")
    else:
        # Pages of a large host are dealt out over several tasks, each with a copy of the host's list.
        many = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("own", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(many, same & (F.col("own") == F.col("salt")), "left")
    joined = joined.select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Page(s).text(set(n or ())) for s, n in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    """One row for each page."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
