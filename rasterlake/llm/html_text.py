"""Main text of web pages by host consensus.

Each page is read into a tree of elements and text blocks; of it a skeleton without the texts is kept (parents, paths, and the lengths and
digests of the blocks). A block is a notice of the site if it stands on LEAST or more of a host's pages that have different text beside it
(told apart by their longest other block), and on at least half as many as the host has different pages. From the root the reader goes
down to the child that holds all other clean text, until an article or no such child is left; the generalised tag-class path of that
container is the page's vote. Spark counts the votes per host, near-equal pages (with the same longest block) once, and every page is read
again with the winning paths of its host:

* A path with STRONG of the host's votes (and LEAST pages) decides where it holds most of a page's clean text: what stands beside it is no
  part of the layout of the others and goes, labelled or not. Titles and leads that a host always puts beside the body stay, since then the
  element around both gets the votes.
* Else, of the winning paths on the page, the one with the most clean text, then the most votes, if it leaves out no clean text of the
  page's own container; else that container.

Notices never empty a page: where they would leave less than FLOOR of the clean text, the page is read without them.

Votes are partial sums, so a host with most of the pages is no hot key; the winners (paths with at least a share of the votes, so a
bounded number per host) are small rows, broadcast if few, else joined by shuffle, which Spark can split by rows of a hot host.

Defined cases: a null page gives an empty text, as does a page without clean text; a null or odd url belongs to the host ''; repeated
rows vote once and are read alike; an empty table gives an empty result; other columns pass through under any name.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import free_name, sized, slices, small_batches

SHARE = 0.05  # of a host's votes that a path needs to be used
REPEATED = 0.5  # of a host's different pages on which a block stands that is taken for a notice of the site
LEAST = 3  # different pages that a notice or a strong path needs
STRONG = 0.8  # of a host's votes with which a path leaves out what stands beside it
FLOOR = 0.25  # of a page's clean text that notices have to leave

# Element names and label words.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
RAW = set("script style textarea title xmp noembed noframes iframe".split())
DROPPED = set(
    "head nav footer aside form script style noscript template iframe object svg canvas select button textarea input label dialog menu "
    "audio video map fieldset noembed noframes xmp title".split()
)
CONTAINERS = set("html body main article section div td table tbody tr center span".split())
CLOSES = {  # an opening tag ends these open elements, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
LABEL_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside nav navbar navigation menu menus breadcrumb "
    "breadcrumbs header masthead topbar footer copyright share sharing social related recommended recommendations comment comments disqus "
    "respond replies reply pagination pager toolbar login search widget widgets".split()
)
KEPT_WORDS = set("article post entry story".split())  # their headers belong to the text
WITH_WORDS = set("has with no without".split())  # as in "has-sidebar": said of what stands beside
DROPPED_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_TAG = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_ODD = re.compile(r"[^a-z0-9_-]+")
_DIGITS = re.compile(r"[0-9]+")
_SPLIT = re.compile(r"[^a-z]+")


class Page:
    """Elements in page order (parents before children) and text blocks with the element each belongs to."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path = [-1], ["#"], [0]
        self.dropped, self.labelled, self.main = [False], [False], [False]  # labelled: to be dropped unless the main part is inside
        self.paths: dict[tuple[int, str], int] = {}
        self.path_key: list[tuple[int, str]] = [(-1, "")]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(html)
        self._settle()

    def _settle(self) -> None:
        """Drop what is in labelled elements, other than those around an article or main element."""
        n = len(self.parent)
        around = self.main[:]
        for e in range(n - 1, 0, -1):
            if around[e]:
                around[self.parent[e]] = True
        for e in range(1, n):
            self.dropped[e] = self.dropped[e] or self.dropped[self.parent[e]] or self.labelled[e] and not around[e]
        self.blocks = [b for b in self.blocks if not self.dropped[b[0]]]

    def _read(self, html: str) -> None:
        stack, open_tags = [0], {}
        pieces: list[str] = []
        links = in_link = 0
        at = 0

        def end_block():
            nonlocal links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] in INLINE:
                        depth -= 1
                    self.blocks.append((stack[depth], text, links))
                pieces.clear()
            links = 0

        def add(text: str):
            nonlocal links
            if not self.dropped[stack[-1]]:
                pieces.append(text)
                if in_link:
                    links += len(text.strip())

        def pop_to(depth: int):
            nonlocal in_link
            end = stack[depth:]
            for e in end:
                tag = self.tag[e]
                open_tags[tag] -= 1
                in_link -= tag == "a"
            if any(self.tag[e] not in INLINE for e in end):
                end_block()
            del stack[depth:]

        def close_open(kinds, stops):
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[depth]]
                if tag in kinds:
                    pop_to(depth)
                    return
                if tag in stops:
                    return

        for m in _TAG.finditer(html):
            if m.start() < at:
                continue  # inside a script or the like
            if m.start() > at:
                add(unescape(html[at:m.start()]))
            at = m.end()
            name = m["name"]
            if not name:
                continue
            name = name.lower()
            if m["close"]:
                if open_tags.get(name):
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] != name:
                        depth -= 1
                    pop_to(depth)
                elif name not in INLINE:
                    end_block()
                continue
            if name == "br":
                add(" ")
                continue
            if name not in INLINE:
                end_block()
                if open_tags.get("p"):
                    close_open({"p"}, {"button", "td", "th", "table"} - ({"table"} if name == "table" else set()))
                if name in CLOSES:
                    close_open(*CLOSES[name])
            if name in VOID:
                continue
            rest = m["rest"]
            element = self._add(stack[-1], name, rest)
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                at = close.start() if close else len(html)
                if rest.endswith("/>") and name == "iframe":
                    continue
            elif rest.endswith("/>") and name in ("svg", "path"):
                continue
            stack.append(element)
            open_tags[name] = open_tags.get(name, 0) + 1
            in_link += name == "a"
        if at < len(html):
            add(unescape(html[at:]))
        end_block()

    def _add(self, parent: int, name: str, rest: str) -> int:
        label, words, role = name, (), ""
        if "=" in rest:
            classes, marks = "", ""
            for a, x, y, z in _ATTR.findall(rest):
                a = a.lower()
                if a == "class":
                    classes = (x or y or z).lower()
                    marks += " " + (x or y or z)
                elif a == "id":
                    marks += " " + (x or y or z)
                elif a == "role":
                    role = (x or y or z).strip().lower()
            if classes:
                names = sorted({_DIGITS.sub("#", _ODD.sub("", c)) for c in classes.split()} - {""})
                label = ".".join([name, *names])
            if marks:
                words = {w for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", marks).lower()) if w}
        key = (self.path[parent], label)
        path = self.paths.get(key)
        if path is None:
            path = self.paths[key] = len(self.path_key)
            self.path_key.append(key)
        main = name in ("article", "main") or role == "main"
        dropped = self.dropped[parent] or name in DROPPED or role in DROPPED_ROLES
        labelled = False
        if not dropped and words and not main and name not in ("html", "body") and WITH_WORDS.isdisjoint(words):
            hits = LABEL_WORDS.intersection(words)
            labelled = bool(hits) and not (hits == {"header"} and KEPT_WORDS.intersection(words))
            dropped = labelled and name in INLINE
        if name == "header" and not dropped:
            e = parent
            while e > 0 and self.tag[e] != "article":
                e = self.parent[e]
            dropped = e <= 0
        self.parent.append(parent)
        self.tag.append(name)
        self.path.append(path)
        self.dropped.append(dropped)
        self.labelled.append(labelled)
        self.main.append(main)
        return len(self.parent) - 1

    def clean(self) -> list[tuple[int, int, int]]:
        """Element, length and digest of the blocks that are not mostly links."""
        return [(e, len(text), digest(text)) for e, text, links in self.blocks if 2 * links <= len(text)]

    def weights(self, notices: frozenset[int] = frozenset()) -> list[int]:
        return weights(self.parent, self.clean(), notices)

    def container(self, weight: list[int]) -> int:
        return container(self.parent, self.tag, weight)

    def skeleton(self) -> bytes:
        """What a vote needs of the page."""
        return pickle.dumps((self.parent, self.tag, self.path, self.path_key, self.clean()), protocol=5)

    def text_in(self, chosen: list[bool]) -> str:
        inside = chosen[:]
        for e in range(1, len(inside)):
            inside[e] = inside[e] or inside[self.parent[e]]
        return "\n".join(text for e, text, _ in self.blocks if inside[e])

    def elements_at(self, path: str) -> list[bool] | None:
        """The elements of a path; None if the page has none."""
        at = 0
        for label in path.split(">") if path else ():
            at = self.paths.get((at, label), -1)
            if at < 0:
                return None
        return [p == at for p in self.path]

    def text_at(self, paths: list[str], notices: frozenset[int] = frozenset(), strong: str | None = None) -> str:
        """Text under the strong path or that of the paths with the most clean text here, as the module says, else under the own container."""
        weight = self.weights(notices)
        own = self.container(weight)

        def held_by(chosen: list[bool]) -> int:
            return sum(w for w, c in zip(weight, chosen) if c)

        if strong is not None:
            chosen = self.elements_at(strong)
            if chosen and 2 * held_by(chosen) > weight[own]:
                return self.text_in(chosen)
        best, most = None, weight[own] - 1
        for path in paths:
            chosen = self.elements_at(path)
            if chosen:
                held = held_by(chosen)
                if held > most:
                    text = self.text_in(chosen)
                    if text:
                        best, most = text, held
        return best if best is not None else self.text_in([e == own for e in range(len(self.parent))])


def weights(parent: list[int], clean: list[tuple[int, int, int]], notices: frozenset[int] = frozenset()) -> list[int]:
    """Clean text in each element: without that of the notices, unless they would leave too little."""
    weight = [0] * len(parent)
    left = sum(n for _, n, d in clean if d not in notices)
    if left < FLOOR * sum(n for _, n, _ in clean):
        notices = frozenset()
    for e, n, d in clean:
        if d not in notices:
            weight[e] += n
    for e in range(len(weight) - 1, 0, -1):
        weight[parent[e]] += weight[e]
    return weight


def container(parent: list[int], tag: list[str], weight: list[int]) -> int:
    """The element a page's clean text is in."""
    best = [0] * len(parent)
    for e in range(len(parent) - 1, 0, -1):
        p = parent[e]
        if weight[e] and (not best[p] or weight[e] >= weight[best[p]]):
            best[p] = e
    here = 0
    while tag[here] != "article":
        child = best[here]
        if not child or weight[child] < weight[here] or tag[child] not in CONTAINERS:
            break
        here = child
    return here


def vote_of(skeleton: bytes, notices: frozenset[int]) -> str:
    """The generalised path of the page's container."""
    parent, tag, path, path_key, clean = pickle.loads(skeleton)
    labels, key = [], path_key[path[container(parent, tag, weights(parent, clean, notices))]]
    while key[0] >= 0:
        labels.append(key[1])
        key = path_key[key[0]]
    return ">".join(reversed(labels))


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def read_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Of every page with text: ``host``, ``blocks`` (digests, no two the same), ``longest`` and ``second`` (the longest of them, null if
    there are none) and ``skeleton``. Written to the shared folder, since notices and votes both read it."""
    rows = pages.filter(F.col(html_col).isNotNull()).select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    kinds = [("blocks", pa.list_(pa.int64())), ("longest", pa.int64()), ("second", pa.int64()), ("skeleton", pa.binary())]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = []
            for html in batch.column("html").to_pylist():
                page = Page(html)
                size = {digest(text): len(text) for _, text, _ in page.blocks}
                long = [*sorted(size, key=lambda d: (-size[d], d))[:2], None, None]
                found.append((sorted(size), long[0], long[1], page.skeleton() if size else None))
            columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*found), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), *columns], ["host", *[n for n, _ in kinds]])

    read = rows.mapInArrow(step, "host string, blocks array<bigint>, longest bigint, second bigint, skeleton binary")
    return cut_lineage(read.filter(F.col("longest").isNotNull()))


def notices(read: DataFrame, share: float = REPEATED) -> DataFrame:
    """``host`` and ``notices``: digests of the blocks that stand beside so many different texts."""
    of_host = sized(read.groupBy("host").agg(F.count_distinct("longest").alias("all")))
    beside = F.when(F.col("block") == F.col("longest"), F.col("second")).otherwise(F.col("longest"))
    counted = (
        read.select("host", "longest", "second", F.explode("blocks").alias("block")).select("host", "block", beside.alias("beside")).distinct()
        .groupBy("host", "block").agg(F.count("beside").alias("n"))
    )
    found = counted.filter(F.col("n") >= LEAST).join(of_host, "host").filter(F.col("n") >= F.col("all") * share)
    return found.groupBy("host").agg(F.collect_list("block").alias("notices"))


def with_notices(pages: DataFrame, known: DataFrame, host: Column, name: str) -> DataFrame:
    """``pages`` with the notices of their host in a column ``name``."""
    own = free_name(pages.columns, "host")
    return pages.withColumn(own, host).join(known.select(F.col("host").alias(own), F.col("notices").alias(name)), own, "left").drop(own)


def votes(read: DataFrame, known: DataFrame) -> DataFrame:
    """``host``, ``path`` and ``longest``: one row for each page. ``known`` are the hosts' notices."""
    rows = with_notices(read.select("host", "longest", "skeleton"), known, F.col("host"), "notices")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            skeletons, own = batch.column("skeleton").to_pylist(), batch.column("notices").to_pylist()
            found = [vote_of(s, frozenset(n or ())) for s, n in zip(skeletons, own)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.string()), batch.column("longest")], ["host", "path", "longest"])

    return rows.mapInArrow(step, "host string, path string, longest bigint")


def winners(cast: DataFrame, share: float = SHARE) -> DataFrame:
    """``host``, ``paths``, most voted first and at most 1 / share of them, and ``strong``: the one path that decides, or null."""
    counted = cast.distinct().groupBy("host", "path").agg(F.count("*").alias("n"))
    of_host = Window.partitionBy("host")
    strong = (F.col("n") >= F.col("all") * STRONG) & (F.col("n") >= LEAST)
    return (
        counted.withColumn("all", F.sum("n").over(of_host)).filter(F.col("n") >= F.col("all") * share)
        .groupBy("host").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("p"), F.max(F.when(strong, F.col("path"))).alias("strong")
        )
        .select("host", F.col("p.path").alias("paths"), "strong")
    )


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """``pages`` without the html, with ``text`` added (under another name if the pages have one)."""
    small_batches(pages.sparkSession)
    read = read_pages(pages, url_col, html_col)
    known = sized(notices(read))
    best = sized(winners(votes(read, known), share))
    host, paths, strong, text, left = (free_name(pages.columns, n) for n in ("host", "paths", "strong", "text", "notices"))
    chosen = pages.withColumn(host, host_of(url_col)).join(
        best.select(F.col("host").alias(host), F.col("paths").alias(paths), F.col("strong").alias(strong)), host, "left"
    ).drop(host)
    chosen = with_notices(chosen, known, host_of(url_col), left)
    kept = [c for c in pages.columns if c != html_col]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = [
                Page(html).text_at(own or [], frozenset(seen or ()), one) if html is not None else ""
                for html, own, seen, one in zip(*[batch.column(c).to_pylist() for c in (html_col, paths, left, strong)])
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found, pa.string())], [*kept, text])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html_col], f"`{text}` string"])
    return chosen.select(*kept, html_col, paths, left, strong).mapInArrow(step, schema)
