"""Main text of web pages, with the templates of their sites removed.

Each page is read into a tree of elements; each element has a hash of its subtree.
Spark counts, for each host, in how many of its contents a subtree occurs: pages with
the same article text are one, so copies of an article have one vote.  Block elements
whose subtree recurs in ``SHARE`` of the host's contents, but in ``MANY`` at least or, on a
smaller host, in all of them, are its template and go; ``ENOUGH`` contents suffice anywhere
(the template of a section of a large host), and fewer than ``LEAST`` never do.  Inline
elements go only with a block.  So do elements whose name, role, class or id says that
they are no part of the article; the article itself and what it stands in are never
judged so.  Paragraphs, headings, lists and tables inside the article stay, however
often they recur, but for lists and tables of nothing but links.  A page without article and main is all text, and there paragraphs go
like other blocks.

Template hashes are sent to all executors only if they are few; else each page's own are
looked up by a join, so no task holds the list of a host.

Defined results: a null or empty html, and a page without text, give an empty text; a
null url is a host of its own; repeated rows are pages like others; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import scratch, slices, table

SHARE, LEAST, MANY, ENOUGH, MOST_SENT = 0.2, 3, 8, 200, 100_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg select".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr li dd dt".split())
#: An element of the first kind ends open ones of the second, up to one of the third.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
}
P_SCOPE = frozenset("article aside blockquote body button caption center dd details dialog div dl dt fieldset figure footer form header html li main nav ol section table td th ul".split())

# What isn't the article, by name, role, and the words of a token of class or id.
NOT_ARTICLE = frozenset("nav aside footer form menu button dialog input label datalist object canvas audio video annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs comment comments commentlist respond disqus consent cookie cookies gdpr footer masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pagination pager popup promo promos promotion related recommended share sharing sidebar sidebars skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table".split())
STAYS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Their content is code, so without an end tag they reach to the end of the page.
CODE = frozenset(["script", "style"])
#: These do not nest and never span the end of the page's text: what begins or ends so within them shows that their end tag is missing.
_UNNESTED = frozenset(["iframe", "noscript", "select"])
_RAW_END = {name: re.compile(rf"(</{name}(?![a-z0-9-]))" + (rf"|<{name}(?![a-z0-9-])|</(?:article|main|body|html)(?![a-z0-9-])" if name in _UNNESTED else ""), re.I | re.A) for name in RAW}


def _listed(value: str) -> bool:
    """Whether a class or id has a token all of whose words are ``PARTS``: ``cookie-notice``, but not ``no-sidebar``."""
    return any((words := _WORD.findall(token)) and PARTS.issuperset(words) for token in value.split())


class Page:
    """The elements of a page in order, and its blocks: lists of (element, raw text)."""

    def __init__(self, source: str):
        self.tags, self.parents, self.foreign, self.roots = ["#"], [-1], [False], []
        self.parts: list[list[str]] = [[]]
        self.hashes = [0]
        self.blocks: list[list[tuple[int, str]]] = [[]]
        self.stack = [0]
        self.endless: set[str] = set()
        self.root: int | None = None
        self.listed, self.aside = [False], [False]
        self.unlinked = [False]  # whether it has text outside links
        self.read(source)
        while len(self.stack) > 1:
            self._close()

    def read(self, source: str) -> None:
        at = 0
        for m in iter(lambda: _TAG.search(source, at), None):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._end(name)
                continue
            if name in ("svg", "math") and (m[3] or m[6] or "").endswith("/"):
                continue
            if name in RAW:  # up to its end tag nothing is a tag
                end = self._raw_end(source, name, at)
                if end < 0 and name in CODE:
                    return
                at = max(at, end)
                continue
            self._start(name, m[3] or m[6] or "")
        if at < len(source):
            self._text(source[at:])

    def _raw_end(self, source: str, name: str, at: int) -> int:
        """Where the end tag of a raw element begins; -1 if it has none of its own."""
        if name in self.endless:
            return -1
        found = _RAW_END[name].search(source, at)
        if not found:
            self.endless.add(name)
        return found.start() if found and found[1] else -1

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        self.blocks[-1].append((top, raw))
        own = " ".join(raw.split())
        if own:
            self.parts[top].append(own)
            self.unlinked[top] = True

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._end_open(frozenset(["p"]), P_SCOPE)
        if name in ENDS:
            self._end_open(*ENDS[name])
        if name in BLOCKS:
            self._break()
        elif name == "br":
            self.blocks[-1].append((self.stack[-1], " "))
        if name in VOID:
            return
        listed, header, role = False, False, ""
        if attributes:
            for key, *value in _ATTRIBUTE.findall(attributes):
                value = "".join(value).lower()
                if key.lower() == "role":
                    role = value
                else:
                    listed = listed or _listed(value)
                    header = header or "header" in value.split()
        foreign = name in NOT_ARTICLE or role in ROLES
        # The header of the page goes; that of an article holds its heading.
        outside = not any(self.tags[i] == "article" for i in self.stack)
        foreign = foreign or name == "header" and outside
        # The id of a heading is what links point to.
        listed = (listed or header and outside) and name not in ("html", "body") and name not in HEADINGS
        if (name in ("article", "main") or role == "main") and not foreign:
            self.roots.append(len(self.tags))
        self.stack.append(len(self.tags))
        self.parents.append(self.stack[-2])
        self.tags.append(name)
        self.foreign.append(foreign)
        self.listed.append(listed)
        self.aside.append(foreign and name != "form")  # a form may hold the page
        self.parts.append([])
        self.hashes.append(0)
        self.unlinked.append(False)

    def _end_open(self, which: frozenset, upto: frozenset) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[i]]
            if tag in which:
                while len(self.stack) > i:
                    self._close()
                return
            if tag in upto:
                return

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._break()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[i]] == name:
                while len(self.stack) > i:
                    self._close()
                return

    def _close(self) -> None:
        i = self.stack.pop()
        if self.tags[i] in BLOCKS:
            self._break()
        if self.parts[i]:
            digest = xxhash.xxh64_intdigest(f"{self.tags[i]}|{' '.join(self.parts[i])}")
            self.hashes[i] = digest - (1 << 64) if digest >> 63 else digest
            self.parts[self.parents[i]].append(f"<{digest:x}>")
            self.parts[i] = []
            self.unlinked[self.parents[i]] |= self.unlinked[i] and self.tags[i] != "a"

    def main(self) -> int:
        if self.root is None:
            self.root = self._main()
        return self.root

    def _main(self) -> int:
        """The article with the most text; else the main element with the most; else everything.

        Ones outside what is listed come first, as a comment is an article too; but an
        article that holds most of the main element, or stands alone, is one whatever is
        written on it or around it.
        """
        roots = [i for i in self.roots if not self._above(i, self.aside)]
        if not roots:
            return 0
        held = self._inside(roots)
        sizes = dict.fromkeys(roots, 0)
        for block in self.blocks:
            for i, raw in block:
                for root in held[i]:
                    sizes[root] += len(raw)
        plain = [i for i in roots if not self._above(i, self.listed)]
        most = lambda own: max(own, key=lambda i: (sizes[i], -i), default=0)
        of = lambda own, article: most([i for i in own if (self.tags[i] == "article") == article])
        if article := of(plain, True):
            return article
        article, main = of(roots, True), of(plain, False) or of(roots, False)
        return article if article and 2 * sizes[article] > sizes.get(main, 0) else main

    def _above(self, i: int, marks: list[bool]) -> bool:
        while i > 0 and not marks[i]:
            i = self.parents[i]
        return i > 0

    def _inside(self, roots: list[int]) -> list[tuple[int, ...]]:
        held: list[tuple[int, ...]] = [()]
        for i in range(1, len(self.tags)):
            above = held[self.parents[i]]
            held.append((*above, i) if i in roots else above)
        return held

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that may be a template."""
        root = self.main()
        inside = self._inside([root]) if root else None
        return {h for i, h in enumerate(self.hashes) if h and self.tags[i] in BLOCKS and not (inside and inside[i] and (i == root or self._stays(i)))}

    def _stays(self, i: int) -> bool:
        """Whether an element inside the article stays, however often it recurs."""
        return self.tags[i] in STAYS and not (self.tags[i] in LISTS and not self.unlinked[i])

    def content(self) -> int:
        """A hash of the text that the page has before templates are known."""
        digest = xxhash.xxh64_intdigest(self.text(set()))
        return digest - (1 << 64) if digest >> 63 else digest

    def text(self, template: set[int]) -> str:
        root = self.main()
        inside, gone = [root == 0], [False]
        for i in range(1, len(self.tags)):
            inside.append(inside[self.parents[i]] or i == root)
            kept = root and inside[i] and (i == root or self._stays(i))
            if i == root:  # what is around the article never takes it along
                gone.append(False)
                continue
            gone.append(gone[self.parents[i]] or self.foreign[i] or self.listed[i] or (self.hashes[i] in template and not kept))
        out = []
        for block in self.blocks:
            own = " ".join(html.unescape("".join(raw for i, raw in block if inside[i] and not gone[i])).split())
            if own:
                out.append(own)
        return "\n".join(out)


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST, many: int = MANY, enough: int = ENOUGH) -> DataFrame:
    """``host`` and ``subtree``, the hash of a subtree that recurs in its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                hosts, found, contents = [], [], []
                for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    page = Page(source or "")
                    own = page.subtrees() | {0}  # 0 counts the contents
                    hosts += [host] * len(own)
                    found += own
                    contents += [page.content()] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64()), pa.array(contents, pa.int64())], names=["host", "subtree", "content"])

    seen = _hosts(pages).select("host", "html").mapInArrow(run, "host string, subtree bigint, content bigint")
    counts = seen.distinct().groupBy("host", "subtree").count()
    with scratch(pages.sparkSession) as keep:
        counts = table(counts.where(F.col("count") >= least), "subtrees")
        contents = counts.where("subtree = 0").select("host", F.col("count").alias("contents"))
        often = (F.col("count") >= F.greatest(share * F.col("contents"), F.least("contents", F.lit(many)))) | (F.col("count") >= enough)
        return keep(table(counts.where("subtree <> 0").join(contents, "host").where(often).select("host", "subtree"), "templates"))


def _looked_up(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``subtrees``, those of each page that are templates of its host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                every = [Page(source or "").subtrees() for source in batch.column(2).to_pylist()]
                at = pa.array([i for i, own in enumerate(every) for _ in own], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([h for own in every for h in own], pa.int64())], names=["of", "key", "subtree"])

    rows = rows.withColumn("__key", F.xxhash64("html"))
    own = rows.select("host", "__key", "html").mapInArrow(run, "of string, key bigint, subtree bigint").distinct()
    # A template may be in most pages of a host, so each is dealt out to sixteen places.
    own = own.withColumn("salt", F.pmod("key", F.lit(16)))
    found = found.select(F.col("host").alias("of"), "subtree", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("salt"))
    own = own.join(found, ["of", "subtree", "salt"]).groupBy("of", "key").agg(F.collect_list("subtree").alias("subtrees"))
    return rows.join(own, (F.col("host") == F.col("of")) & (F.col("__key") == F.col("key")), "left")


def main_text(pages: DataFrame, share: float = SHARE, least: int = LEAST, many: int = MANY, enough: int = ENOUGH, sent: int = MOST_SENT) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` for each page."""
    found = templates(pages, share, least, many, enough)
    rows, shared = _hosts(pages), None
    if found.count() <= sent:
        lists: dict[str, set[int]] = {}
        for host, subtree in found.collect():
            lists.setdefault(host, set()).add(subtree)
        shared = pages.sparkSession.sparkContext.broadcast(lists)
        rows = rows.select("page_id", "url", "html", "host")
    else:
        rows = _looked_up(rows, found).select("page_id", "url", "html", "subtrees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value if shared else None
        for whole in batches:
            for batch in slices(whole, "html"):
                last = batch.column(3).to_pylist()
                own = [lists.get(host, set()) for host in last] if shared else [set(x or ()) for x in last]
                texts = [Page(source or "").text(template) for source, template in zip(batch.column(2).to_pylist(), own)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2]]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars bigint"]))
