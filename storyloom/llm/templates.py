"""Main text of web pages: site templates are removed by counting element subtrees per host.

Each page is parsed into elements (a tag scanner with the implied end tags of HTML, raw text
elements and unclosed tags as browsers treat them).  Subtrees are hashed in two forms: exact, with
all their text, and as a shape, in which every run of text is one sign, every run of equal
neighbours is one, and the place under the body counts.  So a menu whose links change from page
to page still has one shape.  Spark counts, per host, on how many different pages a hash stands;
on at least ``MIN_PAGES`` it is a template, however many pages the host has.

What templates must not delete is counted as well: a container whose place, on the host's pages
that have it, holds on average at least half of the page's text and mostly the heading, and
mostly another text than on the other pages, is the core of these pages.  Outside the core every subtree with a counted shape goes, whatever its tags
are called; inside it, or where a host has no core, exact templates go.  Paragraphs and headings
are content however often they recur, and copies of a page count once, so repeated articles stay.

Names break ties: what elements call themselves (nav, footer, form, article, role and class words
such as menu or comments) decides inside the core, outside it for blocks that stand on fewer than
``MIN_PAGES`` pages, and alone on hosts of so few pages.

A host's counted shapes and cores are few, as sites have few layouts; they meet the pages by
broadcast while their bytes are at most ``BROADCAST_BYTES`` and by a join on the host beyond.
Exact templates may grow with the host; a page is only given those that stand on it and would
change its text, by a join on (host, hash) and one on (host, page).

Defined results: null or empty html gives an empty text; markup that never closes runs to the
end of its parent or page; very long pages are read whole; a null or unreadable url belongs to
the host ''; of containers of one place within each other the innermost that qualifies is the
core; repeated pages are rows of their own; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .cluster import bounded_batches, staged

MIN_PAGES = 5
#: Share of a page's text, of the pages with the heading in it, and of different contents, that make a place the core.
CORE = 0.5
#: Bytes of hosts' shapes and cores, and pages with lists of exact templates, that may be broadcast.
BROADCAST_BYTES, BROADCAST_PAGES = 64 << 20, 200_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_WHITE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - set("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split()) | {"p"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}, "p": {"td", "th", "button", "table", "li", "dd"}}

NEVER = RAW | set("head nav footer aside form button select input svg canvas object embed audio video map dialog menu datalist".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup popup modal overlay sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead topbar toolbar comment comments disqus reply replies respond share sharing social related recommended recommendations pagination pager login search skip alert".split()
)
WHOLE = set("html body article main".split())
#: Elements within a run of text; a link is told from plain text.
INLINE = set("a abbr b bdi bdo big cite code data dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: Inside an article only these can be templates; paragraphs, headings and inline elements are content.
HOLDERS = set("div section aside ul ol dl table form header footer nav details figure center fieldset".split())


CONTAINERS = HOLDERS | {"article", "main", "td"}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _soft(tag: str, attributes: str) -> tuple[bool, bool]:
    """(dropped for certain, dropped unless it holds the article's heading)."""
    soft, hard = tag == "header", tag in NEVER
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in WHOLE and not WORDS.isdisjoint(x.lower() for x in _SPLIT.split(value) if x):
            soft = True
        elif name == "class" and tag == "article" and not {"comment", "comments", "reply", "ad", "related"}.isdisjoint(value.lower().split()):
            hard = True
        elif name == "role" and value.lower() in ROLES:
            soft = True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hard = True
    return hard, soft


class Page:
    """Elements in page order, with the hash of each subtree, and the texts between block edges."""

    def __init__(self, html: str):
        self.tag, self.parent, self.hard, self.soft, self.heading, self.hash, self.main = ["#"], [0], [False], [False], [False], [0], [False]
        self.place, self.shape, label = [0], [0], [""]
        self.texts: list[tuple[int, str | None]] = []
        stack, parts, forms = [0], [["#"]], [[""]]
        opened: dict[str, int] = {}

        def text(raw: str) -> None:
            if raw:
                self.texts.append((stack[-1], raw))
                if raw.strip():
                    parts[-1].append(" ".join(raw.split()))
                    if forms[-1][-1] != "#":
                        forms[-1].append("#")

        def close() -> None:
            k, own = stack.pop(), parts.pop()
            opened[self.tag[k]] -= 1
            self.hash[k] = xxhash.xxh64_intdigest("\x1f".join(own).encode("utf-8", "surrogatepass")) - (1 << 63)
            parts[-1].append(f"\x1e{self.hash[k]}")
            form = forms.pop()
            self.shape[k] = xxhash.xxh64_intdigest(f"{self.place[k]}\x1f{'|'.join(form)}")
            sign = ("@" if self.tag[k] == "a" else "#" if len(form) > 1 else "") if self.tag[k] in INLINE else f"{label[k]}({'|'.join(form)})"
            if sign and forms[-1][-1] != sign:
                forms[-1].append(sign)
            if self.tag[k] in BLOCK:
                self.texts.append((k, None))

        def close_to(tags: set[str], fence: set[str]) -> None:
            if not any(opened.get(x) for x in tags):
                return
            for at in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[at]]
                if tag in tags:
                    while len(stack) > at:
                        close()
                    return
                if tag in fence:
                    return

        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if not m:
                break
            text(html[at : m.start()])
            at = m.end()
            if m[1]:
                close_to({m[1].lower()}, set())
            elif m[2]:
                tag, attributes = m[2].lower(), m[3]
                if tag in CLOSES_P:
                    close_to({"p"}, FENCE["p"])
                if tag in IMPLIED:
                    close_to(IMPLIED[tag], FENCE[tag])
                k = len(self.tag)
                hard, soft = _soft(tag, attributes) if attributes else (tag in NEVER, tag == "header")
                self.tag.append(tag)
                self.parent.append(stack[-1])
                self.hard.append(hard)
                self.soft.append(soft)
                self.heading.append(False)
                self.hash.append(0)
                self.main.append(tag == "main" or "main" in attributes and bool(re.search(r"""role\s*=\s*["']?main\b""", attributes)))
                self.heading[k] = tag == "h1"
                own = _CLASS.search(attributes) if attributes else None
                label.append(f"{tag}.{_DIGITS.sub('0', own[1] or own[2] or own[3] or '').lower()}" if own else tag)
                self.place.append(xxhash.xxh64_intdigest(f"{self.place[stack[-1]]}/{label[k]}"))
                self.shape.append(0)
                if tag in BLOCK:
                    self.texts.append((k, None))
                if tag == "br":
                    self.texts.append((stack[-1], " "))
                if tag in VOID:
                    parts[-1].append(tag)
                    continue
                stack.append(k)
                parts.append([tag])
                forms.append([""])
                opened[tag] = opened.get(tag, 0) + 1
                if tag in RAW:
                    close_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
                    parts[-1].append(html[at : close_tag.start() if close_tag else end])
                    at = close_tag.start() if close_tag else end
        text(html[at:])
        while len(stack) > 1:
            close()

        n = len(self.tag)
        self.size, self.times = [0] * n, Counter(self.place)
        for k, part in self.texts:
            if part:
                self.size[k] += len(part.strip())
        for k in range(n - 1, 0, -1):
            self.heading[self.parent[k]] |= self.heading[k]
            self.size[self.parent[k]] += self.size[k]
        self.gone, self.inside = [False] * n, [False] * n
        holder, self.named = [False] * n, [False] * n
        for k in range(1, n):
            up = self.parent[k]
            holder[k] = holder[up] or self.tag[up] == "article" or self.main[up]
            self.named[k] = self.hard[k] or self.soft[k] and not (self.heading[k] and holder[k])
            self.gone[k] = self.gone[up] or self.named[k]
        kept = [k for k in range(1, n) if not self.gone[k]]
        roots = {k for k in kept if self.tag[k] == "article"} or {k for k in kept if self.main[k]}
        self.rooted = bool(roots)
        for k in range(1, n):
            self.inside[k] = self.inside[self.parent[k]] or k in roots

    def candidates(self) -> set[int]:
        """Hashes of the subtrees that may be templates."""
        return {self.hash[k] for k in range(1, len(self.tag)) if self._candidate(k)}

    def live(self) -> set[int]:
        """Those of the candidates that hold some of the text; without the others it is the same."""
        holds, held = [False] * len(self.tag), self._held()
        within = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            within[k] = held > 0 and (k == held or within[self.parent[k]])
        for k, part in self.texts:
            if part and not self.gone[k] and (self.inside[k] or within[k] or not self.rooted) and not part.isspace():
                holds[k] = True
        for k in range(len(holds) - 1, 0, -1):
            holds[self.parent[k]] |= holds[k]
        return {self.hash[k] for k in range(1, len(holds)) if holds[k] and self._candidate(k)}

    def _candidate(self, k: int) -> bool:
        tag = self.tag[k]
        return tag not in WHOLE and tag not in RAW and tag != "head" and (tag in HOLDERS if self.inside[k] else tag in BLOCK)

    def _held(self) -> int:
        """This page's own guess of its core: the innermost container of half the text, with the heading if there is one; 0 without any."""
        half, best = CORE * max(self.size[0], 1), 0
        for k in range(1, len(self.tag)):
            if self.tag[k] in CONTAINERS and self.times[self.place[k]] == 1 and self.size[k] >= half and (self.heading[k] or not self.heading[0]):
                best = k
        return best

    def shapes(self) -> set[int]:
        """Shapes that may be templates: blocks outside what this page takes for its core."""
        held = self._held()
        around, k = set(), held
        while k:
            around.add(k)
            k = self.parent[k]
        within = [False] * len(self.tag)
        out = set()
        for k in range(1, len(self.tag)):
            within[k] = k == held or within[self.parent[k]]
            if not within[k] and k not in around and self.tag[k] in BLOCK and self.tag[k] not in WHOLE and self.size[k]:
                out.add(_signed(self.shape[k]))
        return out

    def places(self) -> list[tuple[int, float, bool, int]]:
        """(place, share of the text, holds the heading or there is none, exact hash) of containers that stand once."""
        whole = max(self.size[0], 1)
        return [(_signed(self.place[k]), self.size[k] / whole, self.heading[k] or not self.heading[0], self.hash[k]) for k in range(1, len(self.tag)) if self.tag[k] in CONTAINERS and self.times[self.place[k]] == 1 and self.size[k]]

    def body(self) -> int:
        return next((self.hash[k] for k in range(1, len(self.tag)) if self.tag[k] == "body"), self.hash[-1])

    def _parted(self, templates: set[int], shapes: set[int], cores: set[int]) -> list[bool] | None:
        """Which elements' text goes, by the host's core; None if the page has no part of one."""
        n = len(self.tag)
        core = [self.tag[k] in CONTAINERS and self.times[self.place[k]] == 1 and _signed(self.place[k]) in cores for k in range(n)]
        around = [False] * n
        for k in range(n - 1, 0, -1):
            around[self.parent[k]] |= core[k] or around[k]
        innermost = [k for k in range(n) if core[k] and not around[k]]
        if not innermost:
            return None
        within, gone, wrapped = [False] * n, [False] * n, False
        for k in innermost:
            within[k] = True
        for k in range(1, n):
            within[k] |= within[self.parent[k]]
            wrapped |= (core[k] or around[k]) and (self.tag[k] == "article" or self.main[k])
        for k in range(1, n):
            if gone[self.parent[k]]:
                gone[k] = True
            elif core[k] or around[k]:
                pass
            elif within[k]:
                gone[k] = self.named[k] or self.tag[k] in HOLDERS and self.hash[k] in templates
            elif self.tag[k] in BLOCK and _signed(self.shape[k]) in shapes:
                gone[k] = True
            else:
                gone[k] = self.named[k]
        # Of what is left outside, blocks too rare to count go if the core calls itself the article.
        return [g or wrapped and not w for g, w in zip(gone, within, strict=True)]

    def text(self, templates: set[int], shapes: set[int] = frozenset(), cores: set[int] = frozenset()) -> str:
        if (gone := self._parted(templates, shapes, cores)) is not None:
            return self._blocks(gone)
        n = len(self.tag)
        gone, link = self.gone[:], [False] * n
        for k in range(1, n):
            up = self.parent[k]
            gone[k] = gone[k] or gone[up] or (self.hash[k] in templates and self._candidate(k))
            link[k] = link[up] or self.tag[k] == "a"
        if not self.rooted:
            self._link_lists(gone, link)
        return self._blocks([g or self.rooted and not i for g, i in zip(gone, self.inside, strict=True)])

    def _blocks(self, gone: list[bool]) -> str:
        blocks, now = [], []
        for k, part in self.texts:
            if part is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif not gone[k]:
                now.append(_html.unescape(part) if "&" in part else part)
        blocks.append("".join(now))
        return "\n".join(x for x in (_WHITE.sub(" ", b).strip() for b in blocks) if x)

    def _link_lists(self, gone: list[bool], link: list[bool]) -> None:
        """Without an article, lists whose words are mostly links are menus."""
        whole, linked = [0] * len(gone), [0] * len(gone)
        for k, part in self.texts:
            if part:
                whole[k] += len(part.strip())
                linked[k] += len(part.strip()) if link[k] else 0
        for k in range(len(gone) - 1, 0, -1):
            whole[self.parent[k]] += whole[k]
            linked[self.parent[k]] += linked[k]
        for k in range(1, len(gone)):
            gone[k] = gone[k] or gone[self.parent[k]] or self.tag[k] in ("ul", "ol", "dl", "table", "div") and whole[k] > 0 and linked[k] > 0.6 * whole[k]


_SEEN = pa.schema([("host", pa.string()), ("page", pa.int64()), ("body", pa.int64()), ("kind", pa.int8()), ("hash", pa.int64()), ("share", pa.float32()), ("heading", pa.bool_()), ("own", pa.int64()), ("live", pa.bool_())])
#: Kinds of counted hashes.
EXACT, SHAPE, PLACE = 0, 1, 2


def _hashes(batches):
    for batch in batches:
        rows = []
        for host, key, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if html:
                page = Page(html)
                own, body = page.live(), page.body()
                rows += [(host, key, body, EXACT, h, 0.0, False, 0, h in own) for h in page.candidates()]
                rows += [(host, key, body, SHAPE, h, 0.0, False, 0, True) for h in page.shapes()]
                rows += [(host, key, body, PLACE, h, share, heading, exact, True) for h, share, heading, exact in page.places()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_SEEN)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SEEN.types, strict=True)], schema=_SEEN)


def _texts(batches):
    for batch in batches:
        texts = []
        for html, templates, shapes, cores in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
            texts.append(Page(html).text(set(templates or ()), set(shapes or ()), set(cores or ())) if html else "")
        texts = [x.encode("utf-8", "replace").decode() for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def site_templates(seen: DataFrame) -> DataFrame:
    """(host, kind, hash): what recurs across a host's different pages and holds text on some, of places only cores; ``seen`` has the columns of ``_SEEN``."""
    bodies = seen.groupBy("host", "kind", "hash", "body").agg(F.max("share").alias("share"), F.max("heading").cast("int").alias("heading"), F.max("own").alias("own"), F.max("live").alias("live"))
    counted = bodies.groupBy("host", "kind", "hash").agg(F.count("*").alias("n"), F.avg("share").alias("share"), F.avg("heading").alias("heading"), F.approx_count_distinct("own").alias("own"), F.max("live").alias("live"))
    core = (F.col("kind") != PLACE) | (F.col("share") >= CORE) & (F.col("heading") >= CORE) & (F.col("own") >= CORE * F.col("n"))
    return counted.filter((F.col("n") >= MIN_PAGES) & core & F.col("live")).select("host", "kind", "hash")


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(host, shapes, cores) per host, and (host, page, templates) per page with exact templates that hold some of its text."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(_host(url_col).alias("host"), _page(id_col, html_col).alias("page"), F.col(html_col).alias("html"))
    seen = staged(rows.mapInArrow(_hashes, "host string, page long, body long, kind byte, hash long, share float, heading boolean, own long, live boolean"), "templates-seen")
    found = staged(site_templates(seen), "templates-found")
    own = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("hash")))
    sites = found.filter(F.col("kind") != EXACT).groupBy("host").agg(own(SHAPE).alias("shapes"), own(PLACE).alias("cores"))
    exact = found.filter(F.col("kind") == EXACT).select("host", "hash")
    lists = seen.filter((F.col("kind") == EXACT) & F.col("live")).select("host", "page", "hash").join(exact, ["host", "hash"])
    return sites, lists.groupBy("host", "page").agg(F.sort_array(F.collect_set("hash")).alias("templates"))


def _page(id_col: str, html_col: str):
    """The key of a page's html; two pages of one key only share their lists.  Pages without html are spread by id."""
    return F.when(F.length(html_col) > 0, F.xxhash64(html_col)).otherwise(F.xxhash64(id_col))


def _host(url_col: str):
    return F.coalesce(F.lower(F.try_parse_url(F.col(url_col), F.lit("HOST"))), F.lit(""))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    sites, lists = (staged(x, "templates") for x in templates(pages, id_col, url_col, html_col))
    weight = sites.agg(F.coalesce(F.sum(F.octet_length("host") + 64 + 8 * (F.size("shapes") + F.size("cores"))), F.lit(0)).alias("n")).first()["n"]
    sites = F.broadcast(sites) if weight <= BROADCAST_BYTES else sites
    lists = F.broadcast(lists) if lists.count() <= BROADCAST_PAGES else lists.hint("shuffle_hash")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col).alias("host"), _page(id_col, html_col).alias("page"))
    joined = rows.join(sites, "host", "left").join(lists, ["host", "page"], "left").select("page_id", "url", "html", "templates", "shapes", "cores")
    return joined.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
