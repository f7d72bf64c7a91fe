"""Operator 7: HTML extraction by consensus host paths.

Every page's containers are scored by the text of the blocks right in them. The lowest container that holds all the good
scorers, widened to the article or main element around it, to headings beside it and to siblings like it, votes with its
generalised path (tags with digit-free classes, from the root) for its host. Votes are summed in Spark; ties go to the first path by
name. A second pass takes the text of all elements on the host's winning path; pages without one keep their own container.

Inside the chosen containers menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts
and styles are left out, by tag, role, the hidden attribute and the head word of a class or id. Blocks are joined in page order by
one space; white space inside a block becomes one space. Null html is empty; a page without text gives an empty text. Urls
without a host vote together; null ids, repeated rows and pages of any length are rows like others, no rows give no rows,
and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches

DEEPEST = 512  # deeper elements become siblings, as in browsers
SMALL = 64 << 20  # bytes of winners that are broadcast; above, the join shuffles
SALTS = 64  # parts of a host in that join
SHARE = 0.1  # of the best score: containers with less don't count

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_OPEN = re.compile(r"<!--.*|<!\[CDATA\[.*", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption "
    "header footer nav aside form fieldset address details summary hr center menu dialog search".split()
)
CONTAINER = frozenset("body main article section div td center".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg math button select option textarea title menu dialog object canvas audio video map search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id that mark page furniture.
NOISE = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus respond reply replies discussion social share "
    "sharing related recommended breadcrumb breadcrumbs pagination pager toolbar widget widgets login search skip copyright tags".split()
)
#: A header of these is part of the text, and with these words a name tells of a layout, not of furniture.
OWN_HEADER, LAYOUT = frozenset("article post entry story".split()), frozenset("has with no without".split())
#: Words that say nothing about what an element is; the word before them does. So do words of one or two letters.
NEUTRAL = frozenset(
    "box block section area wrapper wrap container inner outer list lists item items posts links link bar unit slot top bottom left right panel content contents body text row col column group "
    "module component region main primary secondary default large small desktop mobile sticky fixed icons icon buttons button title heading media articles stories form forms cta holder placeholder thread".split()
)
_HIDING = re.compile(r"display\s*:\s*none")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES_P = BLOCK - {"html", "body"}
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def furniture_name(name: str) -> bool:
    """Whether a class or id names page furniture: its head, the last word that isn't neutral, does. "comments-list" is
    furniture, "search-results-analysis" an analysis."""
    words = _WORD.findall(name)
    if LAYOUT & set(words):
        return False
    rest = [w for w in words if len(w) > 2 or w in NOISE]
    while len(rest) > 1 and rest[-1] in NEUTRAL and rest[-1] not in NOISE:
        rest.pop()
    return bool(rest) and rest[-1] in NOISE and not (rest[-1] == "header" and set(words) & OWN_HEADER)


def noisy(tag: str, attrs: dict[str, str], in_article: bool, by_name: bool = True) -> bool:
    """Whether an element is page furniture: by tag, role and hiding, and by class and id."""
    if tag in DROPPED or attrs.get("role", "").lower() in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDING.search(attrs.get("style", "")):
        return True
    if tag == "header":
        return not in_article
    if not by_name or tag in ("html", "body", "main", "article", "p", *HEADINGS):
        return False
    return any(furniture_name(name) for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split())


class Page:
    """Text blocks of a page in order, each with the element it is in; elements with their paths.

    Where names of classes would leave no text at all, they are not believed: only tags and roles count then.
    """

    def __init__(self, html: str, by_name: bool = True):
        self.by_name = by_name
        #: (tag, parent, path, furniture)
        self.elements: list[tuple[str, int, str, bool]] = [("", -1, "", False)]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._parse(html)
        if by_name and self.blocks and all(self.elements[e][3] for e, _, _ in self.blocks):
            self.__init__(html, False)

    def _parse(self, html: str) -> None:
        stack, parts, linked, at = [0], [], 0, 0
        names = [""]

        def flush():
            nonlocal linked
            if parts:
                text = _SPACE.sub(" ", entities.unescape("".join(parts)) if any("&" in p for p in parts) else "".join(parts)).strip()
                if text:
                    self.blocks.append((stack[-1] if not inline else block, text, linked))
                parts.clear()
            linked = 0

        def pop_to(k: int):
            nonlocal block
            del stack[k:], names[k:]
            inline[:] = [x for x in inline if x in stack]
            block = next((e for e in reversed(stack) if self.elements[e][0] in BLOCK or e == 0), 0)

        inline: list[int] = []
        block, pos, n = 0, 0, len(html)
        last = html.rfind(">")  # what follows it holds no tag, at most an open comment
        while pos < n:
            m = _TAG.search(html, pos) if pos <= last else _OPEN.search(html, pos)
            end = m.start() if m else n
            if end > pos:
                text = html[pos:end]
                parts.append(text)
                if "a" in names:
                    linked += len(text)
            if not m:
                break
            pos = m.end()
            tag = (m[2] or m[5]) if m.re is _TAG else None
            if not tag:
                if m[0].startswith("<![CDATA["):
                    parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag, closing, rest = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if closing:
                if tag in names:
                    k = len(names) - 1 - names[::-1].index(tag)
                    # An inline end tag doesn't close blocks that were opened inside it.
                    if tag not in BLOCK and any(t in BLOCK for t in names[k + 1 :]):
                        continue
                    if any(t in BLOCK for t in names[k:]):
                        flush()
                    pop_to(k)
                elif tag == "p":
                    flush()
                continue
            if tag in VOID:
                parts.append(" ")
                if tag == "hr":
                    flush()
                continue
            attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(rest)} if rest else {}
            if tag in BLOCK:
                flush()
                if tag in CLOSES_P and "p" in names:
                    k = len(names) - 1 - names[::-1].index("p")
                    if not any(t in CONTAINER or t in ("li", "td", "table") for t in names[k + 1 :]):
                        pop_to(k)
                if tag in HEADINGS and names[-1] in HEADINGS:
                    pop_to(len(names) - 1)
            if tag in SELF_CLOSING:
                for k in range(len(names) - 1, 0, -1):
                    if names[k] in SELF_CLOSING[tag]:
                        break
                    if names[k] == tag or (tag in ("dt", "dd") and names[k] in ("dt", "dd")) or (tag in ("td", "th") and names[k] in ("td", "th")):
                        pop_to(k)
                        break
            parent = stack[-1]
            ptag, _, ppath, furniture = self.elements[parent]
            if not furniture:
                furniture = noisy(tag, attrs, "article" in names or "main" in names, self.by_name)
            label = tag
            if attrs.get("class"):
                label += "." + ".".join(sorted({re.sub(r"\d+", "", c.lower()) for c in attrs["class"].split()} - {""}))
            path = f"{ppath}/{label}" if tag in BLOCK else ppath
            me = len(self.elements)
            self.elements.append((tag, parent, path, furniture))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, pos)
                pos = close.end() if close else n
                continue
            if rest.rstrip().endswith("/") and tag not in BLOCK:
                continue
            if len(stack) >= DEEPEST:
                continue
            stack.append(me)
            names.append(tag)
            if tag in BLOCK:
                block = me
            else:
                inline.append(me)
        flush()

    def best(self) -> int:
        """The container of the main text, 0 if there is no text."""
        score: dict[int, float] = {}
        for e, text, linked in self.blocks:
            if not self.elements[e][3]:
                at = self._container(e)
                score[at] = score.get(at, 0.0) + max(0.0, len(text) - 2.0 * linked) + min(len(text), 25) * 0.1
        if not score:
            return 0
        most = max(score.values())
        chains = [self._above(e) for e, x in score.items() if x >= SHARE * most]
        at = next(e for e in chains[0] if self._is_container(e) and all(e in c for c in map(set, chains[1:])))
        return self._widened(at)

    def _is_container(self, e: int) -> bool:
        return e == 0 or self.elements[e][0] in CONTAINER

    def _above(self, e: int) -> list[int]:
        out = []
        while e >= 0:
            out.append(e)
            e = self.elements[e][1]
        return out

    def _container(self, e: int) -> int:
        while not self._is_container(e):
            e = self.elements[e][1]
        return e

    def _widened(self, at: int) -> int:
        """The outermost article around ``at``, else the main element, else up past headings and siblings with the same tag and classes."""
        chain = self._above(at)
        for wanted in ("article", "main"):
            if found := [e for e in chain if self.elements[e][0] == wanted]:
                return found[-1]
        label = lambda e: self.elements[e][2].rsplit("/", 1)[-1]
        for up in chain[1:]:
            if up == 0 or self.elements[up][0] in ("body", "html"):
                break
            child = chain[chain.index(up) - 1]
            for e, _, _ in self.blocks:
                if self.elements[e][3]:
                    continue
                above = self._above(e)
                if up not in above or child in above or self.elements[e][0] in HEADINGS:
                    continue
                beside = above[above.index(up) - 1] if e != up else up
                if beside == up or label(beside) != label(child) or self.elements[beside][0] != self.elements[child][0]:
                    return at
            at = up if self._is_container(up) else at
        return at

    def text_of(self, roots: set[int]) -> str:
        """The clean blocks below ``roots``, in page order."""
        inside = [False] * len(self.elements)
        for e, (_, parent, _, _) in enumerate(self.elements):
            inside[e] = e in roots or (parent >= 0 and inside[parent])
        return " ".join(text for e, text, _ in self.blocks if inside[e] and not self.elements[e][3])

    def extract(self, winner: str | None) -> str:
        roots = {e for e, x in enumerate(self.elements) if winner and x[2] == winner and x[0] in CONTAINER and not x[3]}
        return (self.text_of(roots) if roots else "") or self.text_of({self.best()})


def _vote(batches):
    """(host, path, votes): one vote a page for the path of its best container, added up per batch."""
    for batch in batches:
        votes: dict[tuple[str, str], int] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = Page(html.as_py() or "")
            best = page.best()
            if best:
                key = host, page.elements[best][2]
                votes[key] = votes.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())],
            schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())]),
        )


def _extract(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in batches:
        texts = [Page(html.as_py() or "").extract(winner) for html, winner in zip(batch.column(2), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def host_winners(rows: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host; ties go to the first by name. Votes are added up before and after the shuffle."""
    votes = rows.select("host", "html").mapInArrow(_vote, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    winners = Scratch(pages.sparkSession).keep(host_winners(rows), "winners")
    if (winners.agg(F.sum(F.octet_length("host") + F.octet_length("path"))).first()[0] or 0) <= SMALL:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:  # hosts are split, so a hot one isn't one task
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        rows = rows.join(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
