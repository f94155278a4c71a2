"""Main text of web pages by consensus of each host's container paths.

A page is read as its block elements (inline markup is transparent) and the
text that stands in each.  Every container gets the text below it that reads as
prose: text in links counts against it, text in menus, headers, footers,
sidebars, notices, adverts, forms and comments counts for nothing, text in an
article or main element counts more.  The page's candidate is the deepest
container with nearly all of that.  Its path of tags and classes, digits
generalised, is the page's vote; votes are summed per host, and the pages are
read again: the text of every container on the host's winning path, and where a
page has none with text, of its own candidate.

Votes are summed in each task before they are shuffled, so a host with a third
of all pages is a few rows a task.  Winners are broadcast where there are at
most ``most_hosts`` (of bounded length: a long path goes by its SHA-256).
Beyond that, those of the hosts with more than 1 / ``most_hosts`` of all pages
are, which are fewer; pages of the others meet theirs in a shuffled join.

Results: null or empty html has the empty text; a null or odd url is of the
host "", as any other; repeated pages give a row each; a page without prose has
no vote and, on its host's path, whatever text stands there; ties of a vote go
to the larger score, then the lesser path; the empty table gives no rows.  Only
page_id, url and html are read.  White space is what Unicode calls so; a line
break element is white space within its block.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrastate.llm.common import materialize

#: Attributes: quoted values may hold ">"; a quote that never closes is taken as it stands.
TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<more>(?>[^>="']++|=\s*+(?>"[^"]*+"|'[^']*+'|)|["'])*+)(?:>|\Z)|<(?:[!?]|/(?=[^A-Za-z]))[^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
WORDS_OF_CLASS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# Fixed values of the page language: elements that part blocks, that hold no page text, that close an open paragraph.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th
thead title tr ul""".split())
SILENT = frozenset("script style noscript template iframe noembed noframes textarea xmp object svg canvas audio video select button title".split())
VOID = frozenset("hr".split())
NOT_IN_A_PARAGRAPH = BLOCKS - frozenset("body caption dd dt head html legend option optgroup tbody td tfoot th thead tr title".split())
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: An open sibling is not closed from within a list or table of its own.
FENCES = frozenset("ul ol menu dl table body html div article section main td th".split())
ASIDE_TAGS = frozenset("nav header footer aside form dialog menu search".split())
SURELY_ASIDE = ASIDE_TAGS - {"form"}
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
ASIDE_CLASSES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu
menus breadcrumb breadcrumbs header masthead footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices alert popup
modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond
pagination pager toolbar form search commentlist""".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li td th dd dt figcaption summary".split())
CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in SILENT}
NEARLY_ALL, LONGEST_HOST, LONGEST_PATH = 0.9, 255, 500


class Page:
    """Block elements of a page in order, and the text runs in them."""

    def __init__(self, html: str):
        self.parent, self.tag, self.names, self.aside, self.main, self.depth = [-1], [""], [()], [False], [False], [0]
        self.runs: list[tuple[int, str, int]] = []  # element, text, characters of it in links
        self._read(html)

    def _open(self, tag: str, names: tuple, aside: bool, main: bool, parent: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.aside.append(aside)
        self.main.append(main)
        self.depth.append(self.depth[parent] + 1)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        at, stack, held, linked, link = 0, [0], [], 0, False

        def flush():
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.runs.append((stack[-1], text, linked))
                held.clear()
            linked = 0

        def close(k: int):  # the k-th open element and all in it
            nonlocal link
            flush()
            del stack[k:]
            link = False

        while True:
            m = TAG.search(html, at)
            piece = html[at:m.start() if m else len(html)]
            if piece:
                piece = unescape(piece)
                held.append(piece)
                if link:
                    linked += len(piece.strip())
            if m is None:
                break
            at = m.end()
            if m["name"] is None:
                continue
            name, end = m["name"].lower(), m["end"]
            if name in SILENT:
                if not end and not m["more"].endswith("/"):
                    over = CLOSERS[name].search(html, at)
                    at = over.end() if over else len(html) if name in ("script", "style") else at
                continue
            if name == "a":
                link = not end
                continue
            if name not in BLOCKS:
                if name == "br":
                    held.append(" ")
                continue
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == name:
                        close(k)
                        break
                continue
            if name in NOT_IN_A_PARAGRAPH and len(stack) > 1:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        close(k)
                        break
                    if self.tag[stack[k]] in FENCES:
                        break
            if name in SIBLINGS:
                lowest = None
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t in SIBLINGS[name]:
                        lowest = k
                        if t == name:
                            break
                    elif t in FENCES:
                        break
                if lowest is not None:
                    close(lowest)
            flush()
            if name in ("html", "body") and any(self.tag[i] == name for i in stack):
                continue  # a second one only adds to the first
            if name in VOID:
                continue
            if name not in ("html", "head") and any(self.tag[i] == "head" for i in stack):
                del stack[next(k for k, i in enumerate(stack) if self.tag[i] == "head"):]
            names, role, known = (), "", ()
            if m["more"]:
                for a in ATTRIBUTE.finditer(m["more"]):
                    key = a[1].lower()
                    if key == "class":
                        names = tuple(unescape(a[2] or a[3] or a[4] or "").split())
                    elif key == "id":
                        known = (unescape(a[2] or a[3] or a[4] or ""),)
                    elif key == "role":
                        role = (a[2] or a[3] or a[4] or "").strip().lower()
            stack.append(self._open(name, names, name in ASIDE_TAGS or role in ASIDE_ROLES or by_class(names + known) and name not in ("html", "body"),
                                    name in MAIN_TAGS or role == "main", stack[-1]))
            if len(stack) > 1_000:  # nested beyond any sense: what follows stays in this element
                flush()
                stack.pop()
        flush()

    def settle(self) -> None:
        """Spread asides to what they hold; a form, or one known by its class only, is none where it holds the page's heading or main part."""
        count = len(self.tag)
        holds = [t in ("h1", "main") or t == "article" and not a for t, a in zip(self.tag, self.aside)]
        for i in range(count - 1, 0, -1):
            if holds[i] and not (self.aside[i] and self.tag[i] in SURELY_ASIDE):
                holds[self.parent[i]] = True
        for i in range(1, count):
            if self.aside[i] and self.tag[i] not in SURELY_ASIDE and holds[i]:
                self.aside[i] = False
            self.aside[i] = self.aside[i] or self.aside[self.parent[i]]
            self.main[i] = self.main[i] or self.main[self.parent[i]]

    def paths(self) -> list[str]:
        """Generalised path of every element: tags and classes from the top, digits as #."""
        out = [""]
        for i in range(1, len(self.tag)):
            own = self.tag[i] + "".join("." + n for n in sorted({re.sub(r"[0-9]+", "#", n) for n in self.names[i]}))
            path = out[self.parent[i]] + ">" + own
            out.append(path if len(path) <= LONGEST_PATH else hashlib.sha256(path.encode()).hexdigest())
        return out

    def candidate(self) -> tuple[int, int]:
        """The deepest container with nearly all prose of the page, and its score; (0, 0) where there is none."""
        score = [0] * len(self.tag)
        for i, text, linked in self.runs:
            if not self.aside[i]:
                score[i] += max(0, len(text) - 2 * linked) * (5 if self.main[i] else 1)
        for i in range(len(self.tag) - 1, 0, -1):
            score[self.parent[i]] += score[i]
        if not score[0]:
            return 0, 0
        for tag in ("article", "main"):  # the outermost that holds most of it, what it holds besides included
            for i in range(1, len(self.tag)):
                if self.tag[i] == tag and not self.aside[i] and 2 * score[i] >= score[0]:
                    return i, score[i]
        # a paragraph, a heading or the like is no container
        best = max((i for i in range(len(self.tag)) if score[i] >= NEARLY_ALL * score[0] and self.tag[i] not in HEADINGS), key=lambda i: (self.depth[i], -i))
        return best, score[best]

    def text_of(self, wanted: set[int]) -> str:
        """Text in and below the elements of ``wanted``, asides left out, a block a line."""
        inside = [i in wanted for i in range(len(self.tag))]
        for i in range(1, len(self.tag)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return "\n".join(text for i, text, _ in self.runs if inside[i] and not self.aside[i])


def by_class(names: tuple) -> bool:
    """Whether a class name, or its first or last word, is one of those that pages give to what is not their article."""
    for n in names:
        words = [w.lower() for w in WORDS_OF_CLASS.findall(n)]
        if words and words[0] not in ("has", "with", "no", "without") and (words[-1] in ASIDE_CLASSES or words[0] in ASIDE_CLASSES):
            return True
    return False


def read_page(html: str) -> Page:
    page = Page(html)
    page.settle()
    return page


VOTES = "host string, path string, votes long, score double, pages long"


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's votes by host and path (none where a page has no prose); written out whenever there are many of them."""
    def out(sums):
        columns = [[k[0] for k in sums], [k[1] for k in sums], *[[v[i] for v in sums.values()] for i in range(3)]]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in VOTES.split(", ")])

    sums: dict[tuple, list] = defaultdict(lambda: [0, 0.0, 0])
    for b in batches:
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            page = read_page(html)
            best, score = page.candidate()
            got = sums[(host, page.paths()[best] if score else "")]
            got[0] += score > 0
            got[1] += score
            got[2] += 1
        if len(sums) > 50_000:
            yield out(sums)
            sums.clear()
    if sums:
        yield out(sums)


TEXTS = "page_id long, url string, text string"


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist()):
            page = read_page(html)
            found = {i for i, p in enumerate(page.paths()) if i and p == path}
            if not found:
                best, score = page.candidate()
                found = {best} if score else set()
            texts.append(page.text_of(found))
        yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_paths(rows: DataFrame) -> DataFrame:
    """host, path, pages: the winning container path of each host ("" where no page voted) and how many pages it has."""
    sums = rows.select("host", "html").mapInArrow(vote, VOTES).groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("votes", "score", "pages")])
    # most votes, then the larger score, then the least path, as an aggregate: a host's paths are never sorted in one task
    best = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), F.col("path").alias("path")))
    return sums.groupBy("host").agg(best.alias("b"), F.sum("pages").alias("pages")).select("host", F.col("b.path").alias("path"), "pages")


def page_texts(spark: SparkSession, pages: DataFrame, most_hosts: int = 20_000) -> DataFrame:
    """page_id, url, text of every page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.when(F.length(host) <= LONGEST_HOST, host).otherwise("").alias("host"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    paths = materialize(spark, host_paths(rows), "host-paths")
    told = paths.agg(F.count("*").alias("hosts"), F.sum("pages").alias("pages")).first()
    if told.hosts <= most_hosts:
        return rows.join(F.broadcast(paths), "host", "left").mapInArrow(extract, TEXTS)
    # at most ``most_hosts`` hosts have so many pages; a row of theirs is of bounded size
    busy = F.col("pages") > told.pages / most_hosts
    many, few = paths.where(busy).select("host", "path", F.lit(True).alias("busy")), paths.where(~busy).select("host", "path")
    marked = rows.join(F.broadcast(many), "host", "left")
    first = marked.where("busy").select("page_id", "url", "html", "path")
    rest = marked.where("busy IS NULL").drop("path", "busy").join(few.hint("merge"), "host", "left").select("page_id", "url", "html", "path")
    return first.unionByName(rest).mapInArrow(extract, TEXTS)
