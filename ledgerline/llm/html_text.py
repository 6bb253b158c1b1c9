"""Operator 13: the main text of web pages, by paths that the pages of a host agree on.

Each page is read into elements and blocks of text. Every container is scored
by what it holds: text outside links for it, links against it, and nothing of
the parts that name themselves menus, adverts, forms or comments. The page
votes for its best container's generalised path, the tags and classes from the
body down with runs of digits made one. Spark adds up the votes of a host, and
the pages are read again: the first path of their host that a page has gives
its text, so that a page whose own best container is a sidebar is put right.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, gathered, small_batches, written

#: Share of a host's votes that a path needs, in per cent; characters from which a page's vote counts in full.
SHARE, FULL_VOTE = 5, 1000
#: A child that holds this share of its parent's score, in tenths, is the narrower choice. Blocks of fewer characters
#: outside of links, other than headings, score a quarter: menus and captions that don't name themselves are made of such.
NARROWER, SHORT = 9, 30

# Kinds of elements, and words by which parts of pages name themselves.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "xmp"}
CONTAINERS = {"body", "div", "article", "main", "section", "center", "td", "details", "fieldset", "form", "figure", "hgroup", "search", "dialog", "aside", "header", "footer", "nav"}
BLOCKS = CONTAINERS | HEADINGS | {
    "address", "blockquote", "caption", "dd", "dir", "dl", "dt", "figcaption", "hr", "legend", "li", "menu", "ol", "optgroup", "option", "p", "pre", "summary", "table", "tbody", "tfoot", "th", "thead", "tr", "ul",
}
NEVER = {
    "script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "button", "select", "textarea", "iframe", "svg", "canvas", "object", "embed", "menu", "dialog", "noembed", "label", "input", "legend", "search", "math", "audio", "video", "map",
}
BESIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "aside", "widget", "widgets", "related", "recommended", "teaser", "teasers", "trending", "popular",
    "comment", "comments", "commentlist", "disqus", "discussion", "replies", "reply", "respond",
    "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "signup", "login",
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "skip", "footer", "copyright", "masthead",
    "share", "sharing", "social", "form", "search",
}
LAYOUT = {"has", "with", "no", "without", "hide"}
STORY = {"article", "post", "entry", "story", "content"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}
#: An open element of the second kind ends where one of the first begins, unless one of the third lies between.
ENDS = {
    **dict.fromkeys(BLOCKS - {"option", "optgroup"}, ({"p"}, CONTAINERS | {"table", "caption", "button", "object"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir", "table"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd", "p"}, {"dl", "table"})),
    "option": ({"option"}, {"select", "datalist"}),
    **dict.fromkeys(("td", "th"), ({"td", "th", "p"}, {"tr", "table"})),
    "tr": ({"tr", "td", "th", "p"}, {"tbody", "thead", "tfoot", "table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "p"}, {"table"})),
}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in RAW}
KEEP, DROP, ONLY_HEADINGS = 0, 1, 2


def _named(words: str) -> bool:
    """Whether a class or id names a part beside the article."""
    before = ""
    for w in (p.lower() for p in _PARTS.findall(words)):
        if w in BESIDE and before not in LAYOUT:
            return True
        before = w
    return False


@lru_cache(4096)
def _judged(name: str, attributes: str) -> tuple[str, int, bool]:
    """Generalised label, whether the element is kept, and whether it is an article by name."""
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    classes = sorted({re.sub(r"\d+", "0", c) for c in found.get("class", "").split()})
    label = ".".join([name, *(c.replace(">", "") for c in classes)])
    names = [*found.get("class", "").split(), found.get("id", "")]
    words = {p.lower() for x in names for p in _PARTS.findall(x)}
    story = name in ("article", "main") or bool(words & STORY)
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    if name in NEVER or hidden or found.get("role", "").lower() in ROLES:
        return label, DROP, story
    if name == "header" or "header" in words and name not in ("article", "main"):
        return label, ONLY_HEADINGS, story and name != "header"
    layout = name == "main" or (name == "article" and not words & {"comment", "comments", "ad", "advert", "related", "teaser", "sponsored", "promo"})
    return label, DROP if not layout and any(map(_named, names)) else KEEP, story


class Page:
    """A page's elements, parents before children, and its blocks of text."""

    def __init__(self, source: str):
        self.tag, self.label, self.parent, self.state, self.story, self.in_link = ["body"], ["body"], [-1], [KEEP], [False], [False]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self._stack, self._pieces = [0], []
        self._read(source)
        self._forms()

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at, name = m.end(), m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
                continue
            self._open(name, m[3])
            if name in RAW:  # what stands in it is no markup
                end = _RAW_END[name].search(source, at)
                at = end.end() if end else n
                self._close(name)
        self._flush()

    def _text(self, raw: str) -> None:
        self._pieces.append((self._stack[-1], html.unescape(raw) if "&" in raw else raw))

    def _flush(self) -> None:
        if self._pieces:
            owner = next(e for e in reversed(self._stack) if self.tag[e] in BLOCKS)
            self.blocks.append((owner, self._pieces))
            self._pieces = []

    def _open(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            return
        if name == "br":
            self._pieces.append((self._stack[-1], " "))
            return
        if name in BLOCKS:
            self._flush()
        if name in ENDS:
            gone, barrier = ENDS[name]
            for k in range(len(self._stack) - 1, 0, -1):
                t = self.tag[self._stack[k]]
                if t in barrier:
                    break
                if t in gone:
                    del self._stack[k:]
        if name in VOID:
            return
        up = self._stack[-1]
        label, own, story = _judged(name, attributes if _TELLING.search(attributes) else "")
        state = self.state[up]
        if state == ONLY_HEADINGS and name in HEADINGS:
            state = KEEP
        if own == ONLY_HEADINGS and state == KEEP:
            state = ONLY_HEADINGS if self.story[up] or story else DROP
        elif own == DROP:
            state = DROP
        self.tag.append(name)
        self.label.append(label)
        self.parent.append(up)
        self.state.append(state)
        self.story.append(story or self.story[up])
        self.in_link.append(name == "a" or self.in_link[up])
        self._stack.append(len(self.tag) - 1)

    def _close(self, name: str) -> None:
        block = name in BLOCKS
        if name in ("html", "body"):
            return
        barrier = {"table"} if name in ("td", "th", "tr", "tbody", "thead", "tfoot") else {"ul", "ol"} if name == "li" else {"td", "th"} if block else BLOCKS
        for k in range(len(self._stack) - 1, 0, -1):
            t = self.tag[self._stack[k]]
            if t == name:
                if block:
                    self._flush()
                del self._stack[k:]
                return
            if t in barrier:
                break
        if name == "p":  # stands for an empty paragraph
            self._flush()

    def _forms(self) -> None:
        """Forms go, but for those around a page's paragraphs, of which only the controls go."""
        forms = {i for i, t in enumerate(self.tag) if t == "form"}
        if not forms:
            return
        paragraphs = defaultdict(int)
        within = [-1] * len(self.tag)
        for i in range(1, len(self.tag)):
            within[i] = i if i in forms else within[self.parent[i]]
            if self.tag[i] in ("p", "article", "main") and within[i] >= 0:
                paragraphs[within[i]] += 3 if self.tag[i] != "p" else 1
        for i in range(1, len(self.tag)):
            if i in forms and paragraphs[i] < 3 or self.state[self.parent[i]] == DROP:
                self.state[i] = DROP

    def scores(self) -> tuple[list[int], list[int], list[int]]:
        """Of each element with all in it: score, kept characters, and those of headings."""
        score, chars, heads = ([0] * len(self.tag) for _ in range(3))
        for owner, pieces in self.blocks:
            plain = linked = 0
            for e, text in pieces:
                if self.state[e] == KEEP:
                    n = len(text) - text.count(" ") - text.count("\n")
                    linked, plain = (linked + n, plain) if self.in_link[e] else (linked, plain + n)
            score[owner] += (plain - linked) * (1 if plain < SHORT and self.tag[owner] not in HEADINGS else 4)
            chars[owner] += plain + linked
            heads[owner] += plain + linked if self.tag[owner] in HEADINGS else 0
        for i in range(len(self.tag) - 1, 0, -1):
            for x in (score, chars, heads):
                x[self.parent[i]] += x[i]
        return score, chars, heads

    def best(self) -> tuple[int, int] | None:
        """The best container and its kept characters."""
        score, chars, heads = self.scores()
        fit = [i for i, t in enumerate(self.tag) if t in CONTAINERS and self.state[i] != DROP]
        at = max(fit, key=lambda i: (score[i], -i))
        if score[at] <= 0:  # links alone are an article only where the page says so
            at = next((i for i in fit if self.tag[i] in ("article", "main") and chars[i]), 0)
            return (at, chars[at]) if at else None
        inner = defaultdict(list)
        for i in fit[1:]:
            up = self.parent[i]
            while self.tag[up] not in CONTAINERS:
                up = self.parent[up]
            inner[up].append(i)
        while (down := max(inner[at], key=lambda i: (score[i], -i), default=None)) is not None and 10 * score[down] >= NARROWER * score[at]:
            at = down
        line = [at]
        while self.parent[line[-1]] >= 0:
            line.append(self.parent[line[-1]])
        for name in ("article", "main"):
            wide = next((i for i in line if self.tag[i] == name and score[i] >= score[at]), None)
            if wide is not None:
                return wide, chars[wide]
        for up in line[1:-1]:  # a title above the text belongs to it
            if chars[up] - chars[at] != heads[up] - heads[at]:
                break
            if self.tag[up] in CONTAINERS:
                at = up
        return at, chars[at]

    def path(self, at: int) -> str:
        labels = []
        while at >= 0:
            labels.append(self.label[at])
            at = self.parent[at]
        return ">".join(reversed(labels))

    def at_path(self, path: str) -> set[int]:
        """Elements whose generalised path is ``path``."""
        labels = path.split(">")
        depth = [0 if labels[0] == "body" else -1] + [-1] * (len(self.tag) - 1)  # labels matched by this element and all above it
        for i in range(1, len(self.tag)):
            d = depth[self.parent[i]]
            if 0 <= d < len(labels) - 1 and self.label[i] == labels[d + 1]:
                depth[i] = d + 1
        return {i for i, d in enumerate(depth) if d == len(labels) - 1}

    def text(self, roots: set[int]) -> str:
        """Blocks inside of ``roots``, without what is dropped."""
        inside = [i in roots for i in range(len(self.tag))]
        for i in range(1, len(self.tag)):
            inside[i] = inside[i] or inside[self.parent[i]]
        found = (" ".join("".join(t for e, t in pieces if self.state[e] == KEEP).split()) for owner, pieces in self.blocks if inside[owner])
        return "\n".join(t for t in found if t)


def best_path(source: str | None) -> tuple[str, int] | None:
    """The path that a page votes for and the weight of its vote."""
    page = Page(source or "")
    best = page.best()
    return best and (page.path(best[0]), min(best[1], FULL_VOTE))


def main_text(source: str | None, paths: list[str] | None) -> str:
    """Text at the first of ``paths`` that has any, else in the page's best container."""
    page = Page(source or "")
    for path in paths or []:
        if text := page.text(page.at_path(path)):
            return text
    best = page.best()
    return page.text({best[0]}) if best else ""


def host_of(url) -> F.Column:
    """The host of a URL in lower case, without port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths) with the paths that have ``SHARE`` per cent of the host's votes or more, most votes first.

    Votes are added up in each batch, then by Spark before and after one shuffle by host and path: a host with most pages is no
    larger a group than its different paths. Pages without a host have no consensus.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for table in gathered(batches, "html"):
            votes = defaultdict(int)
            for host, source in zip(table.column("host").to_pylist(), table.column("html").to_pylist()):
                if vote := best_path(source):
                    votes[host, vote[0]] += vote[1]
            yield pa.RecordBatch.from_pylist([{"host": h, "path": p, "votes": n} for (h, p), n in votes.items()], pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())]))

    voted = pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> ''").mapInArrow(run, "host string, path string, votes long")
    voted = written(voted.groupBy("host", "path").agg(F.sum("votes").alias("votes")), "path-votes")
    total = voted.groupBy("host").agg(F.sum("votes").alias("total"))
    fit = voted.join(total, "host").where(F.col("votes") * 100 >= F.col("total") * SHARE)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")))
    return written(fit.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("paths")), "host-paths")


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html and any other columns) with ``text``, the main text, and without html; one row for each row.

    A null or empty html, and a page without text outside of menus and the like, give the empty text. Repeated rows are pages of their
    own. A url without a host, or null, takes the page's own best container. A column of ``pages`` called text is replaced.
    """
    paths = host_paths(pages)
    kept = [c for c in pages.columns if c.lower() not in ("html", "text")]
    host, chosen = clear_of("host", pages.columns), clear_of("paths", pages.columns)
    rows = pages.withColumn(host, host_of(F.col("url"))).join(paths.select(F.col("host").alias(host), F.col("paths").alias(chosen)), host, "left")
    rows = rows.select(*kept, chosen, F.col("html").alias("html"))
    schema = rows.select(*kept).schema.add("text", "string")

    def run(batches):
        for table in gathered(batches, "html"):
            text = [main_text(source, known) for source, known in zip(table.column("html").to_pylist(), table.column(chosen).to_pylist())]
            yield from table.select(kept).append_column("text", pa.array(text, pa.string())).to_batches()

    return rows.mapInArrow(run, schema)
