"""Main text of web pages through the consensus of each host's pages.

Every page scores its own containers and votes for the generalised tag-class path of the best one. Spark counts the
votes of each host; the winning path is then extracted from all its pages, so that a page whose own scores mislead it
follows its host. A page that lacks the path keeps its own choice.

Names of classes, ids and roles are weights, not verdicts: an element that its names speak against is left out unless
it holds most of the page's text, the larger a part the more they speak against it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import column_values, slices, written

#: Fixed values of HTML: elements without an end, with raw text, that stand in a line, and that may hold an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body main article section div td center blockquote form".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li td th tr tbody thead".split())
#: Elements that are never part of an article.
NEVER = frozenset("nav footer aside script style noscript iframe template svg button select textarea title head object canvas dialog menu input option label legend".split())
#: Words of names that speak against an element, those of reader comments, words that speak for it, and first words
#: after which a name says what an element lacks or goes with.
UNWANTED = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail widget widgets footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager tags skip copyright legal disclaimer".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
WANTED = frozenset("article content post entry story main body text maincontent articlebody prose".split())
WITHOUT = frozenset("no not has have had is with without hide show js".split())
#: The share of the page's text that an element must hold to stay, by how much its names speak against it.
STAYS = (0.5, 0.7, 0.9)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|$)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NUMBER = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")


class Element:
    """A tag of the tree: ``box`` is the container around it, ``plain`` its text outside of links and of what never
    counts, ``skip`` whether it is no part of an article."""

    __slots__ = ("tag", "label", "parent", "box", "depth", "weight", "never", "skip", "score", "plain", "inside")

    def __init__(self, tag: str, label: str, parent: "Element | None", weight: int = 0, never: bool = False):
        self.tag, self.label, self.parent, self.weight, self.never, self.skip = tag, label, parent, weight, never, never
        self.box = None if parent is None else parent if parent.tag in CONTAINERS else parent.box
        self.depth = 0 if parent is None else parent.depth + 1
        self.score, self.plain = 0.0, 0
        #: Texts and elements in page order.
        self.inside: list = []

    @property
    def path(self) -> str:
        labels, e = [], self
        while e.parent is not None:
            labels.append(e.label)
            e = e.parent
        return "/".join(["", *reversed(labels)])


def name_weight(name: str) -> int:
    """What one class, id or role says: -1 to -3 against, 1 for the article. The last word of a name says what it is."""
    words = _WORD.findall(name)
    if not words or words[0] in WITHOUT:
        return 0
    if not COMMENTS.isdisjoint(words):
        return -3
    against = 2 if words[-1] in UNWANTED else 0 if UNWANTED.isdisjoint(words) else 1
    return (words[-1] in WANTED or against == 2 and not WANTED.isdisjoint(words)) - against


def _described(tag: str, rest: str) -> tuple[str, int, bool]:
    """(generalised tag.class, weight of its names, hidden)."""
    if not rest or rest.isspace():
        return tag, 0, False
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), value.strip("\"'").lower())
    classes = found.get("class", "").split()
    weights = {w for n in (*classes, *found.get("id", "").split(), *found.get("role", "").split()) if (w := name_weight(n))}
    # Of several names the one that says most against counts, one that speaks for the element makes up for a little.
    weight = min(weights, default=0) + (max(weights, default=0) > 0 > min(weights, default=0))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "style" in found and bool(_UNSEEN.search(found["style"]))
    return ".".join([tag, *sorted({_NUMBER.sub("#", c) for c in classes})]).replace("/", "|"), weight, hidden


def parsed(page: str) -> list[Element]:
    """The elements of a page in page order, the root first: as browsers do, a block ends an open paragraph, and end
    tags without a start are ignored."""
    root = top = Element("#", "#", None)
    order = [root]
    raw = ""
    open_tags: dict[str, int] = {}

    def close(to: Element) -> Element:
        nonlocal top
        while top is not to:
            open_tags[top.tag] -= 1
            top = top.parent
        open_tags[top.tag] -= 1
        return top.parent

    at, size = 0, len(page)
    while at < size:
        if raw:  # until the end tag nothing is markup
            end = re.compile(rf"</{raw}\s*>?", re.I).search(page, at)
            top.inside.append(page[at : end.start() if end else size])
            at = end.end() if end else size
            top, raw = close(top), ""
            continue
        m = _TOKEN.match(page, at)
        at = m.end()
        slash, tag, rest, text = m.groups()
        if text is not None:
            top.inside.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if open_tags.get(tag):
                e = top
                while e.tag != tag:
                    e = e.parent
                top = close(e)
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            e = top
            while e.tag != "p" and e.tag not in CONTAINERS and e.parent:
                e = e.parent
            if e.tag == "p":
                top = close(e)
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and top.tag == tag:
            top = close(top)
        label, weight, hidden = _described(tag, rest)
        if tag in ("html", "body"):
            weight = 0
        elif tag == "form" or tag == "header" and not open_tags.get("article") and not open_tags.get("main"):
            weight = min(weight, -1 if tag == "form" else -2)  # a header outside of an article is the site's
        new = Element(tag, label, top, weight, hidden or tag in NEVER)
        top.inside.append(new)
        order.append(new)
        if tag in VOID or rest.endswith("/") and tag not in CLOSES_P:
            continue
        top = new
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in RAW:
            raw = tag
    for e in reversed(order):
        e.plain += sum(len(x.strip()) for x in e.inside if isinstance(x, str))
        if e.parent is not None and not e.never and e.tag != "a":
            e.parent.plain += e.plain
    for e in order[1:]:
        against = min(-e.weight, len(STAYS))
        e.skip = e.parent.skip or e.never or against > 0 and e.plain <= STAYS[against - 1] * root.plain
    return order


def containers(order: list[Element]) -> list[Element]:
    """The page's containers that aren't skipped, with their scores: text without links, and half of it for what holds
    them, twice as much for articles and half as much again for names that speak for them."""
    sums = {id(order[0]): [0, 0]}
    linked: set[int] = set()
    for e in order[1:]:  # page order: what holds an element comes before it
        if not e.skip:
            if e.tag == "a" or id(e.parent) in linked:
                linked.add(id(e))
            sums[id(e)] = [0, 0]
    out = []
    for e in reversed(order):
        own = sums.get(id(e))
        if own is None:
            continue
        n = sum(len(x.strip()) for x in e.inside if isinstance(x, str))
        own[0] += n
        own[1] += n if id(e) in linked else 0
        if e.tag not in CONTAINERS:
            if e.parent is not None:
                above = sums[id(e.parent)]
                above[0] += own[0]
                above[1] += own[1]
            continue
        out.append(e)
        gain, holder, share = max(0.0, own[0] - 2.0 * own[1]), e, 1.0
        while holder is not None and share > 0.1:
            holder.score += gain * share
            share *= 0.5
            holder = holder.box
    for e in out:
        if e.tag in ("article", "main"):
            e.score *= 2.0
        elif e.weight > 0:
            e.score *= 1.5
        elif e.weight < 0 or e.tag in ("html", "body"):
            e.score *= 0.5
    out.reverse()
    return out


def best(found: list[Element]) -> Element | None:
    """The container of the highest score; of equal ones the one that is least deep, then the first."""
    return max(found, key=lambda e: (e.score, -e.depth), default=None)


def main_text(e: Element) -> str:
    """Text in page order without what isn't the article, character references decoded, white space as one space."""
    parts: list[str] = []
    stack = [iter([e])]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                parts.append(unescape(child) if "&" in child else child)
            elif child is e or not child.skip:
                if child.tag not in INLINE:
                    parts.append(" ")
                    stack.append(iter([*child.inside, " "]))
                else:
                    stack.append(iter(child.inside))
                break
        else:
            stack.pop()
    return " ".join("".join(parts).split())


def vote(page: str) -> tuple[str, float] | None:
    e = best(containers(parsed(page)))
    return (e.path, e.score) if e is not None and e.score > 0 else None


def on_path(order: list[Element], path: str) -> set[int]:
    """Which elements (by identity) a path leads to, found from the root down."""
    labels = path.split("/")[1:]
    along, ends = {id(order[0])}, set()
    for e in order[1:]:
        if e.depth <= len(labels) and e.label == labels[e.depth - 1] and id(e.parent) in along:
            along.add(id(e))
            if e.depth == len(labels):
                ends.add(id(e))
    return ends


def extracted(page: str, path: str | None) -> tuple[str, str]:
    """(text, path it came from): all containers of the winning path, else the page's own best, else the whole page."""
    order = parsed(page)
    found = containers(order)
    ends = on_path(order, path) if path else set()
    chosen = [e for e in found if id(e) in ends and e.score > 0]
    if not chosen:
        own = best(found)
        chosen = [own] if own is not None and own.score > 0 else [order[0]]
    return " ".join(t for t in map(main_text, chosen) if t), chosen[0].path


def host(url: str) -> F.Column:
    """Host of a url in lower case without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, score): what the pages of each host voted for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            got = [vote(h) for h in column_values(batch, "html", "")]
            keep = [k for k, g in enumerate(got) if g]
            yield pa.RecordBatch.from_pydict({"host": batch.column(0).take(pa.array(keep, pa.int64())), "path": pa.array([got[k][0] for k in keep], pa.string()), "score": pa.array([got[k][1] for k in keep], pa.float64())})

    ballots = pages.select(host(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path string, score double")
    return ballots.groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum("score").alias("score"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, path): the path of most pages; ties go to the path that sorts first."""
    return counted.groupBy("host").agg(F.min_by("path", F.struct((-F.col("pages")).alias("n"), F.col("path"))).alias("path"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, path) of every row. Null and empty pages have an empty text; pages without a host vote together.

    Repeated rows stay repeated, other columns aren't read. Pages of a host that vote evenly follow the path that sorts
    first. A page's tree is held by its task, some 700 bytes a tag.

    The vote is counted with map-side sums, so a host of very many pages is a few rows a task. Pages of such a host
    meet its one winning row in a join that Spark can split.
    """
    # Written first, so that its size is known: few hosts are sent to the pages, many are met in a sorted join.
    won = written(winners(votes(pages, url_col=url_col, html_col=html_col)).withColumnRenamed("host", "__host"), "host-paths")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(url_col).alias("host"))
    joined = rows.join(won, rows.host == F.col("__host"), "left").select("id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            got = [extracted(h, p) for h, p in zip(column_values(batch, "html", ""), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["id", "url", "text", "path"])

    return joined.mapInArrow(run, f"id {dict(pages.dtypes)[id_col]}, url string, text string, path string").withColumnRenamed("id", id_col)
