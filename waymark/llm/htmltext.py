"""Main text of web pages by consensus paths of their hosts.

Every page is read into blocks of text, each below a chain of containers.  A container's path is its
chain of tags and classes with digits generalised, kept as a chained 64-bit hash.  All containers of one path
are scored together: the harmonic mean of the share of the page's prose that they hold and of the share of
prose in what they hold, with a bonus for names like "article".  Each page deals one vote over its paths by
their scores.  Spark sums the votes per host and path; the paths with at least ``SHARE`` of a vote for each
page of the host win.  Each page is then read again and takes the path with the best product of its own score
and the square of its host's vote (plus ``PRIOR``, so that a page unlike its host's others goes by its own score).

Elements that hold boilerplate by their kind (menus, page headers, footers, sidebars, forms, hidden parts) or
by words in class, id or role (adverts, notices, comments) are left out, unless they alone hold an article or
main element, or most of the text of a page that has none elsewhere.  A word counts where it makes up the
name: ``entry-header`` and ``market-share`` name no boilerplate, and no header inside an article does.
Character references are decoded, white space in a block becomes one space, and blocks are joined by line feeds.

Pages are read in one pass, in time and memory linear in their length, however tags nest or quotes lack.

Defined results: null or empty html gives an empty text; a null url, or one without "://", has the empty
host and votes with those like it; ties between paths go to the deeper one, then to the first on the page;
repeated rows vote and are extracted alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from waymark.llm._common import settle, table
from waymark.llm.urls import host_of

SHARE, PRIOR, SHARP, LEAST_PROSE, BROADCAST_ROWS = 0.1, 0.05, 8, 100, 100_000

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li listing main menu nav noframes ol optgroup option"
    " p plaintext pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("html body div section article main td center form aside nav header footer table tbody tr ul ol dl blockquote".split())
DROPPED = frozenset(
    "head nav footer aside button select option menu dialog canvas object video audio map svg iframe frameset annotation annotation-xml".split()
)
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "textarea", "title")}
SELF_CLOSING = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
# Words in class, id and role that mark what is not the article: wherever they stand in a name,
# only together with words that say nothing, and what may say so.
AWAY = re.compile(
    r"ads?|advert.*|sponsor.*|banner|nav|navbar|navigation|footnav|menu.*|breadcrumbs?|sidebar|masthead|topbar|toolbar|cookies?|consent|gdpr"
    r"|popup|modal|overlay|dialog|comments?|commentlist|respond|disqus|newsletter|subscri.*|signup|login|pagination|pager|contentinfo"
    r"|complementary|hidden"
)
PERHAPS = re.compile(r"header|footer|side|notice|notification|alert|share|sharing|social|related|recommend.*|search|widgets?|skip|copyright|repl(y|ies)|promo.*")
IDLE = re.compile(
    r"[0-9]*|site|page|main|content|post|posts|entry|article|articles|story|stories|area|bar|block|box|body|bottom|buttons?|container|group|icons?"
    r"|inner|item|items|left|right|top|link|links|list|outer|panel|section|text|wrap|wrapper|the|to|global|primary|secondary"
)
STATE = frozenset("has no with without not".split())
TITLED = frozenset("article content entry main page post story".split())
TOWARDS = re.compile(r"(?<![a-z])(article|content|post|entry|story|main|text|body|page)(?![a-z])")

OPENING = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
MARKS = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL, PARTS = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^a-z0-9]+")


def tags(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, closing, name, attributes) of each tag, and at last (text, False, "", "").

    A quote that never ends is read as an ordinary sign.  Comments and raw elements are passed over.
    """
    at, begin, last, broken = 0, 0, html.rfind(">"), 0
    parts: list[str] = []
    while 0 <= (spot := html.find("<", at)) < last:
        at = spot + 1
        if html.startswith("!--", at):
            end = html.find("-->", at + 1)
            parts.append(html[begin:spot])
            begin = at = end + 3 if end >= 0 else len(html)
            continue
        m = OPENING.match(html, at)
        if m is None:
            if html[at] in "!?/":
                parts.append(html[begin:spot])
                begin = at = html.find(">", at) + 1
            continue
        end = html.find(">", m.end())
        if m.end() >= broken and end >= 0:
            close = QUOTED.match(html, m.end()).end()
            if close < len(html) and html[close] == ">":
                end = close
            else:
                broken = close  # no tag before this place is searched for quotes again
        if end < 0:
            break
        name = m[2].lower()
        parts.append(html[begin:spot])
        begin = at = end + 1
        if not m[1] and name in RAW:
            stop = RAW[name].search(html, at)
            begin = at = stop.end() if stop else len(html)
            continue
        yield "".join(parts), bool(m[1]), name, html[m.end() : end]
        parts = []
    yield "".join(parts) + html[begin:].partition("<!--")[0], False, "", ""


NONE, CONTESTED, SURE = range(3)


def boilerplate(names: str, titled: bool = False) -> int:
    """Whether a class, id or role names what is not the article: ``NONE``, ``CONTESTED`` or ``SURE``.

    ``titled``: inside an article, where headers belong to it, and where a name is only sure if its last word that says
    anything speaks of boilerplate ("reader-comments", not "hidden-gems") and no other name of the element says something else.
    """
    said, other = NONE, False
    for name in names.split():
        words = [w for w in PARTS.split(CAMEL.sub("-", name).lower()) if w]
        if not words or words[0] in STATE:
            continue
        telling = [w for w in words if not IDLE.fullmatch(w)]
        away = [w for w in words if AWAY.fullmatch(w)]
        perhaps = [w for w in words if PERHAPS.fullmatch(w) and not (w == "header" and (titled or TITLED.intersection(words)))]
        if away:
            said = max(said, SURE if not titled or AWAY.fullmatch(telling[-1]) or PERHAPS.fullmatch(telling[-1]) else CONTESTED)
        elif perhaps and all(PERHAPS.fullmatch(w) or IDLE.fullmatch(w) for w in words):
            said = SURE
        elif telling:
            other = True
    return CONTESTED if titled and said == SURE and other else said


class Page:
    """The blocks of a page: (text, characters in links, container) and the containers (parent, path, bonus)."""

    def __init__(self, html: str):
        self.parents, self.paths, self.bonus = [-1], [1], [1.0]
        self.blocks: list[tuple[str, int, int]] = []
        #: Elements that may be boilerplate: the region around each, 0 for none; and the regions that article or main opens in.
        self._around, self._leads = [0], []
        self._contested: set[int] = set()  # regions whose names also say something else
        self._regions: list[int] = []  # of the blocks
        self._read(html)
        self._sift()

    def _sift(self) -> None:
        """Drop the blocks of boilerplate regions, but for those that hold the article or most of the text."""
        size, linked = [0] * len(self._around), [0] * len(self._around)
        for (text, links, _), region in zip(self.blocks, self._regions, strict=True):
            size[region] += len(text)
            linked[region] += links
        whole, leads, holds = sum(size), set(self._leads), [False] * len(size)
        for own in range(len(size) - 1, 0, -1):  # inner ones first
            size[self._around[own]] += size[own]
            linked[self._around[own]] += linked[own]
            holds[own] = (holds[own] or own in leads) and size[own] > 0
            holds[self._around[own]] |= holds[own]
        kept, found = [True], 0 in leads
        for own in range(1, len(size)):  # outer ones first
            prose = own in self._contested and size[own] >= LEAST_PROSE and 2 * linked[own] < size[own]
            kept.append(kept[self._around[own]] and (prose or not found and (holds[own] or 2 * size[own] > whole)))
            found = found or kept[own] and own in leads
        self.blocks = [b for b, region in zip(self.blocks, self._regions, strict=True) if kept[region]]

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, int]] = []  # tag, its container, left out, its region
        open_: dict[str, list[int]] = {}  # where on the stack each tag is open
        walls: list[int] = []  # where containers are
        container, away, region, parts, links, in_link = 0, False, 0, [], 0, False

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text and not away:
                    self.blocks.append((text, links, container))
                    self._regions.append(region)
                parts.clear()
            links = 0

        def close(k: int) -> None:
            nonlocal container, away, region
            while len(stack) > k:
                open_[stack.pop()[0]].pop()
                if walls and walls[-1] == len(stack):
                    walls.pop()
            container, away, region = stack[-1][1:] if stack else (0, False, 0)

        for text, closing, tag, attributes in tags(html):
            if text:
                parts.append(text)
                links += len(text) if in_link else 0
            if tag in ("br", ""):
                parts.append(" ")
                continue
            if tag == "a":
                in_link = not closing
            block = tag in BLOCKS
            if block:
                flush()
                in_link = False
            wall = walls[-1] if walls else -1
            if closing:
                k = open_[tag][-1] if open_.get(tag) else -1
                if k >= 0 and (block or k > wall):
                    if not block and (away, region) != (stack[k - 1][2:] if k else (False, 0)):
                        flush()
                    close(k)
                continue
            if tag in VOID:
                continue
            k = max((open_[t][-1] for t in SELF_CLOSING.get(tag, ()) if open_.get(t)), default=-1)
            if k > wall:
                # The outermost of those that the new element ends.
                close(min(open_[t][-1] for t in SELF_CLOSING[tag] if open_.get(t) and open_[t][-1] > wall))
            titled = bool(open_.get("article") or open_.get("main"))
            inside = away or tag in DROPPED or (tag == "header" and not titled)
            names, named = "", SURE if tag == "form" else NONE
            if attributes and attributes != "/":
                found = [(a.lower(), b or c or d) for a, b, c, d in MARKS.findall(attributes)]
                if not inside and tag not in ("html", "body", "article", "main"):
                    named = max(named, boilerplate(" ".join(v for a, v in found if a in ("class", "id", "role")), titled))
                inside = inside or any(a == "hidden" or a == "aria-hidden" and v == "true" or a == "style" and UNSEEN.search(v) for a, v in found)
                names = " ".join(v for a, v in found if a == "class").lower()
            if (inside or named) and not away and not block:
                flush()
            if named and not inside:
                self._around.append(region)
                region = len(self._around) - 1
                if named == CONTESTED:
                    self._contested.add(region)
            if tag in ("article", "main") and not inside:
                self._leads.append(region)
            if tag in CONTAINERS:
                walls.append(len(stack))
                if not inside:
                    name = tag + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(names.split())))
                    self.parents.append(container)
                    self.paths.append(xxh64_intdigest(name.encode("utf-8", "surrogatepass"), self.paths[container]))
                    self.bonus.append((1.5 if tag in ("article", "main") else 1.0) * (1.25 if TOWARDS.search(names) else 1.0))
                    container = len(self.paths) - 1
            away = inside
            open_.setdefault(tag, []).append(len(stack))
            stack.append((tag, container, away, region))
        flush()

    def scores(self) -> dict[int, float]:
        """Of each path, but for those whose text one container below holds: how well its containers fit the prose of the page."""
        prose, size, widest = ([0.0] * len(self.paths) for _ in range(3))
        for text, links, container in self.blocks:
            prose[container] += max(0.0, len(text) - 2.0 * links) + 20.0 * (len(text) > 60)
            size[container] += len(text) + 20.0
        for c in range(len(self.paths) - 1, 0, -1):  # inner ones first
            above = self.parents[c]
            prose[above] += prose[c]
            size[above] += size[c]
            widest[above] = max(widest[above], size[c])
        by_path: dict[int, list[float]] = {}
        for c in range(len(self.paths) - 1, -1, -1):
            if prose[c] > 0 and widest[c] < size[c]:
                own = by_path.setdefault(self.paths[c], [0.0, 0.0, self.bonus[c]])
                own[0] += prose[c]
                own[1] += size[c]
        # A name counts for as much as the path holds of the page, so that it never outweighs prose beside it.
        return {path: 2 * (1 + (bonus - 1) * (p / prose[0]) ** 2) * p / (prose[0] + n) for path, (p, n, bonus) in by_path.items()}

    def votes(self) -> dict[int, float]:
        """One vote, dealt over the paths of the page by their scores."""
        sharp = {path: v**SHARP for path, v in self.scores().items()}
        total = sum(sharp.values())
        return {path: v / total for path, v in sharp.items()} if total > 0 else {}

    def text(self, winners: dict[int, float] | None = None) -> str:
        """All blocks in the path that fits best by the page's own score and its host's votes."""
        scores = self.scores()
        if not scores:
            return "\n".join(text for text, _, _ in self.blocks)
        known = winners or {}
        best = max(scores, key=lambda path: scores[path] * (PRIOR + known.get(path, 0.0) ** 2))  # the deepest of equal ones
        inside = [False] * len(self.paths)
        for c in range(len(self.paths)):
            inside[c] = self.paths[c] == best or (self.parents[c] >= 0 and inside[self.parents[c]])
        return "\n".join(text for text, _, c in self.blocks if inside[c])


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def host_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths, votes): the paths of each host with at least ``share`` of a vote for each of its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[tuple[str, int | None], float] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[host, None] = totals.get((host, None), 0.0) + 1.0
                for path, vote in Page(html or "").votes().items():
                    totals[host, path] = totals.get((host, path), 0.0) + vote
            hosts, paths = [h for h, _ in totals], [None if p is None else _signed(p) for _, p in totals]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(list(totals.values()), pa.float64())], names=["host", "path", "vote"])

    votes = pages.select(host_of("url").alias("host"), "html").mapInArrow(run, "host string, path bigint, vote double")
    summed = settle(votes.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote")))
    sizes = summed.where("path is null").select("host", F.col("vote").alias("pages"))
    good = summed.where("path is not null").join(sizes, "host").select("host", "path", (F.col("vote") / F.col("pages")).alias("vote")).where(F.col("vote") >= share)
    # A page has one vote, so that at most 1 / share paths of a host win.
    won = good.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "vote"))).alias("won"))
    return won.select("host", F.transform("won", lambda w: w["path"]).alias("paths"), F.transform("won", lambda w: w["vote"]).alias("votes"))


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(page_id, url, text) for every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html")
    winners = settle(host_paths(rows, share))
    if winners.count() <= BROADCAST_ROWS:
        winners = F.broadcast(winners)
    joined = rows.withColumn("host", host_of("url")).join(winners, "host", "left").select("page_id", "url", "html", "paths", "votes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, paths, votes in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                known = {p & ((1 << 64) - 1): v for p, v in zip(paths or [], votes or [], strict=True)}
                texts.append(Page(html or "").text(known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    ids = joined.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {ids}, url string, text string")


def op10_htmltext(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
