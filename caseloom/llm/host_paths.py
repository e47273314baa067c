"""Main text of web pages by consensus of their host: containers are scored per page, hosts vote, winners are read.

Each page scores its containers by the text of the paragraphs in them. A container is named by its generalised
path: the tags from the root, with their classes, digits replaced. A page's votes go to the whole text around them: the
article or main a container stands in, else the lowest container with nearly all of the page's text. Spark sums the
votes per host and path. The page is then read again at its host's paths: those that several pages have as their best are
templates, and a page is read at all of them that it has, its own first; without one, at the best path it has; a page
without any is read at its own best.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import stored

PATHS_PER_HOST = 4
#: Hosts whose winners may go to every task; beyond, pages and winners are joined by host.
BROADCAST_HOSTS = 50_000
#: Paths that are the best of at least so many pages of a host, and of one in ``TEMPLATE_SHARE`` of them, are templates.
TEMPLATE_PAGES = 2
TEMPLATE_SHARE = 50
#: A container with so much of a page's unlinked text has nearly all of it.
NEARLY_ALL = 0.9
MAX_DEPTH = 40
FLUSH = 50_000

# No < outside quotes: else every tag that is never closed would be sought to the end of the page.
ATTRIBUTES = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Tags whose content is no markup and no text, tags without an end, and tags inside a line.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr", "label",
}
#: Tags and the words that mark what is no main text. A class, id or role made up of such words and of ``BESIDE`` marks, and
#: so does one with a word that begins like one of ``PLAIN_WORDS``, whatever else it says. One that holds another of these words hints
#: at it. With a word of ``STATES`` a class tells how a page is laid out, and neither marks nor hints.
LEFT_OUT_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"} | RAW
LEFT_OUT_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "gdpr", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo",
    "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget", "widgets",
}
PLAIN_WORDS = (
    "advert", "breadcrumb", "comment", "consent", "disqus", "gdpr", "livefyre", "masthead", "navbar", "navigation",
    "newsletter", "pagination", "popup", "reply", "replies", "respond", "sidebar", "sponsored", "subscribe",
)
STATES = {
    "active", "allowed", "closed", "disabled", "enabled", "full", "has", "have", "hide", "layout", "no", "none", "not",
    "off", "on", "open", "single", "template", "with", "without",
}
BESIDE = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "fixed", "form", "global",
    "group", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "mobile", "module", "outer",
    "page", "panel", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "signup", "site", "slot",
    "sticky", "stories", "text", "title", "top", "trail", "unit", "wrap", "wrapper", "zone",
}
SIZES = re.compile(r"v?\d+(?:x\d+)?")
#: A start tag ends open ones: those it names, up to the nearest of the second set.
_BLOCKS = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
    "table", "ul",
}
_BOUNDS = {"table", "td", "th", "body", "html", "button", "object"}
IMPLIED_ENDS = {
    **{tag: ({"p"}, _BOUNDS) for tag in _BLOCKS},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SPLIT = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"\d+")


@dataclass
class Block:
    """A block of text: the path of the containers it stands in, and how much of it is links."""

    path: tuple[str, ...]
    text: str
    linked: int
    marked: tuple[int, ...] = ()
    """The containers around it, by number, that a class, id or role marks as no main text."""
    hinted: tuple[int, ...] = ()
    """Those that a class, id or role only hints at."""


@dataclass
class _Open:
    tag: str
    name: str
    left_out: bool
    marked: int = 0
    hinted: int = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _marks(token: str, inside: bool) -> int:
    """2 if the token marks its container as no main text, 1 if it hints at that, else 0."""
    words = [w for w in SPLIT.split(token) if w and not SIZES.fullmatch(w)]
    out = [w in LEFT_OUT_WORDS or w == "header" and not inside for w in words]
    if any(out) and all(o or w in BESIDE or w == "header" for o, w in zip(out, words)):
        return 2
    if STATES.intersection(words):
        return 0
    return 2 if any(w.startswith(PLAIN_WORDS) for w in words) else int(any(w in LEFT_OUT_WORDS for w in words))


def _opened(tag: str, attributes: str, inside: bool) -> _Open:
    """``inside``: an article or main is open, so a header is the text's own."""
    if not attributes.strip(" /\n\t"):
        return _Open(tag, tag, tag in LEFT_OUT_TAGS or tag == "header" and not inside)
    found = _attributes(attributes)
    classes = found.get("class", "").lower().split()
    tokens = (*classes, found.get("id", "").lower(), *found.get("role", "").lower().split())
    marks = 0 if tag in ("html", "body", "article", "main") else max((_marks(t, inside) for t in tokens), default=0)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    left_out = hidden or tag in LEFT_OUT_TAGS or tag == "header" and not inside
    name = ".".join([tag, *sorted({DIGITS.sub("#", c) for c in classes})])
    if tag in INLINE:  # their text stands in the blocks around them
        return _Open(tag, name, left_out or marks == 2)
    return _Open(tag, name, left_out, int(marks == 2), int(marks == 1))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without what is marked or found to be no main text.

    What a class, id or role marks stays where it holds most of the page's unlinked text and no article or main
    outside it has any. What one hints at goes where it stands beside the text: it holds less than half of the unlinked
    text of the article or main around it, or of the page, and is mostly links, or no more of that text follows it.
    """
    found = list(_all_blocks(page))
    worth = [max(0, len(b.text) - 2 * b.linked) for b in found]
    inside: dict[int, int] = defaultdict(int)
    framed = 0
    framed_inside: dict[int, int] = defaultdict(int)
    for block, n in zip(found, worth):
        in_frame = n if block.marked and _framed(block.path) is not None else 0
        for k in block.marked:
            inside[k] += n
            framed_inside[k] += in_frame
        framed += n if _framed(block.path) is not None else 0
    if inside:
        most = sum(worth) / 2
        stay = {k for k, n in inside.items() if n > most and framed == framed_inside[k]}
        found = [b for b in found if stay.issuperset(b.marked)]
    return _without_hinted(found)


def _without_hinted(found: list[Block]) -> list[Block]:
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    inside: dict[int, int] = defaultdict(int)
    linked: dict[int, int] = defaultdict(int)
    length: dict[int, int] = defaultdict(int)
    frames = [_framed(b.path) for b in found]
    total: dict[tuple[str, ...] | None, int] = defaultdict(int)
    #: The last block of each frame that no hint stands around and that holds more than links.
    end: dict[tuple[str, ...] | None, int] = {}
    for i, (block, frame) in enumerate(zip(found, frames)):
        worth = max(0, len(block.text) - 2 * block.linked)
        total[frame] += worth
        if worth and not block.hinted:
            end[frame] = i
        for k in block.hinted:
            first.setdefault(k, i)
            last[k] = i
            inside[k] += worth
            linked[k] += block.linked
            length[k] += len(block.text)
    if not first:
        return found
    framed = any(total[frame] for frame in total if frame is not None)
    out = set()
    for k, i in first.items():
        frame = frames[i]
        if frame is None and framed:
            out.add(k)
        elif 2 * inside[k] < total[frame] and (2 * linked[k] >= length[k] or end.get(frame, -1) < i):
            out.add(k)
    return [b for b in found if out.isdisjoint(b.hinted)]


def _framed(path: tuple[str, ...]) -> tuple[str, ...] | None:
    """The outermost article around a path, else the innermost main."""
    tags = [name.split(".")[0] for name in path]
    if "article" in tags:
        return path[: tags.index("article") + 1]
    if "main" in tags:
        return path[: len(tags) - tags[::-1].index("main")]
    return None


def _all_blocks(page: str) -> Iterator[Block]:
    stack: list[_Open] = []
    #: Where each tag is open, and the names, marks and hints of what is open: no tag looks through the stack.
    open_at: dict[str, list[int]] = defaultdict(list)
    names: list[str] = []
    marked: list[int] = []
    hinted: list[int] = []
    pieces: list[str] = []
    linked, out, at, numbered = 0, 0, 0, 0

    def flush() -> Block | None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        done, linked = linked, 0
        if not text:
            return None
        return Block(tuple(names[:MAX_DEPTH]), text, done, tuple(marked[:MAX_DEPTH]), tuple(hinted[:MAX_DEPTH]))

    def put(text: str) -> None:
        nonlocal linked
        if not out and text:
            pieces.append(entities.unescape(text))
            if open_at["a"]:
                linked += len(text)

    def close(depth: int) -> None:
        nonlocal out
        while len(stack) > depth:
            gone = stack.pop()
            open_at[gone.tag].pop()
            out -= gone.left_out
            if _names_a_container(gone.tag):
                names.pop()
            if gone.marked:
                marked.pop()
            if gone.hinted:
                hinted.pop()

    def implied(ends: set[str], bounds: set[str]) -> int | None:
        """The lowest open tag of ``ends`` above the highest of ``bounds``."""
        bound = max((open_at[t][-1] for t in bounds if open_at[t]), default=-1)
        above = (open_at[t] for t in ends if open_at[t] and open_at[t][-1] > bound)
        return min((places[bisect_right(places, bound)] for places in above), default=None)

    lowered = page.lower()
    if len(lowered) != len(page):  # a few letters change length; then ends of raw tags are sought as they stand
        lowered = page
    found = TAG.search(page)
    while found:
        put(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            pass
        elif found[1]:
            if tag not in INLINE:
                block = flush()
                if block:
                    yield block
            if open_at[tag]:
                close(open_at[tag][-1])
        else:
            if tag == "br":
                put(" ")
            elif tag not in INLINE:
                block = flush()
                if block:
                    yield block
            if tag in IMPLIED_ENDS:
                depth = implied(*IMPLIED_ENDS[tag])
                if depth is not None:
                    close(depth)
            if tag in ("svg", "math") and found[3].endswith("/"):
                pass
            elif tag in RAW:
                end = lowered.find(f"</{tag}", at)
                at = len(page) if end < 0 else end
            elif tag not in VOID and not found[3].endswith("/"):
                opened = _opened(tag, found[3], bool(open_at["article"] or open_at["main"]))
                open_at[tag].append(len(stack))
                stack.append(opened)
                out += opened.left_out
                numbered += 1
                if _names_a_container(tag):
                    names.append(opened.name)
                if opened.marked:
                    marked.append(numbered)
                if opened.hinted:
                    hinted.append(numbered)
        found = TAG.search(page, at)
    put(page[at:])
    block = flush()
    if block:
        yield block


def _names_a_container(tag: str) -> bool:
    return tag not in INLINE and tag != "p"


def _container(path: tuple[str, ...]) -> tuple[str, ...]:
    while path and path[-1].split(".")[0] in _LEAVES:
        path = path[:-1]
    return path


def _widened(found: list[Block]) -> Callable[[tuple[str, ...]], tuple[str, ...]]:
    """From a container of a page to the one that holds the whole text around it.

    That is the article or main it stands in. On pages without text in one it is the lowest container with nearly all of
    the unlinked text, and the one around that, short of the body, whose own blocks or main heading it lacks.
    """
    below: dict[tuple[str, ...], int] = defaultdict(int)
    right_in, titled = set(), set()
    for block in found:
        worth = max(0, len(block.text) - 2 * block.linked)
        if worth:
            path = _container(block.path)
            right_in.add(path)
            below[path] += worth
            if any(name.split(".")[0] == "h1" for name in block.path):
                titled.add(path)
    for path, worth in list(below.items()):
        for k in range(len(path)):
            below[path[:k]] += worth
    titled = {path[:k] for path in titled for k in range(len(path) + 1)}
    total = below[()]
    framed = any(_framed(path) for path in right_in)

    def widen(path: tuple[str, ...]) -> tuple[str, ...]:
        if framed:
            return _framed(path) or path
        while path and below[path] < NEARLY_ALL * total:
            path = path[:-1]
        for k in range(len(path) - 1, 0, -1):
            around = path[:k]
            if around[-1].split(".")[0] in ("html", "body"):
                break
            if around in right_in and k == len(path) - 1 or around in titled and path not in titled:
                path = around
        return path

    return widen


def scores(found: list[Block]) -> dict[str, float]:
    """The score of each container: the unlinked text of the blocks right in it, and half of those one level below.

    Headings and list items count for the container around them. Commas and length speak for running text. What
    containers inside a whole text score is its own.
    """
    result: dict[str, float] = defaultdict(float)
    widen = _widened(found)
    names: dict[tuple[str, ...], str] = {}

    def name(path: tuple[str, ...]) -> str:
        if path not in names:
            names[path] = ">".join(widen(path))
        return names[path]

    for block in found:
        worth = max(0, len(block.text) - 2 * block.linked)
        if not worth:
            continue
        worth *= 1 + min(3, block.text.count(",") / 3)
        path = _container(block.path)
        result[name(path)] += worth
        if path:
            result[name(path[:-1])] += worth / 2
    return result


_LEAVES = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "blockquote", "pre", "dd", "dt", "dl", "td", "th", "tr", "tbody", "table", "figure", "figcaption"}


def own_best(found: list[Block]) -> str | None:
    votes = scores(found)
    return _best(votes) if votes else None


def _best(votes: dict[str, float]) -> str:
    return min(votes, key=lambda p: (-votes[p], p))


def _under(path: str, around: str) -> bool:
    return not around or path == around or path.startswith(around + ">")


def read_at(found: list[Block], paths: list[str], templates: Iterable[str] = ()) -> str:
    """The blocks under the page's templates, else under the first of ``paths`` it has, else under its own best container.

    Templates count in the order of ``paths``, after the page's own best if that is one. One that holds another or
    stands in it is passed over.
    """
    standing = [">".join(b.path) for b in found]
    best = own_best(found)
    if best in templates:
        paths = [best, *paths]
    taken: list[str] = []
    for path in [*paths, *([] if best is None else [best])]:
        if taken and (path not in templates or any(_under(path, t) or _under(t, path) for t in taken)):
            continue
        if any(_under(where, path) for where in standing):
            taken.append(path)
    return "\n".join(b.text for b, where in zip(found, standing) if any(_under(where, t) for t in taken))


def host_of(url: Column) -> Column:
    """The host of an address in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(host, F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes: dict[tuple[str, str], int] = defaultdict(int)
    wins: dict[tuple[str, str], int] = defaultdict(int)

    def flush() -> pa.RecordBatch:
        rows = [(host, path, n, wins[host, path]) for (host, path), n in votes.items()]
        votes.clear()
        wins.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
            ],
            names=["host", "path", "votes", "wins"],
        )

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found = scores(blocks(page or ""))
            total = sum(found.values())
            for path, worth in found.items():
                # A page has a thousand votes, however long it is; whole numbers, so that sums have one result.
                votes[host, path] += round(1000 * worth / total)
            if found:
                wins[host, _best(found)] += 1
        if len(votes) > FLUSH:
            yield flush()
    yield flush()


def winning_paths(pages: DataFrame, paths: int = PATHS_PER_HOST) -> DataFrame:
    """``(host, paths, templates)``: paths per host, best first: the ones with most votes, and all templates.

    Ties go to the smaller path.
    """
    votes = (
        pages.where(F.col("host").isNotNull())
        .mapInArrow(_vote, "host string, path string, votes long, wins long")
        .groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("wins").alias("wins"))
    )
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    voted = F.sum("wins").over(Window.partitionBy("host"))
    template = (F.col("wins") >= TEMPLATE_PAGES) & (F.col("wins") * TEMPLATE_SHARE >= F.col("voted"))
    ranked = votes.withColumns({"rank": rank, "voted": voted}).withColumn("template", template)
    listed = F.array_sort(F.collect_list(F.struct("rank", "path", "template")))
    return (
        ranked.where((F.col("rank") <= paths) | F.col("template")).groupBy("host").agg(listed.alias("listed"))
        .select(
            "host", F.transform("listed", lambda x: x["path"]).alias("paths"),
            F.transform(F.filter("listed", lambda x: x["template"]), lambda x: x["path"]).alias("templates"),
        )
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            read_at(blocks(page or ""), paths or [], templates or [])
            for page, paths, templates in zip(*(batch.column(k).to_pylist() for k in ("html", "paths", "templates")))
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    Blocks stand in page order, joined by one line feed; white space inside a block is one space. Null and empty pages
    give an empty text. Pages without a host take no part in the vote and are read at their own best container.
    Repeated rows vote and are read each; an empty table gives an empty result. Other columns are not read.
    """
    read = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        host_of(F.col(url_col)).alias("host"),
    )
    winners = stored(winning_paths(read.select("host", "html")), "winners")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    return read.join(winners, "host", "left").select("page_id", "url", "html", "paths", "templates").mapInArrow(
        _read, "page_id long, url string, text string, n_chars long"
    )

