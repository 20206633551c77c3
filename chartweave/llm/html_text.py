"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that their paragraphs hold against the text
of links; from the best one the page climbs to the whole article, and that container votes for
its generalised path (tags and classes, digits as #). Spark counts the votes of each host, and
pages are extracted again with their host's winning path, from which they climb as well. A page
that doesn't have it (or has no text there) uses its own best container.

Marks (tags, roles, classes) of parts beside the article are judged on the whole page: a marked
wrapper around the article isn't beside it. Work and memory are linear in the size of a page,
however deep its elements nest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chartweave.llm.shared import MAX_BROADCAST_KEYS, packed, write_through

# Elements without an end tag, without readable text, and beside the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
NEVER = set("head button select option menu dialog svg canvas object video audio".split())
FRAME = set("nav header footer aside".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = set("p pre blockquote li dd dt figcaption caption".split()) | HEADINGS
ROLES = set("navigation banner contentinfo complementary search menu menubar toolbar dialog alert".split())
ARTICLE = ("article", "main")
#: Parts of an article that never are the whole of it.
PARTS = set("ul ol dl table tbody thead tfoot tr figure".split())
#: Open elements that a start tag ends.
ENDS = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
#: Words of a class or id that mark parts beside the article. After has-, with- or no- they
#: only tell the layout of a container.
BESIDE = re.compile(
    r"ads?|advert.*|adbox|banner|breadcrumbs?|byline|comments?|cookies?|consent|disqus|footer|"
    r"header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo.*|"
    r"related|replies|share|sharing|sidebar|signup|social|sponsor.*|subscribe|toolbar|widgets?"
)
#: Everyday words among them: they count as the first or last part of a name, not within it.
EVERYDAY = set("header notice notices related share sharing social".split())
#: What readers wrote may be longer than the article.
READERS = set("comment comments disqus replies".split())

#: How strongly an element is marked as beside the article.
NONE, WRAPPER, HOLDER, ALWAYS = range(4)
#: A marked wrapper with so many paragraphs and ten times the other prose of its page holds the article.
PARAGRAPHS = 3

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+\Z",
    re.DOTALL,
)
#: One attribute after another: its name, then a value if there is one; an open quote takes the rest.
_ATTRIBUTE = re.compile(
    r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)))?"
)
_DIGITS = re.compile(r"\d+")


class _Element:
    """An element on the stack. ``box`` is its innermost container, ``block`` what isn't inline."""

    __slots__ = ("block", "box", "linked", "prose", "tag", "up")

    def __init__(self, tag: str, up: _Element | None, box: _Box) -> None:
        self.tag, self.up, self.box = tag, up, box
        inline = tag in INLINE
        self.block = up.block if inline and up else self
        self.linked = tag == "a" or (up is not None and up.linked)
        self.prose = tag in PROSE or (up is not None and up.prose)


class _Box:
    """A container: an element that is neither prose nor inline, with sums over what it holds."""

    __slots__ = (
        "chars", "hidden", "links", "mark", "name", "on", "own_chars", "paragraphs", "score",
        "tag", "up", "whole", "words", "wrapped",
    )

    def __init__(self, tag: str, name: str, up: _Box | None, mark: int = NONE) -> None:
        self.tag, self.name, self.up, self.mark = tag, name, up, mark
        self.hidden, self.score, self.on = False, 0.0, False
        self.chars = self.links = self.own_chars = self.words = self.paragraphs = 0
        self.wrapped = False
        self.whole: _Box | None = (up and up.whole) or (self if tag == "article" else None)

    def path(self) -> str:
        names, box = [], self
        while box.up is not None:
            names.append(box.name)
            box = box.up
        return "".join(f"/{name}" for name in reversed(names))


class _Block:
    __slots__ = ("box", "kind", "links", "text")

    def __init__(self, box: _Box, text: str, links: int, kind: str) -> None:
        self.box, self.text, self.links, self.kind = box, text, min(links, len(text)), kind


@lru_cache(4096)
def _named_beside(value: str) -> int:
    """How strongly a class or id marks an element."""
    mark = NONE
    for token in value.lower().split():
        parts = [p for p in re.split("[_-]", token) if p]
        for i, part in enumerate(parts):
            if part in ("has", "with", "no"):
                break
            if BESIDE.fullmatch(part) and not (part in EVERYDAY and 0 < i < len(parts) - 1):
                mark = max(mark, HOLDER if part in READERS else WRAPPER)
    return mark


def _marks(tag: str, attributes: str) -> tuple[str, int]:
    """The generalised classes of an element, and how strongly it is marked as beside the article."""
    classes, met = "", set()
    mark = ALWAYS if tag in NEVER else HOLDER if tag in FRAME else WRAPPER if tag == "form" else NONE
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name in met:  # the first one counts
            continue
        met.add(name)
        if name == "class":
            classes = ".".join(_DIGITS.sub("#", value).replace("/", "_").split())
        if name in ("class", "id"):
            mark = max(mark, _named_beside(value))
        elif name == "role" and value.lower() in ROLES:
            mark = max(mark, HOLDER)
        elif name == "hidden" and not value:
            mark = ALWAYS
    return classes, NONE if tag in ("html", "body") else mark


def parse(page: str) -> tuple[list[_Box], list[_Block]]:
    """All containers of a page, outer before inner, and its blocks in order, marked ones included."""
    root = _Box("", "", None)
    boxes, found = [root], []
    stack = [_Element("", None, root)]
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    linked, kind, skipped = 0, "", 0  # skipped: depth of the stack at which a part without text began

    def flush() -> None:
        nonlocal linked, kind
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            if own:
                found.append(_Block(stack[-1].box, own, linked, kind))
            text.clear()
        linked, kind = 0, ""

    def close(tag: str) -> None:
        nonlocal skipped
        if not open_tags[tag]:
            return
        while True:
            last = stack.pop().tag
            open_tags[last] -= 1
            if last == tag:
                break
        if skipped and len(stack) < skipped:
            skipped = 0

    at = 0
    while True:
        match = _TAG.search(page, at)
        piece = page[at : match.start()] if match else page[at:]
        if piece and not skipped:
            text.append(piece)
            if not piece.isspace():
                last = stack[-1]
                if last.linked:
                    linked += len(piece)
                if last.prose and not kind:
                    kind = last.block.tag if last.block.tag in PROSE else "p"
        if not match:
            break
        at = match.end()
        tag = (match[1] or match[4] or "").lower()
        if match[3]:
            tag = match[3].lower()
            if tag not in INLINE and not skipped:
                flush()
            close(tag)
        elif tag:
            if tag == "br" or (tag in INLINE and tag in VOID):
                if not skipped:
                    text.append(" ")
                continue
            if tag not in INLINE and not skipped:
                flush()
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
                at = end.start() if end else len(page)
                continue
            if tag in VOID:
                continue
            # A block ends an open paragraph, an item or cell the one before it.
            if tag not in INLINE:
                while (open_ := stack[-1].block.tag) == "p" or open_ in ENDS.get(tag, ()):
                    close(open_)
            classes, mark = _marks(tag, match[2] or match[5] or "")
            up = stack[-1]
            box = up.box
            if tag not in INLINE and (tag not in PROSE or NONE < mark < ALWAYS) and not skipped:
                box = _Box(tag, f"{tag}.{classes}" if classes else tag, up.box, mark)
                boxes.append(box)
            stack.append(_Element(tag, up, box))
            open_tags[tag] += 1
            if not skipped and (mark == ALWAYS or (mark and tag in INLINE)):
                skipped = len(stack)
    if not skipped:
        flush()
    return boxes, found


def _judge_marks(boxes: list[_Box], found: list[_Block]) -> None:
    """Hide marked containers, but for those around the article.

    A marked container holds the article if its page has no unmarked ``article`` or ``main`` elsewhere,
    it has one, and more prose than the unmarked rest. Forms and class names (not those of readers'
    comments) do so too without such an element, by ``PARAGRAPHS`` and ten times the rest's prose.
    """
    free = 0  # prose outside all marks
    outside = False
    for box in boxes:
        box.hidden = box.mark > NONE or (box.up is not None and box.up.hidden)
        if box.tag in ARTICLE and not box.hidden:
            outside = True
    for block in found:
        if block.kind:
            prose = max(0, len(block.text) - 2 * block.links)
            block.box.words += prose
            block.box.paragraphs += block.kind == "p" and prose > 0
            if not block.box.hidden:
                free += prose
    for box in reversed(boxes):
        if box.mark and box.mark < ALWAYS and not outside:
            by_element = box.wrapped and box.words > free
            by_prose = box.mark == WRAPPER and box.paragraphs >= PARAGRAPHS and box.words > 10 * free
            if by_element or by_prose:
                box.mark = NONE
        if box.up is not None and not box.mark:
            box.up.words += box.words
            box.up.paragraphs += box.paragraphs
            box.up.wrapped |= box.wrapped or box.tag in ARTICLE
    for box in boxes:
        box.hidden = box.mark > NONE or (box.up is not None and box.up.hidden)


class Page:
    """The visible blocks of a page and the scores of its containers."""

    def __init__(self, page: str) -> None:
        self.boxes, found = parse(page)
        _judge_marks(self.boxes, found)
        self.blocks = [b for b in found if not b.box.hidden]
        for b in self.blocks:
            box, n = b.box, len(b.text)
            box.score += (1.0 if b.kind else 0.5) * (n - 2 * b.links)
            box.chars += n
            box.links += b.links
            if b.kind:
                box.own_chars += n
        for box in reversed(self.boxes):
            if box.up is not None:
                box.up.score += 0.8 * box.score
                box.up.chars += box.chars
                box.up.links += box.links
        # Sections of prose beside one another, counted for what holds them.
        self.sections = Counter(
            id(box.up) for box in self.boxes if box.tag == "section" and 10 * box.links < 3 * box.chars
        )

    def best(self) -> _Box | None:
        """The article around the container with the highest score; of equal ones the inner one."""
        best = None
        for box in self.boxes:
            if box.chars and (best is None or box.score >= best.score):
                best = box
        return best and self.whole(best)

    def whole(self, box: _Box) -> _Box:
        """Climb from a container to the whole article.

        The outermost ``article`` element around it is the article. Else lists, tables and figures are
        left for what holds them (but for cells with paragraphs, which lay out a page), and a container for its parent if that holds prose or headings itself, or
        sections beside this one, in which links don't prevail. What ``body`` holds itself has to be a
        quarter of the container, as it may be a frame's.
        """
        if box.whole is not None:
            return box.whole
        while box.up is not None:
            up = box.up
            own = up.own_chars if 10 * (up.links - box.links) < 3 * (up.chars - box.chars) else 0
            if up.tag in ("", "html", "body") and 4 * own < box.chars:
                own = 0
            beside = box.tag == "section" and self.sections[id(up)] > 1
            part = box.tag in PARTS or (box.tag in ("td", "th") and not box.paragraphs)
            if not (part or own or beside):
                break
            box = up
        return box

    def at(self, path: str) -> list[_Box]:
        """All containers with a path, not those inside one another."""
        names = path.split("/")[1:]
        depth = {id(self.boxes[0]): 0}
        self.boxes[0].on = True
        same = []
        for box in self.boxes[1:]:
            d = depth[id(box.up)]
            box.on = box.up.on and d < len(names) and names[d] == box.name
            depth[id(box)] = d + 1
            if box.on and d + 1 == len(names):
                same.append(box)
        return same if names else self.boxes[:1]

    def inside(self, holders: list[_Box]) -> list[str]:
        """The texts of all blocks in some containers, in page order."""
        for box in self.boxes:
            box.on = False
        for box in holders:
            box.on = True
        for box in self.boxes:
            box.on = box.on or (box.up is not None and box.up.on)
        return [b.text for b in self.blocks if b.box.on]


def blocks(page: str) -> list[tuple[_Box, str]]:
    """(innermost container, text) of each visible block of a page, in order."""
    return [(b.box, b.text) for b in Page(page).blocks]


def main_text(page: str, path: str | None) -> str:
    """The text of the articles at the path, or else of the page's own best one."""
    read = Page(page)
    same = [b for b in read.at(path) if b.score > 0] if path is not None else []  # not those of links
    own = read.inside([*same, read.whole(max(same, key=lambda b: b.chars))]) if same else []
    if not own:
        best = read.best()
        own = read.inside([best]) if best is not None else []
    return "\n\n".join(own)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            best = Page(page.as_py()).best()
            if best is not None and best.score > 0:
                hosts.append(host)
                paths.append(best.path())
                scores.append(round(best.score))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())],
            names=["host", "path", "score"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(page.as_py(), path)
            for page, path in zip(batch.column("html"), batch.column("path").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lowered; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, upper, lower)


def extract_main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, from the whole html.

    Null html counts as empty and gives an empty text. Null urls share the empty host. Repeated
    rows give a row each; other columns are ignored; an empty table gives an empty result. Of paths with
    equal votes the one with the higher scores wins, then the first by name. Very long and very deep
    pages are read whole, in time and memory linear in their length.
    """
    rows = packed(pages).select(
        F.col("row")[page_id].alias("page_id"),
        F.col("row")[url].alias("url"),
        host_of(F.col("row")[url]).alias("host"),
        F.coalesce(F.col("row")[markup].cast("string"), F.lit("")).alias("html"),
    )
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path string, score bigint")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum("score").alias("total"))
    first = F.row_number().over(
        Window.partitionBy("host").orderBy(F.desc("pages"), F.desc("total"), "path")
    )
    winners = write_through(
        counted.withColumn("place", first).where("place = 1").select("host", "path"), "host-paths"
    )
    # One short path for each host: broadcast while there are few hosts, else a plain join.
    few = winners.limit(MAX_BROADCAST_KEYS // 4 + 1).count() <= MAX_BROADCAST_KEYS // 4
    kinds = dict(rows.dtypes)
    return (
        rows.join(F.broadcast(winners) if few else winners, "host", "left")
        .select("page_id", "url", "html", "path")
        .mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
    )
