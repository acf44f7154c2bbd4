"""Main text of HTML pages.

Structure decides first. A light tree of the page is built, with the end tags that HTML lets pages
leave out. Cut are scripts, styles and other raw content, menus, headers, footers, sidebars, forms,
and what the words of a class, id or role call an advert, notice, comment or the like; every part of a
compound name has to agree, so that `table-header` stays. Articles inside articles are reader
comments, as HTML defines them, unless the outer one is but a frame. Of the articles that are
left (else the main elements) the longest stays, with those of at least half its length.

Every page goes through the host suffix array: the token streams of a host's pages are
concatenated, sorted suffixes find substrings of MIN_TOKENS or more, and those that MIN_PAGES distinct pages
of the host share are repeats. The pages of every MIN_TOKENS window are counted over the whole host by an aggregation, so a host
of any size is dealt into arrays of about PAGES pages, and the result does not depend on how. What repeats lose depends on the page:

* without an article or main element they go; the runs that they don't cover stay, without blocks that are mostly links;
* in articles a box (a div, list or the like with a class, id or role, or one article of several) goes if all text of its kind is
  repeats. Of an article that is over half repeats, which is a copy, nothing goes.

The streams hold what structure cuts, too, as a host's menus and notices show what it repeats. Text of an article that is in no
box is not in them: nothing there may go, since articles quote each other and end in common lines.

Nulls count as empty pages, whose text is empty; repeated rows are repeated in the result, and count as one page by
page_id, those without one by what they hold; pages without a url are one host. An empty table has an empty result. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import read
from .words import mix, ngrams, segment_hashes

MIN_TOKENS, MIN_PAGES, PAGES = 6, 3, 512
#: Without an article, blocks go of which more than this share of the characters is in links; beside the longest article, others stay from this share of its length.
LINK_SHARE, ARTICLE_SHARE = 0.5, 0.5

_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
#: Elements whose content holds no tags.
_RAW = {"script", "style", "iframe", "textarea", "title", "xmp"}
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in _RAW}
_CUT = {"noscript", "template", "svg", "object", "canvas", "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select"}
_BLOCK = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "section", "article",
    "main", "body", "html", "figure", "figcaption", "hr", "address", "details", "summary", "center", "fieldset",
}
#: What may be a box of its own inside an article.
_BOX = {"div", "section", "ul", "ol", "details", "fieldset", "center", "address"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {"span", "a", "button", "select"}
_TREE = _BLOCK | _CUT | _INLINE
#: End tags of other elements don't close these; a start tag of the key closes an open one of its values up to the list or table it is in.
_FRAMES = {"article", "main", "body", "html", "nav", "aside", "header", "footer", "form"}
_AGAIN = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(
    r"(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|newsletters?|subscribe|signup|sidebars?|menus?|nav|navbar|navigation|"
    r"breadcrumbs?|footers?|headers?|masthead|comments?|replies|disqus|respond|social|share|sharing|related|teasers?|widgets?|complementary|contentinfo|search|forms?|login)"
)
#: Words that may stand beside one of the above in a compound name.
_BESIDE = {"site", "page", "top", "bottom", "left", "right", "list", "item", "items", "box", "block", "container", "wrapper", "wrap", "section", "area", "inner", "outer", "global", "main", "bar", "links", "link", "buttons", "button", "posts", "post", "articles", "reader", "user", "slot", "unit", "message", "thread", "policy", "overlay", "primary", "secondary"}
_ALONE = {"side-bar"}


def _named(attributes: str) -> bool:
    """Whether a class, id or role calls the element something that is not of the main text."""
    for m in _ATTRIBUTE.finditer(attributes):
        for word in (m[2] or m[3] or m[4] or "").lower().split():
            parts = [x for x in re.split(r"[-_]+", word) if x and not x.isdigit()]
            told = [bool(_NAME.fullmatch(x)) for x in parts]
            if word in _ALONE or any(told) and all(ok or x in _BESIDE for ok, x in zip(told, parts, strict=True)):
                return True
    return False


class Element:
    __slots__ = ("attributes", "chars", "closed", "cut", "holds", "inner", "mute", "name", "parent")

    def __init__(self, name: str, parent: Element | None, cut: bool, attributes: str = ""):
        self.name, self.parent, self.cut, self.attributes = name, parent, cut, attributes
        self.mute = parent is not None and (parent.mute or cut and name in _INLINE)  # inside a block, whose other text goes on
        self.closed = self.holds = False  # by an end tag of its own; an article or main element
        self.chars = self.inner = 0  # of all its text that isn't cut; of articles directly inside


def tree(page: str) -> tuple[list[tuple[str, Element, float]], list[Element]]:
    """The text blocks in page order, each with its innermost element and its share of characters in links; and the article and main elements."""
    root = Element("", None, False)
    stack, at, text, linked, frames, blocks = [root], 0, [], 0, [], []
    in_link = False

    def flush() -> None:
        nonlocal linked
        if text:
            whole = html.unescape("".join(text))
            if block := " ".join(whole.split()):
                blocks.append((block, stack[-1], min(1.0, linked / len(block))))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1].mute:
            text.append(piece)
            if in_link:
                linked += len(piece)

    def close(to: int, own: bool) -> None:
        """Drop the stack's elements from `to` on; the first of them by its own end tag."""
        stack[to].closed = own
        del stack[to:]

    while True:
        m = _TAG.search(page, at)
        add(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name in _RAW:
            if not ends:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else at if name == "title" else len(page)
                add(" ")
            continue
        if name == "br":
            add(" ")
        if name == "a":
            in_link = not ends
        if name not in _TREE:
            continue
        if name not in _INLINE:
            flush()
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k, True)
                    break
                if stack[k].name in _FRAMES and name not in _FRAMES:
                    break
            continue
        if name in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "head":
                    close(k, True)
                    break
            if stack[-1].name == "p":
                close(len(stack) - 1, True)
        if name in _AGAIN:
            again, within = _AGAIN[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in again:
                    close(k, True)
                    break
                if stack[k].name in within or stack[k].name in _FRAMES:
                    break
        if name in _VOID or m[3].endswith("/") and name != "a":
            continue
        cut = name in _CUT or name not in ("main", "body", "html") and _named(m[3])
        stack.append(Element(name, stack[-1], cut, m[3] if name in _BOX else ""))
        if name in ("article", "main"):
            frames.append(stack[-1])
    flush()
    return blocks, frames


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The text blocks of a page that structure keeps, in order, and whether they are those of an article or main element."""
    found, sure = sections(page)
    return [text for text, kept, _ in found if kept], sure


def sections(page: str | None) -> tuple[list[tuple[str, bool, list[tuple]]], bool]:
    """All text blocks of a page in order, each with whether structure keeps it and the boxes that it is in; and whether those kept are of an article or main element."""
    found, frames = tree(page or "")
    for x in frames:
        if not x.cut:
            up = x.parent
            while up:
                up.holds = True
                up = up.parent

    def gone(e: Element | None) -> bool:
        """Whether an element is cut; one that was never closed, or a form, does not cut the articles inside it."""
        inside = False
        while e:
            if e.cut and not (inside and e.holds and (e.name == "form" or not e.closed)):
                return True
            inside = inside or e.name in ("article", "main")
            e = e.parent
        return False

    stays = [not gone(e) for _, e, _ in found]
    for (text, e, _), ok in zip(found, stays, strict=True):
        if not ok:
            continue
        inner = None
        while e:
            if e.name == "article":
                e.chars += len(text)
                if inner:
                    e.inner += len(text)
                inner = e
            elif e.name == "main":
                e.chars += len(text)
            e = e.parent
    for zone in ("article", "main"):
        chosen = [x for x in frames if x.name == zone and x.chars and not gone(x)]
        for x in chosen:  # a frame of articles: most of its text is theirs
            x.holds = zone == "article" and x.inner > x.chars - x.inner
        outer = []
        for x in chosen:
            up, nested = x.parent, False
            while up:
                nested = nested or up.name == zone and not up.holds
                up = up.parent
            if not nested and not x.holds:
                outer.append(x)
        if outer:
            longest = max(x.chars - x.inner for x in outer)
            main = {id(x) for x in outer if x.chars - x.inner >= ARTICLE_SHARE * longest}

            def of(e: Element | None) -> bool:
                while e and e.name != zone:
                    e = e.parent
                return e is not None and (id(e) in main if zone == "article" else id(e) in main or of(e.parent))

            def boxes(e: Element) -> list[tuple]:
                """By their kind: name, and class and role, or else id."""
                kinds = []
                while id(e) not in main:
                    if e.attributes and (told := _ATTRIBUTE.findall(e.attributes)):
                        kinds.append((e.name, *([x for x in told if x[0].lower() != "id"] or told)))
                    e = e.parent
                return [*kinds, (zone, id(e))] if len(main) > 1 else kinds

            kept = [ok and of(e) for (_, e, _), ok in zip(found, stays, strict=True)]
            inside = [boxes(e) if ok else [] for (_, e, _), ok in zip(found, kept, strict=True)]
            sizes = [text.count(" ") + 1 if ok else 0 for (text, _, _), ok in zip(found, kept, strict=True)]
            held = Counter[tuple]()
            for kinds, n in zip(inside, sizes, strict=True):
                held.update(dict.fromkeys(kinds, n))
            # a kind that holds over half of the text never goes: were it all repeats, this would be a copy
            small = {x for x, n in held.items() if 2 * n <= sum(sizes)}
            return [(text, ok, [x for x in kinds if x in small]) for (text, _, _), ok, kinds in zip(found, kept, inside, strict=True)], True
    return [(text, ok and share <= LINK_SHARE, []) for (text, _, share), ok in zip(found, stays, strict=True)], False


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes in sorted order, and each one's common prefix with the one before; by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1]
    step, order = 1, np.argsort(rank, kind="stable")
    while step < n:
        after = np.full(n, -1)
        after[:-step] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.concatenate(([0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    common, h = np.zeros(n, np.int64), 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and tokens[i + h] == tokens[j + h]:
                h += 1
            common[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return order, common


def windows(streams: list[list[str]], min_tokens: int = MIN_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all streams' tokens and the stream of each; and of every min_tokens tokens in a row of one stream: where they begin, and a hash."""
    sizes = np.array([len(s) for s in streams], np.int64)
    tokens = token_hashes([t for s in streams for t in s])
    stream = np.repeat(np.arange(len(streams)), sizes)
    w = ngrams(tokens, min_tokens)
    at = np.flatnonzero(stream[: len(w)] == stream[len(tokens) - len(w) :])
    return tokens, stream, at, w[at].view(np.int64)


def boilerplate(streams: list[list[str]], shared: np.ndarray, min_tokens: int = MIN_TOKENS) -> list[np.ndarray]:
    """For each stream, which of its tokens lie in a substring of min_tokens or more of which the host shares every window; `shared` has those windows."""
    tokens, stream, at, w = windows(streams, min_tokens)
    sizes = np.bincount(stream, minlength=len(streams))
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.arange(len(tokens)) + stream
    flat = np.empty(len(tokens) + len(streams), np.uint64)
    flat[place] = tokens
    flat[begin + sizes] = mix(np.arange(len(streams), dtype=np.uint64) ^ np.uint64(0xE7037ED1A0B428DB))  # ends differ, so that no match goes over one
    often = np.zeros(len(flat), bool)
    often[place[at]] = np.isin(w, shared)
    order, common = suffix_array(flat)
    gone = np.zeros(len(flat) + 1, np.int64)
    # runs of sorted suffixes that agree in min_tokens tokens or more are the places of one substring
    starts = np.flatnonzero(np.concatenate(([True], common[1:] < min_tokens)))
    hit = np.logical_or.reduceat(often[order], starts)
    places = order[np.repeat(hit, np.diff(np.append(starts, len(order))))]
    np.add.at(gone, places, 1)
    np.add.at(gone, np.minimum(places + min_tokens, len(flat)), -1)
    covered = np.cumsum(gone[:-1]) > 0
    return [covered[a : a + n] for a, n in zip(begin, sizes, strict=True)]


def token_hashes(stream: list[str]) -> np.ndarray:
    data = [t.encode("utf-8", "surrogatepass") for t in stream]
    size = np.array([len(x) for x in data], np.int64)
    end = np.cumsum(size)
    return segment_hashes(np.frombuffer(b"".join(data), np.uint8), end - size, end)


def _streams(found: list[tuple[str, bool, list[tuple]]], sure: bool) -> tuple[list[str], list[str]]:
    """The tokens of a page's kept blocks, if repeats may go from them, and those of its other blocks."""
    may_go = not sure or any(boxes for _, _, boxes in found)
    return [t for text, kept, _ in found if kept and may_go for t in text.split(" ")], [t for text, kept, _ in found if not kept for t in text.split(" ")]


def _without(found: list[tuple[str, bool, list[tuple]]], sure: bool, gone: np.ndarray) -> str:
    """The text of the kept blocks without repeats; `gone` tells the tokens that are."""
    kept = [(text, boxes) for text, ok, boxes in found if ok]
    if not gone.any() or sure and 2 * gone.sum() > len(gone):
        return "\n".join(text for text, _ in kept)
    tokens = [text.split(" ") for text, _ in kept]
    marks = np.split(gone, np.cumsum([len(x) for x in tokens])[:-1])
    if not sure:
        left = [" ".join(t for t, g in zip(x, m, strict=True) if not g) for x, m in zip(tokens, marks, strict=True)]
        return "\n".join(x for x in left if x)
    own = {box for (_, boxes), m in zip(kept, marks, strict=True) if not m.all() for box in boxes}
    return "\n".join(text for text, boxes in kept if own.issuperset(boxes))


def _page_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        streams = [s for x in batch.column(3) for s in _streams(*sections(x.as_py()))]
        _, stream, at, w = windows(streams)
        row = pa.array(stream[at] // 2)
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(row) for k in range(3)], pa.array(w)], ["host", "part", "page", "w"])


def _extract(pages: pa.Table, shared: pa.Table) -> pa.Table:
    found = [sections(x.as_py()) for x in pages["html"]]
    gone = boilerplate([s for x in found for s in _streams(*x)], shared["w"].to_numpy())
    texts = [_without(*x, g) for x, g in zip(found, gone[::2], strict=True)]
    return pa.table({"page_id": pages["page_id"], "url": pages["url"], "text": pa.array(texts, pa.string())})


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    pages = pages.withColumn("host", F.coalesce(F.regexp_extract("url", r"^\w+://([^/?#]+)", 1), F.lit("")))
    contents = F.concat(F.lit("#"), F.sha2(F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit(""))), 256))
    pages = pages.withColumn("page", F.coalesce(F.col("page_id").cast("string"), contents))
    # hosts of more than one array; fewer than 1 / PAGES of the pages
    large = pages.groupBy("host").agg(F.ceil(F.count("*") / PAGES).alias("arrays")).where("arrays > 1")
    dealt = pages.join(F.broadcast(large), "host", "left").withColumn("part", F.pmod(F.xxhash64("page"), F.coalesce("arrays", F.lit(1))))
    # a page is in one part only, so that counts of parts add up; one shuffle serves the distinct pages and their counts
    each = dealt.select("host", "part", "page", "html").mapInArrow(_page_windows, "host string, part long, page string, w long")
    counts = each.repartition("host", "part", "w").distinct().groupBy("host", "part", "w").agg(F.count("*").alias("pages"))
    often = counts.withColumn("pages", F.sum("pages").over(Window.partitionBy("host", "w"))).where(F.col("pages") >= MIN_PAGES)
    sides = [x.groupBy("host", "part") for x in (dealt.select("host", "part", "page_id", "url", "html"), often.select("host", "part", "w"))]
    out = sides[0].cogroup(sides[1]).applyInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
