"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks, each the text between two borders of block elements,
with its path of tags from the root. Over the page, per path:

* text ratio: characters outside links for each block of the path,
* punctuation ratio: marks for each block of the path.

Both ratios stand at each block of the page's sequence, are smoothed along it by a Gaussian
kernel and fused to ``text * (1 + punctuation)``. A path whose fused score, averaged over
its blocks, reaches a quarter of the page's average (by characters) holds content. Blocks in
the same article or section as content belong to it, as do headings just before it; so short
paragraphs, titles and lists are not lost.

Elements that say what they are (navigation, forms, scripts, classes named for adverts,
comments and the like) take no part from the start.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the page's average score that a content path reaches.
SHARE = 0.25
#: Open elements at most, as in browsers.
DEPTH = 512
#: Weights of a block's neighbours in the smoothing, by distance.
KERNEL = np.exp(-0.5 * np.arange(3) ** 2)

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
HEAD = frozenset("html head base link meta noscript script style template title".split())
PLACES = frozenset("article body div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end may be left out: what a start tag of each closes, and where the search for it ends.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
#: Never content, and never content whatever is inside.
NEVER = frozenset("script style noscript template iframe object svg math canvas audio video head title select option button textarea input datalist dialog nav aside footer menu xmp noembed noframes".split())
#: Roles and class names of what is not content, but for an article inside.
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NOT_CONTENT_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs colophon consent cookie cookies copyright
    footer foot gdpr header legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup popups
    promo promos promoted promotion related recommended recommendations search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors
    subscribe subscription tagcloud tags toolbar topbar widget widgets""".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies reply".split())
#: A name with one of these speaks of a layout ("no-sidebar").
LAYOUT_NAMES = frozenset("has with no without".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+|=)*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = re.compile(r"[.,;:!?…、。，！？؟،]")


@dataclass
class Block:
    """Text of a page between two borders of block elements."""

    text: str
    path: int
    #: Number of the innermost of ``PLACES`` around the block, in page order; 0 outside all.
    place: int
    heading: bool
    #: Characters inside links.
    linked: int


@dataclass
class _Element:
    tag: str
    path: int
    place: int
    #: 0 content, 1 not content but for an article inside, 2 not content.
    gate: int
    link: bool
    heading: bool
    article: bool


def _named(attributes: dict[str, str], article: bool) -> int:
    """What an element's class, id and role say: see ``_Element.gate``."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return 2
    if attributes.get("role", "").lower() in ROLES:
        return 1
    gate = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = {w.lower() for w in _NAME.findall(name)}
        if words & LAYOUT_NAMES:
            continue
        if words & COMMENT_NAMES:
            return 2
        found = words & NOT_CONTENT_NAMES
        if found - ({"header"} if article else set()):
            gate = 1
    return gate


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks that may be content, in page order, and for each place the place it counts as.

    A place is a part of a page; inside an article or main element it counts as that, and the
    root and the body count as 0. Follows tag soup as browsers do in what matters here: void and
    raw elements, ends left out, ends without a start (ignored), comments, a tag or comment that
    never ends (the rest is dropped). Beyond ``DEPTH`` open elements a new one replaces the last.
    """
    paths: dict[tuple[int, str, str], int] = {}
    around = [0]
    stack = [_Element("", 0, 0, 0, False, False, False)]
    open_tags: dict[str, int] = {}
    found: list[Block] = []
    pieces: list[str] = []
    linked = 0
    at, end = 0, len(page)

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].gate:
            raw = html.unescape(raw)
            pieces.append(raw)
            if stack[-1].link:
                linked += len(_SPACE.sub("", raw))

    def border() -> None:
        nonlocal linked
        if pieces:
            body = _SPACE.sub(" ", "".join(pieces)).strip()
            if body:
                owner = stack[-1]
                found.append(Block(body, owner.path, owner.place, owner.heading, linked))
            pieces.clear()
        linked = 0

    def pop(to: int) -> None:
        if any(e.tag not in INLINE for e in stack[to:]):
            border()
        for e in stack[to:]:
            open_tags[e.tag] -= 1
        del stack[to:]

    def close(tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        """End the outermost open element of ``tags`` inside the innermost of ``until``."""
        if not any(open_tags.get(t) for t in tags):
            return
        best = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in until:
                break
            if stack[i].tag in tags:
                best = i
        if best is not None:
            pop(best)

    def start(tag: str, raw: str) -> None:
        nonlocal at
        if tag not in HEAD:
            close(("head",), ())
        if tag == "a":
            stop(tag)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop(len(stack) - 1)
        if tag in CLOSES_P:
            close(("p",), ("table", "button", "object"))
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if len(stack) > DEPTH:
            pop(len(stack) - 1)
        top = stack[-1]
        if tag in VOID:
            if tag not in INLINE:
                border()
            elif tag == "br":
                text(" ")
            return
        if tag not in INLINE:
            border()
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw.strip() else {}
        gate = max(2 if tag in NEVER else 1 if tag == "form" or tag == "header" and not top.article else 0, 0 if tag in ("html", "body") else _named(attributes, top.article))
        if tag in ("article", "main"):
            own = 2 if gate == 2 else 0
            gate = max(own, 0 if top.gate == 1 else top.gate)
        else:
            gate = max(gate, top.gate)
        path, place = top.path, top.place
        if tag not in INLINE:
            path = paths.setdefault((path, tag, attributes.get("class", "")), len(paths) + 1)
        if tag in PLACES:
            place = len(around)
            around.append(0 if tag == "body" else around[top.place] if top.article and tag not in ("article", "main") else place)
        stack.append(_Element(tag, path, place, gate, top.link or tag == "a", top.heading or tag in HEADINGS, top.article or tag in ("article", "main")))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in RAW:
            last = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            at = last.start() if last else end

    def stop(tag: str) -> None:
        if not open_tags.get(tag):
            if tag == "p":
                border()
            elif tag == "br":
                text(" ")
            return
        i = max(i for i, e in enumerate(stack) if e.tag == tag)
        if tag in INLINE and any(e.tag not in INLINE for e in stack[i:]):
            # <b><p></b>: the paragraph stays open
            for e in stack[i:]:
                e.link = e.link and tag != "a"
            open_tags[tag] -= 1
            del stack[i]
        else:
            pop(i)

    while at < end:
        tag = page.find("<", at)
        if tag < 0:
            text(page[at:])
            break
        text(page[at:tag])
        if page.startswith("<!--", tag):
            stop_at = page.find("-->", tag + 2)
            at = end if stop_at < 0 else stop_at + 3
        elif page.startswith(("<!", "<?"), tag):
            stop_at = page.find(">", tag)
            at = end if stop_at < 0 else stop_at + 1
        elif m := _TAG.match(page, tag):
            at = m.end()
            if m[1]:
                stop(m[2].lower())
            else:
                start(m[2].lower(), m[3])
        elif re.match("</?[A-Za-z]", page[tag : tag + 3]):
            at = end
        else:
            text("<")
            at = tag + 1
    pop(1)
    border()
    return found, around


def smooth(values: np.ndarray) -> np.ndarray:
    """Averages with both neighbours by ``KERNEL``; ends have fewer neighbours."""
    sums, weights = np.zeros(len(values)), np.zeros(len(values))
    for gap, w in enumerate(KERNEL):
        if gap >= len(values):
            break
        sums[gap:] += w * values[: len(values) - gap]
        weights[gap:] += w
        if gap:
            sums[:-gap] += w * values[gap:]
            weights[:-gap] += w
    return sums / weights


def ratios(found: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, text ratio, punctuation ratio) of each block; paths are numbered from 0, and menus have ratios of 0."""
    _, path = np.unique([b.path for b in found], return_inverse=True)
    length = np.array([len(_SPACE.sub("", b.text)) for b in found], float)
    linked = np.array([b.linked for b in found], float)
    marks = np.array([len(_MARK.findall(b.text)) for b in found], float)
    count = np.bincount(path)
    inside, whole = np.bincount(path, linked), np.bincount(path, length)
    menu = (count >= 3) & (2 * inside > whole)
    plain = np.where(menu, 0.0, (whole - inside) / count)
    return path, plain[path], np.where(menu, 0.0, np.bincount(path, marks) / count)[path]


def content(found: list[Block], around: list[int], share: float = SHARE) -> np.ndarray:
    """Which blocks belong to the main text."""
    if not found:
        return np.zeros(0, bool)
    path, plain, marks = ratios(found)
    fused = smooth(plain) * (1 + smooth(marks))
    length = np.array([len(b.text) for b in found], float)
    mean = np.bincount(path, fused) / np.bincount(path)
    kept = (mean[path] >= share * (fused * length).sum() / length.sum()) & (plain > 0)
    if not kept.any():
        # links only, or marks only: nothing sets blocks apart
        return plain > 0 if plain.any() else ~_menus(found)
    place = np.array(around)[[b.place for b in found]]
    more = np.isin(place, place[kept & (place > 0)]) & (plain > 0)
    first = int(np.flatnonzero(kept)[0])
    while first and found[first - 1].heading and plain[first - 1] > 0:
        first -= 1
        more[first] = True
    return kept | more


def _menus(found: list[Block]) -> np.ndarray:
    path, plain, _ = ratios(found)
    return (np.bincount(path)[path] >= 3) & (plain == 0)


def main_text(page: str | None) -> str:
    """The main text of a page, a line per block; empty without any."""
    found, around = blocks(page or "")
    return "\n".join(b.text for b, k in zip(found, content(found, around)) if k)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every row, and its length in code points.

    A null or empty page, or one without main text, has an empty text. Ids and addresses are
    passed on as they are, nulls and repeated rows too. Pages are read one by one, as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long")


def op12(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


#: What stands in the one article element that the given pages have, whose markup needs no tree.
ORACLE = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>|</?b>', ' ', 'g') AS body FROM pages
), b AS (
  SELECT page_id, url, regexp_split_to_array(body, '<[^>]*>') AS parts FROM a
), c AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM b
), d AS (
  SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM c
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
