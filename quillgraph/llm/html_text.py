"""Main text of web pages by the distribution of text over line blocks.

One scan strips the markup: a block-level tag ends a line, and each line keeps how many of its characters stand in links, and
the element that holds it. A line's mass is its characters less twice those in links. Masses are summed over a sliding window
of lines. Text surges where a window's sum reaches a threshold, and dives where it falls below; the threshold is taken from the
page itself. What lies between a surge and its dive is one stretch. The stretch with the most mass is the article's, with those
of its container and others of like mass.

Names only weigh. Lines of elements whose name, class, id or role says navigation, footer, advert, comments and the like weigh
nothing, so that text dives at them. A name is not believed where the element's share of the page speaks against it: a wrapper of
half of the page's mass that is called sidebar is none, nor is a form or a hidden element of that size. Names of wrappers and
those of insertions (adverts, comments) are told apart: the latter also have to hold the page's title or article to be no such.
Lines of links stay only alone and inside the text, so that menus, lists of other stories and the like go from inside an
article too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table

#: Lines of a window.
WINDOW = 3
#: The threshold: a share of the mass of the line in which the middle character of the page's mass lies, and its upper bound.
SHARE, MOST = 0.25, 150
#: Share of the page's mass from which an element's name is doubted, and of a stretch's mass that its container holds.
LARGE, CONTAINER = 0.5, 0.8
#: A stretch outside of the article's container is kept from this share of the article's mass on.
OTHER = 0.2

# Element names of HTML, and what closes what.
NAMED = frozenset("nav footer aside menu".split())
CONTROLS = frozenset("button select option datalist".split())
SKIPPED = frozenset("script style noscript template iframe textarea title head svg math object canvas audio video".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li dt dd td th tr tbody thead tfoot table ul ol dl blockquote pre figure figcaption caption address".split())
CLOSED_BY = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup")}
BOUNDS = {"li": ("ul", "ol", "menu"), "td": ("table",), "th": ("table",), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select", "datalist")}

#: What an element's name says: nothing; a wrapper may be called so too; an insertion; certain; a header.
NOTHING, WRAPPER, INSERTION, CERTAIN, HEADER = range(5)
#: A class, id or role says that its element is no article text if it is made of such a word and of others of these lists.
HEADERS = frozenset("header masthead".split())
WRAPPERS = frozenset("nav navbar navigation menu menubar sidebar footer banner search modal overlay complementary contentinfo pager pagination".split())
INSERTIONS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted breadcrumb breadcrumbs cookie cookies consent gdpr notice popup newsletter subscribe signup login share sharing social comment comments disqus respond reply replies related recommended copyright skip".split()
)
BESIDE = frozenset("area bar block body bottom box btn button buttons container form global group inner item items left line link links list main outer page panel post primary right row secondary section side site small stories text top unit widget wrap wrapper".split())
OWN_RIGHTS = re.compile(r"^\s*(?:©|\(c\)\s|copyright\s*(?:©|\(c\)|\d{4}))|\ball rights reserved\b", re.IGNORECASE)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE = re.compile(r"=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
SPACE = re.compile(r"\s+")
ENDS = (".", "!", "?", "…", "。", "！", "？", '"', "”", "»", ")", ":")


@dataclass
class Lines:
    """text, characters in links, element, whether it is in a list, in a heading: of each line; parent, what its name says,
    whether it is an article or main element, has the page's title or is such an element, is a container, is the page
    itself: of each element, in page order; 0 holds all."""

    text: list[str]
    links: list[int]
    element: list[int]
    listed: list[bool]
    heading: list[bool]
    parent: list[int]
    says: list[int]
    article: list[bool]
    title: list[bool]
    container: list[bool]
    top: list[bool]


def attributes(rest: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; of repeated ones the first."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), "".join(values))
    return found


def hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(given.get("style", "")) is not None


def named(given: dict[str, str]) -> int:
    """What class, id, role and label say."""
    for kind in ("class", "role", "id", "aria-label"):
        value = given.get(kind, "")
        for token in value.split() if kind in ("class", "role") else [value]:
            parts = [p.lower() for p in PARTS.findall(token)]
            for says, words in ((INSERTION, INSERTIONS), (WRAPPER, WRAPPERS), (HEADER, HEADERS)):
                if any(p in words for p in parts) and all(p in INSERTIONS or p in WRAPPERS or p in HEADERS or p in BESIDE or p.isdigit() for p in parts):
                    return says
    return NOTHING


def meaning(name: str, given: dict[str, str], in_article: bool) -> int:
    """What a block element says of its text; in an article a header is the article's own."""
    if name in NAMED:
        return CERTAIN
    if name in ("html", "body", "main"):
        return NOTHING
    says = named(given)
    if name == "article":
        return says if says == INSERTION else NOTHING
    if says == NOTHING and (name in ("form", "dialog") or hidden(given)):
        says = WRAPPER
    if says == NOTHING and name == "header":
        says = HEADER
    return NOTHING if says == HEADER and in_article else says


def _tag_end(source: str, at: int) -> int:
    """Where the > of a tag stands that begins before ``at``, quoted values looked over; -1 if it never ends."""
    end = source.find(">", at)
    while end >= 0 and (m := QUOTE.search(source, at, end)):
        close = source.find(m.group(1), m.end())
        if close < 0:
            break
        at = close + 1
        if end < at:
            end = source.find(">", at)
    return end


def lines_of(source: str) -> Lines:
    """One pass over the page, in time proportional to its length."""
    out = Lines([], [], [], [], [], [0], [NOTHING], [False], [False], [True], [True])
    now: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, element (that of the parent for inline ones), whether its text is left out
    places: dict[str, list[int]] = {}  # where in the stack a name is open
    blocks: list[int] = []  # where block elements are
    element = mute = links = link_chars = headings = articles = 0

    def close() -> None:
        nonlocal link_chars
        text = SPACE.sub(" ", html.unescape("".join(now))).strip()
        if text:
            out.text.append(text)
            out.links.append(min(link_chars, len(text)))
            out.element.append(element)
            out.listed.append(bool(places.get("li")))
            out.heading.append(headings > 0)
        now.clear()
        link_chars = 0

    def say(text: str) -> None:
        nonlocal link_chars
        if text and not mute:
            now.append(text)
            link_chars += len(text.strip()) if links else 0

    def push(name: str, says: int, muted: bool) -> None:
        nonlocal element, mute, links, headings, articles
        if name in BLOCKS:
            out.parent.append(element)
            out.says.append(says)
            out.article.append(name in ("article", "main"))
            out.title.append(name in ("article", "main", "h1"))
            out.container.append(name not in TEXTUAL)
            out.top.append(name in ("html", "body"))
            element = len(out.parent) - 1
            blocks.append(len(stack))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, element, muted))
        mute += muted
        links += name == "a"
        headings += name in HEADINGS
        articles += name in ("article", "main")

    def pop() -> str:
        nonlocal element, mute, links, headings, articles
        name, own, muted = stack.pop()
        places[name].pop()
        mute -= muted
        links -= name == "a"
        headings -= name in HEADINGS
        articles -= name in ("article", "main")
        if name in BLOCKS:
            blocks.pop()
            element = out.parent[own]
        return name

    def close_implied(name: str) -> None:
        """Ends the open elements that this start tag ends: what stands above the nearest of the elements that bound it, or
        a paragraph that is the innermost block."""
        if name in CLOSED_BY:
            bound = max((places[x][-1] for x in BOUNDS[name] if places.get(x)), default=-1)
            ends = [places[x] for x in (*CLOSED_BY[name], "p") if places.get(x)]
            low = min((x[k] for x in ends if (k := bisect_right(x, bound)) < len(x)), default=len(stack))
        else:
            low = blocks[-1] if name in BLOCKS and blocks and stack[blocks[-1]][0] == "p" else len(stack)
        while len(stack) > low:
            pop()

    at, n, last = 0, len(source), source.rfind(">")
    while at < n:
        less = source.find("<", at)
        if less < 0:
            say(source[at:])
            break
        say(source[at:less])
        after = source[less + 1 : less + 2]
        if after in ("!", "?"):
            if source.startswith("<!--", less):
                end = source.find("-->", less + 4)
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", less)
                at = n if end < 0 else end + 1
            continue
        closing = after == "/"
        m = NAME.match(source, less + 1 + closing)
        if not m:
            if closing and less < last:
                at = source.find(">", less) + 1  # </> and the like are no text
            else:
                say("<")
                at = less + 1
            continue
        end = _tag_end(source, m.end())
        if end < 0:
            break  # a tag that never ends
        name, rest, at = m.group().lower(), source[m.end() : end], end + 1
        if closing:
            if name in BLOCKS:
                close()
            if places.get(name):
                while pop() != name:
                    pass
            continue
        if name == "br":
            say(" ")
            continue
        if name in SKIPPED and name not in RAW:
            close_implied(name)
            if not rest.endswith("/"):
                push(name, NOTHING, True)
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s>/])", re.IGNORECASE).search(source, at)
            if end is None:
                break
            stop = source.find(">", end.end())
            at = n if stop < 0 else stop + 1
            continue
        if name in BLOCKS:
            close()
            close_implied(name)
        if name in VOID or rest.endswith("/"):
            continue
        given = attributes(rest) if rest else {}
        if name in BLOCKS:
            push(name, meaning(name, given, articles > 0), False)
        else:
            push(name, NOTHING, name in CONTROLS or hidden(given))
        if name == "body" and places.get("head"):  # a head that was never closed
            mute -= sum(x[2] for x in stack if x[0] == "head")
            stack[:] = [(x[0], x[1], x[2] and x[0] != "head") for x in stack]
    close()
    return out


def window_sums(mass: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each line the mass of the window around it."""
    return np.convolve(mass, np.ones(window))[(window - 1) // 2 :][: len(mass)]


def threshold(mass: np.ndarray) -> float:
    ordered = np.sort(mass[mass > 0])[::-1]
    middle = ordered[int(np.searchsorted(np.cumsum(ordered), ordered.sum() / 2))]
    return min(MOST, SHARE * float(middle))


def stretches(mass: np.ndarray) -> list[tuple[int, int]]:
    """(surge, dive): lines between the points where the windows' sums reach the page's threshold and fall below it.

    A negative mass marks a line that weighs nothing: text dives there, and windows look over it."""
    if not (mass > 0).any():
        return []
    weighs = np.flatnonzero(mass >= 0)
    above = np.zeros(len(mass) + 2, np.int8)
    above[weighs + 1] = window_sums(mass[weighs]) >= threshold(mass)
    turns = np.flatnonzero(np.diff(above))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def _held(lines: Lines, mass: np.ndarray) -> np.ndarray:
    """Mass inside each element."""
    held = np.zeros(len(lines.parent))
    np.add.at(held, lines.element, mass)
    for k in range(len(held) - 1, 0, -1):
        held[lines.parent[k]] += held[k]
    return held


def _inside(lines: Lines, element: int) -> np.ndarray:
    """Whether each line lies in the element."""
    own = [False] * len(lines.parent)
    for k in range(len(own)):
        own[k] = k == element or (k > 0 and own[lines.parent[k]])
    return np.array(own)[lines.element]


def weighed(lines: Lines, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line whether it weighs nothing, and whether only because of a header."""
    large = (held := _held(lines, plain)) >= LARGE * held[0]
    title = list(lines.title)  # whether the element has the page's title or article, not under another name
    for k in range(len(title) - 1, 0, -1):
        if title[k] and lines.says[k] == NOTHING:
            title[lines.parent[k]] = True
    light, header = [False] * len(title), [False] * len(title)
    for k in range(1, len(title)):
        says, up = lines.says[k], lines.parent[k]
        doubted = large[k] and (title[k] or (says != INSERTION and not title[0]))
        own = says == CERTAIN or (says != NOTHING and not doubted)
        light[k] = light[up] or own
        header[k] = (header[up] and not own) or (own and says == HEADER and not light[up])
    element = np.array(lines.element)
    return np.array(light)[element], np.array(header)[element]


def main_text(source: str) -> str:
    """Blocks of the article joined by an empty line; empty if the page has none."""
    lines = lines_of(source)
    if not lines.text:
        return ""
    size, links = np.array([len(x) for x in lines.text]), np.array(lines.links)
    plain = np.maximum(0, size - 2 * links).astype(float)
    light, header = weighed(lines, plain)
    rights = [c < 200 and OWN_RIGHTS.search(x) is not None and not _article_of(lines, e) for x, c, e in zip(lines.text, size.tolist(), lines.element, strict=True)]
    mass = np.where(light | np.array(rights), -1, plain)
    span = _span(lines, mass, header, stretches(mass))
    return "\n\n".join(lines.text[k] for k in _stays(lines, plain, size, links, np.flatnonzero(span).tolist()))


def _span(lines: Lines, mass: np.ndarray, header: np.ndarray, found: list[tuple[int, int]]) -> np.ndarray:
    """The lines of the article by surges and dives."""
    span = np.zeros(len(mass), bool)
    if not found:
        return span
    weighs, least = mass >= 0, threshold(mass)
    for s, t in found:
        span[s:t] = True
    found = _over_light(found, weighs)
    total = [float(np.maximum(mass[a:b], 0).sum()) for a, b in found]
    best = int(np.argmax(total))
    a, b = found[best]
    own = np.zeros(len(mass))
    own[a:b] = np.maximum(mass[a:b], 0)
    held = _held(lines, own)
    home = int(np.flatnonzero((held >= CONTAINER * held[0]) & np.array(lines.container))[-1])
    inside = _inside(lines, home)
    kept = []
    for (s, t), own_mass in zip(found, total, strict=True):
        if s == a or inside[s:t].any() or own_mass >= OTHER * total[best]:
            kept.append((s, t))
        else:
            span[s:t] = False
    between = np.zeros(len(mass), bool)  # of one container, also what lies between surges and dives
    mine = [s for s in kept if inside[s[0] : s[1]].any()]
    between[mine[0][0] : mine[-1][1]] = True
    span |= between & inside & weighs
    for s, t in kept:  # windows reach over the edges of the text
        peak = lines.element[s + int(np.argmax(mass[s:t]))]
        article = _article_of(lines, peak)
        while t > s and mass[t - 1] < least and not inside[t - 1] and not (weighs[t - 1] and lines.text[t - 1].endswith(ENDS)) and (weighs[t - 1] or not span[t - 1]):
            t -= 1
            span[t] = False
        while s < t and mass[s] < least and not inside[s] and (not span[s] or (weighs[s] and _article_of(lines, lines.element[s]) != article)):
            span[s] = False
            s += 1
    near = np.array([_container_of(lines, e) for e in lines.element])
    if lines.article[home]:
        span |= inside & weighs
    elif home and not lines.top[home]:  # its own lines, and a header of it
        span |= ((near == home) & weighs) | (header & inside)
    else:
        last = len(span) - int(np.argmax(span[::-1]))
        while last < len(span) and weighs[last] and near[last] == home and lines.text[last].endswith(ENDS):
            span[last] = True
            last += 1
    first = int(np.argmax(span))
    while first and lines.heading[first - 1] and mass[first - 1] > 0:
        first -= 1
        span[first] = True
    return span


def _over_light(found: list[tuple[int, int]], weighs: np.ndarray) -> list[tuple[int, int]]:
    """Stretches between which only lines stand that weigh nothing are one."""
    joined: list[tuple[int, int]] = []
    for s, t in found:
        if joined and not weighs[joined[-1][1] : s].any():
            joined[-1] = (joined[-1][0], t)
        else:
            joined.append((s, t))
    return joined


def _container_of(lines: Lines, element: int) -> int:
    while not lines.container[element]:
        element = lines.parent[element]
    return element


def _article_of(lines: Lines, element: int) -> int:
    while element and not lines.article[element]:
        element = lines.parent[element]
    return element


def _stays(lines: Lines, mass: np.ndarray, size: np.ndarray, links: np.ndarray, span: list[int]) -> Iterator[int]:
    """Lines with text of their own, and those of links that are headings or stand alone behind such a line: before another,
    before a list, or as the last sentence."""
    linked = ((2 * links >= size) & (links > 0)).tolist()
    for k, before, after in zip(span, [None, *span], [*span[1:], None], strict=False):
        if not linked[k]:
            if mass[k] > 0:
                yield k
        elif lines.heading[k]:
            yield k
        elif before is not None and not linked[before] and not lines.listed[k]:
            if lines.text[k].endswith(ENDS) if after is None else lines.listed[after] or not linked[after]:
                yield k


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per input row: key, url, text, n_chars (code points of text). Null html counts as empty: empty text.

    Null and repeated keys pass through; other columns are not read. Narrow: no shuffle, one Arrow batch in memory."""
    schema = StructType([pages.schema[key], pages.schema[url]]).add("text", "string").add("n_chars", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s or "") for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return pages.select(key, url, F.col(source).cast("string")).mapInArrow(extract, schema)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
