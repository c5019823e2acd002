"""Main text by line-block distribution.

Strip. One linear scan of the tags drops comments, scripts, styles, forms and elements that say they are no article (nav, header, footer, aside, or by role, class or id); each
leaves a gap of empty lines, and so do the bounds of article and main. What is left becomes lines, one for each block element.

Distribution. A line's size is the length of its text; text that is only links counts nothing. Inside article and main, links count and sizes weigh `prior` times as much: tags are a weight, no
more. Sizes are summed over windows of `window` lines. A region begins where a window's sum surges above `surge` and ends where it dives to 0, as it does in a gap. The region with the
largest sum is the main one; what surges with at least `share` of its sum stays with it. Other text stays only if it stands in the same block (of an article: in the same article), cut
off by an advert or another dropped element; body itself is such a block only for what stands in it directly. If nothing surges, the region with the largest sum stays.

Cases. A null or empty html gives an empty text. Broken markup: an unclosed element that would be dropped loses only its text up to the next block element; a script or
comment that never ends reaches to the end of the page. Repeated rows get a row each; null ids and urls stay null.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load

#: Elements whose content is no text; up to their end tag, markup inside them is none.
RAW = frozenset("script style noscript template textarea svg iframe select title math object".split())
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
STOP = re.compile("[>\"']")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Parts of class names and ids.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|commentlist|cookies?|consent|copyright|disqus|disclaimer|footer|footnav|header|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|notification|outbrain|overlay|pager|pagination|popup|promos?|promoted|promotion|related|respond|share|sharing|sidebar|signup|site-?header|skip|social|sponsor|sponsored|subscribe|taboola|toolbar|topbar|widgets?)(?:$|[\s_-])",
    re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?", re.I)
KEPT = frozenset(("html", "body", "article", "main"))
SCOPES = frozenset(("article", "main"))
#: Elements that hold lines together.
HOLDERS = frozenset("article body div main section td".split())


def unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").strip()
        if name in ("class", "id"):
            if tag not in KEPT and NAMES.search(value) and not (in_article and tag in ("h1", "h2", "p") and name == "id"):
                return True
            if tag == "article" and re.search(r"(?:^|[\s_-])(?:comments?|related|promo|teaser|ad)(?:$|[\s_-])", value, re.I):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden" and tag not in KEPT or name == "aria-hidden" and value.lower() == "true" and tag not in KEPT or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class Holders:
    """The tree of the elements that hold lines, numbered as they open; 0 is the page."""

    def __init__(self) -> None:
        self.tags, self.up, self.last, self.lines, self.at = [""], [0], [0], [0], 0
        self.opened: Counter[str] = Counter()

    def open(self, tag: str) -> None:
        self.up.append(self.at)
        self.at = len(self.tags)
        self.tags.append(tag)
        self.last.append(self.at)
        self.lines.append(0)
        self.opened[tag] += 1

    def close(self, tag: str) -> None:
        """Closes the innermost of this tag and what stands open inside; nothing if none is open."""
        while self.opened[tag]:
            here = self.tags[self.at]
            self.opened[here] -= 1
            self.last[self.at] = len(self.tags) - 1
            self.at = self.up[self.at]
            if here == tag:
                break

    def home(self, k: int) -> int:
        """The holder, or the one around it if it is a div of one line and so a mere paragraph."""
        return self.up[k] if self.tags[k] == "div" and self.last[k] == k and self.lines[k] == 1 else k

    def around(self, ks: list[int]) -> int:
        """The innermost holder of all of ks."""
        k, most = min(ks), max(ks)
        while self.last[k] < most:
            k = self.up[k]
        return k

    def article(self, k: int) -> int:
        """The outermost article or main around holder k, or k."""
        out = k
        while k:
            out = k if self.tags[k] in SCOPES else out
            k = self.up[k]
        return out


def tags_of(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, lower-case name, whether it closes, attributes) of each tag; comments, declarations and RAW elements are one nameless item each (RAW ones keep their name behind a !).

    One pass from left to right: what a tag, a comment or an element took is not looked at again. A > in a quoted value ends no tag; the first time that such a quote swallows
    the rest of the page, quotes lose that power for good, so that no page is scanned more than twice."""
    out: list[tuple[int, int, str, bool, str]] = []
    low, at, quotes = page.lower() if len(page.lower()) == len(page) else page, 0, True
    last = page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            out.append((at, end, "", False, ""))
            at = end
            continue
        if at > last:
            break
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            out.append((at, end, "", False, ""))
            at = end
            continue
        m = NAME.match(page, at + 1)
        if not m:
            at += 1
            continue
        end, stop = -1, m.end()
        while quotes:
            found = STOP.search(page, stop)
            if not found:
                quotes = False
            elif found[0] == ">":
                end = found.end()
                break
            else:
                behind = page.find(found[0], found.end())
                stop = behind + 1 if behind >= 0 else found.end()  # the last of its kind opens nothing
        if end < 0:
            end = page.find(">", m.end()) + 1
        closes, name = m[0][0] == "/", m[0].lstrip("/").lower()
        attributes = page[m.end() : end - 1]
        if name in RAW and not closes:
            until = low.find("</" + name, end)
            if until < 0:
                end = len(page)
            else:
                until = page.find(">", until) + 1
                end = until or len(page)
            out.append((at, end, "!" + name, False, ""))
        else:
            out.append((at, end, name, closes, attributes))
        at = end
    return out


def closers(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """For each opening tag that is closed, the place of its end tag: elements of one name nest."""
    opened: dict[str, list[int]] = {}
    out = {}
    for k, (_, _, name, closes, _) in enumerate(tags):
        if closes:
            if opened.get(name):
                out[opened[name].pop()] = k
        else:
            opened.setdefault(name, []).append(k)
    return out


def lines_of(page: str, gap: int) -> tuple[list[tuple[str, int, bool, int]], Holders]:
    """(text, characters outside of links, inside an article, holder) of each line, and the holders; gaps are empty lines. An article's bounds are gaps too."""
    tags = tags_of(page)
    closed = closers(tags)
    out: list[tuple[str, int, bool, int]] = []
    holders = Holders()
    held: list[str] = []
    own, links, scope, at, i = 0, 0, 0, 0, 0

    def end(count: int = 0) -> None:
        nonlocal own
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((text, own, scope > 0, holders.at))
            holders.lines[holders.at] += 1
        held.clear()
        own = 0
        out.extend([("", 0, scope > 0, holders.at)] * count)

    def add(text: str) -> None:
        nonlocal own
        if text:
            held.append(text)
            if not links:
                own += len(text.strip())

    while i < len(tags):
        start, behind, tag, closing, attributes = tags[i]
        add(page[at:start])
        at = behind
        i += 1
        if not tag or tag[0] == "!":
            if tag in ("!title", "!textarea", "!select", "!iframe"):
                end(gap if tag != "!title" else 0)
            continue
        if not closing and tag not in VOID and unwanted(tag, attributes, scope > 0):
            if tag in BLOCKS or tag == "button":
                end(gap)
            if i - 1 in closed:
                i = closed[i - 1] + 1
                at = tags[i - 1][1]
            else:  # never closed
                while i < len(tags) and tags[i][2] not in BLOCKS:
                    i += 1
                at = tags[i][0] if i < len(tags) else len(page)
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag == "br":
            held.append(" ")
        elif tag in BLOCKS:
            end(gap * (tag in SCOPES and scope == closing))
            links = 0
            if tag in HOLDERS:
                holders.close(tag) if closing else holders.open(tag)
            if tag in SCOPES:
                scope = max(0, scope - 1) if closing else scope + 1
    add(page[at:])
    end()
    while holders.at:
        holders.close(holders.tags[holders.at])
    holders.last[0] = len(holders.tags) - 1
    return out, holders


def regions(sizes: list[int], window: int, surge: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(first line, line behind the last, sum) of the regions from surge to dive of the sums over `window` lines, and of those that never surge."""
    found, low, at, n = [], [], 0, len(sizes)
    while at < n:
        if not sizes[at]:
            at += 1
            continue
        first, peak, zero, run = at, 0, 0, 0
        while at < n and zero < window:
            zero = zero + 1 if not sizes[at] else 0
            run += sizes[at] - (sizes[at - window] if at - window >= first else 0)
            peak = max(peak, run)
            at += 1
        (found if peak > surge else low).append((first, at - zero, sum(sizes[first : at - zero])))
    return found, low


def rejoined(found: list[tuple[int, int]], low: list[tuple[int, int]], homes: list[int], sizes: list[int], holders: Holders) -> list[tuple[int, int]]:
    """found, and the lines of low that stand in the same block (of an article: anywhere in it) as one of them, cut off by what was dropped between."""
    of = lambda region: [homes[k] for k in range(*region) if sizes[k]]
    blocks = {holders.article(holders.around(of(x))) for x in found}
    flat = {x for x in blocks if holders.tags[x] in ("", "body")}
    deep: list[tuple[int, int]] = []  # of the others, the outermost
    for x in sorted(blocks - flat):
        if not deep or x > deep[-1][1]:
            deep.append((x, holders.last[x]))
    starts = [x for x, _ in deep]
    inside = lambda k: k in flat or ((at := bisect_right(starts, k)) and k <= deep[at - 1][1])
    return found + [(k, k + 1) for x in low for k in range(*x) if inside(homes[k])]


def main_text(page: str | None, window: int = 3, surge: int = 80, prior: int = 4, share: float = 0.1) -> str:
    if not page:
        return ""
    lines, holders = lines_of(page, window)
    homes = [holders.home(k) for *_, k in lines]
    sizes = [prior * len(text) if inside else own for text, own, inside, _ in lines]
    found, low = regions(sizes, window, surge)
    if not found:
        found, low = [max(low, key=lambda r: r[2])] if low else [], []
    top = max((r[2] for r in found), default=0)
    main = [(a, b) for a, b, total in found if total >= share * top]
    rest = [(a, b) for a, b, total in found if total < share * top] + [(a, b) for a, b, _ in low]
    kept = {k for a, b in rejoined(main, rest, homes, sizes, holders) for k in range(a, b)}
    return "\n\n".join(text for k, (text, *_) in enumerate(lines) if k in kept and text)


def extract(pages: DataFrame, window: int = 3, surge: int = 80) -> DataFrame:
    """pages: page_id, url, html -> page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), window, surge) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
