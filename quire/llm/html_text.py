"""Main text of HTML pages: text-to-tag ratios of streamed lines, smoothed and clustered.

The standard library's parser streams a page's events. Every block becomes a line with its number of
characters and of tags. The ratios are smoothed with a Gaussian and split by a threshold between two
clusters; the lines above it vote for the region that holds the content. All blocks of that region are
kept, short ones too, but for the parts whose tag, class or role says that they are no content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from math import exp, log1p

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_rows, prepare

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section "
    "select summary table tbody tfoot thead title tr ul caption".split()
)
CONTAINERS = frozenset("article main section div td body html".split())
SPACES = frozenset("br td th wbr".split())
UNSEEN = frozenset("head script style noscript template iframe object svg math canvas audio video map".split())
CONTROLS = frozenset("nav footer aside form button select textarea fieldset menu dialog datalist label input".split())
CLOSES_P = BLOCKS - {"li", "dd", "dt", "body", "html", "head", "option", "tr", "tbody", "thead", "tfoot", "caption"}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Names of parts without content, as they stand in class or id, and of reader comments.
PARTS = (
    "nav navbar navigation menu topbar header masthead footer sidebar aside ad ads adv advert adverts advertisement "
    "advertising banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager widget toolbar search skip"
).split()
COMMENTS = "comment comments commentlist respond replies disqus".split()
#: What may stand before and after such a name without changing what it says.
BEFORE = "site main page top bottom left right global primary secondary side sub".split()
AFTER = (
    "bar box container wrapper wrap area list links link menu block inner outer widget section panel row slot unit form "
    "banner notice header footer content thread item button buttons icons posts articles stories nav"
).split()
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may stand in a head; any other one ends it.
HEAD = frozenset("html head title meta link style script base noscript template".split())

#: Width of the Gaussian in lines; share of the content a region has to hold.
SIGMA = 1.0
REGION_SHARE = 0.75
#: Dense characters from which a part that holds nearly all of a page's is taken for its content.
DENSE = 200

_KERNEL = [exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(4)]
_CAMEL = re.compile("([a-z0-9])([A-Z])")


def _named(names: list[str]) -> re.Pattern:
    first, name, after = map("|".join, (BEFORE, names, [*PARTS, *BEFORE, *AFTER]))
    return re.compile(f"(?:(?:{first})-)*(?:{name})(?:-(?:{after}))*(?:-?[0-9]+)?")


_PART, _COMMENT = _named(PARTS), _named(COMMENTS)


@lru_cache(maxsize=10_000)
def part_kind(name: str) -> str:
    """What a whole class or id says: "part", "comment" or nothing. Words inside a name say nothing."""
    plain = _CAMEL.sub(r"\1-\2", name).lower().replace("_", "-").strip("-")
    return "comment" if _COMMENT.fullmatch(plain) else "part" if _PART.fullmatch(plain) else ""


def _slug(text: str) -> str:
    return re.sub(r"[^\w]+", "-", text.lower()).strip("-")


SOFT, HARD = 1, 2


class _Lines(HTMLParser):
    """A page's elements, each after its parent, and its lines: texts with the element they stand in, and tags.

    Elements are numbers; what holds for one is decided when it opens and is never looked for again.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.drop, self.main, self.id = [""], [0], [0], [False], [""]
        self.at = 0
        self.open: dict[str, int] = {}
        self.chunks: list[tuple[int, str]] = []
        self.tags = 0
        self.lines: list[tuple[list[tuple[int, str]], int]] = []
        self.within_main = 0

    def flush(self) -> None:
        if any(not text.isspace() for _, text in self.chunks):
            self.lines.append((self.chunks, self.tags))
            self.tags = 0
        self.chunks = []

    def push(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        role = (named.get("role") or "").lower()
        main = tag in ("article", "main") or role in ("main", "article")
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "")
        kinds = set(map(part_kind, (named.get("class") or "").split()))
        own = named.get("id") or ""
        by_id = part_kind(own) if own and tag not in HEADINGS else ""  # a heading's id repeats what it says
        drop, id_alone = 0, ""
        if tag in UNSEEN or tag in CONTROLS or role in ROLES or hidden or "comment" in kinds or by_id == "comment":
            drop = HARD
        elif tag in ("html", "body"):
            pass
        elif "part" in kinds or (tag == "header" and not self.within_main):
            drop = SOFT
        elif by_id:
            drop, id_alone = SOFT, own
        self.tag.append(tag)
        self.parent.append(self.at)
        self.drop.append(drop)
        self.main.append(main)
        self.id.append(id_alone)
        self.at = len(self.tag) - 1
        self.open[tag] = self.open.get(tag, 0) + 1
        self.within_main += main

    def pop(self, tag: str) -> None:
        """Close the nearest open ``tag`` and what is still open in it."""
        if not self.open.get(tag):
            return
        while True:
            closed, self.at = self.at, self.parent[self.at]
            self.open[self.tag[closed]] -= 1
            self.within_main -= self.main[closed]
            if self.tag[closed] == tag:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag not in HEAD and self.open.get("head"):
            self.pop("head")
        if tag in BLOCKS:
            self.flush()
        elif tag in SPACES:
            self.chunks.append((self.at, " "))
        if tag in CLOSES_P and self.open.get("p"):
            self.pop("p")
        elif tag in ("li", "option", "tr") and self.tag[self.at] == tag:
            self.pop(tag)
        if tag not in VOID:
            self.push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag in SPACES:
            self.chunks.append((self.at, " "))
        if tag not in VOID:
            self.pop(tag)

    def handle_data(self, data: str) -> None:
        self.chunks.append((self.at, data))

    # --- after the last event: everything in one pass down or up the numbers -----------------------

    def down(self, own: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked."""
        out = own[:]
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def up(self, own: list[int]) -> list[int]:
        """Sum of an element's own value and those of all in it."""
        out = own[:]
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def spare(self) -> None:
        """Take back soft marks of ids that repeat the heading below, and around an article or main element."""
        for chunks, _ in self.lines:
            at = chunks[0][0]
            for _ in range(4):  # inline elements of a heading
                if self.tag[at] in HEADINGS or not at:
                    break
                at = self.parent[at]
            above = self.parent[at]
            if self.tag[at] in HEADINGS and self.id[above] and _slug("".join(t for _, t in chunks)) == _slug(self.id[above]):
                self.drop[above] = 0
        hard = self.down([d == HARD for d in self.drop])
        mains = self.up([int(m and not h and d == 0) for m, h, d in zip(self.main, hard, self.drop)])
        self.drop = [0 if d == SOFT and n else d for d, n in zip(self.drop, mains)]

    def kept(self, gone: list[bool]) -> list[tuple[int, str, int]]:
        """Lines of what is not gone: element of the first text, words joined, tags."""
        out = []
        for chunks, tags in self.lines:
            line = " ".join("".join(t for e, t in chunks if not gone[e]).split())
            if line:
                out.append((next(e for e, t in chunks if not gone[e] and not t.isspace()), line, tags))
        return out


def smoothed(ratios: list[float]) -> list[float]:
    out = []
    for i in range(len(ratios)):
        near = [(_KERNEL[abs(d)], ratios[i + d]) for d in range(-3, 4) if 0 <= i + d < len(ratios)]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """Half-way between the means of two clusters, found by alternating split and means."""
    cut = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            return min(values)
        after = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(after - cut) < 1e-9:
            break
        cut = after
    return cut


def _dense(lines: list[tuple[int, str, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Element and characters of the lines above the threshold between few and many characters a tag, and of
    those that without their neighbours reach half of it."""
    own = [log1p(len(line) / max(tags, 1)) for _, line, tags in lines]
    ratios = smoothed(own)
    cut = threshold(ratios)
    sizes = [(e, len(line)) for e, line, _ in lines]
    return [x for x, r in zip(sizes, ratios) if r >= cut], [x for x, r in zip(sizes, own) if r >= cut / 2]


def _overruled(page: _Lines) -> list[bool]:
    """Elements that are gone. On a page without an article element, a part that is named as no content
    but holds nearly all dense text is the content after all."""
    hard = page.down([d == HARD for d in page.drop])
    gone = page.down([d > 0 for d in page.drop])
    if any(m and not g for m, g in zip(page.main, gone)):
        return gone
    if not (lines := page.kept(hard)):
        return gone
    own = [0] * len(page.tag)
    for e, n in _dense(lines)[0]:
        own[e] += n
    held = page.up(own)
    for i, d in enumerate(page.drop):
        if d == SOFT and not hard[i] and held[i] >= max(DENSE, REGION_SHARE * held[0]):
            page.drop[i] = 0
    return page.down([d > 0 for d in page.drop])


def _region(page: _Lines, lines: list[tuple[int, str, int]]) -> int:
    """The element that holds the content: the deepest container of most dense text, and what is around it
    as long as that adds little, such as a headline, or mostly prose; an article element may add as much
    as it holds."""
    def within(values: list[tuple[int, int]]) -> list[int]:
        own = [0] * len(page.tag)
        for e, n in values:
            own[e] += n
        return page.up(own)

    dense, fair = _dense(lines)
    held, size, prose = within(dense), within([(e, len(line)) for e, line, _ in lines]), within(fair)
    best = 0
    for i, n in enumerate(held):  # numbers grow with depth along any path
        if n >= REGION_SHARE * held[0] and (page.tag[i] in CONTAINERS or page.main[i]):
            best = i
    while best:
        up = page.parent[best]
        if page.main[best] or not (page.main[up] or page.tag[up] in ("div", "section")):
            break
        little = size[best] >= (0.5 if page.main[up] else REGION_SHARE) * size[up]
        if not little and 2 * (prose[up] - prose[best]) < size[up] - size[best]:
            break
        best = up
    return best


def main_text(html: str) -> str:
    """The page's content blocks in order, joined by two line feeds; empty if there is none."""
    page = _Lines()
    page.feed(html)
    page.close()
    page.flush()
    page.spare()
    lines = page.kept(_overruled(page))
    if not lines:
        return ""
    region = _region(page, lines)
    inside = page.down([i == region for i in range(len(page.tag))])
    return "\n\n".join(line for e, line, _ in lines if inside[e])


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; a null or empty page has an empty text.

    Each page is parsed on its own, whole, whatever its size; columns other than page_id, url and html
    play no part; repeated rows give equal rows. No rows give no rows.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch["html"]]
            yield {
                "page_id": batch["page_id"],
                "url": batch["url"],
                "text": texts,
                "n_chars": list(map(len, texts)),
            }

    prepare(pages.sparkSession)
    used = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    return map_rows(used, rows, "page_id bigint, url string, text string, n_chars bigint")
