"""Main text of web pages, from parser events, text-to-tag ratios and clusters of smoothed lines.

The standard library's parser sends events while it reads; every block-level tag starts a new line, and each line has
its text, the number of inline tags met in it, and whether it stands in a part of the page that is never content: menus,
headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader comments, told by tag,
role, or the words of class and id. A form or a word of class or id only condemns a part that is no wrapper: judged after
a first clustering, parts that hold the main element, the only article or most of the content lines' text stay. Beside an
article with text outside all such parts, the parts condemned by class or id go at once, but for those around main. The ratio of text length to tags per line is smoothed with a Gaussian; a threshold
from the two clusters of the smoothed ratios marks content lines. The content regions are the article and main elements,
if one has content lines; else the innermost element that holds nine tenths of the content lines' text, and beside it, in
each part of the page that holds further content lines, the innermost element that holds all of those. Such an element is
left out as boilerplate if lines over the threshold, smoothed or not, have less than half of its text; its content lines
that are over it on their own, not by their neighbours, stay. All lines of the regions count, however short, except those
in parts that are never content and, where no article or main element tells the content, blocks of links: lines under the
threshold with no letter outside links, unless one stands alone between other lines. Pages of few lines go the same way.

Null html is the empty page. Character references are decoded, white space inside a block becomes one space, blocks are
joined by one space in page order. A page takes time in proportion to its length, however deep its tags nest. Repeated
rows and null ids are extracted like any other row. Unclosed tags end where the standard says that a block, a list item or a table cell
implies their end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Width of the smoothing in lines, turns of the two-means threshold, distance of cluster means (in logarithms) under which
# all lines are of one kind, and the share of the content lines' text that the main region must hold.
SIGMA, TURNS, ONE_KIND, MOST = 1.0, 12, float(np.log(2)), 0.9

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
_NEVER = frozenset(
    "annotation annotation-xml applet aside audio button canvas datalist dialog footer head iframe input label menu nav noframes "
    "noscript object option script search select style svg template textarea title video".split()
)
_FORMS = frozenset("fieldset form".split())
_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split()
)
# Words of class and id that mark parts which are no content, whatever their tag.
_BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments "
    "commentlist consent cookie cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices notification outbrain pager pagination popup promo promoted promotion related reply "
    "respond respondents share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe "
    "subscription taboola tags teaser toc toolbar topbar widget widgets".split()
)
# Words that say that a header or the like belongs to the article, and words that no such word excuses.
_CONTENT = frozenset("article body content entry post story text".split())
_NEVER_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies footer menu nav navbar "
    "navigation newsletter pagination popup promo related share sidebar sponsored subscribe".split()
)
# Words that never excuse a part while there is other text, because readers may write more than the author.
_COMMENT_WORDS = frozenset("comment comments commentlist disqus reply respond respondents shoutbox".split())
# Names of class and id that tell the layout: what a part has or lacks, its side, the frame of a widget.
_LAYOUT_FIRST, _SIDES = frozenset("has no with without".split()), frozenset("both left right".split())
_LAYOUT_LAST = frozenset("closed disabled enabled open".split())
_FRAMES = frozenset("container elementor wrap wrapper".split())
# What an element is: content, a part to be judged by its text (a form, one named by its class or id, one of readers), or
# never content.
_OPEN, _JUDGED, _NAMED, _READERS, _CLOSED = range(5)
# A start tag on the left ends an open element on the right.
_IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_ENDS_P = _BLOCKS - {"br", "body", "html", "head", "title", "caption", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SCOPES = frozenset("table td th button object template".split())
# What an implied end doesn't reach through, and the elements that are regions.
_STOPS = frozenset("ul ol dl table select".split()) | _SCOPES
_REGIONS = frozenset("article main section div td body".split()) & _BLOCKS


def _named(value: str) -> int:
    """What the words of a class or an id say."""
    names = [re.findall(r"[a-z]+", name) for name in value.split()]
    words = {word for name in names for word in name}
    told = set()
    for name in names:
        layout = name and (name[0] in _LAYOUT_FIRST or name[-1] in _LAYOUT_LAST or name[0] in _SIDES and words & _CONTENT)
        told.update(() if layout else set(name) - {"widget", "widgets"} if _FRAMES & set(name) else name)
    if told & _BOILERPLATE and not (words & _CONTENT and not told & _NEVER_WORDS):
        return _READERS if told & _COMMENT_WORDS else _NAMED
    return _OPEN


def _marked(tag: str, attributes: list[tuple[str, str | None]], in_article: bool) -> int:
    """Whether an element is content, to be judged, or never content."""
    if tag in _NEVER or tag == "header" and not in_article:
        return _CLOSED
    mark = _JUDGED if tag in _FORMS else _OPEN
    for name, value in attributes:
        value = (value or "").lower()
        if name in ("hidden", "inert") or name == "aria-hidden" and value == "true" or name == "aria-modal" and value == "true":
            return _CLOSED
        if name == "role" and value in _ROLES:
            return _CLOSED
        if name == "role" and value == "form":
            mark = max(mark, _JUDGED)
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _CLOSED
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            mark = max(mark, _named(value))
    return mark


class _Line(NamedTuple):
    text: str
    tags: int
    linked: bool  # all letters and digits stand in links
    never: bool
    region: int
    part: int  # 0 is no part to be judged


class _Lines(HTMLParser):
    """The lines of a page in order, and the tree of its regions and parts.

    The open elements are a stack; beside it stands, for each tag and for all blocks, where its open elements lie. So an
    end tag, an implied end or an open article is found without a walk over the stack, and a page of many unclosed tags
    takes time in proportion to its length. Regions and parts are numbered as they begin, so parents have lesser numbers.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[tuple[str, bool, int, int]] = []  # tag ("" once a misnested end tag has ended it), never, region, part
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.parts: list[str] = []
        self.tags, self.outside_links = 0, False
        self.region_around, self.part_around, self.part_region = [-1], [-1], [0]
        self.part_of_article: dict[int, int] = {}
        self.readers: set[int] = set()
        self.named: set[int] = set()
        self.parts_with_main: set[int] = set()

    def _state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def _kind(self, index: int = -1) -> tuple[bool, int]:
        """Never content, and part, at an open element."""
        return (self.open[index][1], self.open[index][3]) if self.open and index >= -1 else (False, 0)

    def _last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places[tag] else -1

    def _push(self, tag: str, never: bool, region: int, part: int) -> None:
        self.places[tag].append(len(self.open))
        if tag in _BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, never, region, part))

    def _cut(self, index: int) -> None:
        """End all elements from ``index`` on, and those below that a misnested end tag had ended before."""
        while len(self.open) > index or self.open and not self.open[-1][0]:
            tag = self.open.pop()[0]
            if tag:
                self.places[tag].pop()
            if tag in _BLOCKS:
                self.blocks.pop()

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(_Line(text, self.tags, not self.outside_links, *self._line_state))
        self.parts, self.tags, self.outside_links = [], 0, False

    def _close(self, index: int) -> None:
        self._end_line()
        self._cut(index)

    def _imply_ends(self, tag: str) -> None:
        ended = set(_IMPLIED_END.get(tag, ()))
        while ended:
            name = max(ended, key=self._last)
            if self._last(name) <= max(self._last(x) for x in _STOPS if x not in ended):
                break
            self._close(self._last(name))
            ended.remove(name)
        if tag in _ENDS_P and self._last("p") > max(map(self._last, _SCOPES)):
            self._close(self._last("p"))

    def handle_starttag(self, tag, attributes):
        if tag in ("html", "body") and self.places[tag]:
            return
        if self.places["head"] and (tag == "body" or tag in _BLOCKS and tag not in ("head", "title", "html")):
            self._close(self.places["head"][0])  # content begins: an unclosed head ends here
        if tag in _BLOCKS:
            self._imply_ends(tag)
            self._end_line()
        else:
            self.tags += 1
        if tag in _VOID:
            return
        never, region, part = self._state()
        mark = _marked(tag, attributes, bool(self.places["article"] or self.places["main"]))
        never = never or mark == _CLOSED
        if not never and mark != _OPEN:
            self.part_around.append(part)
            self.part_region.append(region)
            part = len(self.part_around) - 1
            if mark == _READERS:
                self.readers.add(part)
            if mark != _JUDGED:
                self.named.add(part)
        if tag in _REGIONS:
            self.region_around.append(region)
            region = len(self.region_around) - 1
            if tag in ("article", "main") and not never:
                self.part_of_article[region] = part
                around = part
                while tag == "main" and around > 0 and around not in self.parts_with_main:
                    self.parts_with_main.add(around)
                    around = self.part_around[around]
        self._push(tag, never, region, part)

    def handle_startendtag(self, tag, attributes):
        if tag in _BLOCKS:
            self._end_line()
        else:
            self.tags += 1

    def handle_endtag(self, tag):
        if tag == "br":
            self._end_line()
            return
        index = self._last(tag)
        if index < 0:
            if tag == "p":
                self._end_line()
            return
        if tag in ("p", "li", "div") and max(self._last("td"), self._last("th")) > index:
            return
        if tag in _BLOCKS:
            self._close(index)
            return
        self.tags += 1
        if self.blocks and self.blocks[-1] > index:  # a misnested inline tag ends alone
            self.open[index] = ("", *self.open[index][1:])
            self.places[tag].pop()
            return
        below = index - 1
        while below >= 0 and not self.open[below][0]:
            below -= 1
        if self._kind() != (self._kind(below) if below >= 0 else (False, 0)):
            self._end_line()
        self._cut(index)

    def handle_data(self, data):
        if self.open and self._kind() != self._kind_of_line():
            self._end_line()
        self._line_state = self._state()
        self.parts.append(data)
        if not self.places["a"] and any(map(str.isalnum, data)):
            self.outside_links = True

    # Of the text so far: an element that ends or begins a line within it may be of another kind.
    _line_state = (False, 0, 0)

    def _kind_of_line(self) -> tuple[bool, int]:
        return self._line_state[::2] if self.parts else self._kind()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends are mirrored."""
    reach = int(3 * sigma)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="symmetric"), weights / weights.sum(), mode="valid")


def clusters(values: np.ndarray) -> tuple[float, float]:
    """Half way between the means of the two clusters of the logarithms, and how far these means lie apart."""
    logs = np.log1p(values)
    cut, apart = logs.mean(), 0.0
    for _ in range(TURNS):
        low, high = logs[logs <= cut], logs[logs > cut]
        if not len(low) or not len(high):
            break
        cut, before, apart = (low.mean() + high.mean()) / 2, cut, float(high.mean() - low.mean())
        if abs(cut - before) < 1e-9:
            break
    return float(np.expm1(cut)), apart


def threshold(values: np.ndarray) -> float:
    return clusters(values)[0]


def _content_lines(lines: list[_Line]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines the clustering marks as content, and which are over the threshold without their neighbours.

    Where the two clusters of the lines' own ratios lie no factor of two apart, all lines are of one kind, content.
    Neighbours don't make content of a line of links.
    """
    raw = np.array([len(x.text) / max(1, x.tags) for x in lines])
    if clusters(raw)[1] < ONE_KIND:
        return np.ones(len(lines), bool), np.ones(len(lines), bool)
    ratios = smoothed(raw)
    cut = threshold(ratios)
    alone = raw >= cut
    return (ratios >= cut) & (alone | ~np.array([x.linked for x in lines])), alone


def _gathered(own: list[int], around: list[int]) -> list[int]:
    """Sums over each element with all that it holds."""
    sums = own[:]
    for x in range(len(around) - 1, 0, -1):
        sums[around[x]] += sums[x]
    return sums


def _held(chosen: set[int], around: list[int]) -> list[bool]:
    """Whether each element is, or lies in, a chosen one."""
    held: list[bool] = []
    for x, outer in enumerate(around):
        held.append(x in chosen or outer >= 0 and held[outer])
    return held


def _without_named(parser: _Lines, lines: list[_Line]) -> list[_Line]:
    """Beside an article with any text outside all parts, parts condemned by class or id go, but for those around main."""
    plain = _held({r for r, part in parser.part_of_article.items() if not part}, parser.region_around)
    if not any(plain[x.region] and not x.part for x in lines):
        return lines
    gone = _held(parser.named - parser.parts_with_main, parser.part_around)
    return [x for x in lines if not gone[x.part]]


def _staying_parts(parser: _Lines, lines: list[_Line]) -> list[bool]:
    """For each part to be judged, whether it stays with all parts around it.

    A part around the main element stays. Beside an article with content outside all parts no part stays; else, and
    within such an article, a part stays that holds most of the content, or an article and more than stands outside all
    parts. Readers' parts stay only if all other lines are links.
    """
    around = parser.part_around
    by_readers = _held(parser.readers, around)
    own, plain_text, written = [0] * len(around), [0] * len(parser.region_around), 0
    for line, good in zip(lines, _content_lines(lines)[0]):
        written += not by_readers[line.part] and not line.linked
        if good:
            own[line.part] += len(line.text)
            if not line.part:
                plain_text[line.region] += len(line.text)
    free, total = own[0], sum(own)
    weight, plain_text = _gathered(own, around), _gathered(plain_text, parser.region_around)
    told = {r for r, part in parser.part_of_article.items() if not part and plain_text[r]}
    in_told = _held(told, parser.region_around)
    articles = [0] * len(around)
    for part in parser.part_of_article.values():
        articles[part] += 1
    articles = _gathered(articles, around)
    stays = [True]
    for part in range(1, len(around)):
        stay = part in parser.parts_with_main
        if weight[part] and not (told and not in_told[parser.part_region[part]] or part in parser.readers and written):
            stay = stay or 2 * weight[part] > total or articles[part] > 0 and weight[part] > free
        stays.append(stay and stays[around[part]])
    return stays


def _link_blocks(lines: list[_Line], content: np.ndarray) -> np.ndarray:
    """Lines below the threshold that are links only, unless one stands alone between other lines."""
    idle = np.array([x.linked for x in lines]) & ~content
    before, behind = np.r_[True, idle[:-1]], np.r_[idle[1:], True]
    return idle & (before | behind)


def main_text(html: str | None) -> str:
    """The text of a page's content region."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._end_line()
    lines = _without_named(parser, [x for x in parser.lines if not x.never])
    if any(x.part for x in lines):
        stays = _staying_parts(parser, lines)
        lines = [x for x in lines if stays[x.part]]
    if not lines:
        return ""
    content, alone = _content_lines(lines)
    # Text of content lines per region, counted in every region around it.
    around = parser.region_around
    own = [0] * len(around)
    for line, good in zip(lines, content):
        own[line.region] += len(line.text) if good else 0
    weight = _gathered(own, around)
    articles = set(parser.part_of_article)
    if any(weight[r] for r in articles):
        held = _held(articles, around)
        return " ".join(x.text for x in lines if held[x.region])
    depth = [0]
    for outer in around[1:]:
        depth.append(depth[outer] + 1)
    main = max((r for r in range(len(around)) if weight[r] >= MOST * weight[0]), key=lambda r: (depth[r], weight[r]))
    held = _held({main} | _further_regions(lines, content, alone, main, around, weight), around)
    taken = (content & alone) | np.array([held[x.region] for x in lines]) & ~_link_blocks(lines, content)
    return " ".join(x.text for x, take in zip(lines, taken) if take)


def _further_regions(
    lines: list[_Line], content: np.ndarray, alone: np.ndarray, main: int, around: list[int], weight: list[int],
) -> set[int]:
    """Beside the main region, the innermost element with all content lines of each branch of the page that has some."""
    spine, region = set(), main
    while region >= 0:
        spine.add(region)
        region = around[region]
    all_text, dense = [0] * len(around), [0] * len(around)
    for line, good, own in zip(lines, content, alone):
        all_text[line.region] += len(line.text)
        dense[line.region] += len(line.text) if good or own else 0
    all_text, dense = _gathered(all_text, around), _gathered(dense, around)
    # Parents have lesser numbers: from each branch's top down to the last region that still has the whole weight.
    top, inner = {}, {}
    for region in range(1, len(around)):
        if region in spine or not weight[region]:
            continue
        top[region] = top.get(around[region], region)
        if weight[region] == weight[top[region]]:
            inner[top[region]] = region
    return {r for r in inner.values() if 2 * dense[r] >= all_text[r]}


def _extract_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    taken = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return taken.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
