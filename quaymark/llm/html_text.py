"""Main text of HTML pages from parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser streams events; block-level tags cut a page into lines. Each line has a ratio of
its text to the tags in it. The ratios are smoothed with a Gaussian, and lines whose smoothed ratio exceeds the
page's standard deviation form the content clusters. The clusters vote, by their characters, for the region the
article lies in: an ``article`` or ``main`` element where the page has one, otherwise the smallest element that
holds them all. Every line of that region counts, short ones too, except those inside menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, known by tag, role, class or id.

A class or id marks an element by its last word, layout words apart (``site-header``, ``ad-slot``; not
``share-prices``), and states (``has-sidebar``) mark nothing. Articles beside the largest one, in the same element, belong
to the page's text. Left-out elements inside a line (buttons, drawings, films) leave the line around them whole.

Defined results: a null or empty page, or one without such text, gives an empty string; where only class or id words
other than comments stand against all text of a page, they yield; a tag that is never closed ends with its
surroundings; an unclosed tail is read as far as it goes; repeated rows give repeated rows; an empty table gives no
rows; other columns are ignored. Work is linear in the page, however deep it nests.
"""

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names and the words that mark what is no article.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript
    ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    """aside audio button canvas datalist dialog footer form head iframe label map menu nav noscript object script search
    select style svg template textarea title video""".split()
)
#: These may stand inside a line; the line goes on after them.
WITHIN = NEVER - BLOCKS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(("article", "main"))
ROLES = frozenset(
    """alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar""".split()
)
MARKS = frozenset(
    """ad ads adbox adslot adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments
    commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter
    notice notices pagination pager paywall popup promo promoted promotion recommended related respond share sharing
    sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split()
)
#: Around these, an ``article`` element is a reader's or another page's text.
OTHERS = frozenset("comment comments commentlist respond disqus related recommended".split())
#: Behind a mark, these name a place or a form of it; anywhere in a name, states tell what lies elsewhere.
PLACES = frozenset(
    """area bar block bottom box button buttons form inner item items left link links list middle outer panel posts
    right section slot top unit wrap wrapper""".split()
)
STATES = frozenset("has hide is no not show with without".split())
_MARK_CUT = re.compile(r"[^a-z]+")
#: How firmly an element is left out: not at all, by class or id words, by its tag, role or the comments it holds.
KEPT, MARKED, FIRM = range(3)

SIGMA = 1.5
_REACH = 4
_KERNEL = np.exp(-0.5 * (np.arange(-_REACH, _REACH + 1) / SIGMA) ** 2)
#: Outside regions, a line whose text lies in links by more than this share is a menu.
LINK_SHARE = 0.6


def marks(value: str) -> set[str]:
    """The marks that a class or id attribute carries."""
    found = set()
    for name in value.lower().split():
        words = [w for w in _MARK_CUT.split(name) if w]
        if not STATES.isdisjoint(words):
            continue
        while len(words) > 1 and words[-1] in PLACES:
            words.pop()
        if words and words[-1] in MARKS:
            found.add(words[-1])
    return found


class _Lines(HTMLParser):
    """Cuts the events of one page into lines: words, element, how left out, region, tags, share of links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # name, element number, how left out, region number, whether even an article inside stays out
        self.open: list[tuple[str, int, int, int, bool]] = []
        self.places: dict[str, list[int]] = {}  # where each name stands among the open elements
        self.silent: int | None = None  # where a left-out element inside a line stands
        self.parents = [-1]
        self.around = [0]  # the element that holds each region
        self.lines: list[tuple[str, int, int, int, int, float]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.chars = self.in_link = 0

    def _at(self) -> tuple[str, int, int, int, bool]:
        return self.open[-1] if self.open else ("", 0, KEPT, 0, False)

    def _push(self, name: str, number: int, out: int, region: int, firm: bool) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, number, out, region, firm))

    def _cut(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                _, number, out, region, _ = self._at()
                self.lines.append((words, number, out, region, self.tags, self.linked / max(1, self.chars)))
                self.tags = 0
            self.text, self.linked, self.chars = [], 0, 0

    def _unwanted(self, name: str, attrs: list[tuple[str, str | None]], region: int) -> tuple[int, bool]:
        """How firmly an element is left out, and whether an article inside it is too."""
        if name in NEVER:
            return FIRM, True
        out, firm = (FIRM if name == "header" else KEPT), False
        for key, value in attrs:
            if not value:
                out = FIRM if key == "hidden" else out
            elif key == "role" and value.lower() in ROLES:
                out = FIRM
            elif (key == "class" or key == "id" and name not in HEADINGS) and name != "body":
                found = marks(value)
                if region:
                    found.discard("header")  # the article's own
                if not OTHERS.isdisjoint(found):
                    return FIRM, True
                out = max(out, MARKED if found else KEPT)
        return out, firm

    def handle_starttag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        if name in VOID:
            self.tags += 1
            if self.silent is None:
                if name == "hr":
                    self._cut()
                elif name == "br":
                    self.text.append(" ")
            return
        structural = name in BLOCKS or name in NEVER
        _, number, out, region, firm = self._at()
        if self.silent is not None:
            if structural:
                self._push(name, number, out, region, firm)
            return
        if name in BLOCKS:
            self._cut()
        self.tags += 1
        if name == "a":
            self.in_link += 1
        if not structural or name in ("p", "li", "dd", "dt", "tr", "td", "th", "option") and not attrs:
            return
        unwanted, holds = self._unwanted(name, attrs, region)
        if name in REGIONS and not unwanted and not region:
            self.around.append(number)
            region = len(self.around) - 1
            out = FIRM if firm else KEPT  # an advert left open doesn't swallow the article
        if name in HEADINGS and region and out and self.open[-1][0] == "header" and not unwanted:
            out = KEPT  # the article's own title
        if name in WITHIN:
            self.silent = len(self.open)
        else:
            self.parents.append(number)
            number = len(self.parents) - 1
        self._push(name, number, max(out, unwanted), region, firm or holds)

    def handle_startendtag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(name, attrs)
        if name not in VOID:
            self.handle_endtag(name)

    def handle_endtag(self, name: str) -> None:
        places = self.places.get(name)
        at = places[-1] if places else -1
        fence = max((p[-1] for p in (self.places.get(r) for r in REGIONS) if p), default=-1)
        if at < fence and name not in ("body", "html"):
            at = -1  # a stray end tag inside an article closes nothing around it
        if self.silent is not None and at < 0:
            return
        if self.silent is not None and at <= self.silent:
            self._close(self.silent)
            self.silent = None
            if name in WITHIN and at == len(self.open):
                self.tags += 1
                return
        if self.silent is not None:
            self._close(at)
            return
        if name in BLOCKS:
            self._cut()
        self.tags += 1
        if name == "a":
            self.in_link = max(0, self.in_link - 1)
        if at >= 0:
            self._close(at)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop()[0]].pop()

    def handle_data(self, data: str) -> None:
        if self.silent is not None:
            return
        self.text.append(data)
        self.chars += len(data)
        if self.in_link:
            self.linked += len(data)

    def finish(self) -> None:
        self.close()
        if self.silent is not None:
            self._close(self.silent)
        self._cut()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing; at the ends only lines that exist weigh in."""
    weight = np.convolve(np.ones(len(ratios)), _KERNEL)[_REACH : _REACH + len(ratios)]
    return np.convolve(ratios, _KERNEL)[_REACH : _REACH + len(ratios)] / weight


def _last_inside(parents: list[int]) -> list[int]:
    """The last element inside each one; elements are numbered in page order, so what lies inside is one stretch."""
    last = list(range(len(parents)))
    for number in range(len(parents) - 1, 0, -1):
        last[parents[number]] = max(last[parents[number]], last[number])
    return last


def main_text(html: str | None) -> str:
    """The article of one page, blocks joined by empty lines."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.finish()
    lines = page.lines
    if not lines:
        return ""
    ratios = np.array([len(line[0]) / max(1, line[4]) for line in lines])
    smooth = smoothed(ratios)
    content = smooth >= min(smooth.std(), smooth.max())
    for limit in (KEPT, MARKED):
        allowed = [line[2] <= limit for line in lines]
        wanted = [ok and (line[3] > 0 or line[5] <= LINK_SHARE) for ok, line in zip(allowed, lines)]
        if any(wanted):
            break
    else:
        return ""
    votes: dict[int, int] = {}
    for line, dense, keep in zip(lines, content, wanted):
        if keep and line[3]:
            votes[line[3]] = votes.get(line[3], 0) + (len(line[0]) if dense else 0)
    if votes:
        most = max(votes, key=votes.get)
        beside = page.around[most]
        chosen = {r for r, n in votes.items() if n >= votes[most] / 2 or page.around[r] == beside}
        return "\n\n".join(line[0] for line, keep in zip(lines, wanted) if keep and line[3] in chosen)
    voters = [line[1] for line, dense, keep in zip(lines, content, wanted) if keep and dense]
    voters = voters or [line[1] for line, keep in zip(lines, wanted) if keep]
    last = _last_inside(page.parents)
    root, end = min(voters), max(voters)
    while last[root] < end:
        root = page.parents[root]
    return "\n\n".join(line[0] for line, ok in zip(lines, allowed) if ok and root <= line[1] <= last[root])


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    kinds = dict(pages.dtypes)
    form = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_extract, form)
