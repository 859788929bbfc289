r"""Main text of web pages by line-block distribution.

Markup is stripped so that each block element gives one line. Lines inside menus, headers and footers of the page,
sidebars, notices, adverts, forms and comment sections have no weight; neither have lines that are mostly links. The
other lines weigh as many characters as they have. The weights are summed over sliding windows of lines that have text;
a surge is a window above the threshold after one that is not, a dive is where the windows are empty again, and the text
between them is kept. The threshold is a share of the median weight, 16 characters at most, however long a line is. Where
the page marks its article (article or main element) lines outside of it have no weight; surges and dives choose the
text there too.

Elements nest as HTML has it, end tags that may be left out (p, li, dt, dd, cells, rows, options) included, and whatever
is hidden ends at the latest with the element that holds it.
A class or the like hides an element by whole tokens ("ad", "site-footer"; not "no-sidebar"), and never html, body, an
article or main element (but for readers' comments marked as articles after the first), or a wrapper of the page.

Cases: null html counts as empty and gives an empty text; null ids and urls, repeated rows and extra columns pass; an
empty table gives an empty result; a page cut off inside a tag, script, style or comment gives the text before it; head
holds no text but its title, so its end tag may be left out; formulas are text, drawings and controls aren't.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate
from statistics import median_low

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_TITLE = r"<title\b[^>]*>(?:(?:[^<]|<(?!/?(?:title|head|body|html|article|main|header|nav|section|div|p|h[1-6]|ul|ol|table|form|meta|link)\b))*+</title\s*>|[^<]*+)"
# what holds no markup: comments, scripts and styles to the end of the page if they are cut off, the others only if they end
_GONE = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(textarea|iframe)\b(?:[^>]*[^>/])?>(?:(?!<\2\b).)*?</\2\s*>|{_TITLE}", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i iframe ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()) | frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split())
# never text, and no line of its own either; a control or a drawing that is left open ends before the next block
_DROP = frozenset("noscript template object svg canvas select textarea button".split())
_CONTROLS = frozenset("svg select textarea button".split())
_ASIDE = frozenset("nav aside form footer header dialog menu".split())
_HINT = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# a class token hides if each of its parts is such a word or tells a place or a shape: "site-footer", not "no-sidebar"
_TALK = r"comments?|discussion|replies|respond"
_WORDS = rf"(?:{_TALK}|ad|ads|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|share|social|sidebar|side|menu|nav[a-z]*|breadcrumbs?|footer|masthead|related|recommended|widget|toolbar|pagination|complementary|contentinfo|search)"
_PLAIN = r"(?:site|page|post|posts|entry|article|articles|main|primary|secondary|global|top|bottom|left|right|header|body|inner|outer|list|item|items|area|bar|box|block|section|wrap|wrapper|container|panel|group|row|col|column|form|field|button|buttons|btn|icon|icons|link|links|text|title|media|slot|unit|overlay|dialog|desktop|mobile|\d+)"
_NAMES = re.compile(rf"(?:^|\s)(?:{_PLAIN}[_-]+)*{_WORDS}(?:[_-]+(?:{_WORDS}|{_PLAIN}))*(?=\s|$)", re.I)
_TALKS = re.compile(rf"(?:^|[\s_-])(?:{_TALK})(?=[\s_-]|$)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_OWN = {n: re.compile(rf"<(/?){n}\b", re.I) for n in _DROP}

# where HTML lets end tags be left out: what the start of an element ends, and what it doesn't reach across
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = _HEADINGS | frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
_BREAKS = _ENDS_P - frozenset("hr optgroup option".split())
_ARTICLES = frozenset(("article", "main"))
_CELLS = _ARTICLES | frozenset(("td", "th", "caption"))
_P = frozenset(("p",))
_P_BOUNDS = _CELLS | frozenset(("button", "object", "table", "template"))
_LISTS = _CELLS | frozenset(("ul", "ol", "menu", "dl", "table"))
_TABLE = _ARTICLES | frozenset(("table",))
_SIBLINGS = {
    "li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), _LISTS), "dd": (frozenset(("dt", "dd")), _LISTS),
    "td": (frozenset(("td", "th", "caption", "colgroup")), _TABLE), "th": (frozenset(("td", "th", "caption", "colgroup")), _TABLE), "tr": (frozenset(("td", "th", "tr", "caption", "colgroup")), _TABLE),
    **{n: (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup")), _TABLE) for n in ("tbody", "thead", "tfoot")},
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
# a marked article ends at its own end tag only, and stray end tags in a cell or a list don't reach out of it
_END_BOUNDS = {
    "p": _P_BOUNDS, "li": _LISTS, "dt": _LISTS, "dd": _LISTS, **{n: _TABLE for n in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption")}, "table": _ARTICLES,
    **{n: frozenset() for n in ("article", "main", "body", "html")},
}
LEAST = 16  # characters


class Mask:
    """Lines [start, end) are hidden: by an element's name, by a class or the like, or as talk of readers."""

    __slots__ = ("end", "how", "start")

    def __init__(self, how: str, start: int):
        self.how, self.start, self.end = how, start, -1


class Open:
    """The elements that are open, and which of them hide or mark what they hold. An element ends at its own end tag,
    where HTML lets its end tag be left out, or with the element that holds it."""

    def __init__(self, out: list) -> None:
        self.out = out
        self.names: list[str] = []
        self.masks: list[Mask | None] = []
        self.marked: list[bool] = []
        self.count: dict[str, int] = {}
        self.all: list[Mask] = []
        self.hidden = self.article = 0

    def start(self, name: str, how: str, marked: bool = False) -> None:
        mask = Mask(how, len(self.out)) if how else None
        if mask:
            self.all.append(mask)
            self.hidden += 1
        self.names.append(name)
        self.masks.append(mask)
        self.marked.append(marked)
        self.count[name] = self.count.get(name, 0) + 1
        self.article += marked

    def cut(self, at: int) -> None:
        while len(self.names) > at:
            self.count[self.names.pop()] -= 1
            mask = self.masks.pop()
            if mask:
                mask.end = len(self.out)
                self.hidden -= 1
            self.article -= self.marked.pop()

    def unmask(self) -> None:
        if self.hidden:
            for mask in filter(None, self.masks):
                mask.end = len(self.out)
            self.masks = [None] * len(self.names)
            self.hidden = 0

    def last(self, names: frozenset[str], bounds: frozenset[str]) -> int:
        """Place of the innermost open element of these names that no bound parts from here, or -1."""
        if any(self.count.get(n) for n in names):
            for at in range(len(self.names) - 1, -1, -1):
                if self.names[at] in names:
                    return at
                if self.names[at] in bounds:
                    break
        return -1

    def implied(self, name: str) -> None:
        """Ends what the start of such an element ends."""
        if name in _ENDS_P:
            self._end(_P, _P_BOUNDS)
        if name in _SIBLINGS:
            self._end(*_SIBLINGS[name])

    def _end(self, names: frozenset[str], bounds: frozenset[str]) -> None:
        at = self.last(names, bounds)
        while at >= 0:
            self.cut(at)
            at = self.last(names, bounds)

    def end(self, name: str) -> None:
        # what hides is ended by its own end tag even over cells that were left open
        at = self.last(_HEADINGS if name in _HEADINGS else frozenset((name,)), _END_BOUNDS.get(name, _ARTICLES if self.hidden else _CELLS))
        if at >= 0:
            self.cut(at)


class Dropped:
    """The innermost element that is never text and what is open in it. One that isn't closed before the next of its name
    ends where it must: a control or a drawing before a block, any with the element that holds it; of the others that
    have no end only the tag goes."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.names: list[str] = []
        self.closed = False
        self.next: dict[str, re.Match | None] = {}

    def start(self, name: str, at: int) -> None:
        m = self.next.get(name)
        if name not in self.next or (m and m.start() < at):
            m = self.next[name] = _OWN[name].search(self.page, at)
        self.closed = m is not None and m[1] == "/"
        if self.closed or name in _CONTROLS or (m and name in ("template", "object")):
            self.names = [name]

    def tag(self, end: str, name: str, rest: str, held: bool) -> bool:
        """Whether the tag lies inside; held: it may end an element that holds this one."""
        if end:
            if name in self.names:
                while self.names.pop() != name:
                    pass
                return True
            if held or (name in _INLINE and not self.closed):
                self.names = []
            return bool(self.names)
        if not self.closed and self.names[0] in _CONTROLS and name in _BREAKS and "foreignobject" not in self.names:
            self.names = []
            return False
        if name not in _VOID and not rest.endswith("/"):
            self.names.append(name)
        return True


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, inside the marked article) of every line; weight 0 where markup tells that it isn't article."""
    page = _GONE.sub(" ", page)
    out: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    linked = plain = 0
    tree, dropped = Open(out), Dropped(page)
    link = articles = 0

    def close() -> None:
        nonlocal linked, plain
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            weight = 0 if (linked > plain and not tree.article) else len(text)
            out.append((text, weight, tree.article > 0))
        else:
            out.append(("", 0, tree.article > 0))
        linked = plain = 0

    def put(text: str) -> None:
        nonlocal linked, plain
        if text and not dropped.names:
            buffer.append(text)
            n = len(text) - text.count(" ")
            if link:
                linked += n
            else:
                plain += n

    at = 0
    for m in _TAG.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        end, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if dropped.names and dropped.tag(end, name, rest, bool(tree.count.get(name))):
            continue
        if name in _DROP:
            put(" ")
            if not end and not rest.endswith("/"):
                dropped.start(name, at)
            continue
        if name == "a":
            link = 0 if end else 1
        if name in _INLINE:
            if name in ("mtr", "mtd", "iframe"):
                put(" ")
            continue
        close()
        if end:
            tree.end(name)
            continue
        tree.implied(name)
        if name in _VOID or rest.endswith("/"):
            continue
        how = _hint(rest)
        if name in ("article", "main"):
            # a hint doesn't hide what the page marks as its article, but readers' comments come as articles as well
            if how and (tree.hidden or (how == "talk" and articles)):
                tree.start(name, how)
            else:
                tree.unmask()  # whatever was left open before it ends here
                tree.start(name, "", True)
                articles += name == "article"
        elif name in ("html", "head", "body"):
            tree.start(name, "")
        elif name in _ASIDE and not (tree.article and name == "header"):
            tree.start(name, "name")
        else:
            tree.start(name, how)
    put(page[at:])
    close()
    tree.cut(0)
    for k in _hidden(out, tree.all):
        out[k] = (out[k][0], 0, out[k][2])
    return out


def _hint(attributes: str) -> str:
    """How class, id, role or label hide an element: "hint", "talk" or not at all."""
    values = [a or b or c for a, b, c in _HINT.findall(attributes)] if attributes else []
    found = [m[0] for v in values for m in _NAMES.finditer(v)]
    return "" if not found else "talk" if any(_TALKS.search(x) for x in found) else "hint"


def _hidden(out: list[tuple[str, int, bool]], masks: list[Mask]) -> list[int]:
    """The lines that are hidden. An element that only a hint hides is a wrapper of the page instead, and hides nothing,
    if it has several lines and most of the page's text, and what is left without it is nothing or, beside 200 characters
    or more of it, less than a quarter; for comments, if it has all text."""
    size, full = [0], [0]
    for text, _, _ in out:
        size.append(size[-1] + len(text))
        full.append(full[-1] + bool(text))

    def covered(masks: list[Mask]) -> list[int]:
        step = [0] * (len(out) + 1)
        for m in masks:
            step[m.start] += 1
            step[m.end] -= 1
        return [k for k, depth in enumerate(accumulate(step[:-1])) if depth]

    gone = covered(masks)
    seen = size[-1] - sum(len(out[k][0]) for k in gone)

    def wraps(m: Mask) -> bool:
        held = size[m.end] - size[m.start]
        if m.how == "name" or full[m.end] - full[m.start] < 2:
            return False
        if m.how == "talk":
            return held == size[-1]
        return 2 * held > size[-1] and (not seen or (held >= 200 and 4 * seen < held))

    stay = [m for m in masks if not wraps(m)]
    return gone if len(stay) == len(masks) else covered(stay)


def main_text(page: str | None, window: int = 3, share: float = 0.1) -> str:
    lines = lines_of(page or "")
    marked = any(inside and weight for _, weight, inside in lines)
    weight = [w if inside or not marked else 0 for _, w, inside in lines]
    weight = [w for (text, _, _), w in zip(lines, weight) if text]
    texts = [text for text, _, _ in lines if text]
    n = len(texts)
    sums = [sum(weight[i : i + window]) for i in range(n)]
    least = min(LEAST, share * median_low([w for w in weight if w] or [0]))
    kept: list[str] = []
    i = 0
    while i < n:
        if sums[i] > least:  # surge
            j = i
            while j < n and sums[j]:  # dive
                j += 1
            kept += [texts[k] for k in range(i, j) if weight[k]]
            i = j
        i += 1
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, share: float = 0.1) -> DataFrame:
    """id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, window, share) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession, 500)
    got = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return got.mapInArrow(run, "page_id long, url string, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
