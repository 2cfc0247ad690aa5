"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import re
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_arrow

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "object", "math", "canvas", "audio", "video")
BOILERPLATE = frozenset("nav header footer aside button menu dialog head fieldset".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table tr td th tbody thead article section main div body blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INNER = frozenset("p li pre dd dt blockquote tr tbody ul ol figcaption".split()) | HEADINGS
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: First parts of classes and ids that tell of an element that isn't the article.
NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter pager pagination popup promo respond sidebar sponsor sponsored subscribe topbar".split()
)
#: Last parts that tell so behind a part that names the site's frame.
FRAME, FRAME_PARTS = frozenset("site page global main top left right".split()), frozenset("header footer nav navigation menu sidebar".split())
#: What such a name, or a form, leaves of a node's ratio.
PRIOR = 0.1

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*+")
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_CLOSES = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in RAW}
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Names that say what stands beside an element, not what it is.
_BESIDE = re.compile(r"\b(?:has|with|without|no)[-_ ]?\w+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$|/)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_MARKS = str.maketrans("", "", "".join(c for c in string.punctuation if c in ".,;:!?") + "。、，；：！？…")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Markup and text of the page, in order: ("text", text, ""), ("open", tag, attributes), ("close", tag, ""), ("gap", "", "").

    Comments, declarations and elements whose content is no text are gaps.  Every character is looked at a
    bounded number of times, however the page is broken: a tag that never ends makes the rest of the page text.
    """
    at, last = 0, page.rfind(">")
    while at < len(page):
        k = page.find("<", at)
        if k < 0 or k > last:
            break
        if k > at:
            yield "text", page[at:k], ""
        if page.startswith("<!--", k):
            end = page.find("-->", k + 4)
            at = len(page) if end < 0 else end + 3
            yield "gap", "", ""
            continue
        if page.startswith(("<!", "<?"), k):
            at = page.find(">", k) + 1
            yield "gap", "", ""
            continue
        name = _NAME.match(page, k + 1)
        if not name:
            yield "text", "<", ""
            at = k + 1
            continue
        rest = _REST.match(page, name.end())
        end = rest.end() if rest else page.find(">", name.end()) + 1
        tag, attrs, at = name[0].lower(), page[name.end() : end - 1], end
        if tag[0] == "/":
            yield "close", tag[1:], ""
        elif tag in _CLOSES and not attrs.endswith("/"):
            close = _CLOSES[tag].search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = len(page) if end < 0 else end + 1
            yield "gap", "", ""
        else:
            yield "open", tag, attrs
    if at < len(page):
        yield "text", page[at:], ""


def named_boilerplate(names: str) -> bool:
    """Whether classes or ids tell of an element that isn't the article."""
    for name in _BESIDE.sub(" ", _CASE.sub("-", names).lower()).split():
        parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
        if parts and (parts[0] in NAMES or len(parts) > 1 and parts[0] in FRAME and parts[-1] in FRAME_PARTS):
            return True
    return False


class Page:
    """A page's text by block, in order.

    Of each node the number of its tag path (tags and classes from the root), its element, its text, how much of it is in links, and its prior.
    Of each element its parent, its depth and its tag; parents have lesser numbers than their children.
    """

    def __init__(self, page: str):
        self.parent, self.depth, self.tag = [-1], [0], [""]
        self.paths, self.elements, self.texts, self.linked, self.priors = [], [], [], [], []
        self._paths: dict[tuple, int] = {}
        stack: list[tuple[str, int, bool, int, float]] = [("", 0, False, 0, 1.0)]  # tag, number, unwanted, path, prior
        places: dict[str, list[int]] = defaultdict(list)  # by tag, where it stands in the stack
        scopes = [0]
        pieces: list[str] = []
        linked = bad = 0
        in_link = False

        def flush():
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    _, number, _, path, prior = stack[-1]
                    self.paths.append(path)
                    self.elements.append(number)
                    self.texts.append(text)
                    self.linked.append(min(linked, len(text)))
                    self.priors.append(prior)
                pieces.clear()
            linked = 0

        def pop(to: int):
            nonlocal bad
            flush()
            while len(stack) > to:
                tag, _, unwanted, _, _ = stack.pop()
                places[tag].pop()
                if scopes[-1] == len(stack):
                    scopes.pop()
                bad -= unwanted

        for kind, tag, attrs in tokens(page):
            if kind == "text":
                if not bad:
                    text = entities.unescape(tag)
                    pieces.append(text)
                    if in_link:
                        linked += len(text.strip())
            elif kind == "gap" or tag in VOID:
                pieces.append(" ")
            elif tag in INLINE:
                if tag == "a":
                    in_link = kind == "open"
            elif kind == "close":
                in_link = False
                if places[tag]:
                    pop(places[tag][-1])
                else:
                    flush()
            else:
                in_link = False
                flush()
                closes = [places[t][-1] for t in (*SAME_CLOSES.get(tag, ()), "p") if places[t] and places[t][-1] >= scopes[-1]]
                if closes:
                    pop(min(closes))
                _, above, _, path, prior = stack[-1]
                names, unwanted = "", tag in BOILERPLATE and not (tag == "header" and (places["article"] or places["main"]))
                if attrs:
                    unwanted |= bool(_HIDDEN.search(attrs))
                    for what, *values in _NAMED.findall(attrs):
                        value = next((v for v in values if v), "")
                        if what.lower() == "role":
                            unwanted |= value.lower() in ROLES
                        else:
                            names += " " + value
                if tag == "form" or names and tag not in ("body", "html", "article", "main") and named_boilerplate(names):
                    prior *= PRIOR
                self.parent.append(above)
                self.depth.append(self.depth[above] + 1)
                self.tag.append(tag)
                path = self._paths.setdefault((path, tag, names), len(self._paths) + 1)
                places[tag].append(len(stack))
                if tag in SCOPE:
                    scopes.append(len(stack))
                stack.append((tag, len(self.parent) - 1, unwanted, path, prior))
                bad += unwanted
        flush()


def _smooth(x: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring nodes."""
    if len(x) < 3:
        return x
    padded = np.concatenate([x[:1], x, x[-1:]])
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def scores(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Each node's fused tag-path ratio, of its path alone and smoothed: text and punctuation per node of its path, times its prior.

    Both ratios are smoothed over the page, so that a node is raised by its neighbours.
    """
    path = np.unique(np.array(page.paths), return_inverse=True)[1]
    length = np.array([len(t) for t in page.texts])
    own = np.maximum(length - np.array(page.linked), 0)
    marks = length - np.array([len(t.translate(_MARKS)) for t in page.texts])
    nodes, prior = np.bincount(path), np.array(page.priors)
    text, marks = (np.bincount(path, x) / nodes for x in (own, marks))
    return prior * text[path] * np.log1p(marks[path] + 1.0), prior * _smooth(text[path]) * np.log1p(_smooth(marks[path]) + 1.0)


def main_text(page: str | None, share: float = 0.8, strict: float = 0.5, least_mean: float = 0.35, leak: float = 0.6, pure: float = 0.92) -> str:
    """The page's article: blocks joined by one space, each with its references decoded and white space folded.

    The tag-path ratios choose: nodes whose fused, smoothed ratio is above strict standard deviations and above
    least_mean of the mean, and whose path's own ratio isn't below the share `leak` of that, are content, wherever they stand.  The box is the
    innermost element that holds the given share of their text.  In it more nodes stay, unless a name or a form
    lowers them: those on a path that the ratios chose, and nodes that aren't mostly links, where they stand between
    chosen ones, or the box is an article or main element, or the chosen ones are the share `pure` of the box's
    text.  So do headings right before a node that stays.
    """
    page = Page(page or "")
    if not page.texts:
        return ""
    raw, score = scores(page)
    least = min(max(strict * score.std(), least_mean * score.mean()), score.max())
    sure = (score >= least) & (raw >= leak * least)
    length = np.array([len(t) for t in page.texts])
    # Text of sure nodes by element: children have greater numbers than their parents.
    held = np.bincount(page.elements, np.where(sure, length, 0), len(page.parent))
    for k in range(len(held) - 1, 0, -1):
        held[page.parent[k]] += held[k]
    whole = held[0]
    box = max((k for k in range(len(held)) if held[k] >= share * whole and page.tag[k] not in INNER), key=lambda k: page.depth[k])
    within = np.zeros(len(page.parent), bool)
    within[box] = True
    for k in range(box + 1, len(within)):
        within[k] = within[page.parent[k]]
    elements, paths, priors = np.array(page.elements), np.array(page.paths), np.array(page.priors)
    heads = np.array([t in HEADINGS for t in page.tag])
    usual = priors >= priors[sure].max()
    beside = within[elements] & usual
    mostly_links = np.array(page.linked) > 0.5 * length
    at = np.flatnonzero(sure)
    between = (np.arange(len(sure)) > at[0]) & (np.arange(len(sure)) < at[-1]) & ~mostly_links
    kept = sure & (~mostly_links | beside) | beside & (np.isin(paths, paths[sure & beside]) | between)
    if page.tag[box] in ("article", "main") or page.tag[box] not in ("", "html", "body") and held[box] >= pure * length[within[elements]].sum():
        kept |= beside & ~mostly_links
    following = -1  # the next node that stays
    for k in np.flatnonzero(kept | heads[elements] & usual & ~mostly_links)[::-1].tolist():
        if kept[k] or k + 1 == following:
            kept[k], following = True, k
    return " ".join(t for t, k in zip(page.texts, kept.tolist(), strict=True) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (code points).

    Null or empty html, and pages without content, give an empty text.  The whole page is read.  Rows are
    independent of each other, so copies and null keys need no care; an empty table gives no rows.
    """
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*others, F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                texts = [main_text(x.as_py()) for x in some.column("html")]
                columns = [some.column(c) for c in others] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in others)
    return map_arrow(rows, run, fields + "text string, n_chars long")
