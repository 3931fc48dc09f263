"""Operator 9, HTML extraction by tag-path ratios.

A page is a sequence of text blocks, each with its root-to-leaf path of block-level elements.

* *Ratios.*  For each path of the page, text length (link texts count for little) and punctuation are aggregated over
  its blocks and divided by their number.  The logarithms of both are added and smoothed along the page with a
  Gaussian window; the harmonic mean of both leaves a path without text of its own at nothing.
* *Nodes.*  The text of a page lies in few nodes.  A block's node is the element around it, other than those that
  hold the whole page, with the largest share of the page's text; blocks of the same element name under one parent
  count as a node too.  Between blocks of large nodes a block takes their share (a morphological closing, which fills
  gaps and never reaches beyond the ends), and a heading takes the share of what follows it.
* *Fusion.*  A block's score is smoothed ratio x weight x (1 + GAIN x share squared), a path's that of its blocks' mean.  The
  weight is what names tell: it is below 1 inside elements or classes of menus, headers, footers, sidebars, notices,
  adverts, forms and reader comments, above 1 inside article or main.  It's bounded and nothing else depends on names.
* *Threshold.*  Paths that reach SHARE of the page's best score are content; their blocks are the text.  Blocks of one
  path in different nodes (a footer in the same kind of element as the text) are thresholded apart.

Every row is extracted in an Arrow function by itself; there is no shuffle.  The time for a page grows
with its length (one pass of an atomic pattern).  Defined cases: null or empty html gives the empty text;
null ids and urls pass through; repeated rows give repeated results; an empty table gives an empty result;
further columns are ignored; the results replace kept columns named text or n_chars; tags that are never closed or
cut off at the end end where the page ends, but for media, options and other elements that are never text, which without
an end tag end at the next block; unmatched end tags are skipped.
"""

from __future__ import annotations

import html as entities
import math
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, table, text_of

#: Smoothing (blocks), gain of a node's share of the page, the share of the page's best score that is content, and what a character of a link counts.
SIGMA, GAIN, SHARE, LINKED = 1.0, 50.0, 0.05, 0.02
#: Weights of elements by name: boilerplate, words that only may tell it, and main elements; and the least product.
BOILERPLATE, DOUBTFUL, MAIN_WEIGHT, LEAST = 0.02, 0.5, 2.0, 1e-4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_SPACE = re.compile(r"\s+")
_MARKED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset address details summary center dialog menu search hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that are never text of a page, and those that hold boilerplate.
DROPPED = frozenset("head button noscript template svg math iframe object canvas audio video select datalist option".split())
#: Elements that an inner end tag doesn't reach across, and the names whose end tags do.
BARRIERS = frozenset("article main table".split())
ACROSS = frozenset("body html article main div section table".split())
SKIPPED = frozenset("nav footer aside form fieldset dialog menu search".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that tell boilerplate, words that stand beside them, and words of main elements.
SKIPPED_WORDS = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond pagination pager widget toolbar complementary contentinfo search".split())
BESIDE_WORDS = frozenset("site page top bottom left right main primary secondary global list lists item items box wrap wrapper container block area section inner outer bar link links post posts article content entry header body the form thread unit slot".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
#: An opening tag closes open elements of these names, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def _tokens(attributes: str) -> list[list[str]]:
    """Names in class, id and role, each as its words in lower case."""
    return [[p.lower() for p in _PART.findall(t)] for m in _MARKED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split()]


def _weight(name: str, tokens: list[list[str]], in_main: bool) -> tuple[float, bool]:
    """What an element's names tell, and whether it is a main element."""
    if name in SKIPPED or (name == "header" and not in_main):
        return BOILERPLATE, False
    if name in ("html", "body", *MAIN) or name in HEADINGS or name == "p":
        return (MAIN_WEIGHT, True) if name in MAIN and not in_main else (1.0, False)
    weight = 1.0
    for words in tokens:
        if any(w in SKIPPED_WORDS for w in words):
            weight = min(weight, BOILERPLATE if all(w in SKIPPED_WORDS or w in BESIDE_WORDS for w in words) else DOUBTFUL)
    if weight == 1.0 and not in_main and name in BLOCKS and any(w in MAIN_WORDS for words in tokens for w in words):
        return MAIN_WEIGHT, True
    return weight, False


class _Element:
    __slots__ = ("name", "above", "path", "dropped", "main", "weight", "mass", "held", "node")

    def __init__(self, name: str, above: _Element | None, attributes: str = "", paths: dict[tuple[int, str], int] | None = None):
        tokens = _tokens(attributes) if attributes else []
        self.name, self.above = name, above
        own, main = _weight(name, tokens, bool(above and above.main))
        self.weight = max(LEAST, own * (above.weight if above else 1.0))
        self.main = main or bool(above and above.main)
        self.dropped = name in DROPPED or bool(above and above.dropped)
        # a path is its number among the page's paths, so deep pages need no long strings
        self.path = above.path if above else 0
        if paths is not None and name in BLOCKS:
            step = name + "".join("." + w for w in sorted({w for t in tokens for w in t}))
            self.path = paths.setdefault((self.path, step), len(paths) + 1)
        self.mass, self.held = 0.0, 0
        self.node = self if above is None or name in BLOCKS else above.node  # the innermost block-level element


def _tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether an end tag, attributes) of each tag; comments and the insides of raw elements have an empty name."""
    out, at, n = [], 0, len(page)
    while at < n and (m := _TOKEN.search(page, at)):
        name, ending, attributes = (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        at = m.end()
        if name in RAW:
            if not ending and not attributes.endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
            name = ""
        out.append((m.start(), at, name, ending, attributes))
    return out


_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


def _unclosed(tags: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Places in ``tags`` of the start tags of dropped elements that no end tag belongs to."""
    open_: dict[str, list[int]] = {}
    for k, (_, _, name, ending, _) in enumerate(tags):
        if name in DROPPED:
            if not ending:
                open_.setdefault(name, []).append(k)
            elif open_.get(name):
                open_[name].pop()
    return {k for places in open_.values() for k in places}


class _Stack:
    """Open elements, with the places of each name, so that no lookup walks the stack."""

    def __init__(self, root: _Element):
        self.items, self.at, self.blocks, self.loose = [root], {}, [], []

    def last(self, names) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((places[-1] for x in names if (places := self.at.get(x))), default=0)

    def push(self, e: _Element, loose: bool) -> None:
        k = len(self.items)
        self.items.append(e)
        self.at.setdefault(e.name, []).append(k)
        if e.name in BLOCKS:
            self.blocks.append(k)
        if loose:
            self.loose.append(k)

    def cut(self, k: int) -> None:
        """Close the element at place ``k`` and all inside it."""
        while len(self.items) > k:
            self.at[self.items.pop().name].pop()
        for places in (self.blocks, self.loose):
            while places and places[-1] >= k:
                places.pop()

    def end(self, name: str) -> None:
        """An end tag: closes the innermost element of its name, if one is open within reach."""
        k = self.last((name,))
        if k and (name in ACROSS or k >= self.last(BARRIERS)):
            self.cut(k)

    def start(self, name: str) -> None:
        """What a start tag closes: unclosed media and options and an open paragraph before a block, and siblings of its own kind."""
        if name in BLOCKS:
            if self.loose:
                self.cut(self.loose[0])
            if self.blocks and self.items[self.blocks[-1]].name == "p":
                self.cut(self.blocks[-1])
        if name == "body" and (k := self.last(("head",))):
            self.cut(k)
        if name in ("a", "option") and (k := self.last((name,))) > (self.blocks[-1] if self.blocks else 0):
            self.cut(k)
        if name in CLOSES:
            ended, until = CLOSES[name]
            above = self.last(until)
            if name == "tr":  # all cells and rows of its table
                inside = [places[i] for x in ended if (places := self.at.get(x)) and (i := bisect_right(places, above)) < len(places)]
                if inside:
                    self.cut(min(inside))
            elif (k := self.last(ended)) > above:
                self.cut(k)


def blocks(page: str) -> tuple[list[tuple[str, int, _Element]], list[_Element]]:
    """(text, characters of link texts, innermost element) of each block in page order, and all elements, parents first."""
    root = _Element("", None)
    stack, out, elements = _Stack(root), [], [root]
    paths: dict[tuple[int, str], int] = {}
    parts: list[str] = []
    linked, owner = 0, root

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((text, min(linked, len(text)), owner))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked, owner
        if piece and not stack.items[-1].dropped:
            if not parts:
                if piece.isspace():
                    return
                owner = stack.items[-1]
            parts.append(piece)
            if stack.at.get("a"):
                linked += len(piece)

    tags, at = _tags(page), 0
    unclosed = _unclosed(tags)
    for k, (start, end, name, ending, attributes) in enumerate(tags):
        text(page[at:start])
        at = end
        if not name:
            continue
        if name in VOID:
            if name in ("br", "hr") and parts:
                parts.append(" ")
            continue
        if name in ("td", "th"):
            if parts:
                parts.append(" ")
        elif name in BLOCKS:
            close()
        if ending:
            stack.end(name)
            continue
        stack.start(name)
        if name in DROPPED and attributes.endswith("/"):
            continue
        elements.append(_Element(name, stack.items[-1], attributes, paths))
        stack.push(elements[-1], k in unclosed)
    text(page[at:])
    close()
    return out, elements


def _punctuation(text: str) -> int:
    return sum(c in ".,;:!?" or (c > "\x7f" and unicodedata.category(c)[0] == "P") for c in text)


def _smoothed(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-((d / sigma) ** 2) / 2) for d in range(-reach, reach + 1)]
    out = []
    for k in range(len(values)):
        pairs = [(kernel[d + reach], values[k + d]) for d in range(-reach, reach + 1) if 0 <= k + d < len(values)]
        out.append(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))
    return out


def ratios(found: list[tuple[str, int, _Element]], sigma: float = SIGMA) -> list[float]:
    """The smoothed tag-path ratio of each block."""
    totals: dict[int, list[float]] = {}
    for text, linked, e in found:
        t = totals.setdefault(e.path, [0.0, 0.0, 0])
        t[0] += len(text) - (1 - LINKED) * linked
        t[1] += _punctuation(text) * (1 - linked / len(text))
        t[2] += 1
    own = [math.log1p(t[0] / t[2]) + math.log1p(t[1] / t[2]) for t in (totals[e.path] for _, _, e in found)]
    return [2 * a * b / (a + b) if a else 0.0 for a, b in zip(own, _smoothed(own, sigma))]


def shares(found: list[tuple[str, int, _Element]], elements: list[_Element]) -> list[float]:
    """The share of the page's text in each block's node."""
    kin: dict[tuple[int, int], float] = {}
    for e in elements:
        e.mass, e.held = 0.0, 0
    for text, linked, e in found:
        m = (len(text) - (1 - LINKED) * linked) * e.weight
        e.mass += m
        e.held += 1
        kin[id(e.node.above), e.path] = kin.get((id(e.node.above), e.path), 0.0) + m
    for e in reversed(elements):
        if e.above:
            e.above.mass += e.mass
            e.above.held += e.held
    total = elements[0].mass or 1.0
    best: dict[int, float] = {}
    for e in elements:  # the largest share among an element and those around it
        own = e.mass / total if e.held < len(found) else 0.0
        best[id(e)] = max(own, best[id(e.above)]) if e.above else own
    out = []
    for _, _, e in found:
        out.append(max(best[id(e)], kin[id(e.node.above), e.node.path] / total))
    for k in range(len(out) - 2, -1, -1):
        if found[k][2].name in HEADINGS:
            out[k] = max(out[k], out[k + 1])
    before, after = out[:], out[:]
    for k in range(1, len(out)):
        before[k] = max(before[k], before[k - 1])
    for k in range(len(out) - 2, -1, -1):
        after[k] = max(after[k], after[k + 1])
    return [min(b, a) for b, a in zip(before, after)]


def extract_text(page: str, sigma: float = SIGMA, gain: float = GAIN, share: float = SHARE) -> str:
    """The main text of one page."""
    found, elements = blocks(page)
    if not found:
        return ""
    scores = [r * e.weight * (1 + gain * s * s) for r, s, (_, _, e) in zip(ratios(found, sigma), shares(found, elements), found)]
    mean: dict[tuple[int, int], list[float]] = {}
    for s, (_, _, e) in zip(scores, found):
        m = mean.setdefault((e.path, id(e.above)), [0.0, 0])
        m[0] += s
        m[1] += 1
    fused = {k: a / n for k, (a, n) in mean.items()}
    least = share * max(fused.values())
    return "\n".join(text for text, _, e in found if fused[e.path, id(e.above)] >= least > 0)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep``, ``text`` and ``n_chars`` for each row."""
    require(df, html_col, *keep)

    def extracted(batches):
        for b in batches:
            texts = [extract_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    inner = df.select(*(F.col(c).alias(f"__rw_{k}") for k, c in enumerate(keep)), text_of(html_col).alias("__rw_html"))
    schema = ", ".join([*(f"__rw_{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), "text string", "n_chars long"])
    out = inner.mapInArrow(extracted, schema)
    return out.select(*(F.col(f"__rw_{k}").alias(c) for k, c in enumerate(keep) if c not in ("text", "n_chars")), "text", "n_chars")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
ORACLES: dict[str, str] = {}
