"""Main text of web pages: the contiguous region of an HTML page with the largest score."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty

#: Labelled pages (those that mark their article) that the weights are fitted on, in expectation, chosen by a hash of the id.
SAMPLE = 2000
#: Least distance of a weight from zero: words always score above it, tags below minus it.
LEAST = 0.05

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
#: Elements whose content is never main text.
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe input label map menu nav noscript object option script select style svg template textarea video".split())
#: Words of a class, id, role or label that name such an element. A name counts only if it is made of these words and of
#: those that tell a place, a shape or a number: `ad-banner-2` names an advert, `related-work` and `no-sidebar` don't.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "dialog disqus footer masthead menu modal nav navbar navigation navigationbar newsletter notice notices pagination popup promo promotion recommended related "
    "replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
PLACES = frozenset(
    "area bar block bottom box center container footer form global group header inner item items left link links list main middle outer page panel post posts "
    "right section site slot small the thread top unit view wrap wrapper".split()
)
_OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_RAW = frozenset("script style textarea noscript template svg iframe".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in _RAW}
_NAME = re.compile(r"[^\s_-]+")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)


@dataclass
class Weights:
    """The score of a word, and of each tag: log odds of standing in an article, kept positive and negative."""

    word: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -3.0

    def of(self, tag: str) -> float:
        return self.tags.get(tag, self.other)


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, value, attributes): kind is text, open or close. Scripts, styles, comments and declarations are left out.

    One scan from left to right. What is never closed takes the rest of the page with it, but a tag in whose attributes
    a quote stays open: then tags end at the next `>` from there on.
    """
    out, at, text_from, quoted = [], 0, 0, True
    last = page.rfind(">")
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = len(page) if end < 0 else end + 3
            found = None
        elif m := _OPEN.match(page, i + 1):
            if last < i:  # no tag ends any more: what follows is text
                break
            ending = _ATTRIBUTES.match(page, m.end()) if quoted else None
            if ending is None:
                quoted = False
                end = page.find(">", m.end()) + 1
            else:
                end = ending.end()
            found = ("close" if m[1] else "open", m[2].lower(), page[m.end() : end - 1])
        elif page[i + 1 : i + 2] in ("!", "?", "/"):
            end = page.find(">", i + 2) + 1 or len(page)
            found = None
        else:
            at = i + 1
            continue
        if i > text_from:
            out.append(("text", page[text_from:i], ""))
        if found and found[0] == "open" and found[1] in _RAW and not found[2].endswith("/"):
            closing = _RAW_END[found[1]].search(page, end)
            end = closing.end() if closing else len(page)
        elif found:
            out.append(found)
        at = text_from = end
    if text_from < len(page):
        out.append(("text", page[text_from:], ""))
    return out


def extents(parts: list[tuple[str, str, str]]) -> dict[int, int]:
    """For each opening tag the index of what ends its element: its closing tag, an ancestor's, or for p a block."""
    ends: dict[int, int] = {}
    open_: list[int] = []
    count: dict[str, int] = {}

    def close(upto: str, i: int) -> None:
        while open_:
            k = open_.pop()
            ends[k] = i
            count[parts[k][1]] -= 1
            if parts[k][1] == upto:
                break

    for i, (kind, tag, attributes) in enumerate(parts):
        if kind == "open":
            if tag in BLOCKS and any(parts[k][1] == "p" for k in open_[-6:]):
                close("p", i)
            if tag not in VOID and not attributes.endswith("/"):
                open_.append(i)
                count[tag] = count.get(tag, 0) + 1
        elif kind == "close" and count.get(tag):
            close(tag, i)
    for k in open_:
        ends[k] = len(parts)
    return ends


def _names(attributes: str) -> Iterator[str]:
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "aria-label"):
            value = (m[2] or m[3] or m[4] or "").lower()
            yield from [value] if m[1].lower() == "aria-label" else value.split()


def is_marked(attributes: str) -> bool:
    """Whether an element is hidden, or one of its names says in all its words that it isn't main text."""
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for name in _names(attributes):
        words = _NAME.findall(name)
        if any(w in MARKS for w in words) and all(w in MARKS or w in PLACES or w.isdigit() for w in words):
            return True
    return False


def left_out(parts: list[tuple[str, str, str]], ends: dict[int, int]) -> list[bool]:
    """Which tokens lie in an element that is dropped.

    A header counts as one unless it is an article's and has a heading. An element that is dropped for its names alone
    stays if it holds an article or main, or, on a page without these, more than half of the words outside of dropped tags.
    """
    headings, holders, words = [0], [0], [0]
    depth = 0
    for i, (kind, value, _) in enumerate(parts):
        headings.append(headings[-1] + (kind == "open" and value in ("h1", "h2", "h3")))
        holders.append(holders[-1] + (kind == "open" and value in ("article", "main")))
        if kind == "open" and value in DROPPED and i in ends and ends[i] < len(parts):
            depth = max(depth, ends[i])
        words.append(words[-1] + (len(value.split()) if kind == "text" and i >= depth else 0))

    def holds_much(i: int, end: int) -> bool:
        return holders[end] > holders[i + 1] or not holders[-1] and 2 * (words[end] - words[i]) > words[-1]

    out, i, articles = [False] * len(parts), 0, 0
    while i < len(parts):
        kind, tag, attributes = parts[i]
        if kind == "open" and tag not in ("html", "body", "article", "main"):
            drop, end = tag in DROPPED, ends.get(i, i)
            if tag == "header" and not drop:
                drop = not articles or headings[end] == headings[i]
            if not drop and is_marked(attributes):
                drop = not holds_much(i, end)
            if drop and i in ends:
                if ends[i] == len(parts) and tag not in DROPPED:
                    end = i + 1  # never closed: only the tag itself
                else:
                    end = ends[i] + (ends[i] < len(parts) and parts[ends[i]][:2] == ("close", tag))
                out[i:end] = [True] * (end - i)
                i = max(end, i + 1)
                continue
            if drop:
                out[i] = True
        elif tag in ("article", "main"):
            if kind == "open" and tag == "article" and i in ends and is_marked(attributes) and not holds_much(i, ends[i]):
                end = min(ends[i] + 1, len(parts))
                out[i:end] = [True] * (end - i)
                i = end
                continue
            articles += 1 if kind == "open" else -1 if kind == "close" else 0
        i += 1
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the largest sum, in one scan; of equal ones the first; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page: the blocks of its best region, joined by an empty line."""
    if not page:
        return ""
    parts = tokens(page)
    gone = left_out(parts, extents(parts))
    words = [0.0 if g else len(v.split()) * weights.word if k == "text" else weights.of(v) for (k, v, _), g in zip(parts, gone)]
    start, end = best_region(words)
    blocks, now = [], []
    for (kind, value, _), g in zip(parts[start:end], gone[start:end]):
        if g:
            if kind != "text" and value in BLOCKS:
                blocks.append(now)
                now = []
        elif kind == "text":
            now.append(value)
        elif value in BLOCKS:
            blocks.append(now)
            now = []
        elif value in ("br", "td", "th"):
            now.append(" ")
    blocks.append(now)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def label(page: str | None) -> tuple[list[tuple[str, int, int]], bool]:
    """Counts (kind, inside, outside) of a page that marks one article, `#word` for words; whether it does."""
    parts = tokens(page or "")
    ends = extents(parts)
    marked = [i for i, (k, t, a) in enumerate(parts) if k == "open" and t in ("article", "main") and i in ends and not is_marked(a)]
    if len(marked) != 1:
        return [], False
    first, last = marked[0], ends[marked[0]]
    counts: dict[str, list[int]] = {}
    for i, (kind, value, _) in enumerate(parts):
        c = counts.setdefault("#word" if kind == "text" else value, [0, 0])
        c[0 if first < i < last else 1] += len(value.split()) if kind == "text" else 1
    return [(k, a, b) for k, (a, b) in counts.items()], True


def weights_of(counts: list[tuple[str, int, int]]) -> Weights:
    """Weights from summed counts; the plain ones if no page is labelled."""
    inside, outside = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not inside or not outside:
        return Weights()
    odds = {k: math.log((a + 0.5) / (inside + 0.5)) - math.log((b + 0.5) / (outside + 0.5)) for k, a, b in counts}
    tags = {k: min(-LEAST, v) for k, v in odds.items() if k != "#word"}
    return Weights(max(LEAST, odds.get("#word", 1.0)), tags, min([-LEAST, *tags.values()]) / 2)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from about `sample` pages that mark their article. One row for each kind of tag in those pages reaches the driver."""
    n = pages.count()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for page in batch.column(0).to_pylist() for x in label(page)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["kind", "inside", "outside"])

    chosen = pages.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30))
    sums = chosen.select(F.col(html_col).alias("_html")).mapInArrow(thrifty(counted), "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    return weights_of([(r["kind"], r["i"], r["o"]) for r in sums.orderBy("kind").collect()])


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row.

    Null html is an empty page; a page without words has the empty text. Null ids and urls stay null, repeated rows give
    a row each, other columns are not looked at. Pages are read whole, broken markup included. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(html_col).alias("_html"), F.col(id_col), F.col(url_col)).mapInArrow(thrifty(run), f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
