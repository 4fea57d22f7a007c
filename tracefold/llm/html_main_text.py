"""Main text of web pages by differencing pages of neighbouring URLs.

Pages are ordered by host, path and id.  Each page is compared with the
``near`` nearest pages before and after it on its host that aren't copies of it.
A comparison aligns the text lines (one a block element) of two pages by a
longest common subsequence; a line that enough of these pages share is
furniture of the site and is deleted, wherever it stands.  What such a vote
needs depends on the element tree:

* lines outside of a marked article (``article``, ``main``), and all lines of
  pages without one: half of the pages compared.  Outside of articles the
  elements (tags and classes) are aligned as well as the texts, as menus, adverts
  and footers are templates that each page fills with other words;
* lines of a marked article: all pages compared, three at least, each with the
  line in the same place, counted from the article's first or last line, as pages
  may quote each other.

A page is a copy, which tells nothing, if it shares half of the words of the
marked article, or all but a twentieth of the words of a page without one.

Two checks of the tree follow for what no neighbour shares: lines of elements
that are furniture by name, role or class go, and so do lines outside of a
marked article.  Inside of one only whole class names count, not their parts.

The order is cut into blocks at keys of a sample of the table, some for each
block; each block also gets the rows up to the next sampled key on both sides.
Blocks are sorted by Spark and streamed, so their size costs no memory, and a
host with a third of all pages spreads over many of them.  The pages are exchanged once.

Defined results: null or empty HTML gives an empty text; a null URL has the
empty host and path; repeated rows each get a result; ties in host and path
are ordered by id, a null id first, then by the hash of the page; extra columns
are ignored; an empty table gives an empty result; broken markup is read
leniently; pages of any length are read whole, and the alignment of pages of
many lines splits in two so that its memory stays bounded.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracefold.llm.common import column

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")

RAW = frozenset("script style noscript template iframe textarea title svg object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog head button select label fieldset".split())
MAIN = frozenset(("article", "main"))
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption li dd dt option body html head".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promotion related replies reply search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Whole class names or ids that are furniture in a marked article too.
INNER_FURNITURE = frozenset(
    "ad ads advert advertisement sponsored comment comments comment-list commentlist comments-area reply replies disqus_thread related-posts related-articles share share-buttons sharing social social-links newsletter newsletter-signup cookie-notice sidebar nav navbar menu breadcrumb breadcrumbs pagination pager".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SIBLING = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = frozenset("ul ol dl table select body article main section div".split())


class Line:
    """A block of text and what the element tree says of it; ``slot`` are the elements around it."""

    __slots__ = ("text", "furniture", "main", "slot")

    def __init__(self, text: str, furniture: bool, main: bool, slot: str = ""):
        self.text, self.furniture, self.main, self.slot = text, furniture, main, slot


def attributes_of(raw: str) -> dict[str, str]:
    """Lower-case names and values of a tag's attributes."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), (a or b or c).lower())
    return found


def _is_furniture(tag: str, own: dict[str, str], in_main: bool) -> bool:
    if tag in FURNITURE and not (tag == "header" and in_main):
        return True
    if not own or tag in ("html", "body"):
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "") or own.get("role") in FURNITURE_ROLES:
        return True
    names = f"{own.get('class', '')} {own.get('id', '')}"
    if in_main or tag in MAIN:
        return not INNER_FURNITURE.isdisjoint(names.split())
    return tag not in HEADINGS and not FURNITURE_WORDS.isdisjoint(_WORD.findall(names))


def lines_of(page: str | None) -> list[Line]:
    """The text blocks of a page in order, white space collapsed, references decoded."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool, str]] = [("", False, False, "")]  # tag, furniture, main (both inherited), elements
    parts: list[str] = []
    page = page or ""

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append(Line(text, *stack[-1][1:]))

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                if any(x[0] in BLOCK or x[1] != stack[k - 1][1] for x in stack[k:]):
                    flush()
                del stack[k:]
                return

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if slash:
            close(tag)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" " if tag == "svg" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close("p")
                    break
                if stack[k][0] in CLOSES_P:
                    break
        for sibling in _SIBLING.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == sibling:
                    close(sibling)
                    break
                if stack[k][0] in _SCOPE:
                    break
        _, furniture, main, slot = stack[-1]
        named = attributes_of(attributes) if "=" in attributes or "hidden" in attributes else {}
        own = furniture or _is_furniture(tag, named, main)
        inside = main or (tag in MAIN or named.get("role") == "main") and not own
        if tag in BLOCK or own != furniture:
            flush()
        if not attributes.endswith("/") or tag in BLOCK:
            stack.append((tag, own, inside, f"{slot}/{tag}.{named['class']}" if "class" in named else f"{slot}/{tag}"))
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!][^<]*\Z", rest)  # a tag broken off by the end
        parts.append(rest[: cut.start()] if cut else rest)
    flush()
    return lines


def shared(a: list[str], b: list[str]) -> dict[int, int]:
    """Positions in ``a``, and those in ``b``, of a longest common subsequence."""
    found = {}
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        found[start] = start
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
        found[len(a) - end] = len(b) - end
    both = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    if both:
        left, right = ([k for k in range(start, len(x) - end) if x[k] in both] for x in (a, b))
        found |= {left[i]: right[j] for i, j in _aligned([a[k] for k in left], [b[k] for k in right])}
    return found


def _rows(left: list[str], right: list[str]) -> Iterator[int]:
    """Rows of the dynamic program as bit sets: a zero marks where the length rises."""
    masks: dict[str, int] = {}
    for j, x in enumerate(right):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    row = full
    yield row
    for x in left:
        m = masks.get(x, 0)
        row = ((row + (row & m)) | (row & ~m)) & full
        yield row


def _lengths(left: list[str], right: list[str]) -> np.ndarray:
    """The length of the common subsequence of ``left`` and each prefix of ``right``."""
    for row in _rows(left, right):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(right) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(right)]
    return np.r_[0, np.cumsum(bits == 0)]


def _aligned(left: list[str], right: list[str], most_bits: int = 1 << 27) -> list[tuple[int, int]]:
    """Positions in both of a longest common subsequence, with about ``most_bits`` of memory."""
    if not left or not right:
        return []
    if len(left) > 1 and len(left) * len(right) > most_bits:  # halve ``left``, and ``right`` where the lengths add up to most
        half = len(left) // 2
        to = int((_lengths(left[:half], right) + _lengths(left[half:][::-1], right[::-1])[::-1]).argmax())
        return _aligned(left[:half], right[:to], most_bits) + [(half + i, to + j) for i, j in _aligned(left[half:], right[to:], most_bits)]
    rows, found = list(_rows(left, right)), []
    i, j = len(left), len(right)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


class Page:
    """The lines of a page, with what comparisons need of them."""

    def __init__(self, source: str | None):
        self.lines = lines_of(source)
        self.texts = [x.text for x in self.lines]
        self.marked = any(x.main and not x.furniture for x in self.lines)
        self.content = [not x.furniture and (x.main or not self.marked) for x in self.lines]
        self.size = [x.count(" ") + 1 for x in self.texts]
        self.words = sum(n for n, own in zip(self.size, self.content, strict=True) if own)
        self.outside = [k for k, own in enumerate(self.content) if not own]
        self.rank = list(accumulate(map(int, self.content)))  # of a line among those of the content
        self.slots = [self.lines[k].slot for k in self.outside]
        self.key = tuple(self.texts)

    def common(self, other: Page) -> set[int] | None:
        """The lines that ``other`` takes for furniture; None if one is a copy of the other, as far as their content goes."""
        if self.key == other.key:
            return None
        found = shared(self.texts, other.texts)
        same = sum(self.size[k] for k in found if self.content[k])
        if same and (2 * same >= self.words if self.marked else 20 * same >= 19 * self.words and 20 * same >= 19 * other.words):
            return None
        if self.marked:  # lines of the article only in the same place
            last, other_last = self.rank[-1], other.rank[-1]
            found = {k: j for k, j in found.items() if not self.content[k] or self.rank[k] == other.rank[j] or last - self.rank[k] == other_last - other.rank[j]}
            if other.marked:
                return {*found, *(self.outside[k] for k in shared(self.slots, other.slots))}
        return set(found)


def furniture_of_site(page: Page, before: Iterable[Page], after: Iterable[Page], near: int = 3) -> set[int]:
    """The lines shared with enough of the ``near`` nearest pages on each side, copies passed over."""
    votes, asked = [0] * len(page.lines), 0
    for side in (before, after):
        left = near
        for other in side:
            found = page.common(other)
            if found is None:
                continue
            asked, left = asked + 1, left - 1
            for k in found:
                votes[k] += 1
            if not left:
                break
    guarded = [page.marked and own for own in page.content]
    return {k for k, n in enumerate(votes) if n and (n >= 3 and n == asked if guarded[k] else 2 * n >= asked)}


def main_text(page: Page, before: Iterable[Page] = (), after: Iterable[Page] = (), near: int = 3) -> tuple[str, int]:
    """The main text of a page, and how many of its lines are deleted as shared."""
    gone = furniture_of_site(page, before, after, near)
    return "\n\n".join(x for k, x in enumerate(page.texts) if k not in gone and page.content[k]), len(gone)


def _keyed(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return pages.withColumns({"_host": host, "_path": path, "_n": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "_row": F.monotonically_increasing_id()})


_KEY = ("_host", "_path", "_n", "_row")  # the row only splits pages of one URL and id
PER_BLOCK = 16


def _sampled_keys(keyed: DataFrame, block_rows: int, usual_blocks: int) -> list[tuple]:
    """Keys in order, about ``PER_BLOCK`` for each block of ``block_rows``.

    Tables beyond ``usual_blocks`` blocks get larger blocks, so the driver sees
    at most about ``usual_blocks * PER_BLOCK`` keys; the sample is even, whatever the size.
    """
    thin = keyed.select(*_KEY)
    rows = thin.count()
    blocks = min(-(-rows // block_rows), usual_blocks)
    if blocks < 2:
        return []
    step = max(1, rows // (blocks * PER_BLOCK))
    return sorted(tuple(r) for r in thin.filter(F.pmod(F.xxhash64(*_KEY), F.lit(step)) == 0).collect())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, near: int = 3, block_rows: int = 2048, usual_blocks: int = 20_000) -> DataFrame:
    """The id and URL columns, ``text``, ``n_chars`` (code points) and ``n_shared`` (lines deleted as shared)."""
    spark = pages.sparkSession
    keyed = _keyed(pages.select(id_col, url_col, html_col), id_col, url_col)
    keys = spark.sparkContext.broadcast(_sampled_keys(keyed, block_rows, usual_blocks))
    blocks = len(keys.value) // PER_BLOCK + 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, to, context = [], [], []
            for k, key in enumerate(zip(*(column(b, c).to_pylist() for c in _KEY), strict=True)):
                own, place = divmod(bisect.bisect_right(keys.value, key), PER_BLOCK)
                others = [own - 1] * (place == 0 and own > 0) + [own + 1] * (place == PER_BLOCK - 1 and own + 1 < blocks)
                take += [k] * (1 + len(others))
                to += [own, *others]
                context += [False] + [True] * len(others)
            out = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to, pa.int64()), pa.array(context, pa.bool_())], [*out.schema.names, "block", "context"])

    named = keyed.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), F.xxhash64(html_col).alias("_hash"), *_KEY)
    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    routed = named.mapInArrow(route, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", block long, context boolean").drop("_row")
    ordered = routed.repartition(blocks, "block").sortWithinPartitions("block", "_host", "_path", "_n", "_hash")

    id_type = to_arrow_type(named.schema["_id"].dataType)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                yield from zip(*(column(b.slice(at, 64), c).to_pylist() for c in ("block", "_host", "_id", "_url", "context", "_hash", "_html")), strict=True)

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, site in groupby(rows_of(batches), key=lambda r: r[:2]):
            for page, before, after, rows in _with_neighbours(site, 4 * near):
                found = main_text(page, before, after, near)
                out += [(i, url, found[0], len(found[0]), found[1]) for i, url in rows]
                if len(out) >= 500:
                    yield _packed(out, id_type)
                    out = []
        if out:
            yield _packed(out, id_type)

    found = ordered.mapInArrow(differenced, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars long, n_shared long")
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars", "n_shared")


def _with_neighbours(site: Iterator[tuple], reach: int) -> Iterator[tuple[Page, list[Page], list[Page], list[tuple]]]:
    """Runs of equal pages of a site with up to ``reach`` others before and after, nearest first, and the rows to answer."""
    runs = ((Page(html_), [(r[2], r[3]) for r in rows if not r[4]]) for (_, html_), rows in groupby(site, key=lambda r: (r[5], r[6])))
    before: deque[Page] = deque(maxlen=reach)
    ahead: deque[tuple] = deque()
    for run in chain(runs, [None] * reach):
        if run:
            ahead.append(run)
            if len(ahead) <= reach:
                continue
        elif not ahead:
            break
        page, rows = ahead.popleft()
        if rows:
            yield page, list(before)[::-1], [x[0] for x in ahead], rows
        before.append(page)


def _packed(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    types = [id_type, pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["_id", "_url", "text", "n_chars", "n_shared"])
