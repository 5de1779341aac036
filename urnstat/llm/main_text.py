"""Main text of web pages by a maximum-scoring run of tokens.

A page becomes a sequence of words and tags. Words score by the element they stand in
and tags score below zero, with weights learnt from pages that mark their own article:
how often an element's words, or a tag, stand inside it and outside. One linear scan
finds the contiguous run with the largest sum. Where the ends of the run share an
article or section, the run grows to that element, so short last paragraphs stay.
Elements that never hold main text (menus, forms, scripts, comments …) are told by
their tag, role or class; their words score below zero and are never returned. A class
or id is read name by name, and the last part of a name counts (post-comments, but not
has-comments), or the first one before a word for text (comment-content). Memory grows
with the length of a page, however deep its elements are nested.

Blocks of the run are decoded, white space inside one becomes one space (a line break
element too), and they are joined by line feeds. Null, empty and wordless pages give
the empty text. Broken markup is read leniently: unclosed and stray tags are fine, an
unfinished tag at the end is dropped, an unclosed comment or script runs to the end.
Repeated rows are read one by one and columns beside those named are only carried.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urnstat.llm.common import slices, texts_of

#: Most labelled pages that weights are learnt from.
SAMPLE_PAGES = 2_000
#: Rows that a task turns into Python objects at once; pages can be long.
PAGE_ROWS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
#: Elements without main text, by tag, by role and by a part of their class or id.
DROP_TAGS = frozenset("aside button dialog fieldset footer form head menu nav search select".split()) | RAW
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
DROP_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar widget related recommended share sharing social cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe signup login comment comments reply replies disqus footer "
    "masthead toolbar pagination pager".split()
)
#: A name of its own in a class or id that tells the place of the main text, whatever the other names say.
KEEP_PARTS = frozenset("article content entry main page post story wrapper container layout".split())
#: First parts of a name that make main text of something else (comment-content, related-article), and what they stand before.
FOREIGN_PARTS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promoted comment comments reply replies related recommended cookie "
    "cookies newsletter".split()
)
TEXT_PARTS = frozenset("article articles body content entry entries main post posts story stories text".split())
#: First parts of a name that only tell what stands beside (has-sidebar).
BESIDE_PARTS = frozenset("has with without no is".split())
NEVER_DROPPED = frozenset("html body main article".split())
#: Elements that a run may grow to.
HOLDERS = frozenset("article main section div td".split())
#: Closed by any block that starts; closed by their own kind.
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_SAME = frozenset("li dt dd tr td th".split())

_markup = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z",
    re.S,
)
_attribute = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall


class Element:
    """An open or closed element; ``number`` and ``last`` are the first and last element inside, itself included."""

    __slots__ = ("number", "tag", "key", "dropped", "parent", "depth", "in_article", "in_main", "last")

    def __init__(self, number: int, tag: str, key: str, dropped: bool, parent: Element | None):
        self.number, self.tag, self.key, self.parent, self.last = number, tag, key, parent, number
        self.dropped = dropped or (parent is not None and parent.dropped)
        self.depth = parent.depth + 1 if parent else 0
        self.in_article = tag == "article" or (parent is not None and parent.in_article)
        self.in_main = tag in ("article", "main") or (parent is not None and parent.in_main)


class Token:
    """A tag or a run of text, with the element it stands in."""

    __slots__ = ("text", "words", "key", "dropped", "element", "block")

    def __init__(self, text: str, words: int, key: str, element: Element, block: int):
        self.text, self.words, self.key, self.element, self.block = text, words, key, element, block
        self.dropped = element.dropped


def _foreign(name: str) -> bool:
    """Whether a name in a class or id, like post-comments, calls something that is no main text.

    The last part says what it is; before a word for main text the first part does.
    """
    parts = [p.lower() for p in _parts(name)]
    if not parts or parts[0] in BESIDE_PARTS:
        return False
    return parts[-1] in DROP_PARTS or (len(parts) > 1 and parts[0] in FOREIGN_PARTS and parts[-1] in TEXT_PARTS)


def _look(name: str, rest: str, parent: Element) -> tuple[str, bool]:
    """Key of an element (tag, and what its class or id calls it) and whether it is dropped."""
    if not rest.strip(" /\t\n\r\f"):
        if name == "header":
            return name, not parent.in_main
        return name, name in DROP_TAGS
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(rest)}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    parts = [p.lower() for n in names for p in _parts(n)]
    key = ".".join([name, *sorted(set(parts))[:3]])
    if name in NEVER_DROPPED:
        return key, False
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    if hidden or found.get("role", "").lower() in DROP_ROLES or name in DROP_TAGS:
        return key, True
    kept = any(n.lower() in KEEP_PARTS for n in names)
    if (name == "header" or "header" in parts) and not parent.in_main:
        return key, not kept
    return key, not kept and any(map(_foreign, names))


def read(page: str) -> list[Token]:
    """Tokens of a page in order, each in its element; elements know their parents."""
    out: list[Token] = []
    now = root = Element(0, "", "", False, None)
    opened: Counter[str] = Counter()
    last = count = block = 0
    size = len(page)

    def text_until(stop: int) -> None:
        if stop > last:
            text = page[last:stop]
            out.append(Token(text, len(text.split()), now.key, now, block))

    def close() -> Element:
        opened[now.tag] -= 1
        now.last = count
        return now.parent

    while last < size:
        m = _markup.search(page, last)
        if not m:
            text_until(size)
            break
        text_until(m.start())
        last = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        ends = bool(m["end"])
        inline = name not in BLOCK and name not in RAW
        if name in RAW and not ends:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, last)
            last = stop.end() if stop else size
            block += name not in ("svg", "math", "object")
            continue
        if inline and name not in ("button", "select"):
            out.append(Token(" " if name == "br" else "", -1, name, now, block))
            continue
        block += 1
        if ends:
            if opened[name] > 0:
                while now.tag != name:
                    now = close()
                now = close()
        else:
            if now.tag in CLOSED_BY_BLOCK and name in BLOCK:
                now = close()
            if name in CLOSED_BY_SAME and now.tag == name:
                now = close()
            if name not in VOID:
                key, dropped = _look(name, m["rest"], now)
                count += 1
                now = Element(count, name, key, dropped, now)
                opened[name] += 1
        out.append(Token("", -1, name, now, block))
    while now is not root:
        now = close()
    root.last = count
    return out


def weight(counts: tuple[float, float]) -> float:
    """Log odds of standing inside the article, between -1 and 1."""
    inside, outside = counts
    return max(-1.0, min(1.0, math.log((inside + 0.5) / (outside + 0.5)) / 3))


class Weights:
    """Scores of words by element and of tags, learnt or by default."""

    def __init__(self, counts: dict[str, tuple[float, float]] | None = None):
        self.learnt = {k: weight(c) for k, c in (counts or {}).items()}

    def of(self, token: Token) -> float:
        if token.words < 0:
            # A tag is never better than nothing; one that marks main text costs little.
            return min(-0.05, 0.5 * self.learnt.get(f"<{token.key}>", -0.5) - 0.1)
        if token.dropped:
            return -float(token.words)
        return token.words * self.learnt.get(token.key, 0.5 if token.key.partition(".")[0] in ("", "body", "html") else 1.0)


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the largest positive sum; the first of equal ones."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i + 1)
    return found


def extract(page: str, weights: Weights) -> str:
    """The main text of one page."""
    tokens = read(page)
    first, stop = best_run([weights.of(t) for t in tokens])
    inside = [t for t in tokens[first:stop] if t.words > 0]
    if not inside:
        return ""
    # The element around all of them is the one around the first and the last opened.
    low, high = (f((t.element for t in inside), key=lambda e: e.number) for f in (min, max))
    while low is not high:
        if low.depth > high.depth:
            low = low.parent
        else:
            high = high.parent
    around = []
    while low is not None:
        if low.tag in HOLDERS:
            around.append(low)
        low = low.parent
    around.sort(key=lambda e: e.tag not in ("article", "main"))  # the nearest of these two before any other
    holder = around[0] if around else None
    chosen = tokens[first:stop] if holder is None else [t for t in tokens if holder.number <= t.element.number <= holder.last]
    blocks: dict[int, list[str]] = defaultdict(list)
    for t in chosen:
        if t.text and not t.dropped:
            blocks[t.block].append(t.text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def labelled(page: str) -> list[tuple[str, int, int]]:
    """(key, inside, outside) counts of a page with one marked article, else none."""
    if len(re.findall(r"<article[\s>]", page, re.I)) != 1:
        return []
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for t in read(page):
        outside = not t.element.in_article
        counts[f"<{t.key}>" if t.words < 0 else t.key][outside] += abs(t.words)
    return [(k, a, b) for k, (a, b) in counts.items()]


def learn(pages: DataFrame, html_column: str = "html", id_column: str = "page_id", rows: int = SAMPLE_PAGES) -> Weights:
    """Weights from the ``rows`` pages that mark their article and are smallest by a hash of id and page.

    The hashes are chosen first; pages are counted where they are, and are not moved.
    """
    marked = pages.where(F.lower(html_column).contains("<article"))
    order = F.xxhash64(F.col(id_column).cast("string"), html_column)
    marked = marked.select(F.col(html_column).alias("html"), order.alias("h"))
    # Equal hashes are repeated rows, which a cut-off takes all or none of; so it is the last of different ones.
    last = marked.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    sample = marked.where(F.col("h") <= F.lit(last).cast("bigint"))

    def run(batches):
        for batch in slices(batches, PAGE_ROWS):
            found = [row for p in texts_of(batch, "html") for row in labelled(p)]
            columns = list(zip(*found)) or [[], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "inside", "outside"])

    counts = sample.select("html").mapInArrow(run, "key string, inside bigint, outside bigint")
    summed = counts.groupBy("key").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    return Weights({r["key"]: (r["a"], r["b"]) for r in summed.collect()})  # keys of ``rows`` pages at most


def main_text(pages: DataFrame, weights: Weights, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """All columns of ``pages`` but the page itself, and its main text."""
    others = [f for f in pages.schema.fields if f.name not in (html_column, text_column)]
    schema = T.StructType([*others, T.StructField(text_column, T.StringType())])

    def run(batches):
        for batch in slices(batches, PAGE_ROWS):
            texts = [extract(p, weights) for p in texts_of(batch, html_column)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in others), pa.array(texts, pa.string())], [*(f.name for f in others), text_column]
            )

    return pages.select(*[f"`{f.name}`" for f in others], f"`{html_column}`").mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    found = main_text(pages.select("page_id", "url", "html"), learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
