"""Main text of web pages, by site style trees.

The pages of a host are merged into one tree: a node is a chain of elements with their
classes, and holds what the pages have there. Its presentation is important when pages
differ in the elements below it, its content when the text blocks below it differ from
page to page; both are normalised entropies over the host's distinct pages. Branches of
low importance are the host's furniture and are cut from each page. Elements whose name or
class says what they are need no statistics: navigation, adverts, forms, comments and the
like always go, an article or main part always stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, stage, text_rows

#: A branch below this importance is cut, if so many distinct pages of the host have it.
IMPORTANCE = 0.3
PAGES = 5
#: Elements deeper than this count as their ancestor at this depth.
DEPTH = 24

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.DOTALL
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Elements whose inside is no markup, by the closing tag that ends it.
_ENDS = {
    name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE)
    for name in ("script", "style", "iframe", "noscript", "title", "textarea")
}

#: The last part of a class or id, which says what it is: side-ad is an ad, ad-free is none.
_LAST = re.compile(r"[^-_]*$")

# Element names of HTML by what they do, and words that name furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "script style noscript template iframe object svg math canvas audio video head title select option optgroup datalist textarea "
    "button".split()
)
FURNITURE = frozenset("nav footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
#: Elements that no word of a class or id makes furniture.
HOLDERS = MAIN | {"html", "body"}
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: What a head may hold; anything else ends it, with or without its end tag.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
OPTIONS = frozenset("option optgroup".split())
BY_NAME, BY_WORDS = 1, 2
CLOSES_P = BLOCK - {"body", "html"}
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies footer menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social "
    "sponsor sponsored subscribe".split()
)


class Block:
    """One text block: the style path of its element, what names say of it and around it, and its text."""

    __slots__ = ("path", "parts", "main", "inside", "text")

    def __init__(self, path: str, main: bool, inside: bool):
        self.path, self.main, self.inside, self.parts, self.text = path, main, inside, [], ""


def blocks_of(source: str) -> list[Block]:
    """The visible blocks in page order, without those in furniture by name. Open and crossed tags are put up with.

    Words of a class or id that holds a main part say nothing of that part. An article in
    an element of such words counts where the page has no other main part.
    """
    out: list[Block] = []
    # Open elements: (name, path, in furniture: BY_NAME or BY_WORDS, in the main part, in an article inside BY_WORDS).
    stack: list[tuple[str, str, int, bool, bool]] = [("", "", 0, False, False)]
    current: Block | None = None
    at, skip = 0, ""

    def text(piece: str) -> None:
        nonlocal current
        _, _, furniture, main, inside = stack[-1]
        if furniture or not piece:
            return
        if current is None:
            if not piece.strip():
                return
            current = Block(block_path(), main, inside)
            out.append(current)
        current.parts.append(piece)

    def block_path() -> str:
        return next((p for n, p, *_ in reversed(stack) if n in BLOCK or not n), "")

    def after(name: str, start: int) -> int:
        """Where the raw element that opened before `start` ends; the end of the page for an open one."""
        end = _ENDS[name].search(source, start)
        return end.end() if end else len(source)

    to = 0
    while match := _TAG.search(source, to):
        to = match.end()
        closing, name = match[1], (match[2] or "").lower()
        raw = name in _ENDS and not closing and not match[3].rstrip().endswith("/")
        if skip:
            if raw:
                to = after(name, to)
            elif closing and name == skip:
                skip, at = "", to
            ends = skip == "head" and not closing and name and name not in IN_HEAD
            ends = ends or (skip in OPTIONS and name and name not in OPTIONS)
            if not ends:
                continue
            skip, at = "", match.start()  # elements whose end tag may be left out
        text(source[at : match.start()])
        at = to
        if raw:
            at = to = after(name, to)
            continue
        if not name:
            continue
        if name in BLOCK:
            current = None
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in HIDDEN:
            if not match[3].rstrip().endswith("/"):
                skip = name
            continue
        if name in VOID:
            if name == "br":
                text(" ")
            continue
        if name in CLOSES_P or name == "li":
            for i in range(len(stack) - 1, 0, -1):
                open_ = stack[i][0]
                if open_ == "p" or open_ == name == "li":
                    del stack[i:]
                    break
                if open_ in BLOCK:
                    break
        _, path, furniture, main, inside = stack[-1]
        names = [x.lower() for m in _NAMES.finditer(match[3]) for x in m.groups()[1:] if x] if match[3] else []
        if furniture == BY_WORDS and name in MAIN:
            furniture, inside = 0, inside or name == "article"
        if not furniture:
            if name in FURNITURE or (name == "header" and not main):
                furniture = BY_NAME
            elif name not in HOLDERS and any(_LAST.search(w)[0] in FURNITURE_WORDS for n in names for w in n.split()):
                furniture = BY_WORDS
        elif name in FURNITURE:
            furniture = BY_NAME
        main = main or name in MAIN
        deeper = path if path.count(">") >= DEPTH else f"{path}>{name}" + _style(name, names)
        if not match[3].rstrip().endswith("/") or name in BLOCK:
            stack.append((name, deeper, furniture, main, inside))
    if not skip:
        rest = source[at:]
        text(rest[: rest.find("<")] if re.search(r"<[a-zA-Z/!?]", rest) else rest)
    kept = []
    for block in out:
        block.text = " ".join(html.unescape("".join(block.parts)).split())
        if block.text:
            kept.append(block)
    if any(b.main and not b.inside for b in kept):
        kept = [b for b in kept if not b.inside]
    return kept


def _style(name: str, names: list[str]) -> str:
    """The classes, ids and roles of an element that its host's pages may share: none of a page as a whole, and none with a number."""
    if name in ("html", "body"):
        return ""
    return "".join("." + n for n in sorted(names) if not any(c.isdigit() for c in n))


def main_text(source: str, low: frozenset[str] = frozenset()) -> str:
    """The blocks outside the branches `low`, in the main part alone where the page marks one.

    Where that leaves nothing, the branches stay.
    """
    blocks = blocks_of(source)
    if any(b.main for b in blocks):
        blocks = [b for b in blocks if b.main]
    if low:
        blocks = [b for b in blocks if not any(p in low for p in _branches(b.path))] or blocks
    return "\n".join(b.text for b in blocks)


def _branches(path: str) -> list[str]:
    """The path and its ancestors but the root."""
    parts = path.split(">")
    return [">".join(parts[: i + 1]) for i in range(2, len(parts))] or [path]


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, branch, kind, value): text blocks (kind 0) and element sequences (kind 1) below each branch."""
    held: list[tuple] = []
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())

    def flush() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["host", "page", "branch", "kind", "value"]
        )

    def digest(value: str) -> int:
        return xxhash.xxh3_64_intdigest(value.encode("utf-8", "replace")) - (1 << 63)

    for host, source in text_rows(batches, "host", "html"):
        blocks = blocks_of(source or "")
        if not blocks:
            continue
        page = digest(source)
        below: dict[str, list[str]] = {}
        for block in blocks:
            value = digest(block.text)
            for branch in _branches(block.path):
                held.append((host, page, branch, 0, value))
                below.setdefault(branch, []).append(block.path)
        held += [(host, page, branch, 1, digest("\n".join(paths))) for branch, paths in below.items()]
        if len(held) >= 50_000:
            yield flush()
            held = []
    yield flush()


def style_trees(pages: DataFrame) -> DataFrame:
    """host, branch, pages, importance of the merged tree of every host, from pages (host, html)."""
    nodes = stage(pages.mapInArrow(_nodes, "host string, page long, branch string, kind int, value long").distinct(), "html_nodes")
    # A value on c of m pages: content that repeats has the entropy log c / log m, presentations have shares c / m.
    values = nodes.groupBy("host", "branch", "kind", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    text, look = F.col("kind") == 0, F.col("kind") == 1
    sums = values.groupBy("host", "branch").agg(
        F.sum(F.when(look, F.col("c"))).alias("m"),  # a page has one presentation of a branch
        F.avg(F.when(text, F.log("c"))).alias("repeats"),
        F.sum(F.when(look, F.col("c") * F.log("c"))).alias("alike"),
    ).where("m > 1")
    content = 1 - F.col("repeats") / F.log("m")
    looks = 1 - F.col("alike") / (F.col("m") * F.log("m"))
    return sums.select("host", "branch", F.col("m").cast("long").alias("pages"), F.greatest(content, looks).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text.

    Blocks are joined by a line feed; white space inside one becomes one space, character
    references are decoded. A null or empty page has an empty text. Null urls share a
    host. A page all of whose branches are cut keeps them. Repeated rows are repeated and
    count once in the statistics; an empty table gives no rows; other columns are ignored.
    """
    pages = columns_of(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    trees = style_trees(pages.select("host", "html"))
    # Branches are chains of elements: a host has few, however many pages.
    low = trees.where((F.col("pages") >= PAGES) & (F.col("importance") < IMPORTANCE))
    low = stage(low.groupBy("host").agg(F.collect_set("branch").alias("low")), "html_low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s or "", frozenset(x or ())) for s, x in text_rows([batch], "html", "low")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = pages.join(low, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "low")
    return joined.mapInArrow(run, "page_id long, url string, text string")
