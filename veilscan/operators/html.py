"""What a page shows and what it hides.

A page is read once from left to right in an Arrow batch: tags attribute by attribute, a stack of open elements with the
places of each name, so that every element is pushed and popped once and a hidden one ends where a browser would end it.
Shown text keeps its place: every hidden character becomes a filler of the same length, so positions in the masked page
are positions in the page. What follows, the shown text and its positions, is columns again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from veilscan.functions.spans import fence, marked_pieces, starts_of
from veilscan.functions.text import in_slices

# Fixed values ---------------------------------------------------------------------------------
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BLOCK = ["address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure",
         "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p",
         "pre", "section", "table", "td", "th", "title", "tr", "ul"]
HIDDEN_TAGS = ["noscript", "template"]
TEXT_ATTRIBUTES = ["alt", "title", "aria-label", "placeholder"]
HIDDEN_STYLE = (r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$|!)|"
                r"font-size\s*:\s*0(?:\.\d+)?(?:px|pt|em|rem|%)?\s*(?:;|$|!)|"
                r"(?:left|top|text-indent|margin-left)\s*:\s*-\d{3,}|"
                r"(?<![-\w])color\s*:\s*(?:#fff(?:fff)?\b|white\b|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))")
# End of fixed values --------------------------------------------------------------------------
FILL, BREAK = "\u0004", "\u0005"
NAME = re.compile(r"[A-Za-z][^\s/>]*")
BETWEEN = re.compile(r"[\s/]*")
#: One attribute: its name, and its value if it has one.
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)")
HIDES = re.compile(HIDDEN_STYLE, re.IGNORECASE)
READ = T.StructType([T.StructField("layers", T.ArrayType(T.StructType([
    T.StructField(n, t) for n, t in [("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("text", T.StringType()),
                                     ("depth", T.IntegerType()), ("hidden", T.BooleanType())]]))), T.StructField("shown", T.StringType())])


def known_reference(ref: str) -> tuple[str, int]:
    """What a character reference stands for and how much of it that takes. Without a semicolon the longest known name counts;
    what stands for nothing is left as it is."""
    if ref[1] == "#":
        return unescape(ref), len(ref)
    for k in range(len(ref), 2, -1):
        if ref[1:k] in html5:
            return html5[ref[1:k]], k
    return ref, len(ref)


def decoded(text: str, keep_length: bool = False) -> str:
    """Character references decoded; with ``keep_length`` each takes the place it had, the rest of it filler."""
    def said(m: re.Match) -> str:
        meant, used = known_reference(m[0])
        return meant + FILL * (used - len(meant) if keep_length else 0) + m[0][used:]

    return REFERENCE.sub(said, text) if "&" in text else text


def attributes(page: str, at: int) -> tuple[dict[str, tuple[int, str]], int]:
    """(first value of each attribute with its place, where the tag ends or -1). One attribute is read at a time; a quote
    that nothing closes is a character of a name."""
    found: dict[str, tuple[int, str]] = {}
    while (at := BETWEEN.match(page, at).end()) < len(page):
        if page[at] == ">":
            return found, at + 1
        m = ATTRIBUTE.match(page, at)
        if m and m.lastindex > 1:
            found.setdefault(m[1].lower(), (m.start(m.lastindex), m[m.lastindex]))
        elif m:
            found.setdefault(m[1].lower(), (m.end(), ""))
        at = m.end() if m else at + 1
    return found, -1


class Page:
    """Reads one page, piece by piece: a stack of open elements, the outermost hidden one, and the page as shown."""

    def __init__(self, page: str):
        self.page, self.shown, self.layers = page, [], []
        self.stack: list[str] = []
        self.places: dict[str, list[int]] = {}  # of each name's open elements in the stack
        self.hidden = -1  # place of the outermost hidden element in the stack
        self.hidden_start, self.hidden_text = 0, []

    def layer(self, kind: str, start: int, end: int, text: str) -> None:
        tidy = " ".join("".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf").split())
        if tidy.count(" ") >= 2 and any(c.isalpha() for c in tidy):
            self.layers.append({"kind": kind, "start": start, "end": end, "text": tidy, "depth": 1, "hidden": True})

    def unseen(self, start: int, end: int, name: str = "") -> None:
        """A piece that is not shown; a block's tag breaks the line."""
        breaks = name in BLOCK and self.hidden < 0
        self.shown.append((BREAK if breaks else FILL) + FILL * (end - start - 1) if end > start else "")

    def text(self, start: int, end: int) -> None:
        piece = self.page[start:end]
        if self.hidden >= 0:
            self.hidden_text.append(decoded(piece))
            self.unseen(start, end)
        else:
            self.shown.append(decoded(piece.translate({4: 3, 5: 3}), keep_length=True))

    def comment(self, start: int, end: int) -> None:
        body = self.page[start + 4:end].removesuffix("-->")
        if self.hidden >= 0:
            self.hidden_text.append(body)
        else:
            self.layer("html_comment", start, end, body)
        self.unseen(start, end)

    def start_tag(self, name: str, found: dict[str, tuple[int, str]], start: int, end: int) -> None:
        self.unseen(start, end, name)
        read = [a for a in TEXT_ATTRIBUTES if found.get(a, (0, ""))[1]]
        if name == "meta" and found.get("content", (0, ""))[1] and ("name" in found or "property" in found):
            read.append("content")
        for at, value in (found[a] for a in read):
            if self.hidden >= 0:
                self.hidden_text.append(decoded(value))
            else:
                self.layer("html_attribute", at, at + len(value), decoded(value))
        if name in VOID or self.page.endswith("/>", start, end):
            return
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(name)
        style, aria = (decoded(found.get(a, (0, ""))[1]) for a in ("style", "aria-hidden"))
        if self.hidden < 0 and (name in HIDDEN_TAGS or "hidden" in found or aria.strip().lower() == "true" or HIDES.search(style)):
            self.hidden, self.hidden_start, self.hidden_text = len(self.stack) - 1, start, []

    def end_tag(self, name: str, start: int, end: int) -> None:
        known = bool(self.places.get(name))
        if known:  # it also closes what was opened inside
            keep = self.places[name][-1]
            while len(self.stack) > keep:
                self.places[self.stack.pop()].pop()
            if self.hidden >= keep:
                self.close_hidden(end)
        self.unseen(start, end, name if known else "")

    def close_hidden(self, end: int) -> None:
        self.layer("html_hidden", self.hidden_start, end, " ".join(self.hidden_text))
        self.hidden, self.hidden_text = -1, []

    def read(self) -> dict:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            start = page.find("<", at)
            if start < 0:
                start = n
            follows = page[start + 1:start + 2]
            if follows == "/" and page[start + 2:start + 3].isascii() and page[start + 2:start + 3].isalpha():
                kind = "end"
            elif follows in ("!", "?") and follows:
                kind = "comment" if page.startswith("<!--", start) else "other"
            elif follows.isascii() and follows.isalpha():
                kind = "start"
            else:  # a sign in the text, or the end
                at_next = min(start + 1, n)
                self.text(at, at_next)
                at = at_next
                continue
            if start > at:
                self.text(at, start)
            at = self.piece(kind, start)
        if self.hidden >= 0:  # an unclosed element runs to the end
            self.close_hidden(n)
        return {"layers": self.layers, "shown": "".join(self.shown)}

    def piece(self, kind: str, start: int) -> int:
        """Reads the comment or tag that begins here and returns where it ends; a tag without an end is text to the last."""
        page, n = self.page, len(self.page)
        if kind == "comment":
            end = page.find("-->", start + 4) + 3
            end = end if end > 2 else n
            self.comment(start, end)
            return end
        if kind == "start":
            name = NAME.match(page, start + 1)
            found, end = attributes(page, name.end())
            if end < 0:
                self.text(start, n)
                return n
            tag = name[0].lower()
            if tag not in ("script", "style"):
                self.start_tag(tag, found, start, end)
                return end
            close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, end)
            end = close.end() if close else n
            self.unseen(start, end)
            return end
        end = page.find(">", start) + 1
        if not end:
            self.text(start, n)
            return n
        if kind == "end":
            self.end_tag(NAME.match(page, start + 2)[0].lower(), start, end)
        else:
            self.unseen(start, end)
        return end


@F.arrow_udf(READ)
def read_page(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """struct<layers,shown>: hidden layers, and the page with everything unseen replaced by filler. One pass over each page;
    what is held at a time are the pages of a slice, whatever a batch holds."""
    for batch in batches:
        for pages in in_slices(batch):
            yield pa.array([Page(page.as_py()).read() if page.is_valid else None for page in pages], to_arrow_type(READ))


GAPS = r"[\s\u0004\u0005]+"


def visible_text(pieces: Column) -> Column:
    """The shown text: one space per white run, one newline where a block starts or ends."""
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).when(
        (i == 1) & (F.get(pieces, F.lit(0)) == ""), "").when(F.contains(p, F.lit(BREAK)), "\n").when(p.rlike(r"\s"), " ").otherwise("")), "")


def visible_origin(pieces: Column) -> Column:
    """For each character of the shown text, its position in the page."""
    placed = F.arrays_zip(starts_of(pieces).alias("at"), pieces.alias("piece"))
    none = F.array().cast("array<int>")
    return F.flatten(F.transform(placed, lambda p, i: F.when(p["piece"] == "", none).when(
        i % 2 == 0, F.sequence(p["at"], p["at"] + F.char_length(p["piece"]) - 1)).when(
        (i == 1) & (F.get(pieces, F.lit(0)) == ""), none).when(p["piece"].rlike(r"[\s\u0005]"), F.array(p["at"])).otherwise(none)))


def pages_read(pages: DataFrame, html: Column) -> DataFrame:
    """Adds ``_page`` (layers, shown) and ``_pieces`` to a table of pages."""
    df = pages.withColumn("_page", read_page(html))
    return df.withColumn("_pieces", fence(marked_pieces(F.col("_page.shown"), GAPS)))


def html_front_end(items: DataFrame, content: Column | None = None) -> DataFrame:
    df = pages_read(items, F.col("content") if content is None else content)
    return df.withColumn("base", fence(visible_text(F.col("_pieces")))).withColumn("base_origin", fence(visible_origin(F.col("_pieces")))) \
        .withColumn("hidden_layers", F.col("_page.layers")).drop("_page", "_pieces")


def html_visible(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages_read(pages, F.col(html)).select(key, visible_text(F.col("_pieces")).alias("visible"))


def html_hidden_layers(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per hidden part of a page: comments, hidden elements, read-only attributes."""
    return pages_read(pages, F.col(html)).select(key, F.inline_outer("_page.layers")).filter("kind IS NOT NULL")
