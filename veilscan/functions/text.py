"""Reading views of one text: invisible characters, look-alike letters, encoded runs, sentences."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.spans import OPEN, WHITE, cut_out, find_spans, lead, let, marked_pieces, starts_of, strip, unmarked, with_starts
from veilscan.settings import LAYER_ARRAY, MAX_DECODE_DEPTH, SPAN_ARRAY, UNIT_ARRAY, empty

# Fixed values ---------------------------------------------------------------------------------
LOOK_ALIKES = "аеорсухіјѕԁӏһԛԝАВЕКМНОРСТХУІЈЅαορνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN_TWINS = "aeopcyxijsdlhqwABEKMHOPCTXYIJSaopviktuABEZHIKMNOPTYX"
SPACED_LETTERS = r"(?U)(?<!\w)\w(?: \w){2,}(?!\w)"
BASE64_RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/=_-])"
HEX_RUN = r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){8,}(?![0-9A-Fa-f])"
HEADER_LINES = r"^\n*(?:[^\S\n]*[A-Za-z][A-Za-z-]{0,30}:[ \t][^\n]*(?:\n+|$))+"
SENTENCE_END = (r"(?md)(?=[.!?])(?<!(?:^|\s)(?:\d{1,3}|[A-Za-z]|e\.g|i\.e|etc|Mr|Mrs|Ms|Dr|vs|No)(?=\.\s))"
                r"[.!?]+[\"')\]]*(?=\s)|\n")
TAG_RUN = r"[\x{E0000}-\x{E007F}]+"
SELECTOR_RUN = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]+"
NOT_PRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^\n\t ]]"
# End of fixed values --------------------------------------------------------------------------


def strip_invisible(text: Column) -> Column:
    """The text without format characters (zero-width, direction marks, soft hyphens)."""
    return F.regexp_replace(text, r"\p{Cf}", "")


def invisible_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(strip_invisible(text))


def may_need_view(text: Column) -> Column:
    """Whether a text holds characters outside ASCII and the ordinary accented letters.

    Two ranges, so the test is cheap; what it lets through is settled exactly by the helper below.
    """
    return text.rlike(r"[\x{A0}-\x{BE}\x{132}-\x{10FFFF}]")


VIEW = T.StructType([T.StructField("text", T.StringType()),
                     T.StructField("origin", T.ArrayType(T.IntegerType()))])


DROPPED = "[\u00AD\u0600-\u0605\u061C\u06DD\u070F\u0890\u0891\u08E2\u180E\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u206F" \
          "\uFE00-\uFE0F\uFEFF\uFFF9-\uFFFB\U000110BD-\U000E01EF]"


#: Characters of text whose views a task holds at a time, about; a longer text is a slice of its own.
SLICE_CHARS = 1 << 21


def in_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about SLICE_CHARS bytes, so that what a task holds does not grow with the rows or texts of a batch."""
    at, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
        if i > at and held + size > SLICE_CHARS:
            yield texts.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(texts):
        yield texts.slice(at)


def _kept(text: str | None) -> Iterator[tuple[str, int]] | None:
    """Characters of the compatibility form with their places; None for a text that is in that form."""
    if text is None or (unicodedata.is_normalized("NFKC", text) and not re.search(DROPPED, text)):
        return None
    return ((c, i) for i, ch in enumerate(text)
            if unicodedata.category(ch) != "Cf" and not 0xFE00 <= ord(ch) <= 0xFE0F and not 0xE0100 <= ord(ch) <= 0xE01EF
            for c in (ch if ch < "\x80" else unicodedata.normalize("NFKC", ch)))


@F.arrow_udf(VIEW)
def compatibility_view(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Drops invisible and selector characters and NFKC-normalises the rest, one character at a time.

    ``origin[i]`` is where view character i came from. Spark has no NFKC function; only texts that may
    hold an affected character reach this helper, and ones already in normal form come back as null.
    """
    def view(texts: pa.Array) -> pa.Array:
        views, places, ends = [], array("i"), [0]
        for text in texts:
            kept = _kept(text.as_py())
            chars = None if kept is None else []
            for c, i in kept or ():
                chars.append(c)
                places.append(i)
            views.append(None if kept is None else "".join(chars))
            ends.append(len(places))
        none = np.array([v is None for v in views], bool)
        starts = pa.array(np.array(ends, np.int32), mask=np.append(none, False))
        origin = pa.ListArray.from_arrays(starts, pa.array(np.frombuffer(places, np.int32), pa.int32()))
        return pa.StructArray.from_arrays([pa.array(views, pa.string()), origin], names=["text", "origin"])

    for batch in batches:
        yield from map(view, in_slices(batch))


@F.arrow_udf(T.StringType())
def compatibility_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The text of ``compatibility_view`` alone."""
    def view(texts: pa.Array) -> pa.Array:
        return pa.array([None if (kept := _kept(t.as_py())) is None else "".join(c for c, _ in kept) for t in texts], pa.string())

    for batch in batches:
        yield from map(view, in_slices(batch))


def nfkc(text: Column) -> Column:
    """Compatibility form of a text, character by character, invisible characters dropped."""
    return F.coalesce(compatibility_text(F.when(may_need_view(text), text)), text)


def _twin(word: Column) -> Column:
    return F.translate(word, LOOK_ALIKES, LATIN_TWINS)


OTHER_ALPHABETS = "[\u0370-\u052F]"  # one range holds every look-alike: a cheap test before the word pattern
# Only tried where a word begins: one that fails there fails at its later letters too. The range goes first, so that most letters
# are told apart by it and not by each look-alike in turn.
MIXED_WORD = r"(?U)(?<!\w)(?=\w*?[\x{370}-\x{52F}&&[" + LOOK_ALIKES + r"]])(?=\w*?[A-Za-z])\w++"


def fold_confusables(text: Column) -> Column:
    """Look-alike letters become Latin, only in words that also hold a Latin letter. Length is kept."""
    pieces = marked_pieces(text, MIXED_WORD)
    folded = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, _twin(p)).otherwise(p)), "")
    return F.when(text.rlike(OTHER_ALPHABETS), folded).otherwise(text)


def confusable_words(text: Column) -> Column:
    """How many words mix look-alike letters with Latin ones."""
    return F.when(text.rlike(OTHER_ALPHABETS), F.regexp_count(text, F.lit(MIXED_WORD))).otherwise(F.lit(0))


def looks_like_text(s: Column) -> Column:
    body = strip(s)
    printable = F.char_length(F.regexp_replace(s, NOT_PRINTABLE, ""))
    return ((F.char_length(body) >= 4) & s.rlike(r"\p{L}") & F.contains(body, F.lit(" "))
            & (printable * 10 >= F.char_length(s) * 9))


def _code(ch: Column) -> Column:
    return F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int")


def tag_text(run: Column) -> Column:
    """What a run of tag characters spells."""
    chars = F.transform(F.split(run, ""), lambda c: _code(c) - 0xE0000)
    shown = F.filter(chars, lambda c: (c >= 0x20) & (c <= 0x7E))
    return F.array_join(F.transform(shown, lambda c: F.char(c)), "")


def selector_text(run: Column) -> Column:
    """The bytes a run of four or more variation selectors carries, as text; bad bytes are dropped."""
    codes = F.transform(F.split(run, ""), lambda c: _code(c))
    data = F.array_join(F.transform(
        codes, lambda c: F.lpad(F.hex(F.when(c <= 0xFE0F, c - 0xFE00).otherwise(c - 0xE0100 + 16)), 2, "0")), "")
    text = F.replace(F.make_valid_utf8(F.unhex(data).cast("string")), F.lit("�"), F.lit(""))
    return F.when(F.char_length(run) >= 4, text).otherwise(F.lit(""))


def _layer(kind: Column | str, span: Column, text: Column, depth: int = 1) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), text.alias("text"),
                    F.lit(depth).alias("depth"), F.lit(False).alias("hidden"))


def _readable(layers: Column) -> Column:
    return F.filter(layers, lambda x: x["text"].isNotNull() & looks_like_text(x["text"]))


def _runs(text: Column, pattern: str, kind: str, decode) -> Column:
    found = _readable(F.transform(find_spans(text, pattern), lambda s: _layer(kind, s, decode(s["text"]))))
    return F.when(text.rlike(pattern), found).otherwise(empty(LAYER_ARRAY)).cast(LAYER_ARRAY)


def decode_unicode_tags(text: Column) -> Column:
    return _runs(text, TAG_RUN, "unicode_tags", tag_text)


def decode_variation_selectors(text: Column) -> Column:
    return _runs(text, SELECTOR_RUN, "variation_selectors", selector_text)


def _utf8(data: Column) -> Column:
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def base64_text(token: Column) -> Column:
    """Strict decode of the standard or url-safe alphabet, null when it is not valid UTF-8."""
    body = F.rtrim(token, F.lit("="))
    extra = F.char_length(token) - F.char_length(body)
    rest = F.char_length(body) % 4
    sound = ((rest == 0) & (extra == 0)) | (rest == 2) | ((rest == 3) & (extra <= 1))
    padded = F.concat(F.translate(body, "-_", "+/"), F.repeat(F.lit("="), (4 - rest) % 4))
    return F.when(sound, _utf8(F.unbase64(padded)))


def hex_text(token: Column) -> Column:
    return _utf8(F.unhex(token))


def decode_base64_runs(text: Column) -> Column:
    return _runs(text, BASE64_RUN, "base64", base64_text)


def decode_hex_runs(text: Column) -> Column:
    return _runs(text, HEX_RUN, "hex", hex_text)


def decode_runs(text: Column) -> Column:
    """Base64 and hex runs, and runs inside those; an inner run keeps its outer run's position."""
    outer = F.concat(decode_base64_runs(text), decode_hex_runs(text))

    def inside(layer: Column) -> Column:
        deeper = F.concat(decode_base64_runs(layer["text"]), decode_hex_runs(layer["text"]))
        return F.transform(deeper, lambda d: _layer(d["kind"], layer, d["text"], MAX_DECODE_DEPTH))

    nested = F.transform(outer, lambda x: F.concat(F.array(x).cast(LAYER_ARRAY), inside(x).cast(LAYER_ARRAY)))
    return F.when(text.rlike(BASE64_RUN) | text.rlike(HEX_RUN), F.flatten(nested)).otherwise(
        empty(LAYER_ARRAY)).cast(LAYER_ARRAY)


def join_spaced_letters(text: Column) -> Column:
    """'i g n o r e' becomes 'ignore'."""
    pieces = marked_pieces(text, SPACED_LETTERS)
    joined = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(" "), F.lit(""))).otherwise(p))
    return F.when(text.rlike(SPACED_LETTERS), F.array_join(joined, "")).otherwise(text)


def spaced_origin(text: Column) -> Column:
    """For each character of the joined view, its position in the text."""
    pieces = marked_pieces(text, SPACED_LETTERS)
    placed = F.arrays_zip(starts_of(pieces).alias("at"), pieces.alias("piece"))

    def places(p: Column, i: Column) -> Column:
        every = F.transform(F.split(p["piece"], ""), lambda c, k: F.struct(c.alias("c"), (p["at"] + k).alias("at")))
        kept = F.filter(every, lambda x: (x["c"] != "") & ~((i % 2 == 1) & (x["c"] == " ")))
        return F.transform(kept, lambda x: x["at"])

    return F.flatten(F.transform(placed, places))


def unit_pieces(text: Column, is_email: Column) -> Column:
    """An email's header block, then the rest cut after every sentence and line."""
    head = F.when(is_email & text.rlike(r"^\s*[A-Za-z][A-Za-z-]{0,30}:[ \t]"),
                  F.regexp_extract(text, HEADER_LINES, 0)).otherwise(F.lit(""))
    body = F.when(head == "", text).otherwise(F.substring(text, F.char_length(head) + 1, F.char_length(text)))
    return F.concat(F.array(head), F.split(F.regexp_replace(unmarked(body), SENTENCE_END, "$0" + OPEN), OPEN))


def placed_units(pieces: Column) -> Column:
    def unit(x: Column, i: Column) -> Column:
        at, body = x["start"] + lead(x["text"]), strip(x["text"])
        return F.struct(i.alias("unit_no"), at.alias("start"), (at + F.char_length(body)).alias("end"), body.alias("text"))

    return F.transform(F.filter(with_starts(pieces), lambda x: strip(x["text"]) != ""), unit).cast(UNIT_ARRAY)


def split_units(text: Column, is_email: Column) -> Column:
    """Sentences, lines, or an email's header block, with positions in the text."""
    return let(unit_pieces(text, is_email), placed_units)


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_hidden_text(text: Column) -> Column:
    """Concealed text as the detectors read it: NFKC, no invisible characters, single spaces."""
    return collapse_space(nfkc(text))


def worth_reading(text: Column) -> Column:
    """Three words and a letter: shorter hidden text carries no instruction."""
    return (F.size(F.split(strip(text), r"(?U)\s+")) >= 3) & text.rlike(r"\p{L}")


def clean_layers(layers: Column) -> Column:
    """Layers with their text as the detectors read it. The texts of an item are normalised in one string, since the
    normaliser cannot be called inside a higher-order function."""
    joined = nfkc(F.array_join(F.transform(layers, lambda x: F.replace(x["text"], F.lit("\u0006"), F.lit(" "))), "\u0006"))
    cleaned = F.zip_with(layers, F.split(joined, "\u0006", -1), lambda x, t: x.withField("text", collapse_space(t)))
    return F.when(F.size(layers) > 0, F.filter(cleaned, lambda x: worth_reading(x["text"]))).otherwise(layers)


def at_origin(origin: Column, pos: Column) -> Column:
    """Position in the original of a view position; a null origin is the identity."""
    return F.coalesce(F.get(origin, pos), pos)


def to_original(origin: Column, span: Column, kind: str) -> Column:
    """A span struct moved from view to original positions, other fields kept."""
    return span.withField("start", at_origin(origin, span["start"])).withField(
        "end", at_origin(origin, span["end"] - 1) + 1)
