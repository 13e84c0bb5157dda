"""Positions inside one text: finding matches, overlaps, merging.

Every position counts code points and every range is half-open. A text is one row, so all of this
stays inside the row: arrays of structs and higher-order functions, never a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.settings import SPAN_ARRAY

OPEN, CLOSE = "\u0001", "\u0002"
WHITE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def lead(text: Column) -> Column:
    """How many white characters a text starts with."""
    return F.char_length(text) - F.char_length(F.ltrim(text, F.lit(WHITE)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates a value once per row and uses it many times in one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fence(value: Column) -> Column:
    """A finished value: later filters read it instead of repeating its definition.

    Spark pushes a filter below a projection by copying the projected expression into it. For a column
    built by higher-order functions over other such columns that would run the work again, once per
    element. A projection that also reads the partition number is left in place.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def unfold(df: DataFrame, keys: list[str], array: Column | str) -> DataFrame:
    """One row per struct of an array column, its fields as columns; the first field is never null.

    The outer form is used because the inner one makes Spark evaluate the array twice (a filter on its size).
    """
    out = df.select(*keys, F.inline_outer(array))
    return out.filter(F.col(out.columns[len(keys)]).isNotNull())


def unmarked(text: Column) -> Column:
    """The text with the two marker characters replaced, so marks put in later are the only ones."""
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)),
                  F.translate(text, OPEN + CLOSE, "\u0003\u0003")).otherwise(text)


def marked_pieces(text: Column, pattern: Column | str) -> Column:
    """The text cut at every match: gap, match, gap, match, …, gap."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(unmarked(text), pattern, F.lit(OPEN + "$0" + CLOSE))
    return F.split(marked, f"[{OPEN}{CLOSE}]")


#: Values a running sum adds up by appending before it goes on with the next block.
BLOCK = 32


def running(values: Column, levels: int = 2) -> Column:
    """For each of an array's integers, the sum of those before it.

    Appending to an array in a fold copies it each time. So blocks of BLOCK values are summed first, those sums are run
    over in the same way, and each block then only appends within itself: for millions of values the work per value hardly grows.
    """
    def grow(block: Column, offset: Column) -> Column:
        start = F.struct(offset.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc["out"])

    if not levels:
        return grow(values, F.lit(0))

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")),
                          lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        return let(cut, lambda b: F.flatten(F.zip_with(b, running(F.transform(
            b, lambda x: F.aggregate(x, F.lit(0), lambda acc, one: acc + one)), levels - 1), grow)))

    return let(values, blocks)


def starts_of(pieces: Column) -> Column:
    """Start position of each piece when the pieces are laid end to end."""
    return running(F.transform(pieces, lambda p: F.char_length(p)))


def with_starts(pieces: Column) -> Column:
    """array<struct<start,text>> of pieces laid end to end."""
    return F.arrays_zip(starts_of(pieces).alias("start"), pieces.alias("text"))


def find_spans(text: Column, pattern: Column | str, known: bool = False) -> Column:
    """Every match as (start, end, text), surrounding white space trimmed, blank matches dropped.

    ``known`` says the caller has already seen the pattern match, so it is not tested again.
    """
    def placed(pieces: Column) -> Column:
        # pieces alternate between gap and match; matches without their white space, blank ones left out
        def span(x: Column) -> Column:
            at, body = x["start"] + lead(x["text"]), strip(x["text"])
            return F.struct(at.alias("start"), (at + F.char_length(body)).alias("end"), body.alias("text"))

        matches = F.filter(with_starts(pieces), lambda x, i: (i % 2 == 1) & (strip(x["text"]) != ""))
        return F.transform(matches, span)

    found = let(marked_pieces(text, pattern), placed).cast(SPAN_ARRAY)
    if known:
        return found
    matches = text.rlike(pattern) if isinstance(pattern, str) else F.rlike(text, pattern)
    return F.when(matches, found).otherwise(F.array().cast(SPAN_ARRAY))


def cut_out(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def touches(a: Column, b: Column) -> Column:
    return overlaps(a["start"], a["end"], b["start"], b["end"])


def positions_of(text: Column, needle: Column) -> Column:
    """Start of every occurrence of a needle, overlapping ones included; case is the caller's matter.

    A zero-width look-ahead match is put before each occurrence, so overlaps are kept.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    marked = F.regexp_replace(unmarked(text), quoted, F.lit(OPEN))
    starts = starts_of(F.split(marked, OPEN))
    hit = (F.char_length(needle) > 0) & F.contains(text, needle)
    return F.when(hit, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))).otherwise(
        F.array().cast("array<int>"))


def fold_overlapping(sorted_items: Column, kind: str, combine: Callable[[Column, Column], Column],
                     touching: bool = False) -> Column:
    """Merges neighbours of a start-ordered array whose ranges overlap (or touch).

    ``combine(last, item)`` builds the merged struct. The array is the evidence of one text: short.
    """
    def step(acc: Column, item: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = (item["start"] <= last["end"]) if touching else (item["start"] < last["end"])
        return F.when((F.size(acc) > 0) & F.coalesce(joined, F.lit(False)),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(combine(last, item)).cast(kind))
                      ).otherwise(F.concat(acc, F.array(item).cast(kind)))

    return F.aggregate(sorted_items, F.array().cast(kind), step)


def by_start(items: Column) -> Column:
    """Stable order by start position."""
    indexed = F.transform(items, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(indexed, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                                    .otherwise(a["i"] - b["i"])), lambda s: s["x"])


def ordered_union(a: Column, b: Column) -> Column:
    """Distinct values, first occurrence first."""
    return F.array_distinct(F.concat(a, b))
