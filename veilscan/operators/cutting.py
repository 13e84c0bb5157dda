"""Turning evidence into cuts, the cleaned text, and positions back in the original. All inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.spans import (by_start, cut_out, fold_overlapping, let, ordered_union, overlaps, positions_of,
                                      strip, touches)
from veilscan.operators.evidence import addresses
from veilscan.settings import CUT_ARRAY, OUTSIDE_TYPE, empty

SEGMENTS = "array<struct<d:int,o:int,n:int>>"


def make_cut(start: Column, end: Column, types: Column, found_by: Column, rules: Column | None = None,
             strong_rule: Column | None = None) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), types.alias("types"), found_by.alias("found_by"),
                    (F.array().cast("array<string>") if rules is None else rules).alias("rules"),
                    (F.lit(False) if strong_rule is None else strong_rule).alias("strong_rule"))


def widen_to_sentence(content: Column, units: Column, start: Column, end: Column, neighbours: bool = False) -> Column:
    """The units a range touches (and the ones either side, if asked), as struct<start,end>.

    A single unit of several lines, a header block, is narrowed to the touched lines instead.
    """
    touched = F.filter(units, lambda u: overlaps(u["start"], u["end"], start, end))

    def grown(hit: Column) -> Column:
        if not neighbours:
            return hit
        return F.filter(units, lambda u: (F.size(hit) > 0) & (u["unit_no"] >= F.get(hit, F.lit(0))["unit_no"] - 1)
                        & (u["unit_no"] <= F.get(hit, F.size(hit) - 1)["unit_no"] + 1))

    def box(hit: Column) -> Column:
        lo, hi = F.get(hit, F.lit(0))["start"], F.get(hit, F.size(hit) - 1)["end"]
        header = (F.size(hit) == 1) & F.contains(cut_out(content, lo, hi), F.lit("\n"))
        line_start = start - F.char_length(F.substring_index(F.substring(content, F.lit(1), start), "\n", -1))
        newline = F.call_function("locate", F.lit("\n"), content, end + 1)
        line_end = F.when(newline > 0, newline - 1).otherwise(F.char_length(content))
        return F.struct(
            F.when(F.size(hit) == 0, start).otherwise(F.least(F.when(header, line_start).otherwise(lo), start)).alias("start"),
            F.when(F.size(hit) == 0, end).otherwise(F.greatest(F.when(header, line_end).otherwise(hi), end)).alias("end"))

    return let(touched, lambda hit: let(grown(hit), box))


def payload_sweep(content: Column, units: Column, cuts: Column) -> Column:
    """Cuts, plus the sentences elsewhere that carry an address found inside a cut."""
    def candidates(low: Column) -> Column:
        return F.flatten(F.transform(cuts, lambda c: F.flatten(F.transform(
            F.array_distinct(addresses(cut_out(content, c["start"], c["end"]))),
            lambda a: F.transform(positions_of(low, F.lower(a)), lambda p: F.struct(
                p.alias("start"), (p + F.char_length(a)).alias("end"), c["types"].alias("types")))))))

    def step(acc: Column, x: Column) -> Column:
        inside = F.exists(acc, lambda c: (c["start"] <= x["start"]) & (x["start"] < c["end"]))
        box = widen_to_sentence(content, units, x["start"], x["end"])
        return F.when(inside, acc).otherwise(F.concat(acc, F.array(let(box, lambda b: make_cut(
            b["start"], b["end"], x["types"], F.array(F.lit("payload sweep"))))).cast(CUT_ARRAY)))

    return F.when(F.exists(cuts, lambda c: cut_out(content, c["start"], c["end"]).rlike("@|https?://")), F.aggregate(
        let(F.lower(content), candidates), cuts.cast(CUT_ARRAY), step)).otherwise(cuts)


def merge_cuts(cuts: Column) -> Column:
    return fold_overlapping(by_start(cuts), CUT_ARRAY, lambda a, b: make_cut(
        a["start"], F.greatest(a["end"], b["end"]), ordered_union(a["types"], b["types"]),
        ordered_union(a["found_by"], b["found_by"]), F.array_sort(F.array_union(a["rules"], b["rules"])),
        a["strong_rule"] | b["strong_rule"]))


def cut_label(types: Column) -> Column:
    shown = F.transform(F.filter(types, lambda t: t != OUTSIDE_TYPE), lambda t: F.replace(t, F.lit("_"), F.lit(" ")))
    return F.concat(F.lit("[removed: "), F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise(
        F.lit("suspected injection")), F.lit("]"))


def kept_parts(content: Column, cuts: Column) -> Column:
    """The text between merged cuts, the tail included, as array<struct<start,text>>."""
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.char_length(content)))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct(
        x["a"].alias("start"), cut_out(content, x["a"], x["b"]).alias("text")))


def apply_cuts(content: Column, cuts: Column) -> Column:
    """struct<text, detect, segments>: marked text, kept text alone, and where its parts came from."""
    def build(kept: Column) -> Column:
        text = F.array_join(F.transform(kept, lambda k, i: F.concat(
            k["text"], F.when(i < F.size(cuts), cut_label(F.get(cuts, i)["types"])).otherwise(F.lit("")))), "")
        solid = F.filter(kept, lambda k: strip(k["text"]) != "")
        segments = F.aggregate(solid, F.struct(F.lit(0).alias("d"), F.array().cast(SEGMENTS).alias("found")),
                               lambda acc, k: F.struct(
            (acc["d"] + F.char_length(k["text"]) + 1).alias("d"), F.concat(acc["found"], F.array(F.struct(
                acc["d"].alias("d"), k["start"].alias("o"), F.char_length(k["text"]).alias("n"))).cast(SEGMENTS)
            ).alias("found")), lambda acc: acc["found"])
        return F.struct(text.alias("text"), F.array_join(F.transform(solid, lambda k: k["text"]), "\n").alias("detect"),
                        segments.alias("segments"))

    return let(kept_parts(content, cuts), build)


def to_original(pos: Column, segments: Column) -> Column:
    """A kept-text position in the original; one past every segment maps to the end of the last."""
    inside = F.filter(segments, lambda s: (s["d"] <= pos) & (pos < s["d"] + s["n"]))
    last = F.get(segments, F.size(segments) - 1)
    return F.when(F.size(inside) > 0, F.get(inside, F.lit(0))["o"] + pos - F.get(inside, F.lit(0))["d"]).otherwise(
        F.coalesce(last["o"] + last["n"], F.lit(0)))


def span_to_original(start: Column, end: Column, segments: Column) -> Column:
    return F.struct(to_original(start, segments).alias("start"),
                    (to_original(F.greatest(start, end - 1), segments) + 1).alias("end"))


def removed_text(content: Column, cuts: Column) -> Column:
    return F.transform(cuts, lambda c: cut_out(content, c["start"], c["end"]))


def strip_cuts(content: Column, cuts: Column) -> Column:
    """The text with cuts taken out and no marks, overlapping cuts allowed."""
    merged = fold_overlapping(by_start(F.transform(cuts, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end")))), "array<struct<start:int,end:int>>",
        lambda a, b: F.struct(a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end")), touching=True)
    return F.array_join(F.transform(let(merged, lambda m: kept_parts(content, m)), lambda k: k["text"]), "")
