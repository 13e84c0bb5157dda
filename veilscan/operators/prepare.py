"""From raw items to readable views, units and hidden layers. One row per item in and out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import text as X
from veilscan.functions.rules import Rule, hits_in
from veilscan.functions.spans import by_start, cut_out, fence, fold_overlapping
from veilscan.settings import HIT_ARRAY, LAYER_ARRAY, MAX_CHARS, UNIT_ARRAY, empty

RANGE_ARRAY = "array<struct<start:int,end:int>>"


def reject_oversize(items: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Marks items to refuse: empty ones and ones over the limit. Nothing is ever truncated."""
    size = F.char_length("content")
    status = F.when(X.strip(F.coalesce("content", F.lit(""))) == "", 422).when(size > limit, 413).otherwise(200)
    return items.withColumn("status", status).withColumn("chars", F.coalesce(size, F.lit(0)))


def clamp_ranges(text: Column, ranges: Column) -> Column:
    """Ranges inside the text, in start order."""
    n = F.char_length(text)
    return by_start(F.transform(ranges, lambda r: r.withField("start", F.greatest(r["start"], F.lit(0))).withField(
        "end", F.least(r["end"], n))))


def visible_gaps(text: Column, ranges: Column) -> Column:
    """The parts of a text outside every range, as array<struct<start,end>>."""
    spans = F.filter(F.transform(clamp_ranges(text, ranges), lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"))), lambda r: r["end"] > r["start"])
    merged = fold_overlapping(spans, RANGE_ARRAY, lambda a, b: F.struct(
        a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end")), touching=True)
    starts = F.concat(F.array(F.lit(0)), F.transform(merged, lambda r: r["end"]))
    ends = F.concat(F.transform(merged, lambda r: r["start"]), F.array(F.char_length(text)))
    gaps = F.arrays_zip(starts.alias("start"), ends.alias("end"))
    return F.filter(gaps, lambda g: g["end"] > g["start"])


def apply_hidden_ranges(items: DataFrame, ranges: Column | None = None) -> DataFrame:
    """Splits texts with known hidden ranges into ``base`` (visible), ``base_origin`` and ``hidden_layers``."""
    ranges = F.col("hidden") if ranges is None else ranges
    content = F.col("content")
    df = items.withColumn("_gaps", visible_gaps(content, ranges)).withColumn("_ranges", clamp_ranges(content, ranges))
    base = F.array_join(F.transform("_gaps", lambda g: cut_out(content, g["start"], g["end"])), "")
    origin = F.flatten(F.transform("_gaps", lambda g: F.sequence(g["start"], g["end"] - 1)))
    layers = F.transform("_ranges", lambda r: F.struct(
        r["kind"].alias("kind"), r["start"].alias("start"), r["end"].alias("end"),
        cut_out(content, r["start"], r["end"]).alias("text"),
        F.lit(1).alias("depth"), F.lit(True).alias("hidden")))
    return df.withColumn("base", base).withColumn("base_origin", origin).withColumn(
        "hidden_layers", X.clean_layers(fence(layers.cast(LAYER_ARRAY)))).drop("_gaps", "_ranges")


def choose_front_end(items: DataFrame) -> DataFrame:
    """Adds ``base``, ``base_origin`` and ``hidden_layers`` by how each item is formatted: every front end reads the items it is
    for and null in place of the others, so the input is read once."""
    from veilscan.operators.html import html_front_end

    content, none = F.col("content"), F.lit(None).cast("array<int>")
    base, origin, layers = content, none, empty(LAYER_ARRAY)
    is_html = F.coalesce(F.col("format") == "html", F.lit(False)) if "format" in items.columns else F.lit(False)
    df, spent = items, []

    def taken(df: DataFrame, name: str, asked: Column) -> DataFrame:
        nonlocal base, origin, layers
        part = F.col(name)
        base, origin, layers = (F.when(asked, part[field]).otherwise(other) for field, other in (
            ("base", base), ("base_origin", origin), ("hidden_layers", layers)))
        spent.append(name)
        return df.withColumn(name, F.struct("base", "base_origin", "hidden_layers")).drop("base", "base_origin", "hidden_layers")

    if "hidden" in items.columns:
        ranged = (F.size(F.coalesce("hidden", F.array())) > 0) & ~is_html
        df = taken(apply_hidden_ranges(df, F.when(ranged, F.col("hidden"))), "_ranged", ranged)
    if "format" in items.columns:
        df = taken(html_front_end(df, F.when(is_html, content)), "_paged", is_html)
    return df.withColumns({"base": base, "base_origin": origin, "hidden_layers": layers}).drop(*spent)


def add_view(df: DataFrame) -> DataFrame:
    """Adds view, origin, joined, joined_origin and units to rows with base and base_origin."""
    base = F.col("base")
    special = F.when(X.may_need_view(base), base)
    df = df.withColumn("_n", X.compatibility_view(special))
    origin = F.when(F.col("_n.origin").isNull(), F.col("base_origin")) \
        .when(F.col("base_origin").isNull(), F.col("_n.origin")) \
        .otherwise(F.transform("_n.origin", lambda i: F.get("base_origin", i)))
    # Fenced, or each later step that reads them would call the Python helper again on every row.
    df = df.withColumns({"_text": fence(F.coalesce("_n.text", "base")), "origin": fence(origin)})
    df = df.withColumn("view", fence(X.fold_confusables(F.col("_text"))))
    spaced = F.col("view").rlike(X.SPACED_LETTERS)
    df = df.withColumn("joined", F.when(spaced, X.join_spaced_letters(F.col("view")))).withColumn(
        "joined_origin", F.when(spaced, F.transform(
            X.spaced_origin(F.col("view")), lambda i: X.at_origin(F.col("origin"), i))))
    df = df.withColumn("_pieces", fence(X.unit_pieces(F.col("view"), F.coalesce(F.col("source") == "email", F.lit(False)))))
    df = df.withColumn("units", fence(X.placed_units(F.col("_pieces")))).drop("_pieces")
    moved = F.transform("units", lambda u: X.to_original(F.col("origin"), u, UNIT_ARRAY)).cast(UNIT_ARRAY)
    return df.withColumn("units", fence(F.when(F.col("origin").isNull(), F.col("units")).otherwise(moved))).drop("_n")


def prepare(items: DataFrame) -> DataFrame:
    """Adds view, origin, joined, joined_origin, units, layers and warnings to (item_id, content, source, …)."""
    df = add_view(items if "base" in items.columns else choose_front_end(items))
    base = F.col("base")

    def moved(layers: Column, at: Column) -> Column:
        return F.transform(layers, lambda x: X.to_original(at, x, LAYER_ARRAY)).cast(LAYER_ARRAY)

    hidden_runs = F.concat(X.decode_unicode_tags(base), X.decode_variation_selectors(base))
    inside_hidden = F.flatten(F.transform("hidden_layers", lambda h: F.transform(
        X.decode_runs(h["text"]), lambda d: d.withField("start", h["start"]).withField("end", h["end"]))))
    df = df.withColumn("_runs", fence(moved(hidden_runs, F.col("base_origin")))).withColumn("layers", fence(F.concat(
        F.col("hidden_layers"), F.col("_runs"), moved(X.decode_runs(F.col("view")), F.col("origin")),
        inside_hidden.cast(LAYER_ARRAY))))
    gone = X.invisible_count(F.regexp_replace(base, X.TAG_RUN, ""))
    mixed = X.confusable_words(F.col("_text"))
    decoded = F.exists("layers", lambda x: x["kind"].isin("base64", "hex"))
    notes = F.concat(
        F.transform("_runs", lambda x: F.concat(F.lit("hidden text in "), F.replace(x["kind"], F.lit("_"), F.lit(" ")))),
        F.array_compact(F.array(
            F.when(gone > 0, F.concat(gone.cast("string"), F.lit(" invisible character(s) removed"))),
            F.when(mixed > 0, F.concat(mixed.cast("string"),
                                       F.lit(" word(s) mixing look-alike letters from other alphabets"))),
            F.when(decoded, F.lit("encoded text decoded")))))
    return df.withColumn("warnings", notes).drop("_text", "_runs", "base", "base_origin", "hidden_layers")


def visible_hits(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``hits`` of the view and of the joined-letters view, the latter only where they are new."""
    src = F.col("source")
    visible = F.transform(hits_in(F.col("view"), src, rules=rules), lambda h: X.to_original(F.col("origin"), h, HIT_ARRAY))
    df = df.withColumn("_visible", fence(visible.cast(HIT_ARRAY)))
    joined = F.when(F.col("joined").isNotNull(), F.transform(
        hits_in(F.col("joined"), src, rules=rules), lambda h: X.to_original(F.col("joined_origin"), h, HIT_ARRAY)))
    fresh = F.filter(F.coalesce(joined.cast(HIT_ARRAY), empty(HIT_ARRAY)), lambda j: ~F.exists(
        "_visible", lambda v: (v["rule"] == j["rule"]) & (v["start"] == j["start"])))
    return df.withColumn("hits", F.concat("_visible", fresh)).drop("_visible")


def rule_hits(prepared: DataFrame) -> DataFrame:
    """Adds ``hits``: rule matches in the view, the joined-letters view and every layer, in original positions."""
    src = F.col("source")
    df = visible_hits(prepared)
    deep = F.flatten(F.transform("layers", lambda x: F.transform(
        hits_in(x["text"], src, x["kind"]),
        lambda h: h.withField("start", x["start"]).withField("end", x["end"]))))
    layered = F.when(F.size("layers") > 0, deep.cast(HIT_ARRAY)).otherwise(empty(HIT_ARRAY))
    return df.withColumn("hits", fence(F.concat("hits", layered)))


def layer_kind_counts(prepared: DataFrame, key: str = "item_id") -> DataFrame:
    """Layers per item and kind."""
    return prepared.select(key, F.explode(F.transform("layers", lambda x: x["kind"])).alias("kind")) \
        .groupBy(key, "kind").agg(F.count("*").alias("n"))


def move_ranges(ranges: Column, segments: Column) -> Column:
    """Hidden ranges of the original, moved to their places in the kept text."""
    def in_segment(s: Column) -> Column:
        hit = F.filter(ranges, lambda r: (r["start"] < s["o"] + s["n"]) & (s["o"] < r["end"]))
        return F.transform(hit, lambda r: r.withField("start", s["d"] + F.greatest(r["start"], s["o"]) - s["o"]).withField(
            "end", s["d"] + F.least(r["end"], s["o"] + s["n"]) - s["o"]))
    return F.flatten(F.transform(segments, in_segment))
