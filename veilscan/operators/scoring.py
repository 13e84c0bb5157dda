"""Window scores and localisation: which units of an item carry what the scorers flag."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import text as X
from veilscan.functions.scorers import Scorer
from veilscan.functions.spans import fence, let, running
from veilscan.settings import GROUP_ARRAY, WINDOW_UNITS, Options, empty

RANGES = "array<struct<a:int,b:int,s:array<double>,top:double>>"


def unit_windows(n: Column, width: int = WINDOW_UNITS) -> Column:
    """[a, b) unit ranges: every run of three, or all units when there are fewer."""
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.struct(
        i.alias("a"), F.least(i + width, n).alias("b")))
    return F.when(n > 0, many).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def range_text(texts: Column, a: Column, b: Column) -> Column:
    return F.array_join(F.slice(texts, a + 1, b - a), " ")


def runs_of(n: Column, width: int) -> Column:
    """Every run of exactly ``width`` units."""
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    found = F.transform(starts, lambda i: F.struct(i.alias("a"), (i + width).alias("b")))
    return F.when(n >= width, found).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def score_ranges(texts: Column, ranges: Column, scorers: list[Scorer], wanted: Callable[[Column], Column] | None = None) -> Column:
    """Each range with every scorer's score, in scorer order, and the top score; null scores where a range is not ``wanted``."""
    def merged(lists: Column) -> Column:
        # lists: one array of scores per scorer, bound once, so no text is scored again per range
        return F.transform(ranges, lambda r, i: let(F.transform(lists, lambda x: F.get(x, i)), lambda s: F.struct(
            r["a"].alias("a"), r["b"].alias("b"), s.alias("s"), F.array_max(s).alias("top"))))

    def body(r: Column) -> Column:
        said = range_text(texts, r["a"], r["b"])
        return said if wanted is None else F.when(wanted(r), said)

    bodies = F.transform(ranges, body)
    if all(s.native for s in scorers):
        return let(bodies, lambda t: let(F.array(*[s.many(t) for s in scorers]), merged)).cast(RANGES)
    return let(F.array(*[s.many(bodies) for s in scorers]), merged).cast(RANGES)


def held_phrases(low: Column, scorers: list[Scorer]) -> Column:
    """For each scorer the phrases that the lower-cased texts hold, joined as the texts of any range of them are."""
    return let(F.array_join(low, " "), lambda joined: F.array(*[
        F.filter(F.array(*[F.lit(p) for p in s.phrases]), lambda p: F.contains(joined, p)) for s in scorers]))


def phrase_ranges(low: Column, held: Column, ranges: Column, scorers: list[Scorer], wanted: Callable[[Column], Column] | None = None) -> Column:
    """``score_ranges`` for scorers that look for phrases: a range holds none that all texts together do not hold, so most texts
    are lower-cased and searched once, not once a range and scorer."""
    def row(r: Column, own: Column) -> Column:
        return let(own, lambda s: F.struct(r["a"].alias("a"), r["b"].alias("b"), s.alias("s"), F.array_max(s).alias("top")))

    def scored(t: Column) -> Column:
        return F.array(*[F.when(F.exists(F.get(held, F.lit(k)), lambda p: F.contains(t, p)), s.found_score[0]).otherwise(s.found_score[1])
                         for k, s in enumerate(scorers)])

    def searched(r: Column) -> Column:
        said = range_text(low, r["a"], r["b"])
        return row(r, let(said if wanted is None else F.when(wanted(r), said), scored))

    none = [s.found_score[1] for s in scorers]
    quiet = F.transform(ranges, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), F.array(*[F.lit(x) for x in none]).alias("s"), F.lit(max(none)).alias("top")))
    return F.when(F.exists(held, lambda h: F.size(h) > 0), F.transform(ranges, searched).cast(RANGES)).otherwise(quiet.cast(RANGES))


def drill_down(window: Column, pairs: Column, singles: Column, threshold: float) -> Column:
    """The units of a high window to cut: bad single units, else the worse pair, else the window."""
    first, second = F.get(pairs, window["a"]), F.get(pairs, window["a"] + 1)
    best = F.when(second["top"] > first["top"], second).otherwise(first)
    target = F.when((window["b"] - window["a"] == 3) & (best["top"] >= threshold), F.struct(
        best["a"].alias("a"), best["b"].alias("b"))).otherwise(F.struct(window["a"].alias("a"), window["b"].alias("b")))

    def units(t: Column) -> Column:
        every = F.sequence(t["a"], t["b"] - 1)
        return let(F.filter(every, lambda i: F.get(singles, i)["top"] >= threshold),
                   lambda bad: F.when((F.size(bad) > 0) & (t["b"] - t["a"] > 1), bad).otherwise(every))

    return let(target, units)


def locate_groups(windows: Column, pairs: Column, singles: Column, names: list[str], threshold: float) -> Column:
    """High windows, worst first, each narrowed to its culprit; windows touching found units are skipped."""
    high = F.filter(windows, lambda w: w["top"] >= threshold)
    ordered = F.array_sort(high, lambda x, y: F.when(x["top"] > y["top"], -1).when(x["top"] < y["top"], 1)
                           .otherwise(x["a"] - y["a"]))
    labels = F.array(*[F.lit(n) for n in names])

    def flagged(s: Column) -> Column:
        return F.filter(labels, lambda name, i: F.get(s, i) >= threshold)

    def group(w: Column, found: Column) -> Column:
        lo, hi = F.array_min(found), F.array_max(found) + 1
        final = F.when(hi - lo == 1, F.get(singles, lo)["s"]).when(hi - lo == 2, F.get(pairs, lo)["s"]).otherwise(w["s"])
        return F.struct(found.alias("units"), flagged(w["s"]).alias("flagged_by"),
                        F.map_from_arrays(labels, final).alias("scores"))

    def step(acc: Column, w: Column) -> Column:
        seen = F.exists(acc["covered"], lambda i: (i >= w["a"]) & (i < w["b"]))
        return F.when(seen, acc).otherwise(let(drill_down(w, pairs, singles, threshold), lambda found: F.struct(
            F.concat(acc["covered"], found).alias("covered"),
            F.concat(acc["groups"], F.array(group(w, found)).cast(GROUP_ARRAY)).alias("groups"))))

    start = F.struct(F.array().cast("array<int>").alias("covered"), empty(GROUP_ARRAY).alias("groups"))
    return F.aggregate(ordered, start, step, lambda acc: acc["groups"])


def under_high(windows: Column, threshold: float) -> Callable[[Column], Column]:
    """Whether a range of at most two units lies in a window that a scorer flags: it can only be one of three."""
    def inside(r: Column) -> Column:
        found = F.lit(False)
        for back in range(WINDOW_UNITS):
            w = F.get(windows, r["a"] - back)
            found = found | F.coalesce((w["top"] >= threshold) & (w["b"] >= r["b"]), F.lit(False))
        return found

    return inside


def score_windows(df: DataFrame, scorers: list[Scorer], threshold: float) -> DataFrame:
    """Adds windows and groups to rows with units; pairs and singles are scored only under a high window."""
    df = df.withColumn("_texts", F.transform("units", lambda u: u["text"])).withColumn("_n", F.size("_texts"))
    searching = bool(scorers) and all(s.phrases for s in scorers)
    if searching:
        df = df.withColumn("_texts", fence(F.transform("_texts", lambda t: F.lower(t)))).withColumn(
            "_held", fence(held_phrases(F.col("_texts"), scorers)))

    def scored(ranges: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
        return fence(phrase_ranges(F.col("_texts"), F.col("_held"), ranges, scorers, wanted) if searching
                     else score_ranges(F.col("_texts"), ranges, scorers, wanted))

    df = df.withColumn("windows", scored(unit_windows(F.col("_n"))))
    high = F.exists("windows", lambda w: w["top"] >= threshold)
    nothing = F.array().cast("array<struct<a:int,b:int>>")
    df = df.withColumn("_r2", F.when(high, runs_of(F.col("_n"), 2)).otherwise(nothing)) \
        .withColumn("_r1", F.when(high, runs_of(F.col("_n"), 1)).otherwise(nothing)) \
        .withColumn("_pairs", scored(F.col("_r2"), under_high(F.col("windows"), threshold))) \
        .withColumn("_singles", scored(F.col("_r1"), under_high(F.col("windows"), threshold)))
    groups = locate_groups(F.col("windows"), F.col("_pairs"), F.col("_singles"), [s.name for s in scorers], threshold)
    return df.withColumn("groups", fence(F.when(high, groups).otherwise(empty(GROUP_ARRAY)))).drop(
        "_texts", "_held", "_n", "_r1", "_r2", "_pairs", "_singles")


def score_items(prepared: DataFrame, scorers: list[Scorer], opts: Options = Options()) -> DataFrame:
    """Adds windows, groups, scores, layer_flags and unlocated to prepared items. No shuffle.

    A scorer that fails on an item returns nulls: that item is then decided on the rules alone, with a warning.
    """
    thr = opts.threshold
    df = score_windows(prepared, scorers, thr)
    for i, s in enumerate(scorers):
        df = df.withColumn(f"_whole_{i}", fence(s.long(F.col("view"))))
    df = flag_layers(df, scorers, thr)
    entries = [F.struct(F.lit(s.name).alias("key"), F.struct(
        F.round(F.col(f"_whole_{i}"), 4).alias("whole"),
        F.round(F.coalesce(F.array_max(scores_of(F.col("windows"), i)), F.lit(0.0)), 4).alias("max_window")).alias("value")) for i, s in enumerate(scorers)]
    failed = has_null_score(F.col("windows")) | F.col("_layers_failed")
    for i in range(len(scorers)):
        failed = failed | F.col(f"_whole_{i}").isNull() & F.col("view").isNotNull()
    df = df.withColumn("scorers_failed", fence(failed)).withColumn("scores", F.map_from_entries(F.array(*entries)))
    failed = F.col("scorers_failed")
    whole = F.greatest(*[F.col(f"_whole_{i}") for i in range(len(scorers))]) if len(scorers) > 1 else F.col("_whole_0")
    df = df.withColumn("groups", F.when(failed, empty(GROUP_ARRAY)).otherwise(F.col("groups")))
    df = df.withColumn("layer_flags", F.when(failed, F.transform("layers", lambda x: F.array().cast("array<string>"))).otherwise(F.col("layer_flags")))
    df = df.withColumn("unlocated", ~failed & (F.size("groups") == 0) & (F.coalesce(whole, F.lit(0.0)) >= thr))
    df = df.withColumn("warnings", F.when(failed, F.concat("warnings", F.array(
        F.lit("classifiers unavailable: decided on the rules alone")))).otherwise(F.col("warnings")))
    return df.drop("_layers_failed", *[f"_whole_{i}" for i in range(len(scorers))])


def scores_of(ranges: Column, number: int) -> Column:
    """One scorer's score of each range. (An array function passes the place to a second parameter, so there is none.)"""
    return F.transform(ranges, lambda r: F.get(r["s"], F.lit(number)))


def has_null_score(ranges: Column) -> Column:
    """Whether a scorer gave no score to one of the windows."""
    return F.coalesce(F.exists(ranges, lambda w: F.exists(w["s"], lambda x: x.isNull())), F.lit(False))


def nested_scores(df: DataFrame, texts: str, out: str, scorers: list[Scorer]) -> DataFrame:
    """Adds ``out``, array<array<array<double>>>: for each text of each of ``texts`` (array<array<string>>) the scores in scorer
    order. All texts of a row are scored as one array, since a Python scorer cannot be called inside an array function."""
    df = df.withColumn("_flat", fence(F.flatten(texts)))
    df = df.withColumn("_by", fence(F.array(*[s.many(F.col("_flat")) for s in scorers])))
    places = running(F.transform(texts, lambda t: F.size(t)))
    return df.withColumn(out, fence(F.zip_with(texts, places, lambda own, at: F.transform(
        own, lambda t, i: F.transform("_by", lambda x: F.get(x, at + i)))))).drop("_flat", "_by")


def scored_layer(layer: Column, scorers: list[Scorer], threshold: float) -> Column:
    """struct<flags,failed> of one layer by native scorers, which can be called inside an array function: few texts have layers, so
    their scoring is one column of the row, not dozens of steps that copy every row."""
    labels = F.array(*[F.lit(s.name) for s in scorers])
    nothing = F.array().cast("array<struct<a:int,b:int>>")
    texts = F.when(layer["hidden"], F.transform(X.split_units(layer["text"], F.lit(False)), lambda u: u["text"])).otherwise(
        F.array().cast("array<string>"))

    def by_window(t: Column) -> Column:
        def located(w: Column) -> Column:
            def under(width: int) -> Column:
                return score_ranges(t, runs_of(F.size(t), width), scorers, under_high(w, threshold))

            groups = let(under(2), lambda pairs: let(under(1), lambda singles: locate_groups(w, pairs, singles, [s.name for s in scorers], threshold)))
            high = F.exists(w, lambda x: x["top"] >= threshold)
            return F.struct(F.flatten(F.transform(F.when(high, groups).otherwise(empty(GROUP_ARRAY)), lambda g: g["flagged_by"])).alias("flags"),
                            has_null_score(w).alias("failed"))

        return let(score_ranges(t, F.when(F.size(t) > 0, unit_windows(F.size(t))).otherwise(nothing), scorers), located)

    def together(whole: Column) -> Column:
        over = F.filter(labels, lambda name, k: F.coalesce(F.get(whole, k) >= threshold, F.lit(False)))
        return let(let(texts, by_window), lambda x: F.struct(
            F.array_sort(F.array_distinct(F.concat(over, x["flags"]))).alias("flags"),
            (x["failed"] | F.exists(whole, lambda y: y.isNull())).alias("failed")))

    return let(F.array(*[s.long(layer["text"]) for s in scorers]), together)


def flag_layers(df: DataFrame, scorers: list[Scorer], threshold: float, layers: str = "layers") -> DataFrame:
    """Adds ``layer_flags``, for each layer the scorers that flag it, concealed text also window by window, and ``_layers_failed``.

    The windows, pairs and single units of all of a row's layers are scored like those of visible text, by any scorer."""
    if all(s.native for s in scorers):
        df = df.withColumn("_layers", fence(F.transform(layers, lambda x: scored_layer(x, scorers, threshold))))
        return df.withColumn("layer_flags", F.transform("_layers", lambda x: x["flags"])).withColumn(
            "_layers_failed", F.coalesce(F.exists("_layers", lambda x: x["failed"]), F.lit(False))).drop("_layers")
    nothing = F.array().cast("array<string>")
    labels = F.array(*[F.lit(s.name) for s in scorers])
    df = df.withColumn("_units", fence(F.transform(layers, lambda x: F.when(x["hidden"], F.transform(
        X.split_units(x["text"], F.lit(False)), lambda u: u["text"])).otherwise(nothing))))

    def scored(df: DataFrame, out: str, ranges: Callable[[Column, Column], Column], wanted: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        df = df.withColumn("_ranges", fence(F.transform("_units", ranges)))

        def bodies(t: Column, i: Column) -> Column:
            def said(r: Column) -> Column:
                body = range_text(t, r["a"], r["b"])
                return body if wanted is None else F.when(wanted(r, i), body)

            return F.transform(F.get("_ranges", i), said)

        df = df.withColumn("_texts", fence(F.transform("_units", bodies)))
        df = nested_scores(df, "_texts", "_scores", scorers)
        return df.withColumn(out, fence(F.zip_with("_ranges", "_scores", lambda r, s: F.zip_with(r, s, lambda x, y: F.struct(
            x["a"].alias("a"), x["b"].alias("b"), y.alias("s"), F.array_max(y).alias("top")))).cast(f"array<{RANGES}>")))

    def high(i: Column) -> Column:
        return F.exists(F.get("_windows", i), lambda w: w["top"] >= threshold)

    def within(r: Column, i: Column) -> Column:
        return under_high(F.get("_windows", i), threshold)(r)

    def under(width: int) -> Callable[[Column, Column], Column]:
        return lambda t, i: F.when(high(i), runs_of(F.size(t), width)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))

    def longest(number: int) -> Column:
        return F.transform(f"_whole_layer_{number}", lambda rows: F.array_max(F.transform(rows, lambda y: F.get(y, F.lit(0)))))

    df = scored(df, "_windows", lambda t, i: unit_windows(F.size(t)))
    for width, out in ((2, "_pairs"), (1, "_singles")):
        df = scored(df, out, under(width), within)
    groups = F.transform("_units", lambda t, i: F.when(high(i), locate_groups(
        F.get("_windows", i), F.get("_pairs", i), F.get("_singles", i), [s.name for s in scorers], threshold)).otherwise(empty(GROUP_ARRAY)))
    df = df.withColumn("_groups", fence(groups))
    # Whole texts, each scorer in its own pieces.
    for k, s in enumerate(scorers):
        cut = s.cut
        df = df.withColumn("_texts", fence(F.transform(layers, lambda x: cut(x["text"]))))
        df = nested_scores(df, "_texts", f"_whole_layer_{k}", [s])
    df = df.withColumn("_wholes", fence(F.arrays_zip(*[longest(k).alias(f"w{k}") for k in range(len(scorers))])))

    def flags(x: Column, i: Column) -> Column:
        w = F.get("_wholes", i)
        whole = F.filter(labels, lambda name, k: F.coalesce(F.get(F.array(*[w[f"w{n}"] for n in range(len(scorers))]), k) >= threshold, F.lit(False)))
        return F.array_sort(F.array_distinct(F.concat(whole, F.flatten(F.transform(F.get("_groups", i), lambda g: g["flagged_by"])))))

    failed = F.exists("_windows", has_null_score) | F.exists("_wholes", lambda w: F.exists(
        F.array(*[w[f"w{n}"] for n in range(len(scorers))]), lambda x: x.isNull()))
    df = df.withColumn("layer_flags", fence(F.transform(layers, flags))).withColumn("_layers_failed", F.coalesce(failed, F.lit(False)))
    return df.drop("_units", "_ranges", "_texts", "_scores", "_windows", "_pairs", "_singles", "_groups", "_wholes",
                   *[f"_whole_layer_{k}" for k in range(len(scorers))])
