"""The whole check as one DataFrame function.

Each step adds columns to the item's row, so screening shuffles nothing, whatever the table's size or
skew; only joining judge and sandbox evidence to the items does.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.rules import RULES, STRONG
from veilscan.functions.scorers import Scorer
from veilscan.functions.spans import cut_out, fence, let, touches
from veilscan.operators import cutting as C
from veilscan.operators import evidence as E
from veilscan.operators.language import language_gate
from veilscan.operators.prepare import add_view, choose_front_end, move_ranges, prepare, rule_hits, visible_hits
from veilscan.operators.scoring import has_null_score, score_items, score_windows
from veilscan.settings import CUT_ARRAY, MAX_WIDEN, OUTSIDE_TYPE, Options, empty

LEFT = "array<struct<start:int,end:int>>"


def detect(items: DataFrame, scorers: list[Scorer], opts: Options = Options(), language: bool = True) -> DataFrame:
    """Prepare, rules, scorers, language gate, triage."""
    df = score_items(rule_hits(prepare(items)), scorers, opts)
    if language:
        df = language_gate(df, opts)
    return E.triage(df, opts)


def attach_evidence(items: DataFrame, judgements: DataFrame | None = None, sandbox: DataFrame | None = None,
                    key: str = "item_id") -> DataFrame:
    """Joins judge and sandbox evidence, one row per item each, to the items. They are joined before detection: there a row is the
    text alone, after it the row also holds the views, units and windows and would be several times as wide in the shuffle."""
    df = items
    for name, table, kind in (("judge", judgements, E.JUDGE), ("sandbox", sandbox, E.SANDBOX)):
        df = df.withColumn(name, F.lit(None).cast(kind)) if table is None else df.join(table.select(key, name), key, "left")
    return df


def with_evidence(triaged: DataFrame, configured: bool, opts: Options = Options()) -> DataFrame:
    """Keeps the evidence of items that need it; clean items are decided without."""
    wanted = F.lit(True) if opts.always else F.col("lane") != "clean"
    return triaged.withColumns({name: F.when(wanted, F.col(name)) for name in ("judge", "sandbox")}).withColumn(
        "judge_configured", F.lit(configured))


def decision_warnings(opts: Options = Options()) -> Column:
    asked = F.lit(True) if opts.always else F.col("lane") != "clean"
    return F.array_compact(F.array(
        F.when(asked & ~F.col("judge_configured"), F.lit("judge not configured: decided on the detectors alone")),
        F.when(~F.col("judge.ok"), F.concat(F.lit("judge unavailable ("), F.coalesce("judge.error", F.lit("None")),
                                            F.lit("): decided without it"))),
        F.when(F.col("sandbox.error").isNotNull(), F.concat(F.lit("sandbox error ("), F.col("sandbox.error"), F.lit(")")))))


def decide(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Adds cuts, cleared, verdict and reason to items with evidence."""
    judge, sandbox = F.col("judge"), F.col("sandbox")
    ruled = E.judged(judge)
    attack_said = ruled & F.coalesce(judge["is_attack"], F.lit(False))
    df = df.withColumn("_hijacked", E.sandbox_counts(sandbox, judge, F.col("source")))

    def found_by(s: Column) -> Column:
        rules = F.when(F.size(s["hits"]) > 0, F.array(F.lit("rules"))).otherwise(F.array().cast("array<string>"))
        return F.concat(rules, F.array_sort(s["scorers"]))

    df = df.withColumn("_marked", fence(F.transform("spans", lambda s, i: F.struct(
        s.alias("span"), (E.is_strong(s, opts) | ~ruled | F.coalesce(E.judge_keeps(judge, i, s), F.lit(False))).alias("keep")))))
    content = F.col("content")

    def cut_of(m: Column) -> Column:
        s = m["span"]
        own = E.span_types(s)
        types = F.when(F.size(own) > 0, own).when(attack_said, judge["types"]).otherwise(F.array().cast("array<string>"))
        return C.make_cut(s["start"], s["end"], types, found_by(s),
                          F.array_sort(F.array_distinct(F.transform(s["hits"], lambda h: h["rule"]))), E.has_strong_rule(s))

    kept = F.transform(F.filter("_marked", lambda m: m["keep"]), cut_of).cast(CUT_ARRAY)
    quoted = F.when(attack_said, F.transform(judge["evidence"], lambda e: C.make_cut(
        e["start"], e["end"], F.array(e["type"]), F.array(F.lit("judge")))))
    placed = F.when(F.col("_hijacked"), F.transform(E.locate_addresses(content, sandbox["calls"]), lambda a: let(
        C.widen_to_sentence(content, F.col("units"), a["start"], a["end"]), lambda b: C.make_cut(
            b["start"], b["end"], F.array(F.lit("tool_abuse")), F.array(F.lit("sandbox"))))))
    df = df.withColumn("_cuts", fence(F.concat(kept, F.coalesce(quoted.cast(CUT_ARRAY), empty(CUT_ARRAY)),
                                         F.coalesce(placed.cast(CUT_ARRAY), empty(CUT_ARRAY)))))
    df = df.withColumn("_swept", fence(F.when(F.size("_cuts") > 0, C.payload_sweep(
        content, F.col("units"), F.col("_cuts"))).otherwise(F.col("_cuts"))))
    df = df.withColumn("cuts", fence(C.merge_cuts(F.col("_swept"))))
    df = df.withColumn("cleared", F.transform(F.filter("_marked", lambda m: ~m["keep"]), lambda m: F.struct(
        m["span"]["start"].alias("start"), m["span"]["end"].alias("end"), found_by(m["span"]).alias("found_by"))))
    none = F.size("cuts") == 0
    reason = F.when(F.coalesce(judge["took_over"], F.lit(False)),
                    "the content took over the judge (it returned the wrong check code)") \
        .when(none & attack_said, "the judge found an attack but quoted nothing that is in the content") \
        .when(none & F.col("_hijacked"), "the sandbox was hijacked, but nothing in the content located the attack") \
        .when(none & F.col("unlocated") & ~ruled, "flagged as a whole, but no part of it could be pinned down to cut")
    df = df.withColumn("reason", reason)
    verdict = F.when(F.col("reason").isNotNull(), "quarantine").when(F.size("cuts") > 0, "sanitise").otherwise("allow")
    return df.withColumn("verdict", fence(verdict)).withColumn("warnings", F.concat("warnings", decision_warnings(opts))) \
        .withColumn("hijacked", F.col("_hijacked")).drop("_marked", "_cuts", "_swept", "_hijacked")


CLEANED = "struct<text:string,detect:string,segments:array<struct<d:int,o:int,n:int>>>"


def recheck(df: DataFrame, scorers: list[Scorer], opts: Options = Options(), asked: Column | None = None) -> DataFrame:
    """Adds ``cleaned`` and ``left``: what the rules and scorers still find in the kept text of cut items, and ``recheck_failed``.

    The kept text goes through the item's own front end again, a page as a page and hidden ranges moved to their new
    places, so what nobody sees is not read as prose. Strong visible hits and groups two scorers agree on, moved to
    original positions. Rows that are not ``asked`` keep their ``cleaned`` and have nothing left: each step reads null for them.
    """
    asked = F.lit(True) if asked is None else asked
    before = F.col("cleaned") if "cleaned" in df.columns else F.lit(None).cast(CLEANED)
    df = df.withColumn("_asked", asked).withColumn("cleaned", fence(F.when(
        F.col("_asked"), C.apply_cuts(F.col("content"), F.col("cuts")).cast(CLEANED)).otherwise(before)))
    again, own = F.when(F.col("_asked"), F.col("cleaned")), []
    if "format" in df.columns:
        own.append(F.when(F.col("_asked"), F.col("format")).alias("format"))
    if "hidden" in df.columns:
        moved = move_ranges(F.coalesce("hidden", F.array().cast(df.schema["hidden"].dataType)), again["segments"])
        own.append(moved.cast(df.schema["hidden"].dataType).alias("hidden"))
    packed = df.select(F.struct(*df.columns).alias("_row"), "item_id", "source", again["detect"].alias("content"), *own)
    # Only strong hits count here, so only strong rules are matched.
    seen = score_windows(visible_hits(add_view(choose_front_end(packed)), [r for r in RULES if r.strength == STRONG]), scorers, opts.threshold)
    segments, failed = F.col("_row.cleaned.segments"), has_null_score(F.col("windows"))
    strong = F.filter("hits", lambda h: (h["strength"] == STRONG) & h["layer"].isNull())
    agreed = F.filter("groups", lambda g: ~failed & (F.size(g["flagged_by"]) >= 2))
    left = F.concat(
        F.transform(strong, lambda h: C.span_to_original(h["start"], h["end"], segments)),
        F.transform(agreed, lambda g: C.span_to_original(
            F.get("units", F.array_min(g["units"]))["start"], F.get("units", F.array_max(g["units"]))["end"], segments)))
    found = F.when(F.col("_row._asked"), left.cast(LEFT))
    return seen.select("_row.*", fence(F.coalesce(found, empty(LEFT))).alias("left"), fence(failed).alias("recheck_failed")).drop("_asked")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows to the checkpoint folder the session names, so later rounds do not recompute them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="veilscan-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def recheck_round(df: DataFrame, scorers: list[Scorer], opts: Options, turn: int) -> DataFrame:
    """One round for the rows marked ``_again``, as columns of the item's own row: the others read null in every step. Marks anew
    the rows whose cut was widened."""
    content = F.col("content")
    df = recheck(df, scorers, opts, F.col("_again"))
    acted = F.col("_again") & F.col("hijacked") & ~F.col("source").eqNullSafe("user") & F.coalesce(
        F.col("sandbox_again.ok") & F.col("sandbox_again.acted"), F.lit(False))
    spots = F.when(acted, F.filter(E.locate_addresses(content, F.col("sandbox_again.calls")), lambda p: ~F.exists(
        "cuts", lambda c: (c["start"] <= p["start"]) & (p["start"] < c["end"]))))
    df = df.withColumn("_spots", F.coalesce(spots.cast(LEFT), empty(LEFT)))
    df = df.withColumn("_stuck", fence(acted & (F.size("_spots") == 0))).withColumn("left", fence(F.concat("left", "_spots")))
    more = (F.size("left") > 0) & ~F.col("_stuck")
    last = F.lit(turn == MAX_WIDEN)
    df = df.withColumn("_stopped", F.col("_stuck") | last & more).withColumn("_again", fence(more & ~last))
    note = F.when(F.col("_stuck"), F.lit("the sandbox was still hijacked after cleaning")).otherwise(
        F.lit(f"still flagged after widening the cut {MAX_WIDEN} times"))
    wider = F.transform("left", lambda x: let(
        C.widen_to_sentence(content, F.col("units"), x["start"], x["end"], neighbours=True),
        lambda b: C.make_cut(b["start"], b["end"], F.array_distinct(F.flatten(F.transform(
            F.filter("cuts", lambda c: touches(c, b)), lambda c: c["types"]))), F.array(F.lit("re-check")))))
    failed = F.lit("classifiers unavailable in the re-check")
    return df.withColumns({
        "reason": F.when(F.col("_stopped"), note).otherwise(F.col("reason")),
        "verdict": F.when(F.col("_stopped"), "quarantine").otherwise(F.col("verdict")),
        "warnings": F.when(F.col("recheck_failed"), F.array_union("warnings", F.array(failed))).otherwise(F.col("warnings")),
        "cuts": fence(F.when(F.col("_again"), C.merge_cuts(F.concat("cuts", wider.cast(CUT_ARRAY)))).otherwise(F.col("cuts"))),
        "rounds": F.col("rounds") + F.col("_again").cast("int"),
    }).drop("left", "_spots", "_stuck", "_stopped", "recheck_failed")


def cut_and_recheck(df: DataFrame, scorers: list[Scorer], second_sandbox: DataFrame | None = None,
                    opts: Options = Options(), key: str = "item_id") -> DataFrame:
    """Cuts, reads the kept text again, and widens at most twice; what is still flagged is quarantined.

    The first round is columns of the same pass as detection. Its rows are written once; only those whose cut was widened, few
    as a rule, go round again, at most twice, and only they are written again. (All three rounds as columns took 204 s over 10,000
    items where this takes 84 s, building and compiling most of it.)
    ``second_sandbox`` holds ``sandbox_again`` per item: the sandbox run on the cleaned text.
    """
    df = df.withColumn("rounds", F.lit(0)).withColumn("cleaned", F.lit(None).cast(CLEANED))
    if second_sandbox is not None:
        cut = df.withColumn("_cut", F.when(F.col("verdict") == "sanitise", 1).otherwise(0))
        df = cut.join(second_sandbox.select(key, "sandbox_again").withColumn("_cut", F.lit(1)), [key, "_cut"], "left").drop("_cut")
    else:
        df = df.withColumn("sandbox_again", F.lit(None).cast(E.SANDBOX))
    todo = df.withColumn("_again", F.col("verdict") == "sanitise")
    done = None
    for turn in range(MAX_WIDEN + 1):
        step = cut_lineage(recheck_round(todo, scorers, opts, turn))
        settled = step.filter(~F.col("_again"))
        done = settled if done is None else done.unionByName(settled)
        todo = step.filter("_again")
        if turn == MAX_WIDEN or todo.isEmpty():
            break
    return done.drop("_again", "sandbox_again")


def report_rows(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """The final answer per item."""
    outside = ~F.col("source").eqNullSafe("user")
    concealed = F.filter("layers", lambda x: x["hidden"])
    attacks = F.transform("cuts", lambda c: F.struct(
        F.concat(F.filter(c["types"], lambda t: t != OUTSIDE_TYPE), F.when(outside, F.array(F.lit(OUTSIDE_TYPE))).otherwise(
            F.array().cast("array<string>"))).alias("types"),
        F.when(outside, "indirect").otherwise("direct").alias("channel"), c["start"].alias("start"), c["end"].alias("end"),
        cut_out(F.col("content"), c["start"], c["end"]).alias("text"), c["found_by"].alias("found_by"),
        E.confidence(c["strong_rule"], c["found_by"], opts).alias("confidence"), c["rules"].alias("rules"),
        F.array_distinct(F.transform(F.filter(concealed, lambda x: touches(x, c)), lambda x: x["kind"])).alias("hidden_in")))
    every = F.flatten(F.transform(F.map_values("scores"), lambda s: F.array(s["whole"], s["max_window"])))
    clean = F.when(F.col("verdict") == "allow", F.col("content")).when(F.col("verdict") == "sanitise", F.col("cleaned.text"))
    foreign = F.transform("lang_flags", lambda f: F.struct(
        f["start"].alias("start"), f["end"].alias("end"), f["top"].alias("language"),
        F.round(F.lit(1.0) - f["p_eng"], 4).alias("confidence"), f["text"].alias("text")))
    return df.withColumn("attacks", attacks).select(
        "item_id", "source", "content", "verdict", "lane", F.round(F.array_max(every), 4).alias("risk"), "attacks", "cleared",
        F.transform("hints", lambda h: F.struct(h["rule"], h["type"], h["text"])).alias("hints"),
        F.when(F.col("reason").isNotNull(), F.concat("warnings", F.array(F.concat(F.lit("quarantined: "), F.col("reason")))))
        .otherwise(F.col("warnings")).alias("warnings"),
        clean.alias("clean_content"), F.transform("attacks", lambda a: a["text"]).alias("removed"), "scores",
        foreign.alias("non_english_spans"), "judge", "sandbox", "rounds", F.when(F.col("cleaned").isNull(), 0).otherwise(
            F.col("rounds") + 1).alias("passes"), "layers")


def check_items(items: DataFrame, scorers: list[Scorer], judgements: DataFrame | None = None,
                sandbox: DataFrame | None = None, second_sandbox: DataFrame | None = None,
                opts: Options = Options()) -> DataFrame:
    """Screens a table of items: verdict, cuts, cleaned text and everything a reader needs to see why."""
    df = with_evidence(detect(attach_evidence(items, judgements, sandbox), scorers, opts), judgements is not None, opts)
    return report_rows(cut_and_recheck(decide(df, opts), scorers, second_sandbox, opts), opts)
