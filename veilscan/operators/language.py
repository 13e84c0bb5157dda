"""The language gate: lines the scorers are not validated on. It never cuts; it only makes an item unsure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import language as L
from veilscan.functions import text as X
from veilscan.functions.spans import cut_out, fence, let, running, strip
from veilscan.settings import FLAG_ARRAY, Options, empty

LINE = ("array<struct<unit_no:int,start:int,end:int,text:string,payload:string,words:int,p_eng:double,top:string,"
        "run:int,cleared:boolean>>")


def lang_units(units: Column, layers: Column) -> Column:
    """Visible units, then the units of hidden layers placed at their layer's run."""
    inner = F.flatten(F.transform(F.filter(layers, lambda x: x["hidden"]), lambda x: F.transform(
        X.split_units(x["text"], F.lit(False)), lambda u: u.withField("start", x["start"]).withField("end", x["end"]))))
    n = F.size(units)
    return F.when(F.exists(layers, lambda x: x["hidden"]), F.concat(units, F.transform(
        inner, lambda u, i: u.withField("unit_no", n + i)))).otherwise(units)


SAID = "array<struct<payload:string,words:int,p_eng:double,top:string>>"


def said_in(units: Column, is_email: Column) -> Column:
    """Each unit's payload, word count and language score; metadata has a null payload."""
    def said(p: Column) -> Column:
        judged = let(L.lang_words(F.coalesce(p, F.lit(""))), lambda w: let(L.language_score(w), lambda s: F.struct(
            F.size(w).alias("words"), s["p_eng"].alias("p_eng"), s["top"].alias("top"))))
        return let(judged, lambda j: F.struct(p.alias("payload"), j["words"].alias("words"), j["p_eng"].alias("p_eng"), j["top"].alias("top")))

    payloads = F.transform(units, lambda u: F.when(is_email, L.mail_payload(u["text"])).otherwise(u["text"]))
    return F.transform(payloads, said).cast(SAID)


def lines_of(units: Column, said: Column) -> Column:
    return F.zip_with(units, said, lambda u, s: F.struct(
        u["unit_no"].alias("unit_no"), u["start"].alias("start"), u["end"].alias("end"), u["text"].alias("text"),
        s["payload"].alias("payload"), s["words"].alias("words"), s["p_eng"].alias("p_eng"), s["top"].alias("top"),
        F.lit(0).alias("run"), F.lit(False).alias("cleared"))).cast(LINE)


def scored_lines(units: Column, is_email: Column) -> Column:
    """Each unit with what ``said_in`` finds in it."""
    return lines_of(units, said_in(units, is_email))


def breaks_before(prev: Column, cur: Column, content: Column) -> Column:
    """Whether a mail line starts anew rather than carrying on the line before."""
    ended = prev["payload"].rlike(r"[.!?][\"')\]]*$") | prev["payload"].endswith(":")
    fresh = cur["payload"].rlike(L.HEADER_PREFIX) | cur["payload"].rlike(L.QUOTE) | cur["payload"].rlike(r"^(?:[-*]\s|\d+[\.\)]\s)")
    gap = F.contains(cut_out(content, prev["end"], F.greatest(cur["start"], prev["end"])), F.lit("\n\n"))
    return prev["payload"].isNull() | cur["payload"].isNull() | ended | fresh | gap


def number_runs(lines: Column, content: Column) -> Column:
    """Numbers the wrapped runs: a line that carries on keeps the run of the line before."""
    flags = F.transform(lines, lambda x, i: F.when(i == 0, F.lit(1)).otherwise(
        F.coalesce(breaks_before(F.get(lines, i - 1), x, content), F.lit(True)).cast("int")))
    runs = let(flags, lambda f: F.zip_with(running(f), f, lambda before, own: before + own))
    return let(runs, lambda r: F.transform(lines, lambda x, i: x.withField("run", F.get(r, i))))


def rejoin_wrapped(lines: Column, content: Column, opts: Options = Options()) -> Column:
    """Marks lines cleared because the wrapped sentence they belong to reads as English."""
    def clear(numbered: Column) -> Column:
        n = F.size(numbered)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(numbered, i)["run"] != F.get(numbered, i - 1)["run"]))
        bodies = F.transform(numbered, lambda x: strip(F.coalesce(x["payload"], F.lit(""))))

        def said(at: Column, texts: Column) -> Column:
            # one entry per run: how many lines, and their text
            return F.transform(at, lambda a, k: let(F.slice(texts, a + 1, F.coalesce(F.get(at, k + 1), F.size(texts)) - a), lambda own: F.struct(
                F.size(own).alias("n"), F.array_join(own, " ").alias("text"))))

        runs = let(firsts, lambda at: let(bodies, lambda texts: said(at, texts)))
        english = F.transform(runs, lambda r: F.when(r["n"] > 1, let(L.lang_words(r["text"]), lambda w: (
            F.size(w) >= opts.min_words) & (L.language_score(w)["p_eng"] >= opts.language_threshold))).otherwise(F.lit(False)))

        def mark(verdicts: Column) -> Column:
            # runs are numbered from 1 without gaps
            return F.transform(numbered, lambda x: x.withField("cleared", x["payload"].isNotNull() & F.get(
                verdicts, x["run"] - 1) & ((x["top"] == "en") | (x["p_eng"] >= 0.20)) & ~L.has_indic_markers(x["payload"])))

        return let(english, mark)

    return let(number_runs(lines, content), clear)


def _flag(x: Column, p: Column, top: Column, by: str) -> Column:
    return F.struct(x["unit_no"].alias("unit_no"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"),
                    p.alias("p_eng"), top.alias("top"), F.lit(by).alias("by"))


def flag_lines(lines: Column, opts: Options = Options()) -> Column:
    """Lines long enough to judge that are not English."""
    bad = F.filter(lines, lambda x: x["payload"].isNotNull() & ~x["cleared"] & (x["words"] >= opts.min_words)
                   & (x["p_eng"] < opts.language_threshold))
    return F.transform(bad, lambda x: _flag(x, x["p_eng"], x["top"], "line")).cast(FLAG_ARRAY)


JOINED = "array<struct<at:int,p:double,top:string>>"


def join_short_lines(lines: Column, opts: Options = Options()) -> Column:
    """Short lines in a row are buffered, English ones skipped, until six words can be judged together.

    What the fold carries is copied at every line, so it carries places of lines and one text, not the lines.
    """
    def ends_run(x: Column) -> Column:
        return x["payload"].isNull() | x["cleared"] | (x["words"] == 0) | (x["words"] >= opts.min_words)

    def english(x: Column) -> Column:
        return (x["p_eng"] >= opts.language_threshold) & (x["top"] == "en")

    def state(buf: Column, text: Column, out: Column) -> Column:
        return F.struct(buf.alias("buf"), text.alias("text"), out.alias("out"))

    none, nothing = F.array().cast("array<int>"), F.lit(None).cast("string")

    def finish(buf: Column, text: Column, out: Column) -> Column:
        def judged(w: Column) -> Column:
            enough = F.size(w) >= opts.min_words
            return let(L.language_score(w), lambda s: state(
                F.when(enough, none).otherwise(buf), F.when(enough, nothing).otherwise(text),
                F.when(enough & (s["p_eng"] < opts.language_threshold), F.concat(out, F.transform(buf, lambda at: F.struct(
                    at.alias("at"), s["p_eng"].alias("p"), s["top"].alias("top"))).cast(JOINED))).otherwise(out)))

        return let(L.lang_words(text), judged)

    def step(acc: Column, x: Column) -> Column:
        text = F.concat_ws(" ", acc["text"], x["payload"])
        return F.when(x["ends"], state(none, nothing, acc["out"])).otherwise(
            let(text, lambda t: finish(F.concat(acc["buf"], F.array(x["at"])), t, acc["out"])))

    def fold(kept: Column) -> Column:
        start = state(none, nothing, F.array().cast(JOINED))
        flags = F.aggregate(kept, start, step, lambda acc: acc["out"])
        return F.transform(flags, lambda f: let(F.get(lines, f["at"]), lambda x: _flag(x, f["p"], f["top"], "joined short lines"))).cast(FLAG_ARRAY)

    numbered = F.transform(lines, lambda x, i: F.struct(
        i.alias("at"), ends_run(x).alias("ends"), F.when(~ends_run(x), x["payload"]).alias("payload"), english(x).alias("english")))
    short = F.exists(lines, lambda x: ~ends_run(x) & ~english(x))
    return F.when(short, fold(F.filter(numbered, lambda x: x["ends"] | ~x["english"]))).otherwise(empty(FLAG_ARRAY))


def language_gate(df: DataFrame, opts: Options = Options()) -> DataFrame:
    """Adds ``lang_flags`` and its warning to prepared items."""
    is_email = F.coalesce(F.col("source") == "email", F.lit(False))
    df = df.withColumn("_read", fence(lang_units(F.col("units"), F.col("layers"))))
    df = df.withColumn("_said", fence(said_in(F.col("_read"), is_email)))
    df = df.withColumn("_lines", fence(lines_of(F.col("_read"), F.col("_said"))))
    df = df.withColumn("_lines", fence(F.when(is_email, rejoin_wrapped(F.col("_lines"), F.col("content"), opts)).otherwise(F.col("_lines"))))
    flags = F.array_sort(F.concat(flag_lines(F.col("_lines"), opts), join_short_lines(F.col("_lines"), opts)),
                         lambda a, b: a["unit_no"] - b["unit_no"])
    df = df.withColumn("lang_flags", fence(F.coalesce(flags, empty(FLAG_ARRAY))))
    langs = F.array_join(F.array_sort(F.array_distinct(F.transform("lang_flags", lambda f: f["top"]))), ", ")
    return df.withColumn("warnings", F.when(F.size("lang_flags") > 0, F.concat("warnings", F.array(F.concat(
        F.lit("non-English content detected ("), langs, F.lit(")"))))).otherwise(F.col("warnings"))).drop("_lines", "_read", "_said")
