"""Secret scan, with Spark's own functions only.

Fixed patterns give the base spans: assignments, access keys, long hex strings. A battery of randomness tests adds to them.
Its candidates are all runs of SHORTEST or more encoding characters. Each distinct candidate is set against ordinary text,
as measured on the corpus's own all-letter candidates: a chi-squared test asks whether its symbols are more evenly used
over the alphabet of its inferred encoding, a runs test whether it changes between letter cases and digits more often,
and a serial-correlation test whether neighbours are less related. The three are combined into one p-value per
candidate, and Benjamini-Hochberg control over all distinct candidates, weighted by length (weights average 1), decides.

Edge cases: a null or empty text has no spans; a null doc_id is carried through; repeated rows have spans of their own
but are one hypothesis; without ordinary candidates nothing is added; an empty table gives no rows; other columns are
ignored. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import text_or_empty, written

# Fixed patterns ---------------------------------------------------------------------------------
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same as the longest runs, 18 characters or more kept
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
SHORTEST = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: Share of false discoveries among what the battery adds, at most, in expectation.
FALSE_SHARE = 0.01
#: p-values are rounded up to steps of a hundredth of a decade for the count; 30 decades are told apart.
STEPS, DECADES = 100, 30
_GROUP = 64


def prefix_sums(values: Column) -> Column:
    """Sum of the elements before each one, in groups of 64, so that long arrays don't cost the square of their length."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: a + v)

    n = F.size(values)
    groups = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _GROUP).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(groups, lambda g: total(F.slice(values, g * _GROUP + 1, F.lit(_GROUP))))
    begins = F.transform(groups, lambda g: total(F.slice(sums, F.lit(1), g)))
    return F.flatten(F.transform(groups, lambda g: F.transform(
        F.slice(values, g * _GROUP + 1, F.lit(_GROUP)),
        lambda v, i: F.get(begins, g) + total(F.slice(values, g * _GROUP + 1, i)))))


def add_found(df: DataFrame, name: str, pattern: str, gate: Column, group: int | None = None) -> DataFrame:
    """Adds ``name``: (start, end, match) of the leftmost non-overlapping matches in _text; with ``group``, ``match`` is that
    group's text. Each step is a column of its own, so no pattern is run twice."""
    text, none = F.col("_text"), F.array().cast("array<int>")
    df = df.withColumn("_gate", gate)
    df = df.withColumn("_gaps", F.when(F.col("_gate"), F.transform(F.split(text, pattern, -1), F.length)).otherwise(none)) \
        .withColumn("_whole", F.when(F.col("_gate"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    said = F.col("_whole") if group is None else F.when(F.col("_gate"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_sizes", F.transform("_whole", F.length)).withColumn("_said", said) \
        .withColumn("_steps", F.zip_with(F.slice("_gaps", F.lit(1), F.size("_sizes")), F.col("_sizes"), lambda g, s: (g + s).cast("bigint")))
    df = df.withColumn("_before", prefix_sums(F.col("_steps")))
    spans = F.zip_with(F.zip_with("_before", F.slice("_gaps", F.lit(1), F.size("_sizes")), lambda b, g: b + g), F.arrays_zip("_sizes", "_said"),
                       lambda a, m: F.struct(a.alias("start"), (a + m["_sizes"]).alias("end"), m["_said"].alias("match")))
    return df.withColumn(name, spans).drop("_gate", "_gaps", "_whole", "_sizes", "_said", "_steps", "_before")


def base_spans(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry``, the three kinds' spans, and the battery's candidates, row by row. Cheap tests come before each pattern."""
    t = F.col("_text")
    rows = docs.select(*carry, text_or_empty(text).alias("_text"))
    may_assign = (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(ASSIGN_GATE)
    rows = add_found(rows, "assign", ASSIGN, may_assign, 2)
    rows = add_found(rows, "access", ACCESS, F.contains(t, F.lit("AKIA")))
    rows = add_found(rows, "hex", HEX, t.rlike(HEX))
    rows = add_found(rows, "tokens", TOKEN, t.rlike(TOKEN))
    return rows.select(*carry, F.filter("assign", lambda s: F.length(s["match"]) >= 12).alias("assign"), "access", "hex", "tokens")


def normal_cdf(z: Column) -> Column:
    """A logistic fit of the normal distribution function; it keeps the order of tails however small."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(-1.5976 * z - 0.070565992 * z * z * z))


def measured(candidates: DataFrame) -> DataFrame:
    """Per distinct candidate ``s``: length n, alphabet size k of its inferred encoding, sum of squared symbol counts, number of
    case or digit changes and of pairs they could fall on, lag-1 correlation of symbol values, and whether it is all letters."""
    s = F.col("s")
    body = F.regexp_replace(s, "=+$", "")
    k = F.when(s.rlike("^[0-9]+$"), 10).when(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16).when(s.rlike("^(?:[a-z]+|[A-Z]?[a-z]+|[A-Z]+)$"), 26) \
        .when(s.rlike("^[A-Z2-7]+=*$"), 32).otherwise(64)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = F.translate(body, upper + lower + digit + "+/_=-", "U" * 26 + "l" * 26 + "d" * 10 + "ooooo")
    rows = candidates.select("s", body.alias("body"), k.alias("k"), kinds.alias("kinds"), s.rlike("^[A-Za-z]+$").alias("letters"), F.length(body).alias("n")) \
        .where("n >= 2").withColumn("chars", F.split("body", ""))
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda a, c: a + F.pow(F.col("n") - F.length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2)))
    rows = rows.withColumn("squares", squares).withColumn("v", F.transform("chars", lambda c: F.ascii(c).cast("double")))
    rows = rows.withColumn("mean", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    spread = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    cross = F.aggregate(F.zip_with(F.slice("v", F.lit(1), F.col("n") - 1), F.slice("v", F.lit(2), F.col("n") - 1),
                                   lambda x, y: (x - F.col("mean")) * (y - F.col("mean"))), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("spread", spread).withColumn("cross", cross)
    return rows.select("s", "letters", "k", F.col("n").cast("double").alias("n"), "squares",
                       F.regexp_count("kinds", F.lit("U(?=[ld])|l(?=[Ud])|d(?=[Ul])")).cast("double").alias("changes"),
                       F.regexp_count("kinds", F.lit("[Uld](?=[Uld])")).cast("double").alias("pairs"),
                       F.when(F.col("spread") > 0, F.col("cross") / F.col("spread")).otherwise(F.lit(1.0)).alias("serial"))


def battery(tokens: DataFrame) -> DataFrame:
    """Distinct candidates with their combined p-value under the hypothesis that they are ordinary text."""
    rows = written(measured(tokens.select("s").distinct()), "candidates")
    plain = F.col("letters")
    null = rows.agg(
        F.sum(F.when(plain, F.col("n") * (F.col("n") - 1))).alias("all_pairs"), F.sum(F.when(plain, F.col("squares") - F.col("n"))).alias("same_pairs"),
        F.sum(F.when(plain, F.col("changes"))).alias("changes"), F.sum(F.when(plain, F.col("pairs"))).alias("pairs"),
        F.avg(F.when(plain, F.col("serial"))).alias("serial"), F.avg("n").alias("mean_n"), F.count("*").alias("m")).first()
    if not null.all_pairs or not null.pairs:
        return rows.select("s", "n", F.lit(1.0).alias("p"))
    # Chance that two symbols of ordinary text agree; chance of a change, kept off 0.
    agree, change = null.same_pairs / null.all_pairs, (null.changes + 1) / (null.pairs + 2)
    n = F.col("n")
    even = F.greatest(F.lit(agree), 1 / F.col("k"))
    chi = F.col("k") / n * F.col("squares") - n
    chi_mean = F.col("k") * (1 + (n - 1) * even) - n
    chi_sd = F.col("k") / n * F.sqrt(2 * n * (n - 1) * even * (1 - even) * (1 + 2 * (n - 2) * even))
    z_chi = (chi_mean - chi) / chi_sd
    z_runs = (F.col("changes") - F.col("pairs") * change - 0.5) / F.sqrt(F.greatest(F.col("pairs"), F.lit(1.0)) * change * (1 - change))
    z_serial = (F.abs(F.lit(null.serial)) - F.abs(F.col("serial"))) * F.sqrt(n)
    z = sum((F.greatest(F.least(x, F.lit(8.0)), F.lit(-8.0)) for x in (z_chi, z_runs, z_serial)), F.lit(0.0)) / F.sqrt(F.lit(3.0))
    return rows.select("s", "n", normal_cdf(-z).alias("p"))


def discoveries(tested: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Candidates kept by Benjamini-Hochberg with weights n / mean n. p-values are counted on a fixed grid of at most
    DECADES * STEPS + 1 steps, rounded up, so control is never loosened and the driver sees a bounded table."""
    m, mean = tested.agg(F.count("*"), F.avg("n")).first()
    if not m:
        return tested.select("s")
    step = F.least(F.greatest(F.floor(-F.log10(F.greatest(F.col("p") * mean / F.col("n"), F.lit(1e-300))) * STEPS), F.lit(0)), F.lit(DECADES * STEPS)).cast("int")
    placed = tested.select("s", step.alias("step"))
    grid = sorted(((r.step, r.n) for r in placed.groupBy("step").agg(F.count("*").alias("n")).collect()), reverse=True)
    seen, cut = 0, None
    for at, n in grid:
        seen += n
        if 10 ** (-at / STEPS) <= false_share * seen / m:
            cut = at
    return placed.where(F.col("step") >= (DECADES * STEPS + 1 if cut is None else cut)).select("s")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of ``docs``. Only candidate strings and
    positions are ever shuffled; a string that many texts share is tested once and joined back with its hot key split."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(base_spans(named, ["doc_id"]).withColumn("rid", F.monotonically_increasing_id()), "base-spans")
    tokens = rows.select("rid", F.explode("tokens").alias("t")).select("rid", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.match").alias("s"))
    kept = written(discoveries(battery(tokens)), "discoveries")
    added = tokens.join(kept, "s").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("random"))
    full = rows.drop("tokens").join(written(added, "added"), "rid", "left")

    def placed(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    def said(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.sort_array(F.concat(placed("assign"), placed("access"), placed("hex")))
    full = full.withColumn("base", base)
    random = F.filter(F.coalesce(placed("random"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")),
                      lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    every = F.sort_array(F.concat(F.col("base"), random))
    return full.select("doc_id", F.size("assign").cast("bigint").alias("n_assign"), F.size("access").cast("bigint").alias("n_access"),
                       F.size("hex").cast("bigint").alias("n_hex"), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(every).alias("spans"))
