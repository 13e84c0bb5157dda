"""Window scores, spans, judge and sandbox evidence, cuts: over the planted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilscan.functions.rules import ADDRESS
from veilscan.functions.spans import fence, let, positions_of, unfold
from veilscan.operators import cutting as C
from veilscan.operators import evidence as E
from veilscan.operators import scoring as S
from veilscan.operators.screen import check_items, detect
from veilscan.plans.parts import lit
from veilscan.plans.registry import part, query
from veilscan.sources.planted import items, planted
from veilscan.sources.screened import PHRASES_A, PHRASES_B, scorers, with_cuts, with_hits, with_spans, with_units


def score_sql(text: str, phrases) -> str:
    return "CASE WHEN " + " OR ".join(f"contains(lower({text}), {lit(p)})" for p in phrases) + " THEN 0.99::DOUBLE ELSE 0.01::DOUBLE END"


part("windows", """
SELECT doc_id, unit_no AS a, unit_no + k AS b, texts AS window_text FROM (
  SELECT doc_id, unit_no, count(*) OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n, string_agg(text, ' ') OVER w AS texts FROM units
  WINDOW w AS (PARTITION BY doc_id ORDER BY unit_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
WHERE k = 3 OR (n <= 3 AND unit_no = 0)""", ["units"])
part("scored", f"SELECT doc_id, a, b, {score_sql('window_text', PHRASES_A)} AS score_a, {score_sql('window_text', PHRASES_B)} AS score_b FROM windows", ["windows"])


def scored(spark, sf):
    d = with_units(spark, sf).withColumn("texts", F.transform("units", lambda u: u["text"]))
    return d.withColumn("windows", fence(S.score_ranges(F.col("texts"), S.unit_windows(F.size("texts")), scorers())))


@query("unit_windows", "SELECT doc_id, a, b, md5(window_text) AS window_md5 FROM windows", ["windows"])
def unit_windows(spark, sf):
    d = with_units(spark, sf).withColumn("texts", F.transform("units", lambda u: u["text"]))
    return d.withColumn("w", S.unit_windows(F.size("texts"))).transform(unfold, ["doc_id"], F.transform("w", lambda w: F.struct(
        w["a"].alias("a"), w["b"].alias("b"), F.md5(S.range_text(F.col("texts"), w["a"], w["b"])).alias("window_md5"))))


@query("score_spans", "SELECT doc_id, a, b, score_a, score_b FROM scored", ["scored"])
def score_spans(spark, sf):
    return scored(spark, sf).transform(unfold, ["doc_id"], F.transform("windows", lambda w: F.struct(
        w["a"].alias("a"), w["b"].alias("b"), F.get(w["s"], F.lit(0)).alias("score_a"), F.get(w["s"], F.lit(1)).alias("score_b"))))


@query("keyword_scorer", f"SELECT doc_id, {score_sql('text', PHRASES_A)} AS score_a, {score_sql('text', PHRASES_B)} AS score_b FROM planted", ["planted"])
def keyword_scorer(spark, sf):
    a, b = scorers()
    one = F.array("text")
    return planted(spark, sf).select("doc_id", F.get(a.many(one), F.lit(0)).alias("score_a"), F.get(b.many(one), F.lit(0)).alias("score_b"))


@query("score_long", f"""
SELECT doc_id, count(*) AS chunks, max(score) AS score FROM (SELECT doc_id, {score_sql('substr(text, CAST(st + 1 AS BIGINT), 512)', PHRASES_A)} AS score
  FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 128, 1), 384)) AS st FROM planted)) GROUP BY doc_id""", ["planted"])
def score_long(spark, sf):
    from veilscan.functions.scorers import chunks, keyword_scorer as make

    s = make("scorer_a", PHRASES_A, size=512, overlap=128)
    return planted(spark, sf).select("doc_id", F.size(chunks(F.col("text"), 512, 128)).alias("chunks"), s.long(F.col("text")).alias("score"))


@query("whole_and_max", f"""
SELECT p.doc_id, {score_sql('p.text', PHRASES_A)} AS whole_a, {score_sql('p.text', PHRASES_B)} AS whole_b,
  coalesce(m.a, 0.0) AS max_a, coalesce(m.b, 0.0) AS max_b
FROM planted p LEFT JOIN (SELECT doc_id, max(score_a) AS a, max(score_b) AS b FROM scored GROUP BY doc_id) m USING (doc_id)""", ["planted", "scored"])
def whole_and_max(spark, sf):
    a, b = scorers()

    def top(i):
        return F.coalesce(F.array_max(F.transform("windows", lambda w: F.get(w["s"], F.lit(i)))), F.lit(0.0))
    return scored(spark, sf).select("doc_id", a.long(F.col("text")).alias("whole_a"), b.long(F.col("text")).alias("whole_b"),
                                    top(0).alias("max_a"), top(1).alias("max_b"))


part("high", "SELECT doc_id, a, b FROM scored WHERE greatest(score_a, score_b) >= 0.65", ["scored"])
TOP = f"greatest({score_sql('t', PHRASES_A)}, {score_sql('t', PHRASES_B)})"


part("pair_top", f"""
SELECT doc_id, a, {TOP} AS top FROM (
  SELECT doc_id, unit_no AS a, text || ' ' || lead(text) OVER (PARTITION BY doc_id ORDER BY unit_no) AS t FROM units) WHERE t IS NOT NULL""", ["units"])
part("single_top", f"SELECT doc_id, unit_no, {TOP} AS top FROM (SELECT doc_id, unit_no, text AS t FROM units)", ["units"])


@query("drill_down", """
SELECT doc_id, a, b, string_agg(CAST(unit_no AS VARCHAR), ',' ORDER BY unit_no) AS units FROM (
  SELECT g.doc_id, g.a, g.b, u.unit_no, u.top, bool_or(u.top >= 0.65) OVER (PARTITION BY g.doc_id, g.a) AS any_bad
  FROM (SELECT h.doc_id, h.a, h.b,
          CASE WHEN h.b - h.a = 3 AND greatest(p1.top, p2.top) >= 0.65 AND p2.top > p1.top THEN h.a + 1 ELSE h.a END AS lo,
          CASE WHEN h.b - h.a = 3 AND greatest(p1.top, p2.top) >= 0.65 THEN CASE WHEN p2.top > p1.top THEN h.a + 3 ELSE h.a + 2 END ELSE h.b END AS hi
        FROM high h LEFT JOIN pair_top p1 ON p1.doc_id = h.doc_id AND p1.a = h.a
        LEFT JOIN pair_top p2 ON p2.doc_id = h.doc_id AND p2.a = h.a + 1) g
  JOIN single_top u ON u.doc_id = g.doc_id AND u.unit_no >= g.lo AND u.unit_no < g.hi)
WHERE NOT any_bad OR top >= 0.65 GROUP BY doc_id, a, b""", ["high", "pair_top", "single_top"])
def drill_down(spark, sf):
    d = scored(spark, sf).withColumn("high", F.filter("windows", lambda w: w["top"] >= 0.65)).filter(F.size("high") > 0)
    n = F.size("texts")
    d = d.withColumn("pairs", fence(S.score_ranges(F.col("texts"), S.runs_of(n, 2), scorers()))).withColumn(
        "singles", fence(S.score_ranges(F.col("texts"), S.runs_of(n, 1), scorers())))
    return d.transform(unfold, ["doc_id"], F.transform("high", lambda w: F.struct(
        w["a"].alias("a"), w["b"].alias("b"), F.array_join(S.drill_down(w, F.col("pairs"), F.col("singles"), 0.65).cast("array<string>"), ",").alias("units"))))


@query("locate_groups")
def locate_groups(spark, sf):
    d = S.score_windows(with_units(spark, sf), scorers(), 0.65)
    return d.transform(unfold, ["doc_id"], F.transform("groups", lambda g: F.struct(
        F.array_join(g["units"].cast("array<string>"), ",").alias("units"), F.array_join(g["flagged_by"], ",").alias("flagged_by"))))


@query("unlocated_items", f"""
SELECT p.doc_id FROM planted p WHERE greatest({score_sql('p.text', PHRASES_A)}, {score_sql('p.text', PHRASES_B)}) >= 0.65
AND NOT EXISTS (SELECT 1 FROM high h WHERE h.doc_id = p.doc_id)""", ["planted", "high"])
def unlocated_items(spark, sf):
    a, b = scorers()
    high = F.exists("windows", lambda w: w["top"] >= 0.65)
    return scored(spark, sf).filter((F.greatest(a.long(F.col("text")), b.long(F.col("text"))) >= 0.65) & ~high).select("doc_id")


@query("degrade_on_failure", """
SELECT doc_id, doc_id % 10 = 0 AS failed, CASE WHEN doc_id % 10 = 0 THEN 'classifiers unavailable: decided on the rules alone' ELSE '' END AS warnings
FROM planted""", ["planted"])
def degrade_on_failure(spark, sf):
    from veilscan.functions.scorers import Scorer

    base = scorers()[0]
    failing = F.col("doc_id") % 10 == 0
    flaky = Scorer("flaky", lambda t: F.when(~failing, base.many(t)), base.cut)
    from veilscan.settings import LAYER_ARRAY, empty

    d = with_units(spark, sf).withColumn("view", F.col("text")).withColumn("layers", empty(LAYER_ARRAY)).withColumn(
        "warnings", F.array().cast("array<string>"))
    out = S.score_items(d, [flaky])
    return out.select("doc_id", F.col("scorers_failed").alias("failed"), F.array_join("warnings", "; ").alias("warnings"))


@query("units_hit", "SELECT h.doc_id, h.rule, h.s AS hit_start, u.unit_no FROM hits h JOIN units u ON u.doc_id = h.doc_id AND u.s < h.e AND h.s < u.e", ["hits", "units"])
def units_hit(spark, sf):
    d = with_hits(spark, sf).select("doc_id", "units", F.explode("hits").alias("h"))
    return d.select("doc_id", F.col("h.rule").alias("rule"), F.col("h.start").alias("hit_start"),
                    F.explode(E.units_hit(F.col("units"), F.col("h"))).alias("unit_no"))


SPANS_SQL = "SELECT doc_id, s AS span_from, e AS span_to FROM spans"


@query("collect_spans", SPANS_SQL, ["spans"])
def collect_spans(spark, sf):
    return with_spans(spark, sf).transform(unfold, ["doc_id"], F.transform("spans", lambda s: F.struct(
        s["start"].alias("span_from"), s["end"].alias("span_to"))))


@query("merge_spans", """
SELECT doc_id, min(s) AS span_from, max(e) AS span_to, count(*) AS parts FROM (
  SELECT *, sum(CASE WHEN s < prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e DESC) AS island FROM (
    SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
      SELECT doc_id, greatest(s - 30, 0) AS s, e + 30 AS e FROM hits))) GROUP BY doc_id, island""", ["hits"])
def merge_spans(spark, sf):
    from veilscan.functions.spans import by_start, fold_overlapping

    near = F.transform("hits", lambda h: F.struct(F.greatest(h["start"] - 30, F.lit(0)).alias("start"), (h["end"] + 30).alias("end"), F.lit(1).alias("n")))
    merged = fold_overlapping(by_start(near), "array<struct<start:int,end:int,n:int>>", lambda a, b: F.struct(
        a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"), (a["n"] + b["n"]).alias("n")))
    return with_hits(spark, sf).withColumn("m", merged).transform(unfold, ["doc_id"], "m").select(
        "doc_id", F.col("start").alias("span_from"), F.col("end").alias("span_to"), F.col("n").alias("parts"))


@query("span_types", "SELECT doc_id, s AS span_from, types, rules, strong_rule AS strong FROM span_facts", ["span_facts"])
def span_types(spark, sf):
    return with_spans(spark, sf).transform(unfold, ["doc_id"], F.transform("spans", lambda s: F.struct(
        s["start"].alias("span_from"), F.array_join(E.span_types(s), ",").alias("types"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(s["hits"], lambda h: h["rule"]))), ",").alias("rules"),
        E.is_strong(s).alias("strong"))))


part("hints", """
SELECT h.doc_id, h.rule, h.s, h.hit FROM hits h WHERE h.strength = 'weak' AND NOT EXISTS (
  SELECT 1 FROM spans p WHERE p.doc_id = h.doc_id AND h.s < p.e AND p.s < h.e)""", ["hits", "spans"])


def triaged(spark, sf):
    from veilscan.settings import GROUP_ARRAY, LAYER_ARRAY, empty

    d = with_hits(spark, sf).withColumn("groups", empty(GROUP_ARRAY)).withColumn("layers", empty(LAYER_ARRAY)).withColumn(
        "layer_flags", F.array().cast("array<array<string>>")).withColumn("warnings", F.array().cast("array<string>")).withColumn(
        "unlocated", F.lit(False))
    return E.triage(d)


@query("hints", "SELECT doc_id, rule, s AS hit_start, hit AS hit_text FROM hints", ["hints"])
def hints(spark, sf):
    return triaged(spark, sf).transform(unfold, ["doc_id"], "hints").select("doc_id", "rule", F.col("start").alias("hit_start"), F.col("text").alias("hit_text"))


LANES = """SELECT p.doc_id, p.source, CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = p.doc_id)
  OR EXISTS (SELECT 1 FROM hints h WHERE h.doc_id = p.doc_id) THEN 'unsure' ELSE 'clean' END AS lane FROM planted p"""


@query("lanes", LANES, ["planted", "spans", "hints"])
def lanes(spark, sf):
    return triaged(spark, sf).select("doc_id", "source", "lane")


@query("needs_judging", f"SELECT doc_id FROM ({LANES}) WHERE lane <> 'clean'", ["planted", "spans", "hints"])
def needs_judging(spark, sf):
    return E.needs_judging(triaged(spark, sf)).select("doc_id")


@query("judge_prompts", """
SELECT p.doc_id, substr(sha256('code' || p.doc_id), 1, 6) AS expected_code, coalesce(s.n, 0) + coalesce(h.n, 0) AS flagged_parts,
  contains(p.text, p.text) AS holds_content FROM planted p
LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) s USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM hints GROUP BY doc_id) h USING (doc_id)""", ["planted", "spans", "hints"])
def judge_prompts(spark, sf):
    d = triaged(spark, sf).withColumn("content", F.col("text"))
    prompts = E.judge_prompts(d, "doc_id").withColumn("flagged_parts", F.regexp_count("prompt", F.lit(r'(?m)^  \[F\d+\] "')))
    return prompts.join(d.select("doc_id", "text"), "doc_id").select(
        "doc_id", "expected_code", "flagged_parts", F.contains("prompt", F.concat(F.lit(">>>\n"), "text", F.lit("\n<<<END_"))).alias("holds_content"))


# Judge replies: quotes are exact, re-spaced and upper-cased, or invented, by document number -------
def replies(spark, sf):
    d = planted(spark, sf).withColumn("content", F.col("text"))
    n = F.col("doc_id")
    quote = F.when(n % 5 == 4, F.lit("words that are not in the content")).when(n % 2 == 0, F.col("plant")).otherwise(
        F.upper(F.replace("plant", F.lit(" "), F.lit("\n "))))
    code = E.check_code(n)
    body = F.to_json(F.struct(
        F.when(n % 31 == 0, "000000").otherwise(code).alias("check_code"), (n % 6 != 0).alias("is_attack"),
        F.array(F.lit("tool_abuse"), F.lit("not_a_type")).alias("attack_types"),
        F.array(F.struct(F.coalesce(quote, F.lit("")).alias("quote"), F.when(n % 7 == 0, "indirect_injection").otherwise("tool_abuse").alias("type"))).alias("evidence"),
        F.array(F.struct(F.lit("[f1]").alias("id"), (n % 3 != 0).alias("attack"))).alias("flagged"),
        F.lit("high").alias("confidence"), F.lit("because").alias("reason")))
    raw = F.when(n % 47 == 0, "not json").otherwise(body)
    return d.select("doc_id", "source", "text", "plant", "span_start", "span_end", "content", code.alias("expected_code"), raw.alias("raw"),
                    F.when(n % 43 == 0, "HTTP 503").alias("error"))


part("judgements", """
SELECT doc_id, source, text, NOT fail AS ok, CASE WHEN doc_id % 43 = 0 THEN 'HTTP 503' WHEN doc_id % 47 = 0 THEN 'bad reply: ValueError' END AS error,
  NOT fail AND doc_id % 31 = 0 AS took_over, NOT fail AND (doc_id % 31 = 0 OR doc_id % 6 <> 0) AS is_attack,
  CASE WHEN fail OR doc_id % 31 = 0 THEN '' ELSE 'tool_abuse' END AS types,
  CASE WHEN NOT fail AND doc_id % 31 <> 0 AND plant IS NOT NULL AND doc_id % 5 <> 4 AND doc_id % 7 <> 0
       THEN (strpos(text, plant) - 1) || '-' || (strpos(text, plant) - 1 + length(plant)) ELSE '' END AS evidence,
  CASE WHEN fail OR doc_id % 31 = 0 THEN 0::BIGINT WHEN plant IS NOT NULL AND doc_id % 5 <> 4 AND doc_id % 7 <> 0 THEN 0::BIGINT ELSE 1::BIGINT END AS unmatched_quotes,
  CASE WHEN fail OR doc_id % 31 = 0 THEN NULL ELSE doc_id % 3 <> 0 END AS vote_f1
FROM (SELECT *, doc_id % 43 = 0 OR doc_id % 47 = 0 AS fail FROM planted)""", ["planted"])


@query("parse_judge_replies", "SELECT * EXCLUDE (source, text) FROM judgements", ["judgements"])
def parse_judge_replies(spark, sf):
    j = E.parse_judge_replies(replies(spark, sf))
    spans = F.array_join(F.transform("judge.evidence", lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"))), ",")
    return j.select("doc_id", "judge.ok", "judge.error", "judge.took_over", "judge.is_attack", F.array_join("judge.types", ",").alias("types"),
                    spans.alias("evidence"), "judge.unmatched_quotes", F.try_element_at("judge.flagged", F.lit("F1")).alias("vote_f1"))


@query("find_quote", """
SELECT doc_id, strpos(text, plant) - 1 AS quote_start, strpos(text, plant) - 1 + length(plant) AS quote_end FROM planted""", ["planted"])
def find_quote(spark, sf):
    d = planted(spark, sf)
    odd = F.lower(F.replace("plant", F.lit(" "), F.lit(" \n ")))
    q = E.find_quote(F.col("text"), F.when(F.col("plant").isNull(), "words that no text here has").when(F.col("doc_id") % 2 == 0, F.col("plant")).otherwise(odd))
    return d.withColumn("q", q).select("doc_id", F.col("q.start").alias("quote_start"), F.col("q.end").alias("quote_end"))


@query("unmatched_quotes", "SELECT source, CAST(sum(unmatched_quotes) AS BIGINT) AS unmatched, count(*) FILTER (WHERE took_over) AS took_over FROM judgements GROUP BY source", ["judgements"])
def unmatched_quotes(spark, sf):
    return E.parse_judge_replies(replies(spark, sf)).groupBy("source").agg(
        F.sum("judge.unmatched_quotes").alias("unmatched"), F.count_if("judge.took_over").alias("took_over"))


def sandbox_messages(spark, sf):
    d = planted(spark, sf)
    n = F.col("doc_id")
    to = F.when(n % 2 == 0, "desk@a.example").otherwise("nobody@c.example")
    call = F.struct(F.when(n % 3 == 0, "read_latest_email").otherwise("send_email").alias("name"),
                    F.when(n % 11 == 0, "{broken").otherwise(F.to_json(F.struct(to.alias("to"), F.lit("hi").alias("subject")))).alias("arguments"))
    first = d.select("doc_id", F.lit(1).alias("turn"), F.to_json(F.array(call)).alias("tool_calls"), F.lit(None).cast("string").alias("error"))
    second = d.select("doc_id", F.lit(2).alias("turn"), F.lit("[]").alias("tool_calls"), F.when(n % 13 == 0, "TimeoutError").alias("error"))
    return first.unionByName(second)


part("sandboxed", """
SELECT doc_id, source, text, doc_id % 3 <> 0 OR doc_id % 13 <> 0 AS ok, CASE WHEN doc_id % 13 = 0 THEN 'TimeoutError' END AS error, doc_id % 3 <> 0 AS acted,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 11 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'desk@a.example' ELSE 'nobody@c.example' END END AS target
FROM planted""", ["planted"])


@query("parse_sandbox_calls", "SELECT doc_id, ok, error, acted, target, CASE WHEN acted AND doc_id % 11 = 0 THEN '{broken' END AS raw FROM sandboxed", ["sandboxed"])
def parse_sandbox_calls(spark, sf):
    s = E.parse_sandbox_calls(sandbox_messages(spark, sf), "doc_id")
    args = F.get("sandbox.calls", F.lit(0))["args"]
    return s.select("doc_id", "sandbox.ok", "sandbox.error", "sandbox.acted", F.try_element_at(args, F.lit("to")).alias("target"),
                    F.try_element_at(args, F.lit("raw")).alias("raw"))


ADDR_SQL = "'[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+|https?://[^\\s\"''<>)]+'"


@query("addresses", f"SELECT doc_id, addr AS address, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {ADDR_SQL})) AS addr FROM planted) GROUP BY ALL", ["planted"])
def addresses(spark, sf):
    return planted(spark, sf).select("doc_id", F.explode(E.addresses(F.col("text"))).alias("address")).groupBy("doc_id", "address").agg(F.count("*").alias("n"))


part("address_spots", """
SELECT doc_id, source, list_sum(list_transform(pieces[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(target) AS pos, target FROM (
  SELECT doc_id, source, target, pieces, unnest(range(1, len(pieces))) AS k FROM (
    SELECT doc_id, source, target, string_split(lower(text), target) AS pieces FROM sandboxed WHERE target IS NOT NULL))""", ["sandboxed"])


@query("locate_addresses", "SELECT doc_id, pos AS spot_start, pos + length(target) AS spot_end FROM address_spots", ["address_spots"])
def locate_addresses(spark, sf):
    s = E.parse_sandbox_calls(sandbox_messages(spark, sf), "doc_id")
    d = planted(spark, sf).select("doc_id", "text").join(s, "doc_id")
    return d.transform(unfold, ["doc_id"], E.locate_addresses(F.col("text"), F.col("sandbox.calls"))).select(
        "doc_id", F.col("start").alias("spot_start"), F.col("end").alias("spot_end"))


def with_both(spark, sf):
    j = E.parse_judge_replies(replies(spark, sf)).select("doc_id", "judge")
    s = E.parse_sandbox_calls(sandbox_messages(spark, sf), "doc_id")
    return with_spans(spark, sf).join(j, "doc_id").join(s, "doc_id")


def evidence_tables(spark, sf):
    """The judge's and the sandbox's evidence on every planted document, by item."""
    j = E.parse_judge_replies(replies(spark, sf)).select(F.col("doc_id").alias("item_id"), "judge")
    s = E.parse_sandbox_calls(sandbox_messages(spark, sf), "doc_id").withColumnRenamed("doc_id", "item_id")
    return j, s


part("counted", """
SELECT s.doc_id, s.source, s.ok AND s.acted AND (s.source IS DISTINCT FROM 'user' OR NOT (j.ok AND NOT j.took_over) OR j.is_attack) AS counts,
  j.ok AND NOT j.took_over AS judged, j.is_attack, j.took_over, j.ok AS judge_ok, j.error AS judge_error, s.error AS sandbox_error, j.vote_f1, j.evidence
FROM sandboxed s JOIN judgements j USING (doc_id)""", ["sandboxed", "judgements"])


@query("sandbox_counts", "SELECT doc_id, source, counts FROM counted", ["counted"])
def sandbox_counts(spark, sf):
    return with_both(spark, sf).select("doc_id", "source", E.sandbox_counts(F.col("sandbox"), F.col("judge"), F.col("source")).alias("counts"))


KEEPS = """
SELECT f.doc_id, f.s AS span_from, CASE WHEN NOT c.judged THEN NULL ELSE c.is_attack AND ((CASE WHEN f.k = 1 THEN c.vote_f1 ELSE TRUE END) OR
  (c.evidence <> '' AND TRY_CAST(split_part(c.evidence, '-', 1) AS BIGINT) < f.e AND f.s < TRY_CAST(split_part(c.evidence, '-', 2) AS BIGINT))) END AS keeps
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM spans) f JOIN counted c USING (doc_id)"""


@query("judge_keeps", KEEPS, ["spans", "counted"])
def judge_keeps(spark, sf):
    d = with_both(spark, sf)
    return d.transform(unfold, ["doc_id"], F.transform("spans", lambda s, i: F.struct(
        s["start"].alias("span_from"), F.when(E.judged(F.col("judge")), E.judge_keeps(F.col("judge"), i, s)).alias("keeps"))))


def decided(spark, sf, with_judge=True):
    from veilscan.operators.screen import decide

    d = with_both(spark, sf) if with_judge else with_spans(spark, sf).withColumn("judge", F.lit(None).cast(E.JUDGE)).withColumn(
        "sandbox", F.lit(None).cast(E.SANDBOX))
    lane = F.when(F.size("spans") > 0, "unsure").otherwise("clean")
    d = d.withColumn("content", F.col("text")).withColumn("lane", lane).withColumn("unlocated", F.lit(False)).withColumn(
        "warnings", F.array().cast("array<string>")).withColumn("judge_configured", F.lit(with_judge))
    return decide(d)


@query("decide_cuts")
def decide_cuts(spark, sf):
    return decided(spark, sf).transform(unfold, ["doc_id"], F.transform("cuts", lambda c: F.struct(
        c["start"].alias("cut_start"), c["end"].alias("cut_end"), F.array_join(c["types"], ",").alias("types"),
        F.array_join(c["found_by"], ",").alias("found_by"), c["strong_rule"].alias("strong_rule"))))


@query("cleared_spans", f"SELECT k.doc_id, k.span_from FROM ({KEEPS}) k JOIN span_facts f ON f.doc_id = k.doc_id AND f.s = k.span_from "
       "WHERE k.keeps = FALSE AND NOT f.strong_rule", ["spans", "counted", "span_facts"])
def cleared_spans(spark, sf):
    return decided(spark, sf).transform(unfold, ["doc_id"], F.transform("cleared", lambda c: F.struct(c["start"].alias("span_from"))))


@query("verdicts", """
SELECT c.doc_id, CASE WHEN c.took_over THEN 'quarantine' WHEN has_cut THEN 'sanitise' WHEN (c.judged AND c.is_attack) OR c.counts THEN 'quarantine' ELSE 'allow' END AS verdict
FROM (SELECT c.*, EXISTS (SELECT 1 FROM span_facts f WHERE f.doc_id = c.doc_id AND f.strong_rule) OR (c.judged AND c.is_attack AND c.evidence <> '')
        OR (c.counts AND EXISTS (SELECT 1 FROM address_spots a WHERE a.doc_id = c.doc_id)) AS has_cut FROM counted c) c""",
       ["counted", "span_facts", "address_spots"])
def verdicts(spark, sf):
    return decided(spark, sf).select("doc_id", "verdict")


@query("decision_warnings", """
SELECT c.doc_id, concat_ws('; ', CASE WHEN NOT c.judge_ok THEN 'judge unavailable (' || c.judge_error || '): decided without it' END,
  CASE WHEN c.sandbox_error IS NOT NULL THEN 'sandbox error (' || c.sandbox_error || ')' END) AS warnings FROM counted c""", ["counted"])
def decision_warnings(spark, sf):
    return decided(spark, sf).select("doc_id", F.array_join("warnings", "; ").alias("warnings"))


CUTS_SQL = "SELECT doc_id, s AS cut_start, e AS cut_end, types, found_by, rules, strong_rule FROM cuts"


@query("confidence", "SELECT doc_id, s AS cut_start, CASE WHEN strong_rule THEN 'medium' ELSE 'low' END AS confidence FROM cuts", ["cuts"])
def confidence(spark, sf):
    return with_cuts(spark, sf).transform(unfold, ["doc_id"], F.transform("cuts", lambda c: F.struct(
        c["start"].alias("cut_start"), E.confidence(c["strong_rule"], c["found_by"]).alias("confidence"))))


@query("widen_to_sentence", """
SELECT h.doc_id, h.rule, h.s AS hit_start, least(min(u.s), h.s) AS wide_from, greatest(max(u.e), h.e) AS wide_to,
  least(min(u.s), h.s, coalesce(any_value(lo.s), min(u.s))) AS near_from, greatest(max(u.e), h.e, coalesce(any_value(hi.e), max(u.e))) AS near_to
FROM (SELECT h.doc_id, h.rule, h.s, h.e, min(u.unit_no) AS first_no, max(u.unit_no) AS last_no FROM hits h
      JOIN units u ON u.doc_id = h.doc_id AND u.s < h.e AND h.s < u.e GROUP BY ALL) h
JOIN units u ON u.doc_id = h.doc_id AND u.unit_no BETWEEN h.first_no AND h.last_no
LEFT JOIN units lo ON lo.doc_id = h.doc_id AND lo.unit_no = h.first_no - 1
LEFT JOIN units hi ON hi.doc_id = h.doc_id AND hi.unit_no = h.last_no + 1
GROUP BY h.doc_id, h.rule, h.s, h.e""", ["hits", "units"])
def widen_to_sentence(spark, sf):
    d = with_hits(spark, sf).select("doc_id", "text", "units", F.explode("hits").alias("h"))
    a = C.widen_to_sentence(F.col("text"), F.col("units"), F.col("h.start"), F.col("h.end"))
    b = C.widen_to_sentence(F.col("text"), F.col("units"), F.col("h.start"), F.col("h.end"), neighbours=True)
    d = d.withColumn("a", a).withColumn("b", b)
    return d.select("doc_id", F.col("h.rule").alias("rule"), F.col("h.start").alias("hit_start"), F.col("a.start").alias("wide_from"),
                    F.col("a.end").alias("wide_to"), F.col("b.start").alias("near_from"), F.col("b.end").alias("near_to"))


@query("payload_sweep", "SELECT DISTINCT doc_id, s AS cut_start, e AS cut_end, types FROM sweeps", ["sweeps"])
def payload_sweep(spark, sf):
    swept = F.filter("swept", lambda c: F.array_contains(c["found_by"], "payload sweep"))
    return with_cuts(spark, sf).transform(unfold, ["doc_id"], F.transform(swept, lambda c: F.struct(
        c["start"].alias("cut_start"), c["end"].alias("cut_end"), F.array_join(c["types"], ",").alias("types"))))


@query("merge_cuts", CUTS_SQL, ["cuts"])
def merge_cuts(spark, sf):
    return with_cuts(spark, sf).transform(unfold, ["doc_id"], F.transform("cuts", lambda c: F.struct(
        c["start"].alias("cut_start"), c["end"].alias("cut_end"), F.array_join(c["types"], ",").alias("types"),
        F.array_join(c["found_by"], ",").alias("found_by"), F.array_join(c["rules"], ",").alias("rules"), c["strong_rule"].alias("strong_rule"))))


@query("cut_label", "SELECT doc_id, a AS kept_from, label FROM kept WHERE label <> ''", ["kept"])
def cut_label(spark, sf):
    d = with_cuts(spark, sf)
    return d.transform(unfold, ["doc_id"], F.transform("cuts", lambda c, i: F.struct(
        F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["end"]).alias("kept_from"), C.cut_label(c["types"]).alias("label"))))


def applied(spark, sf):
    return with_cuts(spark, sf).filter(F.size("cuts") > 0).withColumn("cleaned", C.apply_cuts(F.col("text"), F.col("cuts")))


@query("apply_cuts", f"""
SELECT doc_id, md5(string_agg(piece || label, '' ORDER BY k)) AS text_md5, md5(coalesce(string_agg(piece, chr(10) ORDER BY k) FILTER (WHERE trim(piece, ' ' || chr(10) || chr(9)) <> ''), '')) AS detect_md5,
  count(*) FILTER (WHERE trim(piece, ' ' || chr(10) || chr(9)) <> '') AS segments FROM kept GROUP BY doc_id""", ["kept"])
def apply_cuts(spark, sf):
    return applied(spark, sf).select("doc_id", F.md5("cleaned.text").alias("text_md5"), F.md5("cleaned.detect").alias("detect_md5"),
                                     F.size("cleaned.segments").alias("segments"))


@query("kept_to_original", """
SELECT doc_id, mid AS detect_pos, a + (mid - d) AS original_pos FROM (
  SELECT doc_id, a, n, d, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS _x, d + n // 2 AS mid FROM (
    SELECT doc_id, k, a, length(piece) AS n, CAST(coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS d
    FROM kept WHERE trim(piece, ' ' || chr(10) || chr(9)) <> ''))""", ["kept"])
def kept_to_original(spark, sf):
    d = applied(spark, sf).withColumn("seg", F.col("cleaned.segments"))
    return d.transform(unfold, ["doc_id"], F.transform("seg", lambda s: let(s["d"] + F.floor(s["n"] / 2).cast("int"), lambda m: F.struct(
        m.alias("detect_pos"), C.to_original(m, F.col("seg")).alias("original_pos")))))


@query("removed_text", "SELECT c.doc_id, c.s AS cut_start, substr(p.text, c.s + 1, c.e - c.s) AS removed FROM cuts c JOIN planted p USING (doc_id)", ["cuts", "planted"])
def removed_text(spark, sf):
    d = with_cuts(spark, sf).withColumn("r", C.removed_text(F.col("text"), F.col("cuts")))
    return d.transform(unfold, ["doc_id"], F.transform("cuts", lambda c, i: F.struct(c["start"].alias("cut_start"), F.get("r", i).alias("removed"))))


@query("screen_verdicts_by_source", """
SELECT source, CASE WHEN n_strong > 0 THEN 'sanitise' ELSE 'allow' END AS verdict, count(*) AS n FROM (
  SELECT p.doc_id, p.source, count(f.doc_id) AS n_strong FROM planted p LEFT JOIN spans f USING (doc_id) GROUP BY ALL) GROUP BY ALL""", ["planted", "spans"])
def screen_verdicts_by_source(spark, sf):
    return decided(spark, sf, with_judge=False).groupBy("source", "verdict").agg(F.count("*").alias("n"))


def screened(spark, sf):
    """The whole check with scorers, language gate and re-check."""
    return check_items(items(spark, sf), scorers())


@query("recheck_rounds")
def recheck_rounds(spark, sf):
    return screened(spark, sf).groupBy("verdict", "rounds").agg(F.count("*").alias("n"))


@query("check_items")
def check_items_report(spark, sf):
    r = screened(spark, sf)
    return r.select("item_id", "source", "verdict", "lane", "risk", F.size("attacks").alias("cuts"), F.size("hints").alias("hints"),
                    F.size("non_english_spans").alias("foreign_spans"), F.md5("clean_content").alias("clean_md5"), F.array_join("warnings", "; ").alias("warnings"))
