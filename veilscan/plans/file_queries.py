"""Extracted-file tables (glyphs, runs, boxes) and the dictionary gate, over tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilscan.functions.language import INDIC_MARKERS
from veilscan.operators import hidden_runs as H
from veilscan.operators import lexicon as X
from veilscan.plans.parts import lit
from veilscan.plans.registry import part, query
from veilscan.sources.planted import table, texts

part("glyphs", """
SELECT l_suppkey AS doc, l_linenumber AS page, l_orderkey * 10 + l_linenumber AS seq, l_orderkey, l_quantity * 12 AS x0, l_quantity * 12 + 8 AS x1, l_partkey % 900 AS top, l_partkey % 900 + 10 AS bottom,
  CASE WHEN l_orderkey % 13 = 0 THEN 1.0 ELSE 9.0 END AS size, CASE WHEN l_orderkey % 3 = 0 THEN 0.97 ELSE 0.2 END AS shade, substr('abcdefghij', CAST(l_orderkey % 10 + 1 AS BIGINT), 1) AS char FROM lineitem""")
part("rects", "SELECT l_suppkey AS doc, l_linenumber AS page, l_quantity * 12 - 30 AS x0, l_quantity * 12 + 200 AS x1, l_partkey % 900 - 20 AS top, l_partkey % 900 + 120 AS bottom FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01' AND l_orderkey % 5 <> 0")
part("glyph_kinds", """
SELECT g.doc, g.page, g.seq, g.char, CASE WHEN x1 <= 0 OR x0 >= 580 OR bottom <= 0 OR top >= 800 THEN 'pdf_off_page_text' WHEN size < 2 THEN 'pdf_tiny_text'
  WHEN shade >= 0.95 AND NOT EXISTS (SELECT 1 FROM rects r WHERE r.doc = g.doc AND r.page = g.page AND r.x0 <= g.x0 AND g.x1 <= r.x1 AND r.top <= g.top AND g.bottom <= r.bottom) THEN 'pdf_white_text' END AS kind FROM glyphs g""", ["glyphs", "rects"])


def glyphs(spark, sf):
    x = table(spark, sf, "lineitem")
    k, top = F.col("l_orderkey"), (F.col("l_partkey") % 900).cast("double")
    g = x.select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), (k * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_quantity") * 12).alias("x0"),
                 (F.col("l_quantity") * 12 + 8).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.when(k % 13 == 0, 1.0).otherwise(9.0).alias("size"),
                 F.array(F.when(k % 3 == 0, 0.97).otherwise(0.2)).alias("color"), F.substring(F.lit("abcdefghij"), (k % 10 + 1).cast("int"), F.lit(1)).alias("char"))
    pages = g.select("doc", "page").distinct().select("doc", "page", F.lit(0.0).alias("left"), F.lit(580.0).alias("right"), F.lit(0.0).alias("upper"), F.lit(800.0).alias("lower"))
    rects = x.filter("l_shipdate < TIMESTAMP_NTZ '1993-01-01'").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 12 - 30).alias("x0"),
                                                              (F.col("l_quantity") * 12 + 200).alias("x1"), (top - 20).alias("top"), (top + 120).alias("bottom"), (k % 5 != 0).alias("filled"), F.array(F.lit(0.1)).alias("color"))
    return H.glyph_hidden_kind(g, pages, rects)


@query("glyph_hidden_kind", "SELECT doc, page::BIGINT AS page, kind, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM glyph_kinds GROUP BY ALL", ["glyph_kinds"])
def glyph_hidden_kind(spark, sf):
    return glyphs(spark, sf).groupBy("doc", "page", "kind").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("page_text", """
SELECT doc, page::BIGINT AS page, kind, text, e - length(text) AS block_start, e AS block_end FROM (
  SELECT doc, page, kind, text, CAST(sum(length(text) + CASE WHEN rank_in = 1 THEN 0 ELSE 2 END) OVER (PARTITION BY doc, page ORDER BY rk) AS BIGINT) AS e FROM (
    SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY rk) AS rank_in FROM (
      SELECT doc, page, kind, CASE kind WHEN 'pdf_white_text' THEN 1 WHEN 'pdf_tiny_text' THEN 2 WHEN 'pdf_off_page_text' THEN 3 ELSE 0 END AS rk, string_agg(char, '' ORDER BY seq, char) AS text FROM glyph_kinds GROUP BY ALL)))""", ["glyph_kinds"])
def page_text(spark, sf):
    return H.page_text(glyphs(spark, sf)).select("doc", "page", "kind", "text", F.col("start").alias("block_start"), F.col("end").alias("block_end"))


part("runs", """
SELECT o_custkey AS doc, o_orderkey AS seq, o_orderpriority AS text, CASE WHEN o_orderkey % 7 = 0 OR o_orderstatus = 'P' THEN 'docx_hidden_text' WHEN CASE WHEN o_orderkey % 4 = 0 THEN 1.0 WHEN o_orderkey % 4 = 1 THEN 11.0 ELSE 12.0 END < 2 THEN 'docx_tiny_text'
  WHEN o_orderkey % 5 = 0 THEN 'docx_white_text' END AS kind FROM orders""")


def runs(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    k = F.col("o_orderkey")
    kind = H.run_hidden_kind(k % 7 == 0, F.col("o_orderstatus") == "P", F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 11.0), F.lit(12.0),
                             F.when(k % 5 == 0, F.array(F.lit(250), F.lit(255), F.lit(244))).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0))))
    return o.select(F.col("o_custkey").alias("doc"), k.alias("seq"), F.col("o_orderpriority").alias("text"), kind.alias("kind"))


@query("run_hidden_kind", "SELECT seq, kind FROM runs", ["runs"])
def run_hidden_kind(spark, sf):
    return runs(spark, sf).select("seq", "kind")


@query("merge_adjacent_runs", """
SELECT doc, kind, CAST(min(e - length(text)) AS BIGINT) AS range_start, CAST(max(e) AS BIGINT) AS range_end FROM (
  SELECT *, seq_no - row_number() OVER (PARTITION BY doc, kind ORDER BY seq) AS island FROM (
    SELECT *, sum(length(text)) OVER (PARTITION BY doc ORDER BY seq) AS e, row_number() OVER (PARTITION BY doc ORDER BY seq) AS seq_no FROM runs)) WHERE kind IS NOT NULL GROUP BY doc, kind, island""", ["runs"])
def merge_adjacent_runs(spark, sf):
    return H.merge_adjacent_runs(runs(spark, sf)).select("doc", "kind", F.col("start").alias("range_start"), F.col("end").alias("range_end"))


@query("ocr_reading_order")
def ocr_reading_order(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    k = F.col("o_orderkey")
    y, x = (k * 17 % 200).cast("double"), (k * 31 % 400).cast("double")
    return H.ocr_reading_order(o.select(F.col("o_custkey").alias("page"), k.alias("seq"), F.col("o_orderpriority").alias("text"), x.alias("min_x"), (x + 40).alias("max_x"), y.alias("min_y"), (y + 12).alias("max_y")))


@query("distinct_headers", "SELECT o_custkey AS doc, o_orderpriority AS text, min(o_orderkey) AS seq FROM orders GROUP BY ALL")
def distinct_headers(spark, sf):
    o = table(spark, sf, "orders")
    return H.distinct_headers(o.select(F.col("o_custkey").alias("doc"), F.concat(F.lit(" "), "o_orderpriority").alias("text"), F.col("o_orderkey").alias("seq"))).select("doc", "text", "seq")


# Dictionary gate: the dictionary is the words of the benchmark texts --------------------------------
def measures(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", X.gate_words(F.concat("text", F.when(F.col("doc_id") % 10 == 0, " bhejo turant").otherwise(""))).alias("words"))
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).filter(F.char_length("word") >= 2)
    return X.measured_texts(docs, "doc_id", "words", words, INDIC_MARKERS)


STEM_SQL = ", ".join(f"CASE WHEN word LIKE '%{e}' AND length(word) >= {n} THEN left(word, length(word) - {c}) || '{b}' END" for e, c, b, n in X.SUFFIXES)
part("dict", "SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) WHERE length(word) >= 2")
part("gate_words", r"""
SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(regexp_replace(text || CASE WHEN doc_id % 10 = 0 THEN ' bhejo turant' ELSE '' END,
  'https?://\S+|www\.\S+', ' url ', 'g'), '(?:^|\s)-[A-Za-z0-9_-]+', ' ', 'g'), '[A-Za-z]+'), lambda w: lower(w)) AS ws FROM documents)""")
part("vocab", f"""
SELECT word, CASE WHEN length(word) <= 1 THEN word IN ('a', 'i') ELSE EXISTS (SELECT 1 FROM dict d WHERE list_contains(forms, d.word)) OR EXISTS (
  SELECT 1 FROM dict a JOIN dict b ON a.word || b.word = v.word) END AS english FROM (SELECT word, [word, {STEM_SQL}] AS forms FROM (SELECT DISTINCT word FROM gate_words)) v""", ["gate_words", "dict"])
MARKS = "(" + ", ".join(lit(m) for m in INDIC_MARKERS) + ")"
part("measures", f"""
SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE english) AS english, count(*) FILTER (WHERE marker) AS markers, max(run) AS max_run FROM (
  SELECT *, count(*) FILTER (WHERE odd) OVER (PARTITION BY doc_id, island) AS run FROM (
    SELECT *, sum(CASE WHEN odd THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
      SELECT w.doc_id, w.pos, v.english, w.word IN {MARKS} AS marker, NOT v.english OR w.word IN {MARKS} AS odd FROM gate_words w JOIN vocab v USING (word)))) GROUP BY doc_id""", ["gate_words", "vocab"])


@query("lexical_english_ratio", "SELECT doc_id, total, english, round(english / total, 3) AS ratio FROM measures", ["measures"])
def lexical_english_ratio(spark, sf):
    return measures(spark, sf).select("doc_id", "total", "english", F.round("ratio", 3).alias("ratio"))


@query("indic_marker_engine", "SELECT doc_id, markers, max_run, NOT (markers >= 2 OR (markers >= 1 AND total <= 6) OR max_run >= 3) AS english FROM measures", ["measures"])
def indic_marker_engine(spark, sf):
    return X.gate_verdicts(measures(spark, sf)).select("doc_id", "markers", "max_run", F.col("marker_english").alias("english"))


HYBRID = "(markers >= 2 OR (markers = 1 AND total <= 7) OR (markers >= 1 AND max_run >= 2))"


@query("hybrid_language_gate", f"""
SELECT doc_id, NOT ({HYBRID} OR max_run >= 3 OR (total >= 4 AND english / total < 0.65)) AS english FROM measures""", ["measures"])
def hybrid_language_gate(spark, sf):
    return X.gate_verdicts(measures(spark, sf)).select("doc_id", F.col("hybrid_english").alias("english"))


@query("gate_benchmark", f"""
SELECT d.lang, count(*) AS n, count(*) FILTER (WHERE english / total < 0.70) AS lexical_flags, count(*) FILTER (WHERE markers >= 2 OR (markers >= 1 AND total <= 6) OR max_run >= 3) AS marker_flags,
  count(*) FILTER (WHERE {HYBRID} OR max_run >= 3 OR (total >= 4 AND english / total < 0.65)) AS hybrid_flags FROM measures JOIN documents d USING (doc_id) GROUP BY d.lang""", ["measures"])
def gate_benchmark(spark, sf):
    v = X.gate_verdicts(measures(spark, sf)).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return v.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~F.col("lexical_english")).alias("lexical_flags"), F.count_if(~F.col("marker_english")).alias("marker_flags"),
                                 F.count_if(~F.col("hybrid_english")).alias("hybrid_flags"))


@query("sliding_word_windows", """
SELECT doc_id, a, least(a + 10, n) AS b FROM (SELECT doc_id, n, unnest(range(0, greatest(n - 10, 0) + 1, 2)) AS a FROM (SELECT doc_id, count(*) AS n FROM gate_words GROUP BY doc_id))""", ["gate_words"])
def sliding_word_windows(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", F.size(X.gate_words(F.concat("text", F.when(F.col("doc_id") % 10 == 0, " bhejo turant").otherwise("")))).alias("n"))
    return docs.select("doc_id", F.inline(X.word_windows(F.col("n"))))


# Reports over a manifest of planted files: technique and format by document number ------------------
part("file_results", """
SELECT doc_id, label, verdict, n_attacks, error, CASE doc_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'docx' ELSE 'pdf' END AS format, 'technique-' || doc_id % 4 AS technique,
  'render-' || doc_id % 5 AS rendering, set_name, n_attacks > 0 AND doc_id % 2 = 0 AS located, CASE WHEN label = 1 AND verdict IS NOT NULL AND verdict <> 'quarantine' THEN verdict <> 'allow' AND doc_id % 7 <> 0 END AS payload_gone
FROM results""", ["results"])


def file_results(spark, sf):
    from veilscan.sources.results import eval_results

    r, k = eval_results(spark, sf), F.col("doc_id")
    fmt = F.when(k % 3 == 0, "html").when(k % 3 == 1, "docx").otherwise("pdf")
    hidden_in = F.when(k % 2 == 0, F.array(F.lit("pdf_white_text"))).otherwise(F.array().cast("array<string>"))
    attacks = F.transform("attacks", lambda a: a.withField("hidden_in", hidden_in))
    clean = F.when((F.col("label") == 1) & F.col("verdict").isNotNull() & (F.col("verdict") != "quarantine"), (F.col("verdict") != "allow") & (k % 7 != 0))
    return r.select("doc_id", "label", "verdict", "error", fmt.alias("format"), F.concat(F.lit("technique-"), (k % 4).cast("string")).alias("technique"),
                    F.concat(F.lit("render-"), (k % 5).cast("string")).alias("rendering"), attacks.alias("attacks"), clean.alias("payload_gone"))


CAUGHT = "verdict IN ('sanitise', 'quarantine')"


@query("file_set_summary", f"""
SELECT format, label = 1 AS attack, count(*) AS n, count(*) FILTER (WHERE {CAUGHT}) AS flagged, count(*) FILTER (WHERE located) AS located,
  count(payload_gone) AS payload_n, count(*) FILTER (WHERE payload_gone) AS payload_gone FROM file_results WHERE error IS NULL GROUP BY ALL""", ["file_results"])
def file_set_summary(spark, sf):
    r = file_results(spark, sf).filter("error IS NULL")
    located = F.exists("attacks", lambda a: F.size(a["hidden_in"]) > 0)
    return r.groupBy("format", (F.col("label") == 1).alias("attack")).agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict").isin("sanitise", "quarantine")).alias("flagged"), F.count_if(located).alias("located"),
        F.count("payload_gone").alias("payload_n"), F.count_if("payload_gone").alias("payload_gone"))


@query("technique_table", f"""
SELECT format, CASE WHEN format = 'pdf' THEN rendering ELSE technique END AS tech, count(*) FILTER (WHERE label = 1) AS attacks, count(*) FILTER (WHERE label = 1 AND {CAUGHT}) AS attacks_flagged,
  count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label = 0 AND {CAUGHT}) AS benign_flagged FROM file_results WHERE error IS NULL GROUP BY ALL""", ["file_results"])
def technique_table(spark, sf):
    r = file_results(spark, sf).filter("error IS NULL").withColumn("tech", F.when(F.col("format") == "pdf", F.col("rendering")).otherwise(F.col("technique")))
    hit = F.col("verdict").isin("sanitise", "quarantine")
    attack = F.col("label") == 1
    return r.groupBy("format", "tech").agg(F.count_if(attack).alias("attacks"), F.count_if(attack & hit).alias("attacks_flagged"),
                                           F.count_if(~attack).alias("benign"), F.count_if(~attack & hit).alias("benign_flagged"))


@query("pdf_family_table", f"SELECT technique AS family, count(*) AS n, count(*) FILTER (WHERE {CAUGHT}) AS flagged FROM file_results WHERE error IS NULL AND format = 'pdf' AND label = 1 GROUP BY 1", ["file_results"])
def pdf_family_table(spark, sf):
    r = file_results(spark, sf).filter("error IS NULL AND format = 'pdf' AND label = 1")
    return r.groupBy(F.col("technique").alias("family")).agg(F.count("*").alias("n"), F.count_if(F.col("verdict").isin("sanitise", "quarantine")).alias("flagged"))


@query("merged_word_windows", f"""
SELECT doc_id, min(a) AS from_word, max(b) AS to_word FROM (SELECT *, sum(CASE WHEN a <= prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM (
  SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
    SELECT g.doc_id, w.a, least(w.a + 10, g.n) AS b FROM (SELECT doc_id, count(*) AS n FROM gate_words GROUP BY doc_id) g, LATERAL (SELECT unnest(range(0, greatest(g.n - 10, 0) + 1, 2)) AS a) w
    WHERE EXISTS (SELECT 1 FROM gate_words x WHERE x.doc_id = g.doc_id AND x.pos > w.a AND x.pos <= w.a + 10 AND x.word IN {MARKS})))) GROUP BY doc_id, island""", ["gate_words"])
def merged_word_windows(spark, sf):
    from veilscan.functions.spans import fence, fold_overlapping, unfold

    docs = texts(spark, sf, "documents").select("doc_id", fence(X.gate_words(F.concat("text", F.when(F.col("doc_id") % 10 == 0, " bhejo turant").otherwise("")))).alias("w"))
    marks = docs.withColumn("m", fence(F.filter(F.transform("w", lambda w, i: F.when(w.isin(INDIC_MARKERS), i)), lambda i: i.isNotNull())))
    flagged = F.filter(X.word_windows(F.size("w")), lambda x: F.exists("m", lambda i: (i >= x["a"]) & (i < x["b"])))
    spans = F.transform(flagged, lambda x: F.struct(x["a"].alias("start"), x["b"].alias("end")))
    merged = fold_overlapping(spans, "array<struct<start:int,end:int>>", lambda a, b: F.struct(a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end")), touching=True)
    return marks.filter(F.size("m") > 0).transform(unfold, ["doc_id"], merged).select("doc_id", F.col("start").alias("from_word"), F.col("end").alias("to_word"))


# Mail lines and concealed layers -----------------------------------------------------------------------
def mail_lines(spark, sf):
    from veilscan.functions.spans import fence
    from veilscan.operators.language import rejoin_wrapped, scored_lines
    from veilscan.sources.screened import with_units

    d = with_units(spark, sf).filter("source = 'email'").withColumn("lines", fence(scored_lines(F.col("units"), F.lit(True))))
    return d.withColumn("lines", fence(rejoin_wrapped(F.col("lines"), F.col("text"))))


@query("drop_mail_metadata", """
SELECT u.doc_id, u.unit_no, CASE WHEN starts_with(u.text, 'From:') THEN 'Weekly update' WHEN regexp_matches(u.text, '\\p{L}') THEN u.text END AS payload FROM units u WHERE u.source = 'email'""", ["units"])
def drop_mail_metadata(spark, sf):
    from veilscan.functions.spans import unfold

    d = mail_lines(spark, sf).transform(unfold, ["doc_id"], "lines")
    return d.select("doc_id", "unit_no", "payload")


@query("rejoin_wrapped")
def rejoin_wrapped(spark, sf):
    from veilscan.functions.spans import unfold

    return mail_lines(spark, sf).transform(unfold, ["doc_id"], "lines").groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_distinct("run").alias("runs"), F.count_if("cleared").alias("cleared"))


@query("flag_lines")
def flag_lines(spark, sf):
    from veilscan.functions.spans import unfold
    from veilscan.operators import language as G

    return mail_lines(spark, sf).transform(unfold, ["doc_id"], G.flag_lines(F.col("lines"))).select("doc_id", "unit_no", "p_eng", "top")


@query("join_short_lines")
def join_short_lines(spark, sf):
    from veilscan.functions.spans import unfold
    from veilscan.operators import language as G

    return mail_lines(spark, sf).transform(unfold, ["doc_id"], G.join_short_lines(F.col("lines"))).select("doc_id", "unit_no", "p_eng", "by")


@query("flag_layers")
def flag_layers(spark, sf):
    from veilscan.functions.spans import unfold
    from veilscan.operators.prepare import apply_hidden_ranges
    from veilscan.operators.scoring import flag_layers as flags
    from veilscan.plans.text_queries import hidden_ranges
    from veilscan.sources.screened import scorers

    d = apply_hidden_ranges(hidden_ranges(spark, sf))
    d = flags(d, scorers(), 0.65, "hidden_layers")
    rows = F.transform("hidden_layers", lambda x, i: F.struct(x["start"].alias("layer_start"), F.array_join(F.get("layer_flags", i), ",").alias("flagged_by")))
    return d.transform(unfold, ["doc_id"], rows)


@query("two_stage_scan")
def two_stage_scan(spark, sf):
    from veilscan.functions.spans import unfold
    from veilscan.sources.screened import with_units

    units = with_units(spark, sf).transform(unfold, ["doc_id"], "units")
    keyed = units.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("unit_no").cast("string")).alias("unit"), X.gate_words(F.col("text")).alias("words"))
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).filter(F.char_length("word") >= 2)
    return X.two_stage_scan(keyed, "unit", "words", words, INDIC_MARKERS)
