"""Evaluation-set building and record keeping over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilscan.functions.spans import unfold
from veilscan.operators import evalsets as B
from veilscan.operators.prepare import reject_oversize
from veilscan.operators.skew import arithmetic_shuffle, number_rows
from veilscan.plans.metric_queries import HARD
from veilscan.plans.parts import WS, lit
from veilscan.plans.registry import part, query
from veilscan.sources import items as I
from veilscan.sources.planted import PHRASES, pick, planted, table, texts
from veilscan.sources.results import eval_items, eval_results

SHUFFLE = "(doc_id * 7919 + 104729) % 1000003"
E_ = ["eval_items"]


def shuffled(df, key="doc_id"):
    return df.withColumn("shuffle", arithmetic_shuffle(key))


@query("source_of", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1) THEN 'user' ELSE 'email' END AS source FROM documents")
def source_of(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.select("doc_id", I.source_of(pick(["direct_user", "chat_message", "web_page", "email_body"], F.col("doc_id") % 5)).alias("source"))


@query("read_items_json", "SELECT doc_id, source, length(text) AS chars, NULL::VARCHAR AS user_task FROM planted", ["planted"])
def read_items_json(spark, sf):
    from veilscan.settings import ITEMS

    raw = planted(spark, sf).select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("content"), "source")).alias("j"))
    return raw.select(F.from_json("j", ITEMS).alias("i")).select(F.col("i.item_id").cast("bigint").alias("doc_id"), "i.source", F.char_length("i.content").alias("chars"), "i.user_task")


@query("read_labels_json", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS types, 'q' || quality AS reason FROM labels")
def read_labels_json(spark, sf):
    x = table(spark, sf, "labels")
    body = F.struct(F.array(F.when(F.col("toxic") == 1, "toxic").otherwise("clean")).alias("types"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("reason"))
    j = x.select(F.to_json(F.create_map(F.col("doc_id").cast("string"), body)).alias("j"))
    return j.select(F.explode(I.labels_of(F.col("j"))).alias("e")).select(F.col("e.key").cast("bigint").alias("doc_id"), F.array_join("e.value.types", ",").alias("types"), F.col("e.value.reason").alias("reason"))


@query("sample_columns")
def sample_columns(spark, sf):
    return I.sample_columns(spark, [f"{sf}/customer.parquet"], ["c_custkey", "c_name", "c_mktsegment"], 100, 7, "c_custkey")


@query("reject_oversize", "SELECT doc_id, length(text) AS chars, CASE WHEN length(text) > 20000 THEN 413 ELSE 200 END::BIGINT AS status FROM planted", ["planted"])
def reject(spark, sf):
    return reject_oversize(planted(spark, sf).withColumnRenamed("text", "content")).select("doc_id", "chars", "status")


@query("resume_items", "SELECT doc_id, set_name FROM eval_items WHERE doc_id NOT IN (SELECT doc_id FROM labels)", E_)
def resume_items(spark, sf):
    return I.resume(eval_items(spark, sf).select("doc_id", "set_name"), table(spark, sf, "labels"), ["doc_id"])


@query("write_audit", """
SELECT doc_id, coalesce(source, 'unknown') AS source, verdict, substr(sha256(text), 1, 16) AS content_sha256, length(text) AS content_chars, n_attacks AS cuts FROM results""", ["results"])
def write_audit(spark, sf):
    from veilscan.sources.audit import check_entries

    r = eval_results(spark, sf).withColumn("content", F.col("text")).withColumn("warnings", F.array().cast("array<string>")).withColumn(
        "attacks", F.transform("attacks", lambda a: F.struct(F.array(a["type"]).alias("types"), F.array(F.lit("rules")).alias("found_by"))))
    entries = check_entries(r.withColumn("source", F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("source", F.lit("unknown")))))
    return entries.select(F.split_part("source", F.lit("|"), F.lit(1)).cast("bigint").alias("doc_id"), F.split_part("source", F.lit("|"), F.lit(2)).alias("source"), "verdict", "content_sha256", "content_chars", "cuts")


@query("recent_entries", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_entries(spark, sf):
    from veilscan.sources.audit import recent

    return recent(table(spark, sf, "events").select("event_id", "event_type", "ts"), 50, "ts", "event_id").select("event_id", "event_type")


@query("upsert_keep_newest", """
SELECT user_id AS record_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id DESC) AS rn FROM events)
WHERE rn = 1 ORDER BY event_id DESC LIMIT 50""")
def upsert_keep_newest(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("record_id"), "event_id", "event_type")
    old, new = e.filter("event_type <> 'purchase'").drop("event_type"), e.filter("event_type = 'purchase'").drop("event_type")
    return I.upsert_keep_newest(old, new, "record_id", "event_id")


@query("save_within_limit", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 400 WHEN doc_id % 5 = 0 THEN 422 ELSE 200 END::BIGINT AS status FROM documents""")
def save_within_limit(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.create_map(F.lit("protected"), F.col("text")).alias("jobs")))
    body = F.when(F.col("doc_id") % 7 == 0, "{oops").when(F.col("doc_id") % 5 == 0, F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("jobs")))).otherwise(good)
    return I.save_within_limit(d.withColumn("body", body), "body").select("doc_id", "status")


part("table_rows", """SELECT c_nationkey AS sheet, c_custkey AS row_no, CASE WHEN c_custkey % 10 = 3 THEN ['', ' '] WHEN c_custkey % 4 = 0 THEN [c_name, ' ' || c_mktsegment, CAST(c_custkey AS VARCHAR)] ELSE [c_name, c_mktsegment || ' '] END AS cells FROM customer""")


part("wide", "SELECT *, max(len(cells)) OVER (PARTITION BY sheet) AS w, min(row_no) OVER (PARTITION BY sheet) AS first_no FROM table_rows WHERE len(list_filter(cells, lambda c: trim(c) <> '')) > 0", ["table_rows"])


@query("rows_to_markdown", """
SELECT sheet::BIGINT AS sheet, row_no, 0::BIGINT AS part, '| ' || array_to_string(list_concat(list_transform(cells, lambda c: trim(c)), list_transform(range(w - len(cells)), lambda i: '')), ' | ') || ' |' AS line FROM wide
UNION ALL SELECT sheet::BIGINT, row_no, 1::BIGINT, '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' FROM wide WHERE row_no = first_no""", ["wide"])
def rows_to_markdown(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    cells = F.when(k % 10 == 3, F.array(F.lit(""), F.lit(" "))).when(k % 4 == 0, F.array("c_name", F.concat(F.lit(" "), "c_mktsegment"), k.cast("string"))).otherwise(
        F.array("c_name", F.concat("c_mktsegment", F.lit(" "))))
    return I.rows_to_markdown(c.select(F.col("c_nationkey").alias("sheet"), k.alias("row_no"), cells.alias("cells")), "sheet", "row_no", "cells")


@query("html_table_rows", """
SELECT page_id, len(regexp_extract_all(html || '<table><tr><th>Url</th><td><b>' || url || '</b></td></tr></table>', '(?is)<tr[^>]*>(.*?)</tr>', 1)) AS n_rows, url AS last_cell FROM pages""")
def html_table_rows(spark, sf):
    p = texts(spark, sf, "pages")
    rows = I.html_table_rows(F.concat("html", F.lit("<table><tr><th>Url</th><td><b>"), "url", F.lit("</b></td></tr></table>")))
    last = F.element_at(rows, -1)
    return p.select("page_id", F.size(rows).alias("n_rows"), F.element_at(last, -1).alias("last_cell"))


@query("assemble_pages", """
SELECT conv_id, md5(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS text_md5, CAST(sum(length(text)) AS BIGINT) AS chars,
  CASE WHEN sum(length(text)) > 30 THEN 'digital_pdf' ELSE 'scanned_pdf_ocr' END AS method FROM conversations WHERE text <> '' GROUP BY conv_id""")
def assemble_pages(spark, sf):
    return I.assemble_pages(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("text_md5"), "chars", "method")


@query("dashboard_json", """
SELECT set_name, '{"set":"' || set_name || '","n":' || count(*) || ',"flagged":' || count(*) FILTER (WHERE verdict IN ('sanitise', 'quarantine')) || '}' AS body FROM results GROUP BY set_name""", ["results"])
def dashboard_json(spark, sf):
    g = eval_results(spark, sf).groupBy("set_name").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("verdict").isin("sanitise", "quarantine"), F.lit(False))).alias("flagged"))
    return g.select("set_name", F.to_json(F.struct(F.col("set_name").alias("set"), "n", "flagged")).alias("body"))


@query("email_text", f"""
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN trim(text, {WS}) ELSE 'Subject: ' || lang || chr(10) || chr(10) || trim(text, {WS}) END) AS text_md5 FROM documents""")
def email_text(spark, sf):
    d = texts(spark, sf, "documents")
    return d.select("doc_id", F.md5(B.email_text(F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")), F.col("text"))).alias("text_md5"))


part("raw_attacks", """
SELECT o_orderkey AS row_id, o_orderpriority AS subject, CAST(o_custkey AS VARCHAR) AS body, 'level2' || list_extract(['k', 'l', 'a', 'm', 'b'], o_orderkey % 5 + 1) AS scenario,
  o_orderkey % 2 = 0 AS sent, o_orderkey % 3 <> 0 AS dest FROM orders""")


@query("working_attacks", """
SELECT subject, body, min(row_id) AS row_id FROM raw_attacks WHERE right(scenario, 1) IN ('k', 'l', 'm') AND sent AND dest
AND (subject, body) NOT IN (SELECT o_orderpriority, CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL""", ["raw_attacks"])
def working_attacks(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"exfil.sent":'), (k % 2 == 0).cast("string"), F.lit(',"exfil.destination":'), (k % 3 != 0).cast("string"), F.lit("}"))
    raw = o.select(k.alias("row_id"), F.col("o_orderpriority").alias("subject"), F.col("o_custkey").cast("string").alias("body"),
                   F.concat(F.lit("level2"), pick(["k", "l", "a", "m", "b"], k % 5)).alias("scenario"), body.alias("objectives"))
    labelled = o.filter("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("subject"), F.col("o_custkey").cast("string").alias("body"))
    return B.working_attacks(raw, labelled, ["k", "l", "m"]).select("subject", "body", "row_id")


@query("cap_per_group", f"""
SELECT doc_id, grp, rn FROM (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY {SHUFFLE}, doc_id) AS rn FROM eval_items WHERE label = 1) WHERE rn <= 8""", E_)
def cap_per_group(spark, sf):
    return B.cap_per_group(shuffled(eval_items(spark, sf).filter("label = 1").select("doc_id", "grp")), "grp", 8, "shuffle", ["doc_id"]).select("doc_id", "grp", "rn")


@query("constant_types", """
SELECT doc_id, concat_ws(',', CASE type1 WHEN 'context_poisoning' THEN 'x' ELSE type1 END, type2, CASE WHEN coalesce(type1, '') <> 'indirect_injection' AND coalesce(type2, '') <> 'indirect_injection' THEN 'indirect_injection' END,
  CASE WHEN coalesce(type1, '') <> 'tool_abuse' AND coalesce(type2, '') <> 'tool_abuse' THEN 'tool_abuse' END) AS types FROM eval_items WHERE set_name LIKE 'mail%' AND label = 1""", E_)
def constant_types(spark, sf):
    e = eval_items(spark, sf).filter("label = 1 AND set_name LIKE 'mail%'")
    raw = F.transform("types", lambda t: F.when(t == "indirect_injection", "indirect_prompt_injection").otherwise(t))
    renamed = F.transform(raw, lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in B.RENAMED.items() for x in kv]), t), t))
    return e.select("doc_id", F.array_join(F.array_union(renamed, F.array(*[F.lit(t) for t in B.CONSTANT_TYPES])), ",").alias("types"))


FAMS = list(B.FAMILY_TYPES)


@query("family_types", "SELECT i.doc_id, f.family, f.type FROM eval_items i JOIN (VALUES " + ", ".join(f"({k}, {lit(f)}, {lit(t)})" for k, (f, t) in enumerate(B.FAMILY_TYPES.items())) +
       ") f(no, family, type) ON f.no = i.doc_id % 12 WHERE i.label = 1", E_)
def family_types(spark, sf):
    dim = spark.createDataFrame(list(B.FAMILY_TYPES.items()), "family string, type string")
    e = eval_items(spark, sf).filter("label = 1").select("doc_id", pick(FAMS, F.col("doc_id") % 12).alias("family"))
    return e.join(F.broadcast(dim), "family").select("doc_id", "family", "type")  # twelve fixed rows


@query("benign_sample", f"""
SELECT doc_id, rn, CASE WHEN rn <= {B.BENIGN} THEN 'benign' ELSE 'carrier' END AS part FROM (
  SELECT doc_id, words, row_number() OVER (ORDER BY {SHUFFLE}, doc_id) AS rn FROM (
    SELECT min(doc_id) AS doc_id, len(string_split_regex(trim(text, {WS}), '\\s+')) AS words FROM documents WHERE length(text) BETWEEN 20 AND 20000 GROUP BY text))
WHERE rn <= {B.BENIGN} OR words BETWEEN 40 AND 400""")
def benign_sample(spark, sf):
    return B.benign_sample(texts(spark, sf, "documents"))


@query("hard_wording", f"SELECT doc_id FROM planted WHERE regexp_matches(text, '{HARD}')", ["planted"])
def hard_wording(spark, sf):
    return planted(spark, sf).filter(F.col("text").rlike(HARD)).select("doc_id")


# Planting: each attack document is paired with carriers by running number --------------------------
part("pairing", f"""
SELECT a.doc_id, a.attack, a.rn, c.text AS c1, d.text AS c2, e.text AS c3 FROM (
  SELECT doc_id, plant AS attack, row_number() OVER (ORDER BY {SHUFFLE}, doc_id) AS rn FROM planted WHERE label = 1) a,
  (SELECT count(*) AS n FROM planted WHERE label = 0) t
JOIN benign c ON c.rn = (a.rn % t.n) + 1 JOIN benign d ON d.rn = ((a.rn + 1) % t.n) + 1 JOIN benign e ON e.rn = ((a.rn + 2) % t.n) + 1""", ["planted", "benign"])
part("benign", f"SELECT doc_id, text, row_number() OVER (ORDER BY {SHUFFLE}, doc_id) AS rn FROM planted WHERE label = 0", ["planted"])


def pairing(spark, sf):
    p = shuffled(planted(spark, sf).select("doc_id", "plant", "text", "label"))
    attacks = number_rows(p.filter("label = 1").select("doc_id", F.col("plant").alias("attack"), "shuffle"), [], "shuffle", ["doc_id"])
    benign = number_rows(p.filter("label = 0").select("doc_id", "text", "shuffle"), [], "shuffle", ["doc_id"]).select("rn", "text")
    n = benign.agg(F.count("*").alias("n"))
    a = attacks.crossJoin(F.broadcast(n))  # one number
    for i in range(3):
        a = a.withColumn(f"k{i}", (F.col("rn") + i) % F.col("n") + 1)
        a = a.join(benign.select(F.col("rn").alias(f"k{i}"), F.col("text").alias(f"c{i + 1}")), f"k{i}").drop(f"k{i}")
    return a


@query("plant_inbox", """
SELECT doc_id, md5(body) AS text_md5, strpos(body, attack) - 1 AS planted_from FROM (
  SELECT doc_id, attack, rtrim(string_agg('--- Email ' || k || ' of 4 ---' || chr(10) || t || chr(10) || chr(10), '' ORDER BY k), ' ' || chr(10)) AS body FROM (
    SELECT doc_id, attack, unnest([1, 2, 3, 4]) AS k, unnest(CASE doc_id % 4 WHEN 0 THEN [attack, c1, c2, c3] WHEN 1 THEN [c1, attack, c2, c3] WHEN 2 THEN [c1, c2, attack, c3] ELSE [c1, c2, c3, attack] END) AS t
    FROM pairing) GROUP BY ALL)""", ["pairing"])
def plant_inbox(spark, sf):
    a = pairing(spark, sf)
    slot = F.col("doc_id") % 4
    parts = F.when(slot == 0, F.array("attack", "c1", "c2", "c3")).when(slot == 1, F.array("c1", "attack", "c2", "c3")).when(
        slot == 2, F.array("c1", "c2", "attack", "c3")).otherwise(F.array("c1", "c2", "c3", "attack"))
    blocks = F.transform(parts, lambda t, i: F.concat(F.lit("--- Email "), (i + 1).cast("string"), F.lit(" of 4 ---\n"), t, F.lit("\n\n")))
    before = F.aggregate(F.slice(blocks, F.lit(1), slot.cast("int")), F.lit(0), lambda acc, b: acc + F.char_length(b))
    start = before + F.char_length(F.lit("--- Email 1 of 4 ---\n"))
    return a.select("doc_id", F.md5(F.rtrim(F.array_join(blocks, ""), F.lit(" \n"))).alias("text_md5"), start.alias("planted_from"))


@query("plant_thread", """
SELECT doc_id, md5(c1 || chr(10) || chr(10) || '-----Original Message-----' || chr(10) || attack) AS text_md5, length(c1) + 29 AS planted_from FROM pairing""", ["pairing"])
def plant_thread(spark, sf):
    head = F.concat("c1", F.lit("\n\n-----Original Message-----\n"))
    return pairing(spark, sf).select("doc_id", F.md5(F.concat(head, "attack")).alias("text_md5"), F.char_length(head).alias("planted_from"))


@query("set_counts", "SELECT set_name, count(*) AS n FROM (SELECT set_name FROM eval_items UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY set_name", E_)
def set_counts(spark, sf):
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("set_name"))
    return eval_items(spark, sf).select("set_name").unionByName(b).groupBy("set_name").agg(F.count("*").alias("n"))


@query("half_per_category", f"""
SELECT doc_id, set_name FROM (SELECT doc_id, set_name, row_number() OVER (PARTITION BY set_name ORDER BY {SHUFFLE}, doc_id) AS rn, count(*) OVER (PARTITION BY set_name) AS n FROM eval_items) WHERE rn <= n // 2""", E_)
def half_per_category(spark, sf):
    return B.half_per_category(shuffled(eval_items(spark, sf).select("doc_id", "set_name")), "set_name", "shuffle", ["doc_id"]).select("doc_id", "set_name")


@query("heldout_union", "SELECT i.doc_id, i.set_name, l.quality::BIGINT AS quality FROM eval_items i JOIN labels l USING (doc_id) UNION ALL SELECT item_id, 'own', NULL FROM benchmark", E_)
def heldout_union(spark, sf):
    held = eval_items(spark, sf).select("doc_id", "set_name").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    own = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("own").alias("set_name"), F.lit(None).cast("int").alias("quality"))
    return held.unionByName(own).withColumn("quality", F.col("quality").cast("int"))


part("teams", "SELECT doc_id, 'team-' || (doc_id * 31 % 97) AS team FROM documents")


@query("disjoint_dev_split", """
SELECT t.doc_id, t.team FROM teams t WHERE t.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND t.team NOT IN (SELECT team FROM teams JOIN labels USING (doc_id) WHERE toxic = 1)""", ["teams"])
def disjoint_dev_split(spark, sf):
    pool = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("team-"), (F.col("doc_id") * 31 % 97).cast("string")).alias("team"))
    held = pool.join(table(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id")
    return B.disjoint_dev_split(pool, held, "doc_id", "team").select("doc_id", "team")


@query("round_robin", f"""
SELECT doc_id, grp FROM (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY {SHUFFLE}, doc_id) AS rn FROM eval_items) ORDER BY rn, grp LIMIT 50""", E_)
def round_robin(spark, sf):
    return B.round_robin(shuffled(eval_items(spark, sf).select("doc_id", "grp")), "grp", 50, "shuffle", ["doc_id"]).select("doc_id", "grp")


@query("triplets", "SELECT conv_id AS triad, min(text) FILTER (WHERE role = 'system') AS system, min(text) FILTER (WHERE role = 'user') AS \"user\", min(text) FILTER (WHERE role = 'assistant') AS assistant FROM conversations GROUP BY conv_id")
def triplets(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").alias("triad")).pivot("role", ["system", "user", "assistant"]).agg(F.min("text"))


@query("first_n_per_set", """
SELECT doc_id, set_name FROM (SELECT doc_id, set_name, row_number() OVER (PARTITION BY set_name ORDER BY doc_id) AS rn FROM eval_items) WHERE rn <= CASE WHEN set_name LIKE 'pair%' THEN 30 ELSE 40 END""", E_)
def first_n_per_set(spark, sf):
    ranked = number_rows(eval_items(spark, sf).select("doc_id", "set_name"), ["set_name"], "doc_id", [])
    return ranked.filter(F.col("rn") <= F.when(F.col("set_name").startswith("pair"), 30).otherwise(40)).select("doc_id", "set_name")


ESC = "replace(replace(replace(replace(replace(plant, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("hide_in_html", f"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '<!-- ' || plant || ' -->' WHEN 1 THEN '<div style="display:none">' || {ESC} || '</div>' WHEN 2 THEN '<span aria-hidden="true" hidden>' || {ESC} || '</span>'
  WHEN 3 THEN '<img src="figure.png" alt="' || {ESC} || '">' WHEN 4 THEN '<p style="color:#ffffff">' || {ESC} || '</p>' ELSE '<div style="position:absolute; left:-9999px">' || {ESC} || '</div>' END AS html FROM (SELECT doc_id, coalesce(plant, '') AS plant FROM planted)""", ["planted"])
def hide_in_html(spark, sf):
    return planted(spark, sf).na.fill({"plant": ""}).select("doc_id", B.hide_in_html(F.col("plant"), pick(B.HTML_TECHNIQUES, F.col("doc_id") % 6)).alias("html"))


@query("payload_gone", f"""
SELECT doc_id, substr(trim(regexp_replace(plant, '\\s+', ' ', 'g')), 1, 60) AS probe, n_attacks > 0 AND NOT contains(lower(regexp_replace(kept, '\\s+', ' ', 'g')), lower(substr(trim(regexp_replace(plant, '\\s+', ' ', 'g')), 1, 60))) AS gone
FROM (SELECT p.doc_id, p.plant, coalesce(n.n, 0) AS n_attacks, CASE WHEN n.n > 0 THEN replace(p.text, p.plant, '') ELSE p.text END AS kept FROM planted p
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM attacks GROUP BY doc_id) n USING (doc_id) WHERE p.plant IS NOT NULL)""", ["planted", "attacks"])
def payload_gone(spark, sf):
    r = eval_results(spark, sf).select("doc_id", "text", F.size("attacks").alias("n")).join(planted(spark, sf).select("doc_id", "plant"), "doc_id").filter("plant IS NOT NULL")
    verdict = F.when(F.col("n") > 0, "sanitise").otherwise("allow")
    clean = F.when(F.col("n") > 0, F.replace("text", F.col("plant"), F.lit(""))).otherwise(F.col("text"))
    mark = B.probe(F.col("plant"))
    return r.select("doc_id", mark.alias("probe"), B.payload_gone(mark, clean, verdict).alias("gone"))


@query("clean_lane_probe", """
SELECT doc_id, set_name, CASE WHEN label = 1 THEN 'misses' WHEN set_name = 'work_benign' THEN 'benign-rest' ELSE 'benign' END AS mode FROM results WHERE lane = 'clean' AND (label = 0 OR coalesce(verdict, '') NOT IN ('sanitise', 'quarantine'))""", ["results"])
def clean_lane_probe(spark, sf):
    r = eval_results(spark, sf).filter("lane = 'clean'")
    caught = F.coalesce(F.col("verdict").isin("sanitise", "quarantine"), F.lit(False))
    mode = F.when(F.col("label") == 1, "misses").when(F.col("set_name") == "work_benign", "benign-rest").otherwise("benign")
    return r.filter((F.col("label") == 0) | ~caught).select("doc_id", "set_name", mode.alias("mode"))


@query("pair_twins", """
SELECT a.stem, a.verdict AS attack_verdict, b.verdict AS benign_verdict FROM (SELECT doc_id // 2 AS stem, verdict FROM results WHERE doc_id % 2 = 0) a JOIN (SELECT doc_id // 2 AS stem, verdict FROM results WHERE doc_id % 2 = 1) b USING (stem)""", ["results"])
def pair_twins(spark, sf):
    r = eval_results(spark, sf).select(F.concat(F.floor(F.col("doc_id") / 2).cast("string"), F.when(F.col("doc_id") % 2 == 0, "_a").otherwise("_b")).alias("id"), "verdict")
    stem = F.regexp_replace("id", "_[ab]$", "").cast("bigint")
    a = r.filter(F.col("id").endswith("_a")).select(stem.alias("stem"), F.col("verdict").alias("attack_verdict"))
    return a.join(r.filter(F.col("id").endswith("_b")).select(stem.alias("stem"), F.col("verdict").alias("benign_verdict")), "stem")


@query("near_duplicate_skip", """
SELECT b.team, b.doc_id FROM wordsets b WHERE EXISTS (SELECT 1 FROM wordsets a WHERE a.team = b.team AND a.doc_id < b.doc_id
  AND len(list_intersect(a.ws, b.ws)) >= 0.6 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))))""", ["wordsets"])
def near_duplicate_skip(spark, sf):
    d = texts(spark, sf, "documents").select("doc_id", F.col("lang").alias("team"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("ws"))
    return B.near_duplicates(d, "team", "doc_id", "ws")


part("wordsets", "SELECT doc_id, lang AS team, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws FROM documents")
