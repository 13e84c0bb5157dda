"""The guard over tool calls derived from orders and customers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilscan.functions.rules import ADDRESS
from veilscan.operators import guard as G
from veilscan.plans.parts import lit
from veilscan.plans.registry import part, query
from veilscan.sources.planted import pick, table

TOOLS = ["send_email", "forward_email", "reply_email", "make_payment", "delete_email", "delete_file", "run_shell_command", "http_request", "read_file"]
REQUESTS = {"1-URGENT": "Please send the report now", "2-HIGH": "Pay the invoice and check my email", "3-MEDIUM": "Summarise my emails",
            "4-NOT SPECIFIED": "Delete old mail and run the script", "5-LOW": "Open the link and email HR"}
BODIES = ["password: hunter22", "your verification code 493021", "sk-abcdefghijklmnop1234", "the canary word WREN-77"]


def calls(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@a.example"))
    request = F.lit("")
    for p, t in REQUESTS.items():
        request = F.when(F.col("o_orderpriority") == p, F.lit(t)).otherwise(request)
    body = F.coalesce(pick(BODIES, F.when(k % 11 < 4, k % 11)), F.lit("see attached"))
    to = F.when(k % 13 == 0, F.lit("Desk")).otherwise(mail)
    return d.select(
        k.alias("call_id"), (F.col("o_custkey")).alias("run_id"), (1 + k % 5).cast("int").alias("email_id"), pick(TOOLS, k % 9).alias("tool"),
        F.create_map(F.lit("To"), F.array(to), F.lit("body"), F.array(body)).alias("args"), request.alias("user_request"),
        F.when(k % 2 == 0, F.array(mail, F.lit("hr@a.example"))).otherwise(F.array(F.lit("hr@a.example"))).alias("contacts"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("Write to "), mail))).otherwise(F.array().cast("array<string>")).alias("untrusted"),
        F.array(F.lit("WREN-77"), F.lit("")).alias("canaries"))


CASES = " ".join(f"WHEN {lit(p)} THEN {lit(t)}" for p, t in REQUESTS.items())
part("calls", f"""
SELECT call_id, run_id, email_id, tool, CASE WHEN call_id % 13 = 0 THEN 'Desk' ELSE mail END AS target, body, user_request, mail,
  CASE WHEN call_id % 2 = 0 THEN mail || chr(10) || 'hr@a.example' ELSE 'hr@a.example' END AS contacts,
  CASE WHEN call_id % 3 = 0 THEN 'Write to ' || mail ELSE '' END AS untrusted
FROM (SELECT o_orderkey AS call_id, o_custkey AS run_id, CAST(1 + o_orderkey % 5 AS BIGINT) AS email_id,
        list_extract([{', '.join(lit(t) for t in TOOLS)}], o_orderkey % 9 + 1) AS tool,
        lower(replace(c_name, '#', '')) || '@a.example' AS mail, CASE o_orderpriority {CASES} ELSE '' END AS user_request,
        CASE WHEN o_orderkey % 11 < 4 THEN list_extract([{', '.join(lit(b) for b in BODIES)}], o_orderkey % 11 + 1) ELSE 'see attached' END AS body
      FROM orders JOIN customer ON o_custkey = c_custkey)""")
KINDS = " ".join(f"WHEN {lit(t)} THEN {lit(k)}" for t, k in G.ACTION_KIND.items())
ASKED = " ".join(f"WHEN {lit(k)} THEN regexp_matches(user_request, {lit('(?i)' + p)})" for k, p in G.INTENT.items())
FOUND = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(vals, {lit(p)}) THEN {lit(n)} END" for p, n in G.SECRETS) + "], lambda x: x IS NOT NULL)"
part("facts", f"""
SELECT *, CASE kind {ASKED} END AS asked, contains(vals, 'WREN-77') AS canary, {FOUND} AS found,
  CASE WHEN contains(lower(user_request || chr(10) || contacts), lower(target)) THEN 'user' WHEN contains(lower(untrusted), lower(target)) THEN 'outside content'
       ELSE 'unknown' END AS origin, contains(lower(contacts), lower(target)) AS known
FROM (SELECT *, CASE tool {KINDS} END AS kind, target || ' ' || body AS vals FROM calls)""", ["calls"])
part("decisions", """
SELECT *, CASE WHEN kind IS NOT NULL AND reasons <> '' THEN 'block' ELSE 'allow' END AS decision,
  CASE WHEN kind IS NULL THEN 'no outgoing action' WHEN reasons = '' THEN 'no objection' ELSE reasons END AS reason,
  CASE WHEN kind IS NULL THEN '' ELSE concat_ws(',', CASE WHEN canary THEN 'secret_extraction' END, CASE WHEN len(found) > 0 THEN 'credential_theft' END,
    CASE WHEN origin <> 'user' OR NOT asked THEN 'tool_abuse' END) END AS types,
  kind IS NOT NULL AND (reasons <> '' OR kind IN ('pay', 'delete', 'run') OR NOT known) AS needs_review
FROM (SELECT *, concat_ws('; ', CASE WHEN canary THEN 'an internal marker of the agent is in what would be sent' END,
    CASE WHEN len(found) > 0 THEN array_to_string(found, ' and ') || ' in what would be sent' END,
    CASE WHEN origin <> 'user' THEN target || ' has origin: ' || origin  END,
    CASE WHEN NOT asked THEN 'no request to ' || kind END) AS reasons FROM facts)""", ["facts"])


@query("action_kind", "SELECT call_id, tool, kind FROM facts", ["facts"])
def action_kind(spark, sf):
    return calls(spark, sf).select("call_id", "tool", G.action_kind(F.col("tool")).alias("kind"))


@query("secret_scan", "SELECT call_id, array_to_string(found, ', ') AS found FROM facts WHERE len(found) > 0", ["facts"])
def secret_scan(spark, sf):
    d = calls(spark, sf).withColumn("f", G.secret_scan(G.outgoing_values(F.col("args"))))
    return d.filter(F.size("f") > 0).select("call_id", F.array_join("f", ", ").alias("found"))


@query("canary_leak", "SELECT call_id FROM facts WHERE canary", ["facts"])
def canary_leak(spark, sf):
    return calls(spark, sf).filter(G.canary_leak(G.outgoing_values(F.col("args")), F.col("canaries"))).select("call_id")


@query("call_targets", "SELECT call_id, target FROM calls", ["calls"])
def call_targets(spark, sf):
    return calls(spark, sf).select("call_id", F.explode(G.targets(F.col("args"))).alias("target"))


@query("target_origin", "SELECT call_id, target, origin FROM facts", ["facts"])
def target_origin(spark, sf):
    d = calls(spark, sf).withColumn("target", F.explode(G.targets(F.col("args"))))
    return d.select("call_id", "target", G.target_origin(F.col("target"), F.col("user_request"), F.col("contacts"), F.col("untrusted")).alias("origin"))


@query("intent_check", "SELECT kind, user_request, asked, count(*) AS n FROM facts GROUP BY ALL", ["facts"])
def intent_check(spark, sf):
    d = calls(spark, sf).withColumn("kind", G.action_kind(F.col("tool")))
    return d.withColumn("asked", G.intent_check(F.col("kind"), F.col("user_request"))).groupBy("kind", "user_request", "asked").agg(F.count("*").alias("n"))


@query("guard_decisions", "SELECT call_id, tool, decision, reason, types, needs_review FROM decisions", ["decisions"])
def guard_decisions(spark, sf):
    return G.guard_decisions(calls(spark, sf)).select("call_id", "tool", "decision", "reason", F.array_join("types", ",").alias("types"), "needs_review")


@query("guard_checks", """
SELECT call_id, len(found) = 0 AND NOT canary AS secrets, origin = 'user' AS provenance, asked AS intent FROM decisions WHERE kind IS NOT NULL""", ["decisions"])
def guard_checks(spark, sf):
    d = G.guard_decisions(calls(spark, sf)).filter("kind IS NOT NULL")
    passed = {n: F.get(F.col("checks"), F.lit(i))["passed"].alias(n) for i, n in enumerate(["secrets", "provenance", "intent"])}
    return d.select("call_id", *passed.values())


@query("needs_review", "SELECT tool, decision, count(*) FILTER (WHERE needs_review) AS to_review, count(*) AS n FROM decisions GROUP BY ALL", ["decisions"])
def needs_review(spark, sf):
    return G.guard_decisions(calls(spark, sf)).groupBy("tool", "decision").agg(F.count_if("needs_review").alias("to_review"), F.count("*").alias("n"))


# One inbox per run: its customer's nation mates write to it
part("emails", """
SELECT c_custkey AS run_id, i AS email_id, 'sender' || c_custkey || '-' || i || '@c.example' AS sender,
  'Subject: note ' || i || chr(10) || chr(10) || c_mktsegment AS email_text
FROM customer, (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) t(i)""")


def emails(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("i"))
    return c.select(F.col("c_custkey").alias("run_id"), F.col("i").alias("email_id"),
                    F.concat(F.lit("sender"), F.col("c_custkey").cast("string"), F.lit("-"), F.col("i").cast("string"), F.lit("@c.example")).alias("sender"),
                    F.concat(F.lit("Subject: note "), F.col("i").cast("string"), F.lit("\n\n"), "c_mktsegment").alias("email_text"))


@query("enrich_outgoing", """
SELECT c.call_id, c.tool, CASE WHEN c.tool = 'reply_email' AND e.sender IS NOT NULL THEN e.sender END AS reply_to,
  CASE WHEN c.tool = 'forward_email' AND e.sender IS NOT NULL THEN e.email_text END AS forwarded
FROM calls c LEFT JOIN emails e USING (run_id, email_id)""", ["calls", "emails"])
def enrich_outgoing(spark, sf):
    d = G.enrich_outgoing(calls(spark, sf), emails(spark, sf))
    return d.select("call_id", "tool", F.get(F.try_element_at("args", F.lit("to")), F.lit(0)).alias("reply_to"),
                    F.get(F.try_element_at("args", F.lit("forwarded_email")), F.lit(0)).alias("forwarded"))


@query("reject_unknown_email", """
SELECT c.call_id, c.tool, 'No email with id ''' || c.email_id || ''' in the inbox.' AS error FROM calls c
WHERE c.tool IN ('forward_email', 'reply_email', 'delete_email') AND NOT EXISTS (
  SELECT 1 FROM emails e WHERE e.run_id = c.run_id AND e.email_id = c.email_id)""", ["calls", "emails"])
def reject_unknown_email(spark, sf):
    return G.reject_unknown_email(calls(spark, sf), emails(spark, sf)).select("call_id", "tool", "error")


@query("search_contacts", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '7')")
def search_contacts(spark, sf):
    return G.search_contacts(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", F.lit(" 7 "))


@query("latest_invoices", """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
  CASE o_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 3 END AS n FROM orders) WHERE rn <= n""")
def latest_invoices(spark, sf):
    k = F.col("o_custkey") % 3
    asked = F.when(k == 0, "2").when(k == 1, "5").otherwise("all")
    return G.latest_invoices(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", "o_orderdate", asked)


@query("guard_audit", "SELECT call_id, tool, decision AS verdict, types, reason FROM decisions WHERE kind IS NOT NULL", ["decisions"])
def guard_audit(spark, sf):
    from veilscan.sources.audit import guard_entries

    return guard_entries(G.guard_decisions(calls(spark, sf))).select("call_id", "tool", "verdict", F.array_join("types", ",").alias("types"), "reason")


@query("review_log", "SELECT call_id, tool, user_request, decision, reason FROM decisions WHERE needs_review", ["decisions"])
def review_log(spark, sf):
    from veilscan.sources.audit import review_entries

    return review_entries(G.guard_decisions(calls(spark, sf))).select("call_id", "tool", "user_request", "decision", "reason")
