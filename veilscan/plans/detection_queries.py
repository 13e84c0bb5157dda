"""Rule detection over the planted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.functions.rules import RULES, hits_in, rule_rows
from veilscan.plans.parts import lit
from veilscan.functions.spans import unfold
from veilscan.plans.registry import query
from veilscan.sources.planted import planted


def visible_hits(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per rule hit in the text as it stands."""
    found = docs.withColumn("_hits", hits_in(F.col(text), F.col("source")))
    return found.transform(unfold, docs.columns, "_hits")


HIT_SQL = "SELECT doc_id, rule, type, strength, s AS hit_start, e AS hit_end, hit AS hit_text FROM hits"


def _hit_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "rule", "type", "strength", F.col("start").alias("hit_start"),
                     F.col("end").alias("hit_end"), F.col("hit_text"))


@query("rules_table", "SELECT p.doc_id, r.rule, r.type, r.strength, r.outside_only FROM planted p JOIN rules r "
       "ON r.rule_no = p.doc_id % 14", ["planted", "rules"])
def rules_table(spark, sf):
    rules = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rule_rows())],
                                  "rule_no int, rule string, type string, strength string, outside_only boolean")
    docs = planted(spark, sf).select("doc_id", (F.col("doc_id") % 14).cast("int").alias("rule_no"))
    return docs.join(F.broadcast(rules), "rule_no").drop("rule_no")  # 14 fixed rows


@query("rule_hits_visible", HIT_SQL, ["hits"])
def rule_hits_visible(spark, sf):
    docs = planted(spark, sf).select("doc_id", "source", F.col("text").alias("full"))
    return _hit_rows(visible_hits(docs, "full").withColumnRenamed("text", "hit_text"))


def _one_rule(rule):
    name = "rule_" + rule.id[2:].lower().replace("-", "_")

    @query(name, HIT_SQL + f" WHERE rule = {lit(rule.id)}", ["hits"])
    def run(spark, sf):
        docs = planted(spark, sf).select("doc_id", "source", F.col("text").alias("full"))
        hits = docs.withColumn("_h", hits_in(F.col("full"), F.col("source"), rules=[rule]))
        return _hit_rows(hits.transform(unfold, ["doc_id"], "_h").withColumnRenamed("text", "hit_text"))


for _rule in RULES:
    _one_rule(_rule)


@query("flag_rate_by_rule", """
SELECT rule, type, strength, count(*) AS hits, count(DISTINCT doc_id) AS items FROM hits GROUP BY ALL""", ["hits"])
def flag_rate_by_rule(spark, sf):
    docs = planted(spark, sf).select("doc_id", "source", F.col("text").alias("full"))
    # one row per item and rule first: the distinct count then needs no second shuffle of hits
    per_item = unfold(docs, ["doc_id"], hits_in(F.col("full"), F.col("source"))) \
        .groupBy("doc_id", "rule", "type", "strength").agg(F.count("*").alias("n"))
    return per_item.groupBy("rule", "type", "strength").agg(F.sum("n").alias("hits"), F.count("*").alias("items"))


@query("outside_only_skipped", """
SELECT p.doc_id, p.source FROM planted p JOIN rules r ON r.outside_only
WHERE p.source = 'user' AND regexp_matches(p.text, r.pattern)""", ["planted", "rules"])
def outside_only_skipped(spark, sf):
    rule = next(r for r in RULES if r.outside_only)
    docs = planted(spark, sf).filter("source = 'user'")
    return docs.filter(F.col("text").rlike(rule.java)).select("doc_id", "source")


@query("negated_credential", """
SELECT m.doc_id, m.n AS matches, m.n - coalesce(h.n, 0) AS negated FROM (
  SELECT doc_id, CAST(sum(len(pieces) - 1) AS BIGINT) AS n FROM marked WHERE type = 'credential_theft' GROUP BY doc_id) m
LEFT JOIN (SELECT doc_id, count(*) AS n FROM hits WHERE type = 'credential_theft' GROUP BY doc_id) h USING (doc_id)""",
       ["marked", "hits"])
def negated_credential(spark, sf):
    from veilscan.functions.rules import negated
    from veilscan.functions.spans import find_spans

    docs = planted(spark, sf)
    rules = [r for r in RULES if r.type == "credential_theft"]
    spans = F.concat(*[find_spans(F.col("text"), r.java) for r in rules])
    flags = F.transform(spans, lambda s: negated(F.col("text"), s["start"]))
    return docs.withColumn("f", flags).filter(F.size("f") > 0).select(
        "doc_id", F.size("f").alias("matches"), F.size(F.filter("f", lambda x: x)).alias("negated"))
