"""Evaluation results derived from the planted documents: rule verdicts plus arithmetic fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.rules import hits_in
from veilscan.functions.spans import fence
from veilscan.sources.planted import N_ATTACK, PHRASE_TYPES, planted, pick


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted documents as labelled evaluation items."""
    d = planted(spark, sf_dir)
    seven, three = F.col("doc_id") % 7, F.col("doc_id") % 3
    attack_set = F.when(seven <= 1, "mail_labelled").when(seven == 2, "mail_groups").when(seven <= 4, "pair_attack") \
        .when(seven == 5, "planted_inbox").otherwise("planted_thread")
    benign_set = F.when(three == 0, "mail_benign").when(three == 1, "pair_benign").otherwise("work_benign")
    kinds = F.array_compact(F.array(pick(PHRASE_TYPES, F.col("phrase_no")), pick(PHRASE_TYPES, F.col("phrase2_no"))))
    return d.select(
        "doc_id", "source", "text", "label", "n_chars", "span_start", "span_end",
        F.when(F.col("label") == 1, attack_set).otherwise(benign_set).alias("set_name"),
        F.concat(F.lit("family-"), (F.col("doc_id") % 12).cast("string")).alias("grp"),
        F.array_distinct(kinds).alias("types"))


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result row per item: attacks are the strong rule hits."""
    d = eval_items(spark, sf_dir).withColumn("hits", fence(hits_in(F.col("text"), F.col("source"))))
    d = d.withColumn("attacks", F.transform(F.filter("hits", lambda h: h["strength"] == "strong"), lambda h: F.struct(
        h["start"].alias("start"), h["end"].alias("end"), h["type"].alias("type"), h["rule"].alias("rule"))))
    error = F.when(F.col("doc_id") % 53 == 0, "Timeout")
    a = (F.col("doc_id") * 37 % 101) / F.lit(100.0)
    b = (F.col("doc_id") * 53 % 101) / F.lit(100.0)
    strong = F.size("attacks") > 0
    verdict = F.when(error.isNotNull(), F.lit(None)).when(strong & (F.col("doc_id") % 41 == 0), "quarantine") \
        .when(strong, "sanitise").otherwise("allow")
    lane = F.when(F.size("hits") == 0, "clean").when(strong & (a >= 0.65), "clear_attack").otherwise("unsure")
    d = d.withColumn("error", error).withColumn("score_a", a).withColumn("score_b", b).withColumn("verdict", verdict) \
        .withColumn("lane", lane).withColumn("ms", F.col("n_chars"))
    asked = F.col("lane") != "clean"
    return d.withColumn("judge_calls", F.when(asked, 1).otherwise(0)) \
        .withColumn("sandbox_calls", F.when(asked, 1 + F.col("doc_id") % 2).otherwise(0)) \
        .withColumn("judge_ok", F.when(asked, F.col("doc_id") % 29 != 0)) \
        .withColumn("judge_took_over", F.when(asked, F.col("doc_id") % 31 == 0)) \
        .withColumn("sandbox_error", asked & (F.col("doc_id") % 43 == 0)) \
        .withColumn("sandbox_acted", asked & (F.col("doc_id") % 5 == 0)) \
        .withColumn("by_judge", asked & (F.col("doc_id") % 3 == 0)) \
        .withColumn("cleared", F.when(asked, F.col("doc_id") % 4).otherwise(0))
