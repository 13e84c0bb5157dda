"""Planted documents carried through the rule-only evidence steps, and their stand-in scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.rules import hits_in
from veilscan.functions.scorers import Scorer, keyword_scorer
from veilscan.functions.text import split_units
from veilscan.functions.spans import fence
from veilscan.operators import cutting as C
from veilscan.operators import evidence as E
from veilscan.settings import CUT_ARRAY, GROUP_ARRAY, LAYER_ARRAY, empty
from veilscan.sources.planted import planted

PHRASES_A = ["ignore all previous", "your new task", "system prompt", "password to", "without limits"]
PHRASES_B = ["ignore all previous", "do not tell", "delete all", "pretend to be", "verification code"]


def scorers() -> list[Scorer]:
    return [keyword_scorer("scorer_a", PHRASES_A), keyword_scorer("scorer_b", PHRASES_B)]


def with_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = planted(spark, sf_dir).select("doc_id", "source", "text", "label", "span_start", "span_end", "plant")
    return d.withColumn("units", fence(split_units(F.col("text"), F.coalesce(F.col("source") == "email", F.lit(False)))))


def with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_units(spark, sf_dir).withColumn("hits", fence(hits_in(F.col("text"), F.col("source"))))


def with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from the rules alone."""
    d = with_hits(spark, sf_dir)
    return d.withColumn("spans", fence(E.merge_spans(E.collect_spans(
        F.col("units"), F.col("hits"), empty(GROUP_ARRAY), empty(LAYER_ARRAY), F.array().cast("array<array<string>>")))))


def with_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts when no judge is configured: every span, then the payload sweep, then merging."""
    d = with_spans(spark, sf_dir)
    first = F.transform("spans", lambda s: C.make_cut(
        s["start"], s["end"], E.span_types(s), F.array(F.lit("rules")),
        F.array_sort(F.array_distinct(F.transform(s["hits"], lambda h: h["rule"]))), E.has_strong_rule(s))).cast(CUT_ARRAY)
    d = d.withColumn("first_cuts", fence(first)).withColumn("swept", fence(
        C.payload_sweep(F.col("text"), F.col("units"), F.col("first_cuts"))))
    return d.withColumn("cuts", fence(C.merge_cuts(F.col("swept"))))
