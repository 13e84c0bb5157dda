"""The audit table: what was decided and why, never the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how much of the content hash identifies a text
HASH_CHARS = 16


def content_key(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, HASH_CHARS)


def check_entries(report: DataFrame) -> DataFrame:
    """One text-free row per check."""
    def named(field: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.transform("attacks", lambda a: a[field]))))
    return report.select(
        F.lit("check").alias("checkpoint"), F.coalesce("source", F.lit("unknown")).alias("source"), "verdict", "lane",
        named("types").alias("types"), F.size("attacks").alias("cuts"), named("found_by").alias("found_by"), "warnings",
        content_key(F.col("content")).alias("content_sha256"), F.char_length("content").alias("content_chars"))


def guard_entries(decisions: DataFrame) -> DataFrame:
    """One row per acting call; reads are not logged."""
    return decisions.filter("kind IS NOT NULL").withColumn("checkpoint", F.lit("guard")).withColumnRenamed("decision", "verdict")


def review_entries(decisions: DataFrame) -> DataFrame:
    """Decisions a person would have been asked about."""
    return decisions.filter("needs_review")


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def recent(audit: DataFrame, limit: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest entries first; a top-k, so each task keeps at most ``limit`` rows."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return audit.orderBy(F.desc(ts), F.desc(seq)).limit(limit)
