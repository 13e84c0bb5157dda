"""Streaming jobs run over all available rows of the given tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from veilscan.operators.runaudit import STAGES
from veilscan.plans.evidence_queries import evidence_tables
from veilscan.plans.registry import query
from veilscan.plans.run_queries import ms_since_2024
from veilscan.sources.planted import items_of, pick, planted, table
from veilscan.sources.screened import scorers
from veilscan.streaming import streams as S


def stream_of(spark, sf, name):
    """A given table as a stream, be it one file or a folder of files: a pattern is matched against both."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}[.]parquet")


def event_stream(spark, sf):
    return stream_of(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("live_counts", """
SELECT strftime(hour, '%Y-%m-%d %H:00') AS hour, source, verdict, count(*) AS n FROM (
  SELECT date_trunc('hour', ts) AS hour, event_type AS source, CASE WHEN event_id % 7 = 0 THEN 'quarantine' ELSE 'allow' END AS verdict FROM events) GROUP BY ALL""")
def live_counts(spark, sf):
    e = event_stream(spark, sf).select("ts", F.col("event_type").alias("source"), F.when(F.col("event_id") % 7 == 0, "quarantine").otherwise("allow").alias("verdict"))
    out = S.run_closed(e, S.live_counts, "live-counts")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:00").alias("hour"), "source", "verdict", "n")


@query("dedupe_results", "SELECT event_id // 3 AS id, count(*) > 0 AS seen FROM events GROUP BY 1")
def dedupe_results(spark, sf):
    e = event_stream(spark, sf).select(F.floor(F.col("event_id") / 3).alias("id"), "ts")
    return S.run_to_folder(S.dedupe_results(e, delay="60 days"), "dedupe").select("id", F.lit(True).alias("seen"))


@query("latest_stage_stream")
def latest_stage_stream(spark, sf):
    e = event_stream(spark, sf)
    stage = pick(STAGES, F.when(F.col("event_type") == "view", 0).otherwise(F.col("event_id") % 9))
    live = S.latest_stage_stream(e.select(F.col("user_id").alias("check_id"), stage.alias("stage"), ms_since_2024(F.col("ts")).alias("at_ms")))
    out = S.shared_folder(spark, "latest-stage")
    # complete mode: each batch carries the whole current table and replaces the one before
    q = live.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(os.path.join(out, "now"))) \
        .option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(os.path.join(out, "now"))


@query("screen_stream")
def screen_stream(spark, sf):
    out = S.shared_folder(spark, "screened")
    docs = stream_of(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"), F.lit("web").alias("source"))
    S.screen_stream(docs, out, out + "-checkpoint", scorers(), availableNow=True).awaitTermination()
    return spark.read.parquet(out).groupBy("verdict", "lane").agg(F.count("*").alias("n"))


@query("stage_events")
def stage_events(spark, sf):
    judgements, sandbox = evidence_tables(spark, sf)
    out = S.shared_folder(spark, "stage-events")
    arriving = items_of(stream_of(spark, sf, "documents"))
    S.stage_event_stream(arriving, out, out + "-checkpoint", scorers(), judgements, sandbox, availableNow=True).awaitTermination()
    events = spark.read.parquet(out)
    lost = S.unfinished(events).select(F.lit("unfinished").alias("stage"), F.lit(None).cast("string").alias("verdict"))
    return events.select("stage", "verdict").unionByName(lost).groupBy("stage", "verdict").agg(F.count("*").alias("n"))


@query("conversation_threads", """
SELECT conv_id, block, count(*) AS messages, md5(string_agg(text, chr(10) ORDER BY turn)) AS content_md5 FROM (
  SELECT *, unnest(range(greatest(CAST(floor((turn - 50) / 40.0) AS BIGINT) + 1, 0), CAST(floor(turn / 40.0) AS BIGINT) + 1)) AS block FROM conversations) GROUP BY conv_id, block""")
def conversation_threads(spark, sf):
    return S.conversation_threads(table(spark, sf, "conversations")).select("conv_id", "block", "messages", F.md5("content").alias("content_md5"))


@query("conversation_sessions", """
SELECT conv_id, count(*) AS messages, md5(string_agg(text, chr(10) ORDER BY turn)) AS content_md5 FROM (
  SELECT *, unnest(range(greatest(CAST(floor((turn - 50) / 40.0) AS BIGINT) + 1, 0), CAST(floor(turn / 40.0) AS BIGINT) + 1)) AS block FROM conversations)
GROUP BY conv_id, block, CASE WHEN conv_id % 2 = 0 THEN 0 ELSE turn END""")
def conversation_sessions(spark, sf):
    c = stream_of(spark, sf, "conversations").withColumn("ts", F.timestamp_seconds(F.col("conv_id") * 100000 + F.col("turn") * F.when(F.col("conv_id") % 2 == 0, 60).otherwise(2400)))
    out = S.run_closed(c, S.conversation_sessions, "sessions")
    return out.select("conv_id", "messages", F.md5("content").alias("content_md5"))
