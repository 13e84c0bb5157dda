"""Structured Streaming jobs: the same functions as in batch, over arriving rows."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.scorers import Scorer
from veilscan.operators.runaudit import DETECTOR_STAGES, STAGES
from veilscan.operators.screen import check_items
from veilscan.settings import Options
from veilscan.sources.audit import check_entries


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one the session names for checkpoints; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="veilscan-stream-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def write_batches(stream: DataFrame, out: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], **start):
    """Runs a batch function on each micro-batch. A batch writes its own folder, so a retried one replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**start) if start else writer).start()


def screen_stream(items: DataFrame, out: str, checkpoint: str, scorers: list[Scorer], opts: Options = Options(), **start):
    """Screens arriving items with the batch function, so stream and batch can never answer differently."""
    return write_batches(items, out, checkpoint, lambda b: check_items(b, scorers, opts=opts), **start)


def stage_events(report: DataFrame) -> DataFrame:
    """One event per finished stage of a check, then its result, which holds the answer.

    A cut item is cut and read again once, and once more for each time its cut was widened. Only the result's event carries the
    report, so the others stay small.
    """
    asked = F.col("lane") != "clean"

    def ran(*names: str, when: Column | None = None) -> Column:
        stages = F.array(*[F.lit(n) for n in names])
        return stages if when is None else F.when(when, stages).otherwise(F.array().cast("array<string>"))

    stages = F.concat(
        ran(*DETECTOR_STAGES), ran("judge", when=asked & F.col("judge").isNotNull()), ran("sandbox", when=asked & F.col("sandbox").isNotNull()),
        ran("decide"), F.flatten(F.array_repeat(ran("cut", "recheck"), F.col("passes"))), ran("report", "result"))
    answer = F.struct(*[c for c in report.columns if c not in ("item_id", "content", "layers")])
    events = F.transform(stages, lambda stage, i: F.struct(
        i.alias("seq"), stage.alias("stage"), F.when(stage == "result", answer).alias("result")))
    return report.select("item_id", "verdict", F.inline(events)).select("item_id", "seq", "stage", "verdict", "result")


def stage_event_stream(items: DataFrame, out: str, checkpoint: str, scorers: list[Scorer], judgements: DataFrame | None = None,
                       sandbox: DataFrame | None = None, opts: Options = Options(), **start):
    """Checks arriving items with the batch function and writes the events of their stages."""
    return write_batches(items, out, checkpoint, lambda b: stage_events(check_items(b, scorers, judgements, sandbox, opts=opts)), **start)


def unfinished(events: DataFrame) -> DataFrame:
    """Checks whose stream ended without a result: each is a failure."""
    done = events.filter("stage = 'result'").select("item_id")
    return events.select("item_id").distinct().join(done, "item_id", "left_anti")


def audit_sink(reports: DataFrame, path: str, checkpoint: str, **start):
    """Appends one text-free row per streamed check."""
    writer = check_entries(reports).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**start) if start else writer).start()


def live_counts(audit: DataFrame, ts: str = "ts", delay: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Verdict counts per window of an audit stream; late rows beyond the delay are dropped by the watermark."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return audit.withWatermark(ts, delay).groupBy(window.alias("w"), "source", "verdict").agg(F.count("*").alias("n"))


def dedupe_results(results: DataFrame, key: str = "id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first result per id within the watermark."""
    return results.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def latest_stage_stream(events: DataFrame) -> DataFrame:
    """Finished stages and the running one per check, replaced whole as events arrive (update or complete mode)."""
    done = events.groupBy("check_id").agg(F.collect_set("stage").alias("done"), F.max("at_ms").alias("at_ms"))  # at most nine stages
    waiting = F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: ~F.array_contains("done", s))
    return done.select("check_id", F.size("done").alias("finished"), F.get(waiting, F.lit(0)).alias("running"), "at_ms")


def turn_blocks(turn: Column, block: int, overlap: int) -> Column:
    """The blocks a turn belongs to: each starts ``overlap`` turns before the last one ends, so words split over a cut are
    also read together in the block that spans it."""
    step = block - overlap
    first = F.greatest(F.floor((turn - block) / step) + 1, F.lit(0).cast("bigint"))
    return F.sequence(first, F.floor(turn / step))


def _joined(per: DataFrame, *keys) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return per.groupBy(*keys).agg(F.count("*").alias("messages"), F.array_join(texts, "\n").alias("content"))


def conversation_threads(turns: DataFrame, block: int = 50, overlap: int = 10) -> DataFrame:
    """Messages of a conversation joined in order, in overlapping blocks of turns, so split instructions are read together.

    A conversation of any length is many blocks: no block, and so no task, holds more than ``block`` messages.
    """
    return _joined(turns.withColumn("block", F.explode(turn_blocks(F.col("turn"), block, overlap))), "conv_id", "block")


def conversation_sessions(turns: DataFrame, ts: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes", block: int = 50, overlap: int = 10) -> DataFrame:
    """The streaming form: one text per conversation, session and block of turns. Append mode gives a session out once the
    watermark has passed it; ``run_closed`` also gives out those still open when the input ends."""
    per = turns.withWatermark(ts, delay).withColumn("block", F.explode(turn_blocks(F.col("turn"), block, overlap)))
    return _joined(per, "conv_id", "block", F.session_window(ts, gap).alias("session"))


def _run(stream: DataFrame, out: str) -> None:
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()


def run_to_folder(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over all available input and reads the files it wrote."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    _run(stream, out)
    return spark.read.schema(stream.schema).parquet(out)


#: Later than any row's time; a row of it moves the watermark past every open window.
END_OF_TIME = "9999-01-01"


def run_closed(source: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, ts: str = "ts") -> DataFrame:
    """Runs ``build`` as an append stream over all of a source that ends, and gives out what is still open then.

    The job reads the source and a closing folder of its own. Once the source is read to its end, one row of END_OF_TIME, null in
    all else, goes into that folder and the same job, from its checkpoint, goes on: the watermark passes every window that
    holds rows, so each is given out once. The closing row's own window stays open and is never given out.
    """
    spark = source.sparkSession
    out = shared_folder(spark, name)
    closing = out + "-closing"
    nulls = spark.range(1).select(*[F.lit(END_OF_TIME if f.name == ts else None).cast(f.dataType).alias(f.name) for f in source.schema])
    nulls.limit(0).write.parquet(closing)
    stream = build(source.unionByName(spark.readStream.schema(source.schema).parquet(closing)))
    _run(stream, out)
    nulls.write.mode("append").parquet(closing)
    _run(stream, out)
    return spark.read.schema(stream.schema).parquet(out)
