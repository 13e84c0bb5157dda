"""Shared helpers: tables in the cluster's shared folder, word patterns, rank-free row identity, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, wherever a contract speaks of words: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a temporary one only where that is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="veilscan-llm-"))
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and returns that table: lost executors cost no recomputation."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def components(edges: DataFrame, spark: SparkSession, most_rounds: int = 64) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being its smallest node.

    ``edges`` has columns a, b of one orderable type. Each round takes the smallest label among a node and its
    neighbours and then jumps to the label's own label, so paths halve; every step is a join and a combining
    aggregate, and each round's labels are written to the shared folder. Stops when a round changes nothing.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
                   .distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near.select(F.col("a").alias("node"), "near"), "node") \
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = written(best.join(jump, "label", "left")
                       .select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = step.where("old <> label").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle; raise most_rounds")


def ranked(df: DataFrame, order: list[Column], out: str, name: str, add: str | None = None) -> DataFrame:
    """Adds each row's 0-based place in ``order``, or, with ``add``, the sum of that column over the rows before it.

    The table is range-sorted over all tasks and written; only one number per partition is then summed in order. Pass
    a written table: a range sort reads its input twice.
    """
    rows = written(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    amount = F.coalesce(F.col(add), F.lit(0)).cast("bigint") if add else F.lit(1).cast("bigint")
    sums = rows.groupBy(part.alias("_part")).agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    if add:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    else:
        within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).withColumn("_within", within).join(offsets, "_part") \
        .withColumn(out, F.col("_within") + F.col("_offset")).drop("_part", "_at", "_within", "_offset")


def keyed(docs: DataFrame, cols: list[str]) -> DataFrame:
    """``docs`` with _k1 and _k2: 128 bits that name a row by the values of ``cols``, nulls included."""
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]
    return docs.withColumns({"_k1": F.xxhash64(*whole), "_k2": F.xxhash64(F.lit(1), *reversed(whole))})


#: Bits of the filter that keeps rows without a partner out of a join: 2**22 bits are 512 KB.
FILTER_BITS = 22


def filter_words(keys: DataFrame, key: str = "_k1", bits: int = FILTER_BITS) -> DataFrame:
    """A one-hash Bloom filter as a table (_slot, _word) of at most 2**(bits - 6) rows, whatever the number of keys."""
    return keys.select(F.shiftright(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)), 6).alias("_slot"),
                       F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(key).bitwiseAND(F.lit(63)).cast("int")).alias("_bit")) \
        .groupBy("_slot").agg(F.bit_or("_bit").alias("_word"))


def split_by_filter(rows: DataFrame, words: DataFrame, key: str = "_k1", bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among the filter's keys, rows that surely are not). The filter is broadcast: 1 MB at most."""
    slot = F.shiftright(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)), 6)
    marked = rows.withColumn("_slot", slot).join(F.broadcast(words), "_slot", "left")
    bit = F.call_function("shiftright", F.coalesce(F.col("_word"), F.lit(0).cast("bigint")), F.col(key).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return marked.where(bit == 1).drop("_slot", "_word"), marked.where(bit == 0).drop("_slot", "_word")
