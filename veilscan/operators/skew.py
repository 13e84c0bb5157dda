"""Exact ranks, picks and quantiles per group that never bring a whole group into one task.

A window over a group holding a third of all rows would sort them in one task. Here rows are first
counted per (group, bucket of the order key); only those small counts are windowed, to give each
bucket its offset. The fine sort then runs per (group, bucket), so a hot group is spread over as
many tasks as it has buckets. Results are exact: no sampling, no cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def seeded(seed: int, *cols: str) -> Column:
    """A reproducible shuffle key: same rows and seed, same order, on any cluster."""
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))


def arithmetic_shuffle(col: str, a: int = 7919, b: int = 104729, m: int = 1_000_003) -> Column:
    """A shuffle key that plain SQL can compute too."""
    return F.pmod(F.col(col) * F.lit(a) + F.lit(b), F.lit(m))


def number_rows(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str = "rn",
                bucket: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Exact 1-based row number per group by an integer order column, then the tie columns.

    ``bucket`` must not decrease as ``order`` grows; by default the order column's value range over
    the whole table is cut into ``buckets`` equal parts.
    """
    if bucket is None:
        ends = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
        df = df.crossJoin(F.broadcast(ends))  # one row of two numbers
        width = F.greatest(F.col("_hi") - F.col("_lo") + 1, F.lit(1)).cast("double") / buckets
        bucket = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(
            F.floor((F.col(order) - F.col("_lo")).cast("double") / width).cast("int"))
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    if keys:
        w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    else:
        w = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    fine = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)
    numbered = df.withColumn("_fine", F.row_number().over(fine))
    cond = [numbered[c].eqNullSafe(offsets[c]) for c in [*keys, "_bucket"]]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    joined = numbered.join(offsets.select(*[F.col(c) for c in [*keys, "_bucket"]], "_offset"), on)
    keep = [numbered[c] for c in df.columns if c not in ("_bucket", "_lo", "_hi")]
    return joined.select(*keep, (F.col("_fine") + F.col("_offset")).cast("bigint").alias(out))


def value_at_rank(df: DataFrame, keys: list[str], value: str, rank: Column, out: str, buckets: int = BUCKETS) -> DataFrame:
    """The value at a 1-based rank per group; ``rank`` is a column expression over the group size ``n``.

    Values are counted first (map-side), so one row per distinct value is shuffled. Distinct values
    are then ranked in buckets, so neither many rows nor many values meet in one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ends = counts.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)).cast("double") / buckets
    placed = counts.crossJoin(F.broadcast(ends)).withColumn(
        "_b", F.floor((F.col(value) - F.col("_lo")).cast("double") / width).cast("int")).drop("_lo", "_hi")
    per_bucket = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, "_b", "_bc", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_off"),
                                F.sum("_bc").over(part).alias("n"))
    target = offsets.withColumn("_rank", rank.cast("bigint")).filter(
        (F.col("_rank") > F.col("_off")) & (F.col("_rank") <= F.col("_off") + F.col("_bc")))
    fine = Window.partitionBy(*keys, "_b").orderBy(value)
    hit = placed.join(target.select(*keys, "_b", "_off", "_rank", "n"), [*keys, "_b"]) \
        .withColumn("_cum", F.sum("_c").over(fine) + F.col("_off"))
    return hit.filter((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_c") < F.col("_rank"))) \
        .select(*keys, F.col(value).alias(out), "n")


def first_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per group, as an aggregate: combined map-side, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def previous_value(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, out: str, default: int = 0,
                   width: int = 3_600_000) -> DataFrame:
    """The value on the row before, per group in order, without sorting a whole group in one task.

    Rows are windowed per (group, time bucket); the first row of a bucket takes the last value of the
    bucket before it, from a table with one row per bucket.
    """
    df = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(width)))
    part = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)
    lasts = df.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(order, *ties)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket")
    carried = lasts.select(*keys, "_bucket", F.coalesce(F.lag("_last").over(before), F.lit(default)).alias("_carry"))
    rows = df.withColumn("_prev", F.lag(value).over(part))
    return rows.join(carried, [*keys, "_bucket"]).withColumn(out, F.coalesce("_prev", "_carry")).drop("_prev", "_carry", "_bucket")
