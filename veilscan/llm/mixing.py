"""Mixing sources to target weights by entropy balancing.

Each source's tokens must come to its target. Among all document rates r that meet these constraints with 0 <= r <= cap,
the mix takes the one closest to the corpus (least sum of r log r - r), which is r = min(cap, exp(lambda_s * size / mean
size of s)). The lambda_s solve a convex dual; Newton steps for all sources at once are sums over the corpus, made by
Spark from a table of distinct (source, size) cells. Rates are rounded to whole copies by carrying the error in tokens.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a document of size 0 has rate 1
and adds nothing; a source of size 0 has target 0; repeated rows are documents of their own; an empty table gives no
rows; other columns are ignored. Results depend on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import WORD, keyed, ranked, written

#: Documents per rounding group, about: what one task holds at once.
GROUP = 1024
CLOSE = 1e-9
#: Sums over the corpus are of decimals, so their order, and with it the partitioning, has no part in the result.
EXACT = "decimal(38,9)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(src, source_size, docs, target): shares by weight in source order, held at ``cap`` times the source's own size.

    ``sizes`` is a written table (src, size), src being a struct whose order is the order of sources. Sharing the
    excess again and again by weight ends at min(cap * size, weight * level) for one level; each pass of the search for
    it is one sum over the sources and brings two numbers to the driver.
    """
    totals = written(sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources")
    order = ranked(totals, [F.col("src")], "place", "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    order = written(order.withColumn("weight", weight), "sources")
    most = F.col("source_size") * F.lit(float(cap))
    total = order.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        full = most <= F.col("weight") * F.lit(level)
        n, kept, open_weight = order.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)),
                                         F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == held or not open_weight:
            break
        level, held = max(level, (total - kept) / open_weight), n
    return order.select("src", "source_size", "docs", F.least(most, F.col("weight") * F.lit(level)).alias("target"))


def solve_tilts(cells: DataFrame, targets: DataFrame, cap: float, most_rounds: int = 200) -> DataFrame:
    """Adds ``tilt`` (lambda) to the targets. ``cells`` is a written table (src, size, n) of sizes over 0.

    Safeguarded Newton on the logarithm of each source's total: a step outside the bracket known so far is replaced by
    its middle. A target at the cap, or 0, has an infinite tilt and takes no part.
    """
    done = F.col("target") >= F.col("source_size") * F.lit(float(cap) * (1 - 1e-12))
    state = targets.withColumn("tilt", F.when(F.col("target") <= 0, F.lit(float("-inf"))).when(done, F.lit(float("inf")))
                               .otherwise(F.log(F.col("target") / F.col("source_size")))) \
        .withColumn("lo", F.lit(-1e9)).withColumn("hi", F.lit(1e9)).withColumn("off", F.lit(1.0))
    state = written(state, "tilts")
    for _ in range(most_rounds):
        x = F.col("size") / (F.col("source_size") / F.col("docs"))
        rate = F.exp(F.col("tilt") * x)
        got = F.col("n") * F.col("size") * F.least(rate, F.lit(float(cap)))
        slope = F.when(rate < cap, F.col("n") * F.col("size") * rate * x).otherwise(F.lit(0.0))
        live = (F.col("off") > CLOSE) & ~F.col("tilt").isin(float("inf"), float("-inf"))
        sums = cells.join(state.where(live).select("src", "tilt", "source_size", "docs"), "src") \
            .groupBy("src").agg(F.sum(got.cast(EXACT)).cast("double").alias("got"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        step = state.join(sums, "src", "left")
        below = F.col("got") < F.col("target")
        lo, hi = F.when(below, F.col("tilt")).otherwise(F.col("lo")), F.when(below, F.col("hi")).otherwise(F.col("tilt"))
        newton = F.col("tilt") + (F.log("target") - F.log("got")) * F.col("got") / F.col("slope")
        middle = F.when((lo > -1e9) & (hi < 1e9), (lo + hi) / 2).when(below, F.col("tilt") * 2 + 1).otherwise(F.col("tilt") * 2 - 1)
        off = F.abs(F.col("got") / F.col("target") - 1)
        new = F.when((F.col("slope") > 0) & (newton > lo) & (newton < hi) & (F.abs(newton - F.col("tilt")) < 1e3), newton).otherwise(middle)
        flat = (hi - lo) <= F.abs(lo) * 1e-14
        state = written(step.select(
            "src", "source_size", "docs", "target",
            F.when(F.col("got").isNull() | (off <= CLOSE), F.col("tilt")).otherwise(new).alias("tilt"),
            F.when(F.col("got").isNull(), F.col("lo")).otherwise(lo).alias("lo"), F.when(F.col("got").isNull(), F.col("hi")).otherwise(hi).alias("hi"),
            F.when(F.col("got").isNull() | flat, F.lit(0.0)).otherwise(off).alias("off")), "tilts")
        if not state.where(F.col("off") > CLOSE).limit(1).count():
            return state.select("src", "source_size", "docs", "target", "tilt")
    raise RuntimeError("the tilts did not settle; raise most_rounds")


def whole_copies(rates: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rates rounded down or up, largest document first, so that tokens taken follow tokens due."""
    out = np.floor(rates).astype(np.int64)
    short = 0.0
    for i in np.argsort(-sizes, kind="stable"):
        short += float(rates[i] - out[i]) * float(sizes[i])
        if rates[i] > out[i] and 2 * short >= sizes[i] > 0:
            out[i] += 1
            short -= float(sizes[i])
    return out


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, source: str = "source", text: str = "text",
        carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry``, source, size, source_size, target, rate, copies and taken for every row of ``docs``.

    The texts are read once, for their sizes and a hash that orders ties; all else works on that small table. Rounding
    groups are cut by hash to about ``GROUP`` documents, so a source holding a third of all rows is many groups.
    """
    if math.floor(cap) != cap or cap < 1:
        raise ValueError("cap must be a whole number, 1 or more")
    src = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))
    rows = written(docs.select(*carry, src.alias("src"), word_count(F.col(text)).alias("size"),
                               F.xxhash64(*carry, source, text).alias("h")), "sizes")
    targets = source_targets(rows, weights, cap)
    cells = written(rows.where("size > 0").groupBy("src", "size").agg(F.count("*").alias("n")), "cells")
    tilts = solve_tilts(cells, targets, cap)
    x = F.col("size") / (F.col("source_size") / F.col("docs"))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.exp(F.col("tilt") * x), F.lit(float(cap))))
    rated = rows.join(tilts, "src").withColumn("rate", rate) \
        .withColumn("part", F.pmod(F.xxhash64("h", F.lit(7)), F.ceil(F.col("docs") / GROUP)))

    def rounded(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "descending"), ("h", "descending")])
        copies = whole_copies(group["rate"].to_numpy(), group["size"].to_numpy())
        return group.drop_columns(["name", "none", "part", "h"]).append_column("copies", pa.array(copies, pa.int64()))

    plain = rated.select(*carry, "size", "source_size", "target", "rate", "h", "part", "src.none", "src.name")
    kept = [f for f in plain.schema.fields if f.name not in ("name", "none", "part", "h")]
    out = plain.groupBy("none", "name", "part").applyInArrow(
        rounded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", copies bigint")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; rows equal in every column share their copies."""
    rows = keyed(docs, docs.columns)
    copies = mix(rows, weights, cap, carry=("_k1", "_k2")).groupBy("_k1", "_k2").agg(F.sum("copies").alias("_copies"))
    taken = written(copies.where("_copies > 0"), "copies")
    once = rows.join(taken, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(*docs.columns)
