"""Sets of words at least so similar (Jaccard) to an earlier set of their team, exactly, without a row per pair.

Distinct sets are laid out in blocks by size class, each set as its size and parity bits, about twice as many as it has
members. Two blocks of a team meet in one task and are compared there by numpy; only pairs whose sizes and bits allow the
similarity leave it, and of those one a set, its nearest. It is verified on the words themselves. Sets whose nearest
failed, and that have others, go through once more, with all pairs that pass. Comparisons grow with the square of a
team's sets of like size; what is written or shuffled holds a set once per block that its own block meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.streaming.streams import shared_folder

#: Sets in a block, about; two blocks are compared at a time.
BLOCK = 16_384
#: Sets of one block, and of the other, in one numpy step: its arrays stay in a core's cache.
STRIP, STRETCH = 32, 2048
LEAST_BITS = 256


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` under the checkpoint folder and returns that table."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def class_step(threshold: float) -> float:
    """Width of a size class in logarithms: sizes that allow the threshold are at most two classes apart."""
    return -math.log(threshold - 1e-3) / 2


def sketched(sets: DataFrame, team: str, key: str, threshold: float) -> DataFrame:
    """team, key, n, class and bits: whether an odd number of a set's words has each residue. Two sets differ in no fewer words
    than their bits differ in places, so bits too far apart rule a pair out exactly."""
    step = class_step(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, bits = batch.column(3).to_numpy(), []
            for c, words in zip(classes, batch.column(4)):
                m = max(LEAST_BITS, 1 << math.ceil(math.log2(2 * math.exp((c + 1) * step))))
                odd = np.bincount(words.values.to_numpy() & (m - 1), minlength=m) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bits, pa.binary())], names=[team, key, "n", "class", "bits"])

    n = F.size("_set")
    rows = sets.select(team, key, n.alias("n"), F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / step).cast("int").alias("class"),
                       F.transform("_set", lambda w: F.xxhash64(w)).alias("words"))
    schema = rows.drop("words").schema.add("bits", "binary")
    return rows.mapInArrow(run, schema)


def block_pairs(sketches: DataFrame, team: str, key: str) -> DataFrame:
    """team, sets_a, sets_b (null where a block meets itself): every two blocks of a team that can hold similar sets."""
    sizes = sketches.groupBy(team, "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = written(sketches.join(sizes, [team, "class"]).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).groupBy(team, "class", "block")
                     .agg(F.collect_list(F.struct(F.col(key).alias("id"), "n", "bits", "open")).alias("sets")), "set-blocks")
    names = blocks.select(team, "class", "block")
    one, two = (names.select(team, F.col("class").alias(f"class_{x}"), F.col("block").alias(f"block_{x}")) for x in "ab")
    near = one.withColumn("class_b", F.explode(F.array(*[F.col("class_a") + s for s in range(3)]))).join(two, [team, "class_b"]) \
        .where("class_b > class_a OR block_a <= block_b")
    a, b = (blocks.select(team, F.col("class").alias(f"class_{x}"), F.col("block").alias(f"block_{x}"), F.col("sets").alias(f"sets_{x}")) for x in "ab")
    same = (F.col("class_a") == F.col("class_b")) & (F.col("block_a") == F.col("block_b"))
    return near.join(a, [team, "class_a", "block_a"]).join(b, [team, "class_b", "block_b"]).select(team, "sets_a", F.when(~same, F.col("sets_b")).alias("sets_b"))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bits over fewer residues: of half as many, the parities of two are one's."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def nearest_only(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(y, x, apart, met): of each y the least apart x, and how many it had."""
    y, x, apart, met = found
    order = np.lexsort((x, apart, y))
    y, x, apart, met = y[order], x[order], apart[order], met[order]
    first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])[:len(y)])
    return y[first], x[first], apart[first], np.add.reduceat(met, first) if len(first) else met


def near_sets(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], threshold: float, thin: bool) -> tuple[np.ndarray, ...]:
    """(y, x, apart, met) of two blocks (id, n in order, bits, open): pairs x < y, y open, whose sizes and bits allow the
    threshold; with ``thin`` the nearest of each y. ``apart`` is in thousandths of what the two sets hold."""
    words = min(one[2].shape[1], two[2].shape[1])
    bits_a, bits_b = (np.ascontiguousarray(folded(v[2], words).T) for v in (one, two))
    found = tuple(np.zeros(0, np.int64) for _ in range(4))
    for at in range(0, len(one[0]), STRIP):
        ids, n, _, asked = (v[at:at + STRIP] for v in one)
        lo, hi = np.searchsorted(two[1], [threshold * n[0] - 1e-6, n[-1] / threshold + 1e-6])
        news = []
        for left in range(lo, hi, STRETCH):
            right = min(left + STRETCH, hi)
            apart = np.zeros((len(ids), right - left), np.uint16 if words < 1024 else np.uint32)
            for k in range(words):
                apart += np.bitwise_count(bits_a[k, at:at + STRIP, None] ^ bits_b[k, None, left:right])
            total = n[:, None] + two[1][None, left:right]
            i, j = np.nonzero(apart <= (1 - threshold) / (1 + threshold) * total + 1e-6)
            a, b = ids[i], two[0][left:right][j]
            good = (a != b) & np.where(a > b, asked[i], two[3][left:right][j])
            i, j, a, b = i[good], j[good], a[good], b[good]
            if len(a):
                news.append((np.maximum(a, b), np.minimum(a, b), 1000 * apart[i, j].astype(np.int64) // np.maximum(total[i, j], 1), np.ones(len(a), np.int64)))
        if news:
            found = tuple(np.concatenate(v) for v in zip(found, *news))
            found = nearest_only(found) if thin else found
    return found


def candidates(sketches: DataFrame, team: str, key: str, threshold: float, thin: bool) -> DataFrame:
    """(team, y, x, apart, met) of sets whose sizes and bits allow the threshold; ``sketches`` has ``open``: whether a set, as
    the later one, is asked for."""
    def side(cell: pa.ListScalar) -> tuple[np.ndarray, ...]:
        rows = cell.values
        n = rows.field("n").to_numpy().astype(np.int64)
        order = np.argsort(n, kind="stable")
        bits = np.frombuffer(b"".join(rows.field("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        return tuple(v[order] for v in (rows.field("id").to_numpy(), n, bits, rows.field("open").to_numpy(zero_copy_only=False)))

    def met(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, ...]:
        if b is None:  # a block and itself: its open sets with all of it
            return near_sets(tuple(v[a[3]] for v in a), (*a[:3], np.zeros(len(a[3]), bool)), threshold, thin)
        parts = [near_sets(tuple(v[x[3]] for v in x), (*y[:3], np.zeros(len(y[3]), bool)), threshold, thin) for x, y in ((a, b), (b, a))] \
            if not (a[3].all() and b[3].all()) else [near_sets(a, b, threshold, thin)]
        return tuple(np.concatenate(v) for v in zip(*parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, x, y in zip(batch.column(0), batch.column(1), batch.column(2)):
                found = met(side(x), side(y) if y.is_valid else None)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([group.as_py()] * len(found[0]), batch.column(0).type), *map(pa.array, found)],
                                                     names=[team, "y", "x", "apart", "met"])

    pairs = block_pairs(sketches, team, key)
    return pairs.mapInArrow(run, pairs.select(team).schema.add("y", "long").add("x", "long").add("apart", "long").add("met", "long"))


def similar(pairs: DataFrame, sets: DataFrame, team: str, key: str, threshold: float) -> DataFrame:
    """The pairs (team, y, x) whose sets are as similar as asked, on the words themselves."""
    ends = pairs.select(team, F.col("x").alias(key)).union(pairs.select(team, F.col("y").alias(key))).distinct()
    asked = written(sets.join(ends, [team, key], "left_semi").select(team, key, "_set"), "asked-sets")
    x, y = (asked.select(team, F.col(key).alias(c), F.col("_set").alias(f"_set_{c}")) for c in "xy")
    shared: Column = F.size(F.array_intersect("_set_x", "_set_y"))
    return pairs.join(x, [team, "x"]).join(y, [team, "y"]) \
        .filter(shared >= threshold * (F.size("_set_x") + F.size("_set_y") - shared)).select(team, "y").distinct()


def near_earlier(sets: DataFrame, team: str, key: str, threshold: float) -> DataFrame:
    """(team, y): the keys of sets similar to one of a lesser key in their team. ``sets`` has team, key (a long) and _set."""
    sketches = written(sketched(sets, team, key, threshold), "sketches")
    best = candidates(sketches.withColumn("open", F.lit(True)), team, key, threshold, True).groupBy(team, "y") \
        .agg(F.min(F.struct("apart", "x")).alias("best"), F.sum("met").alias("met"))
    best = written(best.select(team, "y", F.col("best.x").alias("x"), "met"), "nearest-sets")
    sure = written(similar(best.select(team, "y", "x"), sets, team, key, threshold), "similar-sets")
    rest = written(best.where("met > 1").join(sure, [team, "y"], "left_anti").select(team, F.col("y").alias(key), F.lit(True).alias("asked")).distinct(), "open-sets")
    if rest.isEmpty():
        return sure
    marked = sketches.join(rest, [team, key], "left").withColumn("open", F.coalesce("asked", F.lit(False))).drop("asked")
    more = written(candidates(marked, team, key, threshold, False).select(team, "y", "x").distinct(), "more-sets")
    return sure.unionByName(similar(more, sets, team, key, threshold))
