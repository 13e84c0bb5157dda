"""Exact top-k inner products by ball-tree branch and bound.

Vectors are cut into shards by hash; each shard's ball tree is built once, in a task, and written as one row of the
index. A query first searches the shard it lies in, and the k-th score found there is shared: every other shard then
opens its nodes in order of their upper bound q.c + |q| r and stops at the first bound below the shared score, which
rises as better rows are found. Every vector is indexed and bounds are never rounded down, so results are exact.

Edge cases: vectors that are null or hold null or non-finite components take no part, as row or query; vectors are
compared only with vectors of the same length (an empty vector scores 0); a null vec_id is no query and, as a
candidate, orders after every number; repeated rows are candidates of each other; a component beyond the range of a
long, and a score beyond it, is held at its end; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import written

#: Vectors in a shard and queries in a block, about; vectors in a leaf at most.
SHARD, QUERIES, LEAF = 8192, 2048, 256
LAST = np.iinfo(np.int64).max


def whole_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """Written table (rid, vec_id, dim, v) of floor(scale * x) for the vectors that take part; rid tells rows apart."""
    def sound(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    v = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v")) \
        .where(F.col("v").isNotNull()).where(F.forall("v", lambda x: F.coalesce(sound(x), F.lit(False))))
    return written(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("v").alias("dim"), v.alias("v")), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dim)


def build_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, and per node (start, stop, left child or -1), centre and radius. Nodes split at the middle of the
    rows' order along the line between two far rows."""
    order, nodes, centres, radii, todo = np.arange(len(v)), [[0, len(v), -1]], [], [], [0]
    f = v.astype(np.float64)
    while todo:
        at = todo.pop(0)
        lo, hi, _ = nodes[at]
        rows = f[order[lo:hi]]
        centre = rows.mean(0) if len(rows) else np.zeros(v.shape[1])
        away = np.sqrt(((rows - centre) ** 2).sum(1))
        centres.append(centre)
        radii.append(away.max(initial=0.0))
        if hi - lo > LEAF and radii[-1] > 0:
            one = rows[away.argmax()]
            two = rows[((rows - one) ** 2).sum(1).argmax()]
            order[lo:hi] = order[lo:hi][np.argsort(rows @ (two - one), kind="stable")]
            nodes[at][2] = len(nodes)
            nodes += [[lo, (lo + hi) // 2, -1], [(lo + hi) // 2, hi, -1]]
            todo += [len(nodes) - 2, len(nodes) - 1]
    return order, np.array(nodes, np.int64), np.array(centres).reshape(len(nodes), -1), np.array(radii)


def inner(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Exact integer inner products: in floating point where every sum stays under 2**53, else in Python's integers."""
    if exact:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    whole = v.astype(object) @ q.astype(object)
    return np.array([max(-LAST - 1, min(LAST, int(x))) for x in whole], np.int64)


def search(tree: dict, q: np.ndarray, q_rid: int, k: int, floor_score: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows (positions in tree order, scores) of one shard for one query, leaving out rows under ``floor_score``."""
    nodes, v, ids, rids = tree["nodes"], tree["v"], tree["ids"], tree["rids"]
    length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
    upper = tree["centres"] @ q.astype(np.float64) + length * tree["radii"]
    upper += 1 + 1e-9 * (np.abs(upper) + length * (tree["radii"] + np.sqrt((tree["centres"] ** 2).sum(1))))
    exact = float(np.abs(q).max(initial=0)) * tree["largest"] * max(1, len(q)) < 2.0 ** 53
    bound = -np.inf if floor_score is None else floor_score
    heap, best, scores = [(-upper[0], 0)], np.zeros(0, np.int64), np.zeros(0, np.int64)
    while heap:
        most, at = heapq.heappop(heap)
        if -most < bound:
            break
        lo, hi, child = nodes[at]
        if child >= 0:
            for c in (child, child + 1):
                if upper[c] >= bound:
                    heapq.heappush(heap, (-upper[c], c))
            continue
        got = inner(q, v[lo:hi], exact)
        keep = np.nonzero((got >= bound) & (rids[lo:hi] != q_rid))[0]
        if len(keep):
            best, scores = np.concatenate([best, keep + lo]), np.concatenate([scores, got[keep]])
            if len(best) > k:
                first = np.lexsort((rids[best], ids[best], -scores))[:k]
                best, scores = best[first], scores[first]
            if len(best) == k:
                bound = max(bound, scores.min())
    return best, scores


def _grow(group: pa.Table) -> pa.Table:
    dim = group["dim"][0].as_py()
    v = matrix(group["v"], dim)
    order, nodes, centres, radii = build_tree(v)
    ids, rids = (group[c].combine_chunks().take(pa.array(order)) for c in ("vec_id", "rid"))
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "shard": group["shard"].slice(0, 1).combine_chunks(), "n": pa.array([len(v)], pa.int64()),
        "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "rids": pa.array([rids.to_pylist()], pa.list_(pa.int64())),
        "v": [v[order].tobytes()], "nodes": [nodes.tobytes()], "centres": [centres.tobytes()], "radii": [radii.tobytes()]})


def _opened(row: dict) -> dict:
    n, dim = row["n"], row["dim"]
    v = np.frombuffer(row["v"], np.int64).reshape(n, dim)
    nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 3)
    return {"nodes": nodes, "centres": np.frombuffer(row["centres"], np.float64).reshape(len(nodes), dim),
            "radii": np.frombuffer(row["radii"], np.float64), "v": v, "largest": float(np.abs(v.astype(np.float64)).max(initial=0)),
            "ids": np.array([LAST if x is None else x for x in row["ids"]], np.int64), "named": row["ids"], "rids": np.array(row["rids"], np.int64)}


INDEX = "dim int, shard bigint, n bigint, ids array<bigint>, rids array<bigint>, v binary, nodes binary, centres binary, radii binary"
FOUND = "q_rid bigint, query_id bigint, vec_id bigint, rid bigint, score bigint"


def _searcher(k: int):
    def run(key: tuple, trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("q_rid", "query_id", "vec_id", "rid", "score")}
        for row in trees.to_pylist():
            tree = _opened(row)
            q = matrix(queries["v"], row["dim"])
            for i, (rid, vec_id, least) in enumerate(zip(queries["rid"].to_pylist(), queries["vec_id"].to_pylist(), queries["least"].to_pylist())):
                best, scores = search(tree, q[i], rid, k, least)
                out["q_rid"] += [rid] * len(best)
                out["query_id"] += [vec_id] * len(best)
                out["vec_id"] += [tree["named"][p] for p in best]
                out["rid"] += tree["rids"][best].tolist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row of ``vectors`` (from ``whole_vectors``) that is a query.

    Queries meet shards as blocks on a grid: the pair (shard, block) is the join key, so no key gathers more than one
    shard and one block. The number of shards and blocks follows from counts of the whole table.
    """
    total, asked = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-total // SHARD)), max(1, -(-asked // QUERIES))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))
    index = written(placed.groupBy("dim", "shard").applyInArrow(_grow, INDEX), "balltrees")
    queries = written(placed.where(is_query), "queries")
    home = queries.withColumn("least", F.lit(None).cast("bigint"))
    near = written(index.groupBy("dim", "shard").cogroup(home.groupBy("dim", "shard")).applyInArrow(_searcher(k), FOUND), "home")
    floor_scores = near.groupBy("q_rid").agg(F.count("*").alias("n"), F.min("score").alias("s")) \
        .select(F.col("q_rid").alias("rid"), F.when(F.col("n") >= k, F.col("s")).alias("least"))
    block = F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(blocks))
    asked_far = queries.join(floor_scores, "rid", "left").withColumn("block", block).withColumnRenamed("shard", "own") \
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))).where("shard <> own").drop("own")
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    far = spread.groupBy("dim", "shard", "block").cogroup(asked_far.groupBy("dim", "shard", "block")).applyInArrow(_searcher(k), FOUND)
    order = Window.partitionBy("q_rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid")
    return near.union(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
