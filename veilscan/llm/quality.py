"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are fitted on a bounded sample of labelled
rows (``most`` rows, those of smallest hash, so the same rows at any partitioning), binned once, with logistic loss; they
are then flattened into arrays and walked for many documents at once in numpy, in the one pass that takes the statistics of every whole
text. Labels, language, source and id are never statistics.

Edge cases: a null or empty text has all statistics 0 and is scored like any other; a null doc_id has the key of the
empty string, takes no label and is scored; rows labelled more than once count once per label; null labels are left
out; with no labelled rows, or one kind of label only, every score is the share of label 1 (0.5 if there is none);
repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.text import in_slices
from veilscan.llm.common import written

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "spaces", "newlines", "symbols", "marks", "stops", "exclaims", "beyond_ascii",
    "distinct_words", "distinct_lines", "top_word", "capital_words", "line_words", "marked_words", "repeated_threes", "entropy",
]
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_MARK = np.frombuffer(b",;:'\"()-", np.uint8)
_STOP = np.frombuffer(b".?", np.uint8)
_SYMBOL = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in b",;:'\"()-.?!"])


def statistics(text: str | None) -> list[float]:
    """Document statistics, all over the whole text; ratios are of bytes, words or lines."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = data.split(b"\n")
    w = max(1, len(words))
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    threes = set(zip(words, words[1:], words[2:]))
    ends = b"".join([x[-1:] for x in words])
    starts = b"".join([x[:1] for x in words])
    last = np.bincount(np.frombuffer(ends, np.uint8), minlength=256)
    first = np.bincount(np.frombuffer(starts, np.uint8), minlength=256)
    p = seen[seen > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), (n - seen[_SPACE].sum()) / w, seen[_UPPER].sum() / n, seen[_DIGIT].sum() / n, seen[32] / n, seen[10] / n,
        seen[_SYMBOL].sum() / n, seen[_MARK].sum() / n, seen[_STOP].sum() / n, seen[33] / n, seen[128:].sum() / n, len(counts) / w,
        len(set(lines)) / len(lines), max(counts.values(), default=0) / w, first[_UPPER].sum() / w, len(words) / len(lines),
        (last[_SYMBOL].sum() + last[33]) / w, 1 - len(threes) / max(1, len(words) - 2), float(-(p * np.log2(p)).sum()),
    ]


def add_statistics(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` and ``x``, the statistics as an array, in one pass over the texts."""
    schema = docs.select(*carry, F.array(F.lit(0.0)).alias("x")).schema
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [pa.array(x, pa.list_(pa.float64()))], names=[*carry, "x"])

    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Trees:
    """Flattened trees: per tree a row of nodes in breadth-first order, children of i at 2i+1 and 2i+2, ``feature`` -1 at a leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: every tree walked for all rows of ``x`` together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[at]
                step = 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at])
                at = np.where(f >= 0, step, at)
            total += value[at]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Trees:
    """Boosting with logistic loss; each split is found from histograms of gradients over quantile bins."""
    share = (y.sum() + 0.0) / len(y) if len(y) else 0.5
    nodes = 2 ** (depth + 1) - 1
    if len(y) == 0 or share in (0.0, 1.0):
        far = 0.0 if len(y) == 0 else (50.0 if share else -50.0)
        return Trees(far, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-12)
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(y), np.int64)
        for node in range(nodes):
            own = np.nonzero(at == node)[0]
            if not len(own):
                continue
            sum_g, sum_h = g[own].sum(), h[own].sum()
            value[node] = -rate * sum_g / (sum_h + ridge)
            if 2 * node + 2 >= nodes or len(own) < 2 * least:
                continue
            best, pick = 1e-9, None
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[own, j]
                hg, hh, hn = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g[own], h[own], np.ones(len(own))))
                gain = hg ** 2 / (hh + ridge) + (sum_g - hg) ** 2 / (sum_h - hh + ridge) - sum_g ** 2 / (sum_h + ridge)
                gain[(hn < least) | (len(own) - hn < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, pick = gain[k], (j, k)
            if pick:
                j, k = pick
                feature[node], cut[node] = j, edges[j][k]
                at[own] = 2 * node + 1 + (binned[own, j] > k)
        total += value[at]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(values))


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, label: str = "quality", text: str = "text") -> Trees:
    """Fits on at most ``most`` labelled rows that are not held out. They are chosen by hash from the ids alone; only their
    texts are then read for statistics, so what is broadcast and what the driver gets are bounded by ``most``."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where("_y IS NOT NULL AND doc_id IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    there = docs.select("doc_id").distinct()
    sample = written(known.join(there, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(most), "sample")
    rows = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(sample), "doc_id")  # ``most`` rows at most
    found = written(add_statistics(rows, ["doc_id", "_y"], "_text"), "sample").orderBy("doc_id", "_y", "x").limit(most).toArrow()
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    return fit(x, (found["_y"].to_numpy() > 0).astype(np.float64))


def add_scores(docs: DataFrame, trees: Trees, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` and _score, in one pass over the whole texts; the flattened trees are of fixed size and travel with the task.

    Only the texts go to Python and only their scores come back, read in slices: what a task holds beside Spark's own rows is one
    batch of texts, not a batch of whole rows there and back."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in in_slices(batch):
                yield pa.array(held.value.scores(np.array([statistics(t.as_py()) for t in texts])))

    return docs.select(*carry, scores(F.col(text)).alias("_score"))


def classify(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    scored = add_scores(docs, train(docs, labels, most), ["doc_id"])
    score = F.col("_score")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, most: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``least`` or more."""
    scored = add_scores(docs, train(docs, labels, most), list(docs.columns))
    return scored.where(F.col("_score") >= least).select(*docs.columns)
