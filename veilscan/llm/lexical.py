"""Ranked lexical search: each item's best documents by an integer score of shared terms, found in buckets of like norm.

A document is the sparse vector of its terms' weighted impacts, an item the vector of its terms' counts; the score is their inner
product. Vectors are ordered by length over all tasks (one range sort) and read bucket by bucket, longest first. For an item with
a k-th score so far,

- a bucket is pruned if the product of the item's length and the longest vector's stays below that score (Cauchy-Schwarz);
- inside, the item's coordinates with the greatest possible share (count times the bucket's greatest value there) are followed; the
  others, which together cannot reach the score, only add their bound: the smaller of their greatest shares' sum and of
  Cauchy-Schwarz on them. Documents whose followed part plus that bound stays below are dropped;
- survivors are scored anew, exactly, in 64-bit integers.

The longest sixteenth of the ranges goes first; its k-th scores are where all other tasks begin. Only vectors over the items' terms are
kept, so what a document has besides counts in its number of terms alone. Items are taken in blocks of at most ``block_bytes`` of text
(or one item), so what is broadcast is bounded; counts over the corpus are sums over all documents.

Edge cases: a null text or one without terms is no document and gets no score; an item without terms has no rows; equal rows of
``items`` count once, items of one id with other texts are ranked apart; equal scores go by ascending doc_id, null last; rows of
``docs`` with one doc_id are documents of their own; texts of any length are read whole; other columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilscan.llm.common import ranked, text_or_empty, written
from veilscan.llm.encoding import gathered, slices, words

#: Documents of a bucket, at most.
BUCKET = 8192
#: Lengths and bounds are doubles: they are widened by this share before anything is pruned.
SLACK = 1 + 1e-9
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, number of each term, end of each text): runs of digits, letters A-Z in lower case and characters beyond ASCII."""
    return words(texts, _TERM, _LOWER)


class Items:
    """A block of items: its vocabulary and, for each item, numbers of its terms and how often it holds each."""

    def __init__(self, ids: list, texts: list[str | None]):
        names, which, ends = terms_of(pa.array(texts, pa.string()))
        self.ids, self.vocabulary = ids, names
        self.terms, self.counts = [], []
        for a, b in zip([0, *ends.tolist()], ends.tolist()):
            term, count = np.unique(which[a:b], return_counts=True)
            self.terms.append(term)
            self.counts.append(count.astype(np.int64))
        self.lengths = [math.sqrt(float((c * c).sum())) for c in self.counts]


def term_vectors(docs: DataFrame, items: Items, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table: a row per document with terms (doc_id, n_terms, terms and tfs of the vocabulary as 32-bit integers), and one per task
    that read any (stats true): how many documents hold each term."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # bounded: terms of one block of items
    names = ["doc_id", "n_terms", "terms", "tfs", "stats"]

    def cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends * values.itemsize]).astype(np.int64)),
                                                                   pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        holding, read = np.zeros(len(vocabulary), np.int64), False
        for batch in batches:
            for piece in slices(batch, 1):
                found, which, ends = terms_of(piece.column(1))
                sizes = np.diff(ends, prepend=0)
                known = pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = known[which]
                doc = np.repeat(np.arange(len(sizes)), sizes)[term >= 0]
                cell, tf = np.unique(doc * len(vocabulary) + term[term >= 0], return_counts=True)
                doc, term = np.divmod(cell, max(len(vocabulary), 1))
                holding += np.bincount(term, minlength=len(vocabulary))
                stops = np.searchsorted(doc, np.arange(len(sizes)), side="right")
                out = pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes), cut(term.astype("<i4"), stops), cut(tf.astype("<i4"), stops),
                                                  pa.array(np.zeros(len(sizes), bool))], names=names)
                read = True
                yield out.filter(pa.array(sizes > 0))
        if read:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([b""], pa.binary()),
                                              pa.array([holding.astype("<i8").tobytes()], pa.binary()), pa.array([True])], names=names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    return written(rows.mapInArrow(run, "doc_id bigint, n_terms bigint, terms binary, tfs binary, stats boolean"), "term-vectors")


def holders(vectors: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term: the tasks' counts, summed by Spark; a row per term of the vocabulary at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    counted = vectors.where("stats").select("tfs").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counted.collect():
        out[r.term] = r.df
    return out


def by_length(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_all: int) -> DataFrame:
    """Written table of impact vectors, longest first over all its ranges: part, doc_id, length, terms, impacts."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)  # a number per term of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            sizes = np.frombuffer(pc.binary_length(batch.column(2)).buffers()[1], np.int32)[:batch.num_rows].astype(np.int64) // 4
            term = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4")
            tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").astype(np.int64)
            m = 75 + 25 * batch.column(1).to_numpy(zero_copy_only=False) * n_docs // max(n_all, 1)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, sizes))
            value = (weight[term] * impact).astype(np.float64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            length = np.sqrt(np.bincount(row, value * value, batch.num_rows))
            cells = impact.astype("<i4").tobytes()
            ends = (np.cumsum(sizes) * 4).tolist()
            packed = [cells[a:b] for a, b in zip([0, *ends], ends)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "length", "terms", "impacts"])
            yield out.filter(pa.array(length > 0))

    rows = vectors.where("NOT stats").select("doc_id", "n_terms", "terms", "tfs").mapInArrow(run, "doc_id bigint, length double, terms binary, impacts binary")
    ordered = rows.sort(F.desc("length"), F.col("doc_id").asc_nulls_last())
    return written(ordered.select(F.spark_partition_id().alias("part"), "*"), "impact-vectors")


class Best:
    """The k best (score, doc_id) of an item so far, equal scores by ascending doc_id, null last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.scores, self.docs, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a score must reach to matter."""
        return max(self.floor, int(self.scores[-1]) if len(self.scores) == self.k else 1)

    def add(self, scores: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        scores, docs, none = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs]), np.concatenate([self.none, none])
        order = np.lexsort((docs, none, -scores))[:self.k]
        self.scores, self.docs, self.none = scores[order], docs[order], none[order]


class Bucket:
    """Vectors of like length, by document and by term."""

    def __init__(self, docs: np.ndarray, none: np.ndarray, lengths: np.ndarray, terms: list[bytes], impacts: list[bytes], weight: np.ndarray):
        self.docs, self.none, self.lengths = docs, none, lengths
        sizes = np.array([len(t) // 4 for t in terms], np.int64)
        self.begin, self.size = np.cumsum(sizes) - sizes, sizes
        self.term = np.frombuffer(b"".join(terms), "<i4")
        self.value = weight[self.term] * np.frombuffer(b"".join(impacts), "<i4").astype(np.int64)
        order = np.argsort(self.term, kind="stable")
        self.row, self.cell = np.repeat(np.arange(len(docs)), sizes)[order], self.value[order]
        self.first = np.searchsorted(self.term[order], np.arange(len(weight) + 1))
        self.top = np.zeros(len(weight), np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.top[held] = np.maximum.reduceat(self.cell, self.first[held])

    def search(self, terms: np.ndarray, counts: np.ndarray, length: float, best: Best, dense: np.ndarray) -> None:
        """Adds to ``best`` what the bucket has for an item. ``dense``: zeros, one per term."""
        least = best.least()
        if not len(terms) or length * self.lengths.max() * SLACK < least:
            return
        share = counts * self.top[terms]
        order = np.argsort(share, kind="stable")
        terms, counts, share = terms[order], counts[order], share[order]
        reach = np.cumsum(share)
        split = int(np.searchsorted(reach, least, side="left"))  # the coordinates before cannot reach the score together
        if split == len(terms):
            return
        many = self.first[terms[split:] + 1] - self.first[terms[split:]]
        place = gathered(self.first[terms[split:]], many)
        part = np.bincount(self.row[place], (np.repeat(counts[split:], many) * self.cell[place]).astype(np.float64), len(self.docs))
        rest = np.minimum(float(reach[split - 1]) if split else 0.0, math.sqrt(float((counts[:split] ** 2).sum())) * self.lengths)
        touched = np.flatnonzero(part > 0)
        floor = float(least)
        if len(touched) >= best.k:  # as many documents have at least this
            floor = max(floor, float(np.partition(part[touched], len(touched) - best.k)[len(touched) - best.k]) / SLACK)
        rows = touched[(part[touched] + rest[touched]) * SLACK >= floor]
        if not len(rows):
            return
        dense[terms] = counts
        place = gathered(self.begin[rows], self.size[rows])
        exact = np.add.reduceat(dense[self.term[place]] * self.value[place], np.cumsum(self.size[rows]) - self.size[rows])
        dense[terms] = 0
        best.add(exact, self.docs[rows], self.none[rows])


FOUND = "item int, doc_id bigint, score bigint"


def _search(rows: DataFrame, items: Items, weights: np.ndarray, floors: np.ndarray, k: int) -> DataFrame:
    """Every task's k best per item among its rows: (item, doc_id, score)."""
    shared = rows.sparkSession.sparkContext.broadcast((items.terms, items.counts, items.lengths, weights, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, lengths, weight, floors = shared.value
        best, dense = [Best(k, int(f)) for f in floors], np.zeros(len(weight), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                piece = batch.slice(at, BUCKET)
                none = pc.is_null(piece.column(0)).to_numpy(zero_copy_only=False)
                bucket = Bucket(pc.fill_null(piece.column(0), 0).to_numpy(zero_copy_only=False), none, piece.column(1).to_numpy(zero_copy_only=False),
                                piece.column(2).to_pylist(), piece.column(3).to_pylist(), weight)
                for number in range(len(terms)):
                    bucket.search(terms[number], counts[number], lengths[number], best[number], dense)
        for number, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.scores), number, np.int32)), pa.array(b.docs, mask=b.none), pa.array(b.scores)],
                                                 names=["item", "doc_id", "score"])

    return rows.select("doc_id", "length", "terms", "impacts").mapInArrow(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, items: Items, k: int, doc_id: str, text: str) -> DataFrame:
    """Written table (item, rank, doc_id, score) of one block of items."""
    vectors = term_vectors(docs, items, doc_id, text)
    n_docs, n_all = vectors.where("NOT stats").agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = holders(vectors, len(items.vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    rows = by_length(vectors, weights, n_docs, n_all)
    last = (rows.agg(F.max("part")).first()[0] or 0) // 16
    first = written(_top(_search(rows.where(F.col("part") <= last), items, weights, np.ones(len(items.ids), np.int64), k), k), "search-first")
    floors = np.ones(len(items.ids), np.int64)
    for r in first.where(F.col("rank") == k).select("item", "score").collect():  # one number per item of the block
        floors[r["item"]] = r["score"]
    more = _search(rows.where(F.col("part") > last), items, weights, floors, k)
    return written(_top(first.drop("rank").unionByName(more), k), "search-block")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 4 << 20, item_id: str = "item_id", doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """item_id, rank from 1, doc_id, score: each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text IS NOT NULL").distinct() \
        .withColumn("bytes", F.octet_length("text").cast("bigint"))
    placed = written(ranked(written(asked, "items"), [F.xxhash64("text"), F.col("item_id")], "before", "items-ordered", add="bytes")
                     .select("item_id", "text", F.expr(f"before div {block_bytes}").alias("block")), "item-blocks")
    out = None
    for block in [r.block for r in placed.select("block").distinct().orderBy("block").collect()]:  # a number per ``block_bytes`` of items
        own = placed.where(F.col("block") == block).orderBy("item_id", F.xxhash64("text")).select("item_id", "text").collect()
        block_items = Items([r.item_id for r in own], [r.text for r in own])
        names = spark.createDataFrame([(n, i) for n, i in enumerate(block_items.ids)],
                                      f"item int, item_id {placed.schema['item_id'].dataType.simpleString()}")
        found = search_block(docs, block_items, k, doc_id, text).join(F.broadcast(names), "item")  # ids of one block
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {placed.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    return out.select("item_id", "rank", "doc_id", "score")
