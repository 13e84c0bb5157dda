"""Benchmark decontamination: finds short test items inside long documents by size-partitioned MinHash containment.

Items are partitioned by the size of their shingle set (powers of two). An item's signature is the bottom of its MinHash
order, as many values as its partition needs: one more than an item of that size may miss and still be contained at the
threshold. A document that contains an item therefore holds at least one signature value, whatever its own length, and
no such document is missed. Every candidate is verified by exact containment of word shingles.

Items that fit (their count of words is checked against ``most_words``) travel to the tasks, and documents are searched
and verified where they lie, with no shuffle. Beyond that size signatures and document shingles meet in a join, shingles
over every signature value of their partition being dropped first.

Edge cases: words are lower-cased (A-Z) and cut at ASCII white space; items of fewer words than a shingle are one shingle
of their own length; null, empty or blank items match nothing; null or empty texts contain nothing; repeated rows are
reported each; repeated items of one item_id count as one each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import WORD, keyed, text_or_empty, written
from veilscan.llm.simhash import shingles, words_of

#: MinHash order: the values of XXH64 with this seed.
SEED = 1


def item_shingles(text: str | None, n: int) -> tuple[int, set[bytes]]:
    """(words in a shingle, distinct shingles) of an item."""
    words = words_of(text)
    size = min(n, len(words))
    return size, set(shingles(words, size)) if words else set()


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))


def signature(parts: set[bytes], at_least: float) -> np.ndarray:
    """The smallest hashes, as many as the item's size partition needs so that containment at the threshold shares one."""
    largest = (1 << len(parts).bit_length()) - 1
    return np.sort(hashes(sorted(parts)))[:int((1 - at_least) * largest + 1e-9) + 1]


def is_contained(shared: int, size: int, at_least: float) -> bool:
    return shared >= at_least * size - 1e-9


class Index:
    """Items by signature value, for documents that are searched in place."""

    def __init__(self, items: list[tuple[int, str]], n: int, at_least: float):
        self.at_least, self.items = at_least, []
        holders: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            size, parts = item_shingles(text, n)
            if parts:
                for h in signature(parts, at_least).tolist():
                    holders.setdefault(size, {}).setdefault(h, []).append(len(self.items))
                self.items.append((item_id, size, parts))
        self.values = {size: np.array(sorted(found), np.uint64) for size, found in holders.items()}
        self.holders = holders

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shared shingles, shingles of the item) for every item the text contains."""
        words, out = words_of(text), []
        for size, values in self.values.items():
            parts = shingles(words, size) if len(words) >= size else []
            if not parts:
                continue
            h = hashes(parts)
            at = np.minimum(np.searchsorted(values, h), len(values) - 1)
            hit = set(h[values[at] == h].tolist())
            if not hit:
                continue
            held = set(parts)
            for i in sorted({i for x in hit for i in self.holders[size][x]}):
                item_id, _, wanted = self.items[i]
                shared = len(wanted & held)
                if is_contained(shared, len(wanted), self.at_least):
                    out.append((item_id, shared, len(wanted)))
        return out


FOUND = [("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())]


def _schema(docs: DataFrame, carry: list[str]):
    schema = docs.select(*carry).schema
    for name, _ in FOUND:
        schema = schema.add(name, "long")
    return schema


def _in_place(docs: DataFrame, carry: list[str], text: str, index: Index) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(index)  # at most ``most_words`` words of items
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(n)):
                hits = held.value.search(t.as_py())
                rows += [i] * len(hits)
                found += hits
            if rows:
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(j).take(own) for j in range(n)] + [pa.array(c, pa.int64()) for c in zip(*found)],
                                                 names=[*carry, *[f for f, _ in FOUND]])

    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(run, _schema(docs, carry))


def _by_join(docs: DataFrame, carry: list[str], text: str, items: DataFrame, n: int, at_least: float) -> DataFrame:
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, t in zip(*(c.to_pylist() for c in batch.columns)):
                size, parts = item_shingles(t, n)
                h = signature(parts, at_least) if parts else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(h), pa.int64()), pa.array([t] * len(h), pa.string()), pa.array([size] * len(h), pa.int32()),
                                                  pa.array(h.view(np.int64))], names=["item_id", "item", "size", "h"])

    signed = written(items.select("item_id", "text").mapInArrow(signatures, "item_id bigint, item string, size int, h bigint"), "signatures")
    # Unsigned order of the hashes: the sign bit flipped. One row per shingle size, n at most.
    tops = {r.size: r.top for r in signed.groupBy("size").agg(F.max(F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).alias("top")).collect()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, t in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(t)
                for size, top in tops.items():
                    if len(words) >= size:
                        h = np.unique(hashes(shingles(words, size)))
                        h = h[h <= np.uint64(top + (1 << 63))].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k1)), pa.array(np.full(len(h), k2)), pa.array(np.full(len(h), size, np.int32)),
                                                          pa.array(h)], names=["k1", "k2", "size", "h"])

    named = keyed(docs.select(*carry, F.col(text).alias("_text")), [*carry, "_text"]).withColumnsRenamed({"_k1": "k1", "_k2": "k2"})
    held = named.select("k1", "k2", "_text").mapInArrow(spread, "k1 bigint, k2 bigint, size int, h bigint")
    pairs = held.join(signed, ["size", "h"]).select("k1", "k2", "item_id", "item").distinct()
    texts = named.join(pairs, ["k1", "k2"]).select(*carry, "_text", "item_id", "item")
    c = len(carry)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (t, item_id, item) in enumerate(zip(*(batch.column(c + j).to_pylist() for j in range(3)))):
                size, wanted = item_shingles(item, n)
                shared = len(wanted & set(shingles(words_of(t), size)))
                if is_contained(shared, len(wanted), at_least):
                    rows.append(i)
                    found.append((item_id, shared, len(wanted)))
            if rows:
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(j).take(own) for j in range(c)] + [pa.array(x, pa.int64()) for x in zip(*found)],
                                                 names=[*carry, *[f for f, _ in FOUND]])

    return texts.mapInArrow(verify, _schema(docs, carry))


def _kept(items: DataFrame, n: int, at_least: float, most_words: int) -> tuple[DataFrame, Index | None]:
    """The items that can match, and an index of them if they are few enough to travel."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(text_or_empty().rlike(WORD)).dropDuplicates(["item_id", "text"])
    words = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    return items, Index([(r.item_id, r.text) for r in items.collect()], n, at_least) if words <= most_words else None


def contained_items(docs: DataFrame, items: DataFrame, carry: list[str] | None = None, text: str = "text", n: int = 5, at_least: float = 0.8,
                    most_words: int = 2_000_000) -> DataFrame:
    """One row per document and item it contains: ``carry`` (doc_id by default), item_id, n_shared, n_item, containment."""
    carry = carry or ["doc_id"]
    items, index = _kept(items, n, at_least, most_words)
    found = _by_join(docs, carry, text, items, n, at_least) if index is None else _in_place(docs, carry, text, index)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", n: int = 5, at_least: float = 0.8, most_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item."""
    items, index = _kept(items, n, at_least, most_words)
    if index is None:
        rows = keyed(docs, docs.columns).withColumnsRenamed({"_k1": "_r1", "_k2": "_r2"})
        found = _by_join(rows, ["_r1", "_r2"], text, items, n, at_least).select("_r1", "_r2").distinct()
        return rows.join(found, ["_r1", "_r2"], "left_anti").select(*docs.columns)
    held, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not held.value.search(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
