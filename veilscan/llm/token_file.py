"""Token-ID files coded by a static range asymmetric numeral system (rANS).

A file set is a folder with two tables. ``frequencies`` holds, for each id in use, its frequency out of 2**SCALE and the sum
of those before it: one table shared by all blocks. ``blocks`` holds independent blocks in order: shard, block number,
place of its first id in the shard, number of ids, CRC-32 of the ids, the checkpoints (each document's id, first place
in the shard, number of ids here, which part of the document it is) and the payload. A payload is, little-endian: LANES
(or, for fewer ids, as many) unsigned 64-bit states, then unsigned 32-bit words in reading order. Id i of a block belongs
to lane i mod LANES; lanes take their words in lane order, step by step. Any block is decoded alone, from the shared table.

Edge cases: a null or empty text has no ids but the end id; a null doc_id orders last; documents with one doc_id are
ordered by a hash of their text; a document longer than a block is cut over several, and its CRC is composed from theirs;
an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.llm.common import new_path, text_or_empty, written
from veilscan.llm.encoding import encoder, slices

#: log2 of the frequencies' sum; interleaved coders in a block; ids in a block at most.
SCALE, LANES, BLOCK = 20, 1024, 1 << 18
LOW = np.uint64(1 << 31)


def tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table: one row per document (doc_id, h, n, ids compressed), and one of id counts per task (counts true)."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(tokenizer), zstandard.ZstdCompressor(level=3)
        seen = np.zeros(max(enc.size, end_id + 1), np.int64)
        names = ["doc_id", "h", "n", "ids", "counts"]
        for batch in batches:
            for piece in slices(batch, 2):
                ids, n = enc.encode(piece.column(2), end_id)
                seen += np.bincount(ids, minlength=len(seen))
                ends = np.cumsum(n)
                packed = [pack.compress(ids[a:b].tobytes()) for a, b in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(n, pa.int64()), pa.array(packed, pa.binary()),
                                                  pa.array([False] * len(n))], names=names)
        used = np.nonzero(seen)[0]
        if len(used):
            packed = np.stack([used, seen[used]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([len(used)], pa.int64()),
                                              pa.array([packed], pa.binary()), pa.array([True])], names=names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("h"), text_or_empty(text).alias("text"))
    return written(rows.mapInArrow(run, "doc_id bigint, h bigint, n bigint, ids binary, counts boolean"), "tokens")


def frequency_table(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, frequency, sum of the frequencies before): at least 1 for every id in use, 2**SCALE in all, largest first to
    give what rounding leaves."""
    ids = np.array(sorted(counts), np.int64)
    n = np.array([counts[i] for i in ids.tolist()], np.float64)
    if not len(ids):
        return ids, ids.copy(), ids.copy()
    if len(ids) > 1 << SCALE:
        raise ValueError("more ids in use than the frequency scale can hold")
    f = np.maximum(1, np.floor(n / n.sum() * (1 << SCALE))).astype(np.int64)
    left = (1 << SCALE) - int(f.sum())
    for i in np.argsort(-n, kind="stable"):
        step = left if left > 0 else max(left, 1 - int(f[i]))
        f[i] += step
        left -= step
        if not left:
            break
    return ids, f, np.cumsum(f) - f


def count_ids(token_rows: DataFrame) -> dict[int, int]:
    """How often each id occurs: summed by Spark; the result has a row per id of the vocabulary at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                ids, n = np.frombuffer(packed, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    rows = token_rows.where("counts").select("ids").mapInArrow(run, "id bigint, n bigint")
    return {r.id: r.n for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def encode_block(places: np.ndarray, f: np.ndarray, c: np.ndarray) -> bytes:
    """Codes positions in the frequency table; lanes step together, last step first."""
    lanes = min(LANES, len(places))
    x, quotient, words = np.full(lanes, LOW, np.uint64), np.zeros(lanes, np.uint64), []
    f, c = f.astype(np.uint64)[places], c.astype(np.uint64)[places]
    # x becomes (x // f << SCALE) + x % f + c, that is x + x // f * ((1 << SCALE) - f) + c.
    most, spread = f << np.uint64(63 - SCALE), np.uint64(1 << SCALE) - f
    for at in range((len(places) - 1) // lanes * lanes, -1, -lanes):
        fs = f[at:at + lanes]
        own, q = x[:len(fs)], quotient[:len(fs)]
        full = np.flatnonzero(own >= most[at:at + lanes])
        out = own[full]
        words.append(out.astype("<u4"))
        own[full] = out >> np.uint64(32)
        np.floor_divide(own, fs, out=q)
        q *= spread[at:at + lanes]
        own += q
        own += c[at:at + lanes]
    return x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(payload: bytes, n: int, f: np.ndarray, c: np.ndarray, slots: np.ndarray) -> np.ndarray:
    lanes = min(LANES, n)
    x = np.frombuffer(payload, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(payload, "<u4", offset=8 * lanes).astype(np.uint64)
    out, held, low = np.zeros(n, slots.dtype), np.zeros(lanes, np.uint64), np.uint64((1 << SCALE) - 1)
    f, c, at = f.astype(np.uint64), c.astype(np.uint64), 0
    for i in range(0, n, lanes):
        place = out[i:i + lanes]
        own, slot = x[:len(place)], held[:len(place)]
        np.bitwise_and(own, low, out=slot)
        slots.take(slot.view(np.int64), out=place, mode="clip")  # a slot is below 1 << SCALE
        own >>= np.uint64(SCALE)
        own *= f.take(place)
        own += slot
        own -= c.take(place)
        need = np.flatnonzero(own < LOW)
        own[need] = (own[need] << np.uint64(32)) | words[at:at + len(need)]
        at += len(need)
    if at != len(words):
        raise ValueError("a block's payload has words left over")
    return out


BLOCKS = ("shard int, block int, first bigint, n bigint, crc bigint, doc_ids array<bigint>, starts array<bigint>, counts array<bigint>, "
          "parts array<int>, payload binary")


@dataclass(frozen=True)
class FileSet:
    frequencies: str
    blocks: str


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> FileSet:
    """Tokenizes once into a table with counts, then range-sorts that by doc_id and codes each sorted part as it comes."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    where = FileSet(f"{folder}/frequencies", f"{folder}/blocks")
    rows = tokens(docs, tokenizer, end_id, doc_id, text)
    counts = count_ids(rows)
    ids, f, c = frequency_table(counts)
    spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "frequency": pa.array(f, pa.int64()), "below": pa.array(c, pa.int64())}).to_pandas(),
                          "id bigint, frequency bigint, below bigint").coalesce(1).write.parquet(where.frequencies)
    # Bounded by the vocabulary: at most one number per id.
    shared = spark.sparkContext.broadcast((ids, f, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, kind = zstandard.ZstdDecompressor(), encoder(tokenizer).kind
        ids, f, c = shared.value
        f_of, c_of = np.zeros((2, int(ids.max(initial=0)) + 1), np.uint64)  # by id; those not in use have frequency 0
        f_of[ids], c_of[ids] = f, c
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held, marks, size = [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal held, marks, size, number, first
            own = np.concatenate(held)
            doc_ids, starts, counts, parts = zip(*marks)
            values = [shard, number, first, size, zlib.crc32(own.astype("<u4").tobytes()), doc_ids, starts, counts, parts, encode_block(own, f_of, c_of)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.list_(pa.int32()), pa.binary()]
            number, first = number + 1, first + size
            held, marks, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(unpack.decompress(packed.as_py()), kind)
                if size and size + len(own) > BLOCK:
                    yield block()
                for part, at in enumerate(range(0, len(own), BLOCK)):
                    piece = own[at:at + BLOCK]
                    if size + len(piece) > BLOCK:
                        yield block()
                    held.append(piece)
                    marks.append((doc, first + size, len(piece), part if len(own) > BLOCK else -1))
                    size += len(piece)
        if size:
            yield block()

    ordered = rows.where("NOT counts").sort(F.col("doc_id").asc_nulls_last(), "h").select("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(where.blocks)
    return where


def crc_join(one: int, two: int, n_two: int) -> int:
    """CRC-32 of two joined byte strings from theirs: the first's register is moved over n_two zero bytes."""
    def apply(rows: list[int], v: int) -> int:
        out = 0
        for r in rows:
            if v & 1:
                out ^= r
            v >>= 1
        return out

    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        step = [apply(step, r) for r in step]
    while n_two:
        if n_two & 1:
            one = apply(step, one)
        step = [apply(step, r) for r in step]
        n_two >>= 1
    return one ^ two


def open_files(spark: SparkSession, where: FileSet) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema("id bigint, frequency bigint, below bigint").parquet(where.frequencies), spark.read.schema(BLOCKS).parquet(where.blocks))


def decode(spark: SparkSession, where: FileSet, what: str, fields: dict[str, pa.DataType], each) -> DataFrame:
    """Decodes every block alone and hands (block's row, ids) to ``each``, which returns columns. A CRC that differs fails the job."""
    frequencies, blocks = open_files(spark, where)
    table = frequencies.orderBy("id").toPandas()  # at most one row per id of the vocabulary
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy(np.int64) for c in ("id", "frequency", "below")))
    sizes = blocks.groupBy("shard").agg(F.sum("n").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    offsets = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, f, c = shared.value
        slots = np.repeat(np.arange(len(ids), dtype=np.int32), f)
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                found = ids[decode_block(r["payload"], r["n"], f, c, slots)].astype("<u4")
                if zlib.crc32(found.tobytes()) != r["crc"]:
                    raise ValueError(f"block {r['block']} of shard {r['shard']} does not match its checksum")
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(each(r, found), fields.values())], names=list(fields))

    return blocks.join(F.broadcast(offsets), "shard").mapInArrow(run, what)  # a row per shard: as many as the sort had partitions


def read_ids(spark: SparkSession, where: FileSet) -> DataFrame:
    """doc_id, start, part and ids (unsigned values as longs): a row per document, or per block of a document longer than one."""
    def each(r: dict, ids: np.ndarray) -> list:
        at = np.array(r["starts"]) - r["first"]
        return [r["doc_ids"], [s + r["offset"] for s in r["starts"]], r["parts"], [ids[a:a + n].astype(np.int64).tolist() for a, n in zip(at, r["counts"])]]

    return decode(spark, where, "doc_id bigint, start bigint, part int, ids array<bigint>",
                  {"doc_id": pa.int64(), "start": pa.int64(), "part": pa.int32(), "ids": pa.list_(pa.int64())}, each)


def file_index(spark: SparkSession, where: FileSet) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, all from the decoded blocks."""
    def each(r: dict, ids: np.ndarray) -> list:
        at = (np.array(r["starts"]) - r["first"]).tolist()
        return [r["doc_ids"], [s + r["offset"] for s in r["starts"]], r["parts"], r["counts"], [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(at, r["counts"])]]

    parts = decode(spark, where, "doc_id bigint, start bigint, part int, n_tokens bigint, ids_crc32 bigint",
                   {"doc_id": pa.int64(), "start": pa.int64(), "part": pa.int32(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}, each)
    parts = written(parts, "token-index")
    cut = parts.where("part >= 0").withColumn("whole", F.col("start") - F.col("part") * BLOCK).groupBy("doc_id", "whole") \
        .agg(F.sort_array(F.collect_list(F.struct("part", "n_tokens", "ids_crc32"))).alias("p"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, start, p in zip(*(x.to_pylist() for x in batch.columns)):
                n, crc = 0, 0
                for x in p:
                    n, crc = n + x["n_tokens"], crc_join(crc, x["ids_crc32"], 4 * x["n_tokens"])
                rows.append((doc, start, n, crc))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.where("part < 0").drop("part").unionByName(cut.mapInArrow(joined, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
