"""Order-preserving packing of documents into training sequences of at most ``length`` tokens.

Documents are laid end to end in ascending doc_id. Windows of that stream are sequences. A window that ends inside a
document pays a penalty: ``sentence`` where a sentence ends, ``hard`` elsewhere, which is allowed only every ``stretch``
tokens of a sentence longer than that. A window pays its padding too: up to ``length``, or nothing where its size is a power of
two. The cheapest cuts follow from dynamic programming over the places where a window may end: the best window that is padded
comes off a monotone queue over the last ``length`` tokens, and the windows of a power of two are looked up.

Every range of doc_ids (a partition of one sort) is packed by one task, a horizon of HORIZON tokens after the other: all
windows but the last few of a horizon are given out and the rest is decided with the next, so a task holds a horizon or one document.

Edge cases: a null or empty text is its end id alone; a null doc_id orders last; rows with one doc_id are documents of their own,
ordered by a hash of their text; a text of any length is cut over as many sequences as it needs; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.encoding import Encoder, encoder
from veilscan.llm.token_file import tokens

HORIZON = 1 << 18
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def sentence_marks(enc: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Per id: does a sentence end with it if a blank follows, and does it begin with a blank."""
    shown = [n.replace("Ġ", " ").replace("Ċ", "\n") for n in enc.names]  # how byte-level vocabularies write both
    closing = np.array([n.rstrip("\"')]").endswith((".", "!", "?", "\n")) for n in shown], bool)
    blank = np.array([n[:1] in (" ", "\n") for n in shown], bool)
    return closing, blank


def boundaries(ids: np.ndarray, ends: np.ndarray, marks: tuple[np.ndarray, np.ndarray], sentence: int, hard: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """(places where a window may end, ascending; the penalty of each). ``ends`` are the documents' ends."""
    closing, blank = marks
    inner = np.flatnonzero(closing[ids[:-1]] & blank[ids[1:]]) + 1
    places = np.union1d(inner, ends)
    before = np.concatenate([[0], places[:-1]])
    more = (places - before - 1) // stretch  # in a long sentence, every ``stretch`` tokens from its begin
    steps = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
    cut = np.repeat(before, more) + (steps + 1) * stretch
    every = np.concatenate([places, cut])
    cost = np.concatenate([np.where(np.isin(places, ends), 0, sentence), np.full(len(cut), hard)])
    order = np.argsort(every, kind="stable")
    return every[order], cost[order]


def best_cuts(places: np.ndarray, cost: np.ndarray, length: int) -> np.ndarray:
    """The ends of the cheapest windows that cover 0 to the last place, each at most ``length`` long."""
    at = np.concatenate([[0], places])
    index = np.full(int(at[-1]) + 1, -1, np.int32)
    index[at] = np.arange(len(at))
    froms, tos = [], []
    size = 1
    while size <= length:
        to = np.flatnonzero(at >= size)
        back = index[at[to] - size]
        froms.append(back[back >= 0])
        tos.append(to[back >= 0])
        size *= 2
    froms, tos = np.concatenate(froms), np.concatenate(tos)
    order = np.argsort(tos, kind="stable")
    exact = froms[order].tolist()
    first = np.searchsorted(tos[order], np.arange(len(at) + 1)).tolist()
    at, penalty = at.tolist(), [0, *cost.tolist()]
    total, came = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (total + place, number), totals ascending, places ascending
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - length:
            queue.popleft()
        best, source = queue[0]
        best += length - here
        for k in exact[first[j]:first[j + 1]]:
            if total[k] < best:
                best, source = total[k], k
        best += penalty[j]
        total[j], came[j] = best, source
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return np.array(cuts[::-1], np.int64)


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, sentence: int = 8, hard: int = 64, stretch: int = 128,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, doc_tokens, sequence_id, offset in the sequence, ids
    (unsigned 32-bit, little-endian). Sequences of one range of doc_ids are numbered on; pieces of a sequence lie gapless from 0."""
    if length < 1 or stretch > length:
        raise ValueError("stretch must not exceed length")
    rows = tokens(docs, tokenizer, end_id, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, unpack = encoder(tokenizer), zstandard.ZstdDecompressor()
        marks = sentence_marks(enc)
        number = TaskContext.get().partitionId() << 33
        held: list[np.ndarray] = []  # what is not given out yet of each document
        about: list[tuple[int | None, int, int]] = []  # its doc_id, ids given out, ids in all
        size = 0

        def horizon(last: bool) -> pa.RecordBatch:
            nonlocal held, about, size, number
            ids = np.concatenate(held)
            ends = np.cumsum([len(h) for h in held])
            cuts = best_cuts(*boundaries(ids, ends, marks, sentence, hard, stretch), length)
            if not last:
                cuts = cuts[:np.searchsorted(cuts, size - 4 * length, side="right")]
            stop = int(cuts[-1])
            parts = np.union1d(cuts, ends[ends < stop])
            begins = np.concatenate([[0], parts[:-1]])
            doc = np.searchsorted(ends, begins, side="right")
            given = np.array([a[1] for a in about], np.int64)
            window = np.searchsorted(cuts, begins, side="right")
            window_begin = np.concatenate([[0], cuts])[window]
            body = pa.py_buffer(ids[:stop].astype("<u4"))
            offsets = pa.py_buffer(np.concatenate([[0], parts * 4]).astype(np.int32))
            out = [pa.array([about[d][0] for d in doc.tolist()], pa.int64()), pa.array(begins - (ends - np.diff(ends, prepend=0) - given)[doc]),
                   pa.array(parts - begins), pa.array([about[d][2] for d in doc.tolist()], pa.int64()), pa.array(window + number),
                   pa.array(begins - window_begin), pa.Array.from_buffers(pa.binary(), len(parts), [None, offsets, body])]
            number += len(cuts)
            keep = int(np.searchsorted(ends, stop, side="right"))
            cut = stop - (int(ends[keep - 1]) if keep else 0)  # what the first document left has given out here
            held, about, size = held[keep:], about[keep:], size - stop
            if cut and held:
                held[0], about[0] = held[0][cut:], (about[0][0], about[0][1] + cut, about[0][2])
            return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(unpack.decompress(packed.as_py()), enc.kind)
                held.append(own)
                about.append((doc, 0, len(own)))
                size += len(own)
                if size >= max(HORIZON, 16 * length):
                    yield horizon(False)
        if size:
            yield horizon(True)

    ordered = rows.where("NOT counts").sort(F.col("doc_id").asc_nulls_last(), "h").select("doc_id", "ids")
    return ordered.mapInArrow(run, PIECES)
