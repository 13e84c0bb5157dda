"""Encoding by pieces and packing: equal ids, gapless sequences, cuts as cheap as an exhaustive search finds."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import packing as P
from veilscan.llm.encoding import encoder, slices
from veilscan.llm.queries import tokenizer_file

BITS = [" ", " ", "\n", "\t", "a", "bc", "1", ".", " ", "é", "“", "　", "日", "<|endoftext|>", "\x1c", "'s", " ", "\r", "\u0085", "😀", ")", "A."]


def plain(texts, end=0):
    return [x.ids + [end] for x in encoder(tokenizer_file()).tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts():
    enc, r = encoder(tokenizer_file()), random.Random(1)
    for case in [[], [""], [None, "", "<|endoftext|>", "", None]] + [["".join(r.choices(BITS, k=r.randrange(14))) for _ in range(r.randrange(6))] for _ in range(800)]:
        ids, n = enc.encode(pa.array(case, pa.string()), 0)
        want = plain(case)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 50, "", "c"])], names=["t"])
    got = [s.column(0).to_pylist() for s in slices(batch, 0, 8)]
    assert got == [["aaaaa", None], ["b" * 50, "", "c"]] or [t for s in got for t in s] == batch.column(0).to_pylist()
    assert all(len(s) == 1 or sum(len(t or "") for t in s) <= 8 for s in got)


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_the_cheapest(seed):
    r, length = random.Random(seed), 16
    places = np.cumsum([r.randrange(1, 9) for _ in range(14)])
    cost = np.array([r.choice([0, 1, 3]) for _ in places])
    total = {0: 0}
    for j, c in zip(places.tolist(), cost.tolist()):
        total[j] = min(total[i] + (0 if (j - i) & (j - i - 1) == 0 else length - (j - i)) + c for i in total if j - i <= length)
    cuts = P.best_cuts(places, cost, length).tolist()
    spent, price = 0, dict(zip(places.tolist(), cost.tolist()))
    for i, j in zip([0, *cuts], cuts):
        assert 0 < j - i <= length
        spent += (0 if (j - i) & (j - i - 1) == 0 else length - (j - i)) + price[j]
    assert cuts[-1] == places[-1] and spent == total[int(places[-1])]


def test_packing_holds_each_id_once(spark):
    r = random.Random(2)
    words = ["Rain falls.", "word", "longer", "It ended!", "\n", "x" * 300]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 30, 300]))), "clash") for i in range(60)]
    rows += [(7, None, "a"), (7, None, "a"), (None, "no id", None), (99, "one. " * 400_000, "long"), (100, "z" * 9000, "no sentence")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    pieces = P.pack(docs, tokenizer_file()).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        assert p.length * 4 == len(p.ids) and p.length > 0
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append((p.start, bytes(p.ids), p.doc_tokens))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    for (doc, text, _), want in zip(rows, plain([t for _, t, _ in rows])):
        parts = sorted(by_doc[doc])
        if doc != 7:
            assert b"".join(b for _, b, _ in parts) == np.array(want, "<u4").tobytes()
            assert [s for s, _, _ in parts] == np.cumsum([0] + [len(b) // 4 for _, b, _ in parts])[:-1].tolist()
            assert {n for _, _, n in parts} == {len(want)}
    assert sum(p.length for p in pieces) == sum(map(len, plain([t for _, t, _ in rows])))
    full = sum(n if n & (n - 1) == 0 else 1024 for n in (sum(k for _, k in s) for s in by_sequence.values()))
    assert full <= 1.02 * sum(p.length for p in pieces)


def test_packing_an_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file()).count() == 0


def test_checksums_are_native(spark):
    row = P.pack(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), tokenizer_file()).selectExpr("crc32(ids) AS c", "ids").first()
    assert row.c == zlib.crc32(bytes(row.ids))


def test_encoding_holds_little_beside_the_texts():
    """A worker's helper arrays do not grow with a slice in 8-byte numbers: they once took some twenty times the text."""
    import tracemalloc

    r = random.Random(3)
    some = [" ".join(r.choice(["the", "of", "data", "Über", "x1,", "stop."]) for _ in range(4000)) for _ in range(600)]
    enc, texts = encoder(tokenizer_file()), pa.array(some, pa.string())
    enc.encode(texts, 0)
    tracemalloc.start()
    ids, n = enc.encode(texts, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == plain(some)
    assert peak < 14 * texts.nbytes
