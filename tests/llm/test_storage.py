"""Archive and token files: exact round trips and brute force, with nulls, ties, repeats and empty tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import encoding as E
from veilscan.llm import token_file as T
from veilscan.llm import warc
from veilscan.llm.queries import tokenizer_file

PAGES = [(3, "http://a b/\n", "<p>x</p>", "z"), (1, None, "<p>x</p>", "z"), (None, "u", "<p>x</p>", None), (2, "u", None, "q"), (5, "u", "", "q"),
         (7, "v", "é" * 50_000, "q"), (9, "w", "once", "q"), (9, "w", "once", "q")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_sha256 string")


def test_archive_reads_back(spark):
    where = warc.write_archive(pages(spark))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, where).collect()), key=str)
    want = []
    for i, (page, _, html, _) in enumerate(PAGES):
        body = (html or "").encode()
        same = [(p is None, p or 0, k) for k, (p, _, h, _) in enumerate(PAGES) if (h or "").encode() == body]
        none, first, at = min(same)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page, len(body), digest, "response" if at == i else "revisit", None if at == i else (None if none else first)))
    assert got == sorted(want, key=str)
    payloads, records = warc.open_archive(spark, where)
    assert payloads.count() == len({(r[2] or "") for r in PAGES}) and records.count() == len(PAGES)


def test_records_are_whole(spark):
    where = warc.write_archive(pages(spark))
    for r in warc.rebuild_records(spark, where).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size:] == b"\r\n\r\n" and b" b/" not in head


def test_small_payloads_are_not_revisited(spark):
    where = warc.write_archive(pages(spark), revisit_from=8)
    assert {r.record_type for r in warc.read_archive(spark, where).where("payload_bytes < 8").collect()} == {"response"}


def test_empty_archive(spark):
    assert warc.read_archive(spark, warc.write_archive(pages(spark, []))).count() == 0


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    where = warc.write_archive(pages(spark))
    payloads, _ = warc.open_archive(spark, where)
    other = str(tmp_path / "payloads")
    payloads.selectExpr("payload_sha256", "cast('x' AS binary) AS payload").write.parquet(other)
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, warc.Archive(other, where.records)).collect()


def test_pieces_encode_as_whole_texts():
    enc = E.Encoder(tokenizer_file())
    random.seed(3)
    parts = ["a", "B", "é", " ", " ", "\n", "\t", "'s", "'", "12", "!!", "<|endoftext|>", " ", "漢", "a,", "B.!", "\0", "\r\n", "\x85", "\xa0", "ing", " the"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert enc.encode(pa.array([text]), 0)[0].tolist() == [*want, 0], repr(text)


def test_remembering_has_an_end_and_no_effect(monkeypatch):
    monkeypatch.setattr(E, "HELD", 8000)
    enc = E.Encoder(tokenizer_file())
    texts = [" ".join(f"word{i}{j}," for j in range(20)) for i in range(20)]
    for t in texts * 2:
        assert enc.encode(pa.array([t]), 0)[0].tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 0]
    assert 0 < enc.held() <= 8000


def test_remembered_pieces_give_the_same_ids():
    """Letters that go to the model alone, signs among them, and lengths about what two numbers hold; each text twice."""
    enc = E.Encoder(tokenizer_file())
    random.seed(5)
    parts = ["a", "Z", "é", "ß", "×", "÷", "Ā", "ª", "\xad", " ", " ", " ", "\n", "'s", "7", "&", "\0", "straße", "conversación", "o" * 12, "漢"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(500)]
    texts += [f" {c * n}" for c in ("b", "é", "\0") for n in range(1, 20)]
    for t in texts * 2:
        assert enc.encode(pa.array([t]), 0)[0].tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_a_slice_costs_what_its_own_pieces_cost(monkeypatch):
    """Neither is what is remembered hashed anew each slice, nor are new words of letters encoded with a splitter and offsets."""
    enc, looked_up, split = E.Encoder(tokenizer_file()), [], []
    index_in, whole = E.pc.index_in, enc.whole
    monkeypatch.setattr(E.pc, "index_in", lambda x, value_set: looked_up.append(len(value_set)) or index_in(x, value_set=value_set))
    monkeypatch.setattr(enc, "whole", lambda texts: split.extend(texts) or whole(texts))
    names = ["".join(random.choice("abcdefghij") for _ in range(8)) for _ in range(4000)]
    for k in range(0, 4000, 1000):
        enc.encode(pa.array([" " + " ".join(names[k:k + 1000])]), 0)
    assert max(looked_up) == 0 and not split


@pytest.mark.parametrize("n", [1, 2, T.LANES - 1, T.LANES, 3 * T.LANES + 7])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000)
    used, f, c = T.frequency_table({int(i): int(k) for i, k in zip(*np.unique(ids, return_counts=True))})
    assert f.sum() == 1 << T.SCALE and f.min() >= 1
    places = np.searchsorted(used, ids)
    slots = np.repeat(np.arange(len(used)), f)
    assert (T.decode_block(T.encode_block(places, f, c), n, f, c, slots) == places).all()


def test_coder_keeps_the_format():
    """Payloads equal those of the plain formula; ids may be coded by tables with gaps, as the file writer does."""
    rng = np.random.default_rng(7)
    ids = 3 * np.minimum(rng.zipf(1.2, 2 * T.LANES + 5), 9000)
    used, f, c = T.frequency_table({int(i): int(k) for i, k in zip(*np.unique(ids, return_counts=True))})
    f_of, c_of = dict(zip(used.tolist(), f.tolist())), dict(zip(used.tolist(), c.tolist()))
    x, words = [int(T.LOW)] * T.LANES, []
    for i in range(len(ids) - 1, -1, -1):
        lane, own = i % T.LANES, int(ids[i])
        if x[lane] >= f_of[own] << 63 - T.SCALE:
            words.append(x[lane] & 0xFFFFFFFF)
            x[lane] >>= 32
        x[lane] = (x[lane] // f_of[own] << T.SCALE) + x[lane] % f_of[own] + c_of[own]
    want = np.array(x, "<u8").tobytes() + np.array(words[::-1], "<u4").tobytes()
    wide = np.zeros((2, int(used.max()) + 1), np.uint64)
    wide[:, used] = f, c
    assert T.encode_block(np.searchsorted(used, ids), f, c) == T.encode_block(ids, *wide) == want


def test_rare_ids_keep_a_frequency():
    _, f, _ = T.frequency_table({0: 10 ** 12} | {i: 1 for i in range(1, 5000)})
    assert f.sum() == 1 << T.SCALE and f.min() == 1


def test_crc_of_joined_strings():
    a, b = b"one" * 33, b"other" * 77
    assert T.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files(spark, monkeypatch):
    texts = [(4, "two words", 1), (2, None, 1), (None, "no id", 1), (9, "", 1), (9, "x " * 3000, 1), (4, "two words", 1), (1, "<|endoftext|> \n\n é", 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, ids long").repartition(3)
    tokenizer = E.Encoder(tokenizer_file()).tokenizer
    where = T.write_files(docs, tokenizer_file())
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.file_index(spark, where).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [1, 2, 4, 4, 9, 9, None]
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _ in texts}
    at = 0
    for doc, start, n, crc in got:
        own = [v for v in (ids[t] for i, t, _ in texts if i == doc) if (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) == (n, crc)]
        assert own and start == at
        at += n
    held = {(r.doc_id, r.start): r.ids for r in T.read_ids(spark, where).collect()}
    assert all(zlib.crc32(np.array(held[d, s], "<u4").tobytes()) == c for d, s, _, c in got)


def test_a_document_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 1 << 18)
    text = "a b " * 180_000
    docs = spark.createDataFrame([(1, "short"), (2, text), (3, "end")], "doc_id long, text string")
    tokenizer = E.Encoder(tokenizer_file()).tokenizer
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
    assert len(want) > T.BLOCK
    got = {r.doc_id: r for r in T.file_index(spark, T.write_files(docs, tokenizer_file())).collect()}
    assert (got[2].n_tokens, got[2].ids_crc32) == (len(want), zlib.crc32(want.tobytes()))
    assert got[3].start == got[2].start + got[2].n_tokens


def test_empty_token_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.file_index(spark, T.write_files(docs, tokenizer_file())).count() == 0
