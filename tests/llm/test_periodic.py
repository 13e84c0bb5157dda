"""Runs of repeated words against brute force, the query against the contract word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from veilscan.llm import periodic as P
from veilscan.llm import queries as Q


def brute(words):
    """(start, length, period) of all runs: each period is tried at each word."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made(r):
    def some(letters, n):
        return [r.randrange(letters) for _ in range(n)]

    if r.random() < 0.3:
        return some(r.choice([1, 2, 3, 50]), r.randrange(200))
    out = some(r.choice([2, 4, 100]), r.randrange(30))
    for _ in range(r.randrange(1, 5)):
        unit = some(r.choice([1, 2, 3, 200]), r.randrange(1, 40))
        if r.random() < 0.4:
            unit = unit + unit + some(3, r.randrange(3))
        out += (unit * r.randrange(2, 9))[:-r.randrange(1, len(unit) + 1)] + some(r.choice([2, 100]), r.randrange(6))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(25):
        texts = [made(r) for _ in range(r.randrange(1, 10))]
        texts += texts[:r.randrange(3)]
        ids, ends = np.array([w for t in texts for w in t], np.int64), np.cumsum([len(t) for t in texts])
        begin, end, period = P.runs(ids, ends, 200, gain=r.choice([0.0, 0.01, 1.0]))
        got = [[] for _ in texts]
        for k, b, e, q in zip(np.searchsorted(ends, begin, side="right").tolist(), begin.tolist(), end.tolist(), period.tolist()):
            got[k].append((b - int(ends[k]) + len(texts[k]), e - b, q))
        assert got == [brute(t) for t in texts]


def test_a_hash_that_lies_changes_nothing(monkeypatch):
    monkeypatch.setattr(P.Texts, "hashes", lambda self, at, size: (self.sums[at + size] - self.sums[at]) * self.back[at] >> np.uint64(60))
    r = random.Random(5)
    texts = [made(r) for _ in range(30)]
    ids, ends = np.array([w for t in texts for w in t], np.int64), np.cumsum([len(t) for t in texts])
    begin, end, period = P.runs(ids, ends, 200)
    stretches = set(zip(begin.tolist(), end.tolist(), period.tolist()))
    for b, e, q in stretches:
        assert (ids[b:e - q] == ids[b + q:e]).all() and e - b >= max(6, 4 * q)


def test_the_grammar_derives_the_texts():
    ids = np.array([1, 2, 1, 2, 3, 1, 2, 1, 2, 3, 3, 3, 3, 3] * 4, np.int64)
    g = P.Grammar(ids, np.array([14, 14, 28, 56]), 4, 0.0)
    for symbol, place in zip(g.symbols.tolist(), g.places.tolist()):
        first, size = int(g.first[symbol]), int(g.stop[symbol] - g.first[symbol])
        assert (ids[place:place + size] == ids[first:first + size]).all() and first < g.middle[symbol] < g.stop[symbol]
    assert len(g.left) < 30 and (np.bincount(g.symbols) > 1).all()


def test_a_long_run_in_linear_time():
    ids = np.tile(np.arange(7), 100_000)
    begin, end, period = P.runs(ids, np.array([len(ids)]), 7)
    assert (begin.tolist(), end.tolist(), period.tolist()) == ([0], [700_000], [7])


def test_words_are_those_of_the_pattern():
    texts = ["", None, " ", "a", " a  b\n", "\x0bé\x0c漢 \xa0x y", "a\r\nb a", "\x1c \x00"]
    names, ids, ends = P.words_of(pa.array(texts, pa.string()))
    got = [[names[i].as_py() for i in ids[b:e].tolist()] for b, e in zip([0, *ends.tolist()], ends.tolist())]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest())


def test_the_query_follows_the_contract(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(str(w) for w in made(r)) if i % 7 else r.choice(["", "\n", "one", "a a a a a a"])) for i in range(150)]
    rows += [(3, None), (None, "b b b b b b b"), (4, rows[4][1]), (4, rows[4][1]), (200, "long " * 300_000 + "end")]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(x) for x in Q.op12_runs(spark, str(tmp_path)).collect() if x.doc_id != 200), key=str)
    assert got == sorted((expected(i, t) for i, t in rows if i != 200), key=str)
    long = P.collapse_runs(spark.createDataFrame(rows[-1:], "doc_id long, text string")).first()
    assert [tuple(x) for x in long.runs] == [(0, 300_000, 1)] and long.collapsed == "long end"


def test_no_rows(spark):
    assert P.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
