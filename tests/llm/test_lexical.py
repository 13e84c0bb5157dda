"""Ranked search against brute force, with ties, repeated rows, nulls, blocks of items and buckets of a few documents."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from veilscan.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    tfs = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n, total = len(tfs), sum(x for _, _, x in tfs)
    df = Counter(w for _, c, _ in tfs for w in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scored = []
        for d, c, size in tfs:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.4)) % 900}" for _ in range(2500)] + ["É", "été", "漢字", "A1"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 3, 30, 300])))) for i in range(n)]
    items = [(i, ", ".join(r.choices(vocabulary, k=r.choice([1, 5, 40])))) for i in range(25)]
    docs += [(n + i, docs[i][1] + "\n" + items[i % 25][1].upper()) for i in range(60)]
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, items[3][1]), (None, items[3][1]), (-4, None), (77, ""), (78, "!?"), (79, items[3][1] + " and" * 200_000)]
    items += [items[0], (0, "w1 w2 w1"), (90, None), (91, ""), (92, "nowhere"), (None, "w3 w5")]
    return docs, items


@pytest.mark.parametrize("bucket, block", [(8192, 4 << 20), (7, 300)])
def test_ranks_equal_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(L, "BUCKET", bucket)
    docs, items = corpus(bucket, 500)
    got = L.best_documents(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string").repartition(5),
                           spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, rank string"), block_bytes=block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_terms_follow_the_pattern():
    texts = ["", None, "a-B_c", "Été ÉTÉ", "x\x00y\x7fz", "漢字   1.5", " a", "İK"]
    names, which, ends = L.terms_of(pa.array(texts, pa.string()))
    assert [[names[i].as_py() for i in which[a:b].tolist()] for a, b in zip([0, *ends.tolist()], ends.tolist())] == [terms(t) for t in texts]


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.best_documents(none, one).count() == 0
    assert L.best_documents(one.withColumnRenamed("item_id", "doc_id"), one.limit(0)).count() == 0
