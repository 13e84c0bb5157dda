"""Suffix deduplication, containment, top-k and SimHash against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from veilscan.llm import decontam, simhash, topk
from veilscan.llm import suffix_dedup as S


def repeated(texts: list[bytes], length: int) -> list[bytearray]:
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        marks = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                marks[i:i + length] = b"\1" * length
        out.append(marks)
    return out


def hard_texts(length: int) -> list:
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, tail = word(2 * length), word(length)
    texts = [word(20) + passage + word(9), word(31) + passage[:length + 3] + word(5), passage[7:], "a" * (3 * length), word(3) + "ab" * length + word(2),
             passage[:length - 1], tail + "x" + tail, "", None, "short", tail, tail]
    base = word(12 * length)
    texts += [base] + [base[:p] + word(4) + base[p + 4:] for p in rng.sample(range(10 * length), 12)]
    return texts + [base, " "] + [word(5) + passage + word(5) for _ in range(30)]


@pytest.mark.parametrize("length", [60, 200])
def test_suffix_dedup(spark, length, monkeypatch):
    monkeypatch.setattr(S, "RANGE_BYTES", 4000)
    texts = hard_texts(length)
    docs = spark.createDataFrame([(i % 40, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, place long").repartition(4)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(docs, length).collect())
    data = [(t or "").encode() for t in texts]
    want = Counter()
    for i, (t, marks) in enumerate(zip(data, repeated(data, length))):
        kept = bytes(x for x, m in zip(t, marks) if not m)
        runs = sum(1 for k in range(len(marks)) if marks[k] and not (k and marks[k - 1]))
        want[i % 40, len(t), len(t) - len(kept), runs, kept] += 1
    assert got == want


def test_suffix_dedup_of_texts_longer_than_a_stretch(spark):
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh") for _ in range(1_300_000))
    docs = spark.createDataFrame([(1, body), (2, "y" * 50 + body[524_200:524_600] + "z" * 50)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(docs).collect()}
    assert got == {1: 400, 2: 400}


def test_suffix_dedup_of_nothing(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    runs, every = [], []
    for _ in range(5):
        own = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30)))
        every += own
        runs.append((own, [S.common(own[i - 1], x, 0) if i else 0 for i, x in enumerate(own)]))
    order, lcps = S.merge(runs)
    merged = [runs[r][0][i] for r, i in order]
    assert merged == sorted(every)
    assert lcps == [S.common(merged[i - 1], x, 0) if i else 0 for i, x in enumerate(merged)]


def test_containment_finds_all(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 4, 5, 6, 20, 33, 60])] + [(50, None), (51, " \t "), (52, "")]
    texts = []
    for i, t in items[:8]:
        words = t.upper().split()
        texts.append(" ".join([word() for _ in range(300)] + words + [word() for _ in range(9)]))
        words[len(words) // 2] = "other"
        texts.append(" ".join([word(), *words, word()]))
        texts.append(" ".join([word(), *t.split()[:int(len(words) * 0.9)], word()]))
    texts += [None, "", " ", texts[0], "\n".join(items[5][1].split())]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def shingle_set(t, n):
        w = (t or "").lower().split()
        return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}

    want = set()
    for i, t in items:
        n = min(5, len((t or "").split()))
        own = shingle_set(t, n) if n else set()
        for d, text in enumerate(texts):
            if own and len(own & shingle_set(text, n)) >= 0.8 * len(own) - 1e-9:
                want.add((d, i, len(own & shingle_set(text, n)), len(own)))
    for most in (2_000_000, 0):
        got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.contained_items(docs, bench, most_words=most).collect()}
        assert got == want
        kept = {r.doc_id for r in decontam.drop_contaminated(docs, bench, most_words=most).collect()}
        assert kept == set(range(len(texts))) - {d for d, *_ in want}
    assert decontam.contained_items(docs.limit(0), bench).count() == decontam.contained_items(docs, bench.limit(0)).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = np.random.default_rng(0)
    rows = [(int(i) - 300, [float(x) for x in rng.normal(size=6).astype(np.float32)], "s") for i in range(700)]
    rows += [(5, None, "s"), (6, [1.0, None, 1.0, 1.0, 1.0, 1.0], "s"), (700, [float("nan")] * 6, "s"), (800, [float("inf")] * 6, "s"), (None, rows[3][1], "s"), rows[300], rows[300],
             (900, [1e17] * 6, "s"), (1000, [2.0, 3.0], "s"), (1001, [1.0, 1.0], "s"), (1100, [], "s"), (1101, [], "s")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    vectors = topk.whole_vectors(table)
    from pyspark.sql import functions as F
    got = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False))).collect()), key=str)
    top = 2 ** 63 - 1
    whole = [(i, [max(-top - 1, min(top, int(np.floor(1024 * x)))) for x in v]) for i, v, _ in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(whole):
        if i is None or i % 100:
            continue
        scored = sorted((-max(-top - 1, min(top, sum(x * y for x, y in zip(q, v)))), (j is None, j or 0), b, j) for b, (j, v) in enumerate(whole) if a != b and len(v) == len(q))
        want += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(scored[:10])]
    assert got == sorted(want, key=str)
    assert topk.top_k(topk.whole_vectors(table.limit(0)), F.lit(True)).count() == 0


def simple_print(text: str | None, n: int, seed: int) -> int:
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p, seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, links):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "STRIP", 8)
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(700)]
    texts = [None, "", " \n", "One two", "one TWO"] + [" ".join(base[:i] + ["z"] + base[i + 1:]) for i in range(0, 700, 7)] + [" ".join(rng.choices("abc", k=5)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, f0 long")
    prints = [simple_print(t, 3, 42) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(range(len(texts)), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (format(prints[i], "016x"), want[i]) for i in range(len(texts))}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_tiles_miss_no_link(spark):
    rng = np.random.default_rng(3)
    f = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64)
    f = np.unique(np.concatenate([f, f[:500] ^ np.uint64(1 << 63), f[:400] ^ np.uint64(0x8001), np.uint64([0, 1, 3, 2 ** 64 - 1, 2 ** 64 - 4])]))
    points = spark.createDataFrame([(int(i), int(np.int64(np.uint64(x)))) for i, x in enumerate(f)], "id long, f0 long")
    near = np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= 2, 1))
    edges = [(r.a, r.b) for r in simhash.link(points, 2).collect()]
    assert roots(range(len(f)), edges) == roots(range(len(f)), near.tolist())


def test_near_copies_keep_one(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, n = [], 0
    for size in (3, 7, 60, 200, 900):
        for _ in range(4):
            own = [word() for _ in range(size)]
            for k in range(4):
                changed = list(own)
                for p in rng.sample(range(size), min(size // 80, k)):
                    changed[p] = word()
                rows.append((n, " ".join(changed), "en"))
                n += 1
    rows += [(None, rows[0][1], "x"), rows[5], rows[5], (n, None, "y"), (n + 1, "", "y"), (n + 2, rows[9][1].upper(), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    place = {i: k for k, i in enumerate(order)}
    links = [(place[a], place[b]) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = sorted(str(rows[order[k]][0]) for k, r in roots(range(len(rows)), links).items() if r == k)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_near_copies_of_a_template_meet(spark):
    """Texts of one template look alike to the fingerprints; only the two of a pair share 0.8 of their shingles."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    template, rows = [word() for _ in range(700)], []
    for _ in range(40):
        own = [word() for _ in range(60)]
        for _ in range(2):
            rows.append((len(rows), " ".join(template + own + [word() for _ in range(82)])))
    sets = [set(simhash.shingles(simhash.words_of(t), 5)) for _, t in rows]
    close = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sorted(close) == [(2 * k + 1, 2 * k) for k in range(40)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 80, 2))


def test_groups_over_many_blocks_keep_one(spark, monkeypatch):
    """Near copies of one text in chains, and texts of a template just under the threshold, in blocks of 8."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "LISTED", 8)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    own, template, texts = [word() for _ in range(120)], [word() for _ in range(200)], []
    for k in range(60):
        texts.append(" ".join(own))
        own[(7 * k) % 120] = word()
    texts += [" ".join(template + [word() for _ in range(rng.choice((20, 24, 30)))]) for _ in range(60)]
    rng.shuffle(texts)
    sets = [set(simhash.shingles(simhash.words_of(t), 5)) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = sorted(i for i, r in roots(range(len(texts)), links).items() if i == r)
    kept = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == want


@pytest.mark.parametrize("thin", [False, True])
def test_bits_rule_no_near_set_out(thin):
    rng = np.random.default_rng(5)
    base = rng.integers(-2 ** 62, 2 ** 62, 400)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(300, 400), replace=False), rng.integers(-2 ** 62, 2 ** 62, rng.integers(0, 60))])) for _ in range(300)]
    sets.sort(key=len)
    bits = np.frombuffer(b"".join(map(simhash.parities, sets)), np.uint64).reshape(len(sets), -1)
    ids, parts = np.arange(len(sets)), np.arange(len(sets)) // 2
    block = (ids, parts, np.array([len(x) for x in sets]), bits)
    close = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if parts[a] != parts[b]
             and len(both := np.intersect1d(sets[a], sets[b], True)) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(both))]
    got = [set(zip(*map(np.ndarray.tolist, simhash.near_sets(block, None, 0.8, thin)))),
           set(zip(*map(np.ndarray.tolist, simhash.near_sets(tuple(x[:150] for x in block), tuple(x[150:] for x in block), 0.8, thin))))]
    assert 50 < len(close) < 30_000
    if thin:
        assert len(got[0]) < 150 and len(got[1]) < 150
        assert len(set(roots(range(150), [(parts[a], parts[b]) for a, b in got[0]]).values())) <= len(set(roots(range(150), [(parts[a], parts[b]) for a, b in close]).values()))
    else:
        assert set(close) <= got[0]
        assert {(a, b) for a, b in close if a < 150 <= b} <= got[1]


def test_bits_tell_long_sets_apart():
    """Unrelated sets of 6,000 to 9,000 members, and some near each other across a power of two."""
    rng = np.random.default_rng(3)
    fresh = lambda n: np.unique(rng.integers(-2 ** 62, 2 ** 62, n))
    sets = [fresh(n) for n in range(6000, 9000, 150)]
    base = fresh(8300)
    near = [base[:8100], base]  # 8,192 lies between
    assert len(simhash.parities(near[0])) * 2 == len(simhash.parities(near[1]))

    def block(sets, at):
        bits = np.frombuffer(b"".join(map(simhash.parities, sets)), np.uint64).reshape(len(sets), -1)
        return np.arange(len(sets)) + at, np.arange(len(sets)) + at, np.array([len(x) for x in sets]), bits

    small, large = [x for x in sets if len(x) <= 8192] + near[:1], [x for x in sets if len(x) > 8192] + near[1:]
    small.sort(key=len)
    large.sort(key=len)
    one, two = block(small, 0), block(large, 100)
    assert len(simhash.near_sets(one, None, 0.8, False)[0]) == 0
    got = simhash.near_sets(one, two, 0.8, False)
    assert len(got[0]) == 1
    assert (len(small[got[0][0]]), len(large[got[1][0] - 100])) == (len(near[0]), len(near[1]))


def recall_of_fingerprints(spark, pairs):
    texts = [x for p in pairs for x in p]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: (r.f0 % 2 ** 64, r.f1 % 2 ** 64) for r in simhash.fingerprints(docs, ["id"], n=5, seeds=(42, 43), once=True).collect()}
    return sum(sum((x ^ y).bit_count() for x, y in zip(got[i], got[i + 1])) <= 32 for i in range(0, len(texts), 2)) / len(pairs)


def test_repeated_lines_and_changed_stretches_are_near(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    repeats, stretches = [], []
    for k in range(40):
        own, line = [word() for _ in range(300)], [word() for _ in range(6)]
        repeats.append((" ".join(own), " ".join(own + line * (20 + 4 * k))))
        own = [word() for _ in range(300)]
        stretches.append((" ".join(own), " ".join(own[:100] + [word() for _ in range(28)] + own[128:])))
    assert recall_of_fingerprints(spark, repeats) == 1
    assert recall_of_fingerprints(spark, stretches) >= 0.95
    pairs = repeats + stretches
    sets = [[set(simhash.shingles(simhash.words_of(t), 5)) for t in p] for p in pairs]
    assert all(len(x & y) >= 0.8 * len(x | y) for x, y in sets)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == list(range(0, 2 * len(pairs), 2))
