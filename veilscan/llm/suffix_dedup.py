"""Removal of repeated byte strings by a distributed, common-prefix-aware suffix sort.

Every start of a string of ``length`` bytes has an anchor: the place in it whose hashed seed (SEED bytes) is smallest.
Equal strings have equal anchors at equal places, so a sparse suffix array over anchors finds every repeat:

1. One pass over the texts lists each anchor with the run of starts it serves: hash of its seed, hash of the whole segment
   the run covers, place. Seeds that occur once are settled; so are segments that occur whole more than once.
2. The rest, one representative per distinct segment, are suffixes from their anchors (with what stands left of them).
   Tasks sort theirs, front-code the sorted run (common prefix length and the rest), and send each suffix range its part.
3. A range merges its runs with a loser tree that holds each run's common prefix with the last string put out: larger
   ones win unseen, equal ones are compared from that prefix on, so no known prefix is compared again.
4. The merged order with its common prefixes gives, for each distance d to the left, classes of suffixes that agree on
   length - d bytes; within a class, starts with the same d bytes before the anchor are the same string.

Strings are judged on the input; covered bytes are then cut from it. Copies never meet one another in a task: equal
segments collapse to one representative with a count before any content moves.

Edge cases: a null or empty text has no bytes and an empty rest; texts under ``length`` bytes lose nothing; repeated
rows are copies of each other; a null doc_id is carried through; an empty table gives no rows; other columns are
ignored. Texts of any length are scanned in overlapping stretches of bounded size.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import filter_words, split_by_filter, text_or_empty, written

#: Bytes of an anchor's seed; bytes scanned at once (positions take the low bits of a packed key).
SEED, STRETCH_BITS = 40, 20
STRETCH = 1 << STRETCH_BITS
#: Suffix bytes merged by one task, about.
RANGE_BYTES = 8 << 20
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MIX = np.uint64(0xFF51AFD7ED558CCD)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for every place in a stretch."""
    if base not in _powers:
        steps = [np.full(STRETCH + 1, b & (2 ** 64 - 1), np.uint64) for b in (base, pow(base, -1, 2 ** 64))]
        for s in steps:
            s[0] = 1
            np.multiply.accumulate(s, out=s)
        _powers[base] = (steps[0], steps[1])
    return _powers[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def span_hash(prefix: np.ndarray, inverse: np.ndarray, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
    return (prefix[hi] - prefix[lo]) * inverse[lo]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: running minima from both ends of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor each in ``data``, texts laid end to end and ending at ``ends``: seed hash, segment
    hash, first start, number of starts, anchor minus first start. No start's string crosses an end."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length:
        return none
    x = data.astype(np.uint64) + np.uint64(1)
    pw, inv = powers(BASE_A)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * pw[:len(x)], out=sums[1:])
    n_seeds = len(x) - SEED + 1
    h = mixed((sums[SEED:] - sums[:-SEED]) * inv[:n_seeds])
    low = np.uint64(STRETCH - 1)
    packed = (h & ~low) | np.arange(n_seeds, dtype=np.uint64)
    least = sliding_min(packed, length - SEED + 1)
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)] or [np.zeros(0, np.int64)])
    if not len(starts):
        return none
    own = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.nonzero(new)[0]
    first, count = starts[at], np.diff(np.append(at, len(starts)))
    anchor = (own[at] & low).astype(np.int64)
    pw, inv = powers(BASE_B)
    np.cumsum(x * pw[:len(x)], out=sums[1:])
    whole = mixed(span_hash(sums, inv, first, first + count - 1 + length))
    return h[anchor], whole, first, count, anchor - first


def stretches(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(bytes, ends, [(text number, offset in the text)]) with every start of every text in exactly one stretch."""
    parts, ends, where, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), STRETCH // 2):
            piece = t[at:at + STRETCH // 2 + length - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > STRETCH:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends, np.int64), where
                parts, ends, where, size = [], [], [], 0
            parts.append(piece)
            size += len(piece)
            ends.append(size)
            where.append((i, at))
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(ends, np.int64), where


def list_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(seed, whole, k1, k2, place) per run; place packs first start, number of starts and the anchor's distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [v.as_py().encode("utf-8", "surrogatepass") for v in batch.column(2)]
            for data, ends, where in stretches(texts, length):
                seed, whole, first, count, off = anchors(data, ends, length)
                piece = np.searchsorted(ends, first, side="right")
                text, at = (np.array(c, np.int64) for c in zip(*where))
                begin = np.concatenate([[0], ends[:-1]])
                place = ((first - begin[piece] + at[piece]) << 16) | (count << 8) | off
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(k1[text[piece]]),
                                                  pa.array(k2[text[piece]]), pa.array(place)], names=["seed", "whole", "k1", "k2", "place"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "seed bigint, whole bigint, k1 bigint, k2 bigint, place bigint")


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, known to be h at least."""
    lo, hi = h, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs (strings, each with its common prefix with the one before) by a loser tree of common prefixes.

    Returns (run, place in the run) in order, and each string's common prefix with the one put out before it.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [r[1] for r in runs] + [[]] * (k - len(runs))
    at, h, lost = [0] * k, [0] * k, [-1] * k

    def beats(x: int, y: int) -> bool:
        """Whether x's head goes before y's; the loser's h becomes its common prefix with the winner."""
        if at[x] >= len(strings[x]):
            return False
        if at[y] >= len(strings[y]) or h[x] > h[y]:
            return True
        if h[x] < h[y]:
            return False
        a, b = strings[x][at[x]], strings[y][at[y]]
        c = common(a, b, h[x])
        first = c == len(a) or (c < len(b) and a[c] < b[c])
        h[y if first else x] = c
        return first

    def play(node: int) -> int:
        if node >= k:
            return node - k
        x, y = play(2 * node), play(2 * node + 1)
        win, lose = (x, y) if beats(x, y) else (y, x)
        lost[node] = lose
        return win

    order, lcps = [], []
    win = play(1)
    while at[win] < len(strings[win]):
        order.append((win, at[win]))
        lcps.append(h[win])
        at[win] += 1
        if at[win] < len(strings[win]):
            h[win] = shared[win][at[win]]
        node = (win + k) // 2
        while node:
            if beats(lost[node], win):
                win, lost[node] = lost[node], win
            node //= 2
    return order, lcps


def repeated_starts(lcp: np.ndarray, left: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> np.ndarray:
    """Per suffix (rows, in sorted order) and distance d to the left: whether that start's string occurs on another row.

    ``left`` holds the bytes before each anchor, nearest first; starts near <= d <= far exist.
    """
    found = np.zeros((len(lcp), left.shape[1] + 1), bool)
    behind = np.zeros(len(lcp), np.uint64)
    for d in range(left.shape[1] + 1):
        if d:
            behind = (behind + left[:, d - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(BASE_A)
        group = np.cumsum(lcp < length - d)
        rows = np.nonzero((near <= d) & (d <= far))[0]
        if len(rows) < 2:
            continue
        rows = rows[np.lexsort((behind[rows], group[rows]))]
        same = (group[rows][1:] == group[rows][:-1]) & (behind[rows][1:] == behind[rows][:-1])
        found[rows[1:][same], d] = True
        found[rows[:-1][same], d] = True
    return found


CONTENT = "head bigint, suffix binary, before binary, near int, far int, k1 bigint, k2 bigint, anchor bigint, copies bigint"
RUNS = ("part int, shared binary, tails binary, sizes binary, befores binary, before_sizes binary, near binary, far binary, "
        "k1 binary, k2 binary, anchor binary, copies binary")


def cut_content(joined: DataFrame, length: int) -> DataFrame:
    """The suffix from each representative's anchor, and the bytes before it, from texts with their lists of places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CONTENT.split(", ")]
        for batch in batches:
            rows = []
            for k1, k2, text, places, copies in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8", "surrogatepass")
                for place, n in zip(places, copies):
                    lo, count, off = place >> 16, (place >> 8) & 255, place & 255
                    suffix = data[lo + off:lo + count - 1 + length]
                    rows.append((int.from_bytes(suffix[:8], "big") - (1 << 63), suffix, data[lo:lo + off][::-1], off - count + 1, off, k1, k2, lo + off, n))
            if rows:
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return joined.mapInArrow(run, CONTENT)


def front_coded_runs(content: DataFrame, splitters: list[int]) -> DataFrame:
    """Each batch's suffixes sorted and front-coded, one row per suffix range."""
    bounds = np.array(splitters, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, suffix, before, near, far, k1, k2, anchor, copies = (
                c.to_pylist() if i in (1, 2) else c.to_numpy(zero_copy_only=False) for i, c in enumerate(batch.columns))
            order = sorted(range(batch.num_rows), key=suffix.__getitem__)
            part = np.searchsorted(bounds, head[order], side="right")
            cuts = np.append(np.nonzero(np.diff(part, prepend=-1))[0], len(order))
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, last, tails, shared, idx = order[a:b], b"", [], [], np.array(order[a:b])
                for i in own:
                    c = common(last, suffix[i], 0)
                    shared.append(c)
                    tails.append(suffix[i][c:])
                    last = suffix[i]
                befores = [before[i] for i in own]
                rows.append((int(part[a]), np.array(shared, np.uint16).tobytes(), b"".join(tails), np.array([len(t) for t in tails], np.uint16).tobytes(),
                             b"".join(befores), np.array([len(x) for x in befores], np.uint16).tobytes(), near[idx].astype(np.int32).tobytes(),
                             far[idx].astype(np.int32).tobytes(), k1[idx].tobytes(), k2[idx].tobytes(), anchor[idx].tobytes(), copies[idx].tobytes()))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]],
                                                 names=[f.split()[0] for f in RUNS.split(", ")])

    return content.mapInArrow(run, RUNS)


def _strings(shared: np.ndarray, sizes: np.ndarray, tails: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for c, n in zip(shared.tolist(), sizes.tolist()):
        last = last[:c] + tails[at:at + n]
        at += n
        out.append(last)
    return out


def merge_ranges(runs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi): stretches of the representatives' own texts whose strings occur in another representative."""
    def run(group: pa.Table) -> pa.Table:
        cols = {f: [] for f in ("k1", "k2", "anchor", "copies", "near", "far", "left")}
        coded, reach = [], length - SEED
        for row in group.to_pylist():
            shared, sizes = np.frombuffer(row["shared"], np.uint16), np.frombuffer(row["sizes"], np.uint16)
            coded.append((_strings(shared, sizes, row["tails"]), shared.tolist()))
            for f, t in (("k1", np.int64), ("k2", np.int64), ("anchor", np.int64), ("copies", np.int64), ("near", np.int32), ("far", np.int32)):
                cols[f].append(np.frombuffer(row[f], t))
            widths = np.frombuffer(row["before_sizes"], np.uint16).astype(np.int64)
            left = np.zeros((len(widths), reach), np.uint8)
            left[np.arange(reach)[None, :] < widths[:, None]] = np.frombuffer(row["befores"], np.uint8)
            cols["left"].append(left)
        base = np.concatenate([[0], np.cumsum([len(c[0]) for c in coded])])
        order, lcps = merge(coded)
        at = np.array([base[r] + i for r, i in order], np.int64)
        v = {f: np.concatenate(x) for f, x in cols.items()}
        lcp = np.array(lcps, np.int64)
        out: list[list[np.ndarray]] = [[], [], [], []]
        # Suffixes of different seeds share no class: work through the order in pieces cut where a seed ends.
        edges = np.append(np.nonzero(lcp < SEED)[0], len(lcp))
        a = 0
        while a < len(lcp):
            b = int(edges[min(np.searchsorted(edges, a + 8192), len(edges) - 1)])
            rows = at[a:b]
            piece = lcp[a:b].copy()
            piece[0] = 0
            hit = repeated_starts(piece, v["left"][rows], v["near"][rows], v["far"][rows], length)
            hit &= (v["copies"][rows] == 1)[:, None]
            i, d = np.nonzero(hit)
            starts = v["anchor"][rows][i] - d
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1] + 1)
            lasts = np.nonzero(np.append(new[1:], True))[0] if len(i) else np.zeros(0, np.int64)
            firsts = np.nonzero(new)[0]
            for o, x in zip(out, (v["k1"][rows][i[firsts]], v["k2"][rows][i[firsts]], starts[lasts], starts[firsts] + length)):
                o.append(x)
            a = b
        return pa.table({c: pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for c, o in zip(("k1", "k2", "lo", "hi"), out)})

    return runs.groupBy("part").applyInArrow(run, "k1 bigint, k2 bigint, lo bigint, hi bigint")


def covered_stretches(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi): stretches that cover exactly the bytes of repeated strings. ``docs`` has k1, k2, text."""
    runs = written(list_anchors(docs, length), "anchors")
    seeds = written(runs.groupBy("seed").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).where("n > 1")
                    .select("seed", (F.col("a") == F.col("b")).alias("settled")), "seeds")
    lo, count = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    hi = lo + count - 1 + F.lit(length)
    shared = written(runs.join(seeds, "seed"), "shared")
    opened = shared.where("NOT settled")
    whole = written(opened.groupBy("seed", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "place")).alias("one"))
                    .select("seed", "whole", "copies", "one.*"), "segments")
    repeated = opened.join(whole.where("copies > 1").select("seed", "whole"), ["seed", "whole"], "left_semi")
    settled = shared.where("settled").select("k1", "k2", lo.alias("lo"), hi.alias("hi")) \
        .union(repeated.select("k1", "k2", lo.alias("lo"), hi.alias("hi")))
    lists = written(whole.groupBy("k1", "k2").agg(F.collect_list(F.struct("place", "copies")).alias("s"))
                    .select("k1", "k2", F.col("s.place").alias("places"), F.col("s.copies").alias("copies")), "places")
    near, _ = split_by_filter(docs, filter_words(lists, "k1"), "k1")
    texts = near.join(lists, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    content = written(cut_content(texts.select("k1", "k2", "text", "places", "copies"), length), "content")
    size = content.agg(F.sum(F.octet_length("suffix") + F.octet_length("before"))).first()[0] or 0
    parts = max(1, -(-size // RANGE_BYTES))
    splitters = []
    if parts > 1:
        picks = [(i + 1) / parts for i in range(parts - 1)]
        splitters = sorted(set(content.agg(F.percentile_approx("head", picks, 10_000)).first()[0]))
    merged = merge_ranges(front_coded_runs(content, splitters), length)
    return written(settled.union(merged), "covered")


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``data`` without the spans, and the number of maximal removed runs."""
    kept, at, n = [], 0, 0
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:
            n += 1
        if lo > at:
            kept.append(data[at:lo])
        at, end = max(at, hi), max(end, hi)
    kept.append(data[at:])
    return b"".join(kept), n


def remove_repeats(docs: DataFrame, length: int = 200, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``carry``, n_bytes, n_removed, n_spans, kept (bytes) for every row of ``docs``."""
    if not SEED <= length <= SEED + 254:
        raise ValueError(f"length must be from {SEED} to {SEED + 254}")
    value = text_or_empty(text)
    keyed = docs.select(*carry, value.alias("text"), F.xxhash64(*carry, value).alias("k1"), F.xxhash64(value, *carry, F.lit(1)).alias("k2"))
    covered = covered_stretches(keyed, length)
    spans = written(covered.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("s"))
                    .select("k1", "k2", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")), "spans")
    hit, clear = split_by_filter(keyed, written(filter_words(spans, "k1"), "filter"), "k1")
    touched = hit.join(spans, ["k1", "k2"], "left").select(*carry, "text", "lo", "hi")
    n = len(carry)
    schema = docs.select(*carry).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, lo, hi in zip(*(batch.column(i).to_pylist() for i in (n, n + 1, n + 2))):
                data = value.encode("utf-8", "surrogatepass")
                kept, runs = cut_spans(data, list(zip(lo, hi)) if lo else [])
                out.append((len(data), len(data) - len(kept), runs, kept))
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [pa.array(c, t) for c, t in zip(columns, kinds)], schema=None,
                                             names=[*carry, "n_bytes", "n_removed", "n_spans", "kept"])

    untouched = clear.select(*carry, F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
                             F.lit(0).cast("bigint").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return touched.mapInArrow(run, schema).union(untouched)


