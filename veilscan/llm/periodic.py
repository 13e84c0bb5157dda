"""Runs of repeated words, found in a grammar of the texts.

A run is a stretch of words with smallest period q that is at least max(``least``, ``repeats`` * q) words long and that no
neighbouring word extends. Word ids of the texts of a slice are compressed together by Re-Pair: each round replaces, at once, every
pair that is more frequent than the pairs it overlaps (ties by code) by a symbol of its own, until rounds gain little. A run lies in
the smallest symbol that derives all of it and crosses the boundary between that symbol's halves, or it crosses a boundary of the
compressed text. So the runs that cross a boundary are computed once for each symbol, at its first place, and once for each
boundary left over; the runs of a symbol are then translated to all places where the text derives it, and those contained in another
of the same period are merged into it.

Crossing runs: a run of ``repeats`` >= 4 periods holds two periods before or after the boundary, so its period is the distance to
a copy of the words next to the boundary. Copies are looked up by hashes of 2**k words for periods of 2**k to 2**(k+1); the ends are
found by comparing hashes over halving distances, and every run is compared word by word before it counts.

Edge cases: a null or empty text has no words and no run; ids, other columns and repeated rows play no part; a text of any length is one
slice at most; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.encoding import gathered, slices, words

#: Bytes of text compressed together.
SLICE = 4 << 20
#: A round of Re-Pair that removes less than this share of the symbols is the last.
GAIN = 0.005
#: Hashes multiply by powers of an odd number, modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
Reorder = Callable[[int | None, int], np.ndarray | None]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word, end of each text among the words): words as in ``WORD``."""
    return words(texts, _SOLID)


class Grammar:
    """Re-Pair of texts laid end to end; no pair spans two texts."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, symbols: int, gain: float = GAIN):
        self.first, self.middle, self.stop = [], [], []  # of each symbol's first place: begin, boundary, end
        self.derived: list[tuple[np.ndarray, np.ndarray]] = []  # (symbol, place) of all places, a pair of arrays a round
        seq, place = ids.copy(), np.arange(len(ids), dtype=np.int64)
        last = np.zeros(len(ids), bool)  # the last symbol of a text
        last[ends[ends > 0] - 1] = True
        symbols, made = symbols + 1, 0
        while len(seq) > 1:
            key = seq[:-1] * np.int64(symbols) + seq[1:]
            open_ = ~last[:-1]
            bits = max(10, min(22, int(len(key)).bit_length()))
            slot = (key.astype(np.uint64) * np.uint64(BASE) >> np.uint64(64 - bits)).astype(np.int64)
            count = np.bincount(slot[open_], minlength=1 << bits)
            rank = np.where(open_, count[slot] << bits | slot, -1)  # frequency, ties by code
            rank[count[slot] < 2] = -1
            take = rank >= 0
            take[1:] &= (rank[1:] > rank[:-1]) | (key[1:] == key[:-1])
            take[:-1] &= (rank[:-1] > rank[1:]) | (key[1:] == key[:-1])
            # Within a stretch of one repeated symbol every other pair counts.
            same = np.concatenate([[False], key[1:] == key[:-1]])
            if same.any():
                at = np.arange(len(key))
                since = at - np.maximum.accumulate(np.where(same, 0, at))
                take &= since % 2 == 0
            take[1:] &= ~take[:-1]
            chosen = np.flatnonzero(take)
            pairs, which, often = np.unique(key[chosen], return_inverse=True, return_counts=True)
            chosen, which = chosen[often[which] > 1], which[often[which] > 1]
            if len(chosen) < gain * len(seq) or not len(chosen):
                break
            used, which = np.unique(which, return_inverse=True)
            end_of = np.append(place[1:], len(ids))
            one = np.zeros(len(used), np.int64)
            one[which[::-1]] = chosen[::-1]  # first place of each new symbol
            self.first.append(place[one])
            self.middle.append(place[one + 1])
            self.stop.append(end_of[one + 1])
            self.derived.append((which + made, place[chosen]))
            seq[chosen] = which + symbols
            last[chosen] = last[chosen + 1]
            keep = np.ones(len(seq), bool)
            keep[chosen + 1] = False
            seq, place, last = seq[keep], place[keep], last[keep]
            made += len(used)
            symbols += len(used)
        self.first = np.concatenate([np.zeros(0, np.int64), *self.first])
        self.middle = np.concatenate([np.zeros(0, np.int64), *self.middle])
        self.stop = np.concatenate([np.zeros(0, np.int64), *self.stop])
        self.left = place[1:][~last[:-1]]  # boundaries of the compressed texts
        self.symbols = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in self.derived)])
        self.places = np.concatenate([np.zeros(0, np.int64), *(p for _, p in self.derived)])


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Texts:
    """Word ids of texts end to end, with hashes of any stretch."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.back = _powers(pow(BASE, -1, 1 << 64), len(ids) + 1)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(BASE, len(ids)), dtype=np.uint64)])

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def ahead(self, one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``one`` on equal those from ``two`` on, up to ``most``."""
        out, step = np.zeros(len(one), np.int64), 1 << int(max(most.max(initial=0), 1)).bit_length()
        while step:
            room = out + step <= most
            a, b = (one + out)[room], (two + out)[room]
            out[np.flatnonzero(room)[self.hashes(a, step) == self.hashes(b, step)]] += step
            step >>= 1
        return out

    def behind(self, one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``one`` equal those before ``two``, up to ``most``."""
        out, step = np.zeros(len(one), np.int64), 1 << int(max(most.max(initial=0), 1)).bit_length()
        while step:
            room = out + step <= most
            a, b = (one - out - step)[room], (two - out - step)[room]
            out[np.flatnonzero(room)[self.hashes(a, step) == self.hashes(b, step)]] += step
            step >>= 1
        return out


def candidates(texts: Texts, at: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of boundaries, periods, where two periods begin) such that one period of words repeats right after or right before the boundary."""
    ids, n = texts.ids, len(texts.ids)
    for q in range(1, 8):
        for side in (0, 1):
            near = np.flatnonzero(at + 2 * q <= high) if side == 0 else np.flatnonzero(at - 2 * q >= low)
            begin = at[near] if side == 0 else at[near] - 2 * q
            for k in range(q):
                equal = ids[begin + k] == ids[begin + k + q]
                near, begin = near[equal], begin[equal]
            yield near, np.full(len(near), q), begin
    # Periods of 2**k to 2**(k+1): blocks of 2**k words whose copy begins so far away. ``alive``: blocks that occur twice in their text.
    size, alive = 8, np.arange(max(n - 7, 0), dtype=np.int64)
    bits = np.uint64(max(int(n).bit_length(), 1))
    begins = np.concatenate([[0], ends[:-1]])
    text_of = np.repeat(np.arange(len(ends)), ends - begins)
    while len(alive):
        alive = alive[alive + size <= ends[text_of[alive]]]
        name = texts.hashes(alive, size) >> bits
        order = np.sort(name << bits | alive.astype(np.uint64))
        place = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        name = order >> bits
        gap = np.diff(place)
        again = (name[1:] == name[:-1]) & (text_of[place[1:]] == text_of[place[:-1]])
        mark = np.zeros(n + 1, bool)
        mark[place[1:][again]] = mark[place[:-1][again]] = True
        # Boundaries whose block has a copy near enough, whichever the copy.
        close = again & (gap < 2 * size)
        near_next, near_before = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        near_next[place[:-1][close]] = True
        near_before[place[1:][close]] = True
        for side in (0, 1):
            if side == 0:
                own = np.flatnonzero((at + 2 * size <= high) & near_next[np.minimum(at, n)])
                block = at[own]
            else:
                own = np.flatnonzero(at - 2 * size >= low)
                block = at[own] - size
                own, block = own[near_before[block]], block[near_before[block]]
            if not len(own):
                continue
            code = (texts.hashes(block, size) >> bits) << bits
            if side == 0:
                one = np.searchsorted(order, code | (block + size).astype(np.uint64))
                two = np.searchsorted(order, code | np.minimum(block + 2 * size, n).astype(np.uint64))
            else:
                one = np.searchsorted(order, code | np.maximum(block - 2 * size + 1, 0).astype(np.uint64))
                two = np.searchsorted(order, code | np.maximum(block - size + 1, 0).astype(np.uint64))
            many = np.maximum(two - one, 0)
            stops = np.cumsum(many)
            begin = 0
            while begin < len(own):  # about a million at a time
                stop = max(begin + 1, int(np.searchsorted(stops, (stops[begin - 1] if begin else 0) + (1 << 20), side="right")))
                some = many[begin:stop]
                which = np.repeat(np.arange(begin, stop), some)
                period = np.abs(place[gathered(one[begin:stop], some)] - block[which])
                b, lo, hi = at[own[which]], low[own[which]], high[own[which]]
                fits = b + 2 * period <= hi if side == 0 else b - 2 * period >= lo
                which, period, b = which[fits], period[fits], b[fits]
                origin = b if side == 0 else b - 2 * period
                square = texts.hashes(origin, period) == texts.hashes(origin + period, period)
                yield own[which[square]], period[square], origin[square]
                begin = stop
        alive = np.flatnonzero(mark)
        size *= 2


def crossing(texts: Texts, at: np.ndarray, low: np.ndarray, high: np.ndarray, ends: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, ...]:
    """(number of boundary, begin, end, smallest period, where a period repeats, the period found there) of the runs that cross each
    boundary, within its ``low`` and ``high``."""
    out = []
    for which, q, o in candidates(texts, at, low, high, ends):
        if not len(which):
            continue
        b, lo, hi = at[which], low[which], high[which]
        begin = o - texts.behind(o, o + q, o - lo)
        end = o + q + texts.ahead(o, o + q, hi - q - o)
        long = (end - begin >= np.maximum(least, repeats * q)) & (begin < b) & (end > b)
        which, begin, end, q, o = which[long], begin[long], end[long], q[long], o[long]
        found = np.stack([which, begin, end, _roots(texts, begin, end, q), o, q])
        out.append(found[:, np.unique(found[:4], axis=1, return_index=True)[1]])
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in out)]) for k in range(6))


def _roots(texts: Texts, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The smallest period of stretches that ``period`` repeats at least twice: it divides ``period``."""
    root, left = period.copy(), period.copy()
    factor = 2
    while len(left) and factor * factor <= int(left.max()):
        for _ in range(int(left.max()).bit_length()):
            own = np.flatnonzero(left % factor == 0)
            if not len(own):
                break
            left[own] //= factor
            _divide(texts, begin, end, root, own, np.full(len(own), factor))
        factor += 1
    own = np.flatnonzero(left > 1)
    _divide(texts, begin, end, root, own, left[own])
    return root


def _divide(texts: Texts, begin: np.ndarray, end: np.ndarray, root: np.ndarray, own: np.ndarray, factor: np.ndarray) -> None:
    less = root[own] // factor
    size = end[own] - begin[own] - less
    good = texts.hashes(begin[own], size) == texts.hashes(begin[own] + less, size)
    root[own[good]] = less[good]


def _checked(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which stretches have their period, word by word."""
    size = end - begin - period
    good = np.ones(len(begin), bool)
    stops, at = np.cumsum(size), 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + (1 << 21), side="right")))
        place = gathered(begin[at:stop], size[at:stop])
        wrong = ids[place] != ids[place + np.repeat(period[at:stop], size[at:stop])]
        good[at:stop][np.repeat(np.arange(stop - at), size[at:stop])[wrong]] = False
        at = stop
    return good


def runs(ids: np.ndarray, ends: np.ndarray, symbols: int, least: int = 6, repeats: int = 4, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of all runs, by begin, then period, as places in ``ids``."""
    if repeats < 4:
        raise ValueError("runs of fewer than 4 periods are not found")
    if not len(ids):
        none = np.zeros(0, np.int64)
        return none, none, none
    grammar, texts = Grammar(ids, ends, symbols, gain), Texts(ids)
    begins = np.concatenate([[0], ends[:-1]])
    text = np.searchsorted(ends, grammar.left, side="right")
    big = np.flatnonzero(grammar.stop - grammar.first >= least)
    at = np.concatenate([grammar.left, grammar.middle[big]])
    low, high = np.concatenate([begins[text], grammar.first[big]]), np.concatenate([ends[text], grammar.stop[big]])
    which, begin, end, period, origin, asked = crossing(texts, at, low, high, ends, least, repeats)
    _, one = np.unique(np.stack([which, begin, end, period]), axis=1, return_index=True)
    which, begin, end, period, origin, asked = which[one], begin[one], end[one], period[one], origin[one], asked[one]
    good = _checked(ids, begin, end, period)
    if not good.all():  # a hash lied: find the ends of these word by word
        more = []
        for k in np.flatnonzero(~good).tolist():
            lo, hi = int(low[which[k]]), int(high[which[k]])
            for q in {int(period[k]), int(asked[k])}:
                x = y = int(origin[k])
                while x > lo and ids[x - 1] == ids[x - 1 + q]:
                    x -= 1
                while y + q < hi and ids[y] == ids[y + q]:
                    y += 1
                if y + q - x >= max(least, repeats * q) and x < at[which[k]] < y + q:
                    more.append((which[k], x, y + q, q))
        again = np.array(more, np.int64).reshape(-1, 4).T
        which, begin, end, period = (np.concatenate([old[good], new]) for old, new in zip((which, begin, end, period), again))
    # Translate the runs of symbols to all places where the text derives them.
    own = which >= len(grammar.left)
    symbol = big[which[own] - len(grammar.left)]
    order = np.argsort(grammar.symbols, kind="stable")
    first = np.searchsorted(grammar.symbols[order], np.arange(len(grammar.first) + 1))
    often = first[symbol + 1] - first[symbol]
    moved = grammar.places[order[gathered(first[symbol], often)]] - np.repeat(grammar.first[symbol], often)
    begin = np.concatenate([begin[~own], np.repeat(begin[own], often) + moved])
    end = np.concatenate([end[~own], np.repeat(end[own], often) + moved])
    period = np.concatenate([period[~own], np.repeat(period[own], often)])
    # Merge: what another run of the same period contains; then of equal stretches the smallest period.
    order = np.lexsort((-end, begin, period))
    begin, end, period = begin[order], end[order], period[order]
    far = np.maximum.accumulate(end + period * (len(ids) + 1)) if len(end) else end
    new = np.concatenate([[True], end[1:] + period[1:] * (len(ids) + 1) > far[:-1]]) if len(end) else np.zeros(0, bool)
    begin, end, period = begin[new], end[new], period[new]
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    new = np.concatenate([[True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])]) if len(end) else np.zeros(0, bool)
    begin, end, period = begin[new], end[new], period[new]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def collapse_runs(docs: DataFrame, reorder: Reorder | None = None, least: int = 6, repeats: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period) and collapsed, the words joined by one space without those that any
    run holds after its first period. ``reorder`` may give, for a doc_id and its number of words, the words to read in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, SLICE):
                names, ids, ends = words_of(piece.column(1))
                sizes = np.diff(ends, prepend=0)
                if reorder is not None:
                    for k, (doc, n) in enumerate(zip(piece.column(0).to_pylist(), sizes.tolist())):
                        order = reorder(doc, n)
                        if order is not None:
                            ids[ends[k] - n:ends[k]] = ids[ends[k] - n:ends[k]][order]
                begin, end, period = runs(ids, ends, len(names), least, repeats)
                step = np.zeros(len(ids) + 1, np.int64)
                np.add.at(step, begin + period, 1)
                np.add.at(step, end, -1)
                kept = np.cumsum(step[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
                lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), names.cast(pa.string()).take(pa.array(ids[kept])))
                of = np.searchsorted(ends, begin, side="right")
                found = pa.StructArray.from_arrays([pa.array(begin - (ends - sizes)[of]), pa.array(end - begin), pa.array(period)], ["start", "length", "period"])
                counts = np.searchsorted(of, np.arange(len(ends) + 1), side="left")
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), found), pc.binary_join(lists, " ")],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, n_words bigint, {RUNS}, collapsed string")
