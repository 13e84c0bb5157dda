"""Token ids of whole Arrow columns of texts: cut in place, distinct pieces encoded once a slice, ids gathered by numpy."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut and encoded together; a longer text is a slice of its own.
SLICE = 16 << 20
_SPACE, _LINE = 0x20, 0x0A
#: Bytes of remembered pieces and their ids; adding to them takes about as much for a moment.
HELD = 48 << 20
#: Bytes of a piece that fit, with its length, into two 64-bit numbers.
SHORT = 15
#: Bytes, or pieces, whose helper arrays a worker holds at a time.
STEP = 1 << 18
#: What a byte after a blank begins: 0 white space or control, 1 a visible character, 2 perhaps a blank of more bytes.
_NEXT = np.zeros(256, np.uint8)
_NEXT[0x21:0x7F], _NEXT[0x80:] = 1, 1
_NEXT[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
_SIGN, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b".,;:!?)")] = True
_PLAIN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\xc3")] = True
#: The character that a byte-level vocabulary writes for each byte.
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = np.arange(256, 256 + 68)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_encoders: dict[str, "Encoder"] = {}


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each text and the end); a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return body, at - at[0]


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each length in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def words(texts: pa.Array, solid: np.ndarray, change: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word, end of each text among the words): maximal runs of bytes that ``solid`` marks, each
    byte replaced as ``change`` says."""
    body, at = raw(texts)
    inside = solid[body]
    begin, stop = inside.copy(), inside.copy()
    full = np.diff(at) > 0
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    begin[at[:-1][full]] = inside[at[:-1][full]]
    stop[at[1:][full] - 1] = inside[at[1:][full] - 1]
    begins = np.flatnonzero(begin)
    # Words and what lies between them in turn; only words are kept.
    edges = np.full(2 * len(begins) + 1, len(body), np.int64)
    edges[:-1:2], edges[1::2] = begins, np.flatnonzero(stop) + 1
    body = body if change is None else change[body]
    both = pa.Array.from_buffers(pa.large_string(), 2 * len(begins), [None, pa.py_buffer(edges), pa.py_buffer(body)])
    found = both.take(pa.array(np.arange(0, 2 * len(begins), 2))).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(begins, at[1:], side="left")


def lettered(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which pieces hold nothing but letters of ASCII or Latin-1, after one space or none."""
    solid = _LETTER[body]
    solid[1:] |= (body[:-1] == 0xC3) & (body[1:] != 0x97) & (body[1:] != 0xB7)  # neither a multiplication nor a division sign
    solid[at[:-1]] |= body[at[:-1]] == _SPACE
    return np.logical_and.reduceat(solid, at[:-1]) if len(at) > 1 else solid


def packed(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, low and high number) of pieces: the numbers hold a piece's bytes and length, if it has at most SHORT bytes."""
    padded = np.append(body, np.zeros(16, np.uint8))
    eight = np.ndarray(len(body) + 8, "<u8", padded, strides=(1,))  # the number that the eight bytes from each place make
    size = np.diff(at)
    low = eight[at[:-1]] & _MASKS[np.minimum(size, 8)]
    high = (eight[np.minimum(at[:-1] + 8, len(body))] & _MASKS[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
    mix = (low ^ (high >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix ^ (mix >> np.uint64(31)), low, high


class Encoder:
    """A tokenizers-library encoder (byte-level BPE).

    A blank before a visible character always begins a new pre-token of a byte-level BPE, so texts are cut before each
    space or newline that a visible character follows, and before signs after a letter or digit. Pieces give the same ids
    alone and in their text. Texts that hold a special token's string are encoded whole. Pieces of letters alone are one
    pre-token each and go to the library's model as they are. A worker remembers pieces up to HELD bytes of memory; what
    comes later is encoded once a slice. Short pieces are looked up by hash and compared whole, in a table that stays sorted,
    so a slice costs what its own pieces cost, not what is remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # A byte-level vocabulary writes each byte as one character.
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.size)]
        self.widths = np.array([len(n) for n in self.names], np.int64)
        splitter = self.tokenizer.pre_tokenizer
        self.direct = self.tokenizer.normalizer is None and isinstance(splitter, ByteLevel) and splitter.use_regex and not splitter.add_prefix_space
        # Short pieces, ascending by hash up to an end that none is equal to, and longer ones; ids of both.
        self.hashes, self.lows, self.highs = np.array([2 ** 64 - 1], np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.places, self.lengths = np.zeros(1, np.int32), np.zeros(1, np.uint8)
        self.known, self.known_places, self.known_lengths = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.store = np.zeros(0, self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cuts(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places where pieces begin: each text's begin, each blank before a visible character, each sign after a letter."""
        if not len(body):
            return at[:0]
        full = np.diff(at) > 0
        firsts, lasts, found = at[:-1][full], at[1:][full] - 1, []
        for a in range(0, len(body), STEP):
            here, after = body[a:a + STEP], body[a + 1:a + 1 + STEP]
            begin, kind = np.zeros(len(here), bool), _NEXT[after]
            np.logical_and((here[:len(after)] == _SPACE) | (here[:len(after)] == _LINE), kind, out=begin[:len(after)])
            for p in np.flatnonzero(begin[:len(after)] & (kind == 2)).tolist():
                begin[p] = not bytes(body[a + p + 1:a + p + 4]).decode(errors="ignore")[:1].isspace()
            i, j = np.searchsorted(lasts, [a, a + len(here)])
            begin[lasts[i:j] - a] = False  # what follows a text's last blank is another text
            skip = int(a == 0)
            begin[skip:] |= _SIGN[here[skip:]] & _PLAIN[body[a + skip - 1:a + len(here) - 1]]
            i, j = np.searchsorted(firsts, [a, a + len(here)])
            begin[firsts[i:j] - a] = True
            found.append(np.flatnonzero(begin) + a)
        return np.concatenate(found)

    def learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, all ids) of pieces. Letters are encoded by the model alone; other pieces that begin with a blank and a
        visible character are encoded joined."""
        body, at = raw(pieces)
        padded = np.append(body, np.zeros(2, np.uint8))
        first = padded[at[:-1]]
        plain = lettered(body, at) if self.direct else np.zeros(len(pieces), bool)
        joint = ~plain & (np.diff(at) > 1) & ((first == _SPACE) | (first == _LINE)) & (_NEXT[padded[at[:-1] + 1]] == 1)
        places, lengths, parts, total = np.zeros(len(pieces), np.int32), np.zeros(len(pieces), np.int32), [], 0
        for own, encoded in ((np.flatnonzero(plain), self.each), (np.flatnonzero(joint), self.joined)):
            body, at = raw(pieces.take(pa.array(own)))
            for k in range(0, len(own), 1 << 14):
                some = own[k:k + (1 << 14)]
                ends = at[k:k + len(some) + 1]
                ids = encoded(body[ends[0]:ends[-1]], ends - ends[0])
                stops = np.searchsorted(np.cumsum(self.widths[ids]), ends[1:] - ends[0], side="left") + 1
                lengths[some] = np.diff(stops, prepend=0)
                places[some] = total + stops - lengths[some]
                parts.append(ids)
                total += len(ids)
        apart = np.flatnonzero(~plain & ~joint)
        for k, ids in zip(apart.tolist(), self.whole(pieces.take(pa.array(apart)).to_pylist())):
            places[k], lengths[k] = total, len(ids)
            parts.append(ids)
            total += len(ids)
        return places, lengths, np.concatenate(parts) if parts else np.zeros(0, self.kind)

    def each(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ids of pieces that are one pre-token each."""
        text, model, at = _SHOWN[body].tobytes().decode("utf-32-le"), self.tokenizer.model, at.tolist()
        return np.array([t.id for a, b in zip(at, at[1:]) for t in model.tokenize(text[a:b])], self.kind)

    def joined(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.whole([body.tobytes().decode()])[0]

    def found(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, store of ids) of each piece, remembered or new. New ones are remembered while there is room."""
        body, at = raw(pieces)
        short = np.diff(at) <= SHORT
        hashes, lows, highs = packed(body, at)
        order, slots = np.argsort(hashes), np.zeros(len(pieces), np.int64)
        slots[order] = np.searchsorted(self.hashes, hashes[order])
        lacking = ~(short & (self.hashes[slots] == hashes) & (self.lows[slots] == lows) & (self.highs[slots] == highs))
        places, lengths = self.places[slots], self.lengths[slots].astype(np.int32)
        far = np.flatnonzero(~short)
        old = pc.fill_null(pc.index_in(pieces.take(pa.array(far)), value_set=self.known), -1).to_numpy(zero_copy_only=False)
        far, old = far[old >= 0], old[old >= 0]
        lacking[far], places[far], lengths[far] = False, self.known_places[old], self.known_lengths[old]
        new = pieces.filter(pa.array(lacking))
        new_places, new_lengths, ids = self.learn(new)
        new_places += np.int32(len(self.store))
        places[lacking], lengths[lacking] = new_places, new_lengths
        store = np.concatenate([self.store, ids])
        brief = short[lacking]
        longer = new.filter(pa.array(~brief))
        if self.held() + 29 * int(brief.sum()) + longer.nbytes + 8 * len(longer) + ids.nbytes <= HELD:
            add = order[(lacking & short)[order]]
            to, where = slots[add], np.cumsum(lacking)[add] - 1
            self.hashes, self.lows, self.highs = np.insert(self.hashes, to, hashes[add]), np.insert(self.lows, to, lows[add]), np.insert(self.highs, to, highs[add])
            self.places, self.lengths = np.insert(self.places, to, new_places[where]), np.insert(self.lengths, to, new_lengths[where])
            self.known, self.store = pa.concat_arrays([self.known, longer]), store
            self.known_places, self.known_lengths = np.append(self.known_places, new_places[~brief]), np.append(self.known_lengths, new_lengths[~brief])
        return places, lengths, store

    def held(self) -> int:
        """Bytes of what is remembered."""
        return sum(x.nbytes for x in (self.hashes, self.lows, self.highs, self.places, self.lengths, self.known, self.known_places, self.known_lengths, self.store))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end_id``; number of ids of each text with it)."""
        special = np.zeros(len(texts), bool)
        for name in self.added:
            special |= pc.fill_null(pc.match_substring(texts, name), False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        body, at = raw(plain)
        cuts = self.cuts(body, at)
        edges = np.append(cuts, len(body))
        array = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(edges), pa.py_buffer(body)])
        found = array.dictionary_encode()
        which = found.indices.to_numpy(zero_copy_only=False)
        places, lengths, store = self.found(found.dictionary)
        extra = self.whole([texts[int(k)].as_py() for k in np.nonzero(special)[0]])
        # Ends and whole texts are pieces of their own behind the others.
        store = np.concatenate([store, np.array([end_id]).astype(self.kind), *extra])
        sizes = np.array([len(x) for x in extra], np.int64)
        places = np.concatenate([places, [len(store) - 1 - sizes.sum()], len(store) - sizes.sum() + np.cumsum(sizes) - sizes])
        lengths = np.concatenate([lengths, [1], sizes])
        stops = np.searchsorted(cuts, at[1:], side="left")
        own = np.nonzero(special)[0]
        added = np.full(len(stops) + len(own), len(found.dictionary))
        added[own + np.arange(len(own))] += 1 + np.arange(len(own))  # a whole text stands before its end
        which = np.insert(which, np.repeat(stops, 1 + special), added)
        text_stops = stops + np.arange(1, len(stops) + 1) + np.searchsorted(own, np.arange(len(stops)), side="right")
        ids, sizes = self.gather(which, places, lengths, store, text_stops)
        del array, found, which
        pa.default_memory_pool().release_unused()  # a worker lives on between tasks, and what its pool keeps counts as held
        return ids, sizes

    def gather(self, which: np.ndarray, places: np.ndarray, lengths: np.ndarray, store: np.ndarray, text_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces ``which`` in turn, number of ids of each text), STEP pieces at a time."""
        ids, ends, at = [np.zeros(0, self.kind)], np.zeros(len(text_stops), np.int64), 0
        for k in range(0, len(which), STEP):
            some = which[k:k + STEP]
            sizes = lengths[some]
            ids.append(store[gathered(places[some], sizes)])
            i, j = np.searchsorted(text_stops, [k + 1, k + len(some) + 1])
            ends[i:j] = at + np.cumsum(sizes)[text_stops[i:j] - 1 - k]
            at += len(ids[-1])
        return np.concatenate(ids), np.diff(ends, prepend=0)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
