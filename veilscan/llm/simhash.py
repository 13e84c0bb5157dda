"""SimHash near-duplicates by tiled exact comparison.

Texts are lower-cased (A-Z), cut into words and shingles, and the shingles' XXH64 values vote on each fingerprint bit.
Distinct fingerprints are laid out in tiles by the population counts of their words (and, where asked, by size band);
only tiles whose counts differ by no more than the radius are compared, block against block, with numpy exclusive-or
and bit counts. The comparison is exact: no pair within the radius is missed. What a block pair returns is a minimum
spanning forest of its links, which keeps who is connected to whom at every distance but never all pairs of a group.

Edge cases: a null or empty text, or one of white space alone, has fingerprint 0 and links like any other; fewer words
than a shingle make one shingle; a null doc_id is never the smallest of its component unless all are null; repeated rows
give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import components, filter_words, keyed, split_by_filter, text_or_empty, written

#: Fingerprints in a block, about; two blocks are compared at a time.
BLOCK = 1024
#: Rows of one block compared with the whole other block in one numpy step.
STRIP = 256
#: Bits of a small set of shingles, a power of two; larger sets have the next power of two from their size on.
PARITIES = 512
#: Sets of one block compared with the whole other block in one numpy step: its arrays stay in a core's cache.
SETS = 32
#: Texts in a block that list one shingle, about.
LISTED = 4096


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower-cased words: bytes.lower and bytes.split touch A-Z and the six ASCII spaces only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], n: int) -> list[bytes]:
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)))))


def fingerprint(parts: Collection[bytes], seeds: tuple[int, ...]) -> np.ndarray:
    """One unsigned 64-bit word per seed; a bit is 1 if set in over half of the hashes of the shingles ``parts``."""
    out = np.zeros(len(seeds), np.uint64)
    for k, seed in enumerate(seeds if parts else ()):
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in parts), np.uint64, len(parts))
        set_bits = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            set_bits += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", n: int = 3, seeds: tuple[int, ...] = (42,),
                 once: bool = False) -> DataFrame:
    """``carry`` and f0, f1, ... (signed longs with the unsigned bits), one per seed; with ``once``, each distinct shingle votes
    once and ``distinct`` is their number."""
    names = [f"f{k}" for k in range(len(seeds))] + (["distinct"] if once else [])
    schema = docs.select(*carry).schema
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((len(names), batch.num_rows), np.int64)
            for i, t in enumerate(batch.column(len(carry))):
                parts = shingles(words_of(t.as_py()), n)
                parts = set(parts) if once else parts
                values[:len(seeds), i] = fingerprint(parts, seeds).view(np.int64)
                if once:
                    values[-1, i] = len(parts)
            yield pa.RecordBatch.from_arrays([batch.column(j) for j in range(len(carry))] + [pa.array(v) for v in values], names=carry + names)

    return docs.select(*carry, F.col(text).alias("_text")).mapInArrow(run, schema)


def _layout(bits: int, radius: int) -> tuple[int, int]:
    """Words whose population counts make a tile's key, and the width of a count's class: fine counts for a small radius."""
    return (4, 1) if radius <= 3 else (1, radius + 1)


def tile_key(cols: list[str], radius: int, band: Column | None) -> Column:
    parts, width = _layout(64 * len(cols), radius)
    key = F.lit(0).cast("bigint")
    for p in range(parts):
        size = 64 // parts
        counts = [F.bit_count(F.shiftrightunsigned(F.col(c), p * size).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))) for c in cols]
        total = counts[0]
        for c in counts[1:]:
            total = total + c
        key = key + F.floor(total / width).cast("bigint") * F.lit(1 << (10 * p))
    if band is not None:
        key = key + band.cast("bigint") * F.lit(1 << 42)
    return key


def tile_steps(bits: int, radius: int, banded: bool) -> list[int]:
    """Key differences, 0 and up, at which two tiles can hold fingerprints within the radius. Counts are compared exactly
    in blocks afterwards; a digit that would run below 0 gives a key no tile has."""
    parts, width = _layout(bits, radius)
    reach = radius // width + (1 if width > 1 else 0)
    found = set()
    for steps in itertools.product(range(-reach, reach + 1), repeat=parts):
        if sum(max(0, (abs(s) - (width > 1)) * width) for s in steps) > radius:
            continue
        low = sum(s << (10 * p) for p, s in enumerate(steps))
        found |= {low + (b << 42) for b in ((-1, 0, 1) if banded else (0,))}
    return sorted(s for s in found if s >= 0)


def forest(a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Positions of the links that make a minimum spanning forest (Kruskal)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, root, kept = ends[:len(a)], ends[len(a):], list(range(len(nodes))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.lexsort((b, a, dist)):
        x, y = top(left[i]), top(right[i])
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def compare(ids_a: np.ndarray, fa: np.ndarray, ids_b: np.ndarray, fb: np.ndarray, radius: int,
            thin: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] = forest) -> tuple[np.ndarray, ...]:
    """Links (a, b, distance) between two blocks, thinned strip by strip, to a forest by default. Both blocks are put in
    order of population count, so a strip meets only the stretch of the other block whose counts lie within the radius."""
    pop_a, pop_b = (np.bitwise_count(f).sum(1, dtype=np.int64) for f in (fa, fb))
    oa, ob = np.argsort(pop_a, kind="stable"), np.argsort(pop_b, kind="stable")
    ids_a, fa, pop_a, ids_b, fb, pop_b = ids_a[oa], fa[oa], pop_a[oa], ids_b[ob], fb[ob], pop_b[ob]
    found = tuple(np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(ids_a), STRIP):
        strip = slice(at, min(at + STRIP, len(ids_a)))
        lo, hi = np.searchsorted(pop_b, [pop_a[strip][0] - radius, pop_a[strip][-1] + radius + 1])
        if lo == hi:
            continue
        dist = np.zeros((strip.stop - strip.start, hi - lo), np.uint16)
        for k in range(fa.shape[1]):
            dist += np.bitwise_count(fa[strip, k, None] ^ fb[None, lo:hi, k])
        i, j = np.nonzero(dist <= radius)
        a, b, d = ids_a[strip][i], ids_b[lo:hi][j], dist[i, j].astype(np.int64)
        other = a != b
        found = tuple(np.concatenate([x, y[other]]) for x, y in zip(found, (np.minimum(a, b), np.maximum(a, b), d)))
        keep = thin(*found)
        found = tuple(x[keep] for x in found)
    return found


def nearest(a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Positions of the links that are the nearest one of an end; of equally near ones, the first in order of (a, b)."""
    order = np.lexsort((b, a, dist))
    firsts = [order[np.unique(ends[order], return_index=True)[1]] for ends in (a, b)]
    return np.unique(np.concatenate(firsts))


def link(points: DataFrame, radius: int, band: Column | None = None, few: bool = False) -> DataFrame:
    """Links (a, b, distance) whose closure joins exactly the points within ``radius`` of each other.

    ``points`` is a written table (id, f0, f1, ...), one row per distinct fingerprint; ``band``, if given, is a whole
    number such that points more than one band apart need no comparison. A crowded tile is cut into blocks by hash.
    With ``few``, of the links between two blocks only each point's nearest is returned, so there are at most two links
    a point whatever the number of blocks; the closure may then hold less, for callers that look further themselves.
    """
    cols = [c for c in points.columns if c[0] == "f" and c[1:].isdigit()]
    keyed = written(points.select("id", *cols, tile_key(cols, radius, band).alias("tile")), "points")
    catalog = written(keyed.groupBy("tile").agg(F.count("*").alias("n")).select("tile", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "tiles")
    blocks = written(keyed.join(catalog, "tile").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
                     .groupBy("tile", "block").agg(F.collect_list(F.struct("id", *cols)).alias("points")), "blocks")
    steps = F.array(*[F.lit(s).cast("bigint") for s in tile_steps(64 * len(cols), radius, band is not None)])
    near = catalog.select(F.col("tile").alias("tile_a"), F.col("blocks").alias("blocks_a"), F.explode(steps).alias("step")) \
        .withColumn("tile", F.col("tile_a") + F.col("step")).join(catalog, "tile")
    pairs = near.withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))) \
        .withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .where("step > 0 OR block_a <= block_b").select("tile_a", "block_a", F.col("tile").alias("tile_b"), "block_b")
    one = blocks.select(F.col("tile").alias("tile_a"), F.col("block").alias("block_a"), F.col("points").alias("points_a"))
    two = blocks.select(F.col("tile").alias("tile_b"), F.col("block").alias("block_b"), F.col("points").alias("points_b"))
    joined = written(pairs, "pairs").join(one, ["tile_a", "block_a"]).join(two, ["tile_b", "block_b"]) \
        .select("points_a", "points_b", ((F.col("tile_a") == F.col("tile_b")) & (F.col("block_a") == F.col("block_b"))).alias("inside"))

    def side(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        rows = cell.values
        f = np.stack([rows.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in cols], axis=1)
        return rows.field("id").to_numpy(zero_copy_only=False), f

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, inside in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                found = compare(*side(x), *side(y), radius, forest if inside or not few else nearest)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array([inside] * len(found[0]))], names=["a", "b", "distance", "inside"])

    links = joined.mapInArrow(run, "a bigint, b bigint, distance bigint, inside boolean")
    if not few:
        return links.drop("inside")
    ends = written(links, "ends-of-links")
    across = ends.where("NOT inside")
    best = across.select("a", F.struct("distance", "b").alias("to")).union(across.select(F.col("b").alias("a"), F.struct("distance", F.col("a").alias("b")).alias("to"))) \
        .groupBy("a").agg(F.min("to").alias("to"))
    return ends.where("inside").select("a", "b", "distance").union(
        best.select(F.least("a", "to.b").alias("a"), F.greatest("a", "to.b").alias("b"), F.col("to.distance").alias("distance"))).distinct()


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and links' closure by 64-bit fingerprints within ``radius``.

    Documents sharing a fingerprint collapse, map-side, before anything is compared; the fingerprint itself serves as
    the point's id, and a component is named by its smallest doc_id.
    """
    prints = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], n=n), "prints")
    points = written(prints.groupBy("f0").agg(F.min("doc_id").alias("least")), "distinct")
    edges = link(points.select(F.col("f0").alias("id"), "f0"), radius)
    joined = components(edges, docs.sparkSession)
    placed = written(points.join(joined.select(F.col("node").alias("f0"), "component"), "f0", "left")
                     .select("f0", "least", F.coalesce("component", "f0").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(placed.join(least, "component").select("f0", "component_id"), "named")
    return prints.join(named, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def verified(edges: DataFrame, texts: DataFrame, n: int, at_least: float) -> DataFrame:
    """Edges (a, b) whose texts' sets of n-word shingles have a Jaccard similarity of ``at_least``. ``texts`` has id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = (set(shingles(words_of(t.as_py()), n)) for t in (one, two))
                shared = len(x & y)
                keep.append(shared >= at_least * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    one, two = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return edges.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def true_links(edges: DataFrame, rows: DataFrame, points: DataFrame, n: int, at_least: float) -> DataFrame:
    """The edges (a, b) whose texts pass ``verified``. ``rows`` has _t1, _t2 and _body, ``points`` has id, _t1 and _t2."""
    ends = written(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct().join(points.select("id", "_t1", "_t2"), "id"), "ends")
    near, _ = split_by_filter(rows.select("_t1", "_t2", F.col("_body").alias("text")), filter_words(ends, "_t1"), "_t1")
    texts = written(near.join(ends, ["_t1", "_t2"]).select("id", "_t1", "text").dropDuplicates(["id"]).select("id", "text"), "ends")
    return written(verified(edges, texts, n, at_least), "true-links")


def hashed_set(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles as XXH64 values, signed and in order; a text without words has the one value 0."""
    parts = set(shingles(words_of(text), n))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts)).view(np.int64)) if parts else np.zeros(1, np.int64)


def parities(hashes: np.ndarray) -> bytes:
    """A bit per residue of the hashes: whether an odd number of them has it. Two sets differ in no fewer members than their
    bits differ in places, so bits too far apart rule a pair out exactly. There are as many bits as members at least, so that
    long texts are told apart like short ones."""
    many = max(PARITIES, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount(hashes & (many - 1), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bits over fewer residues: where there are half as many, two parities make one."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def common_shingles(rows: DataFrame, n: int, texts: int, looked_at: int = 20_000, most: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """The shingles held by most of about ``looked_at`` of the ``texts`` texts, and how many hold each. They only set the order in
    which ``rare_first`` lists shingles; any order finds the same links, with more or less work."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashed_set(t.as_py(), n) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["token"])

    share = min(1 << 16, 1 + (looked_at << 16) // max(1, texts))
    counts = written(rows.where(F.pmod("_t1", F.lit(1 << 16)) < share).dropDuplicates(["_t1", "_t2"]).select("_body").mapInArrow(run, "token bigint")
                     .groupBy("token").agg(F.count("*").alias("n")).where("n > 2"), "common")
    least, held = 3, 0
    for row in sorted(counts.groupBy("n").agg(F.count("*").alias("shingles")).collect(), reverse=True):
        held += row.shingles
        if held > most:
            least = row.n + 1
            break
    found = counts.where(F.col("n") >= least).toArrow().sort_by("token")
    return found["token"].to_numpy(), found["n"].to_numpy()


def rare_first(rows: DataFrame, n: int, at_least: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """_t1, _t2, size, bits and tokens: the first of each text's distinct shingles, rare ones first, as many as two sets that
    share ``at_least`` cannot have without one in common, and the ``parities`` of them all."""
    known, held = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits, lists = [], [], []
            for t in batch.column(2):
                x = hashed_set(t.as_py(), n)
                bits.append(parities(x))
                rank = np.zeros(len(x), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rank = np.where(known[at] == x, held[at], 0)
                sizes.append(len(x))
                lists.append(x[np.lexsort((x, rank))][:len(x) - math.ceil(at_least * len(x) - 1e-9) + 1])
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), tokens],
                                             names=["_t1", "_t2", "size", "bits", "tokens"])

    return rows.select("_t1", "_t2", "_body").mapInArrow(run, "_t1 bigint, _t2 bigint, size int, bits binary, tokens array<bigint>")


def listed_shingles(rows: DataFrame, labelled: DataFrame, texts: int, n: int, at_least: float) -> tuple[DataFrame, DataFrame]:
    """Written tables (id, size, bits) of the texts and (token, held, id) of listed shingles that hold several components.

    Exact prefix filter: two texts that share ``at_least`` share one of the shingles that ``rare_first`` lists. Shingles
    listed in one component only, nearly all, are gone before texts meet. At the first shingle two texts share, all they
    list before it differs, so their places in it may not exceed, taken together, what the two sets may differ by: a place
    whose ``over`` is too far above the least one of its shingle is gone too. Of shingles that then list the very same
    texts (equal counts and 128-bit sums of ids) one stays. ``labelled`` is a written table (id, _t1, _t2, component).
    """
    lists = rare_first(rows, n, at_least, common_shingles(rows, n, texts)).dropDuplicates(["_t1", "_t2"])
    listed = written(lists.join(labelled, ["_t1", "_t2"]).select("id", "component", "size", "bits", "tokens"), "listed")
    over = F.col("at") - (1 - at_least) / (1 + at_least) * F.col("size")
    each = listed.select("id", "component", "size", F.posexplode("tokens").alias("at", "token")).select("id", "component", "token", over.alias("over"))
    ends = [F.min("component").alias("lo"), F.max("component").alias("hi")]
    met = written(each.groupBy("token").agg(*ends, F.min("over").alias("least")).where("lo <> hi AND least <= 1e-6").select("token", "least"), "met")
    near, _ = split_by_filter(each, filter_words(met, "token"), "token")
    near = written(near.join(met, "token").where("over + least <= 1e-6").select("token", "id", "component"), "near")
    held = near.groupBy("token").agg(*ends, F.count("*").alias("held"), F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("s2"))
    one = held.where("lo <> hi").groupBy("held", "s1", "s2").agg(F.min("token").alias("token")).select("token", "held")
    return listed.select("id", "size", "bits"), written(near.join(one, "token").select("token", "held", "id"), "few")


def links_between(texts: DataFrame, few: DataFrame, labelled: DataFrame, at_least: float, thin: bool) -> DataFrame:
    """Pairs (a, b) of texts in different components, among them every pair that shares ``at_least`` of its shingles.

    ``texts`` and ``few`` come from ``listed_shingles``. The texts that list a shingle are laid out in blocks, and blocks of
    one shingle are compared in numpy by size and ``parities``: only pairs that pass become rows, never all pairs of a
    group. With ``thin``, each two blocks give a spanning forest of the components instead, so few links are returned
    where many hold the same components together; a link that then proves false may hide a true one.
    """
    placed = few.join(texts.join(labelled.select("id", "component"), "id"), "id")
    blocks = F.ceil(F.col("held") / LISTED).cast("int")

    def grouped(entries: DataFrame, *keys: str) -> DataFrame:
        return entries.groupBy("token", *keys).agg(F.collect_list(F.struct("id", "component", "size", "bits")).alias("texts"),
                                                   F.min("component").alias("lo"), F.max("component").alias("hi"))

    split = written(grouped(placed.where(F.col("held") > LISTED).withColumn("blocks", blocks)
                            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "blocks", "block"), "shingle-blocks")
    whole = grouped(placed.where(F.col("held") <= LISTED)).where("lo <> hi").select("texts").union(split.where("lo <> hi").select("texts"))
    within = whole.select(F.col("texts").alias("texts_a"), F.lit(None).cast(split.schema["texts"].dataType).alias("texts_b"))
    one, two = (split.select("token", F.col("block").alias(f"block_{x}"), F.col("texts").alias(f"texts_{x}")) for x in "ab")
    sides = split.select("token", F.col("block").alias("block_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block_b")).where("block_a < block_b")
    across = sides.join(one, ["token", "block_a"]).join(two, ["token", "block_b"]).select("texts_a", "texts_b")

    def side(cell: pa.ListScalar) -> list[tuple[np.ndarray, ...]]:
        rows = cell.values
        size = rows.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(size, kind="stable")
        bits = rows.field("bits").to_pylist()
        widths, parts = np.array([len(x) for x in bits])[order], []
        for width in np.unique(widths):
            at = order[widths == width]
            words = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1)
            parts.append((rows.field("id").to_numpy()[at], rows.field("component").to_numpy()[at], size[at], words))
        return parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                one = side(x)
                two = side(y) if y.is_valid else one
                # sizes that allow the similarity have as many bits, or twice as many
                near = [(p, q) for i, p in enumerate(one) for j, q in enumerate(two) if (y.is_valid or i <= j)
                        and max(p[3].shape[1], q[3].shape[1]) <= 2 * min(p[3].shape[1], q[3].shape[1])]
                for p, q in near:
                    a, b = near_sets(p, None if p is q else q, at_least, thin)
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return within.unionByName(across).mapInArrow(run, "a bigint, b bigint").distinct()


def near_sets(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...] | None, at_least: float, thin: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids from two blocks (ids, components, sizes in order, bits), or within ``one``, of different components whose
    sizes and bits allow a similarity of ``at_least``; with ``thin``, a spanning forest of their components."""
    same, two = two is None, one if two is None else two
    words = min(one[3].shape[1], two[3].shape[1])
    bits_a, bits_b = (np.ascontiguousarray(folded(x[3], words).T) for x in (one, two))
    found = tuple(np.zeros(0, np.int64) for _ in range(5))
    for at in range(0, len(one[0]), SETS):
        ids, parts, sizes, _ = (x[at:at + SETS] for x in one)
        lo, hi = np.searchsorted(two[2], [at_least * sizes[0] - 1e-6, sizes[-1] / at_least + 1e-6])
        total = sizes[:, None] + two[2][None, lo:hi]
        apart = np.zeros(total.shape, np.uint32)
        for k in range(words):
            apart += np.bitwise_count(bits_a[k, at:at + SETS, None] ^ bits_b[k, None, lo:hi])
        passed = (apart <= (1 - at_least) / (1 + at_least) * total + 1e-6) & (parts[:, None] != two[1][None, lo:hi])
        if same:
            passed &= ids[:, None] < two[0][None, lo:hi]
        i, j = np.nonzero(passed)
        if not len(i):
            continue
        a, b, x, y = ids[i], two[0][lo:hi][j], parts[i], two[1][lo:hi][j]
        new = (np.minimum(a, b), np.maximum(a, b), np.minimum(x, y), np.maximum(x, y), apart[i, j].astype(np.int64))
        found = tuple(np.concatenate(pair) for pair in zip(found, new))
        if thin:
            order = np.lexsort((found[1], found[0], found[4], found[3], found[2]))
            first = order[np.unique(np.stack([found[2][order], found[3][order]]), axis=1, return_index=True)[1]]
            found = tuple(x[first] for x in found)
            keep = forest(*found[2:])
            found = tuple(x[keep] for x in found)
    return found[0], found[1]


def labels_of(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Written ``points`` with the component of each, its own id where it has no link."""
    joined = components(edges, points.sparkSession)
    return written(points.join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
                   .select("id", "_t1", "_t2", "least", "rows", F.coalesce("component", "id").alias("component")), "placed")


def drop_near_copies(docs: DataFrame, seeds: tuple[int, ...] = (42, 43), radius: int = 32, verify_words: int = 5,
                     at_least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` but for near copies: one row of each group stays, that of the smallest doc_id (nulls last).

    Groups are linked by 128-bit fingerprints of the distinct shingles, the sets that are verified, within ``radius``;
    bands of shingle counts keep texts apart whose sizes already rule that out, and every link of the spanning forest is
    verified by the exact similarity of the two whole texts. What the radius or the forest leaves apart then meets in an
    exact search between the groups found so far (``links_between``), so no pair of ``at_least`` stays unlinked: once thinned,
    to bring groups together by few links, and once whole. Equal texts collapse before anything is compared. Only texts on
    links, and rows of groups, are shuffled; of the rest a fifth of their shingle hashes is. Rows equal in doc_id and text
    are one row.
    """
    columns = docs.columns
    rows = keyed(docs.withColumn("_body", text_or_empty()), ["doc_id", "_body"]) \
        .withColumns({"_t1": F.xxhash64("_body"), "_t2": F.xxhash64(F.lit(1), "_body")})
    carry = ["doc_id", "_k1", "_k2", "_t1", "_t2"]
    prints = written(fingerprints(rows, carry, "_body", verify_words, seeds, once=True), "prints")
    cols = [f"f{k}" for k in range(len(seeds))]
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    points = prints.groupBy("_t1", "_t2").agg(F.min(who).alias("least"), F.count("*").alias("rows"), *[F.min(c).alias(c) for c in [*cols, "distinct"]])
    points = written(points.withColumn("id", F.monotonically_increasing_id()), "texts")
    band = F.floor(F.log(F.greatest(F.col("distinct"), F.lit(1)).cast("double")) / F.log(F.lit(1.01 / at_least)))
    edges = written(link(points.select("id", *cols, band.alias("band")), radius, F.col("band"), few=True).select("a", "b"), "links")
    links = true_links(edges, rows, points, verify_words, at_least)
    placed = labels_of(points, links)
    texts, few = listed_shingles(rows, placed.select("id", "_t1", "_t2", "component"), points.count(), verify_words, at_least)
    for thin in (True, False):
        more = written(links_between(texts, few, placed, at_least, thin), "links-between")
        if more.limit(1).count():
            links = links.unionByName(true_links(more, rows, points, verify_words, at_least))
            placed = labels_of(points, links)
    groups = placed.groupBy("component").agg(F.min("least").alias("one"), F.sum("rows").alias("all"))
    named = written(placed.join(groups.where(F.col("all") > 1), "component").select("_t1", "_t2", F.col("one._k1").alias("o1"), F.col("one._k2").alias("o2")), "groups")
    touched = written(prints.join(named, ["_t1", "_t2"]).select("_k1", "_k2", ((F.col("_k1") == F.col("o1")) & (F.col("_k2") == F.col("o2"))).alias("stays"))
                      .distinct(), "touched")
    some, rest = split_by_filter(rows, filter_words(touched))
    kept = some.join(touched, ["_k1", "_k2"], "left").where(F.coalesce("stays", F.lit(True)))
    once = kept.dropDuplicates(["_k1", "_k2"])
    return once.select(*columns).unionByName(rest.select(*columns))
