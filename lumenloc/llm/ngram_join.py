"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact sorted-array intersection.

Two documents link when ``den * |intersection| >= num * |union|`` of their sets of word n-grams. No link is lost:

* Sets whose sizes allow a link differ in at most ``k = (den - num) * smaller // num`` elements. A band of sizes has
  ``m`` slots, a power of two over k; elements fall into slots by their hash's top bits. At most k slots differ, so some
  slot's content is the same, and a tile is the band, the slot and a hash of its content. A set belongs to the bands of
  all sizes that its partner's smaller one may have: one or two. Where only empty slots might agree, which needs many
  empty ones, these are tiles too.
* Equal sets are one set from the start: classes by a 128-bit hash, and a task sends each class once.
* Tiles of up to SMALL sets give candidate pairs, which must share as many tiles as a linked pair does at least: all its
  slots but k and those that are empty in both. (A pair with too few may share larger tiles too; it is met there.)
* A set goes on to larger tiles only if it has as many of a band's as it must share with any other set, or lacks no more
  of them in some pair of smaller tiles; those that have a common passage and no more don't.
* In larger tiles each set is first compared with the tile's hub, the member of the most larger tiles. Verified links
  make components. Only tiles that still hold several components go on: what they connect is a group, whose sets are
  compared in blocks, each two once: pairs across components pass if their sizes and bitmaps allow a link. Where
  more than MANY pass in a block, first only each component's likeliest does; once these are verified, a second round
  over the new components lets all pass that weren't verified.
* Of the pairs, each set's with its smallest partner and then each component's are verified first, of the others only those
  between components: sets that are all alike need a link each, not all their pairs.
* Verification works in steps and compares bitmaps first: set bits that the other lacks bound the intersection from above. Only the sets of
  pairs that pass meet, to intersect their sorted arrays of 64-bit n-gram hashes.

Rows of (tile, set) travel packed as arrays: a row a task and partition. A tile that a task meets more than CROWD times
sends the rest of its entries straight on as members, by their sets instead of the tile; joins with a tile's or a
component's one row go by broadcast where many rows carry it. Large groups are split into pairs of blocks of BLOCK
members, so no task holds a whole group's pairs, and worked through in passes, so not all of them are on disk at once. Documents' sets are rebuilt from their texts for suspects alone.

N-grams are compared by 64-bit hashes of their words' 64-bit hashes, and equal sets are told by 128 bits over those.

Null and empty texts, and texts without words, have empty sets and link with nothing. Repeated rows and ids are kept:
each row has its own result. A null id never is a component's id unless all its documents have none. Only the id and
text columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import GOLDEN, blocks, documents, hash_words, hot_join, joined, mix, removed, shuffle_partitions, staged

SEED = 3  # of its word hashes
WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
FLUSH = 1_000_000  # (tile, set) entries that a task holds before it sends them
SEEN = 300_000  # sets that a task remembers as sent
SMALL = 4  # a tile of n sets makes n * (n - 1) / 2 pairs: no more rows than 1.5 times its entries
CROWD = 1024  # entries of a tile, among FLUSH, that go to the tile's part; with a task's sets sent again they hold more than SMALL sets
MANY_EMPTY = 65535  # empty slots of a set, or more
PAIRS = 400_000  # that a task holds before it counts and sends them
BLOCK = 4096
PASS = 8  # blocks of a group whose pairs with all before them are on their way at once: up to 2 * PASS bitmaps a member
MANY = 20_000
STEP = 100_000  # pairs, or more, that are verified at once: what moves is both sets of each
BLOOM_BITS = 1 << 27  # at most: 16 MB
#: From texts to the sorted distinct 64-bit elements of their sets in a row, and each set's bounds.
Sets = Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of all texts in a row, and each text's bounds."""
    buf, at = joined([(x or "").encode("utf-8", "surrogatepass").lower() for x in texts])  # bytes.lower: A-Z only
    starts, _, words = hash_words(buf, WORD, SEED)
    first = np.append(np.searchsorted(starts, at), len(starts)) if len(texts) else np.zeros(1, np.int64)
    grams = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        grams = mix(grams * GOLDEN + words[k : k + len(grams)])
    parts = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = grams[a : b - n + 1]
            own.sort()
            parts.append(own)
        elif b > a:
            whole = words[a : a + 1].copy()
            for k in range(a + 1, b):
                whole = mix(whole * GOLDEN + words[k : k + 1])
            parts.append(mix(whole + np.uint64(b - a)))
        else:
            parts.append(words[:0])
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate([words[:0], *parts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[bounds[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return flat[new], kept[bounds]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Wrapping sums between bounds; 0 for empty ones."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_hashes(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    sizes = np.diff(bounds).astype(np.uint64)
    one = mix(sums(mix(flat * GOLDEN), bounds) + sizes)
    two = mix(sums(mix(flat ^ np.uint64(0xA0761D6478BD642F)), bounds) ^ (sizes * GOLDEN))
    return one, two


class Bands:
    """Which bands, and how many slots, sets have at a threshold of num / den."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the threshold must be over 0 and at most 1")
        self.num, self.den = num, den
        self.powers = 1 << np.arange(40, dtype=np.int64)
        self.most = np.zeros(40, np.int64)  # the largest difference that a band of 2 ** j slots serves
        for j in range(40):
            k = max(0, (2**j - 2) * 16 // 17 - 1)
            while k + 1 + (k + 1) // 16 + 2 <= 2**j:
                k += 1
            self.most[j] = k

    def differ(self, size: np.ndarray) -> np.ndarray:
        return (self.den - self.num) * size // self.num

    def level(self, size: np.ndarray) -> np.ndarray:
        k = self.differ(size)
        return np.searchsorted(self.powers, k + k // 16 + 2)

    def shared(self, size: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """How many filled slots of the smaller set's band two linked sets share at least; empty: the fewer empty slots."""
        level = self.level(size)
        return self.least(size, level, empty)

    def least(self, size: np.ndarray, level: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """How many filled slots of a band a set shares at least with any that it links with there; empty: its own empty
        slots. A smaller partner differs less and a pair has no more empty slots, so no pair needs fewer."""
        return np.where(empty == MANY_EMPTY, 1, np.maximum(1, self.powers[level] - np.minimum(self.differ(size), self.most[level]) - empty))

    def levels(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest band; the highest is -1 where only an equal set could link."""
        least = np.maximum(-(-self.num * size // self.den), -(-self.num // max(1, self.den - self.num)))
        high = np.where(self.differ(size) >= 1, self.level(size), -1)
        return np.minimum(self.level(least), np.maximum(high, 0)), high


def tiles(flat: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each tile that each set belongs to, the set's place and its number of empty slots.

    The last six bits of a hash are the band. Places ascend within a band.
    """
    sizes = np.diff(bounds)
    low, high = bands.levels(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    mixed = mix(flat * np.uint64(0xE7037ED1A0B428DB))
    out, own, free = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for down in range(int((high - low).max(initial=0)) + 1):
        level = np.where(high - down >= low, high - down, -1)
        level[high < 0] = -1
        use = level[doc] > 0
        h, d = flat[use], doc[use]
        if not len(h):
            continue
        slot = h >> (64 - level[d]).astype(np.uint64)
        new = np.ones(len(h), bool)
        new[1:] = (d[1:] != d[:-1]) | (slot[1:] != slot[:-1])
        starts = np.flatnonzero(new)
        d, slot = d[starts], slot[starts]
        key = mix((slot + np.uint64(1)) * GOLDEN + level[d].astype(np.uint64))
        slots = bands.powers[np.maximum(level, 0)]
        empty = slots - np.bincount(d, minlength=len(sizes))
        out.append(_banded(mix(np.add.reduceat(mixed[use], starts) ^ key), level[d]))
        own.append(d)
        free.append(empty[d])
        # sets with so many empty slots that no other may agree
        odd = (level > 0) & (empty >= slots - np.minimum(bands.differ(sizes), bands.most[np.maximum(level, 0)]))
        for i in np.flatnonzero(odd).tolist():
            gaps = np.setdiff1d(np.arange(slots[i], dtype=np.uint64), slot[d == i])
            out.append(_banded(mix(mix((gaps + np.uint64(1)) * GOLDEN + np.uint64(level[i])) ^ np.uint64(0x8EBC6AF09C88C6E3)), level[i]))
            own.append(np.full(len(gaps), i))
            free.append(np.full(len(gaps), empty[i]))
    return np.concatenate(out), np.concatenate(own), np.concatenate(free)


def beyond(tile: np.ndarray, crowd: int) -> np.ndarray:
    """Which entries of a tile come after its first ``crowd`` ones."""
    out = np.zeros(len(tile), bool)
    bucket = (tile >> np.uint64(40)).astype(np.int64) & 0xFFFFF
    many = np.bincount(bucket, minlength=1 << 20) > crowd
    if many.any():
        own = np.flatnonzero(many[bucket])
        order = own[np.argsort(tile[own], kind="stable")]
        new = np.concatenate([[True], tile[order][1:] != tile[order][:-1]])
        place = np.arange(len(order))
        out[order] = place - np.maximum.accumulate(np.where(new, place, 0)) >= crowd
    return out


def _banded(x: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return (x & ~np.uint64(63)) | np.asarray(level).astype(np.uint64)


def bitmap(values: np.ndarray, level: int) -> bytes:
    """32 bits a slot; a shorter map is the OR of a longer one's halves."""
    bits = 32 << max(1, level)
    out = np.zeros(bits, np.uint8)
    out[(values & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint64)
    return np.bitwise_or.reduce(x.reshape(-1, size // 8), axis=0)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def set_table(rows: DataFrame, sets: Sets) -> DataFrame:
    """doc_id, n_shingles and the set's hashes one and two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            flat, bounds = sets(batch.column(1).to_pylist())
            one, two = set_hashes(flat, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), _signed(one), _signed(two)], names=["doc_id", "n_shingles", "one", "two"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, one long, two long")


def shared_tiles(rows: DataFrame, sets: Sets, bands: Bands, parts: int) -> DataFrame:
    """tile, id: members of tiles with more than SMALL sets and how many of their band's tiles they must share with any
    other; tile null, id, other: pairs of sets of smaller tiles, how many of a task's tiles they share and how many they
    must share in all. All with their band."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tile, ids, size, free = (np.concatenate(x) for x in zip(*held, strict=True))
            # entries by part; those of a crowded tile past its first CROWD ones stand after, by their sets' parts
            over = beyond(tile, CROWD)
            part = (np.where(over, ids, tile) >> np.uint64(20)) % np.uint64(parts) * np.uint64(2) + over.astype(np.uint64)
            part = part.astype(np.uint16 if parts < 32768 else np.uint32)
            order = np.argsort(part, kind="stable")
            part, tile, ids, size, free = part[order], tile[order], ids[order], size[order], free[order]
            # rows of a set in a part, of at most 65535 tiles each
            run = np.concatenate([[True], (ids[1:] != ids[:-1]) | (part[1:] != part[:-1]) | (free[1:] != free[:-1])])
            place = np.arange(len(tile))
            run |= (place - np.maximum.accumulate(np.where(run, place, 0))) % 65535 == 0
            cuts = np.searchsorted(part, np.arange(2 * parts + 1))
            columns: list[list] = [[], [], [], [], [], [], []]
            for p in range(2 * parts):
                a, b = cuts[p], cuts[p + 1]
                if a < b:
                    starts = a + np.flatnonzero(run[a:b])
                    data = (ids[starts], np.diff(np.append(starts, b)).astype(np.uint16), size[starts], free[starts], tile[a:b])
                    for c, v in zip(columns, (p // 2, p % 2 == 1, *(x.tobytes() for x in data)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), *[pa.array(c, pa.binary()) for c in columns[2:]]], names=["part", "crowded", "ids", "counts", "sizes", "free", "tiles"])

        for batch in blocks(batches, 0):
            flat, bounds = sets(batch.column(0).to_pylist())
            one, _ = set_hashes(flat, bounds)
            fresh = np.zeros(len(one), bool)
            for i, h in enumerate(one.tolist()):
                if h not in seen:
                    fresh[i] = True
                    seen.add(h)
            if len(seen) > SEEN:
                seen.clear()
            sizes = np.diff(bounds)
            keep = np.repeat(fresh, sizes)
            tile, own, free = tiles(flat[keep], np.concatenate([[0], np.cumsum(sizes[fresh])]), bands)
            held.append((tile, one[fresh][own], sizes[fresh][own].astype(np.uint32), np.minimum(free, MANY_EMPTY).astype(np.uint16)))
            count += len(tile)
            if count >= FLUSH:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[np.empty(0, t)] for t in (np.uint64, np.uint64, np.uint32, np.uint16)]
        names = ["tile", "id", "other", "shared", "least", "band"]

        def as_members(tile: np.ndarray, ids: np.ndarray, size: np.ndarray, free: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(tile), 1 << 16):
                own = slice(a, a + (1 << 16))
                band = (tile[own] & np.uint64(63)).astype(np.int64)
                nulls = pa.nulls(len(band), pa.int64())
                yield pa.RecordBatch.from_arrays([_signed(tile[own]), _signed(ids[own]), nulls, nulls, pa.array(bands.least(size[own].astype(np.int64), band, free[own].astype(np.int64))), pa.array(band)], names=names)

        for batch in batches:
            for crowded, ids, counts, sizes, free, own in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                often = np.frombuffer(counts, np.uint16)
                if crowded:  # the tile's own part has more than SMALL of its sets
                    yield from as_members(np.frombuffer(own, np.uint64), *(np.repeat(np.frombuffer(x, kind), often) for x, kind in ((ids, np.uint64), (sizes, np.uint32), (free, np.uint16))))
                    continue
                columns[0].append(np.frombuffer(own, np.uint64))
                for c, data, kind in zip(columns[1:], (ids, sizes, free), (np.uint64, np.uint32, np.uint16), strict=True):
                    c.append(np.repeat(np.frombuffer(data, kind), often))
        tile, ids, size, free = map(np.concatenate, columns)
        del columns
        order = np.argsort(tile, kind="stable")
        tile = tile[order]
        again = np.zeros(len(tile) + 1, bool)
        if len(tile):
            again[1:-1] = tile[1:] == tile[:-1]
        several = again[1:] | again[:-1]
        order, tile = order[several], tile[several]
        ids, size, free = ids[order], size[order].astype(np.int64), free[order].astype(np.int64)
        order = np.lexsort((ids, tile))
        tile, ids, size, free = tile[order], ids[order], size[order], free[order]
        new = np.ones(len(tile), bool)
        if len(tile):
            new[1:] = (tile[1:] != tile[:-1]) | (ids[1:] != ids[:-1])
        tile, ids, size, free = tile[new], ids[new], size[new], free[new]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(tile)), bool), tile[1:] != tile[:-1]]))
        counts = np.diff(np.append(starts, len(tile)))
        held: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            pairs = np.concatenate(held)
            held.clear()
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            at = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]))
            often, pairs = np.diff(np.append(at, len(pairs))), pairs[at]
            for k in range(0, len(pairs), 1 << 16):
                part = pairs[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), _signed(part[:, 0]), _signed(part[:, 1]), pa.array(often[k : k + (1 << 16)]), _signed(part[:, 2]), _signed(part[:, 3])], names=names)

        for n in range(2, SMALL + 1):
            every = starts[counts == n]
            for first in (every[k : k + PAIRS // 8] for k in range(0, len(every), PAIRS // 8)):
                band = (tile[first] & np.uint64(63)).astype(np.int64)
                for i, j in itertools.combinations(range(n), 2):
                    p, q = first + i, first + j
                    small, large = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
                    # a pair is held to what it shares in the smaller one's band
                    good = (bands.den * small >= bands.num * large) & (bands.level(small) == band)
                    p, q, small = p[good], q[good], small[good]
                    least = bands.shared(small, np.minimum(free[p], free[q]))
                    held.append(np.stack([ids[p].view(np.int64), ids[q].view(np.int64), least, band[good]], axis=1))
                    if sum(map(len, held)) > PAIRS:
                        yield from counted()
        if held:
            yield from counted()
        more = np.repeat(counts > SMALL, counts)
        yield from as_members(tile[more], ids[more], size[more], free[more])

    sent = rows.select("text").mapInArrow(send, "part int, crowded boolean, ids binary, counts binary, sizes binary, free binary, tiles binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(meet, "tile long, id long, other long, shared long, least long, band long")


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of column key with two probes, at most BLOOM_BITS long: only these words reach the driver."""
    n = ids.count()
    bits = min(BLOOM_BITS, 1 << max(10, int(n * 12).bit_length()))
    probe = lambda c: F.struct(F.shiftrightunsigned(F.pmod(c, F.lit(bits)), 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int")).alias("bit"))
    words = ids.select(F.explode(F.array(probe(F.col("key")), probe(F.shiftright("key", 32)))).alias("x")).groupBy("x.word").agg(F.bit_or("x.bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)

    for batch in words.toArrow().to_batches():
        out[np.asarray(batch.column(0))] = np.asarray(batch.column(1))
    return out.view(np.uint64)


def probed(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys the Bloom filter may hold."""
    bits = np.int64(len(table) * 64)
    hit = np.ones(len(key), bool)
    for k in (key, key >> 32):
        hit &= (table[np.mod(k, bits) >> 6] >> (np.mod(k, 64)).astype(np.uint64)) & np.uint64(1) == 1
    return hit


def suspects(rows: DataFrame, classes: DataFrame, ids: DataFrame, sets: Sets, bands: Bands) -> DataFrame:
    """id, two, size, items (sorted hashes) and bits of every set whose id is in ids, maybe of a few others.

    One document a set is worked on; a Bloom filter of those documents spares the others' texts a shuffle.
    """
    chosen = classes.join(ids, classes["one"] == ids["id"], "left_semi")
    spark = rows.sparkSession
    words = spark.sparkContext.broadcast(bloom(chosen.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = probed(words.value, np.asarray(batch.column(1)))
            if not hit.any():
                continue
            for part in blocks(iter([batch.filter(pa.array(hit))]), 0):
                flat, bounds = sets(part.column(0).to_pylist())
                one, two = set_hashes(flat, bounds)
                sizes = np.diff(bounds)
                level = bands.levels(sizes)[1]
                items = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([_signed(one), _signed(two), pa.array(sizes), pa.array([x.tobytes() for x in items], pa.binary()), pa.array([bitmap(x, j) for x, j in zip(items, level.tolist(), strict=True)], pa.binary())], names=["id", "two", "size", "items", "bits"])

    return staged(rows.select("text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "id long, two long, size long, items binary, bits binary"), "suspects")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, alike: Callable[[np.ndarray, np.ndarray], bool] | None = None) -> DataFrame:
    """pairs (a, b) with their hashes two, where the sets link: bit counts first, then the sorted arrays, by ``alike``
    if it is given.

    The joins are sort-merge joins at every size; Bloom filters of the pairs that pass the bit counts keep other sets from
    moving. Pairs are worked through in steps of STEP, and not more than 64 of them, so only one step's sets are on their way.
    """
    pairs = staged(pairs.select("a", "b"), "pairs")
    steps = max(1, min(64, -(-pairs.count() // STEP)))
    found = [staged(_verified(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(steps)) == k), sets, num, den, alike), "links") for k in range(steps)]
    removed(pairs)
    return reduce(DataFrame.unionAll, found)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, alike: Callable[[np.ndarray, np.ndarray], bool] | None) -> DataFrame:
    def with_sets(rows: DataFrame, own: dict[str, DataFrame], *columns: str) -> DataFrame:
        for x in "ba":
            rows = rows.join(own[x].select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", *columns)]).hint("merge"), F.col(x) == F.col(f"id_{x}"))
        return rows.select("a", "b", *[f"{c}_{k}" for c in columns for k in "ab"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (s, t, p, q) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)):
                size = min(len(p), len(q))
                c, d = folded(p, size), folded(q, size)
                bound = min(s - int(np.bitwise_count(c & ~d).sum()), t - int(np.bitwise_count(d & ~c).sum()))
                keep[i] = den * bound >= num * (s + t - bound)
            if keep.any():
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    def needed(rows: DataFrame, column: str, *columns: str) -> DataFrame:
        """The sets that stand in a column of the rows, maybe a few others."""
        words = pairs.sparkSession.sparkContext.broadcast(bloom(rows.select(F.col(column).alias("key")).distinct()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = probed(words.value, np.asarray(batch.column(0)))
                if hit.any():
                    yield batch.filter(pa.array(hit))

        own = sets.select("id", *columns)
        return own.mapInArrow(run, own.schema)

    rows = staged(with_sets(pairs, {x: needed(pairs, x, "size", "bits") for x in "ab"}, "size", "bits").mapInArrow(likely, "a long, b long"), "likely")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if alike is not None:
                    keep[i] = alike(u, v)
                    continue
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int((v[at] == u).sum())
                keep[i] = den * both >= num * (len(u) + len(v) - both)
            if keep.any():
                yield batch.select(["a", "b", "two_a", "two_b"]).filter(pa.array(keep))

    return with_sets(rows, {x: needed(rows, x, "two", "items") for x in "ab"}, "two", "items").mapInArrow(linked, "a long, b long, two_a long, two_b long")


def spanning(pairs: DataFrame, sets: DataFrame, num: int, den: int, alike: Callable[[np.ndarray, np.ndarray], bool] | None) -> tuple[DataFrame, DataFrame]:
    """Links among the pairs, as many as make the components that all links make, and these (node, root).

    Of many sets that are all alike, each needs one link. So first each set's pair with its smallest partner is verified,
    then each component's with the smallest one; of the others only those between different components.
    """
    links, left, labels = [], pairs, None
    for last in (False, False, True):
        if labels is not None:
            for x in "ab":
                left = left.join(labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
            left = left.select("a", "b", F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).where("x <> y")
            left = staged(left.join(one, ["a", "b"], "left_anti").select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), "pairs")
            if left.isEmpty():
                break
        else:
            left = left.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"))
        one = left.select("a", "b") if last else staged(left.groupBy("y").agg(F.min(F.struct("x", "a", "b")).alias("p")).select("p.a", "p.b"), "pairs")
        links.append(verified(one, sets, num, den, alike))
        left = left.select("a", "b")
        labels = components(reduce(DataFrame.unionAll, links), "a", "b")
    return reduce(DataFrame.unionAll, links), labels


def by_set(met: DataFrame, small: DataFrame) -> DataFrame:
    """id and all its large tiles that a link may need: what is joined by id is a row a set instead of a row an entry.

    A pair that small tiles don't give shares large ones of its band. If it shares none but these, both sets have at least
    as many as they must share; else the pair is in ``small``, and both have at least as many as it lacks. Sets that merely
    share a passage have a few tiles of that passage alone, and go here.
    """
    members = met.where("tile is not null").repartition("id").groupBy("id", "band").agg(F.collect_set("tile").alias("tiles"), F.min("least").alias("least"))
    members = staged(members, "members")
    has = lambda x: members.select(F.col("id").alias(x), F.col("band").alias(f"band_{x}"), F.size("tiles").alias(f"n_{x}"))
    some = small.where("shared < least").withColumn("lacks", F.col("least") - F.col("shared"))
    for x in "ab":
        some = some.join(has(x), x).where(f"band = band_{x} and n_{x} >= lacks").drop(f"band_{x}", f"n_{x}")
    some = some.select(F.explode(F.array("a", "b")).alias("id"), "band").distinct()
    enough = F.size("tiles") >= F.col("least")
    kept = members.where(enough).unionByName(members.where(~enough).join(some, ["id", "band"], "left_semi").select(members.columns))
    packed = staged(kept.groupBy("id").agg(F.flatten(F.collect_list("tiles")).alias("tiles")), "members")
    removed(members)
    return packed


def hub_pairs(packed: DataFrame, total: int) -> DataFrame:
    """Each member of a tile with the tile's hub: the member of the most large tiles."""
    famed = packed.select("id", F.size("tiles").alias("fame"), F.explode("tiles").alias("tile"))
    hubs = famed.groupBy("tile").agg(F.max(F.struct("fame", "id"))["id"].alias("hub"), F.count("*").alias("n"))
    return hot_join(famed.select("id", "tile"), hubs, "tile", total).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def crossed(packed: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """id, component and hub (the tile's smallest member): members of tiles that hold several components."""
    known = packed.join(labels, F.col("id") == F.col("node"), "left")
    named = known.select("id", F.coalesce("root", "id").alias("component"), F.explode("tiles").alias("tile"))
    mixed = named.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("hub"), F.count("*").alias("n")).where("lo < hi").select("tile", "hub", "n")
    return hot_join(named, mixed, "tile", total).select("id", "component", "hub").distinct()


def group_pairs(crossing: DataFrame, sets: DataFrame, num: int, den: int, many: int | None) -> DataFrame:
    """Pairs (a, b) across components within a group that sizes and bitmaps let through, and whether others were left
    out (cut): where more than many pass in a pair of blocks, each component's likeliest stands for them.

    crossing: of ``crossed``. A group is what tiles with several components connect.
    """
    groups = components(crossing, "id", "hub").select(F.col("node").alias("id"), F.col("root").alias("group"))
    named = crossing.select("id", "component").distinct().join(groups, "id")
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    rows = hot_join(named, sizes, "group", groups.count()).withColumn("g", ((F.col("n") + BLOCK - 1) / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    rows = rows.join(sets.select("id", "size", "bits").dropDuplicates(["id"]), "id")
    most = -(-(sizes.agg(F.max("n")).first()[0] or 1) // BLOCK)
    if most > PASS:
        rows = staged(rows, "blocks")

    def paired(first: int) -> DataFrame:
        """A group of g blocks is worked through as pairs of blocks; a member goes to the g pairs of its block. Those of one
        pass, whose second block is among the PASS from the first."""
        pairs = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("group", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "id", "component", "size", "bits")
        if most > PASS:
            pairs = pairs.where(F.col("y").between(first, first + PASS - 1))
        return pairs.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")

    def compare(group: pa.Table) -> Iterator[tuple[np.ndarray, bool]]:
        """Pairs that pass, in batches; what is held is one batch and, with many, a pair a component."""
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        group = group.take(pa.array(np.argsort(np.asarray(group["size"].combine_chunks()), kind="stable")))
        own, ids, component, size = (np.asarray(group[c].combine_chunks()) for c in ("own", "id", "component", "size"))
        data = group["bits"].to_pylist()
        widths = np.fromiter(map(len, data), np.int64, len(data))
        held: list[np.ndarray] = []
        count, cut = 0, False
        best: dict[int, tuple[float, int, int]] = {}
        for width in np.unique(widths).tolist():
            # the smaller set of a pair has this width; larger sets' maps are folded to it, so no map is overfull
            most = den * int(size[widths == width].max()) // num
            pick = np.flatnonzero((widths >= width) & (size <= most))
            bits = np.stack([folded(data[k], width) for k in pick])
            for at in np.flatnonzero(widths[pick] == width).tolist():
                i = pick[at]
                rest = np.arange(at + 1, len(pick))
                other = pick[rest]
                good = (component[other] != component[i]) & (num * size[other] <= den * size[i])
                if x != y:
                    good &= own[other] != own[i]
                rest, other = rest[good], other[good]
                if not len(other):
                    continue
                there = bits[rest]
                bound = np.minimum(size[i] - np.bitwise_count(bits[at] & ~there).sum(axis=1, dtype=np.int64), size[other] - np.bitwise_count(there & ~bits[at]).sum(axis=1, dtype=np.int64))
                union = size[i] + size[other] - bound
                may = den * bound >= num * union
                if not may.any():
                    continue
                pairs = np.sort(np.stack([np.full(int(may.sum()), ids[i]), ids[other[may]]], axis=1), axis=1)
                if many is not None:
                    for like, c, pair in zip((bound[may] / union[may]).tolist(), component[other[may]].tolist(), pairs.tolist(), strict=True):
                        for k in (int(component[i]), c):
                            best[k] = max(best.get(k, (-1.0, 0, 0)), (like, *pair))
                if cut:
                    continue
                held.append(pairs)
                count += len(pairs)
                if many is not None and count > many:
                    held, count, cut = [], 0, True
                elif many is None and count > 1 << 16:
                    yield np.concatenate(held), False
                    held, count = [], 0
        if cut:
            yield np.array(list(dict.fromkeys(v[1:] for v in best.values())), np.int64), True
        elif held:
            yield np.concatenate(held), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group: pa.Table) -> Iterator[pa.RecordBatch]:
            for found, cut in compare(group):
                yield pa.RecordBatch.from_arrays([_signed(found[:, 0]), _signed(found[:, 1]), pa.array(np.full(len(found), cut))], names=["a", "b", "cut"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[a].tolist())
                if held and key != last:
                    yield from out(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from out(pa.Table.from_batches(held))

    through = lambda first: paired(first).mapInArrow(run, "a long, b long, cut boolean")
    if most <= PASS:
        return through(0)
    found = [staged(through(first), "pairs") for first in range(0, most, PASS)]
    removed(rows)
    return reduce(DataFrame.unionAll, found)


def jaccard_components(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach."""
    return set_components(df, lambda texts: shingles(texts, n), num, den, id_col, text_col)


def set_components(df: DataFrame, cut: Sets, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", alike: Callable[[np.ndarray, np.ndarray], bool] | None = None) -> DataFrame:
    """The same over any sets of 64-bit hashes that ``cut`` makes of texts; ``alike`` is the link's test in other words."""
    spark = df.sparkSession
    bands, parts = Bands(num, den), shuffle_partitions(spark)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = staged(set_table(rows, cut), "sets")
    words = table.where("n_shingles > 0")
    # of each class of equal sets its smallest id, its size and a document: pre-aggregated, for it may hold a third of all
    classes = staged(words.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min(F.xxhash64("doc_id")).alias("key")), "classes")
    met = staged(shared_tiles(rows, cut, bands, parts), "tiles")
    # ids ascend within a tile, so a pair is the same way round in each
    small = staged(met.where("tile is null").groupBy(F.col("id").alias("a"), F.col("other").alias("b"), "band").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")), "small")
    large = packed = by_set(met, small)
    removed(met)
    total = packed.agg(F.sum(F.size("tiles"))).first()[0] or 0
    hubs = hub_pairs(packed, total).distinct()
    tried = staged(small.where("shared >= least").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionAll(hubs).distinct(), "pairs")
    removed(small)
    sets = suspects(rows, classes, tried.select(F.col("a").alias("id")).unionAll(tried.select("b")).unionAll(packed.select("id")).distinct(), cut, bands)
    links, labels = spanning(tried, sets, num, den, alike)
    for many in (MANY, None):
        crossing = staged(crossed(packed, labels, total), "crossing")
        if crossing.isEmpty():
            break
        # tiles that hold one component stay so: the next round looks at these members alone, a tile by its hub
        packed, total = crossing.groupBy("id").agg(F.collect_set("hub").alias("tiles")), crossing.count()
        met_again = staged(group_pairs(crossing, sets, num, den, many), "pairs")
        again = not met_again.where("cut").isEmpty()
        more = staged(met_again.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            if again:
                continue
            break
        found = verified(more, sets, num, den, alike)
        tried, links = tried.unionAll(more), links.unionAll(found)
        if not found.isEmpty():
            labels = components(links, "a", "b")
        if not again:
            break
    removed(large, sets)
    # nodes by both hashes, so that a document with half of another's hash isn't taken for it
    nodes = links.select(F.col("a").alias("one"), F.col("two_a").alias("two")).unionAll(links.select("b", "two_b")).distinct()
    linked = classes.join(nodes, ["one", "two"]).join(labels, F.col("one") == F.col("node")).select("one", "two", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("one", "two", "least")
    named = classes.join(linked, ["one", "two"], "left").select("one", "two", "n", F.coalesce("least", "first").alias("component"))
    found = hot_join(words, named, ["one", "two"], table.count()).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return found.unionAll(table.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), n=4, num=85, den=100)


def oracle(n: int = 4, num: int = 85, den: int = 100) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""with recursive
 w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
 s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < {n} then [array_to_string(ws, ' ')]
   else list_distinct(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) end as g from w),
 e as (select doc_id, len(g) as size, unnest(g) as g from s),
 l as (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id < b.doc_id
   group by a.doc_id, b.doc_id, a.size, b.size having {den} * count(*) >= {num} * (a.size + b.size - count(*))),
 bi as (select a, b from l union all select b, a from l),
 r(doc_id, c) as (select doc_id, doc_id from documents union select bi.b, r.c from r join bi on r.doc_id = bi.a where r.c < bi.b)
 select s.doc_id, cast(len(g) as bigint) as n_shingles, min(r.c) as component_id from s join r on s.doc_id = r.doc_id group by s.doc_id, g"""
