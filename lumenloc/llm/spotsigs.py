"""Document fingerprints: SpotSigs.

A signature is a common word (the anchor) with the chain of the next CHAIN content words after it; a document's
fingerprint is its set of distinct signatures. ``op6_spotsigs`` compares each text with its edited form and its
neighbour: likenesses in full, and whether they're near copies by length partition and pruned Jaccard. ``near_classes`` finds all pairs at the threshold and joins them to classes: sets are partitioned by length,
as only sets whose lengths are within the threshold's ratio can be alike, and compared by Jaccard with pruning: the
lengths bound the likeness from above, and the intersection stops once the rest can't reach the threshold. Its
partitions are the size bands of the n-gram join, whose tiles say which sets of neighbouring lengths meet, without loss,
and which splits hot groups into blocks.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, in lower case. The last anchors of a
text, with fewer than CHAIN content words after them, chain what is left. In a stretch of more than GAP words without an
anchor each further word acts as one, so text without common words has signatures too, and an edit elsewhere doesn't
change them. A text without any signature but with words has the chains of all its words; a text without words, a null
or empty one, has the empty fingerprint, and two empty fingerprints have likeness 1, an empty and another 0.

As text, a fingerprint is the base64 form of its sorted 32-bit signatures. Repeated rows are kept; ids that repeat are
ordered by their texts' hashes; other columns are not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngram_join import set_components
from .shared import GOLDEN, blocks, documents, hash_words, joined, mix, shuffle_partitions

CHAIN = 2
GAP = 8
#: Very common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is it that was for on with be as by this are or at from a an "
    "der die das und zu den mit von ist im sich nicht ein eine auf auch als "
    "le la les des du et en un une que qui dans pour par est au pas "
    "el los las y del se por con para su lo no una de"
).split()
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
SEED = 6  # of its word hashes


def _anchors() -> np.ndarray:
    buf, _ = joined([x.encode() for x in ANCHORS])
    return np.unique(hash_words(buf, WORD, SEED)[2])


ANCHOR_HASHES = _anchors()


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of each text."""
    buf, at = joined([x.lower().encode("utf-8", "surrogatepass") for x in texts])
    starts, _, words = hash_words(buf, WORD, SEED)
    doc = np.searchsorted(at, starts, "right") - 1
    where = np.searchsorted(ANCHOR_HASHES, words)
    is_anchor = ANCHOR_HASHES[np.minimum(where, len(ANCHOR_HASHES) - 1)] == words
    place = np.arange(len(words))
    new = np.diff(doc, prepend=-1) != 0
    last = np.where(is_anchor | new, place, 0)
    np.maximum.accumulate(last, out=last)
    anchors, content = np.flatnonzero(is_anchor | (place - last > GAP)), np.flatnonzero(~is_anchor)
    content_doc = np.append(doc[content], np.full(CHAIN, -1))
    content_word = np.append(words[content], np.zeros(CHAIN, np.uint64))
    following = np.searchsorted(content, anchors, "right")
    value, own, any_word = words[anchors].copy(), doc[anchors], np.zeros(len(anchors), bool)
    for k in range(CHAIN):
        same = content_doc[following + k] == own
        any_word |= same
        value = mix(value * GOLDEN + np.where(same, content_word[following + k], np.uint64(k)))
    value, own = (value[any_word] >> np.uint64(32)).astype(np.uint32), own[any_word]
    bounds = np.searchsorted(own, np.arange(len(texts) + 1))
    word_bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        part = np.unique(value[bounds[i] : bounds[i + 1]])
        if not len(part) and word_bounds[i] < word_bounds[i + 1]:
            own_words = np.append(words[word_bounds[i] : word_bounds[i + 1]], np.zeros(CHAIN, np.uint64))
            size = len(own_words) - CHAIN
            chain = own_words[:size].copy()
            for k in range(1, CHAIN + 1):
                chain = mix(chain * GOLDEN + own_words[k : k + size])
            part = np.unique((chain >> np.uint64(32)).astype(np.uint32))
        out.append(part)
    return out


def shown(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard of two fingerprints; 0 as soon as it can't reach the threshold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    shared, step = 0, max(256, len(a) // 8) if threshold else len(a)
    for i in range(0, len(a), step):
        part = a[i : i + step]
        at = np.searchsorted(b, part)
        shared += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        left = len(a) - min(len(a), i + step)
        if (shared + left) < threshold * (len(a) + len(b) - shared - left):
            return 0.0
    return shared / (len(a) + len(b) - shared)


def near(a: np.ndarray, b: np.ndarray, threshold: float = 0.8) -> bool:
    """Whether two fingerprints are near copies: only those of neighbouring length partitions are compared, pruned."""
    (p, q), (s, t) = length_partition(len(a), threshold), length_partition(len(b), threshold)
    return p <= t and s <= q and likeness(a, b, threshold) >= threshold


def length_partition(size: int, threshold: float) -> tuple[int, int]:
    """The first and the last partition in which a set of this size may meet a partner; a set lives in its first one.

    Partition k holds sizes from threshold ** -k on; partners' sizes differ by less than one partition's width, so
    comparing neighbours loses nothing.
    """
    if size <= 0:
        return 0, 0
    k = 0 if threshold >= 1 else int(np.floor(np.log(size) / -np.log(threshold) + 1e-9))
    return k, k + 1


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, signatures (array of int, sorted as unsigned), length_partition. Row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = fingerprints([x or "" for x in batch.column(1).to_pylist()])
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.uint32), *found]).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([length_partition(len(x), threshold)[0] for x in found], pa.int32())], names=["doc_id", "signatures", "length_partition"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, signatures array<int>, length_partition int")


def signature_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints in a row, their signatures spread over 64 bits one to one, and each one's bounds."""
    parts = [np.sort(mix(x.astype(np.uint64) * GOLDEN)) for x in fingerprints([x or "" for x in texts])]
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)])


def near_classes(df: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_signatures, class_id: the smallest id that pairs of likeness num / den or more reach.

    A row a row of df; a null id is a class's only if it has no other. Empty fingerprints are one class.
    """
    threshold = num / den
    out = set_components(df, signature_sets, num, den, id_col, text_col, lambda a, b: likeness(a, b, threshold) >= threshold)
    out = out.select("doc_id", F.col("n_shingles").alias("n_signatures"), F.col("component_id").alias("class_id"))
    empty = F.broadcast(out.where("n_signatures = 0").agg(F.min("doc_id").alias("empty")))
    return out.crossJoin(empty).select("doc_id", "n_signatures", F.when(F.col("n_signatures") == 0, F.col("empty")).otherwise(F.col("class_id")).alias("class_id"))


def with_next(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (doc_id, text) by descending doc_id with the next one's text; the last is followed by the first.

    Rows move once, to ranges of the order. Each range also gets a copy of the row that follows it, so a task needs no
    other task's rows and keeps one row back. Bounds are approximate quantiles of the id, which must be a number: as
    many as there are parts. Rows of an id, or of none, that are more than a part are split by the hash of their text;
    only rows alike in both stay together.
    """
    spark = df.sparkSession
    n = parts or shuffle_partitions(spark)
    df = df.select("doc_id", "text")
    if not isinstance(df.schema["doc_id"].dataType, T.NumericType):
        raise TypeError("doc_id must be a number")
    # the order's key: ids descending, nulls last, ties by hash
    keyed = df.withColumn("tie", F.xxhash64("text"))
    found = sorted(df.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n), reverse=True) if n > 1 else []
    cuts = sorted(set(found), reverse=True)
    rows, nulls = df.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()

    def search(lo: int, hi: int) -> Column:
        """How many of cuts[lo:hi] aren't under the id, plus lo: by halves."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= F.lit(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    # ids over cuts[0] are in range 0, those from cuts[0] down to above cuts[1] in range 1, ...; nulls come last. An id
    # that is several cuts, and nulls, are so many rows that they are split further, by their ties
    split = [0, *[found.count(c) - 1 for c in cuts], max(0, math.ceil(n * nulls / max(1, rows)) - 1)]
    base = [sum(split[:k]) + k for k in range(len(split))]
    of = lambda values, at: F.get(F.array(*map(F.lit, values)), at)
    number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(search(0, len(cuts)))
    keyed = keyed.withColumn("range", number)
    own = F.col("doc_id").isNull() | (F.col("doc_id") == of([None, *cuts, None] if cuts else [None, None], F.col("range")).cast(df.schema["doc_id"].dataType))
    step = F.floor((F.lit(float(2**63 - 1)) - F.col("tie")) / float(2**64) * (of(split, F.col("range")) + 1)).cast("int")
    part = of(base, F.col("range")) + F.when(of(split, F.col("range")) == 0, 0).when(F.coalesce(own, F.lit(False)), F.least(F.greatest(step, F.lit(0)), of(split, F.col("range")))).otherwise(of(split, F.col("range")))
    keyed = keyed.withColumn("part", part).drop("range")
    parts_in_all = base[-1] + split[-1] + 1
    # each part's first row in the order: a row a part
    first = keyed.groupBy("part").agg(F.max_by(F.struct("doc_id", "tie"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")).alias("first")).orderBy("part").collect()
    if not first:
        return df.withColumn("next", F.col("text"))
    by_part = {r.part: (r.first.doc_id, r.first.tie, first[i - 1].part) for i, r in enumerate(first)}
    listed = [by_part.get(p, (None, None, None)) for p in range(parts_in_all)]
    told = lambda k, kind: F.get(F.array(*[F.lit(x[k]) for x in listed]).cast(f"array<{kind}>"), F.col("part"))
    # a part gets the next part's first row as its tail; repeats of that row are cut to one when they are read
    is_first = F.col("doc_id").eqNullSafe(told(0, df.schema["doc_id"].dataType.simpleString())) & (F.col("tie") == told(1, "bigint"))
    slot = lambda part, tail: F.struct(part.alias("part"), F.lit(tail).alias("tail"))
    slots = F.explode(F.when(is_first, F.array(slot(F.col("part"), 0), slot(told(2, "int"), 1))).otherwise(F.array(slot(F.col("part"), 0))))
    keyed = keyed.select("doc_id", "text", "tie", slots.alias("slot"))
    rows = keyed.select("doc_id", "text", "tie", F.col("slot.part").alias("part"), F.col("slot.tail").alias("tail"))
    rows = rows.repartitionById(parts_in_all, F.col("part")).sortWithinPartitions("part", "tail", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str | None] | None = None
        ended = False
        for batch in blocks(batches):
            ids, texts, tail = (batch.column(i).to_pylist() for i in (0, 1, 2))
            out_ids, out_texts, out_next = [], [], []
            for i, t, last in zip(ids, texts, tail, strict=True):
                if ended:
                    break
                if held is not None:
                    out_ids.append(held[0])
                    out_texts.append(held[1])
                    out_next.append(t)
                held, ended = (i, t), bool(last)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, batch.schema.field(0).type), pa.array(out_texts, pa.string()), pa.array(out_next, pa.string())], names=["doc_id", "text", "next"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "tail").mapInArrow(pair, f"doc_id {kind}, text string, next string")


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            following = [x or "" for x in batch.column(2).to_pylist()]
            changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
            own, other, after = fingerprints(texts), fingerprints(changed), fingerprints(following)
            columns = {
                "doc_id": batch.column(0), "n_chars": pa.array(list(map(len, texts)), pa.int64()), "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                "fingerprint": pa.array(list(map(shown, own))), "edited_fingerprint": pa.array(list(map(shown, other))),
                "near_edited": pa.array([likeness(a, b) for a, b in zip(own, other, strict=True)], pa.float64()), "near_next": pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
                "length_partition": pa.array([length_partition(len(x), 0.8)[0] for x in own], pa.int32()), "copies_edited": pa.array([near(a, b) for a, b in zip(own, other, strict=True)]), "copies_next": pa.array([near(a, b) for a, b in zip(own, after, strict=True)]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return with_next(documents(spark, sf_dir)).mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_partition int, copies_edited boolean, copies_next boolean")


def op6_spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
