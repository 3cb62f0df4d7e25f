"""Best-fit packing under conflicts.

Documents fill bins of ``capacity`` tokens. Two pieces conflict, and never share a bin, if they have the same source or
the same duplicate cluster; bins carry bitmaps of both. Items come longest first, ties by id. Bins are ordered by what is left in them: a
successor search starts at the item's length and goes on, over bins whose bitmaps conflict, to the tightest compatible
bin (the oldest of equals); without one a new bin opens. The order is a tree over the residual lengths whose nodes keep
the intersection of the bitmaps below, so a range where every bin conflicts is passed at once.

A document longer than a bin is cut into full bins and a rest. Packing is sequential by nature, so documents are dealt
into shards of about ``shard_items`` by a hash of their id and text, which no source, cluster or repeated id can skew;
each shard is packed on its own, and their number grows with the input. Rows that are alike in all of this are counted
first and dealt in lots, so a row that comes very often is no hot key either. Only ids, lengths, sources and hashes
move, never texts.

Lengths are words (maximal runs of characters other than white space) plus one for the end mark, so a null or empty
text has length 1. A null source or cluster conflicts with nothing. Repeated rows are packed as often as they come; ties
of repeated ids keep any order, which changes nothing as such rows are alike in what is returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, shuffle_partitions

CAPACITY = 2048
SHARD_ITEMS = 20_000
ALL = -1


class Bins:
    """Open bins of one shard, found by what is left in them."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity.bit_length())
        # intersections of bitmaps; bit 0 marks a range without bins
        self.sources = [ALL] * (2 * self.leaves)
        self.clusters = [ALL] * (2 * self.leaves)
        self.bins: list[dict[int, tuple[int, int]]] = [{} for _ in range(self.leaves)]
        self.counts: list[tuple[dict[int, int], dict[int, int]]] = [({}, {}) for _ in range(self.leaves)]

    def _count(self, left: int, masks: tuple[int, int], by: int) -> None:
        """Bits that all bins of the leaf have make its intersection."""
        size = len(self.bins[left])
        for table, mask, tree in zip(self.counts[left], masks, (self.sources, self.clusters), strict=True):
            while mask:
                bit = mask & -mask
                table[bit] = table.get(bit, 0) + by
                if not table[bit]:
                    del table[bit]
                mask ^= bit
            node = self.leaves + left
            tree[node] = sum(b for b, n in table.items() if n == size) if size else ALL
            node >>= 1
            while node:
                new = tree[2 * node] & tree[2 * node + 1]
                if tree[node] == new:
                    break
                tree[node] = new
                node >>= 1

    def put(self, number: int, left: int, source: int, cluster: int) -> None:
        self.bins[left][number] = (source, cluster)
        self._count(left, (source, cluster), 1)

    def take(self, number: int, left: int) -> tuple[int, int]:
        masks = self.bins[left].pop(number)
        self._count(left, masks, -1)
        return masks

    def find(self, need: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Bin and residual: the smallest residual of at least need with a compatible bin."""
        own = (source | 1, cluster | 1)
        stack = [(1, 0, self.leaves)]
        while stack:
            node, lo, size = stack.pop()
            if lo + size <= need or self.sources[node] & own[0] or self.clusters[node] & own[1]:
                continue
            if size == 1:
                if hits := [k for k, (s, c) in self.bins[lo].items() if not (s & source or c & cluster)]:
                    return min(hits), lo
                continue
            half = size // 2
            stack.append((2 * node + 1, lo + half, half))
            stack.append((2 * node, lo, half))
        return None


def bits(values: list, least: int) -> list[int]:
    """A bit, from 1 on, for each value that occurs at least that often; 0 for others and nulls."""
    counts: dict = {}
    for v in values:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    place = {v: 1 << (i + 1) for i, v in enumerate(v for v, n in counts.items() if n >= least)}
    return [place.get(v, 0) for v in values]


def pack(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Items in their order as (bin, item, piece, start in the document, length, start in the bin)."""
    source, cluster = bits(sources, 2), bits(clusters, 2)
    out, pieces, number = [], [], 0
    for i, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((number, i, k, k * capacity, capacity, 0))
            number += 1
        if rest := n % capacity:
            pieces.append((rest, i))
    pieces.sort(key=lambda x: -x[0])
    bins = Bins(capacity)
    for n, i in pieces:
        start = lengths[i] - n
        if (found := bins.find(n, source[i], cluster[i])) is None:
            home, left, masks = number, capacity, (0, 0)
            number += 1
        else:
            home, left = found
            masks = bins.take(home, left)
        out.append((home, i, start // capacity, start, n, capacity - left))
        if left > n:
            bins.put(home, left - n, masks[0] | source[i], masks[1] | cluster[i])
    return out


def pack_documents(df: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """bin_id, doc_id, piece, doc_start, n_tokens, bin_start. Without cluster_col, equal texts are a cluster."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.col(cluster_col) if cluster_col else F.when(F.length(text) > 0, text)
    shards = max(1, math.ceil(df.count() / shard_items))
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("cluster"),
        (F.regexp_count(text, F.lit(r"\S+")) + 1).cast("long").alias("n"), F.xxhash64(F.col(id_col), text).alias("own"),
    )
    lot = max(1, shard_items // 4)
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.ceil(F.col("copies") / lot) - 1)))
    rows = rows.withColumn("copies", F.least(F.lit(lot), F.col("copies") - F.col("lot") * lot)).withColumn("shard", F.pmod(F.xxhash64("own", "lot"), F.lit(shards))).drop("lot", "own")
    # shards are little data and much work: their tasks aren't merged by size
    rows = rows.repartition(min(shards, 4 * shuffle_partitions(df.sparkSession)), "shard")

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(len(table)), table["copies"].to_numpy())))
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("cluster", "ascending")])
        columns = {c: table[c].to_pylist() for c in ("n", "source", "cluster")}
        placed = np.array(pack(columns["n"], columns["source"], columns["cluster"], capacity), np.int64).reshape(-1, 6)
        first = table["shard"][0].as_py() << 32
        arrays = [pa.array(placed[:, 0] + first), table["doc_id"].combine_chunks().take(pa.array(placed[:, 1])), *[pa.array(placed[:, k]) for k in range(2, 6)]]
        return pa.Table.from_arrays(arrays, names=["bin_id", "doc_id", "piece", "doc_start", "n_tokens", "bin_start"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.groupBy("shard").applyInArrow(run, f"bin_id long, doc_id {kind}, piece long, doc_start long, n_tokens long, bin_start long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
