"""Connected components of a table of links between longs.

Up to LOCAL links, 16 MB, are worked through by one task. More take alternating large and small stars: each round first
contracts what a task reads to the stars of its own components, without a shuffle, then takes two grouped minima,
pre-aggregated before they move, and two joins of links with their nodes' minima. Rounds are written to the shared
folder, so no lineage grows. Where a node has more than a small share of all links, its minimum goes to the links by
broadcast instead of the links to one task (``hot_join``). Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_join, removed, staged

LOCAL = 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of a link but the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    rest = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[rest], nodes[parent[rest]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars; what is held is LOCAL links and the stars of those before."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[pa.RecordBatch] = []
    count = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return contracted(np.concatenate([u, *(np.asarray(b.column(0)) for b in held)]), np.concatenate([v, *(np.asarray(b.column(1)) for b in held)]))

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count > LOCAL:
            u, v = joined()
            held, count = [], 0
            if len(u) > 4 * LOCAL:  # enough for one step: the next round goes on
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                u, v = u[:0], v[:0]
    u, v = joined()
    for k in range(0, len(u), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], names=["u", "v"])


def _stars(links: DataFrame, total: int) -> DataFrame:
    """links (u, v), u > v, after one large-star and one small-star step; total: how many links there are."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    large = hot_join(both.where("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    small = hot_join(large, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return row.n, int(row.h)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: each node of a link and the smallest node of its component. Nulls and loops don't count."""
    links = staged(links.where(f"{a} <> {b}").select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "links")
    stars = lambda rows: rows.mapInArrow(_contract, "u long, v long")
    if (count := links.count()) <= LOCAL:
        links = staged(stars(links.coalesce(1)), "stars")
    else:
        state = None
        while True:
            before, links = links, staged(_stars(stars(links), count), "stars")
            now = _state(links)
            removed(before)
            if now == state:
                break
            count, state = now[0], now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
