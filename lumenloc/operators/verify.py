"""Geometric verification of candidates against one photo, by a matcher that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fewer keypoints or matches than this have no inliers.
LEAST = 8
#: (target, image) to (keypoints of the poorer image, matches, inliers).
Matcher = Callable[[Any, Any], tuple[int, int, int]]


def gated(keypoints: Column, total: Column, inliers: Column) -> tuple[Column, Column]:
    """Inliers and total matches as reported: 0 of 0 under LEAST keypoints, 0 of total under LEAST matches."""
    enough = F.coalesce(keypoints >= LEAST, F.lit(False))
    shown = F.when(enough, F.coalesce(total, F.lit(0))).otherwise(0)
    return F.when(shown >= LEAST, F.coalesce(inliers, F.lit(0))).otherwise(0), shown


def verify(df: DataFrame, target: Any, matcher: Matcher, image_col: str | None = None, loader: Callable[[dict], Any] | None = None, rank_col: str | None = None, top: int | None = None) -> DataFrame:
    """df with inliers and total_matches (long); columns of these names are replaced.

    An image comes from image_col or, where that is null or absent, from loader(row). Without an image, or where loading
    or matching fails, a row has 0 of 0. With rank_col and top, rows of a later rank aren't checked and have nulls.
    Row-local, a batch at a time; target travels with the plan, so it must be one photo's features, not a table.
    """
    df = df.drop("inliers", "total_matches")
    names = df.columns

    def check(row: dict) -> tuple[int | None, int | None]:
        if top is not None and rank_col and (row[rank_col] is None or row[rank_col] > top):
            return None, None
        try:
            image = row[image_col] if image_col else None
            if image is None and loader is not None:
                image = loader(row)
            if image is None:
                return 0, 0
            keypoints, total, inliers = matcher(target, image)
        except Exception:  # noqa: BLE001  a candidate that can't be checked counts as one without matches
            return 0, 0
        total = int(total) if keypoints >= LEAST else 0
        return (int(inliers) if total >= LEAST else 0), total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [check(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]], names=[*names, "inliers", "total_matches"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("inliers", T.LongType()), T.StructField("total_matches", T.LongType())]))
