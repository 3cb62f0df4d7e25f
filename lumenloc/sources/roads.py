"""Road geometry: a query with retries over mirrors, the shrinking radius, addresses of points."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import near_pairs


def with_retries(ask: Callable[[str], tuple[int, object]], mirrors: list[str], max_retries: int = 3, wait: Callable[[float], None] = time.sleep) -> object | None:
    """The body of the first answer with status 200, from mirrors in turn; None after max_retries + 1 attempts.

    Every other status, and whatever ask raises, is tried again after 2 * (attempt + 1) seconds, after the last too.
    """
    for attempt in range(max_retries + 1):
        try:
            status, body = ask(mirrors[attempt % len(mirrors)])
            if status == 200:
                return body
        except Exception:  # noqa: BLE001  the next mirror may answer
            pass
        wait(2 * (attempt + 1))
    return None


def shrinking(ask: Callable[[float], object | None], radius_km: float, tries: int = 3, least: float = 1.0) -> object | None:
    """ask at the radius, then at halves of it, not under the least."""
    for _ in range(tries):
        if (found := ask(radius_km)) is not None:
            return found
        if radius_km <= least:
            return None
        radius_km = max(least, radius_km / 2)
    return None


def vertices(ways: DataFrame) -> DataFrame:
    """way_id, pos, lat, lon of ways (way_id, geometry array of lat, lon)."""
    return ways.select("way_id", F.posexplode("geometry").alias("pos", "v")).select("way_id", "pos", "v.lat", "v.lon")


def addresses(points: DataFrame, places: DataFrame, reach_m: float = 50_000.0) -> DataFrame:
    """points (id, lat, lon) with the address of the nearest place (address, lat, lon) within reach, or null."""
    pairs = near_pairs(points.select("id", "lat", "lon"), places.select("address", "lat", "lon"), reach_m)
    nearest = pairs.groupBy("l_id").agg(F.min_by("r_address", F.struct("meters", "r_address")).alias("address"))
    return points.join(nearest, points["id"] == nearest["l_id"], "left").drop("l_id")


def first_of(cascade: Iterable[DataFrame]) -> DataFrame | None:
    """The first table with rows."""
    return next((df for df in cascade if not df.isEmpty()), None)
