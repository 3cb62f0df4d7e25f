"""Tiles, roads, radius joins and clusters of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def tile_grid(df: DataFrame, radius: str = "radius_km", step: float = geo.TILE_STEP) -> DataFrame:
    """df (lat, lon, radius) with a row for each tile of the square around it, row-major; the last tiles overshoot."""
    dy, dx = geo.lat_span(F.col(radius)), geo.lon_span(F.col(radius), F.col("lat"))
    n = lambda d: F.greatest(F.lit(1), F.ceil(2 * d / step)).cast("int")
    out = df.withColumn("row", F.explode(F.sequence(F.lit(0), n(dy) - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), n(dx) - 1)))
    out = out.withColumn("min_lat", F.col("lat") - dy + F.col("row") * step).withColumn("min_lon", F.col("lon") - dx + F.col("col") * step)
    return out.withColumn("max_lat", F.col("min_lat") + step).withColumn("max_lon", F.col("min_lon") + step)


def segments(vertices: DataFrame, way: str = "way_id", position: str = "pos") -> DataFrame:
    """Consecutive vertices of each way: the vertex with next_lat, next_lon."""
    w = Window.partitionBy(way).orderBy(position)
    return vertices.withColumn("next_lat", F.lead("lat").over(w)).withColumn("next_lon", F.lead("lon").over(w)).where("next_lat is not null")


def road_points(vertices: DataFrame, spacing_m: float = geo.ROAD_SPACING_M) -> DataFrame:
    """Points along each segment, spacing_m apart at least, its end left out."""
    rows = segments(vertices)
    n = F.greatest(F.lit(1), F.floor(geo.haversine_m("lat", "lon", "next_lat", "next_lon") / spacing_m)).cast("int")
    rows = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("k") / F.col("n"))
    return rows.select("way_id", "pos", "k", at("lat", "next_lat").alias("lat"), at("lon", "next_lon").alias("lon"))


def sampled(df: DataFrame, n: int = 400, seed: int = 0, key: tuple[str, ...] = ("way_id", "pos", "k")) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same rows each time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key])), *key).limit(n)


def _cells(lat: Column, lon: Column, reach_deg: float, spread: int) -> Column:
    """Grid cells (row, column) within spread of a point. Rows are reach_deg high; columns are as wide as the row needs
    at its edge nearest a pole, whole numbers of them go round the globe, and rows at a pole have one."""
    row = F.floor((lat + 90) / reach_deg).cast("long")

    def columns(r: Column) -> Column:
        edge = F.least(F.lit(90.0), F.greatest(F.abs(r * reach_deg - 90), F.abs((r + 1) * reach_deg - 90)) + reach_deg)
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / reach_deg)).cast("long")

    def in_row(r: Column) -> Column:
        n = columns(r)
        own = F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n).cast("long")
        near = F.transform(F.sequence(F.lit(-spread), F.lit(spread)), lambda d: F.pmod(own + d, n))
        return F.transform(F.array_distinct(near), lambda c: F.struct(r.alias("row"), c.alias("col")))

    return F.flatten(F.transform(F.sequence(row - spread, row + spread), in_row))


def near_pairs(left: DataFrame, right: DataFrame, reach_m: float) -> DataFrame:
    """Pairs of rows within reach_m: columns of left prefixed l_, of right r_, and meters.

    Right rows lie in one grid cell each, left rows go to the nine around them, so the join is by cell with the exact
    distance as a residual: a hash or sort-merge join, never a nested loop. Handles the date line and the poles.
    """
    degrees = math.degrees(reach_m / geo.EARTH_M) * 1.000001
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("cell", F.explode(_cells(F.col("l_lat"), F.col("l_lon"), degrees, 1)))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("cell", F.explode(_cells(F.col("r_lat"), F.col("r_lon"), degrees, 0)))
    return a.join(b, "cell").withColumn("meters", geo.haversine_m("l_lat", "l_lon", "r_lat", "r_lon")).where(F.col("meters") <= reach_m).drop("cell")


def bounds(df: DataFrame, pad: float = 0.35, max_zoom: int = 13) -> DataFrame:
    """The padded bounding box of all points, and the zoom that a map of it doesn't exceed."""
    box = df.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    return box.select(
        (F.col("a") - (F.col("b") - F.col("a")) * pad).alias("min_lat"), (F.col("b") + (F.col("b") - F.col("a")) * pad).alias("max_lat"),
        (F.col("c") - (F.col("d") - F.col("c")) * pad).alias("min_lon"), (F.col("d") + (F.col("d") - F.col("c")) * pad).alias("max_lon"), F.lit(max_zoom).alias("max_zoom"),
    )
