"""Fit of sun, date and road direction: which sunrise or sunset would stand where the photo's sun does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display, geo
from ..functions.solar import with_sun_events
from .spatial import segments


def road_bearings(vertices: DataFrame) -> DataFrame:
    """way_id and the undirected bearing of each segment."""
    rows = segments(vertices)
    return rows.select("way_id", "pos", geo.undirected(geo.bearing("lat", "lon", "next_lat", "next_lon")).alias("bearing"))


def headings(bearings: DataFrame, key: str) -> DataFrame:
    """key, n_bearings (distinct rounded bearings, 0 and 180 apart), headings: those and their opposites."""
    rounded = F.bround("bearing", 0).cast("int")
    sets = bearings.groupBy(key).agg(F.collect_set(rounded).alias("b"))  # at most 181 numbers
    both = F.array_union("b", F.transform("b", lambda x: (x + 180) % 360))
    return sets.select(key, F.size("b").alias("n_bearings"), F.array_sort(both).alias("headings"))


def fit(clusters: DataFrame, heads: DataFrame, dates: DataFrame, offset: str = "offset_deg") -> DataFrame:
    """clusters (cluster, lat, lon, offset) with the best event, date and heading.

    dates: cluster, date. The least error wins, ties by date, sunrise first, then the smallest heading; errors are
    reduced over a cluster's headings before rows of different dates meet. Clusters without roads have no error.
    """
    events = with_sun_events(clusters.join(dates, "cluster").select("cluster", "lat", "lon", offset, "date"))
    rows = events.join(heads, "cluster")
    error = lambda h: F.abs(geo.signed_diff(F.col("azimuth"), h + F.col(offset)))
    best = F.array_min(F.transform("headings", lambda h: F.struct(error(h).alias("error"), h.alias("heading"))))
    rows = rows.withColumn("best", best)
    order = F.struct("best.error", "date", (F.col("event") == "sunset").alias("late"), "best.heading")
    picked = rows.groupBy("cluster").agg(F.min_by(F.struct("best.error", "date", "event", "azimuth", "best.heading", "n_bearings"), order).alias("p"))
    out = picked.select(
        "cluster", F.bround("p.error", 1).alias("error"), F.col("p.date").alias("date"), F.col("p.event").alias("event"), F.bround("p.azimuth", 1).alias("sun_azimuth"),
        F.col("p.heading").alias("camera_heading"), F.col("p.n_bearings").alias("n_road_bearings"), display.reliability(F.col("p.n_bearings")).alias("reliability"),
    )
    return clusters.select("cluster").join(out, "cluster", "left").withColumn("note", F.when(F.col("error").isNull(), "no usable road data nearby"))
