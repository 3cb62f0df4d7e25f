"""DBSCAN over haversine distance.

Equal points are one weighted place from the start, so hot coordinates cost one row. Places lie in fine cells, half the
reach wide and high, whose places are all within reach of each other. So a cell whose own weight is the minimum has
cores only; for other places, neighbouring cells count as a whole where the distance to their centre and their radius
say that all or none of them is within reach, and only a place that this leaves undecided meets the places of border
cells one by one. Components are found over cells in the same way: links that centres and radii prove come first, and
only cells of different components then compare places. A border place takes the neighbouring core with the smallest
root, as the cluster that grows first claims it. Labels are the roots' ranks; noise is -1. Rounds of repeated minima are
written to the checkpoint folder.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .spatial import near_pairs

RADIUS_KM, MIN_SHARE, LEAST = 100.0, 0.03, 3


def scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not base and jsc.getCheckpointDir().isDefined():
        base = jsc.getCheckpointDir().get()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fine_cell(lat: Column, lon: Column, radius_km: float) -> Column:
    """A cell whose points are all within the radius, half of it along the meridian and, where widest, the parallel; and
    the cell's middle."""
    side = math.degrees(radius_km / geo.EARTH_KM) / 2 * 0.999999
    row = F.floor((lat + 90) / side)
    low, high = row * side - 90, (row + 1) * side - 90
    flat = F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high), F.lit(90.0)))
    count = F.greatest(F.lit(1), F.ceil(360 * F.cos(F.radians(flat)) / side))
    col = F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * count)
    middle = (F.least((low + high) / 2, F.lit(90.0)).alias("lat"), ((col + 0.5) / count * 360 - 180).alias("lon"))
    return F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"), *middle)


def _inside(meters: Column, radius: Column, reach_m: float) -> Column:
    return meters + radius <= reach_m * (1 - 1e-9)


def _near(meters: Column, radius: Column, reach_m: float) -> Column:
    return meters - radius <= reach_m * (1 + 1e-9)


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (cell, own, root) after each cell has taken the smallest root that links (a, b) reach."""
    both = links.unionAll(links.select("b", "a"))
    while True:
        # each cell takes the smallest root around it, then the root of that root's own cell
        around = both.join(roots.select(F.col("cell").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("around"))
        step = roots.join(around, roots["cell"] == around["a"], "left").select("cell", "own", "root", F.least("root", "around").alias("to"))
        home = roots.select(F.col("own").alias("to"), F.col("root").alias("home"))
        roots = staged(step.join(home, "to").select("cell", "own", F.least("to", "home").alias("root"), (F.least("to", "home") < F.col("root")).alias("changed")), "roots")
        if roots.where("changed").isEmpty():
            return roots.drop("changed")
        roots = roots.drop("changed")


def dbscan(samples: DataFrame, radius_km: float = RADIUS_KM, min_share: float = MIN_SHARE, least: int = LEAST) -> DataFrame:
    """samples (sample_id, lat, lon) with label. A null coordinate is noise; ids may be of any type with an order."""
    reach_m = radius_km / geo.EARTH_KM * geo.EARTH_M
    points = samples.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("sample_id").alias("place"), F.count("*").alias("n"))
    points = points.withColumn("fine", _fine_cell(F.col("lat"), F.col("lon"), radius_km))
    places = staged(points.withColumn("off", geo.haversine_m("lat", "lon", "fine.lat", "fine.lon")), "places")
    cells = staged(places.groupBy("fine").agg(F.max("off").alias("radius"), F.sum("n").alias("n")).select("fine", "fine.lat", "fine.lon", "radius", "n"), "cells")
    need = max(least, int(samples.count() * min_share))
    widest = cells.agg(F.max("radius")).first()[0]
    if widest is None:
        return samples.withColumn("label", F.lit(-1).cast("int"))
    # places of cells that aren't cores by their own weight
    sparse = places.join(cells.where(F.col("n") < need).select("fine"), "fine", "left_semi").select("place", "lat", "lon")
    around = near_pairs(sparse, cells, reach_m + widest)
    inside, near = (f(F.col("meters"), F.col("r_radius"), reach_m) for f in (_inside, _near))
    bounds = staged(around.where(near).groupBy("l_place").agg(F.sum(F.when(inside, F.col("r_n")).otherwise(0)).alias("low"), F.sum("r_n").alias("high"), F.collect_list(F.when(~inside, F.col("r_fine"))).alias("border"), F.first("l_lat").alias("l_lat"), F.first("l_lon").alias("l_lon")).where(F.col("high") >= need), "bounds")
    open_ = bounds.where(F.col("low") < need).select("l_place", "l_lat", "l_lon", "low", F.explode("border").alias("fine"))
    met = open_.join(places.select("fine", "lat", "lon", "n"), "fine").where(geo.haversine_m("l_lat", "l_lon", "lat", "lon") <= reach_m)
    exact = met.groupBy("l_place", "low").agg(F.sum("n").alias("n")).where(F.col("low") + F.col("n") >= need).select("l_place")
    chosen = bounds.where(F.col("low") >= need).select("l_place").unionAll(exact).withColumnRenamed("l_place", "place")
    dense = places.join(cells.where(F.col("n") >= need).select("fine"), "fine", "left_semi").select("place")
    cores = staged(places.join(chosen.unionAll(dense), "place", "left_semi").drop("n"), "cores")
    homes = staged(cores.groupBy("fine").agg(F.max("off").alias("radius"), F.min("place").alias("own")).select("fine", "fine.lat", "fine.lon", "radius", "own"), "homes")
    if homes.isEmpty():
        return samples.withColumn("label", F.lit(-1).cast("int"))
    both = F.col("l_radius") + F.col("r_radius")
    pairs = near_pairs(homes, homes, reach_m + 2 * widest).where((F.col("l_own") < F.col("r_own")) & _near(F.col("meters"), both, reach_m))
    pairs = staged(pairs.select(F.col("l_fine").alias("a"), F.col("r_fine").alias("b"), _inside(F.col("meters"), both, reach_m).alias("sure")), "pairs")
    roots = _grown(homes.select(F.col("fine").alias("cell"), "own", F.col("own").alias("root")), pairs.where("sure").select("a", "b"))
    # cells that may be linked and aren't connected yet compare their places
    of = lambda side: roots.select(F.col("cell").alias(side), F.col("root").alias(f"root_{side}"))
    maybe = staged(pairs.where(~F.col("sure")).join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b").select("a", "b"), "maybe")
    if not maybe.isEmpty():
        at = lambda side: cores.select(F.col("fine").alias(side), F.col("lat").alias(f"lat_{side}"), F.col("lon").alias(f"lon_{side}"))
        found = maybe.join(at("a"), "a").join(at("b"), "b").where(geo.haversine_m("lat_a", "lon_a", "lat_b", "lon_b") <= reach_m).select("a", "b").distinct()
        roots = _grown(roots, staged(found.unionAll(pairs.where("sure").select("a", "b")), "links"))
    rooted = homes.join(roots.select(F.col("cell").alias("fine"), "root"), "fine")
    others = places.join(cores.select("place"), "place", "left_anti").select("place", "lat", "lon")
    reached = near_pairs(others, rooted.select("lat", "lon", "radius", "root", "fine"), reach_m + widest).where(near).select(F.col("l_place").alias("place"), "l_lat", "l_lon", F.col("r_root").alias("root"), F.col("r_fine").alias("fine"), inside.alias("inside"))
    one_by_one = reached.where("not inside").join(cores.select("fine", "lat", "lon"), "fine").where(geo.haversine_m("l_lat", "l_lon", "lat", "lon") <= reach_m)
    border = reached.where("inside").select("place", "root").unionAll(one_by_one.select("place", "root")).groupBy("place").agg(F.min("root").alias("root"))
    claimed = cores.join(rooted.select("fine", "root"), "fine").select("place", "root").unionAll(border)
    # a label a cluster; with n samples there are at most 1 / min_share clusters
    named = roots.select("root").distinct().selectExpr("root", "row_number() over (order by root) - 1 as label")
    labels = claimed.join(named, "root").select("place", "label").join(places.select("place", "lat", "lon"), "place").drop("place")
    return samples.join(labels, ["lat", "lon"], "left").select(*samples.columns, F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def summarize(labelled: DataFrame, top: int | None = None) -> DataFrame:
    """A row a cluster: means, population deviations, count, weight over all samples; largest first."""
    total = labelled.agg(F.count("*").alias("total"))
    rows = labelled.where("label <> -1").groupBy("label").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.stddev_pop("lat").alias("lat_std"), F.stddev_pop("lon").alias("lon_std"), F.count("*").alias("count"))
    rows = rows.crossJoin(total).select("label", "lat", "lon", "lat_std", "lon_std", "count", F.bround(F.col("count") / F.col("total"), 3).alias("weight"))
    return rows.orderBy(F.desc("count"), "label").limit(top) if top else rows


def noise_share(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.bround(F.avg((F.col("label") == -1).cast("int")), 3).alias("noise_frac"))
