"""The whole plan: coarse samples to ranked candidates with evidence, and the refinement of one point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display, geo, imaging
from ..functions.similarity import score_against
from ..operators import photo, retrieval, sunfit
from ..operators.dbscan import dbscan, noise_share, staged, summarize
from ..operators.spatial import near_pairs


@dataclass
class Settings:
    cluster_radius_km: float = 100.0
    min_cluster_frac: float = 0.03
    top_k: int = 5
    retrieval_top_clusters: int = 1
    verify_top_n: int = 15
    max_images: int = 150
    radius_km: float | None = None
    source_top_k: int = 5
    fov: float = 65.0
    sun: bool = True
    road_reach_m: float = 300.0


def sun_evidence(clusters: DataFrame, roads: DataFrame, pixels: DataFrame, s: Settings) -> DataFrame:
    """clusters (cluster, lat, lon) with the sun fit of one photo; null where the photo isn't of a golden hour.

    The season's hemisphere is that of the first cluster, as all clusters share the photo.
    """
    gate = photo.golden_hour(pixels).where("golden").join(photo.sun_offset(pixels, s.fov).select("image_id", "offset_deg"), "image_id").join(photo.season(pixels).select("image_id", "season"), "image_id")
    first = clusters.orderBy("cluster").limit(1).select(F.col("lat").alias("first_lat"))
    dates = gate.crossJoin(first).select("offset_deg", F.explode(imaging.sample_dates(imaging.season_months(F.col("season"), F.col("first_lat")))).alias("date"))
    rows = clusters.select("cluster", "lat", "lon").crossJoin(gate.select("offset_deg"))
    near = near_pairs(rows.select("cluster", "lat", "lon"), roads, s.road_reach_m).select(F.col("l_cluster").alias("cluster"), F.col("r_way_id").alias("way_id")).distinct()
    bearings = near.join(sunfit.road_bearings(roads), "way_id")
    return sunfit.fit(rows, sunfit.headings(bearings, "cluster"), dates.crossJoin(clusters.select("cluster")).select("cluster", "date"))


def retrieve(clusters: DataFrame, imagery: DataFrame, query: list[float], s: Settings) -> DataFrame:
    """cluster, source, rank and the match: per cluster and source, the best after the two-tier order.

    Candidates are imagery records within the cluster's box, once each, with a usable thumb, at most max_images in
    tile order a source. imagery: source, image_id, pos, lat, lon, sd_href, thumb_href, embedding, inliers, total_matches.
    """
    radius = F.lit(s.radius_km) if s.radius_km else geo.search_radius_km("lat", "lat_std", "lon_std")
    boxes = clusters.select(F.col("cluster"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), radius.alias("c_radius"))
    # few clusters are refined: their boxes are a handful of literals' worth of rows
    found = imagery.join(F.broadcast(boxes.limit(max(1, s.retrieval_top_clusters))), geo.in_bbox("lat", "lon", "c_lat", "c_lon", "c_radius"))
    found = found.withColumn("_key", F.concat_ws("|", "cluster", "source", "image_id"))
    found = retrieval.keep_first(found, "_key", "pos").withColumn("thumb_url", retrieval.usable_thumb(F.col("sd_href"), F.col("thumb_href"))).where("thumb_url is not null")
    found = found.withColumn("_group", F.concat_ws("|", "cluster", "source"))
    found = retrieval.limit_each(found, "_group", s.max_images, "pos")
    scored = score_against(found, query).where("similarity is not null")
    ranked = retrieval.best_of_each(scored, "_group", s.source_top_k, s.verify_top_n)
    url = retrieval.match_url(F.col("source"), F.col("image_id"), F.col("lat"), F.col("lon"))
    return retrieval.cleaned(ranked.withColumn("url", url)).select("cluster", "source", "rank", "image_id", "similarity", "inliers", "total_matches", "lat", "lon", "url")


def locate(spark: SparkSession, samples: DataFrame, imagery: DataFrame, roads: DataFrame, pixels: DataFrame | None, query: list[float], s: Settings | None = None) -> dict[str, DataFrame]:
    """clusters, noise, sun and matches of one photo. The clusters are written once, as every later step reads them."""
    s = s or Settings()
    labelled = staged(dbscan(samples, s.cluster_radius_km, s.min_cluster_frac), "labelled")
    clusters = summarize(labelled, s.top_k)
    clusters = staged(clusters.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("count"), "label")) - 1), "clusters")
    out = {"clusters": clusters, "noise": noise_share(labelled)}
    if s.sun and pixels is not None:
        out["sun"] = sun_evidence(clusters, roads, pixels, s)
    out["matches"] = retrieve(clusters.where(F.col("cluster") < s.retrieval_top_clusters), imagery, query, s)
    return out


def refine_point(spark: SparkSession, lat: float, lon: float, imagery: DataFrame, query: list[float], s: Settings | None = None) -> DataFrame:
    """Matches around one point: a cluster without spread, so the search has its least radius unless one is given."""
    s = s or Settings(max_images=300)
    point = spark.createDataFrame([(0, lat, lon, 0.0, 0.0)], "cluster int, lat double, lon double, lat_std double, lon_std double")
    return retrieve(point, imagery, query, s)


def report(clusters: DataFrame) -> DataFrame:
    """Each cluster as shown: rank, coordinates, confidence, spread, the radius and zoom of its refinement."""
    spread = geo.spread_km("lat", "lat_std", "lon_std")
    radius = geo.refine_radius_km(spread)
    return clusters.select(
        (F.col("cluster") + 1).alias("rank"), F.format_string("%.5f, %.5f", "lat", "lon").alias("coordinates"), display.half_up(F.col("weight") * 100).cast("int").alias("confidence"),
        display.spread_text(spread).alias("spread"), radius.alias("radius_km"), geo.map_zoom(radius).alias("zoom"), "count",
    )
