"""The registered queries and, beside each, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display, geo, imaging
from ..functions.similarity import cosine
from ..functions.solar import steps, with_sun_events
from ..operators import photo, progress, retrieval, spatial, sunfit
from ..operators.dbscan import dbscan, noise_share, summarize
from ..operators.verify import verify
from ..sources import events, imagery
from .fixtures import FIXTURES, fixture, table, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, fixtures: str = "") -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_fixtures(fixtures, sql) if fixtures else sql
        return f

    return register


def r(column, places: int = 6):  # noqa: ANN001, ANN201
    """Rounded half-even, without a negative zero."""
    return F.bround(column, places) + F.lit(0.0)


# ---------------------------------------------------------------- retrieval

SIM = """sim as (select e.vec_id, round_even(list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v)) + 1e-8), 4) as similarity
 from (select vec_id, cast(embedding as double[]) as v from embeddings) e, (select cast(embedding as double[]) as v from embeddings where vec_id = 0) q)"""
TIERS = f"""{SIM}, m as (select i.*, s.similarity from imagery i join sim s on i.vec_id = s.vec_id),
 t as (select *, row_number() over (partition by source order by similarity desc, pos) as rn from m),
 k as (select *, row_number() over (partition by source order by rn > 15, case when rn > 15 then 0 else inliers end desc, rn) as rank from t)"""


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and likeness to the vector with id 0, which is one row and so sent to every task."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return rows.crossJoin(F.broadcast(one)).select("vec_id", cosine(F.col("q"), F.col("embedding")).alias("similarity"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "imagery").join(similarities(spark, sf_dir), "vec_id")


@query(f"with {SIM} select vec_id, similarity from sim order by similarity desc, vec_id limit 15")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarities(spark, sf_dir).orderBy(F.desc("similarity"), "vec_id").limit(15)


@query(f", {TIERS} select source, vec_id, similarity, cast(rank as bigint) as rank from k", "imagery")
def two_tier_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.two_tier(matches(spark, sf_dir), "source").select("source", "vec_id", "similarity", F.col("rank").cast("long").alias("rank"))


@query(f", {TIERS} select source, vec_id, similarity, inliers, cast(rank as bigint) as rank from k where rank <= 5", "imagery")
def per_source_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_of_each(matches(spark, sf_dir), "source").select("source", "vec_id", "similarity", "inliers", F.col("rank").cast("long").alias("rank"))


@query(
    """select source, vec_id, case source when 'mapillary' then 'https://www.mapillary.com/app/?pKey=' || image_id || '&focus=photo'
 when 'google_sv' then printf('https://www.google.com/maps?q=&layer=c&cbll=%.6f,%.6f', lat, lon) else 'https://api.panoramax.xyz/#focus=pic&pic=' || image_id end as url from imagery""",
    "imagery",
)
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "imagery")
    both = retrieval.union_sources({s: rows.where(F.col("source") == s).drop("source") for s in retrieval.SOURCES})
    return both.select("source", "vec_id", retrieval.match_url(F.col("source"), F.col("image_id"), F.col("lat"), F.col("lon")).alias("url"))


@query("select vec_id, total_matches > 0 and inliers < 0.4 * total_matches as weak from imagery", "imagery")
def weak_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "imagery").select("vec_id", display.is_weak(F.col("inliers"), F.col("total_matches")).alias("weak"))


@query("select vec_id, image_id from imagery i where exists (select 1 from imagery j where j.image_id = i.image_id and (coalesce(j.sd_href, '') <> '' or coalesce(j.thumb_href, '') <> ''))", "imagery")
def semi_downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "imagery")
    there = rows.where(retrieval.usable_thumb(F.col("sd_href"), F.col("thumb_href")).isNotNull()).select("image_id")
    return rows.join(there, "image_id", "left_semi").select("vec_id", "image_id")


@query("select tile_no % 3 as cluster, source, count(*) as n from imagery group by tile_no % 3, source", "imagery")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.source_counts(fixture(spark, sf_dir, "imagery").withColumn("cluster", F.col("tile_no") % 3))


@query("select vec_id, count(*) over (partition by tile_no % 3, source order by pos rows between unbounded preceding and current row) as n from imagery", "imagery")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.running_counts(fixture(spark, sf_dir, "imagery").withColumn("cluster", F.col("tile_no") % 3)).select("vec_id", "n")


URLS = "select vec_id, source, case when vec_id % 2 = 0 then concat('m/', cast(vec_id as varchar(20))) end as mapillary_url, case when vec_id % 3 = 0 then '' when vec_id % 3 = 1 then concat('s/', cast(vec_id as varchar(20))) end as street_view_url, case when vec_id % 5 = 0 then concat('p/', cast(vec_id as varchar(20))) end as panoramax_url from {}"


@query(f", u as ({URLS.format('imagery')}) select vec_id, coalesce(nullif(case source when 'mapillary' then mapillary_url when 'google_sv' then street_view_url else panoramax_url end, ''), nullif(mapillary_url, ''), nullif(street_view_url, ''), nullif(panoramax_url, ''), '') as url from u", "imagery")
def url_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(URLS.format("{imagery}"), imagery=fixture(spark, sf_dir, "imagery"))
    return rows.select("vec_id", retrieval.picked_url(F.col("source"), F.col("mapillary_url"), F.col("street_view_url"), F.col("panoramax_url")).alias("url"))


@query(f", {SIM} select vec_id, printf('%.3f', similarity) as similarity, case when vec_id % 4 = 0 then '' else inliers || '/' || total_matches end as inliers from imagery join sim using (vec_id)", "imagery")
def match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness at three places and inliers of matches as shown; every fourth wasn't verified."""
    checked = F.when(F.col("vec_id") % 4 != 0, F.col("inliers"))
    return matches(spark, sf_dir).select("vec_id", display.to_fixed(F.col("similarity"), 3).alias("similarity"), display.inlier_text(checked, F.col("total_matches")).alias("inliers"))


@query(
    "select vec_id, image_id, coalesce(nullif(sd_href, ''), nullif(thumb_href, '')) as thumb from (select *, row_number() over (partition by image_id order by pos) as n from imagery) q where n = 1 and coalesce(nullif(sd_href, ''), nullif(thumb_href, '')) is not null",
    "imagery",
)
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = retrieval.keep_first(fixture(spark, sf_dir, "imagery"), "image_id", "pos")
    return first.select("vec_id", "image_id", retrieval.usable_thumb(F.col("sd_href"), F.col("thumb_href")).alias("thumb")).where("thumb is not null")


@query("select vec_id, case when sd_href is not null and sd_href <> '' then sd_href when thumb_href <> '' then thumb_href end as thumb from imagery", "imagery")
def thumb_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "imagery").select("vec_id", retrieval.usable_thumb(F.col("sd_href"), F.col("thumb_href")).alias("thumb"))


@query("select tile_no, vec_id from (select *, row_number() over (partition by tile_no order by pos) as n from imagery) q where n <= 5 order by tile_no, pos limit 150", "imagery")
def tile_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.limit_each(fixture(spark, sf_dir, "imagery"), "tile_no", 5, "pos")
    return rows.orderBy("tile_no", "pos").limit(150).select("tile_no", "vec_id")


@query("select vec_id, image_id from imagery where lat between 48.85 - 1 / 111.0 and 48.85 + 1 / 111.0 and lon between 2.35 - 1 / (111 * greatest(cos(radians(48.85)), 0.1)) and 2.35 + 1 / (111 * greatest(cos(radians(48.85)), 0.1))", "imagery")
def bbox_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "imagery").where(geo.in_bbox("lat", "lon", 48.85, 2.35, 1.0)).select("vec_id", "image_id")


@query("select vec_id, printf('%d', cast(floor(similarity * 100 + 0.5) as bigint)) || '%' as percent, cast(least(greatest(floor(similarity * 100 + 0.5), 2), 100) as integer) as meter, printf('%.5f, %.5f', lat, lon) as coordinates from m".replace("from m", "from imagery join sim using (vec_id)").replace("select vec_id", f", {SIM} select vec_id", 1), "imagery")
def match_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(spark, sf_dir)
    percent = F.concat(F.format_string("%d", display.half_up(F.col("similarity") * 100).cast("long")), F.lit("%"))
    return rows.select("vec_id", percent.alias("percent"), display.similarity_percent(F.col("similarity")).alias("meter"), F.format_string("%.5f, %.5f", "lat", "lon").alias("coordinates"))


@query("select vec_id, case when total_matches < 8 then 0 else inliers end as inliers, total_matches, vec_id % 9 = 0 as failed from imagery".replace("case when", "case when vec_id % 9 = 0 or").replace("total_matches, vec", "case when vec_id % 9 = 0 then 0 else total_matches end as total_matches, vec"), "imagery")
def verify_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification reports: fewer than 8 matches have no inliers; a failed image counts as 0 of 0."""
    rows = fixture(spark, sf_dir, "imagery").select("vec_id", F.struct("total_matches", "inliers").alias("image"), (F.col("vec_id") % 9 == 0).alias("failed"))

    def match(_: object, image: dict) -> tuple[int, int, int]:
        return 2048, image["total_matches"], image["inliers"]

    def load(row: dict) -> dict:
        if row["failed"]:
            raise OSError
        return row["image"]

    return verify(rows, None, match, loader=load).select("vec_id", "inliers", "total_matches", "failed")


@query(f", {SIM} select source, image_id, similarity from imagery join sim using (vec_id)", "imagery")
def clean_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(spark, sf_dir).withColumn("_id", F.col("image_id")).withColumn("_img", F.lit(None).cast("binary"))
    return retrieval.cleaned(rows).select("source", "image_id", "similarity")


# ---------------------------------------------------------------- geometry

HAV = "2 * asin(least(1.0, sqrt(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return HAV.format(a=a, b=b, c=c, d=d)


SEGMENTS = "seg as (select * from (select *, lead(lat) over (partition by way_id order by pos) as nlat, lead(lon) over (partition by way_id order by pos) as nlon from road_vertices) q where nlat is not null)"
BEARING = "(((degrees(atan2(sin(radians(nlon - lon)) * cos(radians(nlat)), cos(radians(lat)) * sin(radians(nlat)) - sin(radians(lat)) * cos(radians(nlat)) * cos(radians(nlon - lon)))) + 360) % 360) + 360) % 360"


@query(f"select sample_id, round_even(6371000 * {_hav('48.85', '2.35', 'lat', 'lon')}, 3) as meters from samples", "samples")
def haversine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "samples").select("sample_id", r(geo.haversine_m(48.85, 2.35, "lat", "lon"), 3).alias("meters"))


@query(f", {SEGMENTS} select way_id, pos, round_even({BEARING}, 6) as bearing, round_even(({BEARING}) % 180, 6) as undirected from seg", "road_vertices")
def bearing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.segments(fixture(spark, sf_dir, "road_vertices"))
    b = geo.bearing("lat", "lon", "next_lat", "next_lon")
    return rows.select("way_id", "pos", r(b).alias("bearing"), r(geo.undirected(b)).alias("undirected"))


@query("select vec_id, cast((((((vec_id * 37) % 360 - (vec_id * 53) % 360) + 180) % 360) + 360) % 360 - 180 as double) as diff from imagery", "imagery")
def signed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "imagery").select("vec_id", geo.signed_diff(F.col("vec_id") * 37 % 360, F.col("vec_id") * 53 % 360).alias("diff"))


@query(
    """, g as (select *, radius_km / 111.0 as dy, radius_km / (111.0 * greatest(cos(radians(lat)), 0.1)) as dx from probes)
 select cluster, rw as "row", cl as col, round_even(lat - dy + rw * 0.008, 6) as min_lat, round_even(lon - dx + cl * 0.008, 6) as min_lon from g,
 lateral (select unnest(range(greatest(1, cast(ceil(2 * dy / 0.008) as bigint)))) as rw) a, lateral (select unnest(range(greatest(1, cast(ceil(2 * dx / 0.008) as bigint)))) as cl) b""",
    "probes",
)
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.tile_grid(fixture(spark, sf_dir, "probes"))
    return rows.select("cluster", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), r("min_lat").alias("min_lat"), r("min_lon").alias("min_lon"))


@query(
    f""", {SEGMENTS}, n as (select *, greatest(1, cast(floor(6371000 * {_hav("lat", "lon", "nlat", "nlon")} / 60) as bigint)) as n from seg)
 select way_id, pos, k, round_even(lat + (nlat - lat) * (k / n), 6) as lat, round_even(lon + (nlon - lon) * (k / n), 6) as lon from n, lateral (select unnest(range(n.n)) as k) q""",
    "road_vertices",
)
def road_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.road_points(fixture(spark, sf_dir, "road_vertices"))
    return rows.select("way_id", "pos", F.col("k").cast("long").alias("k"), r("lat").alias("lat"), r("lon").alias("lon"))


@query(f""", {SEGMENTS}, n as (select *, greatest(1, cast(floor(6371000 * {_hav("lat", "lon", "nlat", "nlon")} / 60) as bigint)) as n from seg)
 select way_id, pos, k, round_even(lat + (nlat - lat) * (k / n), 6) as lat, round_even(lon + (nlon - lon) * (k / n), 6) as lon from n, lateral (select unnest(range(n.n)) as k) q order by md5('0:' || way_id || ':' || pos || ':' || k), way_id, pos, k limit 400""", "road_vertices")
def road_sample400(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.sampled(spatial.road_points(fixture(spark, sf_dir, "road_vertices")))
    return rows.select("way_id", "pos", F.col("k").cast("long").alias("k"), r("lat").alias("lat"), r("lon").alias("lon"))


@query(
    f"""select i.vec_id, count(*) as n, round_even(min(6371000 * {_hav("i.lat", "i.lon", "v.lat", "v.lon")}), 3) as nearest_m
 from imagery i, road_vertices v where 6371000 * {_hav("i.lat", "i.lon", "v.lat", "v.lon")} <= 300 group by i.vec_id""",
    "imagery road_vertices",
)
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixture(spark, sf_dir, "imagery").select("vec_id", "lat", "lon")
    pairs = spatial.near_pairs(points, fixture(spark, sf_dir, "road_vertices").select("way_id", "lat", "lon"), 300.0)
    return pairs.groupBy(F.col("l_vec_id").alias("vec_id")).agg(F.count("*").alias("n"), r(F.min("meters"), 3).alias("nearest_m"))


DEVIATIONS = "g as (select tile_no, avg(lat) as lat, stddev_pop(lat) as sy, stddev_pop(lon) as sx from imagery group by tile_no)"


def _deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "imagery").groupBy("tile_no").agg(F.avg("lat").alias("lat"), F.stddev_pop("lat").alias("sy"), F.stddev_pop("lon").alias("sx"))


@query(f", {DEVIATIONS}, s as (select tile_no, sqrt(power(sy * 111, 2) + power(sx * 111 * greatest(cos(radians(lat)), 0.1), 2)) as s from g) select tile_no, round_even(least(greatest(s, 3), 15), 6) as radius_km, round_even(least(greatest(s * 10, 3), 8), 6) as road_radius_km from s", "imagery")
def cluster_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _deviations(spark, sf_dir)
    return rows.select("tile_no", r(geo.search_radius_km("lat", "sy", "sx")).alias("radius_km"), r(geo.search_radius_km("lat", F.col("sy") * 10, F.col("sx") * 10, most=8.0)).alias("road_radius_km"))


SPREAD = f"{DEVIATIONS}, s as (select tile_no, sqrt(power(sy * 111, 2) + power(sx * 111 * cos(radians(lat)), 2)) as km, tile_no % 2 = 0 as small from g), k as (select tile_no, case when small then km / 10 else km end as km from s)"


@query(f", {SPREAD} select tile_no, case when km < 1 then printf('± %d m', cast(floor(km * 1000 + 0.5) as bigint)) else printf('± %.1f km', km) end as spread, round_even(least(greatest(km, 0.5), 20), 6) as radius_km from k", "imagery")
def spread_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = geo.spread_km("lat", "sy", "sx")
    km = F.when(F.col("tile_no") % 2 == 0, km / 10).otherwise(km)
    return _deviations(spark, sf_dir).select("tile_no", display.spread_text(km).alias("spread"), r(geo.refine_radius_km(km)).alias("radius_km"))


@query("select cluster, case when radius_km * 2 > 6 then 10 when radius_km * 2 > 2 then 12 else 13 end as zoom from probes", "probes")
def map_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "probes").select("cluster", geo.map_zoom(F.col("radius_km") * 2).alias("zoom"))


@query("select round_even(min(lat) - 0.35 * (max(lat) - min(lat)), 6) as min_lat, round_even(max(lat) + 0.35 * (max(lat) - min(lat)), 6) as max_lat, round_even(min(lon) - 0.35 * (max(lon) - min(lon)), 6) as min_lon, round_even(max(lon) + 0.35 * (max(lon) - min(lon)), 6) as max_lon, 13 as max_zoom from samples", "samples")
def fit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = spatial.bounds(fixture(spark, sf_dir, "samples"))
    return box.select(*[r(c).alias(c) for c in box.columns if c != "max_zoom"], "max_zoom")


@query("select 'imagery' as run, count(*) as n, round_even(avg(lat), 6) as lat from imagery union all select 'roads', count(*), round_even(avg(lat), 6) from road_vertices", "imagery road_vertices")
def run_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "imagery").select(F.lit("imagery").alias("run"), "lat", "lon").unionByName(fixture(spark, sf_dir, "road_vertices").select("lon", "lat", F.lit("roads").alias("run")))
    return rows.groupBy("run").agg(F.count("*").alias("n"), r(F.avg("lat")).alias("lat"))


# ---------------------------------------------------------------- clusters

CLUSTERS = f""", u as (select lat, lon, min(sample_id) as place, count(*) as w from samples group by lat, lon),
 near as materialized (select a.place as i, b.place as j, b.w from u a join u b on b.lat between a.lat - 0.9 and a.lat + 0.9 and {_hav("a.lat", "a.lon", "b.lat", "b.lon")} <= 100.0 / 6371.0),
 core as materialized (select i from near group by i having sum(w) >= greatest(3, (select cast(floor(count(*) * 0.03) as int) from samples))),
 e as materialized (select i, j from near semi join core c1 on near.i = c1.i semi join core c2 on near.j = c2.i),
 cc(id, root) using key (id) as (select i, i from core union select e.j, min(cc.root) from cc join e on cc.id = e.i join recurring.cc r on r.id = e.j where cc.root < r.root group by e.j),
 claimed as (select near.i, coalesce(min(case when near.i = near.j then cc.root end), min(cc.root)) as root from near join cc on cc.id = near.j group by near.i),
 named as (select root, row_number() over (order by root) - 1 as label from (select distinct root from cc) q),
 lab as (select s.sample_id, s.lat, s.lon, cast(coalesce(n.label, -1) as int) as label from samples s join u on s.lat = u.lat and s.lon = u.lon left join claimed c on c.i = u.place left join named n on n.root = c.root),
 stats as (select label, avg(lat) as lat, avg(lon) as lon, stddev_pop(lat) as lat_std, stddev_pop(lon) as lon_std, count(*) as count, round_even(count(*) / (select count(*) from lab), 3) as weight from lab where label <> -1 group by label)"""


def _cluster_query(body: str) -> str:
    return with_fixtures("samples", CLUSTERS + body).replace("with samples", "with recursive samples", 1)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan(fixture(spark, sf_dir, "samples"))


@query(_cluster_query(" select sample_id, label from lab"))
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("sample_id", "label")


@query(_cluster_query(" select label, round_even(lat, 6) as lat, round_even(lon, 6) as lon, round_even(lat_std, 6) as lat_std, round_even(lon_std, 6) as lon_std, count, weight from stats order by count desc, label limit 5"))
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summarize(_labelled(spark, sf_dir), 5)
    return rows.select("label", *[r(c).alias(c) for c in ("lat", "lon", "lat_std", "lon_std")], "count", "weight")


@query(_cluster_query(" select round_even(avg(case when label = -1 then 1.0 else 0.0 end), 3) as noise_frac from lab"))
def noise_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_share(_labelled(spark, sf_dir))


@query(_cluster_query(", top as (select label from stats order by count desc, label limit 1) select label, source, 'c0_' || source as stage from top, (select unnest(['mapillary', 'google_sv', 'panoramax']) as source) q"))
def top_clusters_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = summarize(_labelled(spark, sf_dir), 1)
    return top.select("label", F.explode(F.array(*map(F.lit, retrieval.SOURCES))).alias("source")).withColumn("stage", F.concat(F.lit("c0_"), "source"))


@query(_cluster_query(" select round_even(avg(case when label = -1 then 1.0 else 0.0 end), 3) as share, printf('noise %d%%', cast(floor(round_even(avg(case when label = -1 then 1.0 else 0.0 end), 3) * 100 + 0.5) as bigint)) as text, case when avg(case when label = -1 then 1.0 else 0.0 end) > 0.25 then 'warn' else 'muted' end as style from lab"))
def noise_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, style = display.noise_badge(F.col("noise_frac"))
    return noise_share(_labelled(spark, sf_dir)).select(F.col("noise_frac").alias("share"), text.alias("text"), style.alias("style"))


# ---------------------------------------------------------------- photos

SIZED = "sz as (select image_id, max(y) + 1 as h, max(x) + 1 as w from pixels group by image_id), px as (select p.*, h, w from pixels p join sz on p.image_id = sz.image_id)"
SEASON = f""", {SIZED}, c as (select image_id, greatest(r, g, b) / 255.0 as top, least(r, g, b) / 255.0 as low, r / 255.0 as r, g / 255.0 as g, b / 255.0 as b from px where y >= floor(h * 0.55)),
 hs as (select image_id, top as val, case when top > 0 then (top - low) / top else 0 end as sat,
  ((case when top = low then 0.0 when top = r then (g - b) / (top - low) when top = g then 2 + (b - r) / (top - low) else 4 + (r - g) / (top - low) end / 6.0) + 1) % 1.0 * 360 as hue from c),
 m as (select image_id, count(*) filter (where sat > 0.15) as n, avg(case when sat < 0.1 and val > 0.75 then 1.0 else 0.0 end) as white, avg(hue) filter (where sat > 0.15) as hue, avg(sat) filter (where sat > 0.15) as sat, avg(val) filter (where sat > 0.15) as val from hs group by image_id),
 season as (select image_id, case when n < 50 then 'unknown' when white > 0.4 then 'snow' when hue between 70 and 170 and sat > 0.2 then 'green' when hue >= 20 and hue < 70 then 'brown' else 'unknown' end as season,
  round_even(case when n < 50 then 0 when white > 0.4 then least(white, 0.8) when hue between 70 and 170 and sat > 0.2 then least(sat, 0.8) when hue >= 20 and hue < 70 then least(sat + (1 - val) * 0.3, 0.8) else 0 end, 2) as confidence from m)"""
MONTHS = "case season when 'green' then [4,5,6,7,8,9] when 'brown' then [9,10,11,12,1] when 'snow' then [11,12,1,2,3] else [1,2,3,4,5,6,7,8,9,10,11,12] end"
SOUTH = "list_transform({m}, lambda x: case when image_id % 3 = 0 then (x - 1 + 6) % 12 + 1 else x end)"
SKY = f""", {SIZED}, sc as (select image_id, x, w, (r + g + b) / 3.0 * 0.5 + least(greatest(r - b, 0), 255) * 0.5 as score from px where y < floor(h * 0.6)),
 th as (select image_id, quantile_cont(score, 0.99) as p99 from sc group by image_id)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pixels")


@query(f", {SIZED} select image_id, count(*) filter (where y >= floor(h * 0.55)) as ground, count(*) filter (where y < floor(h * 0.6)) as sky from px group by image_id", "pixels")
def sky_ground_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photo.sized(_pixels(spark, sf_dir))
    return rows.groupBy("image_id").agg(F.count_if(imaging.is_ground(F.col("y"), F.col("h"))).alias("ground"), F.count_if(imaging.is_sky(F.col("y"), F.col("h"))).alias("sky"))


@query(SEASON + " select image_id, season, confidence from season", "pixels")
def hsv_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo.season(_pixels(spark, sf_dir))


@query(f", {SIZED}, s as (select image_id, avg(case when r / 255.0 - b / 255.0 > 0.08 then 1.0 else 0.0 end) as warm, avg(case when b / 255.0 - r / 255.0 > 0.08 then 1.0 else 0.0 end) as blue from px where y < floor(h * 0.6) group by image_id) select image_id, warm > 0.25 and warm > blue as golden, round_even(least(case when warm > 0.25 and warm > blue then warm else blue end, 0.9), 2) as confidence from s", "pixels")
def golden_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo.golden_hour(_pixels(spark, sf_dir))


@query(SKY + " select image_id, round_even(p99, 6) as p99 from th", "pixels")
def sky_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo.sky_threshold(photo.sky_histogram(photo.sky_scores(_pixels(spark, sf_dir)))).select("image_id", r("p99").alias("p99"))


OFFSET = SKY + ", o as (select sc.image_id, avg(x) filter (where score >= p99) as cx, any_value(w) as w, avg(case when score >= p99 then 1.0 else 0.0 end) as share from sc join th on sc.image_id = th.image_id group by sc.image_id)"


@query(OFFSET + " select image_id, round_even((cx / w - 0.5) * 65, 1) + 0.0 as offset_deg, round_even(least(greatest(1 - 20 * share, 0.1), 1), 2) as confidence from o", "pixels")
def sun_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photo.sun_offset(_pixels(spark, sf_dir)).select("image_id", (F.col("offset_deg") + F.lit(0.0)).alias("offset_deg"), "confidence")


@query(f"{SEASON}, mo as (select image_id, {MONTHS} as m from season) select image_id, array_to_string({SOUTH.format(m='m')}, ',') as months from mo", "pixels")
def season_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photo.season(_pixels(spark, sf_dir))
    months = imaging.season_months(F.col("season"), F.when(F.col("image_id") % 3 == 0, -1.0).otherwise(1.0))
    return rows.select("image_id", F.array_join(months.cast("array<string>"), ",").alias("months"))


@query(f"{SEASON}, mo as (select image_id, unnest({MONTHS}) as m from season) select image_id, cast(d as date) as date from mo, lateral (select unnest(generate_series(make_date(2024, m, 1)::timestamp, last_day(make_date(2024, m, 1))::timestamp, interval 6 days)) as d) q", "pixels")
def season_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = photo.season(_pixels(spark, sf_dir))
    return rows.select("image_id", F.explode(imaging.sample_dates(imaging.season_months(F.col("season"), F.lit(1.0)))).alias("date"))


@query(f"{OFFSET}, g as (select image_id, avg(case when r / 255.0 - b / 255.0 > 0.08 then 1.0 else 0.0 end) as warm, avg(case when b / 255.0 - r / 255.0 > 0.08 then 1.0 else 0.0 end) as blue from px where y < floor(h * 0.6) group by image_id) select g.image_id, case when warm > 0.25 and warm > blue then round_even((cx / w - 0.5) * 65, 1) + 0.0 end as offset_deg from g left join o on g.image_id = o.image_id", "pixels")
def sun_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset where the photo is of a golden hour, else null: later steps leave the others out."""
    pixels = _pixels(spark, sf_dir)
    rows = photo.golden_hour(pixels).join(photo.sun_offset(pixels).select("image_id", "offset_deg"), "image_id", "left")
    return rows.select("image_id", F.when(F.col("golden"), F.col("offset_deg") + F.lit(0.0)).alias("offset_deg"))


# ---------------------------------------------------------------- sun

DATES = "dates as (select cast(d as date) as date from (select unnest(generate_series(make_date(2024, m, 1)::timestamp, last_day(make_date(2024, m, 1))::timestamp, interval 6 days)) as d from (select unnest(range(1, 13)) as m) q) q2)"


def _nested(source: str, columns: list[tuple[str, str]]) -> str:
    for name, text in columns:
        source = f"(select *, {text} as {name} from {source}) q"
    return source


SUN = f", {DATES}, sides as (select * from (values ('sunrise', 1.0), ('sunset', -1.0)) v(event, side)), start as (select probes.*, date, event, cast(side as double) as side, date_diff('day', date '1970-01-01', date) + 2440587.5 as jd0 from probes, dates, sides), sun as (select * from {_nested('start', steps())} where minutes is not null)"


def _dates(rows: DataFrame) -> DataFrame:
    """rows with a date column: sampled over the year."""
    months = F.array(*map(F.lit, imaging.SEASON_MONTHS["unknown"]))
    return rows.withColumn("date", F.explode(imaging.sample_dates(months)))


@query(f"{SUN} select cluster, date, event, round_even(minutes, 3) as minutes, round_even(azimuth, 3) as azimuth from sun", "probes")
def sun_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_sun_events(_dates(fixture(spark, sf_dir, "probes").select("cluster", "lat", "lon")))
    return rows.select("cluster", "date", "event", r("minutes", 3).alias("minutes"), r("azimuth", 3).alias("azimuth"))


HEADS = f""", {SEGMENTS}, bs as (select way_id, cast(round_even(({BEARING}) % 180, 0) as int) as b from seg),
 hs as (select way_id, count(distinct b) as n from bs group by way_id), heads as (select distinct way_id, h from (select way_id, b as h from bs union all select way_id, (b + 180) % 360 from bs) q)"""


@query(f"{HEADS} select heads.way_id, cast(n as int) as n_bearings, h as heading from heads join hs on heads.way_id = hs.way_id", "road_vertices")
def heading_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sunfit.headings(sunfit.road_bearings(fixture(spark, sf_dir, "road_vertices")), "way_id")
    return rows.select("way_id", "n_bearings", F.explode("headings").alias("heading"))


FIT = f"""{HEADS.replace(SEGMENTS, SEGMENTS + SUN)}, er as (select sun.cluster, date, event, azimuth, h, n, abs(((((azimuth - (h + offset_deg)) + 180) % 360) + 360) % 360 - 180) as error from sun join heads on heads.way_id = sun.cluster join hs on hs.way_id = sun.cluster),
 best as (select * from (select *, row_number() over (partition by cluster order by error, date, event = 'sunset', h) as k from er) q where k = 1)"""


def _fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = fixture(spark, sf_dir, "probes").select("cluster", "lat", "lon", "offset_deg")
    heads = sunfit.headings(sunfit.road_bearings(fixture(spark, sf_dir, "road_vertices").withColumnRenamed("way_id", "cluster").withColumn("way_id", F.col("cluster"))), "way_id").withColumnRenamed("way_id", "cluster")
    return sunfit.fit(clusters, heads, _dates(clusters.select("cluster")))


@query(f"{FIT} select p.cluster, round_even(error, 1) as error, date, event, h as camera_heading from probes p left join best on best.cluster = p.cluster", "probes road_vertices")
def sun_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir).select("cluster", "error", "date", "event", "camera_heading")


RELIABILITY = "case when n > 4 then 'low (many road orientations nearby, fit is easy)' when n is not null then 'moderate (few road orientations, fit is more constrained)' end"


@query(f"{FIT} select p.cluster, cast(n as int) as n_road_bearings, {RELIABILITY} as reliability, case when error is null then 'no usable road data nearby' end as note from probes p left join best on best.cluster = p.cluster", "probes road_vertices")
def sun_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit(spark, sf_dir).select("cluster", "n_road_bearings", "reliability", "note")


@query(f"{HEADS}, x as (select way_id, {RELIABILITY} as t from hs) select way_id, string_split(t, ' ')[1] as token from x", "road_vertices")
def reliability_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sunfit.headings(sunfit.road_bearings(fixture(spark, sf_dir, "road_vertices")), "way_id")
    return rows.select("way_id", display.reliability_token(display.reliability(F.col("n_bearings"))).alias("token"))


# ---------------------------------------------------------------- events

LABELS = "case bare " + " ".join(f"when '{k}' then '{v}'" for k, v in display.STAGE_LABELS.items()) + " else bare end"
STATE = "case event " + " ".join(f"when '{k}' then '{v}'" for k, v in progress.STATES.items()) + " end"
STATES = f", st as (select run_id, stage, arg_max({STATE}, seq) as state from run_events group by run_id, stage)"


@query(STATES + " select run_id, stage, state from st", "run_events")
def stage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.stage_states(fixture(spark, sf_dir, "run_events"))


@query(
    """, low as (select *, min(completed) over (partition by run_id, stage, phase order by seq rows between unbounded preceding and 1 preceding) as low from progress),
 mk as (select *, max(case when low is null or completed < low then seq end) over (partition by run_id, stage, phase order by seq rows between unbounded preceding and current row) as base from low),
 bs as (select m.*, b.completed as c0, epoch_us(b.ts) / 1000000.0 as t0 from mk m join progress b on b.seq = m.base),
 rt as (select run_id, seq, total, completed, case when completed - c0 > 0 then (completed - c0) / (epoch_us(ts) / 1000000.0 - t0) else 0 end as rate from bs),
 et as (select *, case when rate > 0 then (total - completed) / rate end as eta from rt)
 select run_id, seq, round_even(rate, 6) as rate, case when eta is null or eta < 0 then '' when eta < 1 then '<1s' when eta < 60 then printf('%ds', cast(floor(eta + 0.5) as bigint)) else printf('%dm %ds', cast(floor(eta / 60) as bigint), cast(floor(eta % 60 + 0.5) as bigint)) end as eta from et""",
    "progress",
)
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.progress_eta(fixture(spark, sf_dir, "progress")).select("run_id", "seq", r("rate").alias("rate"), "eta")


@query(f", b as (select seq, stage, regexp_replace(stage, '^(c[0-9]+_|zoom_)', '') as bare, try_cast(nullif(regexp_extract(stage, '^c([0-9]+)_', 1), '') as int) as cluster from run_events) select seq, bare, cluster, case when cluster is null then '' else printf('Candidate %d · ', cluster + 1) end || {LABELS} as label from b", "run_events")
def stage_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("stage")
    return fixture(spark, sf_dir, "run_events").select("seq", display.bare_stage(s).alias("bare"), display.stage_cluster(s).alias("cluster"), display.stage_label(s).alias("label"))


@query(
    """, seen as (select run_id, stage, max(case when event in ('stage_done', 'stage_failed', 'error', 'stage_skipped') then 1 else 0 end) as completed from run_events where not starts_with(stage, 'zoom_') group by run_id, stage),
 steps as (select run_id, stage, completed from seen union all select run_id, stage, 0 from (select distinct run_id from run_events) q, (select unnest(['model_load', 'plonk_sampling', 'sun_refine', 'c0_mapillary', 'c0_google_sv', 'c0_panoramax']) as stage) p),
 o as (select run_id, count(distinct case when completed = 1 then stage end) as done, count(distinct stage) as total from steps group by run_id)
 select run_id, done, total, cast(floor(done / greatest(total, 1) * 100 + 0.5) as int) as percent, case when done >= total then 'Complete' else printf('Running · %d/%d', done, total) end as text from o""",
    "run_events",
)
def overall_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.overall(fixture(spark, sf_dir, "run_events"))


@query(
    STATES
    + """, n as (select run_id, max(seq) % 2 as n from run_events group by run_id), plan as (select run_id, n, stage, need from n, (values ('model_load', -1), ('plonk_sampling', -1), ('sun_refine', -1), ('c0_mapillary', 0), ('c0_google_sv', 0), ('c0_panoramax', 0)) v(stage, need))
 select plan.run_id, plan.stage, case when need >= n then 'skipped' else coalesce(state, 'pending') end as state from plan left join st on st.run_id = plan.run_id and st.stage = plan.stage""",
    "run_events",
)
def step_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "run_events")
    return progress.seeded(progress.stage_states(rows), rows.groupBy("run_id").agg((F.max("seq") % 2).alias("n")))


@query("select run_id, seq, coalesce(last_value(try_cast(nullif(regexp_extract(stage, '^c([0-9]+)_', 1), '') as int) ignore nulls) over (partition by run_id order by seq rows between unbounded preceding and current row), 0) as cluster from run_events", "run_events")
def cluster_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.cluster_context(fixture(spark, sf_dir, "run_events")).select("run_id", "seq", "cluster")


@query("select run_id, stage, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) as seconds from run_events group by run_id, stage", "run_events")
def stage_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.durations(fixture(spark, sf_dir, "run_events")).select("run_id", "stage", r("seconds", 3).alias("seconds"))


@query("select seq, case when seq % 5 = 0 then 'log' else event end as event, case when seq % 5 = 0 then 'not json ' || cast(seq as varchar) end as message, case when seq % 5 <> 0 then stage end as stage from run_events", "run_events")
def ndjson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines, with every fifth line broken, and read again."""
    rows = fixture(spark, sf_dir, "run_events")
    line = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("not json "), "seq")).otherwise(F.to_json(F.struct("event", "stage", "seq")))
    parsed = events.parse_lines(rows.select(line.alias("value")))
    seq = F.coalesce("seq", F.regexp_extract("message", r"(\d+)$", 1).try_cast("long"))
    return parsed.select(seq.alias("seq"), "event", "message", "stage")


# ---------------------------------------------------------------- hardware, settings, responses

RATE = "select s_suppkey, (s_suppkey * 997) % 90000 / 100.0 - 5 as rate, s_suppkey % 4 > 0 as gpu, (s_suppkey * 1234) % 26000 as mb, s_suppkey % 3 as mode from supplier"


@query(f"with q as ({RATE}) select s_suppkey, case when rate > 0 then cast(least(greatest(floor(rate * 10 / 64 + 0.5) * 64, 256), 8192) as int) else 512 end as by_rate, cast(case when not gpu then 512 when mode = 0 then 640 when mb / 1024.0 >= 16 then 4096 when mb / 1024.0 >= 12 then 2048 when mb / 1024.0 >= 8 then 1024 else 768 end as int) as by_memory, round_even(case when rate > 0 then 4096 / rate else 0 end, 6) as throughput from q")
def samples_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "cast((s_suppkey * 997) % 90000 / 100.0 - 5 as double) as rate", "s_suppkey % 4 > 0 as gpu", "(s_suppkey * 1234) % 26000 as mb", "s_suppkey % 3 as mode")
    calibrated = F.when(F.col("mode") == 0, 640)
    return rows.select("s_suppkey", display.samples_for_rate(F.col("rate")).alias("by_rate"), display.samples_for_memory(F.col("gpu"), F.col("mb"), calibrated).alias("by_memory"), r(display.throughput(F.lit(4096), F.col("rate"))).alias("throughput"))


MESSAGES = ["Downloading uv... 40%", "Downloading uv (windows)", "Extracting uv", "Installing Python 3.11", "Creating virtual environment", "Checking for an NVIDIA GPU", "GPU detected: X", "No NVIDIA GPU found", "Installing pipeline dependencies", "anything else"]
PERCENTS = ["10.0", "2.0", "27.0", "42.0", "55.0", "60.0", "66.0", "66.0", "78.0", "null"]


@query("select event_id, cast([" + ", ".join(PERCENTS) + "][event_id % 10 + 1] as double) as percent from events")
def setup_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.get(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", display.setup_percent(message).alias("percent"))


@query("with q as (select p_partkey, ['osv5m', 'yfcc', 'inat', 'own/model'][p_partkey % 4 + 1] as m from part) select p_partkey, case m when 'osv5m' then 'nicolas-dufour/PLONK_OSV_5M' when 'yfcc' then 'nicolas-dufour/PLONK_YFCC' when 'inat' then 'nicolas-dufour/PLONK_iNaturalist' else m end as model from q")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(F.lit("osv5m"), F.lit("yfcc"), F.lit("inat"), F.lit("own/model")), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", display.looked_up(display.MODEL_ALIASES, name).alias("model"))


@query("select tile_no, image_id as id, lat, lon, coalesce(nullif(sd_href, ''), nullif(thumb_href, '')) as thumb_url from imagery where coalesce(nullif(sd_href, ''), nullif(thumb_href, '')) is not null", "imagery")
def stac_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature collection a tile, written as text and read back; a tile holds fewer features than a page."""
    rows = fixture(spark, sf_dir, "imagery")
    one = F.struct(F.col("image_id").alias("id"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.struct(F.col("sd_href").alias("href")).alias("sd"), F.struct(F.col("thumb_href").alias("href")).alias("thumb")).alias("assets"))
    pages = rows.select("tile_no", F.floor(F.col("pos") / 2000).alias("page"), F.struct("pos", one.alias("f")).alias("s")).groupBy("tile_no", "page").agg(F.array_sort(F.collect_list("s")).alias("s"))
    bodies = pages.select("tile_no", F.to_json(F.struct(F.col("s.f").alias("features"))).alias("body"))
    return imagery.features(bodies).select("tile_no", "id", "lat", "lon", "thumb_url")


@query("select i.vec_id, p.tile_no, row_number() over (partition by p.tile_no order by i.pos) as n from imagery i join (select tile_no, avg(lat) as clat, avg(lon) as clon from imagery group by tile_no) p on i.lat between round_even(clat, 4) - 0.004 and round_even(clat, 4) + 0.004 and i.lon between round_even(clon, 4) - 0.004 and round_even(clon, 4) + 0.004 qualify n <= 5", "imagery")
def tile_source_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records in a box around each tile's middle, five a box: a join by grid cell with the box as a residual."""
    rows = fixture(spark, sf_dir, "imagery")
    middles = rows.groupBy("tile_no").agg(F.bround(F.avg("lat"), 4).alias("c_lat"), F.bround(F.avg("lon"), 4).alias("c_lon"))
    cell = lambda c: F.floor(F.col(c) / 0.008)
    boxes = middles.withColumn("y", F.explode(F.array(*[F.floor(F.col("c_lat") / 0.008) + d for d in (-1, 0, 1)]))).withColumn("x", F.explode(F.array(*[F.floor(F.col("c_lon") / 0.008) + d for d in (-1, 0, 1)])))
    found = rows.drop("tile_no").withColumn("y", cell("lat")).withColumn("x", cell("lon")).join(boxes, ["y", "x"])
    found = found.where(F.col("lat").between(F.col("c_lat") - 0.004, F.col("c_lat") + 0.004) & F.col("lon").between(F.col("c_lon") - 0.004, F.col("c_lon") + 0.004))
    return found.withColumn("n", F.row_number().over(Window.partitionBy("tile_no").orderBy("pos")).cast("long")).where("n <= 5").select("vec_id", "tile_no", "n")


@query("select event_id, case when event_id % 3 = 0 then '5' else cast(cast(json_extract(props, '$.k') as bigint) as varchar) end as k, 'x' as token from events")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("event_id") % 3 == 0, F.lit('{"k": 5, "token": "x"}')).otherwise('{"token": "x"}')
    merged = events.merged_settings(F.col("props"), new)
    return table(spark, sf_dir, "events").select("event_id", merged["k"].alias("k"), merged["token"].alias("token"))


@query("select s_suppkey, case when s_suppkey % 4 = 0 then null else 'GPU ' || cast(s_suppkey as varchar) end as gpu_name, case when s_suppkey % 3 = 0 then null else cast(s_suppkey * 100 as int) end as vram_mb from supplier")
def gpu_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("GPU "), F.col("s_suppkey").cast("string")))
    memory = F.when(F.col("s_suppkey") % 3 == 0, "[N/A]").otherwise(F.concat((F.col("s_suppkey") * 100).cast("string"), F.lit(" MiB")))
    line = events.gpu_from_csv(F.concat_ws(", ", name, memory))
    return table(spark, sf_dir, "supplier").select("s_suppkey", line["gpu_name"].alias("gpu_name"), line["vram_mb"].alias("vram_mb"))


@query("select probe_id, rpad('P-_' || cast(probe_id as varchar), 22, 'x') as panoid, case when probe_id % 3 = 0 then qlat else cast('48.' || cast(10 + probe_id % 80 as varchar) as double) end as lat, case when probe_id % 3 = 0 then qlon else cast('-2.' || cast(10 + probe_id % 70 as varchar) as double) end as lon from pano_text", "pano_text")
def pano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imagery.panorama_ids(fixture(spark, sf_dir, "pano_text")).select("probe_id", "panoid", "lat", "lon")


SIDES = "select p_partkey, 200 + (p_partkey * 37) % 4000 as w, 100 + (p_partkey * 53) % 3000 as h from part"


@query(f"with q as ({SIDES}), s as (select *, least(1.0, 1024.0::double / greatest(w, h)) as f from q) select p_partkey, cast(greatest(16, floor(floor(w * f) / 16) * 16) as int) as width, cast(greatest(16, floor(floor(h * f) / 16) * 16) as int) as height from s")
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "200 + (p_partkey * 37) % 4000 as w", "100 + (p_partkey * 53) % 3000 as h")
    width, height = display.resized(F.col("w"), F.col("h"))
    return rows.select("p_partkey", width.alias("width"), height.alias("height"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_source_top5(spark, sf_dir)


assert set(ORACLES) <= set(QUERIES) and FIXTURES
