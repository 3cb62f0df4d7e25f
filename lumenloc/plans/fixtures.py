"""Input tables derived from generic ones by plain arithmetic, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPOTS = [("0", "48.85", "2.35"), ("1", "40.71", "-74.0"), ("2", "35.68", "139.69"), ("3", "-33.87", "151.2"), (None, "51.5", "-0.12")]


def _spot(key: str, axis: int) -> str:
    whens = " ".join(f"when {k} then cast({v[axis - 1]} as double)" for k, *v in SPOTS if k)
    return f"case {key} {whens} else cast({SPOTS[-1][axis]} as double) end"


FIXTURES = {
    "samples": f"""select event_id as sample_id,
 case when event_id % 17 = 0 then -60 + ((event_id * 7919) % 120000) / cast(1000 as double) else {_spot("user_id % 5", 1)} + ((event_id * 37) % 1000) / cast(1000 as double) - cast(0.5 as double) end as lat,
 case when event_id % 17 = 0 then -179 + ((event_id * 104729) % 358000) / cast(1000 as double) else {_spot("user_id % 5", 2)} + ((event_id * 53) % 1000) / cast(1000 as double) - cast(0.5 as double) end as lon
 from @events""",
    "pixels": """select image_id, y, x,
 case when y < 15 then case kind when 1 then 60 + x when 3 then 90 else 200 + x + (y % 3) end else case when kind = 3 then 90 when kind = 2 and x >= 4 then 240 when kind = 1 then 150 + (x % 7) else 40 + (x % 5) end end as r,
 case when y < 15 then case kind when 1 then 120 + x when 3 then 90 else 150 + y end else case when kind = 3 then 90 when kind = 2 and x >= 4 then 242 when kind = 1 then 110 + (y % 5) else 140 + (y % 9) end end as g,
 case when y < 15 then case kind when 1 then 220 when 3 then 90 else 90 + (x % 11) end else case when kind = 3 then 90 when kind = 2 and x >= 4 then 245 when kind = 1 then 60 else 50 end end as b
 from (select image_id, p % 40 as x, cast(floor(p / cast(40 as double)) as bigint) as y, image_id % 4 as kind from (select cast(floor(event_id / cast(1000 as double)) as bigint) as image_id, event_id % 1000 as p from @events) q1) q2""",
    "road_vertices": f"""select way_id, pos,
 {_spot("way_id % 5", 1)} + ((way_id * 7 + pos * 3) % 100 - 50) / cast(20000 as double) as lat,
 {_spot("way_id % 5", 2)} + ((way_id * 11 + pos * pos) % 100 - 50) / cast(20000 as double) as lon
 from (select cast(floor(p_partkey / cast(8 as double)) as bigint) as way_id, p_partkey % 8 as pos from @part) q""",
    "imagery": """select vec_id, vec_id % 40 as tile_no, vec_id as pos, concat('img', cast(vec_id % 450 as varchar(20))) as image_id,
 case label % 3 when 0 then 'mapillary' when 1 then 'google_sv' else 'panoramax' end as source,
 case when vec_id % 11 = 0 then null when vec_id % 7 = 0 then '' else concat('sd/', cast(vec_id as varchar(20))) end as sd_href,
 case when vec_id % 13 = 0 then null else concat('th/', cast(vec_id as varchar(20))) end as thumb_href,
 cast(48.85 as double) + ((vec_id * 37) % 1000 - 500) / cast(20000 as double) as lat,
 cast(2.35 as double) + ((vec_id * 53) % 1000 - 500) / cast(20000 as double) as lon,
 (vec_id * 37) % 200 as total_matches,
 case when (vec_id * 37) % 200 < 8 then 0 else cast(floor(((vec_id * 37) % 200) * ((vec_id * 13) % 100) / cast(100 as double)) as bigint) end as inliers
 from @embeddings""",
    "progress": """select user_id as run_id, event_id as seq, ts,
 case event_type when 'signup' then 'model_load' when 'view' then 'c0_mapillary' when 'click' then 'c1_google_sv' when 'purchase' then 'zoom_panoramax' else 'sun_refine' end as stage,
 case when event_id % 2 = 0 then 'download' else 'verify' end as phase,
 cast(floor(event_id / cast(40 as double)) as bigint) % 20 as completed, 20 as total
 from @events""",
    "pano_text": """select s_suppkey as probe_id, cast(48.85 as double) as qlat, cast(2.35 as double) as qlon,
 concat('["', rpad(concat('P-_', cast(s_suppkey as varchar(20))), 22, 'x'), '",1', case when s_suppkey % 3 = 0 then ']' else concat(',[null,null,48.', cast(10 + s_suppkey % 80 as varchar(20)), ',-2.', cast(10 + s_suppkey % 70 as varchar(20)), ']]') end) as body
 from @supplier""",
    "probes": """select s_suppkey as cluster, cast(s_suppkey % 130 - 65 as double) as lat, cast((s_suppkey * 47) % 360 - 180 as double) as lon,
 cast(1 + s_suppkey % 5 as double) as radius_km, cast(s_suppkey % 61 - 30 as double) as offset_deg
 from @supplier""",
    "run_events": """select user_id as run_id, event_id as seq, ts,
 case event_type when 'signup' then 'stage_start' when 'view' then 'progress' when 'click' then 'stage_done' when 'purchase' then 'stage_skipped' else 'error' end as event,
 case event_id % 7 when 0 then 'model_load' when 1 then 'plonk_sampling' when 2 then 'sun_refine' when 3 then 'c0_mapillary' when 4 then 'c1_google_sv' when 5 then 'zoom_panoramax' else 'c12_unknown' end as stage
 from @events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    base = text.rpartition("@")[2].split(")")[0].strip()
    return spark.sql(text.replace(f"@{base}", "{base}"), base=table(spark, sf_dir, base))


def with_fixtures(names: str, body: str) -> str:
    """body as SQL after common tables of these fixtures; body may go on with more of them after a comma."""
    parts = ", ".join(f"{n} as ({FIXTURES[n].replace('@', '')})" for n in names.split())
    return f"with {parts} {body}"
