"""Operators against plain Python, and the plans that they must have."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenloc.functions import display, geo
from lumenloc.operators import photo, progress, retrieval, spatial, sunfit
from lumenloc.operators.dbscan import dbscan, noise_share, summarize
from lumenloc.operators.verify import gated, verify
from lumenloc.plans import catalog, locate
from lumenloc.plans.fixtures import fixture
from lumenloc.sources import events, imagery
from lumenloc.sources.roads import addresses, vertices, with_retries
from lumenloc.streaming import progress as streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def sequential_dbscan(points, radius_m, need):
    near = [[j for j, q in enumerate(points) if haversine(p, q) <= radius_m] for p in points]
    label, n = [-1] * len(points), 0
    for i in range(len(points)):
        if label[i] != -1 or len(near[i]) < need:
            continue
        queue = [i]
        label[i] = n
        while queue:
            k = queue.pop()
            if len(near[k]) >= need:
                for j in near[k]:
                    if label[j] == -1:
                        label[j] = n
                        queue.append(j)
        n += 1
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_dbscan_is_the_sequential_one(spark, seed):
    rnd = random.Random(seed)
    centres = [(0, 179.9), (60, 10), (-89.9, 0), (10, 10), (10, 12.2)]
    points = [(max(-90.0, min(90.0, c[0] + rnd.gauss(0, 0.6))), (c[1] + rnd.gauss(0, 0.6) + 180) % 360 - 180) for c in rnd.choices(centres, k=150)]
    points += [(rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for _ in range(20)] + points[:5]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "sample_id long, lat double, lon double")
    found = {r.sample_id: r.label for r in dbscan(df, min_share=0.03).collect()}
    assert [found[i] for i in range(len(points))] == sequential_dbscan(points, 100_000, max(3, int(len(points) * 0.03)))


def test_dbscan_without_points(spark):
    df = spark.createDataFrame([], "sample_id long, lat double, lon double")
    assert dbscan(df).collect() == []
    lonely = spark.createDataFrame([(1, 0.0, 0.0), (2, None, None)], "sample_id long, lat double, lon double")
    out = dbscan(lonely)
    assert {r.label for r in out.collect()} == {-1}
    assert noise_share(out).first().noise_frac == 1.0
    assert summarize(out).collect() == []


def test_two_tier_is_the_sequential_order(spark):
    rnd = random.Random(3)
    rows = [(i % 3, i, round(rnd.random(), 1), rnd.choice([None, 0, 5, 9])) for i in range(120)]
    df = spark.createDataFrame(rows, "source int, pos int, similarity double, inliers int")
    found = retrieval.two_tier(df, "source", 15)
    best = retrieval.best_of_each(df, "source", 5, 15)
    for s in range(3):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[1]))
        expected = [r[1] for r in sorted(own[:15], key=lambda r: -(r[3] or 0)) + own[15:]]
        assert [r.pos for r in found.where(F.col("source") == s).orderBy("rank").collect()] == expected
        assert [r.pos for r in best.where(F.col("source") == s).orderBy("rank").collect()] == expected[:5]
    assert "WindowGroupLimit" in plan(best)


def test_near_pairs_finds_all(spark):
    rnd = random.Random(5)
    points = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(300)] + [(0.0, 179.999), (0.0, -179.999), (90.0, 5.0), (89.99, -170.0), (-90.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lat double, lon double")
    pairs = spatial.near_pairs(df, df, 800_000.0)
    found = {(r.l_id, r.r_id) for r in pairs.collect()}
    assert found == {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if haversine(p, q) <= 800_000}
    assert "NestedLoop" not in plan(pairs)


@pytest.mark.parametrize(("metres", "n"), [(59, 1), (120.1, 2), (179, 2)])
def test_road_points(spark, metres, n):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, metres / geo.EARTH_M * 180 / math.pi, 0.0)], "way_id int, pos int, lat double, lon double")
    assert spatial.road_points(df).count() == n


def test_tiles_cover_the_box(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0), (80.0, 10.0, 1.0)], "lat double, lon double, radius_km double")
    rows = spatial.tile_grid(df).collect()
    assert sum(r.lat == 0.0 for r in rows) == 49
    for r in (0.0, 80.0):
        own = [x for x in rows if x.lat == r]
        assert min(x.min_lat for x in own) <= r - own[0].radius_km / 111 + 1e-9
        assert max(x.max_lat for x in own) >= r + own[0].radius_km / 111 - 1e-9


def test_top_k_needs_no_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(catalog.cosine_topk(spark, sf_dir))


def test_bbox_reaches_the_scan(spark, sf_dir, tmp_path):
    fixture(spark, sf_dir, "imagery").write.parquet(str(tmp_path / "i"))
    df = spark.read.parquet(str(tmp_path / "i")).where(geo.in_bbox("lat", "lon", 48.85, 2.35, 1.0)).select("vec_id")
    assert "PushedFilters: [IsNotNull(lat), IsNotNull(lon), GreaterThanOrEqual(lat" in df._jdf.queryExecution().executedPlan().treeString(True, True, 10000, False, False) or "GreaterThanOrEqual(lat" in plan(df)


def test_season_guard(spark):
    rows = [(1, y, x, *((200, 60, 60) if y * 10 + x < 49 else (255, 255, 255))) for y in range(10) for x in range(10)]
    rows = [(i, y + 100, x, r, g, b) for i, y, x, r, g, b in rows] + [(1, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "image_id int, y long, x long, r int, g int, b int")
    assert photo.season(df).first().season == "unknown"


def test_image_bytes(spark):
    image = spark.createDataFrame([(1, (2, 2, 3, bytearray([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])))], "image_id int, image struct<width: int, height: int, nChannels: int, data: binary>")
    found = {(r.y, r.x): (r.r, r.g, r.b) for r in imagery.pixels(image).collect()}
    assert found == {(0, 0): (3, 2, 1), (0, 1): (6, 5, 4), (1, 0): (9, 8, 7), (1, 1): (12, 11, 10)}


def test_sun_fit_without_roads(spark):
    clusters = spark.createDataFrame([(1, 48.0, 2.0, 3.0)], "cluster int, lat double, lon double, offset_deg double")
    heads = spark.createDataFrame([], "cluster int, n_bearings int, headings array<int>")
    dates = clusters.select("cluster", F.lit("2024-03-01").cast("date").alias("date"))
    r = sunfit.fit(clusters, heads, dates).first()
    assert r.error is None
    assert r.note == "no usable road data nearby"


def test_parse_lines(spark):
    lines = spark.createDataFrame([('{"event": "progress", "ts": 1.5, "stage": "c0_mapillary", "completed": 3, "total": 9}',), ("oops",), ("",), (None,)], "value string")
    rows = events.parse_lines(lines).collect()
    assert [r.event for r in rows] == ["progress", "log", "log", "log"]
    assert rows[0].completed == 3
    assert rows[1].message == "oops"


def test_merged_settings(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}', '{"b": 3}'), ("broken", '{"x": 1}'), (None, None)], "o string, n string")
    assert [r.m for r in df.select(events.merged_settings(F.col("o"), F.col("n")).alias("m")).collect()] == [{"a": "1", "b": "3"}, {"x": "1"}, {}]


def test_features(spark):
    body = '{"features": [{"id": "a", "geometry": {"coordinates": [2, 1]}, "assets": {"sd": {"href": ""}, "thumb": {"href": "t"}}}, {"id": "b", "geometry": {"coordinates": [2, 1]}}, {"id": "c", "assets": {"sd": {"href": "s"}}}, {"id": "a", "geometry": {"coordinates": [4, 3]}, "assets": {"sd": {"href": "s"}}}]}'
    df = spark.createDataFrame([(1, body), (2, "broken")], "q int, body string")
    assert [(r.id, r.lat, r.lon, r.thumb_url) for r in imagery.features(df).collect()] == [("a", 1.0, 2.0, "t"), ("a", 3.0, 4.0, "s")]


def search(tile, limit):
    if tile[0] > 1:
        raise OSError
    return [(f"i{k}", tile[0], tile[1], "t") for k in range(9)]


def test_tile_source(spark):
    spark.dataSource.register(imagery.TileSource)
    df = spark.read.format("imagery_tiles").option("tiles", "0,0,1,1\n1,1,2,2\n2,2,3,3").option("module", "test_operators").option("function", "search").load()
    rows = df.collect()
    assert [sum(r.tile_no == k for r in rows) for k in range(3)] == [5, 5, 0]


def test_fetch_embed_mosaic(spark):
    rows = spark.createDataFrame([("a",), ("bad",)], "thumb_url string")

    def fetch(url):
        if url == "bad":
            raise ValueError("not an image")
        return url.encode()

    done = spark.sparkContext.accumulator(0)
    got = imagery.fetched(rows.repartition(1), fetch, on_progress=lambda n: done.add(1))
    assert [r.content for r in got.collect()] == [bytearray(b"a")]
    assert done.value == 2
    assert [r.embedding for r in imagery.embedded(got, lambda c: [[float(len(x))] for x in c]).collect()] == [[1.0]]
    reds, blues = (np.tile(np.array(c, np.uint8), (512, 512, 1)).tobytes() for c in ([255, 0, 0], [0, 0, 255]))
    tiles = spark.createDataFrame([("p", 1, 0, reds), ("p", 3, 1, blues), ("p", 3, 1, blues), ("p", 2, 1, b"broken"), ("q", 0, 0, None)], "panoid string, x int, y int, content binary")
    (r,) = imagery.mosaics(tiles).collect()
    assert (r.panoid, r.n_tiles, r.image.width, r.image.height, r.image.nChannels) == ("p", 3, 2048, 1024, 3)
    expected = np.zeros((1024, 2048, 3), np.uint8)
    expected[:512, 512:1024, 0] = 255
    expected[512:, 1536:, 2] = 255
    assert (np.frombuffer(r.image.data, np.uint8).reshape(1024, 2048, 3)[:, :, ::-1] == expected).all()


def test_large_images_take_time_in_proportion(spark):
    """Twelve million pixels, all of which come out as they are."""
    rnd = np.random.default_rng(0)
    data = rnd.integers(0, 256, (3000, 4000, 3), dtype=np.uint8)
    image = spark.createDataFrame([(1, (4000, 3000, 3, bytearray(data.tobytes())))], "image_id int, image struct<width: int, height: int, nChannels: int, data: binary>")
    sums = imagery.pixels(image).agg(F.count("*"), F.sum("r"), F.sum(F.col("g") * F.col("x")), F.sum(F.col("b") * F.col("y")), F.max("h"), F.max("w")).first()
    wide = data.astype(np.int64)
    assert tuple(sums) == (12_000_000, wide[:, :, 2].sum(), (wide[:, :, 1] * np.arange(4000)).sum(), (wide[:, :, 0] * np.arange(3000)[:, None]).sum(), 3000, 4000)
    grey = spark.createDataFrame([(2, (2, 1, 1, bytearray([7, 9]))), (3, (0, 0, 3, bytearray()))], "image_id int, image struct<width: int, height: int, nChannels: int, data: binary>")
    assert [(r.x, r.r, r.g, r.b) for r in imagery.pixels(grey).collect()] == [(0, 7, 7, 7), (1, 9, 9, 9)]


def test_verify(spark):
    rows = [(1, 1, b"8 9 8"), (2, 2, b"7 9 9"), (3, 3, b"9 7 7"), (4, 4, None), (5, 5, b"bad"), (6, 6, b"9 9 9")]
    df = spark.createDataFrame(rows, "id int, rank int, image binary").withColumn("inliers", F.lit("kept by nobody"))
    match = lambda target, image: tuple(int(x) + target for x in image.split())

    def load(row):
        if row["id"] == 4:
            return b"8 8 8"
        raise ValueError

    found = {r.id: (r.inliers, r.total_matches) for r in verify(df, 0, match, "image", load, "rank", 5).collect()}
    assert found == {1: (8, 9), 2: (0, 0), 3: (0, 7), 4: (8, 8), 5: (0, 0), 6: (None, None)}
    assert {r.id: r.inliers for r in verify(df, 0, match, "image").collect()}[4] == 0
    i, t = gated(F.col("k"), F.col("t"), F.col("i"))
    gates = spark.createDataFrame([(8, 9, 8), (7, 9, 9), (9, 7, 7), (None, None, None)], "k int, t int, i int").select(i.alias("i"), t.alias("t"))
    assert sorted(map(tuple, gates.collect())) == [(0, 0), (0, 0), (0, 7), (8, 9)]


def test_overall_progress_is_sticky(spark):
    rows = [(1, 1, "stage_done", "sun_refine"), (1, 2, "progress", "sun_refine"), (1, 3, "stage_start", "c4_mapillary"), (1, 4, "stage_done", "zoom_mapillary"), (1, 5, "log", None)]
    rows += [(2, 6 + k, "stage_skipped", s) for k, s in enumerate(["model_load", "plonk_sampling", "sun_refine", "c0_mapillary", "c0_google_sv", "c0_panoramax"])] + [(3, 20, "log", None)]
    df = spark.createDataFrame(rows, "run_id int, seq int, event string, stage string")
    found = {r.run_id: (r.done, r.total, r.percent, r.text) for r in progress.overall(df).collect()}
    assert found == {1: (1, 7, 14, "Running · 1/7"), 2: (6, 6, 100, "Complete"), 3: (0, 6, 0, "Running · 0/6")}


def test_retries_whatever_goes_wrong():
    answers, waits, asked = [(404, "a"), ValueError(), (500, "b"), (200, "c")], [], []

    def ask(mirror):
        asked.append(mirror)
        a = answers[len(asked) - 1]
        if isinstance(a, Exception):
            raise a
        return a

    assert with_retries(ask, ["x", "y"], wait=waits.append) == "c"
    assert (asked, waits) == (["x", "y", "x", "y"], [2, 4, 6])
    asked.clear()
    answers[3] = (302, "d")
    waits.clear()
    assert with_retries(ask, ["x", "y"], wait=waits.append) is None
    assert waits == [2, 4, 6, 8]


def test_exact_rounding(spark):
    values = [0.1235, 0.0005, 0.99951, 0.5, -0.1235, None, 0.9995]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(display.to_fixed(F.col("v"), 3).alias("t")).collect()] == [None if v is None else f"{v:.3f}" for v in values]


def test_dbscan_of_a_hot_spot(spark):
    """Twenty thousand different points around one place: no pairs of them are made."""
    df = spark.range(20_000).select(F.col("id").cast("string").alias("sample_id"), (F.lit(10.0) + F.pmod(F.xxhash64("id"), F.lit(10_007)) / 30_000).alias("lat"), (F.lit(20.0) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_009)) / 30_000).alias("lon"))
    out = dbscan(df)
    assert {(r.label, r["count"]) for r in out.groupBy("label").count().collect()} == {(0, 20_000)}


def test_addresses_and_vertices(spark):
    points = spark.createDataFrame([(1, 48.0, 2.0), (2, 0.0, 0.0)], "id int, lat double, lon double")
    places = spark.createDataFrame([("near", 48.1, 2.0), ("far", 48.3, 2.0)], "address string, lat double, lon double")
    assert {r.id: r.address for r in addresses(points, places).collect()} == {1: "near", 2: None}
    ways = spark.createDataFrame([(1, [(1.0, 2.0), (3.0, 4.0)])], "way_id int, geometry array<struct<lat: double, lon: double>>")
    assert [(r.pos, r.lat, r.lon) for r in vertices(ways).collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]


def test_progress_resets(spark):
    rows = [(1, i, i, "s", "p", c, 20) for i, c in enumerate([5, 7, 9, 2, 2, 6, 20])]
    df = spark.createDataFrame(rows, "run_id long, seq long, ts int, stage string, phase string, completed long, total long").withColumn("ts", F.timestamp_seconds("ts"))
    assert [r.rate for r in progress.progress_eta(df).orderBy("seq").collect()] == [0.0, 2.0, 2.0, 0.0, 0.0, 2.0, 6.0]


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    src = tmp_path / "in"
    fixture(spark, sf_dir, "progress").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(src))
    batch = spark.read.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    found = streams.run_available(streams.stream_eta(stream.withColumn("completed", F.col("completed").cast("long")).withColumn("total", F.col("total").cast("long"))), "eta", str(tmp_path / "c1"))
    key = lambda df: sorted((r.run_id, r.seq, round(r.rate, 6)) for r in df.collect() if r.rate is not None)
    assert key(found) == key(progress.progress_eta(batch))
    src = tmp_path / "ev"
    fixture(spark, sf_dir, "run_events").write.parquet(str(src))
    batch = spark.read.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    found = streams.run_available(streams.stream_states(stream), "states", str(tmp_path / "c2"), "complete")
    assert sorted(found.collect()) == sorted(progress.stage_states(batch).collect())
    counts = streams.run_available(streams.stream_counts(stream), "counts", str(tmp_path / "c3"), "append")
    assert counts.count() > 0


def test_locate_end_to_end(spark, sf_dir):
    samples, roads = fixture(spark, sf_dir, "samples"), fixture(spark, sf_dir, "road_vertices")
    pixels = fixture(spark, sf_dir, "pixels").where("image_id = 0")
    images = fixture(spark, sf_dir, "imagery").join(catalog.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    query = catalog.table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding
    out = locate.locate(spark, samples, images, roads, pixels, query)
    assert out["clusters"].count() == 5
    assert locate.report(out["clusters"]).count() == 5
    assert out["sun"].count() == 5
    out["matches"].collect()
    point = locate.refine_point(spark, 48.85, 2.35, images, query)
    ranks = {}
    for r in point.collect():
        ranks.setdefault(r.source, []).append(r["rank"])
    assert set(ranks) == set(retrieval.SOURCES)
    assert all(sorted(v) == [1, 2, 3, 4, 5] for v in ranks.values())
