"""Values worked out by hand, at the boundaries."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenloc.functions import display, geo, imaging, solar
from lumenloc.functions.similarity import score_against
from lumenloc.sources.roads import shrinking, with_retries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "d"), [(350, 10, -20), (10, 350, 20), (180, 0, -180)])
def test_signed_diff(spark, a, b, d):
    assert one(spark, geo.signed_diff(float(a), float(b))) == d


@pytest.mark.parametrize(("p", "b"), [((0, 0, 0, 1), 90), ((0, 0, 1, 0), 0), ((5, 5, 5, 5), 0), ((0, 0, -1, 0), 180)])
def test_bearing(spark, p, b):
    assert one(spark, geo.bearing(*map(float, p))) == pytest.approx(b)


def test_antipodes_have_a_distance(spark):
    assert one(spark, geo.haversine_m(0.0, 0.0, 0.0, 180.0)) == pytest.approx(np.pi * geo.EARTH_M)


@pytest.mark.parametrize(("s", "most", "km"), [(0.0, 15.0, 3), (9.0, 15.0, 15), (9.0, 8.0, 8)])
def test_search_radius(spark, s, most, km):
    assert one(spark, geo.search_radius_km(0.0, s, s, most=most)) == km


@pytest.mark.parametrize(("r", "z"), [(6.1, 10), (6.0, 12), (2.1, 12), (2.0, 13)])
def test_map_zoom(spark, r, z):
    assert one(spark, geo.map_zoom(r)) == z


@pytest.mark.parametrize(
    ("n", "white", "hue", "sat", "val", "label", "sure"),
    [(50, 0.0, 70.0, 0.21, 0.5, "green", 0.21), (50, 0.0, 170.0, 0.9, 0.5, "green", 0.8), (50, 0.0, 69.9, 0.21, 0.5, "brown", 0.36), (50, 0.0, 171.0, 0.9, 0.5, "unknown", 0.0), (49, 0.9, 70.0, 0.9, 0.5, "unknown", 0.0), (50, 0.41, 70.0, 0.9, 0.5, "snow", 0.41), (50, 0.4, 70.0, 0.9, 0.5, "green", 0.8)],
)
def test_season(spark, n, white, hue, sat, val, label, sure):
    a, b = imaging.season(F.lit(n), F.lit(white), F.lit(hue), F.lit(sat), F.lit(val))
    assert (one(spark, a), one(spark, b)) == (label, sure)


@pytest.mark.parametrize(("rgb", "hsv"), [((1.0, 0.0, 0.0), (0, 1, 1)), ((0.0, 1.0, 0.0), (120, 1, 1)), ((0.0, 0.0, 1.0), (240, 1, 1)), ((0.5, 0.5, 0.5), (0, 0, 0.5)), ((0.0, 0.0, 0.0), (0, 0, 0)), ((1.0, 0.0, 0.5), (330, 1, 1))])
def test_hsv(spark, rgb, hsv):
    assert [one(spark, c) for c in imaging.hsv(*map(F.lit, rgb))] == pytest.approx(hsv)


@pytest.mark.parametrize(("month", "n"), [(1, 6), (2, 5), (4, 5)])
def test_dates_of_a_month(spark, month, n):
    assert len(one(spark, imaging.sample_dates(F.array(F.lit(month))))) == n


def test_southern_green_months(spark):
    assert one(spark, imaging.season_months(F.lit("green"), F.lit(-1.0))) == [10, 11, 12, 1, 2, 3]


@pytest.mark.parametrize(("x", "text"), [(0.4, "<1s"), (59.6, "60s"), (119.6, "1m 60s"), (float("nan"), ""), (float("inf"), ""), (-1.0, ""), (60.0, "1m 0s")])
def test_eta_text(spark, x, text):
    assert one(spark, display.eta_text(F.lit(x))) == text


@pytest.mark.parametrize(("rate", "n"), [(0.0, 512), (10.0, 256), (51.2, 512), (5000.0, 8192), (None, 512)])
def test_samples_for_rate(spark, rate, n):
    assert one(spark, display.samples_for_rate(F.lit(rate).cast("double"))) == n


@pytest.mark.parametrize(("inliers", "total", "weak"), [(4, 10, False), (3, 10, True), (0, 0, False), (None, None, False)])
def test_weak(spark, inliers, total, weak):
    assert one(spark, display.is_weak(F.lit(inliers).cast("int"), F.lit(total).cast("int"))) is weak


@pytest.mark.parametrize(("n", "word"), [(4, "moderate"), (5, "low")])
def test_reliability(spark, n, word):
    assert one(spark, display.reliability_token(display.reliability(F.lit(n)))) == word


def test_empty_reliability(spark):
    assert one(spark, display.reliability_token(F.lit(None).cast("string"))) == "checked"


@pytest.mark.parametrize(("size", "fit"), [((2048, 1024), (1024, 512)), ((10, 10), (16, 16)), ((1000, 33), (992, 32))])
def test_resized(spark, size, fit):
    assert tuple(one(spark, c) for c in display.resized(*map(F.lit, size))) == fit


@given(st.floats(-65, 65), st.floats(-180, 180), st.integers(19700, 20100))
def test_sun_events_are_of_a_day(lat, lon, day):
    jd = np.array([day + solar.EPOCH_JD])
    up, east = solar.sun_event(jd, np.array([lat]), np.array([lon]), 1.0)
    down, west = solar.sun_event(jd, np.array([lat]), np.array([lon]), -1.0)
    assert 0 < down[0] - up[0] < 1440
    assert 0 <= east[0] < 180 <= west[0] < 360


@pytest.mark.parametrize(("day", "rise", "fall"), [(19895, 3 * 60 + 43, 20 * 60 + 22), (20078, 8 * 60 + 4, 15 * 60 + 54)])
def test_sun_in_london(day, rise, fall):
    """2024-06-21 and 2024-12-21, to the minute."""
    jd = np.array([day + solar.EPOCH_JD])
    found = [solar.sun_event(jd, np.array([51.5]), np.array([-0.12]), s)[0][0] for s in (1.0, -1.0)]
    assert found == pytest.approx([rise, fall], abs=1)


def test_no_sun_event_in_polar_summer():
    assert np.isnan(solar.sun_event(np.array([19895 + solar.EPOCH_JD]), np.array([69.6]), np.array([18.9]), 1.0)[0])


def test_score_against(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [3.0, 4.0])], "id int, embedding array<float>")
    assert {r.id: r.similarity for r in score_against(df, [1.0, 0.0]).collect()} == {1: 1.0, 2: 0.0, 3: None, 4: None, 5: 0.6}


def test_retries():
    waits, answers = [], iter([(500, None), OSError(), (429, None), (200, "ok")])

    def ask(url):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert with_retries(ask, ["a", "b", "c"], wait=waits.append) == "ok"
    assert waits == [2, 4, 6]
    assert with_retries(lambda _: (404, None), ["a"], wait=waits.append) is None
    assert with_retries(lambda _: (503, None), ["a"], wait=lambda _: None) is None


def test_shrinking_radius():
    asked = []
    assert shrinking(lambda r: asked.append(r), 3.0) is None
    assert asked == [3.0, 1.5, 1.0]
    assert shrinking(lambda r: r if r < 2 else None, 3.0) == 1.5
