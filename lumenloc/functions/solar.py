"""Sunrise, sunset and solar azimuth by the NOAA calculator's equations.

The equations need three dozen intermediate values, each used several times: as column expressions they multiply when
projections are merged, so they are computed on Arrow batches with numpy, a few dozen array operations a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ZENITH = 90.833
EPOCH_JD = 2440587.5  # Julian day of 1970-01-01 at midnight


def position(jd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Declination in degrees and equation of time in minutes."""
    t = (jd - 2451545.0) / 36525.0
    mean_long = np.radians(np.mod(280.46646 + t * (36000.76983 + 0.0003032 * t), 360.0))
    anomaly = np.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    eccentric = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = np.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + np.sin(2 * anomaly) * (0.019993 - 0.000101 * t) + np.sin(3 * anomaly) * 0.000289
    node = np.radians(125.04 - 1934.136 * t)
    apparent = np.radians(np.degrees(mean_long) + centre - 0.00569 - 0.00478 * np.sin(node))
    tilt = np.radians(23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * np.cos(node))
    y = np.tan(tilt / 2) ** 2
    minutes = 4 * np.degrees(y * np.sin(2 * mean_long) - 2 * eccentric * np.sin(anomaly) + 4 * eccentric * y * np.sin(anomaly) * np.cos(2 * mean_long) - 0.5 * y * y * np.sin(4 * mean_long) - 1.25 * eccentric * eccentric * np.sin(2 * anomaly))
    return np.degrees(np.arcsin(np.sin(tilt) * np.sin(apparent))), minutes


def event_minutes(jd: np.ndarray, lat: np.ndarray, lon: np.ndarray, side: float) -> np.ndarray:
    """Minutes after midnight UTC, which may leave 0 to 1440; NaN where the sun doesn't cross the horizon."""
    decl, eot = position(jd)
    a, d = np.radians(lat), np.radians(decl)
    with np.errstate(invalid="ignore"):
        hour = np.degrees(np.arccos(np.cos(np.radians(ZENITH)) / (np.cos(a) * np.cos(d)) - np.tan(a) * np.tan(d)))
    return 720.0 - 4.0 * (lon + side * hour) - eot


def sun_event(jd0: np.ndarray, lat: np.ndarray, lon: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray]:
    """Minutes and azimuth of the sunrise (side 1) or sunset (-1): the time is taken at noon, then at that time."""
    minutes = event_minutes(jd0 + event_minutes(jd0 + 0.5, lat, lon, side) / 1440.0, lat, lon, side)
    decl, eot = position(jd0 + minutes / 1440.0)
    angle, a = np.radians((minutes + eot + 4.0 * lon) / 4.0 - 180.0), np.radians(lat)
    azimuth = np.degrees(np.arctan2(np.sin(angle), np.cos(angle) * np.sin(a) - np.tan(np.radians(decl)) * np.cos(a))) + 180.0
    return minutes, np.mod(azimuth, 360.0)


def with_sun_events(df: DataFrame, date: str = "date") -> DataFrame:
    """df (lat, lon, date) with a row for each sunrise and sunset: event, minutes, azimuth. Dates without one, and nulls, are left out."""
    df = df.drop("event", "minutes", "azimuth")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon = (np.asarray(pc.cast(batch.column(names.index(c)), pa.float64()).to_numpy(zero_copy_only=False)) for c in ("lat", "lon"))
            days = pc.cast(pc.cast(batch.column(names.index(date)), pa.date32()), pa.int32()).to_numpy(zero_copy_only=False)
            jd0 = np.asarray(days, np.float64) + EPOCH_JD
            for event, side in (("sunrise", 1.0), ("sunset", -1.0)):
                minutes, azimuth = sun_event(jd0, lat, lon, side)
                there = pa.array(np.isfinite(minutes))
                rows = [*batch.columns, pa.array([event] * batch.num_rows, pa.string()), pa.array(minutes), pa.array(azimuth)]
                yield pa.RecordBatch.from_arrays([x.filter(there) for x in rows], names=[*names, "event", "minutes", "azimuth"])

    schema = T.StructType([*df.schema.fields, T.StructField("event", T.StringType()), T.StructField("minutes", T.DoubleType()), T.StructField("azimuth", T.DoubleType())])
    return df.mapInArrow(run, schema)


def position_steps(jd: str, p: str) -> list[tuple[str, str]]:
    """The same equations as SQL over named columns: declination ({p}decl) and equation of time ({p}eot)."""
    t = f"{p}t"
    return [
        (t, f"(({jd}) - 2451545.0) / 36525.0"),
        (f"{p}l", f"(((280.46646 + {t} * (36000.76983 + 0.0003032 * {t})) % 360.0) + 360.0) % 360.0"),
        (f"{p}m", f"357.52911 + {t} * (35999.05029 - 0.0001537 * {t})"),
        (f"{p}e", f"0.016708634 - {t} * (0.000042037 + 0.0000001267 * {t})"),
        (f"{p}c", f"sin(radians({p}m)) * (1.914602 - {t} * (0.004817 + 0.000014 * {t})) + sin(radians(2.0 * {p}m)) * (0.019993 - 0.000101 * {t}) + sin(radians(3.0 * {p}m)) * 0.000289"),
        (f"{p}om", f"125.04 - 1934.136 * {t}"),
        (f"{p}la", f"{p}l + {p}c - 0.00569 - 0.00478 * sin(radians({p}om))"),
        (f"{p}ob", f"23.0 + (26.0 + (21.448 - {t} * (46.815 + {t} * (0.00059 - {t} * 0.001813))) / 60.0) / 60.0 + 0.00256 * cos(radians({p}om))"),
        (f"{p}decl", f"degrees(asin(sin(radians({p}ob)) * sin(radians({p}la))))"),
        (f"{p}y", f"power(tan(radians({p}ob / 2.0)), 2)"),
        (f"{p}eot", f"4.0 * degrees({p}y * sin(2.0 * radians({p}l)) - 2.0 * {p}e * sin(radians({p}m)) + 4.0 * {p}e * {p}y * sin(radians({p}m)) * cos(2.0 * radians({p}l)) - 0.5 * {p}y * {p}y * sin(4.0 * radians({p}l)) - 1.25 * {p}e * {p}e * sin(2.0 * radians({p}m)))"),
    ]


def event_steps(p: str, out: str) -> list[tuple[str, str]]:
    cos_h = f"cos(radians({ZENITH})) / (cos(radians(lat)) * cos(radians({p}decl))) - tan(radians(lat)) * tan(radians({p}decl))"
    return [(f"{p}h", cos_h), (out, f"case when abs({p}h) <= 1.0 then 720.0 - 4.0 * (lon + side * degrees(acos({p}h))) - {p}eot end")]


def steps() -> list[tuple[str, str]]:
    """From columns jd0 (Julian day at midnight UTC), lat, lon and side to minutes and azimuth, in SQL."""
    return [
        *position_steps("jd0 + 0.5", "a_"),
        *event_steps("a_", "first_guess"),
        *position_steps("jd0 + first_guess / 1440.0", "b_"),
        *event_steps("b_", "minutes"),
        *position_steps("jd0 + minutes / 1440.0", "c_"),
        ("hour_angle", "(minutes + c_eot + 4.0 * lon) / 4.0 - 180.0"),
        ("azimuth", "(((degrees(atan2(sin(radians(hour_angle)), cos(radians(hour_angle)) * sin(radians(lat)) - tan(radians(c_decl)) * cos(radians(lat)))) + 180.0) % 360.0) + 360.0) % 360.0"),
    ]
