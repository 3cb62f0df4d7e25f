"""Pixel statistics: colour conversion and the classifiers built on per-image aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUND, SKY = 0.55, 0.6
LEAST_SATURATED = 50
#: Months of each season in the northern hemisphere.
SEASON_MONTHS = {
    "green": [4, 5, 6, 7, 8, 9],
    "brown": [9, 10, 11, 12, 1],
    "snow": [11, 12, 1, 2, 3],
    "unknown": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12],
}


def is_ground(y: Column, height: Column) -> Column:
    return y >= F.floor(height * GROUND)


def is_sky(y: Column, height: Column) -> Column:
    """Sky and ground overlap between 0.55 and 0.6 of the height."""
    return y < F.floor(height * SKY)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation, value of channels in [0, 1]; grey has hue 0, black saturation 0."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    turn = F.when(delta == 0, 0.0).when(top == r, (g - b) / delta).when(top == g, 2.0 + (b - r) / delta).otherwise(4.0 + (r - g) / delta)
    return F.pmod(turn / 6.0, F.lit(1.0)) * 360, F.when(top > 0, delta / top).otherwise(0.0), top


def season(saturated: Column, white: Column, hue: Column, sat: Column, val: Column) -> tuple[Column, Column]:
    """Label and confidence from the count of saturated pixels, the share of white ones and the saturated means."""
    few = saturated < LEAST_SATURATED
    green = (hue >= 70) & (hue <= 170) & (sat > 0.2)
    brown = (hue >= 20) & (hue < 70)
    label = F.when(few, "unknown").when(white > 0.4, "snow").when(green, "green").when(brown, "brown").otherwise("unknown")
    sure = F.when(few, 0.0).when(white > 0.4, F.least(white, F.lit(0.8))).when(green, F.least(sat, F.lit(0.8))).when(brown, F.least(sat + (1 - val) * 0.3, F.lit(0.8))).otherwise(0.0)
    return label, F.bround(sure, 2)


def golden_hour(warm: Column, blue: Column) -> tuple[Column, Column]:
    golden = (warm > 0.25) & (warm > blue)
    return golden, F.bround(F.least(F.when(golden, warm).otherwise(blue), F.lit(0.9)), 2)


def season_months(label: Column, lat: Column) -> Column:
    """The season's months; shifted by half a year south of the equator."""
    table = F.create_map(*[x for k, v in SEASON_MONTHS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    months = table[label]
    return F.when(lat < 0, F.transform(months, lambda m: (m - 1 + 6) % 12 + 1)).otherwise(months)


def sample_dates(months: Column, year: int = 2024, step: int = 6) -> Column:
    """Every step-th day of each month, from its first."""
    first = lambda m: F.make_date(F.lit(year), m, F.lit(1))
    return F.flatten(F.transform(months, lambda m: F.sequence(first(m), F.last_day(first(m)), F.expr(f"interval {step} days"))))
