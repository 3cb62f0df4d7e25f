"""A photo's season, golden hour and sun offset from its pixels (image_id, y, x, r, g, b in 0..255)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import imaging


def sized(pixels: DataFrame) -> DataFrame:
    """pixels with their image's height and width, as the image scan gives them; without these, a row an image joins
    back, so no window holds an image's pixels."""
    if {"h", "w"} <= set(pixels.columns):
        return pixels
    size = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return pixels.join(size, "image_id")


def season(pixels: DataFrame) -> DataFrame:
    """image_id, season, confidence: one pre-aggregated pass over ground pixels."""
    ground = sized(pixels).where(imaging.is_ground(F.col("y"), F.col("h")))
    hue, sat, val = imaging.hsv(F.col("r") / 255, F.col("g") / 255, F.col("b") / 255)
    rows = ground.select("image_id", hue.alias("hue"), sat.alias("sat"), val.alias("val"))
    full = F.col("sat") > 0.15
    means = rows.groupBy("image_id").agg(
        F.count_if(full).alias("n"), F.avg(((F.col("sat") < 0.1) & (F.col("val") > 0.75)).cast("int")).alias("white"),
        F.avg(F.when(full, F.col("hue"))).alias("hue"), F.avg(F.when(full, F.col("sat"))).alias("sat"), F.avg(F.when(full, F.col("val"))).alias("val"),
    )
    label, sure = imaging.season(F.col("n"), F.col("white"), F.col("hue"), F.col("sat"), F.col("val"))
    return means.select("image_id", label.alias("season"), sure.alias("confidence"))


def golden_hour(pixels: DataFrame) -> DataFrame:
    sky = sized(pixels).where(imaging.is_sky(F.col("y"), F.col("h")))
    tilt = F.col("r") / 255 - F.col("b") / 255
    shares = sky.groupBy("image_id").agg(F.avg((tilt > 0.08).cast("int")).alias("warm"), F.avg((-tilt > 0.08).cast("int")).alias("blue"))
    golden, sure = imaging.golden_hour(F.col("warm"), F.col("blue"))
    return shares.select("image_id", golden.alias("golden"), sure.alias("confidence"))


def sky_scores(pixels: DataFrame) -> DataFrame:
    sky = sized(pixels).where(imaging.is_sky(F.col("y"), F.col("h")))
    bright = (F.col("r") + F.col("g") + F.col("b")) / 3
    warm = F.least(F.greatest(F.col("r") - F.col("b"), F.lit(0)), F.lit(255))
    return sky.select("image_id", "x", "w", (bright * 0.5 + warm * 0.5).alias("score"))


def sky_histogram(scores: DataFrame) -> DataFrame:
    """image_id, score and how many pixels have it, the sum of their x and the width: one pass, and 1531 scores at most."""
    return scores.groupBy("image_id", "score").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.first("w").alias("w"))


def sky_threshold(histogram: DataFrame) -> DataFrame:
    """The exact 99th percentile, interpolated."""
    return histogram.groupBy("image_id").agg(F.percentile("score", F.lit(0.99), F.col("n")).alias("p99"))


def sun_offset(pixels: DataFrame, fov: float = 65.0) -> DataFrame:
    """image_id, offset in degrees from the image's middle, confidence: all but the histogram works on few rows."""
    histogram = sky_histogram(sky_scores(pixels))
    rows = histogram.join(sky_threshold(histogram), "image_id").withColumn("hot", F.col("score") >= F.col("p99"))
    hot = lambda c: F.sum(F.when(F.col("hot"), F.col(c)))
    found = rows.groupBy("image_id").agg((hot("sx") / hot("n")).alias("cx"), F.first("w").alias("w"), (hot("n") / F.sum("n")).alias("share"))
    sure = F.least(F.greatest(1 - 20 * F.col("share"), F.lit(0.1)), F.lit(1.0))
    return found.where("cx is not null").select("image_id", F.bround((F.col("cx") / F.col("w") - 0.5) * fov, 1).alias("offset_deg"), F.bround(sure, 2).alias("confidence"))
