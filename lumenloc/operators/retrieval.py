"""Candidates: dedup, limits, similarity ranking, two-tier re-ranking, clean output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERIFY_TOP, TOP = 15, 5
SOURCES = ("mapillary", "google_sv", "panoramax")


def keep_first(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key; Spark cuts each task's rows by a partial window-group limit before they move."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def usable_thumb(sd: Column, thumb: Column) -> Column:
    """The first of both that is neither null nor empty."""
    return F.coalesce(F.nullif(sd, F.lit("")), F.nullif(thumb, F.lit("")))


def limit_each(df: DataFrame, key: str, n: int, *order: str | Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def two_tier(df: DataFrame, by: str | list[str], verify_top: int = VERIFY_TOP, position: str = "pos") -> DataFrame:
    """df with rank: similarity first, then the first verify_top by inliers, which the others keep following.

    One shuffle by the key serves both windows. A null count of inliers in the first tier is 0.
    """
    key = [by] if isinstance(by, str) else by
    first = Window.partitionBy(*key).orderBy(F.desc("similarity"), position)
    ranked = df.withColumn("_rn", F.row_number().over(first))
    tier = F.col("_rn") > verify_top
    second = Window.partitionBy(*key).orderBy(tier, F.desc(F.when(tier, 0).otherwise(F.coalesce("inliers", F.lit(0)))), "_rn")
    return ranked.withColumn("rank", F.row_number().over(second)).drop("_rn")


def best_of_each(df: DataFrame, by: str, top: int = TOP, verify_top: int = VERIFY_TOP) -> DataFrame:
    """The best ``top`` after re-ranking. Rows past the first tier can only matter if top exceeds it, so they go early."""
    reach = max(top, verify_top)
    window = Window.partitionBy(by).orderBy(F.desc("similarity"), "pos")
    head = df.withColumn("_h", F.row_number().over(window)).where(F.col("_h") <= reach).drop("_h")
    return two_tier(head, by, verify_top).where(F.col("rank") <= top)


def picked_url(source: Column, mapillary: Column, street_view: Column, panoramax: Column) -> Column:
    """The url under the source's own key, else the first of the others that is there; '' without any."""
    given = [F.nullif(c, F.lit("")) for c in (mapillary, street_view, panoramax)]
    own = F.when(source == "mapillary", given[0]).when(source == "google_sv", given[1]).when(source == "panoramax", given[2])
    return F.coalesce(own, *given, F.lit(""))


#: Where a match of each source is shown.
def match_url(source: Column, image_id: Column, lat: Column, lon: Column) -> Column:
    return (
        F.when(source == "mapillary", F.concat(F.lit("https://www.mapillary.com/app/?pKey="), image_id, F.lit("&focus=photo")))
        .when(source == "google_sv", F.format_string("https://www.google.com/maps?q=&layer=c&cbll=%.6f,%.6f", lat, lon))
        .when(source == "panoramax", F.concat(F.lit("https://api.panoramax.xyz/#focus=pic&pic="), image_id))
    )


def source_counts(df: DataFrame) -> DataFrame:
    """cluster, source and how many matches each has."""
    return df.groupBy("cluster", "source").agg(F.count("*").alias("n"))


def running_counts(df: DataFrame, position: str = "pos") -> DataFrame:
    """df with n: how many matches its cluster and source have up to that row."""
    w = Window.partitionBy("cluster", "source").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("n", F.count("*").over(w))


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """One table of matches; columns that a source lacks are null."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def cleaned(df: DataFrame) -> DataFrame:
    """Without private columns, whose names start with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])
