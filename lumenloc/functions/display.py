"""Shown forms of numbers and states."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of stages and of sources, aliases of models.
STAGE_LABELS = {
    "model_load": "Load PLONK model",
    "plonk_sampling": "PLONK coarse locate",
    "sun_refine": "Sun / season plausibility",
    "mapillary": "Mapillary refinement",
    "google_sv": "Google Street View refinement",
    "panoramax": "Panoramax refinement",
}
SOURCE_LABELS = {"mapillary": "Mapillary", "google_sv": "Google Street View", "panoramax": "Panoramax"}
MODEL_ALIASES = {
    "osv5m": "nicolas-dufour/PLONK_OSV_5M",
    "yfcc": "nicolas-dufour/PLONK_YFCC",
    "inat": "nicolas-dufour/PLONK_iNaturalist",
}
#: What set-up messages say, and the percentage that each stands for; the first that matches counts.
SETUP_STEPS = [
    (r"Downloading uv \(", 2.0),
    (r"Extracting uv", 27.0),
    (r"Installing Python", 42.0),
    (r"Creating virtual environment", 55.0),
    (r"Checking for an NVIDIA GPU", 60.0),
    (r"GPU detected", 66.0),
    (r"No NVIDIA GPU", 66.0),
    (r"Installing pipeline dependencies", 78.0),
]


def looked_up(table: dict[str, str], key: Column) -> Column:
    """The table's value, or the key itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], key)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def eta_text(seconds: Column) -> Column:
    """'' for null, NaN, infinite or negative; '<1s'; 'Ns'; 'Nm Ns', whose seconds may round to 60."""
    good = seconds.isNotNull() & ~F.isnan(seconds) & (seconds < float("inf")) & (seconds >= 0)
    minutes = F.format_string("%dm %ds", F.floor(seconds / 60).cast("long"), half_up(seconds % 60).cast("long"))
    return F.when(~good, "").when(seconds < 1, "<1s").when(seconds < 60, F.format_string("%ds", half_up(seconds).cast("long"))).otherwise(minutes)


def to_fixed(x: Column, places: int) -> Column:
    """The number with so many places, rounded by its exact binary value: built-in formats round its decimal form, so
    that ties come out differently. Null stays null."""

    @F.arrow_udf("string")
    def shown(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{places}f}" for v in values.to_pylist()], pa.string())

    return shown(x.cast("double"))


def inlier_text(inliers: Column, total: Column) -> Column:
    """'n/m', or '' for a match that wasn't verified."""
    return F.when(inliers.isNotNull(), F.concat_ws("/", inliers.cast("string"), total.cast("string"))).otherwise("")


def spread_text(km: Column) -> Column:
    return F.when(km < 1, F.format_string("± %d m", half_up(km * 1000).cast("long"))).when(km.isNotNull(), F.format_string("± %.1f km", km))


def similarity_percent(similarity: Column) -> Column:
    return F.least(F.greatest(half_up(similarity * 100), F.lit(2)), F.lit(100)).cast("int")


def is_weak(inliers: Column, total: Column) -> Column:
    """Under 0.4 of the matches are inliers; no matches aren't weak."""
    return F.coalesce((total > 0) & (F.try_divide(inliers, total) < 0.4), F.lit(False))


def stage_cluster(stage: Column) -> Column:
    """The candidate's number in a stage's prefix, or null."""
    return F.regexp_extract(stage, r"^c(\d+)_", 1).try_cast("int")


def bare_stage(stage: Column) -> Column:
    return F.regexp_replace(stage, r"^(c\d+_|zoom_)", "")


def stage_label(stage: Column) -> Column:
    cluster = stage_cluster(stage)
    prefix = F.when(cluster.isNotNull(), F.format_string("Candidate %d · ", cluster + 1)).otherwise("")
    return F.concat(prefix, looked_up(STAGE_LABELS, bare_stage(stage)))


def noise_badge(share: Column) -> tuple[Column, Column]:
    return F.format_string("noise %d%%", half_up(share * 100).cast("long")), F.when(share > 0.25, "warn").otherwise("muted")


def reliability(bearings: Column) -> Column:
    return F.when(bearings > 4, "low (many road orientations nearby, fit is easy)").otherwise("moderate (few road orientations, fit is more constrained)")


def reliability_token(text: Column) -> Column:
    word = F.split(F.coalesce(text, F.lit("")), " ")[0]
    return F.when(word == "", "checked").otherwise(word)


def setup_percent(message: Column) -> Column:
    """Null where the message says nothing about progress."""
    own = F.regexp_extract(message, r"Downloading uv\.\.\.\s*(\d+)%", 1)
    out = F.when(own != "", own.try_cast("double") * 0.25)
    for pattern, percent in SETUP_STEPS:
        out = out.when(message.rlike(pattern), percent)
    return out


def samples_for_rate(rate: Column) -> Column:
    """About ten seconds of samples in steps of 64, from 256 to 8192; 512 without a rate."""
    return F.when(rate > 0, F.least(F.greatest(half_up(rate * 10 / 64) * 64, F.lit(256)), F.lit(8192))).otherwise(512).cast("int")


def samples_for_memory(has_gpu: Column, vram_mb: Column, calibrated: Column) -> Column:
    gb = F.coalesce(vram_mb, F.lit(0)) / 1024
    by_memory = F.when(gb >= 16, 4096).when(gb >= 12, 2048).when(gb >= 8, 1024).otherwise(768)
    return F.when(~F.coalesce(has_gpu, F.lit(False)), 512).when(calibrated > 0, calibrated).otherwise(by_memory).cast("int")


def throughput(batch: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, F.try_divide(batch, elapsed)).otherwise(0.0)


def resized(width: Column, height: Column, longest: int = 1024) -> tuple[Column, Column]:
    """At most longest on the long side, then multiples of 16, at least 16."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    fit = lambda x: F.greatest(F.lit(16), (((x * scale).cast("int")) / 16).cast("int") * 16)
    return fit(width), fit(height)
