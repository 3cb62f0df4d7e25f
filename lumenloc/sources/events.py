"""NDJSON events, JSON settings, CSV of hardware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = (
    "event string, ts double, run_id long, seq long, stage string, phase string, completed long, total long, reason string, message string, code int, index int, lat double, lon double, weight double, "
    "noise_frac double, samples_per_sec double, elapsed double, batch_size int, gpu_detected boolean, gpu_name string, gpu_vram_mb int, recommended_samples int, result string, clusters string, matches string, meta string, _corrupt_record string"
)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of NDJSON lines; a line that can't be parsed stays as a log event with its text."""
    parsed = lines.select(F.col(column).alias("line"), F.from_json(column, EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    bad = F.col("e._corrupt_record").isNotNull() | F.col("e.event").isNull()
    names = [c.split()[0] for c in EVENT.split(", ")]
    keep = [F.col(f"e.{c}").alias(c) for c in names if c not in ("event", "message", "ts", "_corrupt_record")]
    return parsed.select(F.when(bad, "log").otherwise(F.col("e.event")).alias("event"), F.when(bad, F.col("line")).otherwise(F.col("e.message")).alias("message"), F.timestamp_seconds("e.ts").alias("ts"), *keep)


def write_lines(events: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    events.write.json(path)


def merged_settings(old: Column, new: Column) -> Column:
    """Two JSON objects as text, merged at the top: the new one's keys win; an unreadable one is empty."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    a, b = as_map(old), as_map(new)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def gpu_from_csv(line: Column) -> Column:
    """name, vram_mb of one "name, memory" line; the number's leading digits count."""
    parts = F.split(line, ",")
    name = F.trim(parts[0])
    return F.struct(F.when(name != "", name).alias("gpu_name"), F.regexp_extract(F.trim(F.get(parts, 1)), r"^(\d+)", 1).try_cast("int").alias("vram_mb"))
