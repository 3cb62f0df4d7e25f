"""Streams of pipeline events: parsing, stage states, progress rates, per-window counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.progress import STATES
from ..sources.events import parse_lines


def read_events(spark, path: str) -> DataFrame:  # noqa: ANN001
    """A stream of parsed events from text files of NDJSON lines."""
    return parse_lines(spark.readStream.text(path))


def _eta(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    base = state.get if state.exists else None
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for r in rows.itertuples(index=False):
        now = r.ts.timestamp()
        if base is None or r.completed < base[1]:
            base = (now, int(r.completed))
        done, elapsed = r.completed - base[1], now - base[0]
        rate = done / elapsed if done > 0 and elapsed > 0 else (None if done > 0 else 0.0)
        out.append((*key, r.seq, r.completed, r.total, rate))
    state.update(base)
    if state.getCurrentWatermarkMs() > 0:
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 3_600_000)
    yield pd.DataFrame(out, columns=["run_id", "stage", "phase", "seq", "completed", "total", "rate"])


def stream_eta(progress: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Rates of a stream of progress events; state is a baseline a run, stage and phase, dropped an hour after its last event."""
    rows = progress.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    schema = "run_id long, stage string, phase string, seq long, completed long, total long, rate double"
    return rows.groupBy("run_id", "stage", "phase").applyInPandasWithState(_eta, schema, "start double, completed long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_states(events: DataFrame) -> DataFrame:
    """The last state of each stage, as an update or complete stream."""
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("event")]
    return events.where("stage is not null").groupBy("run_id", "stage").agg(F.max_by(state, "seq").alias("state"))


def stream_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows; late rows within the watermark count."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", window), "event").agg(F.count("*").alias("n"))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append", **options: Any) -> DataFrame:
    """Runs a stream over what is there into a memory table and returns that."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
