"""Event analytics in batch: stage states, progress rates, carried context, durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display

#: The state that each kind of event puts its stage in.
STATES = {"stage_start": "active", "progress": "active", "stage_done": "done", "stage_failed": "failed", "error": "failed", "stage_skipped": "skipped"}
FINAL = ("done", "failed", "skipped")
#: The steps that a run shows before anything has happened, per refined candidate for the last three.
PLAN = ("model_load", "plonk_sampling", "sun_refine")
PLAN_EACH = ("mapillary", "google_sv", "panoramax")


def stage_states(events: DataFrame) -> DataFrame:
    """run_id, stage, state: the last event wins. Events (run_id, seq, event, stage)."""
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("event")]
    return events.where("stage is not null").groupBy("run_id", "stage").agg(F.max_by(state, "seq").alias("state"))


def overall(events: DataFrame, top: int = 1) -> DataFrame:
    """run_id, done, total, percent, text of events (run_id, event, stage).

    The total counts the planned steps and every other stage that an event names; a stage that was once done, failed or
    skipped stays counted as such, whatever follows. Stages of zoom runs don't count.
    """
    state = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("event")]
    plan = [*PLAN, *[f"c{i}_{s}" for i in range(top) for s in PLAN_EACH]]
    counts = F.col("stage").isNotNull() & ~F.col("stage").startswith("zoom_") & state.isNotNull()
    stages = events.select("run_id", F.when(counts, F.col("stage")).alias("stage"), state.isin(*FINAL).alias("final")).groupBy("run_id", "stage").agg(F.max("final").alias("final"))
    sums = stages.groupBy("run_id").agg(F.count_if(F.col("stage").isNotNull() & F.col("final")).alias("done"), (F.count_if(F.col("stage").isNotNull() & ~F.col("stage").isin(*plan)) + len(plan)).alias("total"))
    text = F.when(F.col("done") >= F.col("total"), "Complete").otherwise(F.format_string("Running · %d/%d", "done", "total"))
    return sums.withColumn("percent", display.half_up(F.col("done") / F.greatest("total", F.lit(1)) * 100).cast("int")).withColumn("text", text)


def seeded(states: DataFrame, candidates: DataFrame, top: int = 1) -> DataFrame:
    """The planned steps of each run with their states: pending before any event, skipped where no candidate is left.

    candidates: run_id, n.
    """
    steps = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(-1).alias("need")) for s in PLAN], *[F.struct(F.lit(f"c{i}_{s}").alias("stage"), F.lit(i).alias("need")) for i in range(top) for s in PLAN_EACH])
    plan = candidates.select("run_id", "n", F.explode(steps).alias("s")).select("run_id", "n", "s.stage", "s.need")
    state = F.when(F.col("need") >= F.col("n"), "skipped").otherwise(F.coalesce("state", F.lit("pending")))
    return plan.join(states, ["run_id", "stage"], "left").select("run_id", "stage", state.alias("state"))


def progress_eta(progress: DataFrame) -> DataFrame:
    """Each progress event with its rate and remaining time.

    The baseline is a stage and phase's first event, and starts anew where the counter falls under it: those events are
    exactly the strict running minima, so one window pass finds them.
    """
    key = Window.partitionBy("run_id", "stage", "phase").orderBy("seq")
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    seconds = F.col("ts").cast("timestamp").cast("double")
    rows = progress.withColumn("_low", F.min("completed").over(before)).withColumn("_t", seconds)
    reset = F.col("_low").isNull() | (F.col("completed") < F.col("_low"))
    rows = rows.withColumn("_base", F.last(F.when(reset, F.struct("_t", "completed")), ignorenulls=True).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    done, elapsed = F.col("completed") - F.col("_base.completed"), F.col("_t") - F.col("_base._t")
    rate = F.when(done > 0, F.try_divide(done.cast("double"), elapsed)).otherwise(0.0)
    rows = rows.withColumn("rate", rate)
    eta = F.when(F.col("rate") > 0, (F.col("total") - F.col("completed")) / F.col("rate"))
    return rows.withColumn("eta", display.eta_text(eta)).drop("_low", "_t", "_base")


def cluster_context(events: DataFrame) -> DataFrame:
    """Each event with the candidate that the last c<i>_ stage named; 0 before any."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("cluster", F.coalesce(F.last(display.stage_cluster(F.col("stage")), ignorenulls=True).over(w), F.lit(0)))


def durations(events: DataFrame) -> DataFrame:
    seconds = F.col("ts").cast("timestamp").cast("double")
    return events.groupBy("run_id", "stage").agg((F.max(seconds) - F.min(seconds)).alias("seconds"))
