"""Run states, publication, recovery and the lists built on them.

Everything is derived from one append-only log of run events. The event that marks a
run succeeded also carries its ``publish_seq``, so a run can not be one without the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyline.functions.times import completion
from tallyline.operators.landing import align_schema
from tallyline.schemas import PUBLICATIONS, RUN_EVENTS


def run_state(run_events: DataFrame) -> DataFrame:
    """One row per run: its newest state, with start and completion times."""
    newest = F.max_by(
        F.struct(
            "status", "at", "error_message", "recovered_at", "recovery_reason", "recovered_artifact_path"
        ),
        "event_seq",
    )
    per_run = run_events.groupBy("run_id").agg(
        F.min("event_seq").alias("run_seq"),
        F.min_by("source_file_id", "event_seq").alias("source_file_id"),
        F.min_by("input_path", "event_seq").alias("input_path"),
        F.min_by("at", "event_seq").alias("started_at"),
        newest.alias("last"),
    )
    done = F.when(F.col("last.status") != "running", completion(F.col("last.at"), F.col("started_at")))
    return per_run.select(
        "run_id",
        "run_seq",
        "source_file_id",
        "input_path",
        F.col("last.status").alias("status"),
        "started_at",
        done.alias("completed_at"),
        "last.error_message",
        "last.recovered_at",
        "last.recovery_reason",
        "last.recovered_artifact_path",
    )


def publications(run_events: DataFrame) -> DataFrame:
    """Publication log: the events that carry a publish sequence."""
    published = run_events.filter("publish_seq IS NOT NULL").withColumn("published_at", F.col("at"))
    return align_schema(published, PUBLICATIONS)


def _published(pubs: DataFrame, runs: DataFrame) -> DataFrame:
    """Publications of succeeded runs."""
    succeeded = runs.filter("status = 'succeeded'").select("run_id", "completed_at")
    return pubs.join(succeeded, "run_id")


def current_publication(pubs: DataFrame, runs: DataFrame) -> DataFrame:
    """The newest publication of a succeeded run. No row: nothing published yet.

    Two rows mean that two publications claim the same sequence, which callers refuse.
    """
    found = _published(pubs, runs)
    newest = found.agg(F.max("publish_seq")).scalar()
    return found.filter(F.col("publish_seq") == newest).select("run_id", "publish_seq", "published_at")


def current_result(results: DataFrame, pubs: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the current result."""
    return results.join(current_publication(pubs, runs).select("run_id"), "run_id", "left_semi")


def result_by_id(results: DataFrame, pubs: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """Rows of one published result, with a flag for the current one."""
    found = _published(pubs, runs)
    newest = found.agg(F.max("publish_seq")).scalar()
    wanted = found.filter(F.col("run_id") == run_id).select(
        "run_id", (F.col("publish_seq") == newest).alias("is_current")
    )
    return results.filter(F.col("run_id") == run_id).join(wanted, "run_id")


def published_list(pubs: DataFrame, runs: DataFrame, scopes: DataFrame, n: int = 20) -> DataFrame:
    """Summaries of published results, newest first."""
    newest = _published(pubs, runs).orderBy(F.desc("publish_seq"), "run_id").limit(n)
    # The list is newest first, so its highest sequence is the current one.
    top = newest.agg(F.max("publish_seq")).scalar()
    return (
        newest.withColumn("is_current", F.col("publish_seq") == top)
        .join(scopes, "run_id", "left")
        .select(
            "run_id",
            "publish_seq",
            "completed_at",
            "is_current",
            "source_file_id",
            "sheet_name",
            "input_scope_id",
            "aggregation_rule_id",
            "transformation_rule_id",
        )
        .orderBy(F.desc("publish_seq"), "run_id", "sheet_name")
    )


def run_history(runs: DataFrame, scopes: DataFrame, n: int = 20) -> DataFrame:
    """All runs, failed and recovered ones too, newest first; a run may have no scope."""
    newest = runs.orderBy(F.desc("run_seq"), "run_id").limit(n)
    return newest.join(scopes.select("run_id", "sheet_name", "input_scope_id"), "run_id", "left").orderBy(
        F.desc("run_seq"), "run_id", "sheet_name"
    )


def default_pair(published: DataFrame) -> DataFrame:
    """Comparison proposed first: the current (else newest) result against the newest other one."""
    rank = F.struct("is_current", "publish_seq")
    top_two = published.orderBy(F.desc("is_current"), F.desc("publish_seq")).limit(2)
    return top_two.agg(
        F.min_by("run_id", rank).alias("base_run_id"), F.max_by("run_id", rank).alias("current_run_id")
    ).filter("current_run_id IS NOT NULL")


def recovery_candidates(runs: DataFrame, pubs: DataFrame, dead: DataFrame) -> DataFrame:
    """Unfinished runs that the caller knows to be dead, with their publication evidence.

    Elapsed time proves nothing, so the caller names the dead runs. A run that has
    published evidence and still reads as running needs a person.
    """
    running = runs.filter("status = 'running'").join(dead.select("run_id"), "run_id", "left_semi")
    evidence = pubs.groupBy("run_id").agg(F.count("publish_seq").alias("published_count"))
    count = F.coalesce("published_count", F.lit(0))
    return running.join(evidence, "run_id", "left").select(
        "run_id",
        "started_at",
        count.cast("bigint").alias("published_count"),
        F.when(count > 0, "manual_review").otherwise("recover").alias("verdict"),
    )


def recover_runs(
    runs: DataFrame,
    pubs: DataFrame,
    dead: DataFrame,
    recovered_at: Column,
    reason: str,
    artifacts: DataFrame | None = None,
    status: str = "failed",
) -> DataFrame:
    """Run events that close the recoverable dead runs as ``failed`` or ``interrupted``.

    ``artifacts`` (run_id, artifact_path) links a result that was written but never
    published to the run it belongs to.
    """
    closed = recovery_candidates(runs, pubs, dead).filter("verdict = 'recover'")
    if artifacts is not None:
        kept = artifacts.select("run_id", F.col("artifact_path").alias("recovered_artifact_path"))
        closed = closed.join(kept, "run_id", "left")
    events = closed.select(
        "*",
        F.lit(status).alias("status"),
        completion(recovered_at, F.col("started_at")).alias("at"),
        F.lit(reason).alias("error_message"),
        F.lit(reason).alias("recovery_reason"),
        recovered_at.alias("recovered_at"),
    )
    return align_schema(events, RUN_EVENTS)


def orphan_results(results: DataFrame, pubs: DataFrame) -> DataFrame:
    """Results that were written but never published, one row per run."""
    written = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("result_rows"))
    return written.join(pubs.select("run_id"), "run_id", "left_anti")


def run_label(runs: DataFrame) -> DataFrame:
    """Readable state of a run; a recovered run says so instead of plain failed."""
    return runs.withColumn(
        "run_label",
        F.when(F.col("recovered_at").isNotNull(), "recovered").otherwise(F.col("status")),
    )


def run_summary(day: DataFrame, runs: DataFrame) -> DataFrame:
    """Run id, state, file and the product sums of each run."""
    return runs.select("run_id", "status", "completed_at").join(day, "run_id")


def data_state(requests: DataFrame, pubs: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """What a reader of each requested run is told; absent data is never shown as zero."""
    published = _published(pubs, runs).select("run_id", F.lit(True).alias("_published"))
    readable = results.select("run_id").distinct().withColumn("_readable", F.lit(True))
    state = (
        F.when(F.col("run_id").isNull() | (F.trim("run_id") == ""), "invalid_request")
        .when(F.col("_published").isNull(), "not_found")
        .when(F.col("_readable").isNull(), "read_error")
        .otherwise("available")
    )
    return (
        requests.select("run_id")
        .join(published.distinct(), "run_id", "left")
        .join(readable, "run_id", "left")
        .select("run_id", state.alias("data_state"))
    )
