"""One batch run: gates, landing, result, publication.

Everything is checked before anything is written. The last write is one appended log
row that makes the run succeeded and published at once; a run that stops anywhere
before it leaves the last good result in place.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.errors import ContractViolation, ResultNotFound, ResultReadError
from tallyline.functions.identity import rule_id
from tallyline.operators import contracts as chk
from tallyline.operators import landing as land
from tallyline.operators import product_day as pday
from tallyline.operators import publish as pub
from tallyline.operators.result import result_header, result_products
from tallyline.operators.scope import scope_ids
from tallyline.operators.typed import TRANSFORMATION_RULE, typed_lines
from tallyline.schemas import MEMBERS, PRODUCT_DAY, RAW_ROWS, RUN_EVENTS, SCOPES, SOURCE_FILES
from tallyline.sources.documents import commit_document
from tallyline.sources.storage import append, append_rows, claim_next, read_or_empty, replace_partitions


@dataclass(frozen=True)
class Store:
    """Tables of a batch ledger under one root folder."""

    spark: SparkSession
    root: str

    def table(self, name: str, schema) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/{name}", schema)

    @property
    def run_events(self) -> DataFrame:
        return self.table("run_events", RUN_EVENTS)

    @property
    def files(self) -> DataFrame:
        return self.table("source_files", SOURCE_FILES)

    @property
    def members(self) -> DataFrame:
        return self.table("members", MEMBERS)

    @property
    def scopes(self) -> DataFrame:
        return self.table("scopes", SCOPES)

    @property
    def landed(self) -> DataFrame:
        """Landed rows, with kinds that later loads recorded for older landings."""
        rows = self.table("raw_rows", RAW_ROWS)
        return land.backfill_kind(rows, self.table("kind_backfill", RAW_ROWS))

    def landed_of(self, members: DataFrame) -> DataFrame:
        """Landed rows of the files that ``members`` name; other files' partitions are pruned when it runs."""
        return self.landed.join(members.select("source_file_id").distinct(), "source_file_id", "left_semi").select(
            *RAW_ROWS.fieldNames()
        )

    @property
    def days(self) -> DataFrame:
        return self.table("product_days", PRODUCT_DAY)

    def contributions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/contributions")

    def log(self, run_id: str, status: str, at: dt.datetime, **more) -> None:
        """Append one run event behind the newest one; its numbers are claimed, so writers at the same time get different ones."""
        newest = self.run_events.agg(F.max("event_seq"), F.max("publish_seq")).first()
        row = {name: None for name in RUN_EVENTS.fieldNames()}
        row.update(run_id=run_id, event_seq=claim_next(self.spark, f"{self.root}/claims/events", newest[0] or 0), status=status, at=at, **more)
        if status == "succeeded":
            row["publish_seq"] = claim_next(self.spark, f"{self.root}/claims/publications", newest[1] or 0)
        append_rows(self.spark, [tuple(row.values())], RUN_EVENTS, f"{self.root}/run_events")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def run_batch(
    store: Store,
    run_id: str,
    rows: DataFrame,
    selection: DataFrame,
    *,
    input_path: str,
    files: DataFrame | None = None,
    manifests: DataFrame | None = None,
    sheet_rows: DataFrame | None = None,
) -> str:
    """Compute and publish the selected rows of ``rows``; returns the run id.

    ``rows`` are raw rows with locations, ``selection`` the chosen locations. ``files`` and
    ``manifests``, which go together, add the fingerprint gate, ``sheet_rows`` the header gate. A known run id is refused. Every row
    that stops a run is kept under ``violations`` in the store.
    """
    if (files is None) != (manifests is None):
        raise ContractViolation("files and manifests are checked against each other: give both or neither")
    one_file = selection.select("source_file_id").limit(1).first()
    if not store.run_events.filter(F.col("run_id") == run_id).isEmpty():
        raise ContractViolation(f"run id {run_id} is taken; a retry needs one of its own")
    started = _now()
    store.log(run_id, "running", started, source_file_id=one_file and one_file[0], input_path=input_path)
    try:
        _compute(store, run_id, rows, selection, files, manifests, sheet_rows)
    except Exception as exc:
        message = str(exc) if isinstance(exc, ContractViolation) else f"{type(exc).__name__}: {exc}"
        store.log(run_id, "failed", max(_now(), started), error_message=message)
        raise
    store.log(run_id, "succeeded", max(_now(), started))
    return run_id


def _compute(store, run_id, rows, selection, files, manifests, sheet_rows) -> None:
    root = store.root

    def gate(name: str, violations: DataFrame, message: str) -> None:
        chk.require_empty(violations, message, f"{root}/violations/run_id={run_id}/gate={name}")

    if files is not None:
        gate("fingerprint", chk.fingerprint_violations(files, manifests), "file fingerprint mismatch")
    members = land.select_rows(selection, None, run_id)
    if members.isEmpty():
        raise ContractViolation("nothing is selected")
    gate("selection", chk.selection_violations(members), "selected rows are invalid")
    if sheet_rows is not None:
        gate("workbook", sheet_rows.filter("error IS NOT NULL").select("source_path", "error"), "workbook not readable")
        gate("header", chk.header_violations(sheet_rows), "unexpected header")

    # A scope is recorded even when the rows then fail a later gate.
    scopes = (
        scope_ids(members)
        .withColumn("aggregation_rule_id", rule_id(pday.AGGREGATION_RULE))
        .withColumn("transformation_rule_id", rule_id(TRANSFORMATION_RULE))
    )
    append(land.align_schema(scopes, SCOPES), f"{root}/scopes")

    wanted = land.restrict_rows(rows, members)
    gate("missing", land.missing_rows(wanted, members), "selected rows were not found")
    gate("typed", chk.typed_violations(typed_lines(wanted), members), "rows can not be published")
    # What has landed stays; a row that reads differently now is another source under the same name.
    landed = store.landed_of(members)
    gate("changed", land.changed_rows(landed, land.align_schema(wanted, RAW_ROWS)), "landed rows read differently now")
    if files is not None:
        append(land.align_schema(land.register_files(store.files, land.align_schema(files, SOURCE_FILES)), SOURCE_FILES),
               f"{root}/source_files")
    append(land.land_rows(landed, land.align_schema(wanted, RAW_ROWS)), f"{root}/raw_rows", "source_file_id")
    unrecorded = landed.filter("invoice_no_source_kind IS NULL")
    append(land.restrict_rows(land.align_schema(wanted, RAW_ROWS), unrecorded), f"{root}/kind_backfill", "source_file_id")
    replace_partitions(members, f"{root}/members", "run_id")

    # From here on the run reads what was landed: its own members against the landed rows of their files.
    own = store.members.filter(F.col("run_id") == run_id)
    expected = selection.groupBy(F.lit(run_id).alias("run_id")).agg(F.count(F.lit(1)).alias("expected_count"))
    gate("count", chk.count_mismatch(own, expected), "membership does not hold the selected rows")
    typed = typed_lines(store.landed_of(own))
    gate("landed", chk.typed_violations(typed, own), "landed rows can not be published")
    replace_partitions(pday.contributions(typed, own), f"{root}/contributions", "run_id")
    long = store.contributions().filter(F.col("run_id") == run_id)
    replace_partitions(land.align_schema(pday.days_of(long), PRODUCT_DAY), f"{root}/product_days", "run_id")


def current_days(store: Store) -> DataFrame:
    """Product days of the current result; refuses when there is none or more than one."""
    runs, log = pub.run_state(store.run_events), pub.publications(store.run_events)
    found = pub.current_publication(log, runs).limit(2).collect()
    if not found:
        raise ResultNotFound("nothing is published yet")
    if len(found) > 1:
        raise ResultReadError("two publications claim to be the newest")
    return store.days.filter(F.col("run_id") == found[0]["run_id"])


def published_days(store: Store, run_id: str) -> DataFrame:
    """Product days of one published run, flagged when it is the current one."""
    runs, log = pub.run_state(store.run_events), pub.publications(store.run_events)
    found = pub.result_by_id(store.days, log, runs, run_id)
    if found.isEmpty():
        raise ResultNotFound(f"run {run_id} has no published result")
    return found


def export_result(store: Store, run_id: str, manifests: DataFrame, path: str) -> None:
    """Write a published run as JSON: header lines, and product lines with their pages, visible together or not at all.

    ``read_document`` reads the newest version.
    """
    day = published_days(store, run_id).drop("is_current")
    long = store.contributions().filter(F.col("run_id") == run_id)
    members = store.members.filter(F.col("run_id") == run_id)
    header = result_header(
        store.scopes.filter(F.col("run_id") == run_id), pub.run_state(store.run_events), manifests, scope_ids(members)
    )
    products = result_products(day, pday.nested_contributions(long))
    commit_document(path, run_id, {"products": products, "header": header})


def recover(store: Store, dead: DataFrame) -> list[str]:
    """Close dead unfinished runs as failed; refuse when one has published evidence."""
    runs, log = pub.run_state(store.run_events), pub.publications(store.run_events)
    evidence = pub.recovery_candidates(runs, log, dead).filter("verdict = 'manual_review'")
    chk.require_empty(evidence.select("run_id"), "runs that never ended but were published: a person has to look")
    reason = "closed from outside: its writer is gone"
    artifacts = store.days.select("run_id").distinct().withColumn(
        "artifact_path", F.concat(F.lit(f"{store.root}/product_days/run_id="), "run_id")
    )
    # One append behind the newest event. The dead runs are the caller's list, so their number is no corpus's.
    seq = store.run_events.agg(F.coalesce(F.max("event_seq"), F.lit(0))).first()[0]
    closed = pub.recover_runs(runs, log, dead, F.lit(_now()), reason, artifacts)
    rows = []
    for row in land.align_schema(closed, RUN_EVENTS).orderBy("run_id").collect():
        seq = claim_next(store.spark, f"{store.root}/claims/events", seq)
        rows.append(tuple((row.asDict() | {"event_seq": seq})[name] for name in RUN_EVENTS.fieldNames()))
    if rows:
        append_rows(store.spark, rows, RUN_EVENTS, f"{store.root}/run_events")
    return [row[RUN_EVENTS.fieldNames().index("run_id")] for row in rows]
