"""Compare two published runs of a batch ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyline.operators import compare as cmp
from tallyline.operators.scope import row_diff
from tallyline.plans.batch_run import Store, published_days


@dataclass(frozen=True)
class Comparison:
    """One-row basis, many-row groups, and the rows that make the difference."""

    basis: DataFrame
    groups: DataFrame
    locations: DataFrame
    selected_rows: DataFrame


def compare_published(store: Store, base_run: str, current_run: str) -> Comparison:
    """Value by value and row by row; both runs must be published."""
    base, current = published_days(store, base_run), published_days(store, current_run)

    def of(table: DataFrame, run_id: str) -> DataFrame:
        return table.filter(F.col("run_id") == run_id)

    long = store.contributions()
    diff = cmp.location_diff(of(long, base_run), of(long, current_run))
    return Comparison(
        basis=cmp.compare_basis(of(store.scopes, base_run), of(store.scopes, current_run)),
        groups=cmp.compare_groups(base, current, diff),
        locations=diff,
        selected_rows=row_diff(store.members, base_run, current_run),
    )
