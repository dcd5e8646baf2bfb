"""Pruning the delete log, and statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelake.functions.hlc import NANOSECONDS_PER_DAY, hlc_key, retention_cutoff, sqlite_time
from mergelake.operators.schema import DELETED_ROWS, ROW_HLC


@dataclass(frozen=True)
class Retention:
    """days: entries older than that go; None: all with a clock go. Entries without a clock always stay."""

    days: int | None = None
    units_per_day: int = NANOSECONDS_PER_DAY


def split_prunable(log: DataFrame, policy: Retention, now: int | None) -> tuple[DataFrame, DataFrame]:
    """(pruned, kept). `now` is the time part of the current clock; without one a policy of days prunes nothing."""
    old = F.col(ROW_HLC).isNotNull()
    if policy.days is not None:
        cutoff = retention_cutoff(now, policy.days, policy.units_per_day)
        old = old & (sqlite_time(ROW_HLC) < F.lit(cutoff).cast("decimal(38,0)")) if cutoff is not None else F.lit(False)
    return log.filter(old), log.filter(~old)


def prune_summary(pruned: DataFrame) -> DataFrame:
    """rows_deleted, max_pruned_hlc: newest by time; of equal times the newest by node."""
    newest = F.max(F.struct(sqlite_time(ROW_HLC).alias("time"), hlc_key(ROW_HLC).alias("key"), F.col(ROW_HLC).alias("hlc")))
    return pruned.agg(F.count("*").alias("rows_deleted"), newest["hlc"].alias("max_pruned_hlc"))


def counts_for_stats(name: str) -> bool:
    """Whether statistics include a table: no name of eight characters or more that ends in `no_sync` after any one character, nor one reserved, nor the delete log."""
    return name != DELETED_ROWS and not re.search(r"(?is)^.*.no.sync$", name) and not re.search(r"(?is)^sqlite.", name)


def stats(tables: dict[str, DataFrame]) -> dict[str, int]:
    """live_row_count and crdt_table_count over replicating tables, delete_log_row_count. One count per table, each on row groups' metadata."""
    live = {n: df for n, df in tables.items() if counts_for_stats(n) and ROW_HLC in df.columns}
    return {"live_row_count": sum(df.count() for df in live.values()), "crdt_table_count": len(live), "delete_log_row_count": tables[DELETED_ROWS].count() if DELETED_ROWS in tables else 0}
