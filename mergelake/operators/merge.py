"""Inbound side: preflight, classification of every change, merge of winners, tombstones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelake.functions.codec import canonical_pk, decode_value, decodes, pk_json
from mergelake.functions.hlc import MAX_DRIFT_SECONDS, OLDEST, drift_seconds, hlc_key, is_complete
from mergelake.operators.schema import COLUMN_HLCS, COLUMN_SIGS, DELETED_ROWS, DELETED_ROWS_SPEC, METADATA, NO_SYNC, ROW_HLC, EngineError, TableSpec, ValidationError, has_metadata, safe_identifier

APPLIED = "applied"
MISSING_TABLE, MISSING_METADATA, INVALID_IDENTITY = "missing_table", "missing_metadata", "invalid_row_identity"
UNKNOWN, RESERVED, NO_SYNC_COLUMN = "unknown_column", "reserved_column", "no_sync_column"
STALE, SUPERSEDED, SHADOWED, POLICY = "stale", "superseded_in_batch", "shadowed_by_delete", "policy"
NOT_NULL, UNIQUE, PRIMARY_KEY = "insert_not_null", "insert_unique", "insert_primary_key"
#: Which counter of the report a reason falls into.
COUNTERS = {
    APPLIED: "applied", STALE: "skipped_stale", SHADOWED: "skipped_shadowed_by_delete", MISSING_TABLE: "skipped_unknown_table",
    MISSING_METADATA: "skipped_unknown_table", INVALID_IDENTITY: "skipped_unknown_table", UNKNOWN: "skipped_unknown_column",
    NO_SYNC_COLUMN: "skipped_no_sync_column", RESERVED: "skipped_reserved_column", POLICY: "skipped_policy", NOT_NULL: "skipped_insert_constraint",
    UNIQUE: "skipped_insert_constraint", PRIMARY_KEY: "skipped_insert_constraint", SUPERSEDED: "skipped_superseded_in_batch",
}


class DriftTooLarge(EngineError):
    """A change's clock is too far ahead: the whole batch is refused."""


class DecodeError(EngineError):
    """A winning value doesn't fit its column."""


def preflight_failures(batch: DataFrame, now: int, limit: float = MAX_DRIFT_SECONDS) -> DataFrame:
    """Changes for which the whole batch is refused: input_index, check (1 table name, 2 column name, 3 clock, 4 drift), hlc_timestamp."""
    check = (
        F.when(~safe_identifier(F.col("table_name")), 1)
        .when(~safe_identifier(F.col("column_name")), 2)
        .when((F.instr("hlc_timestamp", "/") > 0) & ~is_complete("hlc_timestamp"), 3)
        .when(drift_seconds("hlc_timestamp", now) > limit, 4)
    )
    return batch.select("input_index", check.alias("check"), "table_name", "column_name", "hlc_timestamp").filter("check IS NOT NULL")


def preflight(batch: DataFrame, now: int, limit: float = MAX_DRIFT_SECONDS) -> None:
    """Refuse the batch for its first faulty change, before anything is merged."""
    first = preflight_failures(batch, now, limit).agg(F.min_by(F.struct("*"), "input_index").alias("f")).first()["f"]
    if first is None:
        return
    what = {1: f"invalid table name {first['table_name']!r}", 2: f"invalid column name {first['column_name']!r} in {first['table_name']!r}", 3: f"malformed clock {first['hlc_timestamp']!r}", 4: f"clock {first['hlc_timestamp']!r} is too far ahead"}
    raise (DriftTooLarge if first["check"] == 4 else ValidationError)(f"change {first['input_index']}: {what[first['check']]}")


def eligibility(column: Column, spec: TableSpec) -> Column:
    """Why a column of the table can't be written; null where it can. Unknown comes before reserved, reserved before *_no_sync."""
    known = [*spec.names, *METADATA]
    reserved = [*METADATA, *spec.pks]
    return F.when(~column.isin(known), UNKNOWN).when(column.isin(reserved), RESERVED).when(column.endswith(NO_SYNC), NO_SYNC_COLUMN)


def decide_winners(eligible: DataFrame, cell: list[str]) -> DataFrame:
    """Last writer wins within a batch. Needs key, stored_key, hlc_timestamp, input_index; adds status.

    A candidate has a full clock strictly newer than the stored one. The first candidate with the newest clock wins; a
    change in or after the first candidate's place (by clock, then input order) is superseded, one before it stale.
    Winners are pre-aggregated per cell and joined back, so a cell that a third of the batch writes is not one task's.
    """
    eligible = eligible.withColumn("candidate", (F.instr("hlc_timestamp", "/") > 0) & (F.col("key") > F.col("stored_key")))
    best = eligible.filter("candidate").groupBy(*cell).agg(
        F.max(F.struct("key", (-F.col("input_index")).alias("minus"))).alias("winner"), F.min(F.struct("key", "input_index")).alias("first")
    )
    joined = eligible.join(best, cell, "left")
    wins = (F.col("input_index") == -F.col("winner.minus")) & F.col("candidate")
    after = F.struct("key", "input_index") >= F.col("first")
    return joined.withColumn("status", F.when(wins, APPLIED).when(after, SUPERSEDED).otherwise(STALE)).drop("winner", "first", "candidate")


@dataclass
class Outcome:
    """tables: merged state by name (only those touched). classified: input_index, status. target_newer: tombstones that met a newer row."""

    tables: dict[str, DataFrame]
    classified: DataFrame
    target_newer: int = 0
    max_applied: str | None = None
    changed: list[str] = field(default_factory=list)

    def report(self) -> dict[str, int]:
        counts = {r["status"]: r["count"] for r in self.classified.groupBy("status").count().collect()}
        out = dict.fromkeys([*dict.fromkeys(COUNTERS.values()), "skipped_delete_target_newer"], 0)
        for status, n in counts.items():
            out[COUNTERS[status]] += n
        return out | {"skipped_delete_target_newer": self.target_newer}

    def skipped(self) -> DataFrame:
        return self.classified.filter(F.col("status") != APPLIED)


def report_counts(classified: DataFrame) -> DataFrame:
    """The report as one row of counters."""
    counter = F.create_map(*[F.lit(x) for kv in COUNTERS.items() for x in kv])[F.col("status")]
    return classified.agg(*[F.count_if(counter == name).alias(name) for name in dict.fromkeys(COUNTERS.values())])


def tombstone_keys(deleted_rows: DataFrame) -> DataFrame:
    """(table, pk text, newest key) of tombstones with a clock; one row for each target."""
    return deleted_rows.filter(F.col(ROW_HLC).isNotNull() & F.col("row_pks").isNotNull()).groupBy(F.col("table_name").alias("target"), F.col("row_pks").alias("raw_pks")).agg(F.max(hlc_key(ROW_HLC)).alias("deleted_key"))


def of_table(tombstones: DataFrame, spec: TableSpec) -> DataFrame:
    """(pk, deleted_key) of one table's tombstones under the canonical key; spellings that don't name the key exactly are passed over."""
    own = tombstones.filter(F.col("target") == spec.name).select(canonical_pk(F.col("raw_pks"), spec.keys).alias("pk"), "deleted_key")
    return own.filter("pk IS NOT NULL").groupBy("pk").agg(F.max("deleted_key").alias("deleted_key"))


def classify_table(changes: DataFrame, state: DataFrame, spec: TableSpec, shadows: DataFrame | None, rejected: DataFrame | None = None) -> DataFrame:
    """Status of each change of one table, with pk, key, exists. The result is one stage per join: state, winners, shadows."""
    rows = changes.withColumns({"pk": canonical_pk(F.col("row_pks"), spec.keys), "key": hlc_key("hlc_timestamp")})
    stored = state.select(pk_json(spec.keys).alias("pk"), F.col(COLUMN_HLCS).alias("stored_hlcs"), F.lit(True).alias("exists"))
    invalid = rows.filter("pk IS NULL").withColumns({"status": F.lit(INVALID_IDENTITY), "exists": F.lit(False)})
    rows = rows.filter("pk IS NOT NULL").join(stored, "pk", "left").withColumns(
        {"exists": F.coalesce("exists", F.lit(False)), "why": eligibility(F.col("column_name"), spec), "stored_key": F.coalesce(hlc_key(F.col("stored_hlcs")[F.col("column_name")]), F.lit(OLDEST))}
    )
    if rejected is not None:
        rows = rows.join(rejected.select("input_index", F.lit(POLICY).alias("policy")), "input_index", "left").withColumn("why", F.coalesce("why", "policy")).drop("policy")
    kept = [*changes.columns, "pk", "key", "exists", "status"]
    refused = rows.filter("why IS NOT NULL").withColumn("status", F.col("why")).select(*kept)
    decided = decide_winners(rows.filter("why IS NULL"), ["pk", "column_name"]).select(*kept)
    if shadows is not None:
        # A row that isn't there is hidden as a whole if a tombstone is at least as new as its newest winner.
        newest = decided.filter(f"status = '{APPLIED}' AND NOT exists").groupBy("pk").agg(F.max("key").alias("newest"))
        hidden = newest.join(shadows, "pk").filter("deleted_key >= newest").select("pk", F.lit(True).alias("hidden"))
        decided = decided.join(hidden, "pk", "left").withColumn("status", F.when((F.col("status") == APPLIED) & F.col("hidden"), SHADOWED).otherwise(F.col("status"))).drop("hidden")
    return decided.unionByName(refused).unionByName(invalid.select(*kept))


def staged_rows(classified: DataFrame) -> DataFrame:
    """Winners by row: pk, exists, cells (column → value, clock, signature), newest clock. As wide as the table, never wider."""
    cell = F.struct("value", F.col("hlc_timestamp").alias("hlc"), "sig")
    newest = F.max(F.struct("key", F.col("hlc_timestamp").alias("hlc")))
    return classified.filter(F.col("status") == APPLIED).groupBy("pk").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", cell.alias("cell")))).alias("cells"), newest.alias("newest"), F.first("exists").alias("exists"), F.min("key").alias("least_key")
    )


def _pk_values(spec: TableSpec, pk: str) -> list[Column]:
    values = F.from_json(F.col(pk), "map<string,variant>")
    return [decode_value(F.coalesce(F.to_json(values[n]), F.lit("null")), kind).alias(n) for n, kind in spec.keys]


def candidate_rows(staged: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows as they would be inserted: key and winning values, other columns NULL; with pk and least_key."""
    keys = {c.name: v for c, v in zip([c for c in spec.columns if c.name in spec.pks], _pk_values(spec, "pk"))}
    out = [keys[c.name] if c.name in keys else decode_value(F.col("cells")[c.name]["value"], c.dataType).alias(c.name) for c in spec.columns]
    return staged.filter(~F.col("exists")).select("pk", "least_key", *out)


def constraint_failures(staged: DataFrame, state: DataFrame, spec: TableSpec, save: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """(pk, status) of rows to insert that lack a required value or repeat a unique one, stored or inserted before (by clock, then key).

    A row that fails doesn't stand in another's way: rows without a required value and those that meet a stored one go
    first, and only rows that are inserted take their values.
    """
    rows = candidate_rows(staged, spec)
    lacking = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in spec.required], F.lit(False))
    failed = rows.filter(lacking).select("pk", F.lit(NOT_NULL).alias("status"))
    if not spec.unique:
        return failed
    open_rows = rows.filter(~lacking)

    def whole(columns) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])

    def sharing(own: DataFrame, taken: DataFrame) -> DataFrame:
        """Keys of own rows that have a unique value of the taken rows."""
        return reduce(DataFrame.unionByName, [own.filter(whole(u)).join(taken.filter(whole(u)).select(*u).distinct(), list(u), "left_semi").select("pk") for u in spec.unique]).distinct()

    def not_first(own: DataFrame) -> DataFrame:
        """Keys of own rows that an earlier one shares a unique value with."""
        parts = []
        for u in spec.unique:
            first = own.filter(whole(u)).groupBy(*u).agg(F.min(F.struct("least_key", "pk")).alias("first"))
            parts.append(own.filter(whole(u)).join(first, list(u)).filter(F.col("first.pk") != F.col("pk")).select("pk"))
        return reduce(DataFrame.unionByName, parts).distinct()

    stored = sharing(open_rows, state)
    refused = [stored]
    open_rows = open_rows.join(stored, "pk", "left_anti")
    if len(spec.unique) == 1:
        refused.append(not_first(open_rows))
    else:
        # With several unique sets a row's rival may itself be refused. Each round admits the rows that no open row comes
        # before, one at least, and refuses those that share a value with them.
        open_rows = save("open-rows", open_rows)
        while not open_rows.isEmpty():
            admitted = save("admitted-rows", open_rows.join(not_first(open_rows), "pk", "left_anti"))
            rest = open_rows.join(admitted.select("pk"), "pk", "left_anti")
            refused.append(lost := save("refused-rows", sharing(rest, admitted)))
            open_rows = save("open-rows", rest.join(lost, "pk", "left_anti"))
    return failed.unionByName(reduce(DataFrame.unionByName, refused).distinct().select("pk", F.lit(UNIQUE).alias("status")))


def merge_rows(state: DataFrame, staged: DataFrame, spec: TableSpec) -> DataFrame:
    """State with the winners written: values, clocks and signatures by column; the row's clock never goes back.

    A winner's signature replaces the stored one; a winner without removes it.
    """
    old = state.withColumn("__pk", pk_json(spec.keys))
    new = staged.select(F.col("pk").alias("__new"), "cells", "newest", *[v.alias(f"__key_{k}") for k, v in enumerate(_pk_values(spec, "pk"))])
    both = old.join(new, F.col("__pk") == F.col("__new"), "full_outer")
    cells, clocks = F.col("cells"), F.coalesce(F.col(COLUMN_HLCS), F.expr("cast(map() as map<string,string>)"))
    out, place = [], {n: k for k, (n, _) in enumerate(spec.keys)}
    for c in spec.columns:
        if c.name in place:
            out.append(F.when(F.col("__pk").isNotNull(), F.col(f"`{c.name}`")).otherwise(F.col(f"__key_{place[c.name]}")).alias(c.name))
        elif c.name in spec.tracked:
            out.append(F.when(cells[c.name].isNotNull(), decode_value(cells[c.name]["value"], c.dataType)).otherwise(F.col(f"`{c.name}`")).alias(c.name))
        else:
            out.append(F.col(f"`{c.name}`"))
    stored_key = F.coalesce(hlc_key(ROW_HLC), F.lit(OLDEST))
    row_hlc = F.when(cells.isNull(), F.col(ROW_HLC)).when(F.col(ROW_HLC).isNotNull() & (stored_key >= F.col("newest.key")), F.col(ROW_HLC)).otherwise(F.col("newest.hlc"))
    merged = F.map_zip_with(clocks, cells, lambda _, was, cell: F.coalesce(cell["hlc"], was))
    sigs = F.coalesce(F.col(COLUMN_SIGS), F.expr("cast(map() as map<string,string>)"))
    signed = F.map_filter(F.map_zip_with(sigs, cells, lambda _, was, cell: F.when(cell.isNotNull(), cell["sig"]).otherwise(was)), lambda _, v: v.isNotNull())
    return both.select(*out, row_hlc.alias(ROW_HLC), F.when(cells.isNull(), F.col(COLUMN_HLCS)).otherwise(merged).alias(COLUMN_HLCS), F.when(cells.isNull(), F.col(COLUMN_SIGS)).otherwise(signed).alias(COLUMN_SIGS))


def propagate_deletes(state: DataFrame, spec: TableSpec, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that survive, tombstoned rows that are strictly newer). tombstones: pk, deleted_key."""
    rows = state.withColumns({"pk": pk_json(spec.keys), "row_key": F.coalesce(hlc_key(ROW_HLC), F.lit(OLDEST))})
    joined = rows.join(tombstones, "pk", "left")
    return joined.filter("deleted_key IS NULL OR row_key > deleted_key").select(*state.columns), joined.filter("row_key > deleted_key").select("pk")


def apply_batch(
    tables: dict[str, DataFrame],
    specs: dict[str, TableSpec],
    batch: DataFrame,
    now: int,
    decide: Callable[[DataFrame], DataFrame | None] = lambda batch: None,
    save: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
    on_constraint: str = "abort",
) -> Outcome:
    """Merge a batch (change records with input_index) into the tables, deleted_rows among them.

    decide: the policy's rejections (input_index) of eligible changes. save: stores a table and returns it reread; with
    the default, plans are carried on. on_constraint: abort for a row that can't be inserted, or skip it.
    Keys are canonicalised before rows are grouped, so spellings of one key are one row. Tombstones of this batch act
    after all rows, on every target; those merely superseded or stale act again, those refused don't.
    """
    preflight(batch, now)
    specs = specs | {DELETED_ROWS: specs.get(DELETED_ROWS, DELETED_ROWS_SPEC)}
    rejected = decide(batch)
    shadows = save("shadows", tombstone_keys(tables[DELETED_ROWS])) if DELETED_ROWS in tables else None
    named = [r[0] for r in batch.select("table_name").distinct().collect() if r[0] in tables and r[0] in specs]
    merged, parts = {}, []
    usable = [n for n in named if specs[n].synced and has_metadata(tables[n])]
    unknown = batch.filter(~F.col("table_name").isin(named) if named else F.lit(True)).select("input_index", F.lit(MISSING_TABLE).alias("status"), F.lit(None).cast("string").alias("hlc_timestamp"))
    parts.append(unknown)
    if bare := [n for n in named if n not in usable]:
        parts.append(batch.filter(F.col("table_name").isin(bare)).select("input_index", F.lit(MISSING_METADATA).alias("status"), F.lit(None).cast("string").alias("hlc_timestamp")))
    for name in usable:
        spec, state = specs[name], tables[name]
        own = classify_table(batch.filter(F.col("table_name") == name), state, spec, None if shadows is None else of_table(shadows, spec), rejected)
        own = save(f"classified-{name}", own)
        staged = staged_rows(own)
        if spec.required or spec.unique:
            failed = save(f"constraints-{name}", constraint_failures(staged, state, spec, save))
            if on_constraint == "abort" and not failed.isEmpty():
                raise EngineError(f"rows can't be inserted into {name!r}")
            own = own.join(failed.withColumnRenamed("status", "failed"), "pk", "left").withColumn("status", F.when(F.col("status") == APPLIED, F.coalesce("failed", "status")).otherwise(F.col("status"))).drop("failed")
            staged = staged_rows(own)
        bad = [F.count_if((F.col("column_name") == c) & (F.col("status") == APPLIED) & ~decodes(F.col("value"), spec.kind(c))).alias(c) for c in spec.tracked]
        if bad and (wrong := {k: v for k, v in own.agg(*bad).first().asDict().items() if v}):
            raise DecodeError(f"values of {name!r} don't fit their columns: {wrong}")
        merged[name] = save(name, merge_rows(state, staged, spec))
        parts.append(own.select("input_index", "status", "hlc_timestamp"))
        if name == DELETED_ROWS:
            inbound = own.filter(F.col("status").isin(APPLIED, STALE, SUPERSEDED)).select("pk").distinct()
    classified = save("classified", reduce(DataFrame.unionByName, parts))
    newer = 0
    if DELETED_ROWS in merged:
        log = merged[DELETED_ROWS]
        acting = save("acting-tombstones", tombstone_keys(log.withColumn("pk", pk_json(specs[DELETED_ROWS].keys)).join(inbound, "pk", "left_semi")))
        for (name,) in acting.select("target").distinct().collect():
            if name not in tables or name not in specs or name == DELETED_ROWS or not specs[name].synced or not has_metadata(tables[name]):
                continue
            survivors, kept = propagate_deletes(merged.get(name, tables[name]), specs[name], of_table(acting, specs[name]))
            newer += kept.count()
            merged[name] = save(f"{name}-survivors", survivors)
    top = classified.filter(F.col("status") == APPLIED).agg(F.max(F.struct(hlc_key("hlc_timestamp").alias("key"), "hlc_timestamp")).alias("m")).first()["m"]
    return Outcome(merged, classified.select("input_index", "status"), newer, top["hlc_timestamp"] if top else None, sorted(merged))


