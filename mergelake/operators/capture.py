"""Local writes: what changed between two snapshots, stamped with the commit's one clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelake.functions.codec import parameter_bytes, pk_json
from mergelake.operators.schema import COLUMN_HLCS, COLUMN_SIGS, DELETED_ROWS, METADATA, ROW_HLC, EngineError, TableSpec, ValidationError, ensure_metadata

#: Limits of one transaction's values and of one value, in bytes.
MAX_TRANSACTION_BYTES, MAX_VALUE_BYTES = 104_857_600, 1_000_000_000


class LimitExceeded(EngineError):
    """A transaction or value is too large."""


def _map(entries: list[tuple[str, Column]]) -> Column:
    return F.create_map(*[x for name, v in entries for x in (F.lit(name), v)]) if entries else F.expr("cast(map() as map<string,string>)")


def names_where(flags: dict[str, Column]) -> Column:
    """Names whose flag is true, as an array."""
    if not flags:
        return F.array().cast("array<string>")
    return F.array_except(F.array(*[F.when(x, F.lit(c)) for c, x in flags.items()]), F.array(F.lit(None).cast("string")))


def restamped(clocks: Column, names: Column, hlc: str | None) -> Column:
    """The map of clocks with the named columns at `hlc`."""
    kept = F.map_filter(F.coalesce(clocks, _empty_map()), lambda k, _: ~F.array_contains(names, k))
    return F.map_concat(kept, F.map_from_arrays(names, F.array_repeat(F.lit(hlc), F.size(names))))


def _empty_map() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def check_written(rows: DataFrame, spec: TableSpec) -> None:
    """A write names known columns and no metadata."""
    if bad := [c for c in rows.columns if c in METADATA]:
        raise ValidationError(f"metadata columns can't be written: {bad}")
    if bad := [c for c in rows.columns if c not in spec.names]:
        raise ValidationError(f"unknown columns of {spec.name!r}: {bad}")


def charge(rows: DataFrame, spec: TableSpec, limit: int = MAX_TRANSACTION_BYTES, value_limit: int = MAX_VALUE_BYTES) -> int:
    """Bytes of the values written; refuses a transaction or a value beyond the limits. One pass, pre-aggregated."""
    sizes = [parameter_bytes(f"`{c}`", spec.kind(c)) for c in rows.columns]
    total, most = rows.agg(F.sum(reduce(lambda a, b: a + b, sizes)), F.max(F.greatest(*sizes, F.lit(0)))).first()
    if (total or 0) > limit or (most or 0) > value_limit:
        raise LimitExceeded(f"{total} bytes written to {spec.name!r}, the largest value {most}; the limits are {limit} and {value_limit}")
    return total or 0


def stamp_inserts(rows: DataFrame, spec: TableSpec, hlc: str | None) -> DataFrame:
    """New rows in declared order; columns not given are NULL. The row's clock, and every tracked column's, is the commit's."""
    out = [F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) if c.name in rows.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in spec.columns]
    if not spec.synced:
        return rows.select(*out)
    clocks = _map([(c, F.lit(hlc)) for c in spec.tracked]) if hlc is not None else _empty_map()
    return rows.select(*out, F.lit(hlc).cast("string").alias(ROW_HLC), clocks.alias(COLUMN_HLCS), _empty_map().alias(COLUMN_SIGS))


def changed_columns(spec: TableSpec, old: str = "o.", new: str = "n.") -> dict[str, Column]:
    """For each tracked column whether it changed, NULL equal to NULL."""
    return {c: ~F.col(f"{old}`{c}`").eqNullSafe(F.col(f"{new}`{c}`")) for c in spec.tracked}


def diff(old: DataFrame, new: DataFrame, spec: TableSpec) -> DataFrame:
    """Outer join of two snapshots by key: pk, old and new as structs, kind (insert, update, same, delete)."""
    a = old.select(pk_json(spec.keys).alias("pk"), F.struct(*[F.col(f"`{c}`") for c in old.columns]).alias("o"))
    b = new.select(pk_json(spec.keys).alias("pk"), F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("n"))
    names = [c for c in spec.names if c in new.columns]
    same = reduce(lambda x, y: x & y, [F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in names], F.lit(True))
    kind = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(same, "same").otherwise("update")
    return a.join(b, "pk", "full_outer").withColumn("kind", kind)


def capture(old: DataFrame, new: DataFrame, spec: TableSpec, hlc: str, touched: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What capture makes of a snapshot replaced by another: (stamped rows, tombstones' keys, changes by kind).

    Inserted rows are stamped whole. An updated row's clock moves; in its map, the clocks of columns that changed. With
    `touched`, rows that were written with equal values move their clock too, but nothing else. Deleted keys come back as
    (row_pks) for the delete log.
    """
    both = diff(old, new, spec)
    changes = changed_columns(spec)
    stamped_map = restamped(F.col(f"o.{COLUMN_HLCS}"), F.col("__changed"), hlc)
    moved = (F.col("kind") == "update") | (F.lit(touched) & (F.col("kind") == "same"))
    row_hlc = F.when((F.col("kind") == "insert") | moved, F.lit(hlc)).otherwise(F.col(f"o.{ROW_HLC}"))
    clocks = F.when(F.col("kind") == "insert", _map([(c, F.lit(hlc)) for c in spec.tracked])).when(moved, stamped_map).otherwise(F.col(f"o.{COLUMN_HLCS}"))
    given = [c for c in spec.names if c in new.columns]
    rows = both.filter("kind <> 'delete'").withColumn("__changed", names_where(changes)).select(
        *[(F.col(f"n.`{c}`") if c in given else F.col(f"o.`{c}`")).alias(c) for c in spec.names], row_hlc.alias(ROW_HLC), clocks.alias(COLUMN_HLCS), F.coalesce(F.col(f"o.{COLUMN_SIGS}"), _empty_map()).alias(COLUMN_SIGS)
    )
    dirty = F.when(F.col("kind") == "update", reduce(lambda x, y: x | y, changes.values(), F.lit(False))).otherwise(F.col("kind").isin("insert", "delete"))
    return rows, both.filter("kind = 'delete'").select(F.col("pk").alias("row_pks")), both.select("pk", "kind", dirty.alias("dirty"))


def tombstones(keys: DataFrame, table: str, hlc: str | None) -> DataFrame:
    """Rows of the delete log for (row_pks); the id is derived from table, key and clock, so a replayed commit makes the same rows."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(table), F.col("row_pks"), F.lit(hlc or "")), 256)
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    clocks = _map([(c, F.lit(hlc)) for c in ("table_name", "row_pks")]) if hlc is not None else _empty_map()
    return keys.select(uuid.alias("id"), F.lit(table).alias("table_name"), "row_pks", F.lit(hlc).cast("string").alias(ROW_HLC), clocks.alias(COLUMN_HLCS), _empty_map().alias(COLUMN_SIGS))


def update_rows(state: DataFrame, spec: TableSpec, condition: Column, assign: dict[str, Column], hlc: str | None) -> tuple[DataFrame, Column]:
    """State with the assignments on matching rows, in one narrow pass; and the condition under which the table is dirty.

    The clock of every matching row moves, also where values stay; map entries only for columns that change.
    """
    check = {**dict.fromkeys(assign)}
    if bad := [c for c in check if c not in spec.names or c in spec.pks]:
        raise ValidationError(f"can't assign {bad} of {spec.name!r}")
    hit = F.coalesce(condition, F.lit(False))
    new = {c: F.when(hit, v.cast(spec.kind(c))).otherwise(F.col(f"`{c}`")) for c, v in assign.items()}
    if not spec.synced:
        return state.withColumns(new), hit
    changes = {c: hit & ~F.col(f"`{c}`").eqNullSafe(v.cast(spec.kind(c))) for c, v in assign.items() if c in spec.tracked}
    clocks = restamped(F.col(COLUMN_HLCS), F.col("__changed"), hlc)
    # In a step of its own: within a lambda, a name would mean the column as it is assigned beside it.
    marked = state.withColumn("__changed", names_where(changes))
    out = marked.withColumns({**new, ROW_HLC: F.when(hit, F.lit(hlc)).otherwise(F.col(ROW_HLC)), COLUMN_HLCS: F.when(hit, clocks).otherwise(F.col(COLUMN_HLCS))})
    return out.select(*state.columns), reduce(lambda x, y: x | y, changes.values(), F.lit(False))


def upsert(state: DataFrame, rows: DataFrame, spec: TableSpec, hlc: str, update: list[str] | None = None) -> DataFrame:
    """Insert, or on a key that exists update the columns in `update` (None: do nothing). Of rows that repeat a key, the first in the order of their values counts.

    Unlike an update, a conflict stamps every assigned column, changed or not, *_no_sync ones included.
    """
    check_written(rows, spec)
    new = stamp_inserts(rows, spec, hlc).withColumn("__pk", pk_json(spec.keys))
    first = new.groupBy("__pk").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in spec.names])).alias("n"))
    old = state.withColumn("__old", pk_json(spec.keys))
    both = old.join(first, F.col("__old") == F.col("__pk"), "full_outer")
    fresh, hit = F.col("__old").isNull(), F.col("__old").isNotNull() & F.col("__pk").isNotNull() & F.lit(update is not None)
    assigned = update or []
    stamped = _map([(c, F.lit(hlc)) for c in assigned])
    clocks = F.coalesce(F.col(COLUMN_HLCS), _empty_map())
    merged = F.map_concat(F.map_filter(clocks, lambda k, _: ~k.isin(assigned)), stamped) if assigned else clocks
    out = [F.when(fresh | (hit & F.lit(c in assigned)), F.col(f"n.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) for c in spec.names]
    return both.select(
        *out,
        F.when(fresh | hit, F.lit(hlc)).otherwise(F.col(ROW_HLC)).alias(ROW_HLC),
        F.when(fresh, _map([(c, F.lit(hlc)) for c in spec.tracked])).when(hit, merged).otherwise(F.col(COLUMN_HLCS)).alias(COLUMN_HLCS),
        F.when(fresh, _empty_map()).otherwise(F.col(COLUMN_SIGS)).alias(COLUMN_SIGS),
    )


def install(rows: DataFrame, spec: TableSpec, hlc: str) -> DataFrame:
    """Make a plain table replicate: rows without a clock get the commit's, for the row and for all columns but keys, *_no_sync ones too."""
    rows = ensure_metadata(rows)
    columns = [c for c in spec.names if c not in spec.pks]
    bare = F.col(ROW_HLC).isNull()
    clocks = _map([(c, F.lit(hlc)) for c in columns])
    return rows.withColumns({COLUMN_HLCS: F.when(bare, clocks).otherwise(F.col(COLUMN_HLCS)), ROW_HLC: F.when(bare, F.lit(hlc)).otherwise(F.col(ROW_HLC))})


def stamp_unstamped(state: DataFrame, spec: TableSpec, hlc: str) -> DataFrame:
    """Rows without a clock, written before there was one, get the commit's; their map, of tracked columns only."""
    bare = F.col(ROW_HLC).isNull()
    clocks = _map([(c, F.lit(hlc)) for c in spec.tracked])
    return state.withColumns({COLUMN_HLCS: F.when(bare, clocks).otherwise(F.col(COLUMN_HLCS)), ROW_HLC: F.when(bare, F.lit(hlc)).otherwise(F.col(ROW_HLC))})


def copy_verbatim(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows for a rebuilt table: metadata kept as it is, columns that are gone dropped, new ones NULL; nothing is captured."""
    rows = ensure_metadata(rows)
    out = [F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) if c.name in rows.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in spec.columns]
    return rows.select(*out, *METADATA)


def mark_dirty(dirty: DataFrame, tables: list[str], now) -> DataFrame:
    """The dirty set with the tables marked at `now`; the latest mark of each table stays."""
    spark = dirty.sparkSession
    marks = spark.createDataFrame([(t, now) for t in tables], "table_name string, last_modified timestamp")
    return dirty.unionByName(marks).groupBy("table_name").agg(F.max("last_modified").alias("last_modified"))


def merge_legacy(current: DataFrame, legacy: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore of legacy rows; rows of equal key must agree."""
    other = [c for c in current.columns if c not in keys]
    if other:
        a, b = current.alias("a"), legacy.alias("b")
        same_key = reduce(lambda x, y: x & y, [F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in keys])
        differs = reduce(lambda x, y: x | y, [~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in other])
        if not a.join(b, same_key).filter(differs).limit(1).isEmpty():
            raise ValidationError("legacy and current rows contradict each other")
    return current.unionByName(legacy.select(*current.columns).join(current.select(*keys), keys, "left_anti"))


__all__ = ["DELETED_ROWS", "capture", "charge", "check_written", "copy_verbatim", "diff", "install", "mark_dirty", "merge_legacy", "stamp_inserts", "stamp_unstamped", "tombstones", "update_rows", "upsert"]
