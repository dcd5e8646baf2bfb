"""Table specifications: keys, tracked columns, the three metadata columns, name rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The metadata columns. Their suffix keeps them out of replication by the common rule.
ROW_HLC, COLUMN_HLCS, COLUMN_SIGS = "row_hlc_no_sync", "column_hlcs_no_sync", "column_sigs_no_sync"
METADATA = (ROW_HLC, COLUMN_HLCS, COLUMN_SIGS)
NO_SYNC = "_no_sync"
DELETED_ROWS = "deleted_rows"

METADATA_FIELDS = [T.StructField(ROW_HLC, T.StringType()), T.StructField(COLUMN_HLCS, T.MapType(T.StringType(), T.StringType())), T.StructField(COLUMN_SIGS, T.MapType(T.StringType(), T.StringType()))]
CHANGE = T.StructType([T.StructField(n, T.StringType()) for n in ("table_name", "row_pks", "column_name", "hlc_timestamp", "value", "device_id", "sig")])
BATCH = T.StructType([*CHANGE.fields, T.StructField("input_index", T.LongType())])


class EngineError(Exception):
    """Root of the errors that operators raise."""


class ValidationError(EngineError):
    """A name, batch, statement or schema that is refused."""


class MissingMetadata(EngineError):
    """A table without the metadata columns or without a key."""


def is_safe_identifier(name: str) -> bool:
    """Not empty; letters, digits, underscore and hyphen only, of any script."""
    return bool(name) and all(c.isalnum() or c in "_-" for c in name)


def safe_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[\p{L}\p{N}_-]+$"), F.lit(False))


def normalize_table_name(name: str) -> str:
    """Last part of a dotted name, without quotes, in lower case."""
    return re.split(r"\.", name)[-1].strip("\"'`[] ").lower()


_KINDS = {"string": T.StringType(), "long": T.LongType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def parse_schema(schema: T.StructType | str) -> T.StructType:
    """`name type, ...` of plain types without a session; other types by Spark's parser, which needs one."""
    if not isinstance(schema, str):
        return schema
    fields = [f.split() for f in schema.split(",")]
    if all(len(f) == 2 and f[1].lower() in _KINDS for f in fields):
        return T.StructType([T.StructField(n, _KINDS[kind.lower()]) for n, kind in fields])
    return T._parse_datatype_string(schema)


@dataclass(frozen=True)
class TableSpec:
    """A table's declared columns in order (without metadata) and its key columns.

    synced: whether it has metadata columns; local tables have none and are left alone. required and unique are the
    constraints that inserted rows are held to.
    """

    name: str
    columns: tuple[T.StructField, ...]
    pks: tuple[str, ...]
    synced: bool = True
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = field(default=())

    @staticmethod
    def of(name: str, schema: T.StructType | str, pks: list[str] | tuple[str, ...], **more) -> TableSpec:
        if not is_safe_identifier(name):
            raise ValidationError(f"invalid table name {name!r}")
        schema = parse_schema(schema)
        columns = tuple(f for f in schema.fields if f.name not in METADATA)
        for c in columns:
            if not is_safe_identifier(c.name):
                raise ValidationError(f"invalid column name {c.name!r} in {name!r}")
        if missing := [p for p in pks if p not in [c.name for c in columns]]:
            raise ValidationError(f"key columns {missing} aren't columns of {name!r}")
        more.setdefault("synced", not name.endswith(NO_SYNC))
        return TableSpec(name, columns, tuple(pks), **more)

    def kind(self, column: str) -> T.DataType:
        return next(c.dataType for c in self.columns if c.name == column)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def keys(self) -> list[tuple[str, T.DataType]]:
        """Key columns in declaration order, with types."""
        return [(c.name, c.dataType) for c in self.columns if c.name in self.pks]

    @property
    def tracked(self) -> list[str]:
        """Columns that replicate: neither key nor named *_no_sync."""
        return [c.name for c in self.columns if c.name not in self.pks and not c.name.endswith(NO_SYNC)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*self.columns, *(METADATA_FIELDS if self.synced else [])])

    def add_column(self, column: T.StructField) -> TableSpec:
        if not is_safe_identifier(column.name) or column.name in self.names or column.name in METADATA:
            raise ValidationError(f"can't add column {column.name!r} to {self.name!r}")
        return replace(self, columns=(*self.columns, column))

    def rename_column(self, old: str, new: str) -> TableSpec:
        """Renaming across the replication boundary is refused, as is renaming keys and metadata."""
        if old not in self.names or old in self.pks or new in [*self.names, *METADATA] or not is_safe_identifier(new):
            raise ValidationError(f"can't rename {old!r} to {new!r} in {self.name!r}")
        if old.endswith(NO_SYNC) != new.endswith(NO_SYNC):
            raise ValidationError(f"renaming {old!r} to {new!r} would change whether it replicates")
        return replace(self, columns=tuple(T.StructField(new, c.dataType, c.nullable) if c.name == old else c for c in self.columns))

    def drop_column(self, name: str) -> TableSpec:
        if name not in self.names or name in self.pks:
            raise ValidationError(f"can't drop {name!r} from {self.name!r}")
        return replace(self, columns=tuple(c for c in self.columns if c.name != name))


DELETED_ROWS_SPEC = TableSpec.of(DELETED_ROWS, "id string, table_name string, row_pks string", ["id"])


def table_schema(df: DataFrame, spec: TableSpec) -> list[dict]:
    """Column metadata: name, type, whether part of the key."""
    return [{"name": f.name, "type": f.dataType.simpleString(), "is_pk": f.name in spec.pks} for f in df.schema.fields]


def partition_columns(spec: TableSpec) -> tuple[list[str], list[str]]:
    """(key columns, columns that replicate)."""
    return [n for n, _ in spec.keys], spec.tracked


def has_metadata(df: DataFrame) -> bool:
    return all(c in df.columns for c in METADATA)


def ensure_metadata(df: DataFrame) -> DataFrame:
    """Add the metadata columns that are missing: no clock, empty maps."""
    empty = F.expr("cast(map() as map<string,string>)")
    return df.withColumns({c: F.lit(None).cast("string") if c == ROW_HLC else empty for c in METADATA if c not in df.columns})


def foreign_key_violations(tables: dict[str, DataFrame], specs: dict[str, TableSpec]) -> list[tuple[str, DataFrame]]:
    """For each declared foreign key (column, parent, parent column) the child rows without a parent; NULL references none."""
    out = []
    for name, spec in specs.items():
        for column, parent, parent_column in spec.foreign_keys:
            child = tables[name].filter(F.col(column).isNotNull())
            parents = tables[parent].select(F.col(parent_column).alias("__parent"))
            out.append((name, child.join(parents, F.col(column) == F.col("__parent"), "left_anti")))
    return out


def violating_tables(tables: dict[str, DataFrame], specs: dict[str, TableSpec]) -> list[str]:
    """Distinct tables with a foreign key violation."""
    return sorted({name for name, rows in foreign_key_violations(tables, specs) if not rows.isEmpty()})
