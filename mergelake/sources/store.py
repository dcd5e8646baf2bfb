"""A store of tables: immutable Parquet versions and one manifest, replaced atomically; one writer, any number of readers.

Layout under the root: manifest-<version>.json (the newest counts), data/<table>/<id> (Parquet). A commit writes new
versions of the tables it touched, then its manifest, through Hadoop's file system, so any root that Spark can write
will do; the rename of the manifest is the commit. A reader pins a manifest, and sees one state whatever is written
meanwhile.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.operators import capture as cap
from mergelake.operators import merge, retention, scan
from mergelake.operators.schema import (
    BATCH,
    DELETED_ROWS,
    DELETED_ROWS_SPEC,
    EngineError,
    METADATA,
    MissingMetadata,
    ROW_HLC,
    TableSpec,
    ValidationError,
    has_metadata,
    is_safe_identifier,
    parse_schema,
    violating_tables,
)
from mergelake.plans.clock import Clock, ClockError, parse
from mergelake.plans.guard import Guard
from mergelake.plans.policy import ApplyPolicy, NoSignatures, SignaturePolicy, SignatureProvider, change_preimage

CAPTURE_VERSION = 4


class StoreLocked(EngineError):
    """Another process writes to the store."""


class MigrationError(EngineError):
    """A migration changed, vanished or failed."""


class ClockBehind(EngineError):
    """The merge is committed, but the clock couldn't take in its newest clock; `outcome` has the merge's."""

    def __init__(self, message: str, outcome):
        super().__init__(message)
        self.outcome = outcome


@dataclass(frozen=True)
class StoreConfig:
    """device: UUID of this writer. bootstrap: called once in the first commit, with its transaction."""

    device: str
    max_transaction_bytes: int = cap.MAX_TRANSACTION_BYTES
    max_value_bytes: int = cap.MAX_VALUE_BYTES
    capture_version: int = CAPTURE_VERSION
    signatures: SignatureProvider = field(default_factory=NoSignatures)
    now: Callable[[], int] | None = None
    bootstrap: Callable[[Transaction], None] | None = None


def spec_to_json(spec: TableSpec) -> dict:
    return {"name": spec.name, "schema": json.loads(T.StructType(list(spec.columns)).json()), "pks": list(spec.pks), "synced": spec.synced, "required": list(spec.required), "unique": [list(u) for u in spec.unique], "foreign_keys": [list(k) for k in spec.foreign_keys]}


def spec_from_json(x: dict) -> TableSpec:
    return TableSpec(x["name"], tuple(T.StructType.fromJson(x["schema"]).fields), tuple(x["pks"]), x["synced"], tuple(x["required"]), tuple(tuple(u) for u in x["unique"]), tuple(tuple(k) for k in x["foreign_keys"]))


def migration_digest(body: str | Callable) -> str:
    """Of a migration's text; of a callable's name, as its code isn't text."""
    return hashlib.sha256((body if isinstance(body, str) else f"{body.__module__}.{body.__qualname__}").encode()).hexdigest()


def journal_status(source: dict[str, str | Callable], journal: dict[str, str]) -> dict[str, str]:
    """What became of each migration, in order of name: missing from the source, pending, changed since, or applied."""
    out = {}
    for name in sorted({*source, *journal}):
        if name not in source:
            out[name] = "missing"
        elif name not in journal:
            out[name] = "pending"
        else:
            out[name] = "applied" if journal[name] == migration_digest(source[name]) else "changed"
    return out


EMPTY = {"version": 0, "tables": {}, "specs": {}, "dirty": {}, "config": {}, "journals": {"core": {}, "consumer": {}}, "capture_version": CAPTURE_VERSION}


class Snapshot:
    """A pinned manifest: tables as they were at one commit."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest = store, manifest
        self.specs = {n: spec_from_json(x) for n, x in manifest["specs"].items()}

    def table(self, name: str) -> DataFrame:
        if name not in self.manifest["tables"]:
            raise ValidationError(f"no table {name!r}")
        spec = self.specs[name]
        path = self.manifest["tables"][name]
        schema = spec.schema
        return self.store.spark.read.schema(schema).parquet(f"{self.store.root}/{path}") if path else self.store.spark.createDataFrame([], schema)

    def names(self) -> list[str]:
        return sorted(self.manifest["tables"])

    def discover(self) -> list[str]:
        """Names, sorted, of the tables that carry a row clock."""
        return [n for n in self.names() if self.specs[n].synced]

    def dirty(self) -> DataFrame:
        rows = list(self.manifest["dirty"].items())
        return self.store.spark.createDataFrame(rows, "table_name string, last_modified string").withColumn("last_modified", F.to_timestamp("last_modified"))

    def views(self) -> None:
        for n in self.names():
            self.table(n).createOrReplaceTempView(n)

    def sql(self, text: str, guard: Guard = Guard()) -> DataFrame:
        """A read over the snapshot's tables, guarded."""
        guard.check(self.store.spark, text)
        self.views()
        return self.store.spark.sql(text)

    def scan(self, name: str, after_hlc: str | None = None, filters: scan.ScanFilters = scan.ScanFilters()) -> DataFrame:
        """Change records of a table; none of one that isn't there."""
        if not is_safe_identifier(name):
            raise ValidationError(f"invalid table name {name!r}")
        known = name in self.specs
        return scan.scan_changes(self.table(name) if known else None, self.specs.get(name), after_hlc, self.store.config.device, filters, self.store.spark)

    def stats(self) -> dict[str, int]:
        return retention.stats({n: self.table(n) for n in self.names()})


class Transaction:
    """One commit in the making: reads see its own writes; one clock stamps all. An exception leaves the store as it was."""

    def __init__(self, store: Store, base: Snapshot):
        self.store, self.base = store, base
        self.frames: dict[str, DataFrame] = {}
        self.specs = dict(base.specs)
        self.dropped: set[str] = set()
        self.dirtied: set[str] = set()
        self.touched: set[str] = set()
        self.bytes = 0
        self._hlc: str | None = None

    @property
    def hlc(self) -> str:
        if self._hlc is None:
            self._hlc = self.store.clock.draw()
        return self._hlc

    def table(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if name in self.dropped or name not in self.specs:
            raise ValidationError(f"no table {name!r}")
        return self.base.table(name)

    def sql(self, text: str, guard: Guard = Guard()) -> DataFrame:
        guard.check(self.store.spark, text)
        for n in self.specs:
            if n not in self.dropped:
                self.table(n).createOrReplaceTempView(n)
        return self.store.spark.sql(text)

    def _spec(self, name: str) -> TableSpec:
        if name not in self.specs:
            raise ValidationError(f"no table {name!r}")
        return self.specs[name]

    def _charge(self, rows: DataFrame, spec: TableSpec) -> None:
        config = self.store.config
        self.bytes += cap.charge(rows, spec, config.max_transaction_bytes, config.max_value_bytes)
        if self.bytes > config.max_transaction_bytes:
            raise cap.LimitExceeded(f"{self.bytes} bytes written; the limit is {config.max_transaction_bytes}")

    def _put(self, name: str, df: DataFrame, dirty: bool = True) -> None:
        self.frames[name] = df
        self.touched.add(name)
        if dirty and self.specs[name].synced:
            self.dirtied.add(name)

    def _sign(self, rows: DataFrame, spec: TableSpec) -> DataFrame:
        """Signatures of the columns that this commit stamped."""
        provider = self.store.config.signatures
        if type(provider).sign is SignatureProvider.sign or not spec.synced:
            return rows
        from mergelake.functions.codec import encode_value, pk_json, preimage
        from mergelake.operators.schema import COLUMN_HLCS, COLUMN_SIGS

        if not spec.tracked:
            return rows
        stamped = {c: F.coalesce(F.col(COLUMN_HLCS)[c] == self.hlc, F.lit(False)) for c in spec.tracked}
        names = cap.names_where(stamped)
        signed = [provider.sign(preimage(F.lit(spec.name), pk_json(spec.keys), F.lit(c), F.lit(self.hlc), encode_value(F.col(f"`{c}`"), spec.kind(c)))) for c in spec.tracked]
        fresh = F.create_map(*[x for c, v in zip(spec.tracked, signed) for x in (F.lit(c), v)])
        kept = F.map_filter(F.coalesce(F.col(COLUMN_SIGS), F.expr("cast(map() as map<string,string>)")), lambda k, _: ~F.array_contains(names, k))
        return rows.withColumn(COLUMN_SIGS, F.map_concat(kept, F.map_filter(fresh, lambda k, v: F.array_contains(names, k) & v.isNotNull())))

    # Schema

    def create_table(self, name: str, schema, pks: list[str], **more) -> TableSpec:
        if name in self.specs and name not in self.dropped:
            raise ValidationError(f"table {name!r} exists")
        schema = T.StructType([f for f in parse_schema(schema).fields if f.name not in METADATA])
        self.specs[name] = spec = TableSpec.of(name, schema, pks, **more)
        self.dropped.discard(name)
        self._put(name, self.store.spark.createDataFrame([], spec.schema), dirty=False)
        return spec

    def drop_table(self, name: str) -> None:
        self._spec(name)
        self.frames.pop(name, None)
        del self.specs[name]
        self.dropped.add(name)

    def alter_table(self, name: str, change: Callable[[TableSpec], TableSpec], rename: dict[str, str] | None = None) -> TableSpec:
        """Change the specification; rows are rebuilt with their metadata as it is. rename: old name to new, to carry values over."""
        old = self.table(name)
        self.specs[name] = spec = change(self._spec(name))
        for a, b in (rename or {}).items():
            old = old.withColumnRenamed(a, b)
        self._put(name, cap.copy_verbatim(old, spec) if spec.synced else old.select(*[F.col(f"`{c.name}`") if c.name in old.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in spec.columns]), dirty=False)
        return spec

    def rename_table(self, old: str, new: str) -> None:
        """Refused across the replication boundary."""
        if old.endswith("_no_sync") != new.endswith("_no_sync"):
            raise ValidationError(f"renaming {old!r} to {new!r} would change whether it replicates")
        spec, rows = self._spec(old), self.table(old)
        if new in self.specs:
            raise ValidationError(f"table {new!r} exists")
        self.drop_table(old)
        self.specs[new] = TableSpec.of(new, T.StructType(list(spec.columns)), spec.pks, synced=spec.synced, required=spec.required, unique=spec.unique, foreign_keys=spec.foreign_keys)
        self._put(new, rows, dirty=False)

    def install(self, name: str) -> None:
        """Make a local table replicate; its rows are stamped with this commit's clock and signed."""
        spec = self._spec(name)
        if spec.synced and has_metadata(self.table(name)):
            rows = self.table(name)
        else:
            from dataclasses import replace

            rows = self.table(name)
            self.specs[name] = spec = replace(spec, synced=True)
        self._put(name, self._sign(cap.install(rows, spec, self.hlc), spec))

    def copy_rows_verbatim(self, source: str, target: str) -> None:
        self._put(target, cap.copy_verbatim(self.table(source), self._spec(target)), dirty=False)

    # Rows

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        """Insert rows; returns them as stored (RETURNING)."""
        spec = self._spec(name)
        cap.check_written(rows, spec)
        self._charge(rows, spec)
        new = self._sign(cap.stamp_inserts(rows, spec, self.hlc if spec.synced else None), spec)
        new = self.store.save(f"insert-{name}", new)
        self._reject_duplicates(new, spec, name)
        self._put(name, self.table(name).unionByName(new))
        return new

    def _reject_duplicates(self, new: DataFrame, spec: TableSpec, name: str) -> None:
        """Required values, keys and unique values, within the rows and against the table; NULLs repeat freely in unique columns."""
        from mergelake.functions.codec import pk_json

        self._reject_missing(new, spec, spec.required)
        pk = new.select(pk_json(spec.keys).alias("pk"))
        repeated = pk.groupBy("pk").count().filter("count > 1").select("pk").unionByName(pk.join(self.table(name).select(pk_json(spec.keys).alias("pk")), "pk", "left_semi"))
        if spec.pks and not repeated.isEmpty():
            raise EngineError(f"keys of rows for {name!r} exist or repeat")
        self._reject_repeats(self.table(name).select(*spec.names).unionByName(new.select(*spec.names)), spec)

    def _reject_missing(self, written: DataFrame, spec: TableSpec, columns) -> None:
        if columns and not written.filter(reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns])).isEmpty():
            raise EngineError(f"required values are missing in rows for {spec.name!r}")

    def _reject_repeats(self, rows: DataFrame, spec: TableSpec) -> None:
        """Refuse a table's rows, as they would be stored, if a unique value repeats."""
        for columns in spec.unique:
            whole = rows.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns]))
            if not whole.groupBy(*[F.col(f"`{c}`") for c in columns]).count().filter("count > 1").isEmpty():
                raise EngineError(f"values of {list(columns)} repeat in {spec.name!r}")

    def upsert(self, name: str, rows: DataFrame, update: list[str] | None = None) -> None:
        spec = self._spec(name)
        cap.check_written(rows, spec)
        self._charge(rows, spec)
        stored = self._sign(cap.upsert(self.table(name), rows, spec, self.hlc, update), spec)
        self._reject_missing(stored.filter(F.col(ROW_HLC) == self.hlc), spec, spec.required)
        self._reject_repeats(stored, spec)
        self._put(name, stored)

    def update(self, name: str, assign: dict[str, Column], where: Column | None = None) -> DataFrame:
        """Assign to matching rows; returns these as stored (keys can't be assigned, so they name the rows)."""
        from mergelake.functions.codec import pk_json

        spec = self._spec(name)
        where = F.lit(True) if where is None else where
        state = self.table(name)
        if used := [c for c in assign if c in METADATA]:
            raise ValidationError(f"metadata columns can't be written: {used}")
        new, changed = cap.update_rows(state, spec, where, assign, self.hlc if spec.synced else None)
        self._reject_missing(state.filter(where).select(*[v.alias(c) for c, v in assign.items()]), spec, [c for c in spec.required if c in assign])
        self._reject_repeats(new, spec)
        self._charge(state.filter(where).select(*[v.cast(spec.kind(c)).alias(c) for c, v in assign.items()]), spec)
        dirty = spec.synced and not state.filter(changed).limit(1).isEmpty()
        matched = self.store.save(f"matched-{name}", state.filter(where).select(pk_json(spec.keys).alias("__pk")))
        self._put(name, self._sign(new, spec), dirty)
        stored = self.table(name)
        return stored.withColumn("__pk", pk_json(spec.keys)).join(matched, "__pk", "left_semi").select(*stored.columns)

    def delete(self, name: str, where: Column) -> None:
        """Delete matching rows and log their keys."""
        from mergelake.functions.codec import pk_json

        spec, state = self._spec(name), self.table(name)
        hit = F.coalesce(where, F.lit(False))
        if spec.synced:
            gone = self.store.save(f"deleted-{name}", state.filter(hit).select(pk_json(spec.keys).alias("row_pks")))
            if not gone.isEmpty():
                self._put(DELETED_ROWS, self.table(DELETED_ROWS).unionByName(self._sign(cap.tombstones(gone, name, self.hlc), DELETED_ROWS_SPEC)))
                self._put(name, state.filter(~hit))
        else:
            self._put(name, state.filter(~hit))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Replace a table's rows by a snapshot; what changed is found by comparing, then captured like single writes."""
        spec = self._spec(name)
        cap.check_written(rows, spec)
        stamped, deleted, kinds = cap.capture(self.table(name), rows, spec, self.hlc)
        self._reject_missing(stamped, spec, spec.required)
        self._reject_repeats(stamped, spec)
        kinds = self.store.save(f"diff-{name}", kinds)
        if kinds.filter("dirty OR kind <> 'same'").isEmpty():
            return
        deleted = self.store.save(f"deleted-{name}", deleted)
        self._put(name, self._sign(stamped, spec), not kinds.filter("dirty").isEmpty())
        if not deleted.isEmpty():
            self._put(DELETED_ROWS, self.table(DELETED_ROWS).unionByName(self._sign(cap.tombstones(deleted, name, self.hlc), DELETED_ROWS_SPEC)))

    def check_foreign_keys(self) -> None:
        names = [n for n in self.specs if n not in self.dropped]
        if bad := violating_tables({n: self.table(n) for n in names}, {n: self.specs[n] for n in names}):
            raise EngineError(f"foreign keys are violated in {bad}")


class Store:
    """Opens at a root folder; `writable` takes the lock."""

    def __init__(self, spark: SparkSession, root: str, config: StoreConfig, writable: bool = True):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self.observers: list[Callable[[list[str]], None]] = []
        self._writing = 0
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.root}/{name}" if name else self.root)
        self._fs = path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))
        self._lock = self._acquire() if writable else None
        manifest = self._manifest()
        saved = manifest["config"].get("clock")
        self.clock = Clock(config.device, *([config.now] if config.now else []), last=saved) if config.now else Clock(config.device, last=saved)
        if writable and manifest["version"] == 0:
            self._first_commit()
        elif writable and manifest["capture_version"] < config.capture_version:
            self._publish({**manifest, "capture_version": config.capture_version}, manifest)

    # Files

    def _acquire(self) -> int | None:
        """Advisory lock on a local root; on others the manifest's exclusive creation keeps writers apart."""
        if not (m := re.fullmatch(r"(?:file:/*)?(/?[^:]*)", self.root)):
            return None
        import fcntl

        handle = os.open(os.path.realpath("/" + m[1].lstrip("/")) + "/.lock", os.O_CREAT | os.O_RDWR)
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            os.close(handle)
            raise StoreLocked(f"another process writes to {self.root}") from e
        return handle

    def close(self) -> None:
        if self._lock is not None:
            os.close(self._lock)
            self._lock = None

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for s in self._fs.listStatus(self._path("")) if (m := re.fullmatch(r"manifest-(\d+)\.json", s.getPath().getName())))

    def _manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return json.loads(json.dumps(EMPTY))
        stream = self._fs.open(self._path(f"manifest-{versions[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict, base: dict) -> None:
        """Rename the new manifest into place; it fails if another commit came first."""
        manifest = {**manifest, "version": base["version"] + 1}
        temporary = self._path(f".manifest-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        final = self._path(f"manifest-{manifest['version']:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise EngineError("another commit came first")

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write a frame under the root and read it back: its plan ends there, and its rows no longer change."""
        df.write.parquet(path := f"{self.root}/data/{name}/{uuid.uuid4().hex}")
        return self.spark.read.schema(df.schema).parquet(path)

    def vacuum(self, keep: int = 2) -> None:
        """Remove data that none of the newest `keep` manifests uses, and older manifests. Only the writer may, and not within
        a transaction, whose rows no manifest names yet. Readers that pin an older manifest than those kept lose their files."""
        if self._closed_for_writing() or self._writing:
            raise EngineError("vacuum needs the writer's store, outside a transaction")
        versions = self._versions()
        used: set[str] = set()
        for v in versions[-keep:]:
            stream = self._fs.open(self._path(f"manifest-{v:012d}.json"))
            used |= {p for p in json.loads(bytes(stream.readAllBytes()).decode())["tables"].values() if p}
            stream.close()
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"manifest-{v:012d}.json"), False)
        if self._fs.exists(self._path("data")):
            for d in self._fs.listStatus(self._path("data")):
                for x in self._fs.listStatus(d.getPath()):
                    if f"data/{d.getPath().getName()}/{x.getPath().getName()}" not in used:
                        self._fs.delete(x.getPath(), True)

    # Reading

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self._manifest())

    def read(self, text: str, guard: Guard = Guard()) -> DataFrame:
        return self.snapshot().sql(text, guard)

    def scan_dirty_tables(self) -> list[str]:
        return [r[0] for r in scan.scan_dirty_tables(self.snapshot().dirty()).collect()]

    def clean(self, tables: list[str]) -> None:
        """Take tables out of the dirty set, after their changes were sent."""
        base = self._manifest()
        self._publish({**base, "dirty": {k: v for k, v in base["dirty"].items() if k not in tables}}, base)

    # Writing

    def observe(self, callback: Callable[[list[str]], None]) -> None:
        """Called after each commit with the sorted names of the tables it changed; not with bookkeeping, not after a rollback. Its errors are ignored."""
        self.observers.append(callback)

    @contextlib.contextmanager
    def write(self, check_foreign_keys: bool = False) -> Iterator[Transaction]:
        """A transaction: commits at the end of the block, or not at all."""
        if self._closed_for_writing():
            raise StoreLocked("the store is open for reading")
        tx = Transaction(self, self.snapshot())
        self._writing += 1
        try:
            yield tx
            if check_foreign_keys:
                tx.check_foreign_keys()
            self._commit(tx.base.manifest, tx.frames, tx.specs, tx.dirtied, tx.touched)
        finally:
            self._writing -= 1

    def _closed_for_writing(self) -> bool:
        return self._lock is None and re.fullmatch(r"(?:file:/*)?(/?[^:]*)", self.root) is not None

    def _commit(self, base: dict, frames: dict[str, DataFrame], specs: dict[str, TableSpec], dirtied: set[str], touched: set[str]) -> None:
        tables = {n: p for n, p in base["tables"].items() if n in specs}
        for name, df in frames.items():
            df.select(*specs[name].schema.fieldNames()).write.parquet(f"{self.root}/{(path := f'data/{name}/{uuid.uuid4().hex}')}")
            tables[name] = path
        now = self.spark.sql("SELECT CAST(current_timestamp() AS STRING)").first()[0]
        dirty = {n: t for n, t in base["dirty"].items() if n in specs} | dict.fromkeys(sorted(dirtied), now)
        clock = self.clock.current()
        self._publish({**base, "tables": tables, "specs": {n: spec_to_json(s) for n, s in specs.items()}, "dirty": dirty, "config": base["config"] | ({"clock": clock} if clock else {})}, base)
        if seen := sorted(n for n in touched if n in specs and n != DELETED_ROWS):
            for callback in self.observers:
                with contextlib.suppress(Exception):
                    callback(seen)

    def _first_commit(self) -> None:
        base = self.snapshot()
        tx = Transaction(self, base)
        tx.specs[DELETED_ROWS] = DELETED_ROWS_SPEC
        tx.frames[DELETED_ROWS] = self.spark.createDataFrame([], DELETED_ROWS_SPEC.schema)
        if self.config.bootstrap:
            self.config.bootstrap(tx)
        self._commit({**base.manifest, "capture_version": self.config.capture_version}, tx.frames, tx.specs, tx.dirtied, tx.touched)

    def stamp_unstamped(self) -> list[str]:
        """Stamp rows that were written before there was a clock; returns the tables that had such rows."""
        base = self.snapshot()
        tx = Transaction(self, base)
        for name in base.discover():
            rows = base.table(name)
            if name != DELETED_ROWS and not rows.filter(F.col(ROW_HLC).isNull()).limit(1).isEmpty():
                tx._put(name, tx._sign(cap.stamp_unstamped(rows, base.specs[name], tx.hlc), base.specs[name]))
        if tx.frames:
            self._commit(base.manifest, tx.frames, tx.specs, tx.dirtied, tx.touched)
        return sorted(tx.frames)

    def apply(self, batch: DataFrame, policy: ApplyPolicy | None = None) -> merge.Outcome:
        """Merge remote changes (input_index is added by order of rows if missing) in one commit; the clock advances after it."""
        policy = policy or SignaturePolicy(self.config.signatures)
        if "input_index" not in batch.columns:
            batch = batch.withColumn("input_index", F.monotonically_increasing_id())
        batch = self.save("inbound", batch.select(*BATCH.fieldNames()))
        # Names, clocks and drift come before the policy: it sees no batch that is refused anyway.
        merge.preflight(batch, self.clock.now())
        policy.preflight(batch)
        base = self.snapshot()
        tables = {n: base.table(n) for n in base.names()}
        outcome = merge.apply_batch(tables, base.specs, batch, self.clock.now(), policy.reject, self.save, policy.on_constraint())
        for name in outcome.tables:
            policy.after_merge(name, outcome.classified)
        policy.before_commit(outcome)
        if outcome.tables:
            self._commit(base.manifest, outcome.tables, base.specs, set(), set(outcome.tables))
        if outcome.max_applied is not None:
            try:
                self.clock.advance(outcome.max_applied)
            except ClockError as e:
                raise ClockBehind(str(e), outcome) from e
        return outcome

    def cleanup(self, policy: retention.Retention, before_prune: Callable[[DataFrame], None] = lambda pruned: None) -> dict:
        """Prune the delete log: rows_deleted, max_pruned_hlc. before_prune sees what goes, and may raise."""
        base = self.snapshot()
        saved = base.manifest["config"].get("clock")
        pruned, kept = retention.split_prunable(base.table(DELETED_ROWS), policy, parse(saved)[0] if saved else None)
        result = retention.prune_summary(pruned).first().asDict()
        if result["rows_deleted"]:
            before_prune(pruned)
            self._commit(base.manifest, {DELETED_ROWS: kept}, base.specs, set(), set())
        return result

    # Migrations

    def migrate(self, migrations: dict[str, str | Callable[[Transaction], None]], journal: str = "consumer") -> list[str]:
        """Apply migrations that the journal doesn't have, in order of name, each in a commit with its journal entry.

        A migration is a callable, or text: statements split at lines `--> breakpoint`, each a JSON object {"create":
        name, "schema": DDL, "pks": [...]} or {"add": column DDL, "to": name}. A journalled one whose text changed, or
        that is gone from the source, stops all.
        """
        status = journal_status(migrations, self._manifest()["journals"][journal])
        for fault in ("missing", "changed"):
            if names := [n for n, s in status.items() if s == fault]:
                raise MigrationError(f"applied migrations {'are missing' if fault == 'missing' else fault}: {names}")
        applied = []
        for name in [n for n, s in status.items() if s == "pending"]:
            base = self.snapshot()
            tx = Transaction(self, base)
            body = migrations[name]
            if isinstance(body, str):
                for statement in re.split(r"(?m)^-->\s*breakpoint\s*$", body):
                    if statement.strip():
                        self._statement(tx, json.loads(statement))
            else:
                body(tx)
            journals = base.manifest["journals"] | {journal: base.manifest["journals"][journal] | {name: migration_digest(body)}}
            self._commit({**base.manifest, "journals": journals}, tx.frames, tx.specs, tx.dirtied, tx.touched)
            applied.append(name)
        return applied

    @staticmethod
    def _statement(tx: Transaction, x: dict) -> None:
        if "create" in x:
            tx.create_table(x["create"], x["schema"], x["pks"])
        elif "add" in x:
            column = parse_schema(x["add"]).fields[0]
            tx.alter_table(x["to"], lambda s: s.add_column(column))
        else:
            raise MigrationError(f"unknown statement {sorted(x)}")


__all__ = ["ClockBehind", "MigrationError", "MissingMetadata", "Snapshot", "Store", "StoreConfig", "StoreLocked", "Transaction", "change_preimage"]
