"""Outbound side: change records newer than a cursor, and pages that never split a transaction."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergelake.functions.codec import change_json, encode_value, pk_json
from mergelake.functions.hlc import hlc_key, is_from_node
from mergelake.operators.schema import CHANGE, COLUMN_HLCS, COLUMN_SIGS, METADATA, ROW_HLC, MissingMetadata, TableSpec, ValidationError, is_safe_identifier
from mergelake.sources.staging import staging

#: Fixed value: bytes of a page.
PAGE_BYTES = 104_857_600
#: Keys of an allow-list that go as literals into the filter; more are joined.
LITERAL_KEYS = 200
#: Steps of page cutting (three numbers each) that the driver holds at once.
STEPS = 100_000


@dataclass(frozen=True)
class ScanFilters:
    """origin_node: only clocks of this node (thirty-two hex digits). row_pks: only these keys (canonical JSON).
    column_eq: (column, text): only rows where the column equals the text, read as the column's type."""

    origin_node: str | None = None
    row_pks: Iterable[str] | DataFrame | None = None
    column_eq: tuple[str, str] | None = None


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], CHANGE)


def scan_changes(df: DataFrame | None, spec: TableSpec, after_hlc: str | None = None, device_id: str = "", filters: ScanFilters = ScanFilters(), spark=None) -> DataFrame:
    """A record for each tracked column whose clock is newer than after_hlc.

    A column's clock is its entry in the map, or else (missing or empty) the row's; without either it is skipped. Filters
    on rows come before the unpivot; clocks compare numerically. One narrow pass: nothing is shuffled, unless an
    allow-list is a table.
    """
    if filters.column_eq and not is_safe_identifier(filters.column_eq[0]):
        raise ValidationError(f"invalid column name {filters.column_eq[0]!r}")
    if df is None:
        return spark.createDataFrame([], CHANGE)
    if missing := [c for c in METADATA if c not in df.columns]:
        raise MissingMetadata(f"table {spec.name!r} lacks {missing}")
    if not spec.pks:
        raise MissingMetadata(f"table {spec.name!r} has no key")
    if filters.column_eq:
        name, wanted = filters.column_eq
        if name not in df.columns:
            return _empty(df)
        df = df.filter(F.col(f"`{name}`") == F.lit(wanted).try_cast(df.schema[name].dataType))
    rows = df.withColumn("__pk", pk_json(spec.keys))
    if isinstance(filters.row_pks, DataFrame):
        rows = rows.join(filters.row_pks.select(F.col(filters.row_pks.columns[0]).alias("__pk")).distinct(), "__pk", "left_semi")
    elif filters.row_pks is not None:
        wanted = list(dict.fromkeys(filters.row_pks))
        if len(wanted) <= LITERAL_KEYS:
            rows = rows.filter(F.col("__pk").isin(wanted))
        else:
            rows = rows.join(df.sparkSession.createDataFrame([(w,) for w in wanted], "__pk string"), "__pk", "left_semi")
    if not spec.tracked:
        return _empty(df)
    row_hlc = F.nullif(F.col(ROW_HLC), F.lit(""))
    records = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(F.nullif(F.col(COLUMN_HLCS)[c], F.lit("")), row_hlc).alias("hlc_timestamp"),
            encode_value(F.col(f"`{c}`"), spec.kind(c)).alias("value"),
            F.col(COLUMN_SIGS)[c].alias("sig"),
        )
        for c in spec.tracked
    ]
    out = rows.select(F.col("__pk").alias("row_pks"), F.explode(F.array(*records)).alias("r")).select("row_pks", "r.*").filter("hlc_timestamp IS NOT NULL")
    if after_hlc is not None:
        out = out.filter(hlc_key("hlc_timestamp") > hlc_key(F.lit(after_hlc)))
    if filters.origin_node is not None:
        out = out.filter(is_from_node("hlc_timestamp", F.lit(filters.origin_node)))
    return out.select(F.lit(spec.name).alias("table_name"), "row_pks", "column_name", "hlc_timestamp", "value", F.lit(device_id).alias("device_id"), "sig")


def scan_dirty_tables(dirty: DataFrame) -> DataFrame:
    """Names of tables with local changes, the longest waiting first."""
    return dirty.orderBy("last_modified", "table_name").select("table_name")


def changes_of(tables: dict[str, tuple[DataFrame, TableSpec]], after_hlc: str | None = None, device_id: str = "", filters: ScanFilters = ScanFilters()) -> DataFrame:
    """The feed of several tables."""
    return reduce(DataFrame.unionByName, [scan_changes(df, spec, after_hlc, device_id, filters) for df, spec in tables.values()])


def group_sizes(changes: DataFrame, hlc: str = "hlc_timestamp", record=None) -> DataFrame:
    """For each transaction (clock) its number of records and the bytes of the JSON array of them; pre-aggregated."""
    size = F.octet_length(record if record is not None else change_json()).cast("long")
    return changes.groupBy(F.col(hlc).alias("hlc")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).select(hlc_key("hlc").alias("key"), "hlc", "n", (F.col("bytes") + F.col("n") + 1).alias("bytes"))


def _dealt(sizes: DataFrame) -> tuple[DataFrame, list]:
    """sizes, written once in clock order with the number of its range (part), and for each range its sum, count and last transaction, in order.

    Clocks are taken apart once for each transaction, not in every later filter. As many rows come back as there are ranges.
    """
    spark = sizes.sparkSession
    ranged = sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "hlc").withColumn("part", F.spark_partition_id())
    dealt = staging(spark)("transactions", ranged)
    parts = dealt.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max(F.struct("key", "hlc")).alias("end")).orderBy("part").collect()
    return dealt, parts


def _running_bytes():
    """Bytes of a range's transactions up to each."""
    return F.sum("bytes").over(Window.partitionBy("part").orderBy("key", "hlc"))


def first_page(changes: DataFrame, budget: int = PAGE_BYTES, hlc: str = "hlc_timestamp", record=None) -> tuple[DataFrame, bool]:
    """The oldest transactions that fit the budget, one at least, whole; and whether there are more.

    Running sums go over one row per transaction: sums of clock ranges first, then within the one range in which the
    budget runs out.
    """
    dealt, parts = _dealt(group_sizes(changes, hlc, record))
    last, more, spent = None, False, 0
    for k, part in enumerate(parts):
        if spent + part["bytes"] <= budget:
            last, spent = part["end"], spent + part["bytes"]
            continue
        within = dealt.filter(F.col("part") == part["part"]).withColumn("total", _running_bytes() + spent)
        place = F.struct("key", "hlc")
        ends = within.agg(F.max(F.when(F.col("total") <= budget, place)).alias("fits"), F.min(place).alias("first")).first()
        more = True
        if ends["fits"] is not None:
            last = ends["fits"]
        elif last is None:  # the oldest transaction alone is over the budget
            last, more = ends["first"], part["n"] > 1 or k + 1 < len(parts)
        break
    if last is None:
        return changes.limit(0), False
    mine = hlc_key(hlc)
    return changes.filter((mine < last["key"]) | ((mine == last["key"]) & (F.col(hlc) <= last["hlc"]))), more


def page_groups(sizes: DataFrame, budget: int = PAGE_BYTES) -> DataFrame:
    """Over one row per transaction (hlc, key, n, bytes): those of the first page with running totals, and whether more follow."""
    dealt, parts = _dealt(sizes)
    bases, spent = [], 0
    for part in parts:
        bases.append((part["part"], spent))
        spent += part["bytes"]
    more = spent > budget and sum(part["n"] for part in parts) > 1
    base = sizes.sparkSession.createDataFrame(bases, "part int, base long")
    sums = dealt.join(F.broadcast(base), "part").withColumn("total", _running_bytes() + F.col("base"))
    first = F.col("total") == F.col("bytes")
    return sums.filter((F.col("total") <= budget) | first).withColumn("has_more", F.lit(more)).drop("part", "base")


def _steps(budget: int):
    """Over transactions (part, bytes) in order: rows (part, below, pages, spent) that tell what a range makes of the room
    left in the page that is open before it. With less room than `below` (the least such row holds) it begins so many pages,
    the last of which has spent so much at its end; with more room than any row has, all of it joins the open page."""

    def of_range(part: int, sizes: np.ndarray) -> pa.RecordBatch:
        count = len(sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(count)
        follows = np.maximum(np.searchsorted(edges[1:], edges[:-1] + budget, "right"), place + 1)
        last, pages = np.where(follows < count, follows, place), np.ones(count, np.int64) + (follows < count)
        while (further := last[last] != last).any():  # by doubling
            pages += np.where(further, pages[last] - 1, 0)
            last = last[last]
        entries = min(int(np.searchsorted(edges[1:], budget, "right")), count - 1) + 1  # places where the first page may begin
        last, pages = last[:entries], pages[:entries]
        ends = np.flatnonzero(np.append((last[1:] != last[:-1]) | (pages[1:] != pages[:-1]), True))
        columns = [np.full(len(ends), part, np.int32), edges[ends + 1], pages[ends], edges[-1] - edges[last[ends]]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "below", "pages", "spent"])

    def steps(batches):
        part, held = None, []
        for batch in batches:
            parts, sizes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.diff(parts)) + 1
            for own, some in zip(np.split(parts, cuts), np.split(sizes, cuts)):
                if len(own) and own[0] != part:
                    if held:
                        yield of_range(part, np.concatenate(held))
                    part, held = int(own[0]), []
                held.append(some.copy())
        if held:
            yield of_range(part, np.concatenate(held))

    return steps


def _open_pages(steps: DataFrame, parts: list, budget: int) -> dict[int, tuple[int, int]]:
    """For each range the bytes and the number of the page that is open before it (before the first: a full one, -1).

    Few steps come to the driver at once: those of several ranges together, or of a longer range the one that applies."""
    counts = {r["part"]: r["count"] for r in steps.groupBy("part").count().collect()}
    order, known = [part["part"] for part in parts], {}
    found, spent, page = {}, budget + 1, -1
    for k, part in enumerate(parts):
        at, room = part["part"], budget - spent
        found[at] = (spent, page)
        if counts[at] > STEPS:
            most = [steps.filter((F.col("part") == at) & (F.col("below") > room)).agg(F.min(F.struct("below", "pages", "spent")).alias("s")).first()["s"]]
            rows = [r for r in most if r is not None]
        else:
            if at not in known:
                known, total = {}, 0
                for p in order[k:]:
                    if (total := total + counts[p]) > STEPS:
                        break
                    known[p] = []
                for r in steps.filter(F.col("part").between(at, max(known))).collect():
                    known[r["part"]].append(r)
            rows = [r for r in known[at] if r["below"] > room]
        if rows:
            step = min(rows, key=lambda r: r["below"])
            page, spent = page + step["pages"], step["spent"]
        else:
            spent += part["bytes"]
    return found


def pages(changes: DataFrame, budget: int = PAGE_BYTES, hlc: str = "hlc_timestamp", record=None) -> DataFrame:
    """All pages of a feed: changes with a page number.

    A page's end depends on all pages before it. So each range of transactions first tells, for every place where its
    first page may begin, how many pages it begins and what the last one has spent; the driver follows these from range
    to range, and then each range numbers its own transactions, which the changes are joined with. The driver holds a row
    for each range and STEPS steps, however many transactions and pages there are.
    """
    dealt, parts = _dealt(group_sizes(changes, hlc, record))
    if not parts:
        return changes.withColumn("page", F.lit(0))
    # Empty ranges have no row; whole ranges, in order, to a task.
    ordered = dealt.repartition(len(parts), "part").sortWithinPartitions("part", "key", "hlc")
    stage = staging(changes.sparkSession)
    before = _open_pages(stage("page-steps", ordered.select("part", "bytes").mapInArrow(_steps(budget), "part int, below long, pages long, spent long")), parts, budget)

    def numbered(batches):
        own = None
        for batch in batches:
            out = []
            for part, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != own:
                    own, (spent, page) = part, before[part]
                if spent + size > budget:
                    spent, page = 0, page + 1
                spent += size
                out.append(page)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.int32())], ["__hlc", "__page"])

    # A merge join, so no table of transactions goes through the driver.
    marks = stage("page-marks", ordered.select("part", "bytes", "hlc").mapInArrow(numbered, "__hlc string, __page int"))
    joined = changes.join(marks.hint("merge"), F.col(hlc).eqNullSafe(F.col("__hlc")))
    return joined.withColumn("page", F.col("__page")).drop("__hlc", "__page")
