"""Hybrid logical clock strings `<decimal time>/<hex node>` as Columns.

Order is numeric on the time, then on the node. Both parts that don't parse count as 0, each on its own; so an empty
string is the oldest of all. hlc_key maps the order onto plain string order: twenty digits of time, then thirty-two hex
digits of node. Stored beside the text, a comparison with it reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest times and nodes, the clock's counter bits, the drift that is tolerated (seconds), nanoseconds of a day.
MAX_TIME = "18446744073709551615"
COUNTER_BITS = 4
MAX_DRIFT_SECONDS = 12 * 3600
NANOSECONDS_PER_DAY = 86_400_000_000_000
OLDEST = "0" * 52


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hlc_time_text(h: Column | str) -> Column:
    """Twenty digits of the time; 0 where it doesn't parse or exceeds 64 bits."""
    digits = F.regexp_extract(F.substring_index(_col(h), "/", 1), r"^\+?0*([0-9]*)$", 1)
    padded = F.lpad(digits, 20, "0")
    return F.when((F.length(digits) <= 20) & (padded <= MAX_TIME), padded).otherwise("0" * 20)


def hlc_time(h: Column | str) -> Column:
    """The time as DECIMAL(20,0)."""
    return hlc_time_text(h).cast("decimal(20,0)")


def node_suffix(h: Column | str) -> Column:
    """What follows the first slash; null without one."""
    h = _col(h)
    return F.when(F.instr(h, "/") > 0, F.regexp_extract(h, r"(?s)^[^/]*/(.*)$", 1))


def node_hex(suffix: Column | str) -> Column:
    """Thirty-two lower-case hex digits of a node; null where it doesn't parse to 128 bits."""
    suffix = _col(suffix)
    digits = F.lower(F.regexp_extract(suffix, r"^\+?0*([0-9a-fA-F]*)$", 1))
    return F.when(suffix.rlike(r"^\+?[0-9a-fA-F]+$") & (F.length(digits) <= 32), F.lpad(digits, 32, "0"))


def hlc_key(h: Column | str) -> Column:
    """Sort key of a clock string: comparing keys as strings compares clocks. Null for null."""
    node = F.coalesce(node_hex(node_suffix(h)), F.lit("0" * 32))
    return F.when(_col(h).isNotNull(), F.concat(hlc_time_text(h), node))


def hlc_compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1."""
    x, y = hlc_key(a), hlc_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def is_newer(a: Column | str, b: Column | str) -> Column:
    """Strictly newer; equal clocks, however spelled, are not."""
    return hlc_key(a) > hlc_key(b)


def hlc_max(h: str) -> Column:
    """Aggregate: the newest clock; of equal ones the last spelling in text order."""
    return F.max(F.struct(hlc_key(h).alias("key"), F.col(h).alias("hlc")))["hlc"]


def hlc_min(h: str) -> Column:
    """Aggregate: the oldest clock; of equal ones the first spelling in text order."""
    return F.min(F.struct(hlc_key(h).alias("key"), F.col(h).alias("hlc")))["hlc"]


def node_of_uuid(uuid: Column | str) -> Column:
    """Node of a device: its UUID's sixteen bytes read little-endian, as node_hex spells it; null for what is no UUID."""
    digits = F.lower(F.regexp_replace(_col(uuid), "[{}-]", ""))
    swapped = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), 1)), "")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), swapped)


def is_from_node(h: Column | str, node: Column) -> Column:
    """Whether the clock was drawn by a node (as node_hex spells it); false where malformed."""
    return F.coalesce(node_hex(node_suffix(h)) == node, F.lit(False))


def is_complete(h: Column | str) -> Column:
    """Whether the clock has the full shape: time within 64 bits, node without leading zero, not zero, within 128 bits."""
    h = _col(h)
    digits = F.regexp_extract(h, r"^0*([0-9]+)/", 1)
    return h.rlike(r"^[0-9]+/[1-9a-f][0-9a-f]{0,31}$") & (F.length(digits) <= 20) & (F.lpad(digits, 20, "0") <= MAX_TIME)


def drift_seconds(h: Column | str, now: int) -> Column:
    """Seconds by which a complete clock is ahead of `now` (32.32 fixed point, counter bits masked); null if it isn't, or is malformed."""
    masked = now >> COUNTER_BITS << COUNTER_BITS
    ahead = hlc_time(h) - F.lit(masked).cast("decimal(20,0)")
    return F.when(is_complete(h) & (ahead > 0), ahead.cast("double") / float(1 << 32))


def delete_shadows_insert(deleted: Column | str, inserted: Column | str) -> Column:
    """A delete wins ties."""
    return hlc_key(deleted) >= hlc_key(inserted)


def delete_propagates(deleted: Column | str, row: Column | str) -> Column:
    """Whether a tombstone removes a row; one without a clock is the oldest."""
    return F.coalesce(hlc_key(row), F.lit(OLDEST)) <= hlc_key(deleted)


def retention_cutoff(now: int | None, days: int, units_per_day: int = NANOSECONDS_PER_DAY) -> int | None:
    """Times below it are prunable; none without a clock or beyond signed 64 bits. The subtraction saturates at 0."""
    if now is None:
        return None
    cutoff = max(0, now - min(days * units_per_day, (1 << 64) - 1))
    return cutoff if cutoff < 1 << 63 else None


def sqlite_time(h: Column | str) -> Column:
    """Time part as retention reads it: text before the slash, its leading digits; 0 without a slash."""
    h = _col(h)
    return F.when(F.instr(h, "/") > 0, F.coalesce(F.regexp_extract(h, r"^\s*([+-]?[0-9]+)", 1).try_cast("decimal(38,0)"), F.lit(0))).otherwise(F.lit(0)).cast("decimal(38,0)")
