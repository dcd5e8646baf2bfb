"""Values and keys as JSON text, hexadecimal BLOB tags, canonical JSON, signature preimages, sizes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the key of an object that stands for bytes.
BLOB_TAG = "$blob_hex"


def encode_hex(b: Column | str) -> Column:
    return F.lower(F.hex(b))


def decode_hex(text: Column) -> Column:
    """Bytes of lower-case hex digits of even number; null for anything else."""
    return F.when(text.rlike("^([0-9a-f]{2})*$"), F.unhex(text))


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    return F.substring(whole := F.to_json(F.array(text)), F.lit(2), F.length(whole) - 2)


def encode_value(c: Column | str, kind: T.DataType) -> Column:
    """JSON text of a stored value: NULL is null, booleans are 0 and 1, bytes are tagged, numbers that aren't finite are 0."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(kind, T.BinaryType):
        text = F.concat(F.lit('{"' + BLOB_TAG + '":"'), encode_hex(c), F.lit('"}'))
    elif isinstance(kind, T.BooleanType):
        text = c.cast("int").cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
        text = F.when(finite, F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)).when(c.isNotNull(), "0")
    elif isinstance(kind, (T.IntegralType, T.DecimalType)):
        text = c.cast("string")
    elif isinstance(kind, T.StringType):
        text = json_string(c)
    else:  # what the wire has no form for goes as text
        text = json_string(F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string"))
    return F.coalesce(text, F.lit("null"))


def blob_of(text: Column) -> Column:
    """Bytes of a JSON text that is exactly one tagged object; null otherwise."""
    pattern = r'^\s*\{\s*"\$blob_hex"\s*:\s*"((?:[0-9a-f]{2})*)"\s*\}\s*$'
    return F.when(text.rlike(pattern), F.unhex(F.regexp_extract(text, pattern, 1)))


def is_blob(text: Column) -> Column:
    return text.rlike(r'^\s*\{\s*"\$blob_hex"\s*:[^,]*\}\s*$')


def decode_value(text: Column, kind: T.DataType) -> Column:
    """Stored value of a JSON text, by the declared type; null where it doesn't fit. Objects and arrays are kept as text."""
    plain = F.when(text != "null", F.when(text.rlike(r'^\s*"'), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]).when(text == "true", "1").when(text == "false", "0").otherwise(text))
    if isinstance(kind, T.BinaryType):
        return F.when(is_blob(text), blob_of(text))
    return plain if isinstance(kind, T.StringType) else plain.try_cast(kind)


def decodes(text: Column, kind: T.DataType) -> Column:
    """Whether a JSON text is null or has a value of the type."""
    return (text == "null") | decode_value(text, kind).isNotNull()


def pk_json(columns: list[tuple[str, T.DataType]], prefix: str = "") -> Column:
    """Canonical key: a compact object, keys in the given (declaration) order."""
    parts: list[Column] = []
    for k, (name, kind) in enumerate(columns):
        parts += [F.lit(("," if k else "{") + json.dumps(name, ensure_ascii=False) + ":"), encode_value(F.col(f"{prefix}`{name}`"), kind)]
    return F.concat(*parts, F.lit("}"))


def _key_texts(text: Column, columns: list[tuple[str, T.DataType]]) -> Column:
    """JSON texts of the key columns as a struct k0, k1, ...; null unless the text is an object of exactly these keys.

    One value: put it in a column of its own, so that the text is parsed once however often its parts are used.
    """
    values = F.from_json(text, "map<string,variant>")
    names = F.array(*[F.lit(n) for n in sorted(n for n, _ in columns)])
    whole = F.transform(
        F.filter(F.array(values), lambda v: F.array_sort(F.map_keys(v)) == names), lambda v: F.struct(*[F.coalesce(F.to_json(v[n]), F.lit("null")).alias(f"k{k}") for k, (n, _) in enumerate(columns)])
    )
    return F.get(whole, 0)


def canonical_pk(text: Column, columns: list[tuple[str, T.DataType]]) -> Column:
    """pk_json from JSON text with its keys in whatever order; null unless it is an object of exactly these keys whose values fit."""
    parts: list[Column] = []

    def joined(own: Column) -> Column:
        ok = F.lit(True)
        for k, (name, kind) in enumerate(columns):
            ok = ok & decodes(own[f"k{k}"], kind)
            parts.extend([F.lit(("," if k else "{") + json.dumps(name, ensure_ascii=False) + ":"), encode_value(decode_value(own[f"k{k}"], kind), kind)])
        return F.when(ok, F.concat(*parts, F.lit("}")))

    return F.get(F.transform(F.filter(F.array(_key_texts(text, columns)), lambda t: t.isNotNull()), joined), 0)


@F.pandas_udf(T.StringType())
def _sorted_json(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)


def canonical_json(text: Column) -> Column:
    """JSON with object keys sorted at every depth. Scalars, which most values are, stay in the JVM."""
    return F.when(text.rlike(r"^\s*[\[{]") & ~is_blob(text), _sorted_json(text)).otherwise(F.trim(text))


def _prefixed(part: Column) -> Column:
    data = part.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data)


def preimage(table: Column, row_pks: Column, column: Column, hlc: Column, value: Column) -> Column:
    """What is signed: five parts, each after its length in four big-endian bytes; the value as canonical JSON."""
    return F.concat(*[_prefixed(p) for p in (table, row_pks, column, hlc, canonical_json(value))])


def scalar_preimage(table: Column, row_pks: Column, column: Column, hlc: Column, value: Column) -> Column:
    """preimage for values known to be scalars or tagged bytes; no Python."""
    return F.concat(*[_prefixed(p) for p in (table, row_pks, column, hlc, F.trim(value))])


def legacy_preimage(table: Column, row_pks: Column, column: Column, hlc: Column, value: Column) -> Column:
    """The older preimage, with bytes as base64 strings in value and key; null where neither holds bytes."""
    quoted = lambda b: F.concat(F.lit('"'), F.base64(b), F.lit('"'))
    tags = F.regexp_extract_all(row_pks, F.lit(r'\{"\$blob_hex":"(?:[0-9a-f]{2})*"\}'), 0)
    old_pks = F.aggregate(tags, row_pks, lambda acc, tag: F.replace(acc, tag, quoted(F.unhex(F.regexp_extract(tag, '"([0-9a-f]*)"}$', 1)))))
    old_value = F.coalesce(quoted(blob_of(value)), value)
    return F.when((F.size(tags) > 0) | blob_of(value).isNotNull(), preimage(table, old_pks, column, hlc, old_value))


def parameter_bytes(c: Column | str, kind: T.DataType) -> Column:
    """Bytes that a written value counts with: text and bytes their length, numbers 8, NULL 0."""
    c = F.col(c) if isinstance(c, str) else c
    size = F.octet_length(c).cast("long") if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(8).cast("long")
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(size)


def change_json(table="table_name", row_pks="row_pks", column="column_name", hlc="hlc_timestamp", value="value", device="device_id", sig="sig") -> Column:
    """A change record on the wire: camel-case names, value raw, sig raw and only if present."""
    name = lambda n, c: F.concat(F.lit(f'"{n}":'), json_string(F.col(c)))
    head = [name("tableName", table), name("rowPks", row_pks), name("columnName", column), name("hlcTimestamp", hlc), F.concat(F.lit('"value":'), F.coalesce(F.col(value), F.lit("null"))), name("deviceId", device)]
    return F.concat(F.lit("{"), F.concat_ws(",", *head, F.concat(F.lit('"sig":'), F.col(sig))), F.lit("}"))


def parse_change(text: Column) -> Column:
    """A struct of the seven fields from a wire record. value and sig are JSON text."""
    value = F.try_parse_json(text)
    field = lambda n: F.try_variant_get(value, f"$.{n}", "string")
    raw = lambda n: F.to_json(F.try_variant_get(value, f"$.{n}", "variant"))
    names = ["tableName", "rowPks", "columnName", "hlcTimestamp", "deviceId"]
    table, pks, column, hlc, device = (field(n) for n in names)
    return F.struct(table.alias("table_name"), pks.alias("row_pks"), column.alias("column_name"), hlc.alias("hlc_timestamp"), F.coalesce(raw("value"), F.lit("null")).alias("value"), device.alias("device_id"), raw("sig").alias("sig"))
