"""Change feeds in files: JSON lines as on the wire, or Parquet with the sort key beside the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelake.functions.codec import change_json, parse_change
from mergelake.functions.hlc import hlc_key
from mergelake.operators.schema import CHANGE


def write_json_feed(changes: DataFrame, path: str) -> None:
    changes.select(change_json().alias("value")).write.text(path)


def read_json_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(parse_change(F.col("value")).alias("c")).select("c.*")


def write_feed(changes: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet in clock order by range, so a cursor on hlc_key skips files and row groups."""
    keyed = changes.withColumn("hlc_key", hlc_key("hlc_timestamp"))
    ranged = keyed.repartitionByRange(*([partitions] if partitions else []), "hlc_key")
    ranged.sortWithinPartitions("hlc_key").write.mode("append").parquet(path)


def read_feed(spark: SparkSession, path: str, after_hlc: str | None = None) -> DataFrame:
    """Changes newer than the cursor; the comparison is pushed to the scan."""
    feed = spark.read.schema(f"{', '.join(f'{f.name} string' for f in CHANGE.fields)}, hlc_key string").parquet(path)
    if after_hlc is not None:
        feed = feed.filter(F.col("hlc_key") > spark.range(1).select(hlc_key(F.lit(after_hlc))).first()[0])
    return feed.drop("hlc_key")
