"""Streaming merge: each micro-batch of a feed is one merge; the merged tables are the state, so no watermark is needed.

Without tombstones the result doesn't depend on where micro-batches end; with them it can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mergelake.functions.hlc import hlc_key
from mergelake.operators.schema import CHANGE
from mergelake.plans.policy import ApplyPolicy
from mergelake.sources.store import Store


def read_feed_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(f"{', '.join(f'{f.name} string' for f in CHANGE.fields)}, hlc_key string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).drop("hlc_key")


def apply_stream(store: Store, feed: DataFrame, checkpoint: str, policy: ApplyPolicy | None = None, available_now: bool = True) -> StreamingQuery:
    """Merge a streaming feed. A micro-batch that is replayed after a failure changes nothing: equal clocks lose."""

    def merge(batch: DataFrame, _: int) -> None:
        order = batch.withColumn("input_index", F.monotonically_increasing_id())
        store.apply(order, policy)

    writer = feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_values(feed: DataFrame) -> DataFrame:
    """Stateful register without a store: newest value of each (table, key, column) so far, in update mode."""
    top = F.max(F.struct(hlc_key("hlc_timestamp").alias("key"), "hlc_timestamp", "value"))
    return feed.groupBy("table_name", "row_pks", "column_name").agg(top.alias("top")).select("table_name", "row_pks", "column_name", F.col("top.hlc_timestamp").alias("hlc_timestamp"), F.col("top.value").alias("value"))
