"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what survives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelake.llm.common import staged, text_or_empty

#: Bytes of text that the second level hashes.
PREFIX_BYTES = 256
#: Groups that may be broadcast to the scan (about 60 bytes each); more are sort-merge joined. The rows hashed are the same.
BROADCAST_GROUPS = 250_000


def _marked(rows: DataFrame, groups: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """rows with a column that says whether their keys are among the groups."""
    groups = groups.withColumn(mark, F.lit(True))
    return rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, keys, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def exact_dedup(docs: DataFrame, digest: bool = False, level: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept; with `digest` also text_sha256 of every row, with `level`
    the level that decided it: 1 if no other text is as long, 2 if none of its length has its prefix, else 3.

    First lengths are counted. Prefixes are hashed only where a length repeats, full texts only where length and prefix
    hash repeat (`digest` asks for all rows' hashes, but groups are still formed of the survivors'). Each level shuffles
    pre-aggregated counts and marks the next level's rows in the scan, so texts aren't shuffled unless a level leaves more
    than BROADCAST_GROUPS groups. A hot group of copies is one pre-aggregated row; joining it back is a sort-merge join
    that adaptive execution splits.

    Of equal texts the row with the largest doc_id stays. A null text counts as the empty one; a very long text is read
    like any other. A null doc_id never beats another; where all are null, they stay. Repeated rows (same doc_id and text)
    count each in group_size, and those that bear keep_id are all kept, as nothing tells them apart. An empty table gives
    an empty result. Columns besides doc_id and text aren't read.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", F.octet_length(text).alias("length"), text.alias("text"))

    lengths = staged(rows.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length"), "dedup-lengths")
    # Without a repeated length there is no prefix, so nothing is hashed for it.
    rows = _marked(rows, lengths, ["length"], "same_length").withColumn("prefix", F.when(F.col("same_length"), F.xxhash64(F.substring(F.col("text").cast("binary"), 1, PREFIX_BYTES))))

    prefixes = staged(rows.filter("same_length").groupBy("length", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("length", "prefix"), "dedup-prefixes")
    rows = _marked(rows, prefixes, ["length", "prefix"], "same_prefix")

    full = F.sha2(F.col("text").cast("binary"), 256)
    own = F.when(F.col("same_prefix"), 3).when(F.col("same_length"), 2).otherwise(1).alias("level")
    extra = ([full.alias("text_sha256")] if digest else []) + ([own] if level else [])
    rows = staged(rows.select("doc_id", "length", F.when(F.col("same_prefix"), full).alias("full"), *extra), "dedup-rows")

    groups = staged(rows.filter("full IS NOT NULL").groupBy("length", "full").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-full")
    grouped = rows.filter("full IS NOT NULL").join(groups, ["length", "full"])
    alone = rows.filter("full IS NULL").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *(["text_sha256"] if digest else []), *(["level"] if level else [])]
    return grouped.select(*out).unionByName(alone.select(*out))
