"""Line dedup: levelled sorted runs of line hashes, compacted periodically, merge-anti-joined by each new batch."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelake.llm.common import discard, fresh_path, partitions, staged, text_or_empty

#: The white space that ends of lines lose, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Dropped keys that may be broadcast (about 60 bytes each); beyond, the lines are sort-merge joined.
BROADCAST_KEYS = 250_000


def line_key(line: Column) -> Column:
    """Stripped, A-Z lower-cased. lower() is the same as that on ASCII text, and faster."""
    line = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


class Run(NamedTuple):
    table: str
    path: str


class LineRuns:
    """Runs of (hash, n, holder): tables bucketed by hash and sorted by it within each bucket. n documents of a batch hold
    the line; holder is the largest doc_id, and stands only in the run of the first batch that held the line.

    Batches come in descending order of doc_id, so the largest holder of a line is known with the first batch that has
    it: a batch is merge-joined with each run, its lines that no run knows are fresh and keep their holder for good, those
    that a run knows only add to the count. As runs and batches are dealt by the same hash, a run is read where it lies:
    neither a batch's lookup nor the merging of two runs shuffles older runs again. A level that has `fanout` runs is
    compacted into one run of the next level. An empty batch is an empty run; a null holder (a batch of null doc_ids) is
    kept as unknown until a later batch names one.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets, self.stale = partitions(spark), []

    def _write(self, df: DataFrame) -> Run:
        path = fresh_path(self.spark, "line-run")
        run = Run(path.rpartition("/")[2].replace("-", "_"), path)
        df.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(run.table)
        return run

    def _drop(self, runs: list[Run]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")
            discard(self.spark, run.path)

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def _merged(self, runs: list[Run]) -> DataFrame:
        """One row for each line: counts add up, and of its rows at most one names the holder. Merge joins of two runs at a
        time, not a union: Spark 4.1 takes a union of bucketed scans for dealt by hash, but reads them one after the other."""

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            joined = a.join(b.select("hash", F.col("n").alias("more"), F.col("holder").alias("other")), "hash", "full_outer")
            zero = F.lit(0).cast("long")
            return joined.select("hash", (F.coalesce("n", zero) + F.coalesce("more", zero)).alias("n"), F.coalesce("holder", "other").alias("holder"))

        return reduce(both, [self.spark.table(r.table) for r in runs])

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch of (doc_id, hash), a line once for each document; returns its run, in which fresh lines have a holder."""
        own = batch.groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        known = F.lit(False)
        for k, run in enumerate(self.runs()):
            own = own.join(self.spark.table(run.table).filter("holder IS NOT NULL").select("hash", F.lit(True).alias(f"known_{k}")), "hash", "left")
            known = known | F.col(f"known_{k}").isNotNull()
        run = self._write(own.select("hash", "n", F.when(~known, F.col("holder")).alias("holder")))
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            full = self.levels[level]
            self.levels[level + 1].append(self._write(self._merged(full)))
            self.levels[level] = []
            # The caller may still read the newest run, which add() returns; it goes with drop().
            self._drop([r for r in full if r != run])
            self.stale += [r for r in full if r == run]
            level += 1
        return self.spark.table(run.table)

    def state(self) -> DataFrame:
        return self._merged(self.runs())

    def drop(self) -> None:
        """Remove the runs; frames read from them are void."""
        self._drop(self.runs() + self.stale)
        self.levels, self.stale = [[]], []


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text, and the columns of docs named in `carry`.

    Lines whose key has min_chars code points and is held by min_docs documents stay only in the largest doc_id that
    holds it. Keys are compared by 128-bit hash. Three things are shuffled: a hash once for each document that holds it
    (pre-aggregated, so a line that a third of all documents hold is a row for each task), positions of dropped lines,
    and each text once to meet them.

    A null or empty text is one empty line. A null doc_id holds lines like any other but is never the largest; rows that
    repeat a doc_id are one document when holders are counted by their own lines, each row counting once, and all of them
    keep what their doc_id holds. A document may lose all its lines; its kept_text is then empty. A very long text is a row
    with an array of its lines, cut in linear time; a line may be as long as its text. An empty table gives an empty
    result; other columns aren't read unless carried.
    """
    spark = docs.sparkSession
    whole = docs.select("doc_id", text_or_empty().alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("carried"))
    docs = whole.select("doc_id", "text")
    lines = F.split("text", "\n", -1)
    bounds = [] if batches < 2 else (docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] or [])
    batch = sum(((F.col("doc_id") <= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    keyed = F.transform(lines, lambda x: F.when(F.char_length(key := line_key(x)) >= min_chars, F.md5(key)))
    held = docs.select("doc_id", F.coalesce(batch, F.lit(len(bounds))).alias("batch"), F.explode(F.array_distinct(F.array_compact(keyed))).alias("hash"))
    held = held.select("doc_id", F.unhex("hash").alias("hash"), "batch")
    held.write.partitionBy("batch").parquet(path := fresh_path(spark, "line-hashes"))
    held = spark.read.schema("doc_id long, hash binary, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    for k in range(len(bounds) + 1):
        runs.add(held.filter(F.col("batch") == k).select("doc_id", "hash"))
    common = staged(runs.state().filter(F.col("n") >= min_docs).select("hash", "holder"), "line-common")
    runs.drop()
    discard(spark, path)

    each = docs.select("doc_id", F.xxhash64("text").alias("of_text"), F.posexplode(lines).alias("at", "line")).select("doc_id", "of_text", "at", line_key(F.col("line")).alias("key"))
    each = each.filter(F.char_length("key") >= min_chars).select("doc_id", "of_text", "at", F.unhex(F.md5("key")).alias("hash"))
    met = F.broadcast(common) if common.count() <= BROADCAST_KEYS else common
    dropped = each.join(met, "hash").filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    dropped = dropped.groupBy("doc_id", "of_text").agg(F.array_sort(F.collect_set("at")).alias("dropped"))

    joined = whole.join(dropped.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("of_text")), "left").withColumn("lines", lines)
    total = F.size("lines")
    gone = F.coalesce(F.col("dropped"), F.array().cast("array<int>"))
    # What lies between dropped positions stays; slices, so a text of many lines takes linear time.
    spans = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(total)), lambda a, b: F.struct((a + 2).alias("from"), (b - a - 1).alias("n")))
    kept = F.flatten(F.transform(spans, lambda s: F.slice("lines", s["from"], s["n"])))
    kept_text = F.when(F.size(gone) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("doc_id", total.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept_text.alias("kept_text"), *(F.col("carried")[c].alias(c) for c in carry))
