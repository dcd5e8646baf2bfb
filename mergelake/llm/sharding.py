"""Sharding by minimax contiguous partition of ordered atomic groups, exact at any size with bounded driver memory.

Groups of equal texts are ordered by a 64-bit hash of the text. The driver sees their sizes as sums over hash ranges
("units"): 2^14 at first, and finer only where a cut could fall. It binary-searches the smallest capacity with which a
greedy walk needs no more than the given number of shards, once with coarse units divisible at will (a lower bound) and
once with them whole (an upper bound), and refines the units that the two walks cut until both bounds meet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelake.llm.common import checkpointed, staged, text_or_empty

FIRST_BITS, MORE_BITS = 14, 8
#: Units on either side of one that a walk cuts, refined along with it.
NEAR = 2
#: Rows of the (partition, shard) table that may be broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Unit:
    """Groups whose hash, shifted right by `shift`, is `prefix`."""

    prefix: int
    shift: int
    size: int
    groups: int

    @property
    def start(self) -> int:
        return self.prefix << self.shift

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or not self.shift


class Walks:
    """Greedy walks over ordered units; `cut` gathers the divisible units that they cut."""

    def __init__(self, units: list[Unit]):
        self.units, self.edges = units, [0, *accumulate(u.size for u in units)]
        self.total, self.cut = self.edges[-1], set()

    def floor(self, x: int) -> int:
        at = bisect_right(self.edges, x) - 1
        if at < len(self.units) and self.edges[at] < x and not self.units[at].atomic:
            self.cut.add(at)
        return self.edges[at]

    def ceil(self, x: int) -> int:
        at = bisect_left(self.edges, x)
        if at and self.edges[at] > x and not self.units[at - 1].atomic:
            self.cut.add(at - 1)
        return self.edges[at] if at < len(self.edges) else self.total

    def fits(self, capacity: int, shards: int, divisible: bool) -> bool:
        at = 0
        for _ in range(shards):
            if at >= self.total:
                break
            k = bisect_right(self.edges, at + capacity) - 1
            to = self.edges[k]
            if k < len(self.units) and not self.units[k].atomic:
                if divisible:
                    to = at + capacity
                elif to < at + capacity:
                    self.cut.add(k)
            if to <= at:
                return False
            at = to
        return at >= self.total

    def smallest(self, shards: int, divisible: bool) -> int:
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, shards, divisible) else (mid + 1, high)
        return low

    def divisible_cuts(self, capacity: int, shards: int) -> set[int]:
        """The divisible units in which the walk with divisible units ends a shard."""
        at, found = 0, set()
        for _ in range(shards):
            if at >= self.total:
                break
            k = bisect_right(self.edges, at + capacity) - 1
            to = self.edges[k]
            if k < len(self.units) and not self.units[k].atomic and to < at + capacity:
                found.add(k)
                to = at + capacity
            at = to
        return found

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Positions where shards begin: each as near an even share of what is left as the capacity lets the rest fit."""
        least = [self.total] * (shards + 1)
        for j in range(shards - 1, 0, -1):
            least[j] = self.ceil(max(0, least[j + 1] - capacity))
        at, out = 0, []
        large = [(self.edges[k], u.size) for k, u in enumerate(self.units) if u.size * shards > self.total]  # these get shards of their own
        for j in range(1, shards):
            ahead = [size for start, size in large if start >= at]
            even = at + (self.total - at - sum(ahead)) // max(1, shards - j + 1 - len(ahead))
            below, above = self.floor(even), self.ceil(even)
            to = below if at < below and even - below <= above - even else above
            if to > at + capacity:
                to = self.floor(at + capacity)
            at = max(at, to, least[j])
            out.append(at)
        return out


def minimax_cuts(first: list[Unit], shards: int, refine) -> tuple[list[int], int]:
    """Hashes at which shards 1, 2, ... begin, and the smallest feasible capacity. refine(units) gives the finer units of each."""
    units = sorted(first, key=lambda u: u.start)
    while True:
        walks = Walks(units)
        low = walks.smallest(shards, divisible=True)
        cut = walks.divisible_cuts(low, shards)
        if not cut:
            walks.cut = set()
            positions = walks.cuts(low, shards)
            cut = walks.cut
            if not cut:
                starts = {walks.edges[k]: u.start for k, u in enumerate(units)}
                return [starts[p] for p in positions if p < walks.total], low
        near = {k for c in cut for k in range(max(0, c - NEAR), min(len(units), c + NEAR + 1)) if not units[k].atomic}
        finer = refine([units[k] for k in sorted(near)])
        units = sorted([u for k, u in enumerate(units) if k not in near] + finer, key=lambda u: u.start)


def minimax_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Each document's shard under the law `bytes`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus one (null: one). Equal texts share a shard. No shard is larger than the smallest
    feasible capacity for the groups in hash order; within it, shards are cut near even shares of what is left, so a
    group larger than an even share stands (nearly) alone and the others stay even. slot counts from 0 in each shard
    without gaps: it is the row's place in its partition of a reliable checkpoint plus what earlier partitions hold, so
    no task gathers a shard. Null doc_ids and repeated rows get slots of their own; an empty table gives an empty
    result; columns besides doc_id and text aren't read.
    """
    text = text_or_empty()
    rows = staged(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash")), "shard-rows")
    groups = staged(rows.groupBy("hash").agg(F.sum("size").alias("size")), "shard-groups")

    def units(df: DataFrame, shift: int) -> list[Unit]:
        sums = df.groupBy(F.shiftright("hash", shift).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"))
        # One job: 2^14 rows at first, later 2^8 for each unit near a cut. Taken partition by partition, each would be a job of its own.
        return [Unit(r["prefix"], shift, r["size"], r["groups"]) for r in sums.collect()]

    def refine(coarse: list[Unit]) -> list[Unit]:
        out = []
        for shift in {u.shift for u in coarse}:
            own = groups.filter(F.shiftright("hash", shift).isin([u.prefix for u in coarse if u.shift == shift]))
            out += units(own, max(0, shift - MORE_BITS))
        return out

    starts, _ = minimax_cuts(units(groups, 64 - FIRST_BITS), shards, refine)
    shard = sum(((F.col("hash") >= F.lit(s)).cast("int") for s in starts), F.lit(0))
    placed = checkpointed(rows.withColumn("shard", shard).drop("hash").sortWithinPartitions("shard"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumns({"part": F.spark_partition_id(), "place": place})
    counts = placed.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    counts = counts.select("part", "shard", (before - F.col("first")).alias("shift"))
    if placed.rdd.getNumPartitions() * shards <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    return placed.join(counts, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
