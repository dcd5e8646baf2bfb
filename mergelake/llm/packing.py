"""Packing along a space-filling curve: neighbouring documents share sequences, and no sequence but the last is padded."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelake.llm.common import checkpointed, partitions, small_batches, staged
from mergelake.llm.units import balanced, encoder, release, tidy

DIMENSIONS, BITS = 3, 10
#: How far projected means spread before they are squeezed to the cube.
SPREAD = 12.0


def directions(count: int) -> np.ndarray:
    """For each token id a sign in each dimension, from the bits of a mixed id: the hashed vector of a document and its random projection at once."""
    x = np.arange(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x + np.uint64(0x9E3779B97F4A7C15) ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.stack([((x >> np.uint64(40 + d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(DIMENSIONS)], 1)


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of integer points (rows of DIMENSIONS numbers under 2^BITS) on the Hilbert curve, by Skilling's transposition, for all points at once."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    bit = 1 << (BITS - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[:, i] & bit) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    bit = 1 << (BITS - 1)
    while bit > 1:
        turn ^= np.where(x[:, n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, piece_crc: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of `length` ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Each document is encoded once, with end_id after it, and staged with its Hilbert key. Only (key, row, size) is
    range-sorted; running sums within partitions and the partitions' totals (a row for each) give every document's place
    in the one long run of ids, which is cut each `length`. So just the very last sequence needs padding. Places meet ids
    by a unique row number, in a join without hot keys; equal documents have equal keys, but the sort goes on by row.

    A null or empty text is end_id alone. Null doc_ids and repeated rows are packed like others; an empty table gives an
    empty result; columns besides doc_id and text aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def encoded(batches):
        own = encoder(tokenizer_path)
        signs = directions(own.tokenizer.get_vocab_size())
        kind = np.uint16 if len(signs) <= 1 << 16 else np.uint32
        end = np.asarray([end_id], kind)
        for batch in balanced(batches):
            keys, sizes, ids = [], [], []
            for flat, bounds in own.encode(batch.column(2)):
                few = flat.astype(kind)
                count = np.diff(bounds)
                sums = np.zeros((len(count), DIMENSIONS), np.float32)
                for d in range(DIMENSIONS):
                    total = np.concatenate([[0], np.cumsum(signs[:, d][flat], dtype=np.float64)])
                    sums[:, d] = total[bounds[1:]] - total[bounds[:-1]]
                mean = sums / np.maximum(count, 1)[:, None]
                keys.append(hilbert_keys(((np.tanh(mean * SPREAD) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)))
                sizes.append(count + 1)
                ids += [few[a:b].tobytes() + end.tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes), pa.int64()), pa.array(ids, pa.binary())], ["row", "doc_id", "key", "size", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    held = staged(rows.mapInArrow(encoded, "row long, doc_id long, key long, size long, ids binary"), "pack-ids")
    curve = checkpointed(held.select("key", "row", "size").repartitionByRange(partitions(spark), "key", "row").sortWithinPartitions("key", "row"))

    def running(batches):
        at = 0
        for batch in batches:
            size = np.asarray(batch.column(2))
            ends = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - size)], ["part", "row", "within"])
            at = int(ends[-1]) if len(ends) else at

    numbered = curve.select(F.spark_partition_id().alias("part"), "row", "size")
    totals = [(r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect()]
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = spark.createDataFrame(bases, "part int, base long")
    places = numbered.mapInArrow(running, "part int, row long, within long").join(F.broadcast(base), "part").select("row", (F.col("within") + F.col("base")).alias("place"))

    def pieces(batches):
        release()
        for batch in batches:
            out = [[], [], [], [], [], [], []]
            for doc_id, size, ids, place in zip(*(batch.column(i).to_pylist() for i in range(4))):
                width = len(ids) // size
                numbers = np.frombuffer(ids, np.uint16 if width == 2 else np.uint32).astype("<u4")
                start = 0
                while start < size:
                    sequence, offset = divmod(place + start, length)
                    n = min(length - offset, size - start)
                    own = numbers[start : start + n].tobytes()
                    for column, v in zip(out, (doc_id, start, n, zlib.crc32(own) if piece_crc else own, size, sequence, offset)):
                        column.append(v)
                    start += n
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if piece_crc else pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
        tidy()

    names = ["doc_id", "start", "length", "ids_crc32" if piece_crc else "ids", "doc_tokens", "sequence_id", "offset"]
    joined = held.select("row", "doc_id", "size", "ids").join(places, "row").select("doc_id", "size", "ids", "place")
    return joined.mapInArrow(pieces, f"doc_id long, start long, length long, {names[3]} {'long' if piece_crc else 'binary'}, doc_tokens long, sequence_id long, offset long")
