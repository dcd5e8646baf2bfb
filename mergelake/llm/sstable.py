"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse block index, Bloom filter, footer.

File: blocks, then index, Bloom filter and footer. A key is 9 bytes: 0 and zeros for a null doc_id, else 1 and the
doc_id, offset by 2^63, big-endian; so byte order is id order. A block is zstandard-compressed and holds entries
(shared: bytes shared with the previous key, unshared, size of the value: one, one and four bytes; the key's rest;
start: ids in this file before it, eight bytes; the ids). The index holds first key, place and stored size of each
block; the footer the places of index and filter, counts, the width of an id, and the magic.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelake.llm.common import fresh_path, small_batches, staged
from mergelake.llm.units import balanced, encoder, release, tidy

BLOCK_BYTES = 64 << 10
#: Text bytes that a shard takes on average.
SHARD_BYTES = 24 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"MLSST001"
FOOTER = struct.Struct("<QQQQQQQQ8s")
ENTRY, INDEX = struct.Struct("<BBI"), struct.Struct("<9sQI")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Writer:
    """Writes one shard; add() in ascending key order, then close(). The file appears under its name only when whole."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = _filesystem(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.width, self.block, self.held, self.previous, self.first = width, [], 0, b"", b""
        self.index, self.keys, self.tokens = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        if not self.block:
            self.first = key
        shared = 0
        while self.block and shared < 9 and key[shared] == self.previous[shared]:
            shared += 1
        self.block += [ENTRY.pack(shared, 9 - shared, len(ids)), key[shared:], struct.pack("<Q", self.tokens), ids]
        self.held += len(ids)
        self.previous = key
        self.tokens += len(ids) // self.width
        self.keys.append(key)
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            stored = self.compress(b"".join(self.block))
            self.index.append(INDEX.pack(self.first, self.out.tell(), len(stored)))
            self.out.write(stored)
            self.block, self.held = [], 0

    def close(self) -> None:
        self._flush()
        at_index = self.out.tell()
        self.out.write(b"".join(self.index))
        at_bloom, bits = self.out.tell(), max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(packed)
        self.out.write(FOOTER.pack(at_index, len(self.index), at_bloom, len(packed), bits, len(self.keys), self.tokens, self.width, MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)


class Reader:
    """Reads one shard: scan() in key order, get() by binary search over the block index, behind the Bloom filter."""

    def __init__(self, path: str):
        import zstandard

        self.fs, self.path = _filesystem(path)
        self.file = self.fs.open_input_file(self.path)
        end = self.file.size()
        at_index, blocks, at_bloom, bloom, self.bits, self.count, self.tokens, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of this format")
        raw = self.file.read_at(blocks * INDEX.size, at_index)
        self.index = [INDEX.unpack_from(raw, k * INDEX.size) for k in range(blocks)]
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(bloom, at_bloom), np.uint8))
        self.expand = zstandard.ZstdDecompressor().decompress

    def _block(self, k: int) -> Iterator[tuple[bytes, int, memoryview]]:
        _, at, size = self.index[k]
        data = memoryview(self.expand(self.file.read_at(size, at)))
        at, key = 0, b""
        while at < len(data):
            shared, rest, length = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + bytes(data[at : at + rest])
            start = struct.unpack_from("<Q", data, at + rest)[0]
            at += rest + 8
            yield key, start, data[at : at + length]
            at += length

    def _ids(self, value: memoryview) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this file, ids) of all documents."""
        for k in range(len(self.index)):
            for key, start, value in self._block(k):
                yield id_of(key), start, self._ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that identifier."""
        key, found = key_of(doc_id), []
        if not self.bloom[_bloom_places(key, self.bits)].all():
            return found
        low, high = 0, len(self.index)  # the first block that begins at the key or later
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        for k in range(max(0, low - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            found += [self._ids(v) for other, _, v in self._block(k) if other == key]
        return found


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Encode all documents and write shards in ascending doc_id order; returns the manifest (shard, path, n_docs, n_tokens, base).

    Shards are ranges of doc_id between quantiles, so one holds about SHARD_BYTES of text. Texts are encoded where they
    are read; their ids are shuffled once, to the shard's task, sorted there and streamed to the file. base is the number
    of ids in earlier shards.

    A null text is empty (end_id alone). Null doc_ids come first. Rows that repeat a doc_id stay side by side, in order of
    their ids. An empty table gives an empty manifest. Columns besides doc_id and text aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "sstable")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    bounds = [] if shards < 2 else sorted({*(docs.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 100 * shards)).first()[0] or [])})
    shard = _range_of("doc_id", bounds)

    def encoded(batches):
        own = encoder(tokenizer_path)
        kind = np.uint16 if own.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        end = np.asarray([end_id], kind).tobytes()
        for batch in balanced(batches):
            ids = []
            for flat, bounds in own.encode(batch.column(2)):
                few = flat.astype(kind)
                ids += [few[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array([np.dtype(kind).itemsize] * len(ids), pa.int32())], ["shard", "doc_id", "ids", "width"])

    def written(batches):
        release()
        writer, docs_in, own = None, 0, None
        for batch in batches:
            for number, doc_id, ids, width in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if writer is None:
                    own = number
                    writer = Writer(f"{folder}/shard-{number:06d}-{uuid.uuid4().hex[:8]}.sst", width)
                writer.add(doc_id, ids)
                docs_in += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": own, "path": writer.path, "n_docs": docs_in, "n_tokens": writer.tokens}], schema)

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    rows = docs.select(shard.alias("shard"), "doc_id", "text").mapInArrow(encoded, "shard int, doc_id long, ids binary, width int")
    rows = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("doc_id", F.crc32("ids"), "ids")
    manifest = staged(rows.mapInArrow(written, "shard int, path string, n_docs long, n_tokens long"), "sstable-manifest")
    from pyspark.sql import Window

    return manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))


def _range_of(column: str, bounds: list[int]):
    """Number of bounds below the value (null: 0); by halves, so the expression's depth is the logarithm of their number."""

    def part(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) > bounds[mid], part(mid + 1, high)).otherwise(part(low, mid))

    return part(0, len(bounds))


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, as the files have them; a task for each shard."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = ([], [], [], [])
                for doc_id, start, ids in Reader(path).scan():
                    for column, v in zip(rows, (doc_id, base + start, len(ids), zlib.crc32(ids.tobytes()))):
                        column.append(v)
                    if len(rows[0]) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)
                        rows = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    files = manifest.select("path", "base", "shard")
    count = max(1, files.count())
    return files.repartitionById(count, F.col("shard") % count).select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
