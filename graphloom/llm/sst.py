"""Sorted-string-table shards: documents' token ids keyed by identifier.

A shard is blocks, Bloom filter, index, footer. A block holds entries sorted by key, each as varints of the bytes it
shares with the key before, of its further key bytes and of its value bytes, then those bytes; it is compressed and
ends with its crc32. The sparse index has the first key, place and length of each block; the footer has the places
of index and filter, the number of entries and ids, a crc32 and the magic string. ``Shard.get`` asks the filter, then
finds the block by binary search and reads only that.

Keys are 8 bytes whose order as bytes is the order of the identifiers. A null identifier is the empty key, before all
others. Repeated identifiers keep all their rows, ordered by the crc32 of their ids, then by ids. Rows are dealt out by
ranges of that order, so an identifier, or none, that holds many rows takes several ranges.

Defined results: a null or empty text has only the end id; a text of any length is one value; extra columns are
ignored, whatever their names; no rows give no shards and no documents. Shards of a task that was lost or repeated are
never listed in the manifest, so they do no harm.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import documents, fresh_path, materialize, per_step, shuffle_partitions

MAGIC = b"GLSST01\n"
_FOOTER = struct.Struct("<QIQIQQI8s")
BLOCK_BYTES = 64 * 1024
#: Documents of a range where the shuffle's parts are too few, and the most ranges; a range writes as many shards as it needs.
RANGE_ROWS = 200_000
MOST_RANGES = 10_000
SHARD_BYTES = 32 * 1024 * 1024
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 7


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else struct.pack(">Q", (identifier + (1 << 63)) & (1 << 64) - 1)


def identifier_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Takes entries in key order and keeps one block in memory."""

    def __init__(self, filesystem: pafs.FileSystem, path: str) -> None:
        self.filesystem, self.path = filesystem, path
        self.out = filesystem.open_output_stream(path)
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.at = self.entries = self.ids = 0
        self.press = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes, ids: int) -> None:
        if not self.block:
            self.first = key
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.last = key
        self.entries += 1
        self.ids += ids
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _end_block(self) -> None:
        if self.block:
            packed = self.press.compress(bytes(self.block))
            self.index.append((self.first, *self._put(packed + struct.pack("<I", zlib.crc32(packed)))))
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys)) + 7 & ~7
        bloom = np.zeros(bits // 8, np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self._put(bloom.tobytes())
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        index_at = self._put(index)
        self._put(_FOOTER.pack(*index_at, *bloom_at, self.entries, self.ids, zlib.crc32(index), MAGIC))
        self.out.close()


class Shard:
    """Reads a shard: ``get`` for one key, ``entries`` for all in order."""

    def __init__(self, path: str) -> None:
        filesystem, at = pafs.FileSystem.from_uri(path)
        self.file = filesystem.open_input_file(at)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.count, self.ids, crc, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        index = self._read(index_at, index_n)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{path} is no whole shard")
        self.bloom = np.frombuffer(self._read(bloom_at, bloom_n), np.uint8)
        self.first: list[bytes] = []
        self.place: list[tuple[int, int]] = []
        i = 0
        while i < len(index):
            n, i = _read_varint(index, i)
            self.first.append(index[i : i + n])
            start, i = _read_varint(index, i + n)
            length, i = _read_varint(index, i)
            self.place.append((start, length))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._read(*self.place[i])
        packed, (crc,) = data[:-4], struct.unpack("<I", data[-4:])
        if zlib.crc32(packed) != crc:
            raise ValueError("a block's checksum is wrong")
        data, at, key = zstandard.ZstdDecompressor().decompress(packed), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            further, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + further]
            yield key, data[at + further : at + further + n]
            at += further + n

    def entries(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.place)):
            yield from self.block(i)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom)))

    def get(self, identifier: int | None) -> list[bytes]:
        """The values of an identifier's rows, in order."""
        key, found = key_of(identifier), []
        if not self.may_have(key):
            return found
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.place) and self.first[i] <= key:
            found += [v for k, v in self.block(i) if k == key]
            i += 1
        return found

    def close(self) -> None:
        self.file.close()


class Ranges:
    """Borders of ranges of (identifier, crc32 of ids); an identifier that is several borders takes that many ranges more."""

    def __init__(self, nulls: int, borders: list[int]) -> None:
        self.nulls, self.borders = nulls, np.array(sorted(borders), np.int64)

    @property
    def count(self) -> int:
        return self.nulls + len(self.borders) + 1

    def of(self, identifier: int | None, crc: int) -> int:
        if identifier is None:
            return crc * (self.nulls + 1) >> 32
        low, high = (int(np.searchsorted(self.borders, identifier, side)) for side in ("left", "right"))
        return self.nulls + low + (crc * (high - low + 1) >> 32 if high - low > 1 else 0)


def ranges_of(docs: DataFrame, least: int) -> Ranges:
    """Borders of ``least`` ranges, or more for many documents, from the identifiers alone."""
    keys = docs.select(F.col("doc_id").cast("bigint").alias("k"))
    counts = keys.agg(F.count("*").alias("rows"), F.count("k").alias("known")).first()
    n = max(least, min(MOST_RANGES, -(-counts["rows"] // RANGE_ROWS)))
    if n < 2 or not counts["rows"]:
        return Ranges(0, [])
    nulls = round((n - 1) * (1 - counts["known"] / counts["rows"]))
    wanted = n - nulls
    known = keys.select(F.col("k").cast("double").alias("k")).where("k is not null")
    found = known.approxQuantile("k", [i / wanted for i in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
    return Ranges(nulls, [max(-(1 << 63), min((1 << 63) - 1, int(b))) for b in found])


def token_rows(docs: DataFrame, path: str, end_id: int, ranges: Ranges | None = None) -> DataFrame:
    """(doc_id, ids as little-endian bytes of the vocabulary's width, their crc32, range), the end id last."""
    ranges = ranges or Ranges(0, [])

    def make():
        encode = tokens.encoder(path)
        end = np.array([end_id], encode.dtype)

        def work(keys: list, texts: list) -> dict:
            ids = [np.concatenate([encode.ids(t), end]).tobytes() for t in texts]
            crc = list(map(zlib.crc32, ids))
            return {"doc_id": keys, "ids": ids, "crc": crc, "part": list(map(ranges.of, keys, crc))}

        return work

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("crc", pa.int64()), ("part", pa.int32())])
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(per_step(make, schema), "doc_id bigint, ids binary, crc bigint, part int")


def write_shards(spark: SparkSession, docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the ids of ``docs`` in identifier order and returns the manifest: one row for each shard.

    Range borders come from the identifiers alone; what is shuffled is ids, not texts. ``rank`` is the shard's
    place in the order, ``before`` the ids of all shards ahead of it.
    """
    path = path or tokens.default_tokenizer()
    width = tokens.encoder(path).dtype.itemsize
    ranges = ranges_of(docs, shuffle_partitions(spark))
    ordered = token_rows(docs, path, end_id, ranges)
    ordered = ordered.repartitionById(ranges.count, "part").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc", "ids").select("doc_id", "ids", "part")
    folder = fresh_path(spark, "shards")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("entries", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, at = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(at, recursive=True)
        writer, seq, rows = None, 0, []

        def close(part: int) -> None:
            writer.close()
            rows.append((f"{folder}/{writer.path.rsplit('/', 1)[1]}", part, seq, writer.entries, writer.ids, writer.at))

        part = 0
        for batch in batches:
            for identifier, value, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part = own
                if writer is None:
                    writer = ShardWriter(filesystem, f"{at}/{part:06d}-{seq:04d}-{uuid4().hex}.sst")
                writer.add(key_of(identifier), value, len(value) // width)
                if writer.at + len(writer.block) >= SHARD_BYTES:
                    close(part)
                    writer, seq = None, seq + 1
        if writer is not None:
            close(part)
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    manifest = materialize(spark, ordered.mapInArrow(run, "path string, part int, seq int, entries bigint, ids bigint, bytes bigint"), "manifest")
    order = W.orderBy("part", "seq")
    return manifest.withColumn("rank", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("ids").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def read_shards(spark: SparkSession, manifest: DataFrame, path: str | None = None) -> DataFrame:
    """Every document of the listed shards: doc_id, start, n_tokens, ids_crc32, all from the files."""
    dtype = tokens.encoder(path or tokens.default_tokenizer()).dtype
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, start in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                shard, rows = Shard(at), []
                for key, value in shard.entries():
                    ids = np.frombuffer(value, dtype)
                    rows.append((identifier_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                shard.close()
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    listed = manifest.select("path", "before").repartition(max(1, shuffle_partitions(spark)), "path")
    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(spark, write_shards(spark, documents(spark, sf_dir)))
