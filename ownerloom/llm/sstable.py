"""Token ids of documents in sorted-string-table files: one file a range of doc_id.

Texts are shuffled once, by ranges of doc_id whose bounds come from a bounded sample of ids (KEY_SAMPLE;
the bounds only balance the files). An id that fills more than one range, null too, is dealt over them by a hash
of the text, so no file holds all of a repeated id's rows by need.

File: data blocks, Bloom filter, sparse block index, footer. A block holds records in key order,
each as (shared prefix length, rest of the key, value length, value), all but lengths raw; a block
begins with a whole key. The index has each block's first key and place. The footer (fixed length)
has the places of filter and index, the numbers of records and ids, the id width, and a magic word.
A key is the doc_id as 9 bytes that sort like the numbers (null first). A value is the ids as
little-endian unsigned integers of 2 bytes if the vocabulary allows, else 4.

Cases: null text is empty (only the end id). Null doc_ids come first. Equal doc_ids are all kept, in
order of a hash of their texts (then of the texts), and a lookup gives them all. Texts of any length are encoded
whole. An empty table gives no file and no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownerloom.llm._common import file_system, scratch, small_batches
from ownerloom.llm.encoding import encoder, vocabulary_path

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQB7x8s")  # filter at, index at, records, ids, filter bits, filter hashes, width, magic
BLOCK_BYTES = 64 * 1024
BLOOM_BITS = 10
#: Ids that are sampled for each range, and at most, to find the ranges' bounds.
SAMPLE_A_RANGE, KEY_SAMPLE = 100, 1_000_000
MANIFEST = "path string, part int, first_key long, last_key long, has_null boolean, n_records long, n_ids long, n_bytes long"


def key_bytes(doc_id: int | None) -> bytes:
    """9 bytes in the order of the numbers, null first."""
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def key_value(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
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


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class TableWriter:
    """Writes one file from records in key order; holds one block, the keys' hashes and the index."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.block_key, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.records = self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.block_key = key
        self.block += _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value)) + value
        if not self.keys or self.last != key:
            self.keys.append(key)
        self.last = key
        self.records += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.index.append((self.block_key, self.at, len(self.block)))
            self.at += len(self.block) + 4
            self.block = bytearray()

    def close(self) -> int:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        filter_ = np.zeros((bits + 7) // 8, "u1")
        for key in self.keys:
            for p in _bloom_places(key, bits, 7):
                filter_[p >> 3] |= 1 << (p & 7)
        filter_at = self.at
        self.out.write(filter_.tobytes())
        index_at = filter_at + len(filter_)
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        self.out.write(index)
        self.out.write(FOOTER.pack(filter_at, index_at, self.records, self.ids, bits, 7, self.width, MAGIC))
        return index_at + len(index) + FOOTER.size


class TableReader:
    """Reads one file: all records in order, or those of one key by binary search of the index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        self.filter_at, self.index_at, self.records, self.ids, self.bits, self.hashes, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table file, or cut short")
        source.seek(self.index_at)
        data, at, self.index = source.read(size - FOOTER.size - self.index_at), 0, []
        while at < len(data):
            n = data[at]
            key = data[at + 1 : at + 1 + n]
            place, length = struct.unpack_from("<QI", data, at + 1 + n)
            self.index.append((key, place, length))
            at += 1 + n + 12
        self.filter: bytes | None = None

    def _block(self, place: int, length: int) -> Iterator[tuple[bytes, bytes]]:
        self.source.seek(place)
        raw = self.source.read(length + 4)
        data = raw[:length]
        if zlib.crc32(data) != struct.unpack("<I", raw[length:])[0]:
            raise ValueError("a block does not match its checksum")
        at, key = 0, b""
        while at < length:
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + n]
            at += n
            n, at = _read_varint(data, at)
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, place, length in self.index:
            yield from self._block(place, length)

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key: filter, binary search for the last block that may begin at or before it, scan."""
        if self.filter is None:
            self.source.seek(self.filter_at)
            self.filter = self.source.read(self.index_at - self.filter_at)
        if not all(self.filter[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits, self.hashes)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.index[mid][0] < key:
                lo = mid + 1
            else:
                hi = mid
        found: list[bytes] = []
        for first, place, length in self.index[max(0, lo - 1) :]:
            if first > key:
                break
            found += [v for k, v in self._block(place, length) if k == key]
        return found

    def numbers(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")


def key_bounds(ids: DataFrame, n: int) -> list[int | None]:
    """n - 1 bounds of ranges of about equal numbers of rows, null first; an id with many rows may stand more than once."""
    total = ids.count()
    share = min(1.0, 2 * min(SAMPLE_A_RANGE * n, KEY_SAMPLE) / max(1, total))
    sample = ids if share == 1.0 else ids.sample(share, seed=9)
    found = sorted((r[0] for r in sample.limit(2 * KEY_SAMPLE).collect()), key=lambda x: (x is not None, x or 0))
    return [found[len(found) * k // n] for k in range(1, n)] if found else []


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows (doc_id, text) with text_hash, in n partitions by ranges of (doc_id, text_hash)."""
    bounds = key_bounds(rows.select("doc_id"), n)
    nulls = sum(b is None for b in bounds)
    known = np.array(bounds[nulls:], np.int64)

    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        empty = ids.is_null().to_numpy(zero_copy_only=False)
        keys = ids.fill_null(0).to_numpy()
        low = np.where(empty, 0, nulls + np.searchsorted(known, keys, "left"))
        high = np.where(empty, nulls, nulls + np.searchsorted(known, keys, "right"))
        share = (hashes.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        return pa.array(np.minimum(low + (share * (high - low + 1)).astype(np.int64), high).astype(np.int32))

    place.__annotations__ = {"ids": pa.Array, "hashes": pa.Array, "return": pa.Array}
    keyed = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.withColumn("part", F.arrow_udf(place, "int")("doc_id", "text_hash")).repartitionById(n, "part")


def write_tables(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, files: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text), append end_id to each, and write one file per range of doc_id (files: how many;
    by default as many as the input has partitions).

    Returns the manifest as a table that Spark has committed: only files of tasks that ended count,
    so a task that is run again leaves a stray file that nobody reads.
    """
    spark = docs.sparkSession

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc = encoder(vocabulary_path(vocabulary))
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        kind, end = f"<u{width}", np.array([end_id], f"<u{width}").tobytes()
        writer = stream = path = part = None
        first = last = None
        has_null = False
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            if not ids:
                continue
            if writer is None:
                part = batch.column(2)[0].as_py()
                path = f"{folder}/part-{part:06d}-{task.taskAttemptId()}.sst"
                fs, inner = file_system(path)
                fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                stream = fs.open_output_stream(inner)
                writer = TableWriter(stream, width)
            for doc_id, text in zip(ids, texts, strict=True):
                packed = enc.encode(text.as_py())
                writer.add(key_bytes(doc_id), (np.frombuffer(packed, "<u4").astype(kind).tobytes() if width == 2 else packed) + end)
                if doc_id is None:
                    has_null = True
                else:
                    first, last = doc_id if first is None else first, doc_id
        if writer is not None:
            n_bytes = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist(
                [{"path": path, "part": part, "first_key": first, "last_key": last, "has_null": has_null, "n_records": writer.records, "n_ids": writer.ids, "n_bytes": n_bytes}],
                schema=pa.schema([("path", pa.string()), ("part", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("has_null", pa.bool_()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = _dealt(rows, files or max(1, docs.rdd.getNumPartitions()))
    manifest = dealt.sortWithinPartitions("doc_id", "text_hash", "text").select("doc_id", "text", "part").mapInArrow(write, MANIFEST)
    with small_batches(spark):
        manifest.write.parquet(f"{folder}/_manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed files with id_base: how many ids stand before each file (a sum over files, not rows)."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("id_base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def scan_tables(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Every record read back: doc_id, start (ids before it), n_tokens, ids_crc32, and ids where asked for."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as source:
                    table, rows = TableReader(source), []
                    for key, value in table:
                        numbers = table.numbers(value)
                        row = {"doc_id": key_value(key), "start": base, "n_tokens": len(numbers), "ids_crc32": zlib.crc32(numbers.tobytes())}
                        rows.append(row | {"ids": numbers.astype("i8")} if with_ids else row)
                        base += len(numbers)
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = 2 * manifest.sparkSession.sparkContext.defaultParallelism
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return manifest.select("path", "id_base").repartition(tasks).mapInArrow(read, kind)


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Ids of the wanted doc_ids (column doc_id of keys): each key goes to the files whose range may hold it,
    and there by filter and index to one block. Workers get the files' names and ranges (one entry a file, no rows)."""
    files = manifest.select("part", "path", "first_key", "last_key", "has_null").orderBy("part").collect()
    with_null = [f["path"] for f in files if f["has_null"]]
    ranged = [f for f in files if f["first_key"] is not None]
    told = keys.sparkSession.sparkContext.broadcast(([f["path"] for f in ranged], np.array([f["first_key"] for f in ranged], np.int64), np.array([f["last_key"] for f in ranged], np.int64)))

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, firsts, lasts = told.value
        for batch in batches:
            ids, where = [], []
            for doc_id in batch.column(0).to_pylist():
                # Ranges are in order and meet at most in their ends.
                hit = with_null if doc_id is None else paths[int(np.searchsorted(lasts, doc_id, "left")) : int(np.searchsorted(firsts, doc_id, "right"))]
                ids += [doc_id] * len(hit)
                where += hit
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(where, pa.string())], names=["doc_id", "path"])

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, source, table = None, None, None
        for batch in batches:
            rows = []
            for doc_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != open_path:
                    fs, inner = file_system(path)
                    source = fs.open_input_file(inner)
                    open_path, table = path, TableReader(source)
                rows += [{"doc_id": doc_id, "ids": table.numbers(v).astype("i8")} for v in table.get(key_bytes(doc_id))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    hits = wanted.mapInArrow(locate, "doc_id long, path string")
    return hits.repartition("path").sortWithinPartitions("path", "doc_id").mapInArrow(find, "doc_id long, ids array<long>")


def op9_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: documents to table files and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_tables(write_tables(docs, scratch(spark, "sst")), with_ids=False)
