"""WARC archives through a chunked record table.

At the scan a payload is cut into rows (record id, chunk number, bytes, the SHA-256 of the payload up to and
with them), which are written as a table: every task has its file, in which a record's chunks stand one after the other.
Equal payloads are found by ids and digests alone: the record with the smallest id is the response, the others are
revisit records that name it. What a file's records refer to is one row for each file, and the task that gets this
row reads the file from the shared folder a few chunks at a time and writes the archive; so payloads are not shuffled, no plan can
part a record's chunks, and no whole payload is held. The reader gives chunks back the same way.

File: one gzip member a record, WARC/1.1, in the shared folder. A file counts once Spark has
committed its manifest row, so a task that is run again leaves a stray file that nobody reads.

Cases: a null payload is empty; one of any length is whole. Payloads under MIN_REVISIT bytes, and records without an id, are
always responses. Repeated ids are all written; with equal payloads each of them is a response
if that id is the smallest. An empty table gives no file and no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.llm._common import discard, file_system, materialize, scratch, setting, small_batches

#: Bytes of a payload in one row.
CHUNK_BYTES = 1 << 20
#: Bytes of chunks in one batch that a task gives out.
BATCH_BYTES = 4 << 20
#: Payloads shorter than this are never revisits.
MIN_REVISIT = 100
MANIFEST = "path string, n_records long, n_bytes long"
CHUNKS = pa.schema(
    [("record_id", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("digest_so_far", pa.string()), ("data", pa.binary())]
)
CHUNKS_DDL = "record_id long, chunk int, last boolean, uri string, record_type string, refers_to long, payload_bytes long, digest string, digest_so_far string, data binary"
_DATE = "2026-01-01T00:00:00Z"


_CUT = pa.schema(
    [("record_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("digest_so_far", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("row", pa.int64())]
)
_CUT_DDL = "record_id long, uri string, payload_bytes long, digest string, digest_so_far string, chunk int, last boolean, data binary, row long"
#: Chunks that a writer reads at a time.
READ_CHUNKS = 8
#: Tasks of the writer for each core; a file is written by one task.
FILES_A_CORE = 4


def cut_payloads(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", uri_column: str = "url", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all payloads, a record's one after the other: record_id, uri, payload_bytes, digest (of the payload),
    digest_so_far, chunk, last, data; row (within the task) names the record. In place over the scan."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, rows, held = 0, [], 0
        for batch in batches:
            for record_id, uri, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                view = memoryview(payload.as_buffer() or b"")
                total, so_far = hashlib.sha256(), []
                parts = [view[at : at + chunk_bytes] for at in range(0, max(1, len(view)), chunk_bytes)]
                for part in parts:
                    total.update(part)
                    so_far.append(total.copy())
                digest = total.hexdigest()
                for k, part in enumerate(parts):
                    rows.append((record_id, uri, len(view), digest, so_far[k].hexdigest(), k, k == len(parts) - 1, bytes(part), row))
                    held += len(part) + 400
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CUT.types, strict=True)], schema=_CUT)
                        rows, held = [], 0
                row += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CUT.types, strict=True)], schema=_CUT)

    payload = F.coalesce(F.encode(F.col(payload_column).cast("string"), "utf-8"), F.lit(b""))
    return pages.select(F.col(id_column).cast("long"), F.col(uri_column).cast("string"), payload).mapInArrow(cut, _CUT_DDL)


def chunk_table(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", uri_column: str = "url", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """cut_payloads() as a table; each of its files holds whole records, numbered by row."""
    spark = pages.sparkSession
    with small_batches(spark), setting(spark, "spark.sql.files.maxRecordsPerFile", "0"):
        return materialize(cut_payloads(pages, id_column, payload_column, uri_column, chunk_bytes), "warc-chunks")


def first_records(chunks: DataFrame) -> DataFrame:
    """file, refers_to: for each file of a chunk table a map from the row of a record to the smallest record id of
    those with an equal payload, where that is another record. Payloads under MIN_REVISIT bytes and records
    without an id refer to none; files may have no entry."""
    keys = chunks.where(F.col("last") & (F.col("payload_bytes") >= MIN_REVISIT) & F.col("record_id").isNotNull()).select("record_id", "digest", F.input_file_name().alias("file"), "row")
    groups = keys.groupBy("digest").agg(F.min("record_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first_id")
    repeats = keys.join(groups, "digest").where(F.col("record_id") != F.col("first_id"))
    return repeats.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("row", "first_id"))).alias("refers_to"))


def _header(record_id, uri, payload_bytes, digest, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if record_id is None else record_id}>", f"WARC-Date: {_DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {payload_bytes}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {payload_bytes if refers_to is None else 0}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write one archive for each file of a chunk table; returns the manifest."""
    names = ["record_id", "uri", "payload_bytes", "digest", "row", "chunk", "last", "data"]

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task, written = TaskContext.get(), 0
        for batch in batches:
            for file, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers, n_records, squeeze = dict(refers or ()), 0, None
                path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{written}.warc.gz"
                written += 1
                fs, inner = file_system(path)
                fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                given, source = file_system(unquote(file))
                with given.open_input_file(source) as handle, fs.open_output_stream(inner, compression=None) as stream:
                    for part in pq.ParquetFile(handle, buffer_size=1 << 20, pre_buffer=False).iter_batches(READ_CHUNKS, columns=names):
                        for record_id, uri, payload_bytes, digest, row, chunk, last, data in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                            refers_to = refers.get(row)
                            if refers_to is not None and chunk:
                                continue  # a revisit has no payload
                            if chunk == 0:
                                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                                stream.write(squeeze.compress(_header(record_id, uri, payload_bytes, digest, refers_to)))
                                n_records += 1
                            if refers_to is None and data:
                                stream.write(squeeze.compress(data))
                            if last or refers_to is not None:
                                stream.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                    n_bytes = stream.tell()
                yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n_records, "n_bytes": n_bytes}], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    spark = chunks.sparkSession
    files = chunks.select(F.input_file_name().alias("file")).distinct().join(first_records(chunks), "file", "left")
    files.repartition(FILES_A_CORE * spark.sparkContext.defaultParallelism).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


class _Members:
    """Bytes of a file of gzip members, read on demand; holds one input block and its output."""

    def __init__(self, source, block: int = 1 << 18):
        self.source, self.block, self.left, self.raw, self.squeeze = source, block, b"", b"", None

    def _more(self) -> bool:
        while True:
            if self.squeeze is None or self.squeeze.eof:
                self.raw = (self.squeeze.unused_data if self.squeeze else b"") or self.raw or self.source.read(self.block)
                if not self.raw:
                    return False
                self.squeeze = zlib.decompressobj(31)
                out, self.raw = self.squeeze.decompress(self.raw, self.block), b""
            else:
                feed = self.squeeze.unconsumed_tail or self.source.read(self.block)
                if not feed:
                    raise ValueError("the archive ends within a record")
                out = self.squeeze.decompress(feed, self.block)
            if out:
                self.left += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with mark; None at the end of the file."""
        while (at := self.left.find(mark)) < 0:
            if not self._more():
                if self.left:
                    raise ValueError("the archive ends within a header")
                return None
        out, self.left = self.left[: at + len(mark)], self.left[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.left) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out, self.left = self.left[:n], self.left[n:]
        return out


def _urn(text: str | None) -> int | None:
    number = (text or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def read_records(source, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of one archive; holds one chunk at a time."""
    members = _Members(source)
    while (head := members.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)
        length, total = int(fields["Content-Length"]), hashlib.sha256()
        row = {"record_id": _urn(fields["WARC-Record-ID"]), "uri": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": _urn(fields.get("WARC-Refers-To"))}
        row |= {"payload_bytes": int(fields["WARC-Payload-Length"]), "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}
        for k in range(max(1, -(-length // chunk_bytes))):
            data = members.take(min(chunk_bytes, length - k * chunk_bytes))
            total.update(data)
            yield row | {"chunk": k, "last": (k + 1) * chunk_bytes >= length, "digest_so_far": total.hexdigest() if length else None, "data": data}
        if members.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its header says")
        if length and total.hexdigest() != row["digest"]:
            raise ValueError(f"payload of record {row['record_id']} does not match its digest")


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives in the manifest, payload digests checked; without data where only records count."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = file_system(path)
                rows, held = [], 0
                with fs.open_input_stream(inner, compression=None) as source:
                    for row in read_records(source, chunk_bytes):
                        if not with_data:
                            if not row["last"]:
                                continue
                            row["data"] = None
                        rows.append(row)
                        held += len(row["data"] or b"") + 400
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS)

    tasks = 2 * manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path").repartition(tasks).mapInArrow(read, CHUNKS_DDL)


def op5_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: pages to archives and back, one row a page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    chunks = chunk_table(pages)
    manifest = write_archives(chunks, scratch(spark, "warc"))
    discard(chunks)  # the archives hold all of it
    records = read_archives(manifest, with_data=False).where("last")
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", F.col("uri").alias("target_uri"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, url AS target_uri FROM pages
), f AS (
  SELECT payload_digest, payload_bytes, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY ALL
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to, p.target_uri
FROM p LEFT JOIN f USING (payload_digest, payload_bytes)
"""
