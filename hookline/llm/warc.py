"""WARC archives from a chunked record table (operator 1).

Payloads travel as rows (record, chunk number, at most CHUNK bytes) that carry
the number of bytes and the SHA-1 so far, so no step needs a whole record:

* ``chunk_records`` cuts pages into that table;
* ``write_archives`` streams it, sorted by record and chunk, into gzipped WARC
  files in the shared scratch folder, one gzip member per record. Of records
  with equal payloads (of at least MIN_REVISIT bytes) one is written as
  response, the others as revisits that refer to it;
* ``read_archives`` streams the files back into a chunked record table, again
  with digests that grow chunk by chunk.

A file belongs to one attempt of one task and only files whose task succeeded
are in the manifest, so lost executors leave at most unread files behind.

Rows: null html is an empty payload; null page ids and urls leave their header
out and read back as null. Repeated rows give a record each; among records with
equal payload and id one is the response. An empty table writes no file and
reads back empty. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hookline.session import scratch_path

from .common import join_skewed, materialise, slices, with_columns_of

CHUNK = 1 << 16
FILE_BYTES = 1 << 30

_CHUNKS = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()),
                     ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()),
                     ("last", pa.bool_())])
CHUNK_TYPE = ("record long, page_id long, url string, chunk int, data binary, bytes_so_far long, "
              "digest_so_far string, last boolean")


def digest(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def _batches(rows, schema: pa.Schema, size: int = 128):
    """Record batches of at most ``size`` rows, so that a batch holds few chunks."""
    out = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def chunk_records(pages: DataFrame) -> DataFrame:
    """(record, page_id, url, chunk, data, bytes_so_far, digest_so_far, last) per chunk."""
    d = with_columns_of(pages, {"page_id": "long", "url": "string", "html": "string"}).withColumn(
        "record", F.monotonically_increasing_id())

    def run(batches):
        def rows():
            for batch in batches:
                for part in slices(batch, "html", 1 << 20):
                    html = part.column("html").cast(pa.large_binary()).fill_null(b"")
                    for record, page, url, value in zip(part.column("record").to_pylist(),
                                                        part.column("page_id").to_pylist(),
                                                        part.column("url").to_pylist(), html):
                        whole = value.as_buffer()
                        sha, n = hashlib.sha1(usedforsecurity=False), whole.size
                        for i in range(max(1, -(-n // CHUNK))):
                            piece = whole[i * CHUNK:(i + 1) * CHUNK].to_pybytes()
                            sha.update(piece)
                            to = min(n, (i + 1) * CHUNK)
                            # a url may be long: the first chunk has it for the header, the last for its digest
                            yield record, page, url if not i or to == n else None, i, piece, to, digest(sha), to == n
        yield from _batches(rows(), _CHUNKS)
    return d.mapInArrow(run, CHUNK_TYPE)


def decide(chunks: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(record, payload_bytes, payload_digest, response, response_page, response_url): the record
    that holds the payload, and null for those that hold their own."""
    last = chunks.where("last").select("record", "page_id", "url", F.col("bytes_so_far").alias("payload_bytes"),
                                       F.col("digest_so_far").alias("payload_digest"))
    key = F.xxhash64("payload_digest", "payload_bytes")
    last = last.withColumn("key", key)
    first = last.where(F.col("payload_bytes") >= min_revisit).groupBy("key", "payload_digest").agg(
        F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "record", "url")).alias("r"),
        F.count("*").alias("copies")).where("copies > 1").select(
        "key", "copies", F.col("r.record").alias("response"), F.col("r.page_id").alias("response_page"),
        F.col("r.url").alias("response_url"))
    x = join_skewed(last.select("record", "key", "payload_bytes", "payload_digest"), first, "key", "copies",
                    max(1, last.count()), "record")
    mine = F.col("response").isNull() | (F.col("response") == F.col("record")) | (F.col("payload_bytes") < min_revisit)
    return x.select("record", "payload_bytes", "payload_digest",
                    *[F.when(~mine, F.col(c)).alias(c) for c in ("response", "response_page", "response_url")])


def _urn(run: str, record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(run), str(record))}>"


def _uri(url: str) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]")


def _head(run: str, r: dict) -> bytes:
    """WARC and HTTP header of a record."""
    revisit = r["response"] is not None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {r['payload_bytes']}\r\n\r\n").encode()
    h = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(run, r['record'])}",
         "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
         f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
         f"Content-Length: {len(http) + (0 if revisit else r['payload_bytes'])}", f"X-Record: {r['record']}"]
    if r["page_id"] is not None:
        h.append(f"X-Page-Id: {r['page_id']}")
    if r["url"] is not None:
        h.append(f"WARC-Target-URI: {_uri(r['url'])}")
    if revisit:
        h += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
              f"WARC-Refers-To: {_urn(run, r['response'])}"]
        if r["response_page"] is not None:
            h.append(f"X-Refers-To-Page-Id: {r['response_page']}")
        if r["response_url"] is not None:
            h.append(f"WARC-Refers-To-Target-URI: {_uri(r['response_url'])}")
    return ("\r\n".join(h) + "\r\n\r\n").encode() + http


class _Writer:
    """A run of files in one folder; a record is compressed chunk by chunk."""

    def __init__(self, folder: str, run: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.run, self.out, self.done, self.gz = run, None, [], None

    def add(self, r: dict) -> None:
        if r["chunk"] == 0:
            if self.out is None:
                self.fs.create_dir(self.folder, recursive=True)
                self.name, self.size, self.records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.gz = zlib.compressobj(6, zlib.DEFLATED, 31)
            self._put(self.gz.compress(_head(self.run, r)))
        if r["response"] is None:
            self._put(self.gz.compress(r["data"]))
        if r["last"]:
            self._put(self.gz.compress(b"\r\n\r\n") + self.gz.flush())
            self.records += 1
            if self.size >= FILE_BYTES:
                self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def write_archives(pages: DataFrame, min_revisit: int = 0) -> tuple[str, DataFrame]:
    """Write one record per row; the folder and its manifest (file, records, bytes)."""
    chunks = materialise(chunk_records(pages), "warc-chunks")
    folder = scratch_path(pages.sparkSession, "warc")
    run_id = str(uuid.uuid4())
    # a revisit's payload stays behind: only what is written moves
    rows = chunks.drop("digest_so_far", "bytes_so_far").join(decide(chunks, min_revisit), "record").withColumn(
        "data", F.when(F.col("response").isNull(), F.col("data"))).repartition("record").sortWithinPartitions(
        "record", "chunk")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        w = _Writer(folder, run_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    w.add(r)
        w.close()
        yield from _batches(w.done, schema)
    return folder, materialise(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


class _Source:
    """Decompressed bytes of a file of gzip members, read in small steps."""

    def __init__(self, stream):
        self.stream, self.gz, self.raw, self.buf = stream, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                return False
        self.buf += self.gz.decompress(self.raw, CHUNK)
        self.raw = self.gz.unconsumed_tail or self.gz.unused_data
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end."""
        at = 0
        while True:
            i = self.buf.find(mark, max(0, at - len(mark)))
            if i >= 0:
                return self.take(i + len(mark))
            at = len(self.buf)
            if not self._more():
                if self.buf.strip():
                    raise ValueError("a WARC file ends within a record")
                return None

    def take(self, most: int) -> bytes:
        """Between 1 and ``most`` bytes."""
        while not self.buf:
            if not self._more():
                raise ValueError("a WARC file ends within a record")
        out = bytes(self.buf[:most])
        del self.buf[:most]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:] if x)}


_READ = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()),
                   ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
READ_TYPE = ("record long, page_id long, url string, record_type string, refers_to long, chunk int, data binary, "
             "bytes_so_far long, digest_so_far string, last boolean")


def _records(src: _Source, with_data: bool):
    while True:
        head = src.until(b"\r\n\r\n")
        if head is None:
            return
        h = _fields(head)
        http = src.until(b"\r\n\r\n")
        left = int(h["content-length"]) - len(http)
        record, page, refers = (int(h[k]) if k in h else None for k in ("x-record", "x-page-id", "x-refers-to-page-id"))
        stated = h["warc-payload-digest"].removeprefix("sha1:")
        kind = h["warc-type"]
        common = (record, page, h.get("warc-target-uri"), kind, refers)
        if kind == "revisit":  # the payload is with the response; its size and digest are in the headers
            yield *common, 0, None, int(_fields(http)["content-length"]), stated, True
        else:
            sha, n, i = hashlib.sha1(usedforsecurity=False), 0, 0
            while True:
                piece = b""
                while left and len(piece) < CHUNK:
                    got = src.take(min(left, CHUNK - len(piece)))
                    piece += got
                    left -= len(got)
                sha.update(piece)
                n += len(piece)
                got = digest(sha)
                if not left and got != stated:
                    raise ValueError(f"record {record}: payload digest is {got}, header says {stated}")
                if with_data or not left:
                    yield *common, i, piece if with_data else None, n, got, not left
                i += 1
                if not left:
                    break
        end = src.until(b"\r\n\r\n")
        if end != b"\r\n\r\n":
            raise ValueError(f"record {record}: bytes after its block")


def read_archives(folder: str, manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the manifest's files; without data only last chunks."""
    files = max(1, manifest.count())

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)

        def rows():
            for batch in batches:
                for name in batch.column("file").to_pylist():
                    with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                        yield from _records(_Source(stream), with_data)
        yield from _batches(rows(), _READ, 128 if with_data else 4096)
    return manifest.select("file").repartition(min(files, 4096), "file").mapInArrow(run, READ_TYPE)


def op1(pages: DataFrame) -> DataFrame:
    """Contract of op1_warc: write, read back, report each record."""
    return read_archives(*write_archives(pages), with_data=False).where("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"),
        "record_type", "refers_to")
