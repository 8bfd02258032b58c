"""WARC archives through a chunked record table.

A page's payload is dealt into rows (record, chunk number, bytes) by DataFrame expressions, so a
writer holds one chunk at a time however large the record. Writers stream the rows of a record into
one gzip member of a WARC/1.1 file. Reading streams each file back into rows
(page_id, chunk, bytes, size and SHA-1 so far, last): the digests are carried on from chunk to chunk
and the last row of a record has those of the whole payload.

Equal payloads of at least `LEAST` bytes are stored once: the largest page_id has the response, the
others are revisits that refer to it. Which that is comes from one aggregate per digest with
map-side partials, joined back; a digest that many pages share is a skewed join that AQE splits.

Files are written to the shared folder under the name of the attempt that writes them. Only the
attempts that succeed are in the manifest, so a lost executor or a second attempt leaves a file that
nobody reads.

Cases: a null html is an empty payload. Rows that share both the payload and the largest page_id are
all responses. A null page_id is smaller than any other; payloads that only null ids share are all
responses, and the id comes back as null. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framerank.llm import _common as C

LEAST, CHUNK = 1000, 1 << 20
#: Shared digests (of 60 bytes) up to this number are broadcast.
FEW = 500_000
_ENDS = b"\r\n\r\n"
TABLE = "page_id long, record_type string, refers_to long, chunk int, data binary, bytes_so_far long, sha1_so_far string, last boolean, payload_bytes long, payload_digest string"
_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_HEADS = "page_id long, url string, size long, sha1 string, refers_to long"


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, size, sha1 and refers_to (null for a response)."""
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({"size": F.octet_length("html").cast("long"), "sha1": F.sha1("html")})
    shared = rows.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Only digests that occur twice are looked up. If they are few they travel to the pages, else both meet in a shuffle.
    shared = C.materialise(shared, "warc_shared")
    found = rows.join(F.broadcast(shared) if shared.count() <= FEW else shared, ["sha1", "size"], "left")
    return found.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of at most `chunk` bytes, in order; an empty or referred payload has one empty chunk."""
    n = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(F.col("size") / chunk).cast("int"))).otherwise(1)
    return rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "page_id", "url", "size", "sha1", "refers_to", "chunk", (F.col("chunk") == n - 1).alias("last"),
        F.when(F.col("refers_to").isNull(), F.substring("html", F.col("chunk") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b"")).alias("data"),
    )


def _name(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _id(name: str) -> int | None:
    tail = name.strip("<>").rsplit(":", 1)[1]
    return None if tail == "null" else int(tail)


def head(page_id: int | None, url: str | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """Everything of a record that stands before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    digest = b32encode(bytes.fromhex(sha1)).decode()
    stored = size if refers_to is None else 0
    address = "".join(c for c in url or "urn:none" if c > " " and c != "\x7f")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_name(page_id)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_name(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + stored}"]
    return "\r\n".join(lines).encode() + _ENDS + http


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, records, packer = None, 0, None
        for batch in batches:
            for page_id, url, size, sha1, refers_to, chunk, last, data in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                if chunk == 0:
                    packer = zlib.compressobj(1, wbits=31)
                    out.write(packer.compress(head(page_id, url, size, sha1, refers_to)))
                out.write(packer.compress(data))
                if last:
                    out.write(packer.compress(_ENDS) + packer.flush())
                    records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{path.rsplit('/', 1)[1]}"], "records": [records]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return write


def write(pages: DataFrame, folder: str, *, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Write archives under `folder`, which all executors reach; the manifest (file, records)."""
    C.arrow_limits(pages.sparkSession)
    return C.materialise(chunked(classify(pages, least), chunk).mapInArrow(_writer(folder), "file string, records long"), "warc_manifest")


class _Stream:
    """Bytes of a file of gzip members, pulled as they are needed."""

    def __init__(self, source, size: int = 1 << 18):
        self.source, self.size, self.raw, self.held = source, size, b"", bytearray()
        self.member = zlib.decompressobj(wbits=31)

    def _more(self) -> bool:
        if self.member.eof:
            self.raw, self.member = self.member.unused_data or self.raw, zlib.decompressobj(wbits=31)
        if not self.raw:
            self.raw = self.source.read(self.size)
            if not self.raw:
                return False
        self.held += self.member.decompress(self.raw, self.size)
        self.raw = b"" if self.member.eof else self.member.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return b""
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        """1 to n bytes."""
        while not self.held:
            if not self._more():
                raise EOFError("an archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[: len(out)]
        return out


def _fields(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if ": " in line)


def records(source, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of TABLE from one open archive."""
    stream = _Stream(source)
    while top := stream.until(_ENDS):
        warc = _fields(top)
        http_block = stream.until(_ENDS)
        http = _fields(http_block)
        left = int(warc["Content-Length"]) - len(http_block) - len(_ENDS)
        kind = warc["WARC-Type"]
        same = (_id(warc["WARC-Record-ID"]), kind, _id(warc["WARC-Refers-To"]) if "WARC-Refers-To" in warc else None)
        digest, size, k = hashlib.sha1(), 0, 0
        while True:
            data = bytearray()
            while left and len(data) < chunk:
                data += (got := stream.take(min(left, chunk - len(data))))
                left -= len(got)
            digest.update(data)
            size += len(data)
            so_far = digest.copy().hexdigest()
            whole = (None, None) if left else (size, so_far) if kind == "response" else (int(http["Content-Length"]), b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex())
            yield (*same, k, bytes(data), size, so_far, not left, *whole)
            k += 1
            if not left:
                break
        stream.until(_ENDS)


def _reader(chunk: int, with_data: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(file if "://" in file or file.startswith("file:") else f"file://{file}")
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for row in records(source, chunk):
                        held += len(row[4]) + 200
                        rows.append(row if with_data else (*row[:4], None, *row[5:]))
                        if held > C.BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return read


def read(spark: SparkSession, manifest: DataFrame, *, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table (TABLE) of the archives in `manifest`; a file is one task's work.
    Without data the bytes are digested and left out of the rows."""
    C.arrow_limits(spark)
    files = max(1, manifest.count())
    return manifest.select("file").repartition(files).mapInArrow(_reader(chunk, with_data), TABLE)


def digest(pages: DataFrame) -> DataFrame:
    """The columns of op6: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    manifest = write(pages, C.fresh_path(spark, "warc"))
    table = read(spark, manifest, with_data=False).where("last")
    return table.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
