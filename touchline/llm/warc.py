"""WARC archives from pages by way of a chunked record table, and their reading back.

A payload is handled as rows `(record, chunk_no, data)` of at most `chunk_bytes` bytes that carry the running SHA-1 and
length; the writer appends chunks to a gzip member a record, the reader parses members as a stream and gives chunks
again. Neither holds a whole record beside the row that the table itself stores.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import cut, open_in, open_out, per_file, shared_folder, task_file, tasks, text_or_empty

CHUNK = 1 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(state) -> str:
    return base64.b32encode(state.digest()).decode()


def chunks_of(text: str, chunk_bytes: int = CHUNK):
    """UTF-8 chunks of a text, encoded piece by piece."""
    step = max(1, chunk_bytes // 4)
    for at in range(0, len(text), step):
        yield text[at : at + step].encode("utf-8", "replace")


CHUNKS = "record long, page_id long, url string, chunk_no int, data binary, size long, digest string, last boolean"


def batch_of(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def chunk_table(pages: DataFrame, html: str = "html", chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunked record table: `record, page_id, url, chunk_no, data, size, digest, last`.

    `record` numbers the rows; `size` is the length so far; the last chunk has the digest that grew with the chunks. An empty or
    null payload has one empty chunk.
    """
    kinds = [("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("size", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())]

    def run(batches):
        out, held = [], 0
        for b in batches:
            for record, page_id, url, text in zip(*(b[c].to_pylist() for c in ("record", "page_id", "url", "t")), strict=True):
                state, size, data, number = hashlib.sha1(), 0, b"", 0
                for piece in chunks_of(text, chunk_bytes):
                    if size:
                        out.append((record, page_id, url, number, data, size, None, False))
                        number += 1
                    state.update(piece)
                    size += len(piece)
                    held += len(piece)
                    data = piece
                    if held >= 4 * CHUNK and out:
                        yield batch_of(out, kinds)
                        out, held = [], 0
                out.append((record, page_id, url, number, data, size, base32_sha1(state), True))
        if out:
            yield batch_of(out, kinds)

    rows = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"), text_or_empty(html).alias("t"),
    )
    return rows.mapInArrow(run, CHUNKS)


def record_roles(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """A row per record: `record, page_id, url, size, digest, first`; `first` is the page a revisit refers to.

    Digests are counted first (partial sums meet a hot payload's rows before the shuffle) and written; the join
    then reads plain tables, whose hot partitions adaptive execution can split.
    """
    heads = chunks.filter("last").select("record", "page_id", "url", "size", "digest")
    firsts = heads.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    refers = (F.col("size") >= least_bytes) & (F.col("page_id").isNull() | (F.col("first") < F.col("page_id")))
    return heads.join(cut(firsts, "firsts"), "digest", "left").withColumn("first", F.when(refers, F.col("first")))


def record_head(page_id, url: str | None, digest: str, size: int, first, date: str) -> bytes:
    name = "null" if page_id is None else page_id
    kind, body = ("response", len(HTTP_HEAD) + size) if first is None else ("revisit", len(HTTP_HEAD))
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {''.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"] if first is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {body}",
    ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, chunk_bytes: int = CHUNK, date: str | None = None) -> list[str]:
    """Paths of the archives, one a task: a gzip member a record, a revisit without its payload.

    Role rows (chunk number -1) and chunk rows are dealt by record and sorted, so the writer appends one chunk at a time.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        uri, out, member, body = None, None, None, False
        for b in batches:
            for number, data, page_id, url, size, digest, first in zip(*(b[c].to_pylist() for c in ("chunk_no", "data", "page_id", "url", "size", "digest", "first")), strict=True):
                if out is None:
                    uri = task_file(folder, 0, "warc.gz")
                    out = open_out(uri)
                if number < 0:
                    if member is not None:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                    member, body = zlib.compressobj(6, zlib.DEFLATED, 31), first is None
                    out.write(member.compress(record_head(page_id, url, digest, size, first, date) + HTTP_HEAD))
                elif body:
                    out.write(member.compress(data))
        if out is not None:
            out.write(member.compress(b"\r\n\r\n") + member.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["path"])

    chunks = cut(chunk_table(pages, chunk_bytes=chunk_bytes), "chunks")
    heads = record_roles(chunks, least_bytes).withColumn("chunk_no", F.lit(-1))
    rows = heads.unionByName(chunks.select("record", "chunk_no", "data"), allowMissingColumns=True)
    dealt = rows.repartition(tasks(pages.sparkSession), "record").sortWithinPartitions("record", "chunk_no")
    return [r.path for r in dealt.drop("record").mapInArrow(run, "path string").collect()]


class Members:
    """Reads the concatenated gzip members of a file as one stream of decoded bytes."""

    def __init__(self, file, step: int = 1 << 16):
        self.file, self.step, self.raw, self.got, self.state = file, step, b"", b"", None

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = bytes(self.file.read(self.step))
                if not self.raw:
                    return False
            self.state = self.state or zlib.decompressobj(31)
            data = self.state.decompress(self.raw, CHUNK)
            self.raw = self.state.unconsumed_tail
            if self.state.eof:
                self.raw, self.state = self.state.unused_data + self.raw, None
            if data:
                self.got += data
                return True

    def line(self) -> bytes | None:
        while b"\n" not in self.got:
            if not self.more():
                return None
        line, self.got = self.got.split(b"\n", 1)
        return line.rstrip(b"\r")

    def take(self, n: int):
        """The next n bytes in pieces."""
        while n:
            if not self.got and not self.more():
                raise EOFError("archive ends inside a record")
            piece, self.got = self.got[:n], self.got[n:]
            n -= len(piece)
            yield piece


def records(stream: Members):
    """`(headers, chunks of the payload)` per record; the chunks are taken before the next record."""
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        heads = {}
        while line := stream.line():
            name, _, value = line.decode("utf-8").partition(":")
            heads[name.strip().lower()] = value.strip()
        left = int(heads["content-length"])
        while left:
            line = stream.line()
            left -= len(line) + 2
            if not line:
                break
        yield heads, stream.take(left)


def page_of(urn: str | None):
    name = (urn or "<urn:page:null>").strip("<>").rsplit(":", 1)[1]
    return None if name == "null" else int(name)


def read_warc(spark: SparkSession, paths: list[str], payloads: bool = False) -> DataFrame:
    """Chunk rows of the archives: `page_id, chunk_no, last, payload_bytes, payload_digest, record_type, refers_to` (and `data`).

    The digest and length of a response are counted chunk by chunk from what the archive holds and must equal its
    header; a revisit's come from its header.
    """

    def run(batches):
        for b in batches:
            for uri in b["path"].to_pylist():
                out = []
                with open_in(uri) as file:
                    for heads, chunks in records(Members(file)):
                        page, kind = page_of(heads["warc-record-id"]), heads["warc-type"]
                        refers = page_of(heads["warc-refers-to"]) if kind == "revisit" else None
                        state, size, number = hashlib.sha1(), 0, 0
                        for data in chunks:
                            state.update(data)
                            size += len(data)
                            if payloads:
                                out.append((page, number, False, size, None, kind, refers, data))
                                number += 1
                        said, length = heads["warc-payload-digest"].removeprefix("sha1:"), int(heads["warc-payload-length"])
                        if kind == "response" and (base32_sha1(state), size) != (said, length):
                            raise ValueError(f"record {page}: payload differs from its digest")
                        out.append((page, number, True, length, said, kind, refers, None))
                        if len(out) >= (8 if payloads else 4096):
                            yield batch_of(out, kinds)
                            out = []
                if out:
                    yield batch_of(out, kinds)

    kinds = [("page_id", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("data", pa.binary())]

    schema = "page_id long, chunk_no int, last boolean, payload_bytes long, payload_digest string, record_type string, refers_to long, data binary"
    return per_file(spark, [(p,) for p in paths], "path string").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = CHUNK) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back: one row per page.

    A null html is an empty payload. Rows that repeat the smallest page id of their payload are responses as well;
    a null page id is never the first and revisits nothing unless another row has its payload.
    """
    spark = pages.sparkSession
    paths = write_warc(pages, shared_folder(spark, "warc"), least_bytes, chunk_bytes)
    return read_warc(spark, paths).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
