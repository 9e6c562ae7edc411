"""WARC archives of pages: written with segments and chunked framing, read back and put together again.

A response is an HTTP message whose body is framed in chunks. Blocks beyond ``segment_bytes`` are cut: the first segment is the
response, the others are continuation records that name its identifier. Payloads that an earlier record has are revisits
without a body. Reading parses records by their lengths, groups segments by the origin's identifier, orders them by number,
checks the numbering and the total length, and takes the chunk framing off the whole block.

Archives are written by the tasks through the file system of the shared folder. A task writes into a folder of its own attempt
below ``_attempts``; the driver moves those of the attempts whose results it got into place, and only these are read. What a lost
or repeated attempt leaves stays below ``_attempts``.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bodygrid.llm.common import shared_folder, stored

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4096
#: An archive file is closed beyond this size, so that no task has to hold a large one.
FILE_BYTES = 8 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000

CRLF = b"\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The body without chunked framing; extensions after the sizes and trailing fields are skipped. ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + CRLF + CRLF


def page_records(page_id, url, payload: bytes, revisit_of, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page; ``revisit_of``: the page whose response has the same payload, or None."""
    origin = f"<{uuid.uuid4().urn}>"
    digest = hashlib.sha1(payload).hexdigest()
    own = [("WARC-Date", "2026-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join((url or "about:blank").split())), ("WARC-Payload-Digest", f"sha1:{digest}")]
    own += [("WARC-Page-ID", str(page_id))] if page_id is not None else []
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit_of is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Record-ID", origin), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", str(revisit_of))]
        return [record(more + own, head)]
    block = head + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    number = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", origin), ("Content-Type", "application/http;msgtype=response"), *own, *number], parts[0])]
    for i, p in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(i)), *own[:2], *last], p))
    return out


def _plain(data: bytes, step: int = 8192) -> bytes:
    """All members of a gzip file; read in steps, as what follows a member is copied at each end of one."""
    out, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("archive is cut short")
            part = data[at : at + step]
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
    return b"".join(out)


def records(data: bytes):
    """(fields, block) of each record of an archive, plain or compressed record by record; names in lower case."""
    if data[:2] == b"\x1f\x8b":
        data = _plain(data)
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at {at} is cut short")
        yield fields, block
        at = end + 4 + size + 4


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message, without transfer framing."""
    head, _, body = block.partition(CRLF + CRLF)
    framed = any(x.split(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(CRLF)[1:])
    return unchunked(body) if framed else body


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> int:
    """Writes archives of (page_id, url, html, revisit_of) under ``folder``, a folder of a file system that all executors share; how many files."""

    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(uri)
        name = uuid.uuid4().hex
        mine = f"{root}/_attempts/{name}"
        out, n = None, 0
        for b in batches:
            for page_id, url, html, revisit_of in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    store.create_dir(mine, recursive=True)
                    out = store.open_output_stream(f"{mine}/{n:06d}.warc.gz", compression=None)
                    n += 1
                for r in page_records(page_id, url, (html or "").encode("utf-8", "surrogatepass"), revisit_of, segment_bytes):
                    out.write(gzip.compress(r, 1, mtime=0))
                if out.tell() >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "files": pa.array([n], pa.int32())})

    done = pages.select("page_id", "url", "html", "revisit_of").mapInArrow(write, "task int, name string, files int").collect()  # one row per task
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    for r in done:
        final = f"{root}/part-{r['task']:06d}"
        if store.get_file_info(final).type != fs.FileType.NotFound:
            store.delete_dir(final)
        store.move(f"{root}/_attempts/{r['name']}", final)
    return sum(r["files"] for r in done)


_READ = "origin string, type string, segment int, total bigint, page_id bigint, digest string, refers bigint, block binary"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of all archives in the parts of ``folder``: the columns of a record, one row each. Whole files are at most
    FILE_BYTES and one record large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/part-*")

    def parse(batches):
        whole = lambda x: None if x is None else int(x)
        for b in batches:
            for data in b.column(0):
                rows = []
                for f, block in records(data.as_py()):
                    kind = f["warc-type"]
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    rows.append(
                        (
                            f.get("warc-segment-origin-id", f["warc-record-id"]), kind, int(f.get("warc-segment-number", 0)), whole(f.get("warc-segment-total-length")),
                            whole(f.get("warc-page-id")), f.get("warc-payload-digest", "").removeprefix("sha1:"), whole(f.get("warc-refers-to-page")), block if kind != "revisit" else b"",
                        )
                    )
                for i in range(0, len(rows), 256):
                    cols = list(zip(*rows[i : i + 256]))
                    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in _READ.split(", ")])

    return files.select("content").mapInArrow(parse, _READ)


_WHOLE = "page_id bigint, type string, payload_bytes bigint, payload_digest string, refers bigint, problem string"


def _decoded(whole: DataFrame) -> DataFrame:
    """(page_id, type, digest, refers, total, numbers, blocks) to the payload's size and digest; ``problem`` if it can't be had."""

    def decode(batches):
        for b in batches:
            out = []
            for page_id, kind, digest, refers, total, numbers, blocks in zip(*[c.to_pylist() for c in b.columns]):
                if kind == "revisit":
                    out.append((page_id, kind, None, digest, refers, None))
                    continue
                block, problem, payload = b"".join(blocks), None, b""
                if numbers and (numbers != list(range(1, len(numbers) + 1)) or total is None):
                    problem = "segments are missing"
                elif numbers and total != len(block):
                    problem = "total length differs"
                else:
                    try:
                        payload = payload_of(block)
                    except ValueError as e:
                        problem = str(e)
                got = hashlib.sha1(payload).hexdigest()
                if problem is None and digest and digest != got:
                    problem = "digest differs"
                out.append((page_id, kind, len(payload), got, None, problem))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], [x.split()[0] for x in _WHOLE.split(", ")])

    return whole.select("page_id", "type", "digest", "refers", "total", "numbers", "blocks").mapInArrow(decode, _WHOLE)


def reassemble(segments: DataFrame) -> DataFrame:
    """Per page record: page_id, type, payload_bytes, payload_digest, refers, problem.

    Only cut records are shuffled. A group is the segments of one record, so as large as one page.
    """
    single = segments.filter("segment = 0").select("page_id", "type", "digest", "refers", "total", F.array().cast("array<int>").alias("numbers"), F.array("block").alias("blocks"))
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    cut = segments.filter("segment > 0").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("digest"), F.max("total").alias("total"), parts.alias("parts")
    )
    cut = cut.select("page_id", F.lit("response").alias("type"), "digest", F.lit(None).cast("bigint").alias("refers"), "total", F.col("parts.segment").alias("numbers"), F.col("parts.block").alias("blocks"))
    return _decoded(single.unionByName(cut))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes ``pages`` as archives and reads them back. Per page: page_id, payload_bytes, payload_digest, record_type, refers_to,
    and ``problem``, null where the payload came back whole.

    Null html is empty. Of equal payloads of at least 1000 bytes the record with the largest page_id is the response and the
    others revisit it; rows that repeat that page_id, and rows without an id where no other has one, are responses too. A
    revisit's size is that of the response it refers to. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # equal payloads by 256 bits of hash and the length
    src = src.withColumn("same", F.when(F.octet_length("html") >= LEAST_REVISIT, F.concat_ws(":", F.sha2(F.encode("html", "UTF-8"), 256), F.octet_length("html"))))
    last = stored(src.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "last"))
    # small payloads get keys of their own, so that they don't meet in one task
    src = src.withColumn("same", F.coalesce("same", F.concat(F.lit("-"), F.col("page_id").cast("string")), F.lit("-")))
    marked = src.join(last, "same", "left").select("page_id", "url", "html", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("revisit_of"))
    if not write_archives(marked, folder, segment_bytes):
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, problem string")
    got = stored(reassemble(read_archives(spark, folder)))
    responses = got.filter("type = 'response' and problem is null").groupBy(F.col("payload_digest").alias("d"), F.col("page_id").alias("p")).agg(F.max("payload_bytes").alias("bytes"))
    whole = got.join(responses, (got["payload_digest"] == responses["d"]) & (got["refers"] == responses["p"]), "left")
    lost = (F.col("type") == "revisit") & F.col("bytes").isNull()
    return whole.select(
        "page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("refers").alias("refers_to"),
        F.when(lost, "nothing to refer to").otherwise(F.col("problem")).alias("problem"),
    )
