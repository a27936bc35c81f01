"""WARC archives: written with revisits and long records in segments, read back and reassembled.

A record is a row of text, and Spark writes rows: the archive's line separator
is the blank lines that end a record, its compression gzip. A record's block is
an HTTP response in chunks. A block beyond SEGMENT_BYTES becomes a first record
and continuation records, rows of their own, so that a file is bounded however
long a page is. Reading groups continuations by the identifier of their origin,
orders them by segment number and checks the total length; only records in
segments are shuffled for that.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffinlake.session import scratch_dir

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Records in a file; with SEGMENT_BYTES this bounds its size.
FILE_RECORDS = 2_000
DATE = "2020-01-01T00:00:00Z"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_SEGMENTS = (
    "record_id string, origin_id string, segment int, total_length long, record_type string, page_id {id}, url string, "
    "payload_digest string, block binary"
)
_RECORDS = "record_id string, record_type string, page_id {id}, url string, payload_digest string, payload binary"


class BrokenArchive(ValueError):
    """What is read is not what was written."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing: the length of each chunk in hex on a line before it, an empty chunk at the end."""
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return b"".join([*(b"%x\r\n%b\r\n" % (len(p), p) for p in parts), b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise BrokenArchive("a chunk has no length")
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            raise BrokenArchive("a chunk's length is no number") from None
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise BrokenArchive("a chunk ends early")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _header(fields: dict[str, object]) -> bytes:
    """Lines of named fields, null ones left out; a line break in a value cannot end its line."""
    lines = ["WARC/1.1"]
    for name, value in fields.items():
        if value is not None:
            safe = re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value) if name == "WARC-Target-URI" else value
            lines.append(f"{name}: {safe}")
    return ("\r\n".join(lines) + _END).encode("utf-8", "surrogatepass")


def records_of(name: str, page_id: object, url: str | None, payload: bytes, refers_to: object, segment_bytes: int) -> list[bytes]:
    """The records of one page, without the blank lines that end them."""
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{name}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "WARC-Page-ID": page_id,
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        block = (_HTTP + "\r\n").encode()
        return [_header(fields | {"WARC-Profile": profile, "Content-Length": len(block)}) + block]
    block = (_HTTP + "Transfer-Encoding: chunked" + _END).encode() + chunked(payload)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_header(fields | {"Content-Length": len(block)}) + block]
    out = [_header(fields | {"WARC-Segment-Number": 1, "Content-Length": len(parts[0])}) + parts[0]]
    for number, part in enumerate(parts[1:], 2):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.UUID(name), str(number))}>",
            "WARC-Date": DATE,
            "WARC-Segment-Number": number,
            "WARC-Segment-Origin-ID": f"<urn:uuid:{name}>",
            "WARC-Segment-Total-Length": len(block) if number == len(parts) else None,
            "Content-Length": len(part),
        }
        out.append(_header(more) + part)
    return out


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """A record for each row of `pages` (page_id, url, html), in gzip files below `path`.

    The payload is the html in UTF-8, empty for null. Of equal payloads the
    row with the largest page_id is the response and the others revisit it;
    rows that repeat its id as well are responses too, and so are all if no row
    has an id. Only payloads that occur twice take part in the join that tells
    which; Spark splits it at one that very many rows share.
    """
    named = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    named = named.withColumn("digest", F.sha1("payload"))
    again = named.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    rows = named.join(again, "digest", "left").select("page_id", "url", "payload", refers)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows that are equal get names of their own: their segments must not mix.
        task, number = TaskContext.get(), 0
        space = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}/{task.partitionId()}/{task.taskAttemptId()}")
        for batch in batches:
            out = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number += 1
                out += records_of(str(uuid.uuid5(space, str(number))), page_id, url, payload, refers_to, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # The writer puts the bytes of a string as they are, whatever they are.
    lines = rows.mapInArrow(step, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, names in lower case, and block of each record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise BrokenArchive("a record does not begin as one")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        block = archive[end + 4 : end + 4 + size]
        at = end + 8 + size
        if len(block) < size or archive[at - 4 : at] != b"\r\n\r\n":
            raise BrokenArchive("a record is cut short")
        yield fields, block


def unzipped(content: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while content:
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        out += [member.decompress(content), member.flush()]
        if not member.eof:
            raise BrokenArchive("a file is cut short")
        content = member.unused_data
    return b"".join(out)


def _payload(block: bytes) -> bytes:
    """The body of an HTTP message, out of its chunks if it is in chunks."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        raise BrokenArchive("a block has no end of its header")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) else body


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """record_id, record_type, page_id, url, payload_digest and payload of each record below `path`, segments put together.

    A revisit has its digest and no payload. Records whose segments, length,
    chunks or digest do not fit raise an error.
    """
    number = re.compile(r"-?\d+")

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse(unzipped(content.as_py())):
                    page = fields.get("warc-page-id")
                    url = fields.get("warc-target-uri")
                    rows.append(
                        (
                            fields["warc-record-id"],
                            fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                            int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None,
                            int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
                            fields["warc-type"],
                            int(page) if page and number.fullmatch(page) and id_type != "string" else page,
                            url if url is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
                            fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            block,
                        )
                    )
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, heads = [], []
            for total, parts in zip(batch.column("total_length").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                parts.sort(key=lambda p: p["segment"])
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                    raise BrokenArchive("segments are missing")
                blocks.append(block)
                heads.append(parts[0])
            columns = [pa.array([h[n] for h in heads], t) for n, t in zip(names, kinds, strict=True) if n in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blocks, pa.binary())], [*kept, "block"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for kind, block, digest in zip(*(batch.column(n).to_pylist() for n in ("record_type", "block", "payload_digest")), strict=True):
                payloads.append(_payload(block) if kind == "response" else None)
                if payloads[-1] is not None and digest_of(payloads[-1]) != digest:
                    raise BrokenArchive("a payload does not have its digest")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(payloads, pa.binary())], [*kept, "payload"])

    names = [f.split()[0] for f in _SEGMENTS.split(", ")]
    id_arrow = pa.string() if id_type == "string" else pa.int64()
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), id_arrow, pa.string(), pa.string(), pa.binary()]
    kept = ["record_id", "record_type", "page_id", "url", "payload_digest"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    found = files.select("content").mapInArrow(read_files, _SEGMENTS.format(id=id_type))
    whole = found.where("segment IS NULL").select(*kept, "block")
    parts = (
        found.where("segment IS NOT NULL")
        .groupBy("origin_id")
        .agg(F.max("total_length").alias("total_length"), F.collect_list(F.struct("segment", *kept, "block")).alias("parts"))
        .mapInArrow(join_segments, whole.schema)
    )
    return whole.unionByName(parts).mapInArrow(decode, _RECORDS.format(id=id_type))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes `pages` to archives in the shared folder and reads them back: a row for each page.

    page_id, payload_bytes, payload_digest, record_type and refers_to, the
    page_id of the response that a revisit's digest leads to. Null html is an
    empty payload; a null page_id stays null. Integer and string ids only.
    """
    kind = "string" if pages.schema["page_id"].dataType.simpleString() == "string" else "bigint"
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write(pages, path, **options)
    records = read(spark, path, kind).select("page_id", "record_type", "payload_digest", F.length("payload").cast("long").alias("payload_bytes"))
    responses = records.where("record_type = 'response'")
    behind = responses.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(behind, "payload_digest")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast(kind)).select(columns).unionByName(revisits.select(columns))
