"""WARC archives: writing pages with revisits and segments, and reading them back by segment reassembly.

Writing: a page is a response record with its payload in chunked HTTP framing. Of pages with equal payloads of at least
``least`` bytes only the one with the smallest ``page_id`` holds it; the others are revisit records. A record's block
above ``segment`` bytes continues in continuation records, of which the last states the total length. Spark's text
writer writes the archives (``value`` holds a record's bytes, the line end completes it), each a gzip file.

Reading: archives are cut into records by their stated lengths, never by looking for markers. Whole records are decoded
where they are; segments are grouped by origin identifier, ordered by segment number, checked for gaps and against the
total length, joined and decoded. A revisit takes its facts from the response that it names.

A null payload is empty; empty payloads are equal. A null ``page_id`` is written without a number: such a page is a
response of its own unless a numbered page has the same payload. Rows that repeat a ``page_id`` are written each; with
the payload's smallest number all of them are responses. A record that lacks a segment, or whose framing is broken, has
``complete`` false and null facts. An empty table gives one empty archive or none. One segment's block, one archive
and one page's payload are the largest things that a task holds.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import stored

SEGMENT, CHUNK, LEAST = 16 << 10, 4 << 10, 0
RECORDS_PER_FILE = 10_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE, _REFERS = "Loomlog-Page-ID", "Loomlog-Refers-To-Page"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

PARSED = (
    "record_id string, origin_id string, segment int, total long, record_type string, page_id long, "
    "refers_to long, digest string, block binary, payload_bytes long, payload_digest string, complete boolean"
)
_PARSED_TYPES = [
    pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(),
    pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_(),
]
_PARSED_NAMES = [field.split()[0] for field in PARSED.split(", ")]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """A payload in chunked transfer framing."""
    parts = (payload[n:n + size] for n in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes | None:
    """The payload of a chunked framing; None if it is broken. Chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or framed[at + size:at + size + 2] != b"\r\n":
            return None
        parts.append(framed[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last byte, which is the line end that the text writer adds."""
    lines = [b"WARC/1.1"]
    for name, value in fields:
        if value is not None:
            lines.append(f"{name}: {' '.join(str(value).split())}".encode())
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r"


def records(
    unique: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT
) -> list[bytes]:
    """The records of one page: one, or a first one and its continuations. ``unique`` makes the identifiers."""
    name = f"<urn:uuid:{uuid.uuid5(_NAMES, unique)}>"
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url or None),
        (_PAGE, page_id), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        fields[0] = ("WARC-Type", "revisit")
        return [_record([*fields, ("WARC-Profile", PROFILE), (_REFERS, refers_to)], HTTP)]
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        return [_record(fields, block)]
    found = [_record([*fields, ("WARC-Segment-Number", 1)], block[:segment])]
    for number, at in enumerate(range(segment, len(block), segment), 2):
        found.append(_record([
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, f'{unique}/{number}')}>"),
            ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if at + segment >= len(block) else None),
        ], block[at:at + segment]))
    return found


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT, least: int = LEAST) -> None:
    """Write ``page_id``, ``url`` and ``html`` of all pages to WARC files in ``folder``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    same = F.sha2("payload", 256)
    shared = F.octet_length("payload") >= least
    firsts = stored(
        rows.filter(shared).groupBy(same.alias("first_digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")).filter("pages > 1").drop("pages"),
        "warc-firsts",
    )
    typed = rows.join(firsts, shared & (same == F.col("first_digest")), "left").select(
        "page_id", "url", "payload",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            held: list[bytes] = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                count += 1
                held += records(f"{task}/{count}/{page_id}", page_id, url, payload, refers_to, segment)
                if len(held) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    typed.mapInArrow(write, "value binary").select(F.col("value").cast("string")).write.options(
        lineSep="\n", compression="gzip", maxRecordsPerFile=RECORDS_PER_FILE
    ).text(folder)


class _Stream:
    """Bytes of a gzip file, unpacked as they are read."""

    def __init__(self, packed: bytes):
        self.packed, self.at = memoryview(packed), 0
        self.unpack = zlib.decompressobj(31)
        self.held = b""

    def _more(self) -> bool:
        while True:
            if self.unpack.eof:
                rest = self.unpack.unused_data
                if not rest and self.at >= len(self.packed):
                    return False
                self.unpack = zlib.decompressobj(31)
                new = self.unpack.decompress(rest) if rest else b""
            elif self.at < len(self.packed):
                new = self.unpack.decompress(self.packed[self.at:self.at + (1 << 16)])
                self.at += 1 << 16
            else:
                return False
            if new:
                self.held += new
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.held.find(mark)) < 0:
            if not self._more():
                return None
        found, self.held = self.held[:end], self.held[end + len(mark):]
        return found

    def take(self, size: int) -> bytes | None:
        parts, have = [self.held], len(self.held)
        while have < size:
            self.held = b""
            if not self._more():
                return None
            parts.append(self.held)
            have += len(self.held)
        data = b"".join(parts)
        self.held = data[size:]
        return data[:size]


def archive_records(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive; a cut last record is passed over."""
    stream = _Stream(packed)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        first, *lines = head.lstrip(b"\r\n").decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        block = stream.take(int(fields["content-length"]))
        if block is None or stream.take(4) is None:
            return
        yield fields, block


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind, name = fields["warc-type"], fields["warc-record-id"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    segment = _number(fields.get("warc-segment-number"))
    known = (
        name, fields.get("warc-segment-origin-id", name), segment, _number(fields.get("warc-segment-total-length")),
        kind, _number(fields.get(_PAGE.lower())), _number(fields.get(_REFERS.lower())), digest,
    )
    if segment is not None:
        return (*known, block, None, None, None)
    if kind == "revisit":
        return (*known, None, None, None, None)
    return (*known, None, *_facts(http_payload(block), digest))


def _facts(payload: bytes | None, stated: str | None) -> tuple[int | None, str | None, bool]:
    if payload is None:
        return None, None, False
    digest = payload_digest(payload)
    return len(payload), digest, stated in (None, digest)


def _parsed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_PARSED_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PARSED_TYPES)], names=_PARSED_NAMES)


def parse_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records: whole responses decoded, segments with their blocks, revisits with what they refer to."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                held = []
                for fields, block in archive_records(packed.as_py()):
                    held.append(_row(fields, block))
                    if len(held) >= 64:
                        yield _parsed(held)
                        held = []
                yield _parsed(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.filter("length > 0").select("content").mapInArrow(parse, PARSED)


def reassembled(parsed: DataFrame) -> DataFrame:
    """Segmented records put together: the first segment's facts, and what the joined block holds."""
    groups = parsed.filter(F.col("segment").isNotNull()).groupBy("origin_id").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("segments"),
        F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"),
        F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
    )
    numbers = F.transform("segments", lambda s: s["segment"])
    length = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["block"]))
    whole = (numbers == F.sequence(F.lit(1), F.size("segments"))) & (length == F.col("total"))
    # A binary array is joined as strings of the same bytes.
    block = F.array_join(F.transform("segments", lambda s: s["block"].cast("string")), "").cast("binary")
    joined = groups.select(
        "page_id", "record_type", "digest", F.when(whole, block).alias("block")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [
                _facts(None if block is None else http_payload(block), digest)
                for digest, block in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            sizes, digests, complete = list(zip(*facts)) or ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(complete, pa.bool_())],
                names=["page_id", "record_type", "payload_bytes", "payload_digest", "complete"],
            )

    return joined.mapInArrow(
        decode, "page_id long, record_type string, payload_bytes long, payload_digest string, complete boolean"
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``complete``."""
    parsed = stored(parse_archives(spark, folder), "warc-records")
    responses = parsed.filter(F.col("segment").isNull() & (F.col("record_type") == "response")).select(
        "page_id", "record_type", "payload_bytes", "payload_digest", "complete"
    ).unionByName(reassembled(parsed))
    named = stored(
        responses.filter("complete").groupBy(F.col("page_id").alias("response_id"), "payload_digest").agg(
            F.max("payload_bytes").alias("payload_bytes")
        ),
        "warc-responses",
    )
    revisits = parsed.filter(F.col("record_type") == "revisit").select(
        "page_id", "record_type", "refers_to", F.col("digest").alias("payload_digest")
    )
    # A revisit is complete if the response that it names holds the payload that it states.
    answered = revisits.join(
        named, (F.col("refers_to") == F.col("response_id")) & (revisits.payload_digest == named.payload_digest), "left"
    ).select(
        "page_id", "payload_bytes", F.when(F.col("response_id").isNotNull(), revisits.payload_digest).alias("payload_digest"),
        "record_type", "refers_to", F.col("response_id").isNotNull().alias("complete"),
    )
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "complete"
    ).unionByName(answered)
