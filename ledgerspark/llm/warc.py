"""WARC archives through a chunked record table.

Writing: pages are streamed into blocks of whole WARC records. A payload longer than ``chunk`` bytes
is written as WARC segments (a first record and ``continuation`` records) of a chunk each, and a
block ends with the chunk that fills it, so no block passes ``block`` bytes by more than a chunk and
its header. Spark's text writer puts each block into a file of its own, with the blank lines that
end a record as its line separator; so archives can lie in any store that Spark writes to.

Reading: every archive is parsed as it streams by into rows (record, chunk number, bytes). A payload
of one chunk is digested in place. The chunks of longer ones are dealt out by record, sorted by
chunk number and digested one after the other with a running SHA-256, so that no task ever holds a
whole payload.

Deduplication: of the pages with equal payloads of at least ``least`` bytes, the one with the
smallest page_id is written in full, the others as revisit records that refer to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, key_filter, materialize, scratch, table

CRLF = b"\r\n"
END = "\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def plan_records(pages: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """pages with payload_bytes, payload_digest, record_type and refers_to, in two parts: payloads that occur once, and the rest.

    Equal payloads are found by SHA-256. The digests that occur more than once go into a bitmap of
    fixed size; pages that it doesn't hold are written as they are read, and only the others are
    shuffled to meet the smallest page_id, by a join that Spark may split where a payload is hot. Of
    rows that repeat (the same page_id and payload) each is a response if its page_id is the
    smallest. A null page_id is never the smallest, unless all are null; then all are responses.
    Short and empty payloads are responses.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)})
    first = materialize(
        known.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select(F.col("payload_digest").alias("d"), "first_id"),
        "warc-copies",
    )
    copied = key_filter(first, "d")(F.col("payload_digest"))
    marked = known.withColumn("maybe", copied)
    once = marked.where(~F.col("maybe")).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast(pages.schema["page_id"].dataType)})
    joined = marked.where("maybe").join(first, F.col("payload_digest") == F.col("d"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    more = joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first_id"))})
    return once.drop("maybe"), more.drop("maybe", "d", "first_id")


def _header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + CRLF


def _clean(url: str | None) -> str | None:
    """A header's value holds no control characters: they and spaces are percent-encoded."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _quoted(value: str | None) -> str | None:
    """As _clean, and percent signs are encoded too, so that _unquoted() gives the value back."""
    return None if value is None else _clean(value.replace("%", "%25"))


def _unquoted(value: str | None) -> str | None:
    return None if value is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def _records(page_id, url, html, size, digest, kind, refers, key: str, date: str, chunk: int) -> Iterator[bytes]:
    """The page's records without the blank lines that end each."""
    rid = f"<urn:ledgerspark:{key}>"
    common = [("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("X-Page-Id", _quoted(page_id))]
    full = [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", size)]
    if kind == "revisit":
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _header([("WARC-Type", kind), ("WARC-Record-ID", rid), *common, ("WARC-Profile", profile), ("X-Refers-To-Page", _quoted(refers)), *full, ("Content-Length", 0)])
        return
    payload = memoryview((html or "").encode())
    pieces = max(1, -(-len(payload) // chunk))
    for k in range(pieces):
        piece = payload[k * chunk : (k + 1) * chunk]
        http = HTTP % len(payload) if k == 0 else b""
        segment = [("WARC-Segment-Number", k + 1), ("X-Segments", pieces)] if pieces > 1 else []
        if k == 0:
            head = [("WARC-Type", kind), ("WARC-Record-ID", rid), *common, *full, *segment, ("Content-Type", "application/http; msgtype=response")]
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:ledgerspark:{key}-{k + 1}>"), ("WARC-Segment-Origin-ID", rid), *segment]
            if k == pieces - 1:
                head.append(("WARC-Segment-Total-Length", len(payload) + len(HTTP % len(payload))))
        yield _header([*head, ("Content-Length", len(http) + len(piece))]) + http + bytes(piece)


def write_archives(planned: DataFrame, path: str, chunk: int = 1 << 16, block: int = 1 << 24, name: str = "warc", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write what plan_records() returns (page_id, url, html and its columns) as .warc files below path; name is part of the record ids."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0
        for b in batches:
            for row in zip(*(b[c] for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"))):
                page_id, url, html, length, digest, kind, refers = (None if x is None or x is pd.NA or x != x else x for x in row)
                for record in _records(page_id, url, html, length, digest, kind, refers, f"{name}-{task}-{n}", date, chunk):
                    held.append(record)
                    size += len(record)
                    if size >= block:
                        yield pd.DataFrame({"block": [END.encode().join(held)]})
                        held, size = [], 0
                n += 1
        if held:
            yield pd.DataFrame({"block": [END.encode().join(held)]})

    rows = planned.select(F.col("page_id").cast("string"), "url", "html", F.col("payload_bytes").cast("string"), "payload_digest", "record_type", F.col("refers_to").cast("string"))
    packed = rows.mapInPandas(pack, "block binary").select(F.col("block").cast("string"))
    packed.write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def _parse(content: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The records of an archive: header fields and block, the latter not copied."""
    raw, at = content.obj, 0
    while at < len(content):
        end = raw.find(END.encode(), at)
        if end < 0 or raw[at:end].split(CRLF, 1)[0] != b"WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in raw[at:end].decode().split("\r\n")[1:])
        start = end + 4
        stop = start + int(fields["Content-Length"])
        if raw[stop : stop + 4] != END.encode():
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, content[start:stop]
        at = stop + 4


CHUNKS = "record_id string, page_id string, record_type string, refers_to string, chunk_no int, chunks int, payload_bytes long, header_digest string, digest string, data binary"


def read_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The archives in these folders as rows of record and chunk number. Chunks of a payload of several carry data, others their digest."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for b in batches:
            for content in b["content"]:
                rows, held = [], 0
                for f, body in _parse(memoryview(content)):
                    kind, number = f["WARC-Type"], int(f.get("WARC-Segment-Number", 1))
                    if kind == "response":
                        body = body[bytes(body[:256]).index(END.encode()) + 4 :]
                    several = "X-Segments" in f
                    told = f.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
                    if kind == "revisit":
                        digest, length = told, int(f["X-Payload-Length"])
                    else:
                        digest, length = None if several else hashlib.sha256(body).hexdigest(), len(body)
                    rows.append((f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), _unquoted(f.get("X-Page-Id")), kind, _unquoted(f.get("X-Refers-To-Page")), number, int(f.get("X-Segments", 1)), length, told, digest, bytes(body) if several else None))
                    held += len(body) if several else 0
                    if held > 1 << 22 or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(paths).select("content")
    return files.mapInPandas(parse, CHUNKS)


RECORDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, header_digest string, chunks int"


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each record in the archives in these folders, with digest and length of its whole payload as read; revisits have those that they tell."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        running, length, expected, first = hashlib.sha256(), 0, 1, None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.chunk_no == 1:
                    running, length, expected, first = hashlib.sha256(), 0, 1, r
                if first is None or r.record_id != first.record_id or r.chunk_no != expected:
                    raise ValueError(f"chunk {r.chunk_no} of {r.record_id} is out of turn")
                running.update(r.data)
                length += len(r.data)
                expected += 1
                if r.chunk_no == r.chunks:
                    rows.append((first.page_id, length, running.hexdigest(), "response", None, first.header_digest, r.chunks))
                    first = None
            yield pd.DataFrame(rows, columns=names)

    table_ = materialize(read_chunks(spark, paths), "warc-chunks")
    single = table_.where("chunks = 1").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "header_digest", "chunks")
    several = table_.where("chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return single.unionByName(several.mapInPandas(chain, RECORDS))


def round_trip(pages: DataFrame, least: int = 100, chunk: int = 1 << 16, block: int = 1 << 24) -> DataFrame:
    """Write pages (page_id, url, html) as archives in the shared folder and read them back.

    A null html is an empty payload, a null url or page_id has no header field. Control characters and
    spaces of a page_id of text are percent-encoded in its header and come back as they were. Other columns are
    dropped. Rows that repeat are records of their own. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    path = scratch(spark, "warc")
    id_type = pages.schema["page_id"].dataType
    paths = []
    for name, part in zip(("once", "copied"), plan_records(pages.select("page_id", "url", "html"), least)):
        paths.append(f"{path}/{name}")
        write_archives(part, paths[-1], chunk, block, name)
    read = read_records(spark, paths)
    return read.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("header_digest") == F.col("payload_digest")).alias("verified"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
       true AS verified
FROM f
"""
