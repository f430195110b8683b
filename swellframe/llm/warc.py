"""WARC archives: written with revisit records, indexed first, read back by coalesced byte ranges.

`write_archives` writes one gzip-member record per page into archives in a shared folder and returns the index:
page_id, url, record_type, refers_to, digest, archive, start, length. `read_records` takes any selection of index rows and
reads their records: rows are dealt by archive and stretch, sorted by offset, and neighbouring ranges become one read.

Of pages with equal payloads of at least `revisit_from` bytes the one with the smallest page_id is a response, the others
are revisits that refer to it. The choice is a grouped minimum joined back by digest; the pages of a very common
payload spread over many tasks (skew join), as none of them is needed in the same place as another.

The folder is opened through pyarrow.fs by its URI (file, hdfs, s3, gs). A task that is run again writes new files; only files that the
stored index names are ever read.

Defined results: null html is an empty payload, null url an empty one; pages without page_id are revisits if an equal payload has
one, else responses; rows that tie for the smallest page_id are all responses; an empty table writes no archive.
"""

from __future__ import annotations

import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, scratch, stored

#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Ranges with at most this much between them are read together, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 128 << 10, 8 << 20
#: Index rows of one such stretch of an archive go to one task; most tasks.
STRETCH_BYTES, MOST_TASKS = 8 << 20, 100_000
#: Bytes of payloads that are Python objects at once.
HELD_BYTES = 8 << 20
INDEX = "page_id bigint, url string, record_type string, refers_to bigint, digest string, archive string, start bigint, length bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, digest string, payload binary"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def _line(text: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text or "")


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parsed(member: bytes) -> tuple:
    """page_id, url, record type, refers_to, digest and payload of a gzip-member record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], refers, fields["WARC-Payload-Digest"].removeprefix("sha256:"), payload


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of all pages (page_id, url, html) in the folder; the index, stored."""
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"digest": F.sha2("payload", 256), "large": F.octet_length("payload") >= revisit_from})
    first = stored(p.where("large").groupBy("digest").agg(F.min("page_id").alias("first")), "first")
    p = p.join(first, "digest", "left")
    p = p.withColumn("revisit", F.coalesce(F.col("large") & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    p = p.select("page_id", "url", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "digest", F.when(~F.col("revisit"), F.col("payload")).alias("payload"))

    def written(batches):
        where, path = _folder(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                if out is not None and at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                starts, lengths, names = [], [], []
                for row in batch.to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        where.create_dir(path, recursive=True)
                        out = where.open_output_stream(f"{path}/{name}", compression=None)
                    member = record(row["page_id"], row["url"], row["record_type"], row["refers_to"], row["digest"], row["payload"], date)
                    out.write(member)
                    starts.append(at)
                    lengths.append(len(member))
                    names.append(name)
                    at += len(member)
                kept = [batch.column(c) for c in ("page_id", "url", "record_type", "refers_to", "digest")]
                kept += [pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())]
                index = pa.RecordBatch.from_arrays(kept, names=["page_id", "url", "record_type", "refers_to", "digest", "archive", "start", "length"])
                yield index
        finally:
            if out is not None:
                out.close()

    return stored(p.mapInArrow(releasing(written), INDEX), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index rows; a revisit has no payload of its own."""

    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = [c.split(" ")[0] for c in RECORDS.split(", ")]

    def as_batch(records: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*records, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def read(batches):
        where, path = _folder(folder)
        name, source = None, None
        for batch in batches:
            rows = list(zip(batch.column("archive").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist(), strict=True))
            i, out, held = 0, [], 0
            while i < len(rows):
                archive, begin, length = rows[i]
                end, j = begin + length, i + 1
                while j < len(rows) and rows[j][0] == archive and rows[j][1] - end <= GAP_BYTES and rows[j][1] + rows[j][2] - begin <= READ_BYTES:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                if archive != name:
                    name, source = archive, where.open_input_file(f"{path}/{archive}")
                data = source.read_at(end - begin, begin)
                for _, s, n in rows[i:j]:
                    out.append(parsed(data[s - begin : s - begin + n]))
                    held += len(out[-1][-1] or b"")
                    if held >= HELD_BYTES:
                        yield as_batch(out)
                        out, held = [], 0
                i = j
            yield as_batch(out)

    stretch = F.floor(F.col("start") / STRETCH_BYTES)
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = min(MOST_TASKS, -(-total // STRETCH_BYTES) or 1)
    dealt = index.select("archive", "start", "length").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(releasing(read), RECORDS)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to as the archives have them.

    Size and digest are computed from payloads that were read; a revisit has those of the record it refers to.
    """
    folder = scratch(spark, "warc")
    records = read_records(write_archives(pages, folder), folder)
    seen = stored(records.select("page_id", "url", "record_type", "refers_to", "digest", F.octet_length("payload").cast("bigint").alias("n"), F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("sha")), "records")
    response = seen.where("record_type = 'response'").select("page_id", "url", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", "refers_to")
    revisit = seen.where("record_type = 'revisit'").select("page_id", "url", "digest", "refers_to")
    target = response.select(F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("digest")).distinct()
    target = stored(target.join(revisit.select("refers_to", "digest").distinct(), ["refers_to", "digest"], "left_semi"), "targets")
    revisit = revisit.join(target, ["refers_to", "digest"]).select("page_id", "url", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return response.unionByName(revisit)


SQL = """
with p as (select page_id, sha256(coalesce(html, '')) d, strlen(coalesce(html, ''))::bigint n from pages),
f as (select d, min(page_id) first from p where n >= 100 group by d)
select page_id, n payload_bytes, p.d payload_digest,
  case when n >= 100 and page_id is distinct from first and first is not null then 'revisit' else 'response' end record_type,
  case when n >= 100 and page_id is distinct from first then first end refers_to
from p left join f using (d)
"""
