"""Legacy archive converter: ARC files become WARC files.

An ARC file opens with a version block that names the version and the fields of every header line that
follows; version 1 has five fields, version 2 ten. The last field is the declared length of the body.
The converter reads header lines by the fields the file itself declares, takes exactly the declared
bytes, and synthesises what WARC wants beside them: record ids, ISO timestamps, record types, block and
payload digests. Records whose payload another record already holds become revisits.

Archives are gzip members, one a record, in the shared folder; file names carry the task attempt, and
only files named in a stored manifest are read, so a lost or repeated task leaves nothing behind that counts.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.runtime import drop_stored, remove, scratch_path, shuffle_partitions, store

# Fixed values of the ARC and WARC formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURED = "20240101000000"
NO_ADDRESS = "0.0.0.0"
#: An archive is closed beyond so many bytes before compression.
ROLL_BYTES = 64 << 20
PAGE_HEADER = "X-Page-Id"


class ArchiveError(ValueError):
    """A header line, a length or a digest that the format does not allow."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def member(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


# --- ARC -------------------------------------------------------------------------------------------


def arc_version_block(name: str, version: int, date: str = CAPTURED) -> bytes:
    body = f"{version} 0 lociweave\n{ARC_FIELDS[version]}\n\n".encode()
    extra = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} {NO_ADDRESS} {date} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, body: bytes, name: str, offset: int, date: str = CAPTURED, kind: str = "text/html") -> bytes:
    extra = "" if version == 1 else f"200 {sha1_base32(body)} - {offset} {name} "
    return f"{url} {NO_ADDRESS} {date} {kind} {extra}{len(body)}\n".encode() + body + b"\n"


@dataclass
class ArcRecord:
    number: int
    version: int
    fields: dict
    body: bytes


def read_arc(stream):
    """Records of an ARC file after its version block, which comes first with number -1.

    Header lines must have as many fields as the version block declares; bodies are taken by declared
    length, whatever they contain. Anything else raises :class:`ArchiveError`.
    """
    names = ARC_FIELDS[1].lower().split()
    version, number = 0, -1
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\n":
            continue
        parts = line.decode("utf-8", "replace").rstrip("\n").split(" ")
        if number < 0:
            if not parts[0].startswith("filedesc://"):
                raise ArchiveError("no version block")
            size = _length(parts[-1])
            body = _exactly(stream, size)
            head = body.decode("utf-8", "replace").split("\n")
            found = re.match(r"(\d+) ", head[0])
            version = int(found[1]) if found else 0
            if version not in ARC_FIELDS or len(head) < 2:
                raise ArchiveError(f"unknown version: {head[0][:40]!r}")
            names = head[1].lower().split()
            yield ArcRecord(-1, version, {"url": parts[0], "archive-date": parts[2]}, body)
        else:
            if len(parts) != len(names):
                raise ArchiveError(f"record {number}: {len(parts)} fields, {len(names)} declared")
            fields = dict(zip(names, parts, strict=True))
            yield ArcRecord(number, version, fields, _exactly(stream, _length(fields["archive-length"])))
        number += 1


def _length(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise ArchiveError(f"length {text[:20]!r}")
    return int(text)


def _exactly(stream, size: int) -> bytes:
    data = stream.read(size)
    if len(data) != size:
        raise ArchiveError(f"{size} bytes declared, {len(data)} there")
    return data


def split_http(body: bytes) -> tuple[bytes, bytes] | None:
    """Headers (with the empty line) and payload of a stored response; None if it is not one."""
    if not body.startswith(b"HTTP/"):
        return None
    head, gap, payload = body.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else None


# --- WARC ------------------------------------------------------------------------------------------


def warc_date(date: str) -> str:
    """ISO form of ARC's 14 digits; shorter dates are filled up."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else CAPTURED
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def record_id(archive: str, number: int) -> str:
    """The same for the same place in an archive, so a converter that runs again gives the same ids."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def convert(record: ArcRecord, archive: str, refers: str | None = None) -> bytes:
    """The WARC record of an ARC record: warcinfo, response, revisit (if ``refers`` is an id) or resource."""
    base = [("WARC-Record-ID", record_id(archive, record.number)), ("WARC-Date", warc_date(record.fields["archive-date"]))]
    if record.number < 0:
        return warc_record([("WARC-Type", "warcinfo"), *base, ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], f"software: lociweave\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/{record.version}\r\n".encode())
    base += [("WARC-Target-URI", record.fields["url"]), ("WARC-IP-Address", record.fields["ip-address"])]
    parts = split_http(record.body)
    if parts is None:
        return warc_record([("WARC-Type", "resource"), *base, ("Content-Type", record.fields["content-type"]), ("WARC-Payload-Digest", "sha1:" + sha1_base32(record.body))], record.body)
    head, payload = parts
    base += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload))]
    if refers:
        return warc_record([("WARC-Type", "revisit"), *base, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers)], head)
    return warc_record([("WARC-Type", "response"), *base], record.body)


def read_warc(stream):
    """(headers in lower case, block) of every record; checks lengths, ends and block digests."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not re.fullmatch(rb"WARC/1\.[01]\r\n", line):
            raise ArchiveError(f"no record starts here: {line[:30]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = _exactly(stream, _length(headers.get("content-length", "")))
        if stream.read(4) != b"\r\n\r\n":
            raise ArchiveError("no end of record")
        if headers.get("warc-block-digest", "sha1:" + sha1_base32(block)) != "sha1:" + sha1_base32(block):
            raise ArchiveError("block digest")
        yield headers, block


# --- On a cluster ----------------------------------------------------------------------------------


def _opened(uri: str):
    system, path = pafs.FileSystem.from_uri(uri)
    return gzip.GzipFile(fileobj=io.BufferedReader(system.open_input_stream(path, compression=None), 1 << 20))


class _Output:
    """A gzip archive under the shared folder."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.file, self.size = uri, system.open_output_stream(path, compression=None), 0

    def add(self, data: bytes) -> None:
        self.file.write(member(data))
        self.size += len(data)

    def close(self) -> None:
        self.file.close()


INDEX = "arc string, number long, record_id string, page_id long, payload_digest string, payload_bytes long"


def write_arcs(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Store (page_id, url, html) as ARC files below ``folder``, every second one of version 2; gives their index."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches):
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        files, out, name, version, number = 0, None, "", 1, 0
        for batch in batches:
            index = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or out.size > roll_bytes:
                    if out:
                        out.close()
                    version, name, number = 1 + (part + files) % 2, f"pages-{part:06d}-{files:04d}", 0
                    out, files = _Output(f"{folder}/{name}-{attempt}.arc.gz"), files + 1
                    out.add(arc_version_block(name, version))
                payload = html.encode("utf-8", "surrogatepass")
                page = "" if page_id is None else f"{PAGE_HEADER}: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode()
                target = re.sub(r"[\s\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:page"
                out.add(arc_record(version, target, head + payload, name, out.size))
                index.append((out.uri, number, record_id(name, number), page_id, sha1_base32(payload), len(payload)))
                number += 1
            if index:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    return rows.mapInArrow(run, INDEX)


def convert_arcs(plan: DataFrame, folder: str) -> DataFrame:
    """(arc, number, refers) for all records of the ARC files -> the WARC files written, with their numbers of records."""
    rows = plan.select("arc", "number", "refers").repartition(shuffle_partitions(plan.sparkSession), "arc").sortWithinPartitions("arc", "number")

    def run(batches):
        attempt = TaskContext.get().taskAttemptId()
        arc, records, out, name, done = None, None, None, "", 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([out.uri]), pa.array([done], pa.int64())], names=["warc", "records"])

        for batch in batches:
            for uri, number, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != arc:
                    if out:
                        yield closed()
                    arc, done = uri, 0
                    name = re.sub(r"-\d+\.arc\.gz$", "", uri.rpartition("/")[2])
                    records = read_arc(_opened(uri))
                    out = _Output(f"{folder}/{name}-{attempt}.warc.gz")
                    out.add(convert(next(records), name))
                record = next(records)
                if record.number != number:
                    raise ArchiveError(f"{uri}: record {record.number} where {number} is planned")
                out.add(convert(record, name, refers))
                done += 1
        if out:
            yield closed()

    return rows.mapInArrow(run, "warc string, records long")


RECORDS = "record_id string, record_type string, page_id long, payload_digest string, payload_bytes long, refers string"


def read_warcs(files: DataFrame) -> DataFrame:
    """What the WARC files in column ``warc`` hold: responses with their payload checked, and revisits."""
    spread = files.select("warc").repartition(shuffle_partitions(files.sparkSession), "warc")

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_warc(_opened(uri)):
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if headers["warc-type"] == "response" and (digest != sha1_base32(payload) or int(http["Content-Length"]) != len(payload)):
                        raise ArchiveError(f"{uri}: payload of {headers['warc-record-id']}")
                    page = http.get(PAGE_HEADER)
                    rows.append((headers["warc-record-id"], headers["warc-type"], None if page is None else int(page), digest, int(http["Content-Length"]), headers.get("warc-refers-to")))
                    if len(rows) == 10_000:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    return spread.mapInArrow(run, RECORDS)


def _records(rows):
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write ``pages`` as ARC, convert to WARC; gives the WARC folder and a table of its files.

    Of records with equal payloads of at least ``min_bytes`` the one with the smallest page_id is the
    response (a null id is smallest; of rows with the same id the first by place), the others revisit it.
    Null html is an empty payload, a null url becomes ``urn:page``. No pages, no files. Columns beside
    page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "archives")
    index = store(write_arcs(pages, f"{folder}/arc"), "arc-index")
    place = F.struct("page_id", "arc", "number", "record_id")
    first = index.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(place).alias("first"))
    same = (F.col("first.arc") == F.col("arc")) & (F.col("first.number") == F.col("number"))
    plan = index.join(first, ["payload_digest", "payload_bytes"], "left").select("arc", "number", F.when(F.col("first").isNotNull() & ~same, F.col("first.record_id")).alias("refers"))
    files = store(convert_arcs(plan, f"{folder}/warc"), "warc-files")
    remove(spark, f"{folder}/arc")
    drop_stored(index)
    return f"{folder}/warc", files


def op2_warc(spark, sf_dir):
    _, files = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    records = read_warcs(files)
    if not files.limit(1).count():
        return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    records = store(records, "warc-records")
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = records.filter("record_type <> 'response'").join(responses, "refers", "left").select(columns)
    return records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionAll(revisits)
