"""WARC archives: written by Spark tasks, read back by byte ranges.

Writer: a gzip member for each record, as the format advises. Of records with equal payloads of ``least`` bytes or more, the one with the smallest id is
a response and the others are revisits that refer to it. A task streams its records to files of its own, and only files that
a finished task names in the manifest count, so attempts that were lost leave nothing that is read.

Splittable reader: an archive is dealt in byte ranges. A task scans its range for the gzip magic, and a place is a record if the member there can be
decoded (checksum and length are right) to a WARC header that fits its content; after a record the scan goes on where its member ends. A task owns the records
that start inside its range, and reads past its end for the last one's rest. A place inside another member can look like a record, as in an archive that is a record's payload. So
ranges are chained first: a range whose first record starts before the records of earlier ranges end is walked again from that end, until all agree.
Damaged members are skipped; the next sound one is found by its magic.

Edge cases: a null payload is empty; payloads under ``least`` bytes are never revisits; rows with equal ids and payloads are all responses if the id is their
payload's smallest; a row without an id never leads, and is a revisit if its payload has a response with an id; an empty table gives no archive and no record;
line ends and control characters in a URL are percent-encoded; a record is held whole in memory by the task that owns it, so the longest payload bounds memory; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.llm.common import cut, join_hot, kept, shared_folder

LEAST, SPLIT, ARCHIVE = 100, 8 << 20, 1 << 30
MAGIC = b"\x1f\x8b\x08"
#: Bytes in which a record's header must end.
HEADER = 1 << 16
_END = b"\r\n\r\n"


def file_system(uri: str):  # noqa: ANN201
    """(file system, path in it) of a URI as Hadoop writes them."""
    from pyarrow import fs

    if re.match(r"file:/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", uri)) if ":/" in uri else (fs.LocalFileSystem(), uri)


# writing


def member(fields: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + _END) + packer.flush()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_of(key: str | None, url: str | None, payload: bytes, digest: str, lead: str | None, date: str) -> bytes:
    """The response, or the revisit of ``lead``, of one row."""
    name = f"<urn:page:{_clean(key or '')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if lead is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", _clean(url) if url else name[1:-1])]
    if lead is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{_clean(lead)}>")]
    block = http + payload if lead is None else http
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response")]
    return member(fields, block)


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, limit: int) -> Iterator[pa.RecordBatch]:
    system, place = file_system(folder)
    out, path, size, count, task = None, "", 0, 0, TaskContext.get().partitionId()

    def done() -> pa.RecordBatch:
        out.close()
        return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]}, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                # the name is this attempt's alone
                file = f"part-{task:05d}-{uuid.uuid4().hex}.warc.gz"
                path, size, count = f"{folder}/{file}", 0, 0
                out = system.open_output_stream(f"{place}/{file}", compression=None)
                size += out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{file}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            size += out.write(record_of(row["id"], row["url"], row["payload"], row["digest"], row["lead"], date))
            count += 1
            if size >= limit:
                yield done()
                out = None
    if out is not None:
        yield done()


def linked(pages: DataFrame, key: Column, url: Column, payload: Column, least: int = LEAST) -> DataFrame:
    """id, url, payload, digest and lead: the id of the response that a revisit refers to, null for a response. key is a whole number."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    rows = pages.select(key.cast("long").alias("id"), url.cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    groups = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    leads = cut(groups.where("n > 1 and first is not null"))
    met = join_hot(rows, leads, "digest", "n", F.col("id"))
    return met.select("id", "url", "payload", "digest", F.when((F.length("payload") >= least) & (F.col("id").isNull() | (F.col("id") > F.col("first"))), F.col("first")).alias("lead"))


def write(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", limit: int = ARCHIVE) -> DataFrame:
    """The manifest of archives in ``folder`` (a URI that all executors can write): path, bytes, records. rows: from ``linked``. Runs at once."""
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)
    texts = rows.withColumns({"id": F.col("id").cast("string"), "lead": F.col("lead").cast("string")})
    return kept(texts.mapInArrow(functools.partial(_write, folder=folder, date=date, limit=limit), "path string, bytes long, records long"), "warc-manifest")


# reading


class Tape:
    """Reads a file from any place, some of it ahead."""

    def __init__(self, file: pa.NativeFile, ahead: int = 1 << 20) -> None:
        self.file, self.ahead, self.start, self.data = file, ahead, 0, b""

    def read(self, at: int, n: int) -> bytes:
        k = at - self.start
        if k < 0 or k + n > len(self.data):
            self.file.seek(at)
            self.start, self.data, k = at, self.file.read(max(n, self.ahead)), 0
        return self.data[k : k + n]

    def find(self, at: int, end: int) -> int:
        """The first place of the magic from ``at`` on that starts before ``end``; -1 if there is none."""
        while at < end:
            block = self.read(at, min(self.ahead, end - at) + len(MAGIC) - 1)
            k = block.find(MAGIC)
            if k >= 0:
                return at + k
            at += max(1, len(block) - len(MAGIC) + 1)
        return -1

    def record(self, at: int) -> tuple[int, dict[str, str], bytes] | None:
        """(where its member ends, header fields, block) of the record at a place, None if there is no sound one."""
        unpack, parts, size, pos, step, body = zlib.decompressobj(31), [], 0, at, 1 << 13, -1
        while not unpack.eof:
            block = self.read(pos, step)
            if not block:
                return None
            try:
                part = unpack.decompress(block)
            except zlib.error:
                return None
            pos, size, step = pos + len(block), size + len(part), min(2 * step, 1 << 20)
            parts.append(part)
            if body < 0:
                head = b"".join(parts)[:HEADER]
                if not head.startswith(b"WARC/1."[: len(head)]):
                    return None
                body = head.find(_END)
                if body < 0 and len(head) == HEADER:
                    return None
        content = b"".join(parts)
        if body < 0:
            return None
        fields = fields_of(content[:body])
        length = fields.get("content-length", "")
        if not length.isdecimal() or body + 2 * len(_END) + int(length) != size or not content.endswith(_END):
            return None
        return pos - len(unpack.unused_data), fields, content[body + len(_END) : size - len(_END)]


def fields_of(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def walk(tape: Tape, at: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, end, fields, block) of the records that start in [at, end), one member after the other."""
    while (at := tape.find(at, end)) >= 0:
        got = tape.record(at)
        if got is None:
            at += 1
            continue
        yield at, *got
        at = got[0]


_WALKED = "path string, start long, end long, at long, first long, last long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            system, place = file_system(row["path"])
            row["first"] = row["last"] = None
            with system.open_input_file(place) as file:
                for start, stop, *_ in walk(Tape(file), row["at"], row["end"]):
                    row["first"], row["last"] = start if row["first"] is None else row["first"], stop
        whole = pa.int64()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), *[(c, whole) for c in ("start", "end", "at", "first", "last")]]))


def chained(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """path, first, end: where the first record of each byte range of ``files`` (path, bytes) starts; ranges in which none starts are left out."""
    parts = int(files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 0)
    every = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start")).select("path", "start", F.least(F.col("start") + split, "bytes").alias("end"))
    spread = lambda df: df.repartition(max(1, min(parts, 20_000)), "path", "start")
    seen = cut(spread(every.withColumn("at", F.col("start"))).mapInArrow(_walk, _WALKED))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        # ranges of one file are few; all that they say is a row each
        due = seen.withColumn("due", F.greatest("start", F.max("last").over(before)))
        odd = F.coalesce((F.col("first") < F.col("due")) | (F.col("due") < F.col("at")), F.lit(False))
        if not due.where(odd).limit(1).count():
            break
        again = spread(due.where(odd).select("path", "start", "end", F.col("due").alias("at"))).mapInArrow(_walk, _WALKED)
        seen = cut(due.where(~odd).select(*seen.columns).unionByName(again))
    return spread(seen.where("first is not null").select("path", "start", "first", "end"))


_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
                     ("digest", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())])


def _read(batches: Iterator[pa.RecordBatch], held: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, place = file_system(row["path"])
            with system.open_input_file(place) as file:
                rows, size = [], 0
                for start, stop, fields, block in walk(Tape(file), row["first"], row["end"]):
                    named = fields.get("warc-block-digest")
                    http = fields.get("content-type", "").startswith("application/http")
                    payload = block[block.find(_END) + len(_END) :] if http and _END in block else block
                    refers, digest = fields.get("warc-refers-to"), fields.get("warc-payload-digest")
                    rows.append({"path": row["path"], "offset": start, "length": stop - start, "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": refers,
                                 "digest": digest, "payload": payload, "intact": f"sha256:{hashlib.sha256(block).hexdigest()}" == named if named and named.startswith("sha256:") else None})
                    size += len(payload)
                    if size >= held:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)


def read(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """A row for each record of the archives in ``files`` (path, bytes): where it is, header fields, payload, and whether its block digest is right (null: none)."""
    return chained(files, split).mapInArrow(_read, "path string, offset long, length long, type string, record_id string, uri string, refers_to string, digest string, payload binary, intact boolean")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of the archives in a folder; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", F.col("length").alias("bytes"))


def resolved(records: DataFrame) -> DataFrame:
    """record_id, type, refers_to, payload_bytes, payload_digest (hexadecimal) of responses and revisits. A revisit has those of the response that it refers to, null if there is none.

    Digests and sizes are of the payloads read, not of what headers say.
    """
    small = records.where("type in ('response', 'revisit')").select("record_id", "type", "refers_to", F.length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"))
    small = kept(small, "warc-records")
    asked = small.where("type = 'revisit'").groupBy("refers_to").agg(F.count("*").alias("weight"))
    found = small.where("type = 'response'").groupBy("record_id").agg(F.min_by(F.struct("n", "sha"), F.struct("n", "sha")).alias("x")).select(F.col("record_id").alias("refers_to"), "x")
    leads = cut(asked.join(found, "refers_to").select("refers_to", "weight", F.col("x.n").alias("lead_n"), F.col("x.sha").alias("lead_sha")))
    met = join_hot(small.withColumn("refers_to", F.coalesce("refers_to", F.concat(F.lit("#"), "record_id"))), leads, "refers_to", "weight", F.col("record_id"))
    own = F.col("type") == "response"
    return met.select("record_id", "type", F.when(~own, F.col("refers_to")).alias("refers_to"), F.when(own, F.col("n")).otherwise(F.col("lead_n")).alias("payload_bytes"), F.when(own, F.col("sha")).otherwise(F.col("lead_sha")).alias("payload_digest"))


def through_archives(pages: DataFrame, key: Column, url: Column, payload: Column, split: int = SPLIT) -> DataFrame:
    """All rows written as records and read back: see ``resolved``."""
    manifest = write(linked(pages, key, url, payload), shared_folder(pages.sparkSession, "warc"))
    return resolved(read(manifest, split))
