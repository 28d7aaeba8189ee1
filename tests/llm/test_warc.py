"""WARC archives against the plain rule, and the splittable reader against a whole-file reader."""

import gzip
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from assaykit.llm import warc
from assaykit.llm.common import shared_folder

def columns():
    return [F.col(c) for c in ("page_id", "url", "html")]


def plain(rows):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in body:
        first = min((j for j, c in body if c == b and j is not None), default=None) if len(b) >= 100 else None
        lead = first if first is not None and (i is None or i > first) else None
        out.append((f"<urn:page:{'' if i is None else i}>", "response" if lead is None else "revisit", None if lead is None else f"<urn:page:{lead}>", len(b), hashlib.sha256(b).hexdigest()))
    return sorted(out, key=str)


def rows_of():
    rng = random.Random(5)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(300_000))
    rows = [(k, f"http://h/{k}", "copy " * 40) for k in range(10, 40)] + [(k, None, "short") for k in range(40, 44)] + [(44, "a b\r\nX: y", noise), (45, "u", noise), (46, "u", ""), (47, "u", None)]
    rows += [(10, "http://h/10", "copy " * 40), (None, "u", "copy " * 40), (None, "u", "lone " * 40), (None, "u", "lone " * 40), (48, "u", "x" * 99), (49, "u", "x" * 99), (50, "u", "é" * 50), (51, "u", "é" * 50)]
    return rows


def test_through_archives_against_plain(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for split in (warc.SPLIT, 700):
        got = warc.through_archives(df, *columns(), split=split).select("record_id", "type", "refers_to", "payload_bytes", "payload_digest").collect()
        assert sorted(map(tuple, got), key=str) == plain(rows)


def test_clashing_columns_and_empty_table(spark):
    extra = ["id", "url_", "payload", "digest", "lead", "first", "n", "_hot", "_key", "weight", "path", "type"]
    df = spark.createDataFrame([(1, "u", "t" * 200, *[7] * len(extra)), (2, "u", "t" * 200, *[7] * len(extra))], f"page_id long, url string, html string, {', '.join(f'`{c}` int' for c in extra)}")
    assert sorted(r.type for r in warc.through_archives(df, *columns()).collect()) == ["response", "revisit"]
    assert warc.through_archives(df.limit(0), *columns()).count() == 0


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_reader_nested_and_damaged(spark, split):
    """A payload that is itself an archive, stored without compression, and a member with a broken byte."""
    folder = shared_folder(spark, "nested")
    inner = b"".join(warc.member([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:inner:{k}>")], b"inside %d" % k) for k in range(30))
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:outer>\r\nContent-Length: %d\r\n\r\n" % len(inner)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = packer.compress(head + inner + b"\r\n\r\n") + packer.flush()
    others = [warc.member([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:r:{k}>")], random.Random(k).randbytes(400)) for k in range(20)]
    broken = bytearray(others[7])
    broken[60] ^= 0xFF
    data = b"".join(others[:5]) + outer + b"".join(others[5:7]) + bytes(broken) + b"".join(others[8:])
    system, place = warc.file_system(folder)
    system.create_dir(place)
    with system.open_output_stream(f"{place}/a.warc.gz", compression=None) as out:
        out.write(data)
    with system.open_output_stream(f"{place}/empty.warc.gz", compression=None):
        pass
    got = warc.read(warc.archives(spark, folder), split).collect()
    assert sorted(r.record_id for r in got) == sorted(["<urn:outer>", *[f"<urn:r:{k}>" for k in range(20) if k != 7]])
    assert next(bytes(r.payload) for r in got if r.record_id == "<urn:outer>") == inner
    assert sum(r.length for r in got) == len(data) - len(broken)


def test_archives_are_gzip_members_with_headers(spark):
    df = spark.createDataFrame(rows_of(), "page_id long, url string, html string").repartition(2)
    folder = shared_folder(spark, "plain")
    manifest = warc.write(warc.linked(df, *columns()), folder, limit=2_000).collect()
    system, _ = warc.file_system(folder)
    assert sum(r.records for r in manifest) == len(rows_of()) and len(manifest) > 2
    for r in manifest:
        with system.open_input_file(warc.file_system(r.path)[1]) as file:
            raw = file.read()
        whole = gzip.decompress(raw)
        assert len(raw) == r.bytes and len(re.findall(rb"WARC/1\.1\r\nWARC-Type: (?:response|revisit)", whole)) == r.records
    assert all(r.intact in (True, None) for r in warc.read(spark.createDataFrame(manifest), 999).collect())
