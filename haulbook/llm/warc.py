"""WARC archives: a writer, and a splittable reader of their gzip members.

`write` puts a record per page into one `.warc.gz` file per task, each record a gzip member of
its own. Of pages with equal payloads the one with the largest id is written in full, the
others as `revisit` records that name it. Files have new names in each attempt, and the table
`write` returns lists those of the attempts that succeeded, so a task that is run again does
no harm.

`read` cuts the files into byte ranges. A task looks for the gzip magic in its range, takes a
place for a member only if the first bytes unpack to a WARC header, and owns the records that
start inside its range, reading past its end for the last one.

Files are reached through `pyarrow.fs` (local and shared folders, HDFS, object stores), as
Spark has no writer for binary files of this kind.

Defined cases: null html is an empty payload; a null url gives a record without target; a null
page_id is never the largest unless all are null; repeated rows of the largest id are all
responses; payloads under `smallest` bytes are never revisits; an empty table gives files
without page records; a member that is cut short, or a record shorter than its Content-Length,
raises and is never returned in part. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map
from haulbook.session import fresh_dir, materialize

SMALLEST = 0
RANGE_BYTES = 4 << 20
#: Tasks of one read; from there on a task has several ranges.
MOST_TASKS = 50_000
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of a record that are unpacked to see whether it is one, and read at a time.
PROBE, STEP = 512, 1 << 20


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def page_member(page_id: int | None, url: str | None, payload: bytes, winner: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", page_urn(page_id)), ("WARC-Date", DATE),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", page_urn(winner)),
        ]
    return member(headers, http if revisit else http + payload)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def with_winners(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """page_id, url, html, winner, revisit. Winners are found from digests alone."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest")
    )
    winners = rows.groupBy("digest").agg(F.max("page_id").alias("winner"))
    revisit = (F.octet_length("html") >= smallest) & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.join(winners, "digest").select("page_id", "url", "html", "winner", revisit.alias("revisit"))


def write(pages: DataFrame, path: str, smallest: int = SMALLEST) -> DataFrame:
    """Writes the archives below `path`; returns their list: file, bytes, records."""

    def work(batches):
        files, name, out = None, f"{path.rstrip('/')}/pages-{uuid.uuid4().hex}.warc.gz", None
        records = size = 0
        try:
            for batch in batches:
                for page_id, url, html, winner, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "winner", "revisit"))):
                    if out is None:
                        files, at = _open(name)
                        files.create_dir(at.rpartition("/")[0], recursive=True)
                        out = files.open_output_stream(at, compression=None)  # packed already
                        info = b"software: pyspark\r\nformat: WARC File Format 1.1\r\n"
                        head = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info)
                        out.write(head)
                        size += len(head)
                    packed = page_member(page_id, url, html.encode(), winner, revisit)
                    out.write(packed)
                    size += len(packed)
                    records += 1
        finally:
            if out is not None:
                out.close()
        if records:
            yield {"file": [name], "bytes": [size], "records": [records]}

    return materialize(arrow_map(with_winners(pages, smallest), work, "file string, bytes long, records long"), "archives")


def members(source, start: int, end: int, size: int) -> Iterator[bytes]:
    """The unpacked members of an open file that start in [start, end).

    Each byte is read once and a record's bytes are gathered in a list, so the work is linear in
    its length. A member without its end raises.
    """

    def fetch(at: int, n: int) -> bytes:
        source.seek(at)
        got = source.read(min(n, size - at))
        if len(got) < min(n, size - at):
            raise EOFError(f"the archive ends before its {size} bytes")
        return got

    held, base, place = b"", start, start  # bytes of the file from `base` on
    while place < end:
        if base + len(held) < min(place + PROBE, size):
            held, base = held[place - base:] + fetch(base + len(held), STEP), place
        found = held.find(MAGIC, place - base)
        if found < 0:
            if base + len(held) >= size:
                return
            # The magic may be cut by the end of what is held.
            place = max(base + len(held) - len(MAGIC) + 1, place + 1)
            continue
        place = base + found
        if place >= end:
            return
        if base + len(held) < min(place + PROBE, size):
            continue
        try:
            begun = zlib.decompressobj(31).decompress(held[found:found + PROBE], PROBE).startswith(b"WARC/1.")
        except zlib.error:
            begun = False
        if not begun:
            place += 1
            continue
        unpack, parts, chunk, at = zlib.decompressobj(31), [], held[found:], place
        while True:
            parts.append(unpack.decompress(chunk))
            at += len(chunk)
            if unpack.eof:
                break
            if at >= size:
                raise EOFError(f"the member at byte {place} is cut short")
            chunk = fetch(at, STEP)
        held = unpack.unused_data
        base = place = at - len(held)
        yield b"".join(parts)


def record(raw: bytes) -> dict | None:
    """A page record's fields, with the digest of the payload as it was read; None for others."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    length = int(fields["Content-Length"])
    if len(block) < length:
        raise ValueError(f"{fields['WARC-Record-ID']} has {len(block)} bytes of {length}")
    block = block[:length]
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda urn: int(urn[10:-1]) if urn[10:-1] else None
    full = kind == "response"
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "payload_bytes": len(payload) if full else int(lines["Content-Length"]),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": None if full else number(fields["WARC-Refers-To"]),
        "payload": payload if full else None,
    }


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """The page records of archives (file, bytes), read in byte ranges by separate tasks."""
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long")))
    ranges = files.select("file", "bytes", begins.alias("begin"))
    # Rows of ranges are tiny: without a number, adaptive execution would give all of them to one task.
    tasks = min(max(ranges.count(), 1), MOST_TASKS)
    ranges = ranges.repartition(tasks, "file", "begin")
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        for batch in batches:
            for file, size, begin in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "begin"))):
                files, at = _open(file)
                with files.open_input_file(at) as source:
                    rows, held = [], 0
                    for raw in members(source, begin, min(begin + range_bytes, size), size):
                        row = record(raw)
                        if row is None:
                            continue
                        rows.append(row)
                        held += len(raw) if payloads else 200
                        if held > STEP:
                            yield {n: [r[n] for r in rows] for n in names}
                            rows, held = [], 0
                    yield {n: [r[n] for r in rows] for n in names}

    return arrow_map(ranges, work, schema)


def round_trip(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """Writes the pages as archives in the shared folder and returns what is read from them."""
    files = write(pages, fresh_dir(pages.sparkSession, "warc"), smallest)
    return read(files).drop("url")
