"""WARC archives: writing with revisit records, and a splittable reader (operator 7)."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.files import NewFile, open_at
from tessera.llm.shared import materialize, new_path, require

#: Fixed values of the formats: gzip's first bytes (deflate), how a version line begins, the version written here, and what an archive made here is dated.
GZIP_MAGIC, ANY_VERSION, VERSION, DATE = b"\x1f\x8b\x08", b"WARC/1.", b"WARC/1.1", "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or with `refers_to` a revisit, which has the
    response's HTTP headers and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url) if url is not None else None
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {uri}"] if uri is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time, so equal records give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = 0, pages_per_file: int = 5000,
) -> DataFrame:
    """(path, bytes) of the archives written under `folder`: a gzip member for every row.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of
    `min_revisit_bytes` or more the smallest id is a response (rows that share it, too) and the others are revisits of it, rows with
    a null id included; if all ids are null, all are responses. The smallest id of a digest is found with
    map-side combining and joined back by an equi-join that splits skewed
    partitions; payloads cross the network once, to the task that writes them.
    """
    require(pages, id_col, url_col, html_col)
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("payload")).withColumn("sha", F.sha1("payload"))
    firsts = materialize(
        slim.where(F.length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("sha").alias("digest"), "first"),
        "digests",
    )
    rows = slim.join(firsts, F.col("sha") == F.col("digest"), "left").select(
        "id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to")
    )
    files = max(1, -(-pages.count() // pages_per_file))
    dealt = rows.repartition(files, F.xxhash64("id", "url", "payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = NewFile(f"{folder}/part-{task.partitionId():06d}.warc.gz", str(task.taskAttemptId()))
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, refers = (batch.column(k)[i].as_py() for k in range(4))
                out.write(member(record(page, url, payload, payload_digest(payload), refers)))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([out.name]), pa.array([out.size], pa.int64())], ["path", "bytes"])

    # a row a file: dealt to a few tasks, so that the table isn't as many files as the archives
    return materialize(dealt.mapInArrow(run, "path string, bytes long").repartition(1 + files // 10_000), "warc-files")


def parse_record(data: bytes) -> dict:
    """The fields of a whole record of any type and any version 1. What a record doesn't have is null; the payload is that of
    an HTTP response or request, or the whole block of another record that isn't a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    kind, length = fields.get("warc-type"), fields.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest
    http, parted, payload = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "").startswith("application/http"):
        http, payload = b"", block
    elif not parted:
        http, payload = block, b""
    lengths = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = fields.get("warc-payload-digest")
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").rpartition(":")[2]).lstrip("-").isdigit() else None
    revisit = kind == "revisit"
    return {
        "page_id": number("warc-record-id"),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "payload": None if revisit else payload,
        "payload_bytes": (int(lengths[0]) if lengths and lengths[0].isdigit() else None) if revisit else len(payload),
        "payload_digest": digest.partition(":")[2] if digest and digest.lower().startswith("sha1:") else None,
        "refers_to": number("warc-refers-to"),
    }


class Damage(ValueError):
    """Bytes of an archive that belong to no whole record."""


def records_starting_in(f, start: int, end: int, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record bytes) of the members of an open file that start in [start, end).

    Bytes are scanned for the gzip magic; a candidate counts if what it inflates
    to begins with a WARC version line and the member ends well (its CRC is
    right), since the magic also occurs by chance inside compressed data. Scanning
    goes on behind a member's end; a record that runs past `end` is read to its end."""
    at, window, base, size = start, b"", start, f.size()
    while at < end:
        while len(window) - (at - base) < len(GZIP_MAGIC) and base + len(window) < size:
            window, base = window[at - base :], at
            f.seek(base + len(window))
            window += f.read(chunk)
        found = window.find(GZIP_MAGIC, at - base)
        if found < 0:
            tail = base + len(window)
            if tail >= size:
                return
            at = max(at, tail - len(GZIP_MAGIC) + 1)
            window, base = window[at - base :], at
            f.seek(base + len(window))
            window += f.read(chunk)
            continue
        at = base + found
        if at >= end:
            return
        data, used = _inflate(f, window[found:], at, chunk)
        if data is None:
            at += 1
        else:
            yield at, used, data
            at += used
            if at - base > len(window):
                window, base = b"", at


def _inflate(f, head: bytes, at: int, chunk: int) -> tuple[bytes | None, int]:
    """The member at `at`, of which `head` has the first bytes, and its length; None if it is no record."""
    z, out, fed = zlib.decompressobj(31), [], 0
    piece = head
    try:
        while True:
            out.append(z.decompress(piece))
            fed += len(piece)
            if len(out) <= 2 or len(out[0]) < len(ANY_VERSION):
                begun = b"".join(out)[: len(ANY_VERSION)]
                if not ANY_VERSION.startswith(begun):
                    return None, 0
            if z.eof:
                data = b"".join(out)
                return (data, fed - len(z.unused_data)) if data.startswith(ANY_VERSION) else (None, 0)
            f.seek(at + fed)
            piece = f.read(chunk)
            if not piece:
                return None, 0
    except zlib.error:
        return None, 0


def read_warc(files: DataFrame, range_bytes: int = 4 << 20, on_damage: str = "error") -> DataFrame:
    """The records of the archives in `files` (path, bytes), page_id, record_type,
    target_uri, payload, payload_bytes, payload_digest, refers_to, in tasks of about
    `range_bytes`: a range of a large file, or several small files. An archive of any size is shared out; ranges are dealt out evenly.

    Records of every type and of WARC/1.0 and 1.1 come, with nulls for what they lack. A SHA-1 digest is checked against its payload.
    Members follow each other without gaps: bytes between a record's end and the next record's start, in whichever range that is, and before
    the first record are damaged, and the range of the record before them says so. With on_damage "error" such bytes, or a digest that doesn't fit, fail the
    job; with "row" each damaged stretch comes as a row of record_type "damaged" with its length as payload_bytes, and all whole records beside it."""
    if on_damage not in ("error", "row"):
        raise ValueError(f"on_damage is {on_damage!r}, not error or row")
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    n = 1 + (files.agg(F.sum("bytes")).first()[0] or 0) // range_bytes
    schema = "page_id long, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def damaged(path: str, begin: int, end: int) -> dict:
        if on_damage == "error":
            raise Damage(f"{path}: no record in bytes {begin} to {end}")
        return dict.fromkeys(names) | {"record_type": "damaged", "payload_bytes": end - begin}

    def rows_of(path: str, start: int, end: int) -> Iterator[dict]:
        with open_at(path) as f:
            done = None if start else 0  # where the last record of this range ended
            for at, used, data in records_starting_in(f, start, end):
                if done is not None and at > done:
                    yield damaged(path, done, at)
                row = parse_record(data)
                if row["payload"] is not None and row["payload_digest"] and payload_digest(row["payload"]) != row["payload_digest"]:
                    if on_damage == "error":
                        raise Damage(f"{path}: the payload of the record at {at} has another digest")
                    row["record_type"] = "damaged"
                yield row
                done = at + used
            # behind its last record a range answers for the bytes up to the next record, wherever that begins
            if done is None:
                return
            stop = next((at for at, _, _ in records_starting_in(f, max(done, end), f.size())), f.size())
            if stop > done:
                yield damaged(path, done, stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[dict] = []
                held = 0
                for row in rows_of(path, start, end):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > (4 << 20):
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    return ranges.repartition(n).mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write `pages` to archives in the shared folder and read every record back."""
    files = write_warc(pages, new_path(pages.sparkSession, "warc"), id_col, url_col, html_col, min_revisit_bytes)
    return read_warc(files)
