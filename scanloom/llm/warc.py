"""WARC archives: a writer, and a reader that splits files at any byte.

Every record is a gzip member of its own. A reading task owns the byte range [start, end) of a file:
it looks for gzip magic from `start`, takes a candidate for a record only if what it holds inflates
to a WARC version line, reads on past `end` to the record's end, and owns the records whose first
byte lies inside. Chance magic inside compressed data fails that test, so neither order nor count of
splits changes the result.

Of records with equal payloads of at least `least_bytes` that with the smallest id is a response, the
others are revisits of it (RFC-style profile, HTTP header only; the payload's full length and digest
stand in the record). Rows with null payload count as empty. Rows that repeat the smallest id are
responses too; a null id is never the smallest unless all are null (then all are responses). A null
url gives no target URI. Other columns are ignored; an empty table makes no file and reads as empty.

Files lie in a folder that all executors reach, through pyarrow.fs (file, hdfs, s3, gs). A task that
is run again writes files of new names, and only files in the returned list are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, fresh_path

MAGIC = b"\x1f\x8b\x08"
FILES = "path string, length bigint, records bigint"
RECORDS = "path string, start bigint, record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary"
#: Fixed value: the profile of a revisit whose payload equals an earlier one's.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """Rows (id, url, payload, first): first is the id of the response with the same payload, null where
    no other row has it. Payloads are compared by SHA-256 and length, of which only the smallest id is
    gathered (map-side). The table of those met twice is joined back by key: while Spark finds it small
    enough to broadcast, payloads are not moved; beyond, a payload that a third of all rows share skews
    one side of the join only, which Spark splits."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.concat(F.sha2("payload", 256), F.lit(":"), F.octet_length("payload").cast("string")))
    firsts = cut(rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "firsts")
    small = F.octet_length("payload") < least_bytes
    return rows.join(firsts, "key", "left").select("id", "url", "payload", F.when(small, F.col("id")).otherwise(F.col("first")).alias("first"))


def record(id_: str | None, url: str | None, payload: bytes, first: str | None) -> bytes:
    """One record, gzipped."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = first is not None and first != id_
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if id_ is None else id_}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes pages to archives of about file_bytes below folder, a record a row. The list of files
    (path, length, records), as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done, out, name, length, n = [], None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, length, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                text = lambda x: None if x is None else str(x)
                member = record(text(row["id"]), row["url"], row["payload"], text(row["first"]))
                out.write(member)
                length, n = length + len(member), n + 1
                if length >= file_bytes:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", length, n))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", length, n))
        columns = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["path", "length", "records"])

    return cut(plan(pages, id_col, url_col, payload_col, least_bytes).mapInArrow(run, FILES), "warc-files")


def inflate(f, offset: int, size: int, piece: int = 1 << 18) -> tuple[bytes, int] | None:
    """The member at offset, inflated, and the offset behind it; None if it is no WARC record. The
    version line is looked at first, so chance magic costs one piece."""
    d, out, at, seen = zlib.decompressobj(31), [], offset, 0
    try:
        while not d.eof:
            data = f.read_at(min(piece, size - at), at)
            if not data:
                return None
            at += len(data)
            out.append(d.decompress(data))
            seen += len(out[-1])
            if len(out) == 1 and not out[0].startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    return b"".join(out), at - len(d.unused_data)


def parse(raw: bytes) -> dict | None:
    """The fields of RECORDS behind the first two; None if the header is not whole."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        return None
    named = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        named[k.strip().lower()] = v.strip()
    if not named.get("content-length", "").isdigit():
        return None
    block = rest[: int(named["content-length"])]
    kind, digest = named.get("warc-type"), named.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in named.get("content-type", "") else block
    id_of = lambda k: named[k].removeprefix("<urn:page:").removesuffix(">") if k in named else None
    own = base32_sha1(payload) if kind != "revisit" else None
    length = len(payload) if own else int(named["warc-payload-length"]) if named.get("warc-payload-length", "").isdigit() else None
    return {
        "record_type": kind, "record_id": id_of("warc-record-id"), "target_uri": named.get("warc-target-uri"), "refers_to": id_of("warc-refers-to"), "payload_bytes": length,
        "payload_digest": own or digest or None, "digest_ok": not own or not digest or own == digest, "payload": payload if own else None,
    }


def records_in(path: str, start: int, end: int, step: int = 1 << 20) -> Iterator[dict]:
    """The records of a file that begin in [start, end)."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        size, at = f.size(), start
        while at < end:
            window = f.read_at(min(step, end - at) + len(MAGIC) - 1, at)
            hit = window.find(MAGIC)
            if hit < 0 or at + hit >= end:
                at += max(1, min(step, end - at))
                continue
            at += hit
            member = inflate(f, at, size)
            fields = member and parse(member[0])
            if fields:
                yield {"path": path, "start": at} | fields
                at = member[1]
            else:
                at += 1


def read(files: DataFrame, split_bytes: int = 64 << 20, payload: bool = True, most_tasks: int = 20_000) -> DataFrame:
    """RECORDS of the files (path, length), each file dealt out in ranges of split_bytes. payload:
    whether the payload itself is returned; its length and digest are computed from it either way."""
    ranges = files.where("length > 0").selectExpr("path", "length", f"explode(sequence(0L, length - 1, {split_bytes}L)) AS start").selectExpr("path", "start", f"least(start + {split_bytes}L, length) AS stop")
    tasks = min(max(ranges.count(), 1), most_tasks)
    kind = pa.schema([("path", pa.string()), ("start", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held, weight = [], 0
                for x in records_in(r["path"], r["start"], r["stop"]):
                    if not payload:
                        x["payload"] = None
                    held.append(x)
                    weight += 500 + len(x["payload"] or b"")
                    if weight >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held, weight = [], 0
                yield pa.RecordBatch.from_pylist(held, kind)

    return ranges.repartition(tasks, "path", "start").mapInArrow(run, RECORDS)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the archives below a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")


def round_trip(pages: DataFrame, least_bytes: int = 0, split_bytes: int = 8 << 20) -> DataFrame:
    """Writes pages to archives in the shared folder and returns the records read back."""
    files = write(pages, fresh_path(pages.sparkSession, "warc"), least_bytes=least_bytes)
    return read(files, split_bytes, payload=False)
