"""WARC records inside ZIP packages: a writer, and a reader that never extracts.

A package is a ZIP file with two stored (uncompressed) members: `archive/data.warc.gz`, in which every record is a gzip
member of its own, and `indexes/index.jsonl`, one line per record with its offset and length inside the archive member.
The reader takes the end of the file, follows the end-of-central-directory record (or the ZIP64 one), parses the
central directory with its ZIP64 extra fields, finds where the stored members' bytes begin, reads the index member, and
then reads single records by their byte ranges.

Equal payloads of at least `least` bytes are written once: the record with the largest id is a response, the others are
revisits that refer to it.  The writer takes rows as they come; which rows are revisits is worked out beforehand from
(digest, id) rows alone.

Files carry names that no other attempt uses; the manifest, a table written after them, says which count.

Defined results: a null payload counts as empty; payloads below `least` are all responses; of rows that share payload
and largest id one is the response; null ids are smallest; a revisit's payload is that of the record it refers to;
an empty table gives no package and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
PACKAGE_BYTES = 32 << 20
MOST_TASKS = 50_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# ---- records ---------------------------------------------------------------------------------------------------


def record(kind: str, number, url: str, digest_hex: str, size: int, payload: bytes | None, refers_to=None) -> bytes:
    """One WARC record as a gzip member."""
    name = "-" if number is None else str(number)
    block = _HTTP + payload if kind == "response" else _HTTP
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
        f"X-Payload-Length: {size}",
    ]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <urn:record:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload)."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _number(urn: str):
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "-" else int(name)


# ---- ZIP by byte ranges ----------------------------------------------------------------------------------------


def directory(f, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, stored size, size, header offset) from the central directory of an open file."""
    tail_at = max(0, size - 65557)
    tail = _range(f, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, at):
        locator = tail[end - 20 : end]
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end64 = _range(f, struct.unpack("<Q", locator[8:16])[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack("<QQQ", end64[32:56])
    raw, p, out = _range(f, at, length), 0, {}
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", raw[p + 8 : p + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
        (header,) = struct.unpack("<I", raw[p + 42 : p + 46])
        name = raw[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out[name] = (method, packed, full, header)
        p += 46 + n_name + n_extra + n_comment
    return out


def _range(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def stored_at(f, entry: tuple[int, int, int, int]) -> int:
    """File offset of the first byte of a stored member."""
    method, _, _, header = entry
    if method != 0:
        raise ValueError("member is compressed: its records cannot be read by range")
    local = _range(f, header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack("<HH", local[26:30])
    return header + 30 + n_name + n_extra


def package(records: list[bytes], force_zip64: bool = False) -> bytes:
    """A ZIP package of the records."""
    lines, at = [], 0
    for r in records:
        lines.append(json.dumps({"offset": at, "length": len(r)}))
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, b"".join(records)), (INDEX, "\n".join(lines).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=force_zip64) as m:
                m.write(data)
    return out.getvalue()


def read_records(f, size: int, wanted=None):
    """(headers, payload) of the records with the index numbers `wanted` (default: all), by range reads."""
    members = directory(f, size)
    index = members[INDEX]
    base = stored_at(f, members[ARCHIVE])
    lines = _range(f, stored_at(f, index), index[2]).decode().splitlines()
    for i in range(len(lines)) if wanted is None else wanted:
        where = json.loads(lines[i])
        yield parse_record(_range(f, base + where["offset"], where["length"]))


# ---- tables ----------------------------------------------------------------------------------------------------


def revisits(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """seq, refers_to of the rows to be written as revisits.  Only digests and ids are read from here on."""
    text = shared.text_of(payload_col)
    digests = pages.select(F.col(id_col).alias("id"), "__ls_seq", F.unhex(F.sha1(text.cast("binary"))).alias("sha"), F.octet_length(text).alias("size"))
    digests = shared.keep(digests.filter(F.col("size") >= least).select("id", "__ls_seq", "sha"), "payload-digests")
    groups = digests.groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("id", "__ls_seq")).alias("first")).filter("n > 1")
    groups = shared.keep(groups, "payload-groups")
    out = shared.join_counted(digests, groups, "sha", "n", digests.count())
    return out.filter(F.col("__ls_seq") != F.col("first.__ls_seq")).select("__ls_seq", F.col("first.id").alias("refers_to"))


def write_packages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", least: int = 1000
) -> DataFrame:
    """Write a record per row into packages under `folder`; returns the manifest: path, records."""
    spark = pages.sparkSession
    base = pages.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col(url_col) if url_col else F.lit("")).cast("string").alias("url"),
        F.col(payload_col).cast("string").alias("payload"),
    )
    unique = base.groupBy("id").count().filter("count > 1").isEmpty()
    if unique:
        base = base.withColumn("__ls_seq", F.coalesce(F.col("id"), F.lit(-(1 << 62))))
    else:  # ids repeat: fix the rows in a table before numbering them
        base = shared.keep(base.withColumn("__ls_seq", F.monotonically_increasing_id()), "pages")
    marks = shared.keep(revisits(base, "id", "payload", least), "revisits").withColumn("is_revisit", F.lit(True))
    rows = base.join(marks, "__ls_seq", "left").select("id", "url", "payload", "is_revisit", "refers_to")

    def write(batches):
        held, size = [], 0

        def flush():
            path = f"{folder}/package-{uuid.uuid4().hex}.zip"
            shared.put_file(path, package(held))
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                number, url, payload, revisit, refers = (c[i].as_py() for c in batch.columns)
                raw = (payload or "").encode()
                kind, sent = ("revisit", None) if revisit else ("response", raw)
                held.append(record(kind, number, url or "", hashlib.sha1(raw).hexdigest(), len(raw), sent, "-" if refers is None else refers))
                size += len(held[-1])
                if size >= PACKAGE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    manifest = rows.mapInArrow(write, "path string, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_packages(manifest: DataFrame, with_payload: bool = False, records_a_task: int = 2000) -> DataFrame:
    """One row per record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to, and on
    demand payload (null for revisits).  Digest and length of responses are taken from the payload that was read."""
    last = F.floor((F.col("records") - 1) / records_a_task).cast("int")
    # a number of tasks of its own: the few manifest rows say nothing about the bytes behind them
    n = manifest.agg(F.sum(last + 1)).first()[0] or 1
    parts = manifest.select("path", F.explode(F.sequence(F.lit(0), last)).alias("part")).repartition(min(n, MOST_TASKS), "path", "part")

    def read(batches):
        for batch in batches:
            for path, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                store, p = shared.task_fs(path)
                with store.open_input_file(p) as f:
                    size = f.size()
                    lines = directory(f, size)[INDEX]
                    n = _range(f, stored_at(f, lines), lines[2]).count(b"\n") + 1
                    for fields, payload in read_records(f, size, range(part * records_a_task, min(n, (part + 1) * records_a_task))):
                        kind = fields["warc-type"]
                        declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        length = int(fields["x-payload-length"])
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != declared or len(payload) != length):
                            raise ValueError(f"{path}: damaged record {fields['warc-record-id']}")
                        refers = _number(fields["warc-refers-to"]) if kind == "revisit" else None
                        row = (_number(fields["warc-record-id"]), length, declared, kind, refers)
                        if with_payload:
                            row += (payload.decode() if kind == "response" else None,)
                            held += len(payload)
                        rows.append(row)
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    def out(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()][: 5 + with_payload]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)), kinds)], names)

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return parts.mapInArrow(read, kinds + ", payload string" * with_payload)


def warc_round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    return read_packages(write_packages(pages, shared.scratch(spark, "warc"), **options))
