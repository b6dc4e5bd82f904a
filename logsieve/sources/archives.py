"""Lines of zip, tar.gz, tgz and brotli inputs, which Spark has no reader for; one task a file, streamed in batches."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SUFFIXES = (".zip", ".tar.gz", ".tgz", ".br")
BATCH_ROWS = 8192
#: Bytes of an archive that goes through Spark in one row, and of a piece of a stream.
WHOLE, PIECE = 1 << 30, 1 << 16


def is_archive(path: str) -> bool:
    return path.endswith(SUFFIXES)


def is_candidate(name: str) -> bool:
    """Whether an archive entry may be a log."""
    full = name.replace("\\", "/").lower()
    base = full.rpartition("/")[2]
    if full.startswith("__macosx/") or base.startswith("."):
        return False
    return os.path.splitext(base)[1] in ("", ".log", ".txt", ".gz", ".br") or "access" in base


class _Stream(io.RawIOBase):
    """Anything with read(n), as a stream that is read forwards only."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class _Brotli:
    """A brotli stream, decompressed as it is read."""

    def __init__(self, stream):
        try:
            import brotli
        except ImportError as e:
            raise RuntimeError("brotli input needs the brotli package on the executors") from e
        self.stream, self.decoder, self.rest = stream, brotli.Decompressor(), b""

    def read(self, n: int) -> bytes:
        while not self.rest:
            raw = self.stream.read(PIECE)
            if not raw:
                return b""
            self.rest = self.decoder.process(raw)
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def _opened(name: str, stream):
    if name.endswith(".gz"):
        return gzip.GzipFile(fileobj=stream)
    return _Brotli(stream) if name.endswith(".br") else stream


def streams(path: str, data):
    """(label, byte stream) of each log in an archive that is open as `data`."""
    if path.endswith(".br"):
        yield path, _Brotli(data)
        return
    found = False
    if path.endswith(".zip"):
        with zipfile.ZipFile(data) as z:
            for entry in z.infolist():
                if not entry.is_dir() and is_candidate(entry.filename):
                    found = True
                    with z.open(entry) as s:
                        yield f"{path}::{entry.filename}", _opened(entry.filename, s)
    else:
        with tarfile.open(fileobj=data, mode="r|gz") as t:
            for entry in t:
                if entry.isfile() and is_candidate(entry.name):
                    found = True
                    yield f"{path}::{entry.name}", _opened(entry.name, t.extractfile(entry))
    if not found:
        raise ValueError(f"no log in archive: {path}")


def _from_storage(uri: str):
    """An open file of a URI that pyarrow knows: local, HDFS, S3, GCS."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, block, place, value of the archives' lines.  Spark hands over archives of up to WHOLE bytes; larger ones, which
    no row can hold, are read from their storage as they are unpacked."""
    files = spark.read.format("binaryFile").load(paths)
    small = files.filter(F.col("length") <= WHOLE).select("path", "content")
    large = files.filter(F.col("length") > WHOLE).select("path", F.lit(None).cast("binary").alias("content"))

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shown = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
                data = pa.BufferReader(content.as_buffer()) if content.is_valid else _from_storage(path)
                with data:
                    for label, stream in streams(shown, data):
                        yield from _lines(label, stream)

    kinds = "source string, block long, place long, value string"
    rows = small.mapInArrow(unpack, kinds).unionByName(large.mapInArrow(unpack, kinds))
    return rows.withColumn("block", F.floor(F.col("place") / 1_000_000))


def _lines(label: str, stream):
    rows, n = [], 0
    for line in io.TextIOWrapper(io.BufferedReader(_Stream(stream)), "utf-8", "replace", newline=None):
        rows.append(line.rstrip("\n"))
        if len(rows) == BATCH_ROWS:
            yield _batch(label, n, rows)
            n, rows = n + len(rows), []
    if rows:
        yield _batch(label, n, rows)


def _batch(label: str, first: int, rows: list[str]) -> pa.RecordBatch:
    place = pa.array(range(first, first + len(rows)), pa.int64())
    columns = [pa.array([label] * len(rows), pa.string()), pa.array([0] * len(rows), pa.int64()), place, pa.array(rows, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["source", "block", "place", "value"])


def write_archive(path: str, name: str, lines) -> None:
    """A zip, tar.gz, gzip or plain file (by its ending) of lines, under an entry name for archives."""
    data = "".join(x + "\n" for x in lines).encode()
    if path.endswith(".zip"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, data)
            z.writestr("notes.bin", b"\0")
    elif path.endswith((".tar.gz", ".tgz")):
        with tarfile.open(path, "w:gz") as t:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    else:
        with gzip.open(path, "wb") if path.endswith(".gz") else open(path, "wb") as f:
            f.write(data)
