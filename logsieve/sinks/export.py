"""Rows to CSV, TSV and JSON, as one file streamed through the driver or as a distributed folder."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, functions as F

COLUMNS = ["row", "source", "lineNumber", "timestamp", "ip", "method", "target", "path", "status", "bytes", "userAgent", "raw"]
SEPARATORS = {"csv": ",", "tsv": "\t"}


def cell(value, separator: str) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ('"', "\n", "\r", separator)) else text


def chunks(rows, fmt: str, incident: dict | None = None):
    """Text pieces of the whole export."""
    if fmt in SEPARATORS:
        sep = SEPARATORS[fmt]
        yield sep.join(COLUMNS) + "\n"
        for r in rows:
            yield sep.join(cell(r[c], sep) for c in COLUMNS) + "\n"
    elif fmt == "json":
        yield '{"incident":' + json.dumps(incident, ensure_ascii=False) + ',"lines":['
        for i, r in enumerate(rows):
            yield ("," if i else "") + json.dumps(r.asDict(), ensure_ascii=False)
        yield "]}\n"
    else:
        raise ValueError(f"export format: {fmt}")


def pretty(rows, incident: dict | None = None) -> str:
    """A selection of rows as indented JSON."""
    return json.dumps({"incident": incident, "lines": [r.asDict() for r in rows]}, ensure_ascii=False, indent=2) + "\n"


def export(log: DataFrame, path: str, fmt: str, incident: dict | None = None, progress=None, stop=None) -> int:
    """Write the rows in their order into one file; it appears whole or not at all.  Partitions come one by one.  stop() is
    asked from time to time; where it says so, InterruptedError ends the export and no file is left."""
    n = 0

    def counted():
        nonlocal n
        for r in log.toLocalIterator(prefetchPartitions=True):
            n += 1
            if n % 5000 == 0:
                if progress:
                    progress(n)
                if stop and stop():
                    raise InterruptedError(f"export stopped after {n} rows")
            yield r

    handle, part = tempfile.mkstemp(prefix=".export-", dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            for piece in chunks(counted(), fmt, incident):
                f.write(piece)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
    return n


def export_folder(log: DataFrame, path: str, fmt: str) -> None:
    """The same rows as a folder of part files, written by the executors."""
    if fmt in SEPARATORS:
        log.select(*COLUMNS).write.csv(path, sep=SEPARATORS[fmt], header=True, quote='"', escape='"', nullValue="", emptyValue="")
    else:
        log.select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
