"""Input paths to sources, in the order that fixes row numbers."""

from __future__ import annotations

import fnmatch
import os
import sys


def discover(paths: list[str], include: str | None = None, exclude: str | None = None, spark=None) -> list[str]:
    """Files as given, directories by all regular files below them; sorted by code point.  include and exclude are
    patterns on the whole path.  URIs of other file systems are listed by Spark's own, if a session is given."""
    out = []
    for p in paths:
        if os.path.isdir(p):
            for folder, _, names in os.walk(p):
                out += [full for n in names if os.path.isfile(full := os.path.join(folder, n)) and not os.path.islink(full)]
        elif "://" in p:
            out += _listed(spark, p) if spark is not None else [p]
        elif os.path.isfile(p):
            out.append(p)
        else:
            raise FileNotFoundError(f"no such file or directory: {p}")
    if include:
        out = [p for p in out if fnmatch.fnmatchcase(p, include)]
    if exclude:
        out = [p for p in out if not fnmatch.fnmatchcase(p, exclude)]
    return sorted(out)


def _listed(spark, uri: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        raise FileNotFoundError(f"no such file or directory: {uri}")
    found, out = store.listFiles(path, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def spooled_stdin(spark) -> str:
    """Standard input in a file of the shared folder, which all executors can read; stored.release deletes it."""
    from .. import stored

    target = stored.scratch(spark, "stdin") + ".log"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        while chunk := sys.stdin.buffer.read(1 << 20):
            out.write(chunk)
    finally:
        out.close()
    stored.also(target)
    return target
