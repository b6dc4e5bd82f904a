"""Path and query of targets that need the full URL rules, by an Arrow UDF; simple targets never come here."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..data import paths
from . import scalars

_SPECIAL = ("http", "https", "ws", "wss", "ftp")
_PATH_KEEP = set("!$%&'()*+,-./:;=@[]\\_|~") | set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_PATH_KEEP -= set("\\")
_QUERY_ESCAPE = set(" \"#<>'")
_HOST_BAD = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


def _escaped(text: str, bad) -> str:
    return "".join("".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) if bad(c) else c for c in text)


def _bad_in_path(c: str) -> bool:
    return c not in _PATH_KEEP and not c == "^" or c in "\"<>`{}"


def split_target(target: str) -> tuple[str, str] | None:
    """(path, query with its question mark or "") of a target resolved as a web URL; None if it is no URL."""
    text = re.sub(r"[\t\n\r]", "", target.strip("".join(map(chr, range(33)))))
    text = text.partition("#")[0]
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
    if scheme and scheme[1].lower() not in _SPECIAL:
        rest = text[scheme.end() :]
        path, mark, query = rest.partition("?")
        if not path.startswith("/"):
            return path, (mark + _escaped(query, lambda c: c in " \"#<>" or not 32 < ord(c) < 127)) if query else ""
    elif scheme:
        rest = text[scheme.end() :]
        text = rest if scheme[1].lower() == "http" and not re.match(r"[/\\]{2}", rest) else "//" + rest.lstrip("/\\")
    path, mark, query = text.partition("?")
    path = path.replace("\\", "/")
    if path.startswith("//"):
        host, slash, path = path.lstrip("/").partition("/")
        path = slash + path
        host, colon, port = host.rpartition("@")[2].partition(":") if not host.rpartition("@")[2].startswith("[") else (host, "", "")
        if not host or port and not (port.isdigit() and int(port) < 65536) or _HOST_BAD.search(host) and not host.startswith("["):
            return None
    segments: list[str] = []
    parts = path.lstrip("/").split("/") if path.startswith("/") else path.split("/")
    if path.startswith("/"):
        parts = path[1:].split("/")
    for i, s in enumerate(parts):
        dots = re.sub("(?i)%2e", ".", s)
        last = i == len(parts) - 1
        if dots == "..":
            segments = segments[:-1]
            if last:
                segments.append("")
        elif dots == ".":
            if last:
                segments.append("")
        else:
            segments.append(_escaped(s, _bad_in_path))
    query = _escaped(query, lambda c: c in _QUERY_ESCAPE or not 32 < ord(c) < 127)
    return "/" + "/".join(segments), mark + query if query else ""


_SAFE_FORM = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789*-._")


def _form(text: str) -> str:
    return "".join("+" if b == 32 else chr(b) if chr(b) in _SAFE_FORM else f"%{b:02X}" for b in text.encode("utf-8", "replace"))


def _decoded(text: str) -> str:
    from urllib.parse import unquote_plus

    return unquote_plus(text, errors="replace")


_TRACKING = re.compile(paths.TRACKING.replace(r"\z", r"\Z"))
_REDACT = re.compile(rf'({scalars.SENSITIVE})=([^&\s"]+)', re.I)


def _signature(target: str) -> str:
    if "?" not in target:
        return ""
    got = split_target(target)
    if got is None:
        return _REDACT.sub(r"\1=[REDACTED]", target[target.index("?") :])
    query = got[1][1:]
    pairs = [(p.partition("=")[0], p.partition("=")[2]) for p in query.split("&") if p]
    kept = [(n, v) for n, v in pairs if not _TRACKING.search(_decoded(n))]
    if len(kept) != len(pairs):
        query = "&".join(f"{_form(_decoded(n))}={_form(_decoded(v))}" for n, v in kept)
    return _REDACT.sub(r"\1=[REDACTED]", "?" + query) if query else ""


def _udf():
    @F.pandas_udf("struct<path:string,full:string,signature:string>")
    def resolve(targets: pd.Series) -> pd.DataFrame:
        rows = []
        for t in targets:
            if t is None:
                rows.append((None, None, None))
                continue
            got = split_target(t)
            path, full = (t.partition("?")[0] or "/", t) if got is None else (got[0] or "/", got[0] + got[1])
            rows.append((path, full, _signature(t)))
        return pd.DataFrame(rows, columns=["path", "full", "signature"])

    return resolve


def with_url(df: DataFrame, target: str = "target") -> DataFrame:
    """df with path, full (path with query) and signature of its targets.  The UDF gets null for simple targets, so that
    only the others cost Python time."""
    t = F.col(target)
    df = df.withColumn("_simple", scalars.is_simple_target(t))
    df = df.withColumn("_odd", _udf()(F.when(~F.col("_simple"), t)))
    path = F.split_part(t, F.lit("?"), F.lit(1))
    either = lambda x, name: F.when(F.col("_simple"), x).otherwise(F.col("_odd")[name]).alias(name)
    full = F.when(scalars.query_of(t) == "", path).otherwise(t)
    kept = [c for c in df.columns if c not in ("_simple", "_odd")]
    return df.select(*kept, either(path, "path"), either(full, "full"), either(scalars.simple_signature(t), "signature"))
