"""Custom formats from a JSON file: {"formats": [{"name", "label"?, "pattern", "fields": {...}}]}."""

from __future__ import annotations

import json
import re

from ..operators.parse import Format

FIELDS = ("ip", "timestamp", "method", "target", "protocol", "request", "status", "bytes", "referer", "userAgent")


class FormatError(ValueError):
    pass


def _groups(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with plain groups, and the number of each named one (Java takes no _ in names)."""
    names, n, i, out, in_class = {}, 0, 0, [], False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "(" and not in_class:
            m = re.match(r"\(\?<([A-Za-z_$][\w$]*)>", pattern[i:])
            if m:
                n += 1
                names[m[1]] = n
                out.append("(")
                i += m.end()
                continue
            if pattern[i + 1 : i + 2] != "?":
                n += 1
        out.append(c)
        i += 1
    text = re.sub(r"(?<!\\)\$\Z", lambda m: r"\z", "".join(out))
    return text, names


def load(path: str) -> list[Format]:
    with open(path, encoding="utf-8") as f:
        return parse_config(json.load(f))


def parse_config(config: dict) -> list[Format]:
    formats = config.get("formats")
    if not isinstance(formats, list) or not formats:
        raise FormatError("formats: at least one is needed")
    out = []
    for f in formats:
        name, pattern, fields = f.get("name"), f.get("pattern"), f.get("fields") or {}
        if not isinstance(name, str) or not re.fullmatch(r"[a-zA-Z0-9_-]+", name):
            raise FormatError(f"bad format name: {name!r}")
        if not isinstance(pattern, str) or not pattern:
            raise FormatError(f"{name}: pattern is missing")
        for need in ("ip", "timestamp", "status"):
            if not fields.get(need):
                raise FormatError(f"{name}: fields.{need} is missing")
        if not fields.get("request") and not all(fields.get(x) for x in ("method", "target", "protocol")):
            raise FormatError(f"{name}: fields.request, or fields.method, target and protocol, are needed")
        text, groups = _groups(pattern)
        out.append(Format(f"custom:{name}", f.get("label") or name, text, {k: groups[v] for k, v in fields.items() if k in FIELDS and v in groups}))
    return out
