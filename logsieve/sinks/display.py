"""Short forms of values for terminal output and file names."""

from __future__ import annotations

import re
from datetime import datetime

_UNITS = ("KiB", "MiB", "GiB")


def size(n: float) -> str:
    """A number of bytes in the largest unit that it fills, up to GiB."""
    if n < 1024:
        return f"{n} B"
    for unit in _UNITS:
        n /= 1024
        if n < 1024 or unit == _UNITS[-1]:
            return f"{n:.1f} {unit}"


def when(text: str) -> str:
    """Day and time of a log or ISO time, without the year; other texts are cut to 15 characters."""
    for pattern, shown in (("%d/%b/%Y:%H:%M:%S", "%d/%b %H:%M:%S"), ("%Y-%m-%dT%H:%M:%S", "%m-%d %H:%M:%S")):
        try:
            return datetime.strptime(text[: 20 if "%b" in pattern else 19], pattern).strftime(shown)
        except ValueError:
            continue
    return text[:15]


def fitted(text: str, width: int) -> str:
    """One line of at most `width` characters, with dots where it was cut and there is room for them."""
    line = " ".join(text.split())
    if len(line) <= max(width, 0):
        return line
    return line[: max(width, 0)] if width <= 3 else line[: width - 3] + "..."


def wrapped(text: str, width: int) -> list[str]:
    """Lines of at most `width` characters, cut anywhere: targets have no blanks to cut at."""
    return [text[i : i + width] for i in range(0, len(text), width)] or [""]


def file_part(text: str) -> str:
    """A text as part of a file name."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", text).strip("_") or "unknown"
