"""Command line: python -m logsieve.cli [paths] [options]."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from . import __version__


def _top(text: str) -> int:
    import re

    m = re.match(r"\s*([+-]?\d+)", text)
    if not m or int(m[1]) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return int(m[1])


def _date(text: str) -> str:
    try:
        datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise argparse.ArgumentTypeError(f"not a date: {text}") from None
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logsieve", description="Analyse web access logs.")
    p.add_argument("paths", nargs="*", help="files or directories; - is standard input")
    kinds = p.add_mutually_exclusive_group()
    for kind in ("json", "markdown", "html"):
        kinds.add_argument(f"--{kind}", dest="kind", action="store_const", const=kind)
    p.add_argument("--out", help="write the report to this file")
    p.add_argument("--format", default="auto")
    p.add_argument("--format-config")
    p.add_argument("--top", type=_top, default=20)
    p.add_argument("--since", type=_date)
    p.add_argument("--until", type=_date)
    p.add_argument("--include")
    p.add_argument("--exclude")
    p.add_argument("--filter", default="", help="with --export: the rows to write")
    p.add_argument("--export", help="write stored rows to this .csv, .tsv or .json file")
    p.add_argument("--master", help="Spark master; default: the environment's")
    p.add_argument("--no-interactive", action="store_true", help="accepted; there is no interactive mode")
    p.add_argument("--no-color", action="store_true", help="accepted; output has no colour")
    p.add_argument("--sweep", type=float, metavar="HOURS", help="first delete scratch tables that are older, of runs that never ended")
    p.add_argument("-v", "--version", action="version", version=f"logsieve {__version__}")
    p.add_argument("--debug", action="store_true", help="show tracebacks")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from . import stored
    from .api import analyze
    from .operators.query import query_rows
    from .session import session
    from .sinks import export, reports
    from .sources.discover import spooled_stdin

    try:
        paths = args.paths or (["-"] if not sys.stdin.isatty() else [])
        if not paths:
            raise ValueError("no input")
        spark = session(args.master or "local[*]")
        if args.sweep is not None:
            stored.sweep(spark, args.sweep)
        files = [p for p in paths if p != "-"] + [spooled_stdin(spark) for p in paths if p == "-"]
        result = analyze(spark, files, args.format, args.format_config, args.since, args.until, args.top, args.include, args.exclude)
        if args.export:
            export.export(query_rows(result.analysis.log, args.filter), args.export, args.export.rpartition(".")[2])
        text = reports.RENDERERS[args.kind or "terminal"](result.report())
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            sys.stdout.write(text)
        stored.release(spark)
        return 0
    except Exception as e:
        if args.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
