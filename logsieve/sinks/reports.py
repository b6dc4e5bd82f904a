"""An analysis as a document, and that document as JSON, Markdown, HTML or terminal text."""

from __future__ import annotations

import html
import json
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ..functions import scalars as S
from ..operators import aggregates as A, matches
from ..plans.analysis import Analysis

PANELS = [("topIps", "Top IPs", "ips"), ("topPaths", "Top Paths", "paths"), ("topUserAgents", "Top User Agents", "userAgents"), ("topParams", "Top Query Params", "params"),
          ("topParamValues", "Top Query Param Values", "paramValues"), ("topMethods", "Methods", "methods"), ("topStatuses", "Statuses", "statuses")]
AGENT_WIDTH = 60


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _number(x: float):
    return int(x) if x == int(x) else x


def incident_dict(row: dict) -> dict:
    evidence = [{"key": e["key"], "value": e["text"] if e["text"] is not None else e["flag"] if e["flag"] is not None else _number(e["number"])} for e in row["evidence"]]
    out = {k: row[k] for k in ("id", "category", "kind", "severity", "score", "title", "description")} | {"evidence": evidence, "samples": row["samples"]}
    return out | ({"successful": True} if row["successful"] else {})


def build(analysis: Analysis, summary: DataFrame, inputs: list[str], formats: list, top: int = 20, with_matches: bool = True) -> dict:
    """The whole report.  Everything collected is bounded: top lists, 100 clients, bots by name, incidents, and 200
    sample rows an incident."""
    from pyspark.sql import functions as F

    bots = A.ordered_bots(analysis.bots).select(
        "botName", "requests", "ipCount", "pathCount", "requestedRobotsTxt", S.iso_of(F.col("firstSeen")).alias("firstSeen"), S.iso_of(F.col("lastSeen")).alias("lastSeen")
    )
    report = {
        "app": "logsieve", "phase": 1, "status": "ok", "generatedAt": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z"), "inputs": inputs,
        "inputFormats": [asdict(f) for f in formats], "summary": _rows(summary)[0],
    }
    report |= {key: _rows(analysis.top(what, top)) for key, _, what in PANELS}
    report |= {"timeStats": _rows(analysis.time_stats)[0], "ipBehaviorStats": _rows(A.top_clients(analysis.profiles, analysis.thresholds)), "aiBotStats": _rows(bots)}
    report["incidents"] = [incident_dict(r) for r in _rows(analysis.incidents())]
    report["incidentMatches"] = []
    if with_matches:
        totals = {r["id"]: r["totalMatches"] for r in _rows(matches.match_counts(analysis.bridge))}
        lines: dict[str, list] = {}
        for r in _rows(analysis.match_samples().join(analysis.log, "row").orderBy("id", "row")):
            lines.setdefault(r.pop("id"), []).append(r)
        report["incidentMatches"] = [{"incidentId": k, "totalMatches": totals[k], "rowNumbers": [x["row"] for x in v], "lines": v} for k, v in sorted(lines.items())]
    return report


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def shortened(text: str, width: int = AGENT_WIDTH) -> str:
    return text if len(text) <= width else text[: width - 1] + "…"


def _cell(x) -> str:
    if isinstance(x, bool):
        x = str(x).lower()
    return str(x).replace("|", "\\|").replace("\n", " ")


def _table(head: list[str], align: list[str], rows: list[list]) -> list[str]:
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return [line(head), line(align), *map(line, rows)]


def _shown(report: dict, key: str, what: str) -> list[list]:
    return [[i["count"], shortened(i["value"]) if what == "userAgents" else i["value"]] for i in report[key]]


def _evidence(incident: dict) -> str:
    return "; ".join(f"{e['key']}={str(e['value']).lower() if isinstance(e['value'], bool) else e['value']}" for e in incident["evidence"])


def _summary_rows(report: dict) -> list[list]:
    s, t = report["summary"], report["timeStats"]
    return [
        ["Files", s["files"]], ["Lines parsed", f"{s['parsedLines']} / {s['totalLines']}"], ["Lines filtered", s["filteredLines"]], ["Invalid lines", s["invalidLines"]], ["Bytes served", s["totalBytes"]],
        ["First seen", t["firstSeen"] or "unknown"], ["Last seen", t["lastSeen"] or "unknown"], ["Peak global RPS", t["peakGlobalRps"]], ["Global RPS p95", t["globalRpsP95"]],
    ]


def _bot_rows(report: dict) -> list[list]:
    return [[b["botName"], b["requests"], b["ipCount"], b["pathCount"], "yes" if b["requestedRobotsTxt"] else "no"] for b in report["aiBotStats"]] or [["none", 0, 0, 0, "no"]]


def to_markdown(report: dict) -> str:
    out = ["# Access log analysis", "", f"Generated: {report['generatedAt']}", "", "## Summary", "", *_table(["Metric", "Value"], ["---", "---:"], _summary_rows(report))]
    out += ["", "## Inputs", "", *_table(["Input", "Format", "Parsed sample"], ["---", "---", "---:"], [[_cell(i["file"]), _cell(i["format"]), f"{i['parsedSampleLines']} / {i['sampledLines']}"] for i in report["inputFormats"]]), ""]
    for key, title, what in PANELS:
        out += [f"## {title}", "", *_table(["Count", "Value"], ["---:", "---"], [[n, _cell(v)] for n, v in _shown(report, key, what)] or [[0, "none"]])]
    out += ["## Known AI Bots", "", *_table(["Bot", "Requests", "IPs", "Paths", "Robots.txt"], ["---", "---:", "---:", "---:", "---"], [[_cell(x) for x in r] for r in _bot_rows(report)])]
    rows = []
    for i in report["incidents"]:
        rows.append([i["severity"], i["score"], _cell(i["category"]), _cell(i["title"]), _cell(_evidence(i))])
        rows += [["", "", "sample", "", f"`{_cell(s)}`"] for s in i["samples"][:3]]
    out += ["## Incidents", "", *_table(["Severity", "Score", "Category", "Title", "Evidence"], ["---", "---:", "---", "---", "---"], rows or [["info", 0, "none", "No incidents detected", ""]])]
    return "\n".join(out) + "\n"


_STYLE = "body{font:14px system-ui;margin:2rem;max-width:80rem}table{border-collapse:collapse;margin:.5rem 0 1.5rem}td,th{border:1px solid #ccc;padding:.25rem .5rem;text-align:left}.critical,.high{color:#a00}"


def to_html(report: dict) -> str:
    esc = lambda x: html.escape(str(x), quote=True)
    table = lambda head, rows: "<table><tr>" + "".join(f"<th>{esc(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    out = [f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Access log analysis</title><style>{_STYLE}</style></head><body><h1>Access log analysis</h1>']
    out += [f"<p>Generated: {esc(report['generatedAt'])}</p><h2>Summary</h2>", table(["Metric", "Value"], _summary_rows(report))]
    out += ["<h2>Inputs</h2>", table(["Input", "Format", "Parsed sample"], [[i["file"], i["format"], f"{i['parsedSampleLines']} / {i['sampledLines']}"] for i in report["inputFormats"]])]
    for key, title, what in PANELS:
        out += [f"<h2>{title}</h2>", table(["Count", "Value"], _shown(report, key, what) or [[0, "none"]])]
    out += ["<h2>Known AI Bots</h2>", table(["Bot", "Requests", "IPs", "Paths", "Robots.txt"], _bot_rows(report)), "<h2>Incidents</h2>"]
    for i in report["incidents"]:
        out.append(f'<section class="{esc(i["severity"])}"><h3>{esc(i["title"])} ({esc(i["severity"])}, {esc(i["score"])})</h3><p>{esc(i["description"])}</p><p>{esc(_evidence(i))}</p>')
        out.append("".join(f"<pre>{esc(s)}</pre>" for s in i["samples"][:3]) + "</section>")
    return "".join(out) + ("" if report["incidents"] else "<p>No incidents detected</p>") + "</body></html>\n"


def to_terminal(report: dict) -> str:
    out = ["Access log analysis", ""] + [f"  {k}: {v}" for k, v in _summary_rows(report)]
    for key, title, what in PANELS:
        out += ["", title] + [f"  {n:>8}  {v}" for n, v in _shown(report, key, what)]
    out += ["", "Known AI bots"] + [f"  {b[0]}: {b[1]} requests, {b[2]} IPs, {b[3]} paths, robots.txt {b[4]}" for b in _bot_rows(report)[:10]]
    for kind in ("compromise", "saturation"):
        own = [i for i in report["incidents"] if i["kind"] == kind]
        out += ["", f"Incidents: {kind} ({len(own)})"]
        for i in own[:15]:
            out.append(f"  [{i['severity']} {i['score']}] {i['title']}: {shortened(_evidence(i), 160)}")
            out += [f"      {s}" for s in i["samples"][:2]]
    noise = sum(i["kind"] == "noise" for i in report["incidents"])
    return "\n".join([*out, "", f"{noise} noise incidents not shown"]) + "\n"


RENDERERS = {"json": to_json, "markdown": to_markdown, "html": to_html, "terminal": to_terminal}
