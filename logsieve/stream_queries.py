"""Queries of the streams, of other line formats, of filters that the views offer, and of reports; with the SQL that gives
the same rows.

A stream reads the derived log as it grows: its first part is written and streamed to the end, then the second part and
one entry of a far later time, which closes all windows.  The second run goes on from the checkpoint of the first."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import api, corpus, stored
from .operators import aggregates as A, filterlang, parse, query
from .plans import analysis
from .queries import _ALL, _E, _HITS, _NET, _ROWS, _register, _run, L, U, log
from .sinks import reports
from .sources import formats
from .streaming import streams
from .thresholds import DEFAULT

#: Where the first part of the log ends, in the middle of the busiest seconds.
_CUT = 1767225600 + 1005
_CLOSING = '0.0.0.0 - - [01/Jan/2030:00:00:00 +0000] "GET / HTTP/1.1" 204 1 "-" "-"'


def _grown(spark: SparkSession, lines: DataFrame, first, run) -> None:
    """run(folder) after each of the two parts of the lines."""
    folder = stored.scratch(spark, "growing")
    lines.filter(first).select("value").write.mode("append").text(folder)
    run(folder)
    closing = spark.createDataFrame([(_CLOSING,)], "value string")
    lines.filter(~first).select("value").unionByName(closing).write.mode("append").text(folder)
    run(folder)


def _ended(writer, marks: str) -> None:
    writer.option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def _by_time(spark: SparkSession, sf_dir: str):
    lines = corpus.log_lines(spark, sf_dir)
    return lines, corpus.second_of_number() < _CUT


def _appended(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """What make(entries) appends, written as Parquet and read again."""
    out, marks, schema = stored.scratch(spark, "streamed"), stored.scratch(spark, "stream-marks"), []

    def run(folder):
        df = make(streams.entries(spark, folder))
        schema[:] = [df.schema]
        _ended(df.writeStream.format("parquet").option("path", out), marks)

    _grown(spark, *_by_time(spark, sf_dir), run)
    return spark.read.schema(schema[0]).parquet(out)


_register("stream_seconds", f"{_E} SELECT epoch, count(*) AS n FROM e GROUP BY epoch")(lambda spark, d: _appended(spark, d, streams.rps))
_FAMILIES = ", ".join(f"count(*) FILTER (status // 100 = {k}) AS status{k}xx" for k in (2, 3, 4, 5))
_register("stream_minutes", f"{_E} SELECT epoch // 60 AS minute, {_FAMILIES} FROM e GROUP BY 1")(
    lambda spark, d: _appended(spark, d, streams.minute_statuses)
)
_TWO = "(SELECT ip, status, epoch // 60 AS bucket FROM e UNION ALL SELECT ip, status, epoch // 60 + 1 FROM e)"
for _family in (4, 5):
    _register(
        f"stream_storms_{_family}xx",
        f"{_E} SELECT ip, bucket, count(*) FILTER (status // 100 = {_family}) AS most FROM {_TWO} GROUP BY ip, bucket HAVING most >= 2",
    )(lambda spark, d, family=_family: _appended(spark, d, lambda s: streams.storms(s, family, 2)))
_register("stream_hits", f"{_E}, {_HITS} SELECT rule, ip, path, count(*) AS n FROM r GROUP BY ALL")(
    lambda spark, d: _appended(spark, d, lambda s: streams.hits(s).select("rule", "ip", "path"))
    .groupBy("rule", "ip", "path").agg(F.count("*").alias("n"))
)


def _longest(grown: DataFrame, key: str) -> DataFrame:
    """The longest run of each key, the earliest of equally long ones."""
    first = F.max(F.struct("run_seconds", (-F.col("run_start")).alias("before"), "run_start", "run_end")).alias("r")
    return grown.groupBy(key).agg(first).select(key, "r.run_seconds", "r.run_start", "r.run_end")


_SECONDS = "t AS (SELECT ip, epoch, count(*) AS n FROM e GROUP BY ip, epoch)"
_register(
    "stream_ip_bursts",
    f"{_E}, {_SECONDS}, {_run('t', 'ip', f'n >= {DEFAULT.burst_rps}', 'z')} SELECT * FROM z WHERE run_seconds >= {DEFAULT.burst_seconds}",
)(lambda spark, d: _longest(_appended(spark, d, streams.bursts), "ip"))
_register(
    "stream_subnet_bursts",
    f"{_E}, {_NET}, {_run('sn', 'subnet', f'n >= {DEFAULT.subnet_rps} AND ips >= {DEFAULT.subnet_ips}', 'z')} "
    f"SELECT * FROM z WHERE run_seconds >= {DEFAULT.subnet_seconds}",
)(lambda spark, d: _longest(_appended(spark, d, streams.subnet_bursts), "subnet"))
_register(
    "stream_global_bursts",
    f"{_E}, b AS (SELECT epoch FROM e GROUP BY epoch HAVING count(*) >= {DEFAULT.spike_rps}) SELECT a.epoch AS run_start, "
    f"a.epoch + {DEFAULT.spike_seconds - 1} AS run_end FROM b a JOIN b ON b.epoch BETWEEN a.epoch AND a.epoch + {DEFAULT.spike_seconds - 1} "
    f"GROUP BY a.epoch HAVING count(*) = {DEFAULT.spike_seconds}",
)(lambda spark, d: _appended(spark, d, streams.global_bursts))


def _stream_tops(spark, d):
    out, marks, batches = stored.scratch(spark, "streamed"), stored.scratch(spark, "stream-marks"), []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        batches.append(number)

    def run(folder):
        counted = streams.tops(streams.entries(spark, folder), "ip")
        _ended(counted.writeStream.outputMode("complete").foreachBatch(write), marks)

    _grown(spark, *_by_time(spark, d), run)
    return spark.read.schema("value string, count long").parquet(f"{out}/{batches[-1]}").filter("value <> '0.0.0.0'")


_register("stream_tops", f'{_E} SELECT ip AS value, count(*) AS "count" FROM e GROUP BY ip')(_stream_tops)


def _stream_late(spark, d):
    """Lines in the order of events, half by half: busy seconds of the second half lie far behind the first one's end."""
    lines, marks = corpus.log_lines(spark, d), stored.scratch(spark, "stream-marks")
    counter = streams.LateCounter()

    def run(folder):
        entries = streams.entries(spark, folder).filter(F.col("ip") != "0.0.0.0")
        _ended(entries.writeStream.foreachBatch(counter), marks)

    _grown(spark, lines, F.col("k") < lines.count() // 2, run)
    return spark.createDataFrame([(counter.late, counter.newest)], "late long, newest long")


_register(
    "stream_late",
    f"{_E}, h AS (SELECT (SELECT count(*) // 2 FROM e) AS half) SELECT count(*) FILTER (k >= half AND epoch < "
    f"(SELECT max(epoch) FROM e, h WHERE k < half) - {DEFAULT.late_seconds}) AS late, max(epoch) AS newest FROM e, h",
)(_stream_late)

# ---- other line formats ------------------------------------------------------------------------------------------

_register("parse_common", f"{_E} SELECT k, ip, epoch, method, target, path, status, bytes, CAST(NULL AS VARCHAR) AS ua FROM e")(
    lambda spark, d: _parsed(corpus.log_lines(spark, d).withColumn("value", F.regexp_replace("value", ' "[^"]*" "[^"]*"$', "")), parse.BUILT_IN[2])
)
_PIPE = {
    "name": "pipe",
    "pattern": r"^(?<client>[^|]+)\|(?<when>[^|]+)\|(?<verb>[A-Z]+) (?<where>[^|]*) (?<version>HTTP/[0-9.]+)\|"
    r"(?<code>\d+)\|(?<size>[^|]*)\|(?<agent>[^|]*)$",
    "fields": {
        "ip": "client", "timestamp": "when", "method": "verb", "target": "where", "protocol": "version", "status": "code", "bytes": "size",
        "userAgent": "agent",
    },
}


def _parsed(lines, fmt):
    found = parse.enriched(parse.entries(lines, fmt).filter("ok").drop("ok"))
    return found.select("k", "ip", "epoch", "method", "target", "path", "status", "bytes", "ua")


def _piped(spark, d):
    """The log in a format of its own, with times in ISO form."""
    lines = corpus.log_lines(spark, d).withColumn("value", F.regexp_replace("value", "[|]", "%7C"))
    shape = r'^(\S+) - - \[[^\]]+\] "([^"]*)" (\d+) (\S+) "[^"]*" "([^"]*)"$'
    at = F.date_format(F.timestamp_seconds(corpus.second_of_number()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    part = lambda n: F.regexp_extract("value", shape, n)
    lines = lines.withColumn("value", F.concat_ws("|", part(1), at, part(2), part(3), part(4), part(5)))
    return _parsed(lines, formats.parse_config({"formats": [_PIPE]})[0])


_register("parse_custom", f"{_E} SELECT k, ip, epoch, method, target, path, status, bytes, ua FROM e")(_piped)

# ---- filters that the views offer, rows of an incident -------------------------------------------------------------

# Fixed order: that of the presets.
_PRESET_SQL = [
    "status // 100 = 5", "contains(lower(method), 'post')", "contains(lower(coalesce(ua, '')), 'bot')",
    "status // 100 = 2 AND contains(lower(path), '/admin')", "status // 100 = 4", "contains(lower(path), '/api')",
]


def _presets(spark, d):
    counts = parse.access_log(L(spark, d)).agg(*[F.count_if(filterlang.compile_filter(p)).alias(p) for p in filterlang.PRESETS])
    pairs = F.array(*[F.struct(F.lit(p).alias("preset"), F.col(f"`{p}`").alias("n")) for p in filterlang.PRESETS])
    return counts.select(F.inline(pairs))


_PRESET_COUNTS = [f"SELECT '{p}' AS preset, count(*) FILTER ({x}) AS n FROM e" for p, x in zip(filterlang.PRESETS, _PRESET_SQL)]
_register("filter_presets", f"{_E} {' UNION ALL '.join(_PRESET_COUNTS)}")(_presets)


def _value_filters(spark, d):
    """How many rows the filter of each top value finds."""
    rows = stored.keep(log(spark, d), "log")
    tops = U(spark, d)
    # 5 of each
    found = [(panel, r.value) for panel in ("ips", "paths", "statuses", "params") for r in A.top_of(tops, panel, 5).collect()]
    filters = [filterlang.compile_filter(filterlang.top_item_filter(*x)) for x in found]
    counts = rows.agg(*[F.count_if(x).alias(str(i)) for i, x in enumerate(filters)])
    pairs = [F.struct(F.lit(p).alias("panel"), F.lit(v).alias("value"), F.col(f"`{i}`").alias("n")) for i, (p, v) in enumerate(found)]
    return counts.select(F.inline(F.array(*pairs)))


_NAMES = "(SELECT row, unnest(list_distinct([split_part(x, '=', 1) for x in string_split(query, '&')])) AS value FROM e WHERE query <> '')"
_TOP5 = "(SELECT '{0}' AS panel, value, count(*) AS n FROM {1} GROUP BY value ORDER BY n DESC, value LIMIT 5)"
_PANEL_SQL = {p: f"(SELECT CAST({c} AS VARCHAR) AS value FROM e)" for p, c in (("ips", "ip"), ("paths", "path"), ("statuses", "status"))}
_PANEL_SQL["params"] = _NAMES
_register("filter_of_top_value", f"{_E} {' UNION ALL '.join(_TOP5.format(*x) for x in _PANEL_SQL.items())}")(_value_filters)


def _incident_log(spark, d):
    """GET rows of the first incident that has any rows, by id."""
    found = analysis.Analysis(L(spark, d))
    first = found.bridge.agg(F.min("id").alias("id")).first().id
    return query.incident_log(found.log, found.bridge, first, "method:GET").select("row", "ip", "status")


_register(
    "incident_log",
    f"{_ALL}, {_ROWS} SELECT row, ip, status FROM e WHERE contains(lower(method), 'get') "
    "AND row IN (SELECT row FROM br WHERE id = (SELECT min(id) FROM br))",
)(_incident_log)

# ---- reports -----------------------------------------------------------------------------------------------------


def _report(spark, d):
    """Numbers as they stand in the JSON report of the log files, and in the lines of the other forms."""
    made = api.analyze(spark, corpus.log_files(spark, d, ".log")).report(with_matches=False)
    back = json.loads(reports.to_json(made))
    rows = [("summary", k, back["summary"][k]) for k in ("files", "totalLines", "parsedLines", "invalidLines", "totalBytes")]
    for key, _, what in reports.PANELS:
        if what in ("ips", "paths", "methods", "statuses"):
            rows += [(what, x["value"], x["count"]) for x in back[key]]
    rows += [("kind", k, sum(x["kind"] == k for x in back["incidents"])) for k in sorted({x["kind"] for x in back["incidents"]})]
    for form, text in (("markdown", reports.to_markdown(made)), ("html", reports.to_html(made)), ("terminal", reports.to_terminal(made))):
        lines = text.replace("<tr>", "\n<tr>").splitlines()
        shown = [(x["value"], x["count"]) for x in back["topMethods"] if any(x["value"] in y and str(x["count"]) in y for y in lines)]
        rows += [(form, *x) for x in shown]
    return spark.createDataFrame(rows, "section string, key string, n long")


_TOP20 = "(SELECT '{0}' AS section, CAST({1} AS VARCHAR) AS key, count(*) AS n FROM e GROUP BY 2 ORDER BY n DESC, key LIMIT 20)"
_SUMMARY = {
    "files": f"count(DISTINCT k // {corpus.FILE_LINES})", "totalLines": "count(*)", "parsedLines": "count(*)",
    "invalidLines": "count(*) FILTER (ip IS NULL)", "totalBytes": "CAST(sum(bytes) AS BIGINT)",
}
_register(
    "report_forms",
    f"{_ALL} " + " UNION ALL ".join([
        *(f"SELECT 'summary' AS section, '{k}' AS key, {x} AS n FROM e" for k, x in _SUMMARY.items()),
        *(_TOP20.format(*x) for x in (("ips", "ip"), ("paths", "path"), ("methods", "method"), ("statuses", "status"))),
        "SELECT 'kind', kind, count(*) FROM ff GROUP BY kind",
        *(_TOP20.format(x, "method") for x in ("markdown", "html", "terminal")),
    ]),
)(_report)
