"""A web access log made of the `events` table: one line per event, by fixed arithmetic on its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import stored
from .operators import parse

#: Expressions in SQL that Spark and DuckDB both read; {div} is integer division, {text} a cast to text.
_IP = """CASE WHEN k % 4 = 1 THEN '203.0.113.66' WHEN k % 4 = 3 THEN concat('192.0.2.', (k {div} 4) % 40 + 1) WHEN u % 17 = 0 THEN concat('2001:db8:', u, '::1')
 WHEN u % 25 = 2 THEN concat('66.249.64.', u % 30) ELSE concat('198.51.', (u {div} 100) % 256, '.', u % 100 + 1) END"""
_METHOD = "CASE WHEN k % 4 = 1 THEN 'HEAD' WHEN k % 2 = 0 AND k % 97 = 0 THEN 'TRACE' WHEN k % 2 = 0 AND t IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END"
_TARGET = """CASE WHEN k % 4 = 1 THEN concat('/', k % 13) WHEN k % 4 = 3 THEN concat('/api/list?cursor=', k) WHEN t = 'view' THEN concat('/product/', k % 700)
 WHEN t = 'click' THEN concat('/search?q=term', k % 400, '&page=', k % 7, '&utm_source=feed') WHEN t = 'signup' THEN '/account/signup'
 WHEN t = 'purchase' THEN concat('/checkout?token=s', k, '&step=', k % 3) WHEN (k {div} 2) % 10 = 0 THEN '/item?id=1%20UNION%20SELECT%20password' WHEN (k {div} 2) % 10 = 1 THEN '/.env'
 WHEN (k {div} 2) % 10 = 2 THEN '/x?f=../../etc/passwd' WHEN (k {div} 2) % 10 = 3 THEN '/x?q=<script>alert(1)</script>' WHEN (k {div} 2) % 10 = 4 THEN '/fetch?url=http://169.254.169.254/latest'
 WHEN (k {div} 2) % 10 = 5 THEN '/ping?h=1;id' WHEN (k {div} 2) % 10 = 6 THEN '/robots.txt' ELSE concat('/missing/', k) END"""
_STATUS = """CASE WHEN k % 20 = 3 THEN 503 WHEN k % 2 = 1 THEN 200 WHEN t = 'error' AND (k {div} 2) % 4 = 0 THEN 404 WHEN t = 'error' AND (k {div} 2) % 4 = 1 THEN 200
 WHEN t = 'error' AND (k {div} 2) % 4 = 2 THEN 403 WHEN t = 'error' THEN 500 WHEN k % 50 = 0 THEN 302 ELSE 200 END"""
_BYTES = "CASE WHEN k % 31 <> 0 THEN CAST(floor(v * 100) AS bigint) END"
_AGENT = """CASE WHEN k % 2 = 1 THEN 'curl/8.0' WHEN u % 10 = 0 THEN 'GPTBot/1.0' WHEN u % 10 = 1 THEN 'sqlmap/1.7'
 WHEN u % 10 = 2 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)' WHEN u % 10 = 3 THEN '-'
 ELSE concat('Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/1', u % 20, '.0 Safari/537.36') END"""
_EPOCH = "1767225600 + CASE WHEN k % 2 = 0 THEN k {div} 2 ELSE 1000 + k {div} 800 END"


def _expressions(div: str) -> dict[str, str]:
    found = {"epoch": _EPOCH, "ip": _IP, "method": _METHOD, "target": _TARGET, "status": _STATUS, "bytes": _BYTES, "agent": _AGENT}
    return {n: x.format(div=div).replace("\n", " ") for n, x in found.items()}


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, value: raw lines."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS k", "user_id AS u", "event_type AS t", "value AS v")
    cores = spark.sparkContext.defaultParallelism
    if events.rdd.getNumPartitions() < cores:  # a small table is one row group, and so one task
        events = events.repartition(cores)
    df = events.selectExpr("k", *[f"{x} AS {n}" for n, x in _expressions("div").items()])
    when = F.date_format(F.timestamp_seconds("epoch"), "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(
        "ip", F.lit(" - - ["), when, F.lit(' +0000] "'), "method", F.lit(" "), "target", F.lit(' HTTP/1.1" '), F.col("status").cast("string"), F.lit(" "),
        F.coalesce(F.col("bytes").cast("string"), F.lit("-")), F.lit(' "-" "'), "agent", F.lit('"'),
    )
    return df.select("k", line.alias("value"))


def second_of_number() -> Column:
    """The epoch of the line of event k."""
    return F.expr(_expressions("div")["epoch"])


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed entries of the whole log, for what does not look at row numbers: these take a second pass and a shuffle."""
    return parse.enriched(parse.entries(log_lines(spark, sf_dir), parse.BUILT_IN[0]).filter("ok").drop("ok"))


def stored_entries(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of unnumbered entries in a table, for what reads them several times."""
    return stored.keep(unnumbered(spark, sf_dir).select(*columns), "entries")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and numbered entries of the whole log."""
    df = parse.numbered_by_time(unnumbered(spark, sf_dir))
    return df.withColumn("source", F.lit("events.log")).withColumn("line", F.col("row") + 1)


#: Lines of a derived log file.
FILE_LINES = 500


def log_files(spark: SparkSession, sf_dir: str, ending: str) -> list[str]:
    """The derived log as files of FILE_LINES lines (k div FILE_LINES is the number of the file) of one kind, written by tasks
    into the shared folder."""
    folder = stored.scratch(spark, "log-files").removeprefix("file://")
    lines = log_lines(spark, sf_dir).withColumn("f", F.floor(F.col("k") / FILE_LINES))

    def write(key, pdf):
        import os

        import pandas as pd

        from .sources import archives

        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/access-{key[0]:08d}{ending}"
        archives.write_archive(path, f"logs/access-{key[0]:08d}.log", pdf.sort_values("k")["value"])
        return pd.DataFrame({"path": [path]})

    written = lines.groupBy("f").applyInPandas(write, "path string")
    return sorted(r.path for r in written.toLocalIterator())


def sql_log() -> str:
    """A DuckDB query with the same entries, from the recipe rather than from lines."""
    e = _expressions("//")
    return f"""(SELECT *, row_number() OVER (ORDER BY epoch, k) - 1 AS row, split_part(target, '?', 1) AS path, nullif(agent, '-') AS ua,
 CASE WHEN contains(target, '?') THEN substr(target, strpos(target, '?') + 1) ELSE '' END AS query,
 concat(ip, ' - - [', strftime(to_timestamp(epoch) AT TIME ZONE 'UTC', '%d/%b/%Y:%H:%M:%S'), ' +0000] "', method, ' ', target, ' HTTP/1.1" ', status, ' ', coalesce(CAST(bytes AS VARCHAR), '-'), ' "-" "', agent, '"') AS line_text
 FROM (SELECT k, {", ".join(f"{x} AS {n}" for n, x in e.items())} FROM (SELECT event_id AS k, user_id AS u, event_type AS t, value AS v FROM events)))"""
