"""Log inputs of any kind to numbered, parsed entries."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import stored
from ..operators import parse
from . import archives

SAMPLE_LINES, LEAST_RATIO = 200, 0.8


@dataclass
class InputFormat:
    file: str
    format: str
    sampledLines: int
    parsedSampleLines: int
    sampleParseRatio: float


def read_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """source, order (of the source), block, place, value of all non-empty lines, plain, gzip or archived."""
    plain = [p for p in files if not archives.is_archive(p)]
    packed = [p for p in files if archives.is_archive(p)]
    out = None
    if plain:
        text = spark.read.text(plain)
        path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
        out = text.select(path.alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    if packed:
        more = archives.read_archives(spark, packed)
        out = more if out is None else out.unionByName(more)
    if out is None:
        raise ValueError("no input")
    # sources stand in the order of the files; entries of an archive in the order they were found
    order = spark.createDataFrame([(p, i) for i, p in enumerate(files)], "file string, order long")
    out = out.withColumn("file", F.when(F.contains("source", F.lit("::")), F.regexp_extract("source", r"^(.*?\.(?:zip|tar\.gz|tgz))::", 1)).otherwise(F.col("source")))
    return out.join(F.broadcast(order), "file").filter("value <> ''").drop("file")


def sampled(lines: DataFrame, n: int = SAMPLE_LINES) -> DataFrame:
    """order, source, value, _n: the first n lines of each source, picked where they are: each task gives the first n of each
    source that it sees, and only these shuffle."""
    kinds = "order long, source string, block long, place long, value string"

    def heads(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            sources = batch.column(1).to_pylist()
            rows = []
            for i, source in enumerate(sources):
                if seen.get(source, 0) < n:
                    seen[source] = seen.get(source, 0) + 1
                    rows.append(i)
            if rows:
                yield batch.take(pa.array(rows))

    few = lines.select("order", "source", "block", "place", "value").mapInArrow(heads, kinds)
    place = F.row_number().over(Window.partitionBy("order", "source").orderBy("block", "place"))
    return few.withColumn("_n", place).filter(F.col("_n") <= n)


def detect(spark: SparkSession, lines: DataFrame, wanted: str = "auto", custom: list[parse.Format] | None = None) -> list[tuple[InputFormat, parse.Format]]:
    """The format of each source by its first lines.  A source of which no format parses four fifths is an error."""
    every = [*(custom or []), *parse.BUILT_IN]
    tried = every if wanted == "auto" else [f for f in every if f.id == wanted]
    if not tried:
        raise ValueError(f"unknown format: {wanted}")
    rows = stored.keep(sampled(lines), "sampled-lines")
    by_source = lambda df: df.groupBy("order", "source").agg(F.count("*").alias("n")).orderBy("order", "source").toLocalIterator()
    counts = {f.id: {r.source: r.n for r in by_source(parse.entries(rows, f).filter("ok"))} for f in tried}
    out = []
    for r in by_source(rows):  # a row a source
        best = max(tried, key=lambda f: counts[f.id].get(r.source, 0))
        n = counts[best.id].get(r.source, 0)
        if n / r.n < LEAST_RATIO:
            raise ValueError(f"{r.source}: not a log of format {wanted} ({n} of {r.n} sampled lines parse)")
        out.append((InputFormat(r.source, best.id, r.n, n, round(n / r.n, 3)), best))
    return out


def _numbers(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """0-based number of each row by (keys, block, place), counted block by block, never in one task."""
    counts = df.groupBy(*keys, "block").agg(F.count("*").alias("_n"))
    w = (Window.partitionBy(*keys) if keys else Window).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "block", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("place"))
    return df.join(starts, [*keys, "block"]).withColumn(name, F.col("_start") + own - 1).drop("_start")


def read_log(spark: SparkSession, files: list[str], wanted: str = "auto", custom: list[parse.Format] | None = None, since=None, until=None) -> tuple[DataFrame, DataFrame, list[InputFormat]]:
    """(all lines with ok and fields, kept entries with row, formats)."""
    lines = read_lines(spark, files)
    found = detect(spark, lines, wanted, custom)
    if not found:
        raise ValueError("input has no lines")
    lines = _numbers(lines, ["order", "source"], "line").withColumn("line", F.col("line") + 1)
    parsed = None
    for fmt in {f.id: f for _, f in found}.values():
        own = [i.file for i, f in found if f.id == fmt.id]
        part = parse.entries(lines.filter(F.col("source").isin(own)) if len(found) > 1 else lines, fmt)
        parsed = part if parsed is None else parsed.unionByName(part)
    kept = parse.time_filtered(parse.enriched(parsed.filter("ok")), since, until)
    # rows are numbered over sources in order: first sources, then blocks
    total = kept.groupBy("order", "source").agg(F.count("*").alias("_c"))
    before = total.select("order", "source", F.coalesce(F.sum("_c").over(Window.orderBy("order", "source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    kept = _numbers(kept, ["order", "source"], "row").join(F.broadcast(before), ["order", "source"]).withColumn("row", F.col("row") + F.col("_before")).drop("_before")
    return parsed, kept, [i for i, _ in found]
