"""Structured Streaming over growing logs: the same parsing, watermarked windows, and stateful bursts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import parse, rules
from ..thresholds import DEFAULT, Thresholds

LATE = "60 seconds"
IDLE_SECONDS = 900


def entries(spark: SparkSession, folder: str, fmt: parse.Format = parse.BUILT_IN[0], files_per_trigger: int | None = None) -> DataFrame:
    """Parsed entries of the text files that appear in a folder, with ts."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return timed(parse.entries(reader.text(folder), fmt).filter("ok").drop("ok"))


def timed(parsed: DataFrame) -> DataFrame:
    df = parsed.withColumn("epoch", S.epoch_of(F.col("timestamp"))).filter("epoch is not null")
    return df.withColumn("path", F.split_part("target", F.lit("?"), F.lit(1))).withColumn("ts", F.timestamp_seconds("epoch"))


def rps(stream: DataFrame) -> DataFrame:
    """epoch, n of each second, once it is closed by the watermark."""
    w = stream.withWatermark("ts", LATE).groupBy(F.window("ts", "1 second")).agg(F.count("*").alias("n"))
    return w.select(F.unix_seconds("window.start").alias("epoch"), "n")


def minute_statuses(stream: DataFrame) -> DataFrame:
    """minute, status2xx..5xx."""
    family = S.status_class(F.col("status"))
    w = stream.withWatermark("ts", LATE).groupBy(F.window("ts", "1 minute")).agg(*[F.count_if(family == k).alias(f"status{k}xx") for k in (2, 3, 4, 5)])
    return w.select(F.floor(F.unix_seconds("window.start") / 60).alias("minute"), *[f"status{k}xx" for k in (2, 3, 4, 5)])


def storms(stream: DataFrame, family: int, limit: int = DEFAULT.storm_4xx) -> DataFrame:
    """ip, bucket, most: two adjacent minutes with at least `limit` responses of the family; bucket is the later one."""
    # all entries move the watermark on, so they are counted by condition and not filtered before
    family_rows = F.count_if(S.status_class(F.col("status")) == family).alias("most")
    w = stream.withWatermark("ts", LATE).groupBy("ip", F.window("ts", "2 minutes", "1 minute")).agg(family_rows).filter(F.col("most") >= limit)
    return w.select("ip", (F.floor(F.unix_seconds("window.start") / 60) + 1).alias("bucket"), "most")


def tops(stream: DataFrame, column: str) -> DataFrame:
    """value, count; write in complete mode, or in update mode to a keyed sink."""
    return stream.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))


def hits(stream: DataFrame) -> DataFrame:
    """Signature hits, without state."""
    return stream.withColumn("rule", F.explode(rules.rule_ids(F.col("target"), F.col("method"))))


class LateCounter:
    """For foreachBatch: counts the entries more than `seconds` behind the newest entry of all earlier batches.  The count is
    distributed; a batch gives two numbers.  A batch that comes again after a restart counts once."""

    def __init__(self, seconds: int = DEFAULT.late_seconds):
        self.seconds, self.newest, self.late, self.last = seconds, None, 0, -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        limit = F.lit(self.newest).cast("long") - self.seconds
        row = batch.agg(F.max("epoch").alias("newest"), F.count_if(F.col("epoch") < limit).alias("late")).first()
        self.late += row.late
        self.newest = max((x for x in (self.newest, row.newest) if x is not None), default=None)
        self.last = number


def late_counter(stream: DataFrame, seconds: int = DEFAULT.late_seconds):
    """(LateCounter, writer): start the writer, and read late from the counter."""
    counter = LateCounter(seconds)
    return counter, stream.writeStream.foreachBatch(counter)


def bursts(stream: DataFrame, t: Thresholds = DEFAULT, key: str = "ip") -> DataFrame:
    """Runs of consecutive seconds with at least burst_rps requests: a row (key, run_seconds, run_start, run_end) whenever
    a run that is long enough grows."""
    return _runs(stream, key, t.burst_rps, t.burst_seconds)


def subnet_bursts(stream: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The same for subnets: seconds with at least subnet_rps requests of at least subnet_ips addresses."""
    nets = stream.withColumn("subnet", S.subnet_of(F.col("ip"))).filter("subnet is not null")
    return _runs(nets, "subnet", t.subnet_rps, t.subnet_seconds, t.subnet_ips)


def global_bursts(stream: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """run_start, run_end of every stretch of spike_seconds seconds that each have at least spike_rps requests of all clients
    (a running baseline would need all seconds): sliding windows over counted seconds, so nothing meets in one task but one
    row a second.  Stretches of a longer run overlap."""
    counted = stream.withWatermark("ts", LATE).groupBy(F.window("ts", "1 second")).agg(F.count("*").alias("n")).filter(F.col("n") >= t.spike_rps)
    along = F.window(F.window_time("window"), f"{t.spike_seconds} seconds", "1 second")
    full = counted.groupBy(along.alias("stretch")).agg(F.count("*").alias("busy")).filter(F.col("busy") == t.spike_seconds)
    return full.select(F.unix_seconds("stretch.start").alias("run_start"), (F.unix_seconds("stretch.end") - 1).alias("run_end"))


def _runs(stream: DataFrame, key: str, least: int, seconds: int, ips: int = 0) -> DataFrame:
    """State per key: counts of the seconds that the watermark has not passed yet, at most as many as entries may be late,
    with up to `ips` addresses each, and the current run, which goes after 15 idle minutes of event time."""
    schema = f"{key} string, run_seconds long, run_start long, run_end long"

    def fold(group, frames, state):
        epochs, counts, seen, start, end = state.get if state.exists else ([], [], [], None, None)
        pending = {e: [n, set(s)] for e, n, s in zip(epochs or [], counts or [], seen or [])}
        for f in frames:
            for epoch, own in f.groupby("epoch"):
                held = pending.setdefault(int(epoch), [0, set()])
                held[0] += len(own)
                if len(held[1]) < ips:
                    held[1].update(sorted(set(own["ip"]) - held[1])[: ips - len(held[1])])
        closed = state.getCurrentWatermarkMs() // 1000
        out = []
        for epoch in sorted(e for e in pending if e < closed):
            n, addresses = pending.pop(epoch)
            if n >= least and len(addresses) >= ips:
                start = start if end is not None and epoch == end + 1 else epoch
                end = epoch
                if end - start + 1 >= seconds:
                    out.append((group[0], end - start + 1, start, end))
        wake = min(pending) + 1 if pending else end + IDLE_SECONDS if end is not None else None
        if wake is None or wake <= closed:
            if state.exists:
                state.remove()
        else:
            held = [[*x] for x in zip(*((e, n, sorted(a)) for e, (n, a) in pending.items()))] or [[], [], []]
            state.update((*held, start, end))
            state.setTimeoutTimestamp(wake * 1000)
        if out:
            yield pd.DataFrame(out, columns=[key, "run_seconds", "run_start", "run_end"])

    slim = stream.withWatermark("ts", LATE).select(*dict.fromkeys((key, "ip", "epoch", "ts")))
    kinds = "epochs array<long>, counts array<long>, seen array<array<string>>, start long, end long"
    return slim.groupBy(key).applyInPandasWithState(fold, schema, kinds, "append", "EventTimeTimeout")
