"""Summary, top values, and statistics of time, paths, clients, crawlers and subnets.

Distinct counts are made of nested aggregations (key and value, then key), which combine on the map side and need no row
multiplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..thresholds import DEFAULT, Thresholds
from . import windows

TOPS = {
    "ips": lambda: F.col("ip"),
    "paths": lambda: F.col("path"),
    "methods": lambda: F.col("method"),
    "statuses": lambda: F.col("status").cast("string"),
    "userAgents": lambda: S.agent_label(F.col("ua")),
}


def count_if(x: Column) -> Column:
    return F.count_if(x)


def summary(parsed: DataFrame, files: int, since=None, until=None) -> DataFrame:
    """One row over all lines (ok or not): files, totalLines, parsedLines, filteredLines, invalidLines, totalBytes."""
    from .parse import time_filtered

    inside = F.lit(True)
    if since is not None or until is not None:
        marked = time_filtered(parsed.withColumn("_in", F.lit(True)), since, until)
        kept = marked.filter("ok").agg(F.count("*").alias("parsedLines"), F.coalesce(F.sum(F.coalesce("bytes", F.lit(0))), F.lit(0)).alias("totalBytes"))
        total = parsed.agg(F.count("*").alias("totalLines"), count_if(~F.col("ok")).alias("invalidLines"))
        both = total.join(F.broadcast(kept))  # one row each
        return both.select(
            F.lit(files).cast("bigint").alias("files"), "totalLines", "parsedLines",
            (F.col("totalLines") - F.col("invalidLines") - F.col("parsedLines")).alias("filteredLines"), "invalidLines", "totalBytes",
        )
    ok = F.col("ok") & inside
    return parsed.agg(
        F.lit(files).cast("bigint").alias("files"), F.count("*").alias("totalLines"), count_if(ok).alias("parsedLines"), F.lit(0).cast("bigint").alias("filteredLines"),
        count_if(~F.col("ok")).alias("invalidLines"), F.coalesce(F.sum(F.when(ok, F.coalesce("bytes", F.lit(0)))), F.lit(0)).alias("totalBytes"),
    )


def top(df: DataFrame, value: Column, k: int) -> DataFrame:
    """value, count of the k most frequent values; of equal counts the smaller value first."""
    counted = df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "value").limit(max(k, 0))


def top_of(entries: DataFrame, what: str, k: int = 20) -> DataFrame:
    if what == "params":
        return top(entries.select(F.explode(S.param_names(F.col("target"))).alias("v")), F.col("v"), k)
    if what == "paramValues":
        return top(entries.select(F.explode(S.param_labels(F.col("target"))).alias("v")), F.col("v"), k)
    if what == "userAgents":  # labels are made once a distinct agent
        agents = entries.groupBy("ua").agg(F.count("*").alias("n"))
        counted = agents.groupBy(S.agent_label(F.col("ua")).alias("value")).agg(F.sum("n").alias("count"))
        return counted.orderBy(F.desc("count"), "value").limit(max(k, 0))
    return top(entries, TOPS[what](), k)


def insights(log: DataFrame, k: int = 10) -> DataFrame:
    """panel, value, count: the k most frequent values of six panels over stored rows; "-" and empty values don't count."""
    one = lambda panel, x: F.struct(F.lit(panel).alias("panel"), x.alias("value"))
    panels = F.concat(
        F.array(one("ips", F.col("ip")), one("paths", F.col("path")), one("userAgents", S.agent_label(F.col("userAgent"))), one("statuses", F.col("status").cast("string"))),
        F.transform(S.param_names(F.col("target")), lambda v: one("params", v)),
        F.transform(S.param_labels(F.col("target")), lambda v: one("paramValues", v)),
    )
    counted = log.select(F.explode(panels).alias("p")).select("p.*").filter("value is not null and value not in ('', '-')").groupBy("panel", "value").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("count"), "value"))
    return counted.withColumn("_n", place).filter(F.col("_n") <= k).drop("_n")


# ---- time ------------------------------------------------------------------------------------------------------


def rps(entries: DataFrame) -> DataFrame:
    """epoch, n: requests of each second that has any."""
    return entries.filter("epoch is not null").groupBy("epoch").agg(F.count("*").alias("n"))


def p95(seconds: DataFrame) -> DataFrame:
    """One row: p95 of requests a second from the first to the last second, empty seconds included.

    With n seconds, of which z are empty, the value stands at place k = floor((n - 1) * 0.95) of the ascending counts: 0
    if k < z, else the (k - z)th of the others.  Counts are grouped first, so the ranking is over distinct counts."""
    grouped = seconds.groupBy("n").agg(F.count("*").alias("times"), F.min("epoch").alias("a"), F.max("epoch").alias("b"))
    w = Window.orderBy("n")
    every = Window.partitionBy()
    ranked = grouped.select(
        "n", F.sum("times").over(w).alias("upto"), F.sum("times").over(every).alias("busy"), F.min("a").over(every).alias("a"), F.max("b").over(every).alias("b")
    )
    length = F.col("b") - F.col("a") + 1
    k = F.floor((length - 1) * 0.95) - (length - F.col("busy"))
    return ranked.agg(F.coalesce(F.min(F.when((k >= 0) & (F.col("upto") > k), F.col("n"))), F.lit(0)).cast("bigint").alias("p95"))


def late_rows(entries: DataFrame, seconds: int = 60) -> DataFrame:
    """One row: late, the number of entries more than `seconds` behind an earlier one.

    A running maximum over all rows, in two levels: within blocks of rows, and over the blocks' maxima."""
    block = F.floor(F.col("row") / 100_000)
    rows = entries.filter("epoch is not null").select("row", "epoch", block.alias("block"))
    own = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.max("epoch").alias("m")).select("block", F.max("m").over(before).alias("before"))
    seen = rows.withColumn("own", F.max("epoch").over(own)).join(blocks, "block")
    return seen.agg(count_if(F.col("epoch") < F.greatest("own", "before") - seconds).alias("late"))


def time_stats(entries: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """One row: firstSeen, lastSeen, peakGlobalRps, peakGlobalRpsAt, globalRpsP95, invalidTimestampLines,
    outOfOrderTimestamps, droppedIpCount, droppedSubnetCount (both 0: nothing is dropped)."""
    seconds = rps(entries)
    span = seconds.agg(F.min("epoch").alias("a"), F.max("epoch").alias("b"), F.coalesce(F.max("n"), F.lit(0)).alias("peak"), F.max_by("epoch", F.struct("n", -F.col("epoch"))).alias("at"))
    bad = entries.agg(count_if(F.col("epoch").isNull()).alias("bad"))
    one = span.join(F.broadcast(p95(seconds))).join(F.broadcast(bad)).join(F.broadcast(late_rows(entries, t.late_seconds)))  # one row each
    return one.select(
        S.iso_of(F.col("a")).alias("firstSeen"), S.iso_of(F.col("b")).alias("lastSeen"), F.col("peak").alias("peakGlobalRps"), S.iso_of(F.col("at")).alias("peakGlobalRpsAt"),
        F.col("p95").alias("globalRpsP95"), F.col("bad").alias("invalidTimestampLines"), F.col("late").alias("outOfOrderTimestamps"),
        F.lit(0).cast("bigint").alias("droppedIpCount"), F.lit(0).cast("bigint").alias("droppedSubnetCount"),
    )


# ---- paths -----------------------------------------------------------------------------------------------------


def status_counts(x: str = "status") -> list[Column]:
    return [count_if(S.status_class(F.col(x)) == k).alias(f"status{k}xx") for k in (2, 3, 4, 5)]


def path_minutes(entries: DataFrame) -> DataFrame:
    """path, minute, n, served."""
    return entries.filter("epoch is not null").groupBy("path", F.floor(F.col("epoch") / 60).alias("minute")).agg(F.count("*").alias("n"), count_if(S.is_served(F.col("status"))).alias("served"))


def path_stats(entries: DataFrame, t: Thresholds = DEFAULT, samples: bool = False) -> DataFrame:
    """One row a path: count, bytes, uniqueIps, repeatedIps, repeatedRequests, queryVariants, postCount, firstSeen,
    lastSeen (epoch), status2xx..5xx, maxRequestsPerMinute, maxServedPerMinute, and on demand samples."""
    by_ip = entries.groupBy("path", "ip").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), count_if(F.col("method") == "POST").alias("posts"), F.min("epoch").alias("a"),
        F.max("epoch").alias("b"), *status_counts(),
    )
    again = F.col("n") >= t.repeated_ip_requests
    main = by_ip.groupBy("path").agg(
        F.sum("n").alias("count"), F.sum("bytes").alias("bytes"), F.count("*").alias("uniqueIps"), count_if(again).alias("repeatedIps"),
        F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("repeatedRequests"), F.sum("posts").alias("postCount"), F.min("a").alias("firstSeen"), F.max("b").alias("lastSeen"),
        *[F.sum(f"status{k}xx").alias(f"status{k}xx") for k in (2, 3, 4, 5)],
    )
    variants = entries.filter("signature <> ''").groupBy("path", "signature").agg(F.lit(1).alias("x")).groupBy("path").agg(F.count("*").alias("queryVariants"))
    minutes = path_minutes(entries).groupBy("path").agg(F.max("n").alias("maxRequestsPerMinute"), F.max("served").alias("maxServedPerMinute"))
    out = main.join(variants, "path", "left").join(minutes, "path", "left").fillna(0, ["queryVariants", "maxRequestsPerMinute", "maxServedPerMinute"])
    if samples:
        shown = entries.filter(F.contains("target", F.lit("?"))).select("path", "row", S.clipped(S.redacted(F.col("full"))).alias("sample"))
        out = out.join(windows.first_distinct(shown, ["path"], "sample", "row", 5, "samples"), "path", "left")
    return out


# ---- clients ---------------------------------------------------------------------------------------------------


def ip_seconds(entries: DataFrame) -> DataFrame:
    """ip, epoch, n, heads."""
    return entries.filter("epoch is not null").groupBy("ip", "epoch").agg(F.count("*").alias("n"), count_if(F.col("method") == "HEAD").alias("heads"))


def ip_profiles(entries: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """One row an ip with readable times: totalRequests, firstSeen, lastSeen (epoch), peakRps, peakRpsAt, pathCount and
    uaCount (capped), status4xxCount, status5xxCount, headCount, peakHeadRps, peakHeadRpsAt."""
    timed = entries.filter("epoch is not null")
    by_path = timed.groupBy("ip", "path").agg(
        F.count("*").alias("n"), F.min("epoch").alias("a"), F.max("epoch").alias("b"), count_if(S.status_class(F.col("status")) == 4).alias("c4"), count_if(S.status_class(F.col("status")) == 5).alias("c5"),
        count_if(F.col("method") == "HEAD").alias("h"),
    )
    main = by_path.groupBy("ip").agg(
        F.sum("n").alias("totalRequests"), F.min("a").alias("firstSeen"), F.max("b").alias("lastSeen"), F.least(F.count("*"), F.lit(t.cap_paths)).cast("bigint").alias("pathCount"),
        F.sum("c4").alias("status4xxCount"), F.sum("c5").alias("status5xxCount"), F.sum("h").alias("headCount"),
    )
    agents = timed.filter("ua is not null").groupBy("ip", "ua").agg(F.lit(1).alias("x")).groupBy("ip").agg(F.least(F.count("*"), F.lit(t.cap_agents)).cast("bigint").alias("uaCount"))
    peaks = ip_seconds(timed).groupBy("ip").agg(
        F.max("n").alias("peakRps"), F.max_by("epoch", F.struct("n", -F.col("epoch"))).alias("peakRpsAt"), F.max("heads").alias("peakHeadRps"),
        F.max_by("epoch", F.when(F.col("heads") > 0, F.struct("heads", -F.col("epoch")))).alias("peakHeadRpsAt"),
    )
    return main.join(agents, "ip", "left").join(peaks, "ip").fillna(0, ["uaCount"])


def top_clients(profiles: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return profiles.orderBy(F.desc("totalRequests"), "ip").limit(t.top_ips).select(
        "ip", "totalRequests", S.iso_of(F.col("firstSeen")).alias("firstSeen"), S.iso_of(F.col("lastSeen")).alias("lastSeen"), "peakRps", S.iso_of(F.col("peakRpsAt")).alias("peakRpsAt"),
        "pathCount", "uaCount", "status4xxCount", "status5xxCount",
    )


def storms(entries: DataFrame, family: int) -> DataFrame:
    """ip, most (responses of the family in two adjacent minutes), bucket."""
    hits = entries.filter(F.col("epoch").isNotNull() & (S.status_class(F.col("status")) == family))
    return windows.two_bucket_max(hits.groupBy("ip", F.floor(F.col("epoch") / 60).alias("bucket")).agg(F.count("*").alias("n")), "ip", "bucket", "n")


def fingerprint_hits(entries: DataFrame, fingerprints: list[str]) -> DataFrame:
    """ip, hits (distinct scanner paths in two adjacent minutes), bucket, samplePaths."""
    seen = entries.filter(F.col("epoch").isNotNull() & F.col("path").isin(fingerprints)).groupBy("ip", "path", F.floor(F.col("epoch") / 60).alias("b")).agg(F.min("row").alias("row"))
    own = seen.select("ip", F.col("b").alias("bucket")).distinct()
    spread = seen.select("ip", "path", "row", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("bucket")).join(own, ["ip", "bucket"], "left_semi")
    counted = spread.groupBy("ip", "bucket", "path").agg(F.min("row").alias("row")).groupBy("ip", "bucket").agg(
        F.count("*").alias("hits"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("row", "path"))), lambda x: x["path"]), 1, 10).alias("samplePaths")
    )  # at most the fixed list of paths each
    best = F.max_by(F.struct("hits", "bucket", "samplePaths"), F.struct("hits", -F.col("bucket"))).alias("best")
    return counted.groupBy("ip").agg(best).select("ip", "best.*")


def known_actors(entries: DataFrame) -> DataFrame:
    """Entries with readable times, with bot and scanner: the first names that the ip's agents had up to the row.

    Agents are matched once a distinct agent; a client's first row with an agent that matches is found by aggregation, so no
    client's rows are sorted in one task."""
    from ..data import agents

    timed = entries.filter("epoch is not null")
    named = timed.filter("ua is not null").groupBy("ip", "ua").agg(F.min("row").alias("row"))
    named = named.select(
        "ip", "ua", "row", S.ai_bot(F.col("ua")).alias("bot"), S.scanner(F.col("ua")).alias("scanner"),
        F.col("ua").rlike("(?i)" + agents.GOOGLEBOT).alias("google"), F.col("ua").rlike("(?i)" + agents.BINGBOT).alias("bing"),
    )
    first = lambda what, when: F.min_by(what, F.when(when, F.col("row")))
    return named.groupBy("ip").agg(
        first("bot", F.col("bot").isNotNull()).alias("bot"), F.min(F.when(F.col("bot").isNotNull(), F.col("row"))).alias("botFrom"),
        first("scanner", F.col("scanner").isNotNull()).alias("scanner"), first("ua", F.col("scanner").isNotNull()).alias("scannerAgent"),
        F.max("google").alias("google"), F.max("bing").alias("bing"), first("ua", F.col("google") | F.col("bing")).alias("claimedAgent"),
    )


def bot_rollup(entries: DataFrame, actors: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """One row an AI bot.  A client's rows count for its first bot from that bot's first row on, whatever agents follow."""
    bots = actors.filter("bot is not null").select("ip", "bot", "botFrom")
    if bots.limit(t.broadcast_ips + 1).count() <= t.broadcast_ips:
        bots = F.broadcast(bots)  # rows of other clients then stay where they are
    rows = entries.filter("epoch is not null").join(bots, "ip").filter("row >= botFrom").withColumn("minute", F.floor(F.col("epoch") / 60))
    served = S.is_served(F.col("status"))
    fine = rows.groupBy("bot", "minute", "path").agg(
        F.count("*").alias("n"), F.min("epoch").alias("a"), F.max("epoch").alias("b"), count_if(served).alias("served"), *status_counts()
    )
    minutes = fine.groupBy("bot", "minute").agg(F.count("*").alias("paths"), F.sum("served").alias("served")).groupBy("bot").agg(
        F.max("paths").alias("maxPathsPerMinute"), count_if(F.col("paths") > t.ai_minute_paths).alias("highPathMinutes"), F.max("served").alias("maxServedPerMinute")
    )
    paths = fine.groupBy("bot", "path").agg(
        F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), *[F.sum(f"status{k}xx").alias(f"status{k}xx") for k in (2, 3, 4, 5)]
    ).groupBy("bot").agg(
        F.sum("n").alias("requests"), F.least(F.count("*"), F.lit(t.cap_bot_paths)).cast("bigint").alias("pathCount"), F.max(F.col("path") == "/robots.txt").alias("requestedRobotsTxt"),
        F.min("a").alias("firstSeen"), F.max("b").alias("lastSeen"), *[F.sum(f"status{k}xx").alias(f"status{k}xx") for k in (2, 3, 4, 5)],
    )
    ips = bots.groupBy("bot").agg(F.least(F.count("*"), F.lit(t.cap_bot_ips)).cast("bigint").alias("ipCount"))
    return paths.join(minutes, "bot").join(ips, "bot").withColumnRenamed("bot", "botName")


def ordered_bots(bots: DataFrame) -> DataFrame:
    """Bots by requests, most first, then by name."""
    return bots.orderBy(F.desc("requests"), "botName")


def subnet_seconds(entries: DataFrame, t: Thresholds = DEFAULT, subnet=S.subnet_of) -> DataFrame:
    """subnet, epoch, n, ips.  What is no valid address is left out, or counted with subnet=S.subnet_or_text."""
    by_ip = ip_seconds(entries).withColumn("subnet", subnet(F.col("ip"))).filter("subnet is not null")
    return by_ip.groupBy("subnet", "epoch").agg(F.sum("n").alias("n"), F.least(F.count("*"), F.lit(t.cap_subnet_ips)).cast("bigint").alias("ips"))
