"""Which stored rows an incident is about: a bridge table (id, row), exact, for incidents that remain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..data import agents, paths as P
from ..functions import scalars as S


#: Detectors by the start of their ids: those about a path, and those about an address with the rows that count.
BY_PATH = ("abusive_crawl", "query_explosion", "post_hotspot")
BY_ADDRESS = {
    "http_4xx_storm": lambda: S.status_class(F.col("status")) == 4,
    "http_5xx_storm": lambda: S.status_class(F.col("status")) == 5,
    "http_head_flood": lambda: F.col("method") == "HEAD",
    "scanner_signature_paths": lambda: F.col("path").isin(P.FINGERPRINT_PATHS),
    **dict.fromkeys(("fake_bot_googlebot", "fake_bot_bingbot", "ddos_rps_burst_single_ip", "single_ip_path_explosion", "ua_rotation_same_ip"), lambda: F.lit(True)),
}


def incident_rows(entries: DataFrame, hits: DataFrame, incidents: DataFrame) -> DataFrame:
    """id, row.  incidents are scored ones, with their facts.  Detectors with the same key share one join."""
    detector = F.substring_index("id", ":", 1)
    about = incidents.select("id", "kind", "_ip", "_subject", detector.alias("_d"))
    rules = about.join(hits.select("rule").distinct().withColumnRenamed("rule", "_subject"), "_subject", "left_semi")
    rules = rules.select("id", F.col("_subject").alias("rule"), F.col("_ip").alias("ip"))
    out = [hits.select("row", "ip", "rule").join(rules, ["ip", "rule"]).select("id", "row")]

    of_path = about.filter(F.col("_d").isin(*BY_PATH)).select("id", F.col("_subject").alias("path"))
    out.append(entries.select("row", "path").join(of_path, "path").select("id", "row"))

    of_ip = about.filter(F.col("_d").isin(*BY_ADDRESS)).select("id", "_d", F.col("_ip").alias("ip"))
    counts = reduce(lambda x, y: x | y, [(F.col("_d") == d) & rows() for d, rows in BY_ADDRESS.items()])
    out.append(entries.select("row", "ip", "status", "method", "path").join(of_ip, "ip").filter(counts).select("id", "row"))

    of_subnet = about.filter(F.col("_d") == "ddos_distributed_subnet").select("id", F.col("_subject").alias("subnet"))
    out.append(entries.select("row", S.subnet_of(F.col("ip")).alias("subnet")).join(of_subnet, "subnet").select("id", "row"))

    scanners = about.filter(F.col("_d") == "scanner_ua_known").select("id", F.col("_subject").alias("name"), F.col("_ip").alias("ip"))
    matches = _agents_matching(entries, agents.SCANNERS)
    out.append(entries.select("row", "ip", "ua").join(scanners, "ip").join(matches, ["ua", "name"], "left_semi").select("id", "row"))

    bots = about.filter(F.col("_d") == "ai_scraper_known").select("id", "kind", F.col("_subject").alias("name"))
    named = _agents_matching(entries, agents.AI_BOTS).join(bots, "name").select("ua", "id", "kind")
    served = (F.col("kind") != "saturation") | S.is_served(F.col("status"))
    out.append(entries.select("row", "ua", "status").join(named, "ua").filter(served).select("id", "row"))
    return reduce(DataFrame.unionByName, out)


def _agents_matching(entries: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """ua, name for every pattern that a distinct agent matches (not the first one only)."""
    names = F.array_compact(F.array(*[F.when(F.col("ua").rlike("(?i)" + p), F.lit(n)) for n, p in patterns]))
    return entries.filter("ua is not null").select("ua").distinct().select("ua", F.explode(names).alias("name"))


def match_counts(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("id").agg(F.count("*").alias("totalMatches"))


def match_samples(bridge: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` rows of each incident."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("row"))
    return bridge.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")
