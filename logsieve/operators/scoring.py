"""Scoring of all incidents together, and their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from .incidents import COLUMNS

# Bonuses and ladders.
CORRELATED, PERSISTENT, PERSISTENT_SECONDS, POLITE, POLITE_REQUESTS, MOST_IMPACT = 10, 15, 1800, -10, 5000, 15
NEVER_PERSISTENT = ["abusive_crawling", "ai_scraper", "post_hotspot"]
LADDERS = {
    "requests": [(100_000, 8), (50_000, 6), (10_000, 4), (5_000, 2)],
    "served": [(600, 7), (300, 5), (120, 3), (60, 1)],
    "peak": [(500, 8), (250, 6), (100, 4), (50, 2), (10, 1)],
    "errors": [(1000, 8), (500, 6), (100, 4), (25, 2)],
    "ips": [(1000, 5), (200, 4), (50, 2), (10, 1)],
    "seconds": [(3600, 4), (1800, 3), (600, 2), (120, 1)],
}
KINDS = {"compromise": 3, "saturation": 2, "noise": 1}
SEVERITIES = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def _ladder(x: Column, steps: list[tuple[int, int]]) -> Column:
    out = F.when(x >= steps[0][0], steps[0][1])
    for least, bonus in steps[1:]:
        out = out.when(x >= least, bonus)
    return out.otherwise(0)


def scored(found: DataFrame) -> DataFrame:
    """Incidents with final score and severity.  An ip that several incidents name is counted by aggregation; the names
    of those ips are joined back, so an ip with very many incidents is no hot window."""
    many = found.filter("_ip is not null").groupBy("_ip").agg(F.count("*").alias("n")).filter("n >= 2").select("_ip", F.lit(True).alias("_many"))
    df = found.join(many, "_ip", "left")
    seconds = F.greatest(F.lit(0), F.col("_end") - F.col("_begin"))
    persistent = ~F.col("category").isin(NEVER_PERSISTENT) & (seconds >= PERSISTENT_SECONDS)
    steps = [_ladder(F.coalesce(seconds if k == "seconds" else F.col("_" + k), F.lit(0)), v) for k, v in LADDERS.items()]
    impact = F.least(F.lit(MOST_IMPACT), steps[0] + steps[1] + steps[2] + steps[3] + steps[4] + steps[5])
    polite = F.col("id").startswith("ai_scraper_known:") & (F.col("_requests") < POLITE_REQUESTS) & F.coalesce("_robots", F.lit(False))
    total = (
        F.col("score") + F.when(F.col("_many"), CORRELATED).otherwise(0) + F.when(persistent, PERSISTENT).otherwise(0)
        + F.when(F.col("kind") == "saturation", impact).otherwise(0) + F.when(polite, POLITE).otherwise(0)
    )
    df = df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")).withColumn("severity", S.severity_of(F.col("score")))
    return df.drop("_many")


def _weight(column: str, weights: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(column)]


def ordered(df: DataFrame) -> DataFrame:
    """compromise before saturation before noise, then by severity, score, and id."""
    return df.orderBy(_weight("kind", KINDS).desc(), _weight("severity", SEVERITIES).desc(), F.desc("score"), "id")


def public(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)
