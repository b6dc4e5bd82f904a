"""Signature rules on single requests, and their incidents per (rule, ip)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..data import signatures as D
from ..functions import scalars as S
from . import incidents as I, windows
from .aggregates import count_if, status_counts

PAYLOAD = ["sqli", "xss", "lfi_rfi", "ssrf", "command_injection"]
RECON = "recon_sensitive_file"


def _one(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


#: Literals that already hold another literal need not be tried.
_NEEDED = [x for x in D.GATE if not any(y != x and y.lower() in x.lower() for y in D.GATE)]
GATE = "(?i)" + "|".join(re.escape(x) for x in _NEEDED)


def rule_ids(target: Column, method: Column, strict_gate: bool = True) -> Column:
    """array of the ids of the rules that a request hits, in rule order.  The gate is tried on the raw target and is
    part of the meaning: without one of its literals only the method counts.  strict_gate=False tries all targets."""
    shown = S.match_text(target)
    hits = [F.when(shown.rlike(_one(patterns)), F.lit(id)) for id, *_, patterns in D.RULES]
    rare = F.when(~method.isin(D.COMMON_METHODS), F.lit(D.RARE_METHOD[0]))
    every = F.array_compact(F.array(*hits, rare))
    return F.when(target.rlike(GATE), every).otherwise(F.array_compact(F.array(rare))) if strict_gate else every


def rule_hits(entries: DataFrame, strict_gate: bool = True) -> DataFrame:
    """Entries with rule, one row per hit."""
    return entries.withColumn("rule", F.explode(rule_ids(F.col("target"), F.col("method"), strict_gate)))


def outcomes(hits: DataFrame) -> DataFrame:
    """One row per (rule, ip): count, status2xx..5xx, status404, outcome, kind, severity, score, successful, n_paths."""
    by_path = hits.groupBy("rule", "ip", "path").agg(F.count("*").alias("n"), *status_counts(), count_if(F.col("status") == 404).alias("status404"))
    names = [f"status{k}xx" for k in (2, 3, 4, 5)] + ["status404"]
    df = by_path.groupBy("rule", "ip").agg(F.sum("n").alias("count"), *[F.sum(c).alias(c) for c in names], F.least(F.count("*"), F.lit(10)).cast("int").alias("n_paths"))
    two, five, all404, all4 = F.col("status2xx"), F.col("status5xx"), F.col("status404") == F.col("count"), F.col("status4xx") == F.col("count")
    rule = F.col("rule")
    payload, recon = rule.isin(PAYLOAD), rule == RECON
    served = (two >= 2) | (two / F.col("count") >= 0.1)
    df = df.withColumn(
        "outcome",
        F.when(recon, F.when(served, "file_served").when(five > 0, "server_error").when(all404, "all_404").when(all4, "all_4xx").otherwise("mixed"))
        .when(payload, F.when(two > 0, "successful").when(five > 0, "server_error").when(all404, "all_404").when(all4, "all_4xx").otherwise("blocked"))
        .otherwise("mixed"),
    )
    o = F.col("outcome")
    score = F.when(recon, F.when(o == "file_served", 80).when(o == "server_error", 55).when(o == "all_404", 20).when(o == "all_4xx", 30).otherwise(50))
    score = score.when(payload, F.when(o == "successful", 100).when(o == "server_error", 90).when(o == "all_404", 30).when(o == "all_4xx", 50).otherwise(55)).otherwise(55)
    severity = F.when(recon, F.when(o == "file_served", "high").when(o.isin("all_404", "all_4xx"), "low").otherwise("medium"))
    severity = severity.when(payload, F.when(o.isin("successful", "server_error"), "critical").when(o == "all_404", "low").otherwise("medium")).otherwise("medium")
    kind = F.when(recon & o.isin("file_served", "server_error") | payload & o.isin("successful", "server_error"), "compromise").otherwise("noise")
    return df.select("*", kind.alias("kind"), severity.alias("severity"), score.alias("score"), o.isin("successful", "file_served").alias("successful"))


def kept_after_noise(found: DataFrame) -> DataFrame:
    """Outcomes without single probes that neither were served nor broke the server."""
    count, paths = F.col("count"), F.col("n_paths")
    drop = (F.col("rule") == D.RARE_METHOD[0]) & (count < 5) | (count < 2) & (paths <= 1) | (F.col("rule") == RECON) & (count < 3) & (paths <= 2)
    return found.filter((F.col("status2xx") > 0) | (F.col("status5xx") > 0) | ~drop)


def rule_incidents(hits: DataFrame) -> DataFrame:
    """Incidents of all (rule, ip), after noise is dropped."""
    found = kept_after_noise(outcomes(hits))
    shown = F.concat(F.when(F.col("rule") == D.RARE_METHOD[0], F.concat("method", F.lit(" "))).otherwise(""), S.clipped(S.redacted(F.col("full"))))
    slim = hits.select("rule", "ip", "row", "path", shown.alias("sample"))
    df = found.join(windows.first_distinct(slim, ["rule", "ip"], "path", "row", 10, "topPaths"), ["rule", "ip"], "left")
    df = df.join(windows.first_distinct(slim, ["rule", "ip"], "sample", "row", 5, "samples"), ["rule", "ip"], "left")
    info = {r[0]: r for r in [*D.RULES, D.RARE_METHOD]}
    pick = lambda k: F.create_map(*[F.lit(x) for id, r in info.items() for x in (id, r[k])])[F.col("rule")]
    counts = [I.number(c, F.col(c), F.col(c) > 0) for c in ("status2xx", "status3xx", "status4xx", "status5xx", "status404")]
    return I.build(
        df, F.concat_ws(":", "rule", "ip"), pick(1), F.col("kind"), F.col("severity"), F.col("score"), pick(4), pick(5),
        [I.text("ip", F.col("ip")), I.number("count", F.col("count")), I.text("outcome", F.col("outcome")), I.text("topPaths", F.array_join("topPaths", " | ")), *counts],
        F.col("samples"), F.col("successful"), ip=F.col("ip"), errors=F.col("status5xx"), subject=F.col("rule"),
    )
