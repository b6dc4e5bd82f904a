"""Analysis of log files in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .operators import aggregates as A, behavior as B
from .plans.analysis import Analysis
from .ship import to_workers
from .sinks import reports
from .sources import discover, formats, logs
from .thresholds import DEFAULT, Thresholds


@dataclass
class Result:
    """An analysis with its inputs; `report()` collects it into one document."""

    analysis: Analysis
    summary: DataFrame
    inputs: list[str]
    formats: list[logs.InputFormat]
    top: int = 20

    def report(self, with_matches: bool = True) -> dict:
        return reports.build(self.analysis, self.summary, self.inputs, self.formats, self.top, with_matches)


def analyze(
    spark: SparkSession, paths: list[str], format: str = "auto", format_config: str | None = None, since: str | None = None, until: str | None = None, top: int = 20,
    include: str | None = None, exclude: str | None = None, thresholds: Thresholds = DEFAULT, ranges: B.Ranges | None = None, strict_gate: bool = True,
) -> Result:
    to_workers(spark)
    files = discover.discover(paths, include, exclude, spark)
    if not files:
        raise ValueError("no input files")
    custom = formats.load(format_config) if format_config else []
    parsed, kept, found = logs.read_log(spark, files, format, custom, since, until)
    analysis = Analysis(kept, thresholds, ranges or B.Ranges(), strict_gate)
    return Result(analysis, A.summary(_with_epoch(parsed), len({f.file for f in found}), since, until), files, found, top)


def _with_epoch(parsed: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    from .functions import scalars as S

    return parsed.withColumn("epoch", S.epoch_of(F.col("timestamp")))
