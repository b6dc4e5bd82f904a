"""The incident row: what every detector returns, and how evidence is put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

#: Facts that scoring reads, beside the evidence shown; null where a detector has none.
FACTS = {"ip": "string", "begin": "bigint", "end": "bigint", "requests": "bigint", "served": "bigint", "peak": "bigint", "errors": "bigint", "ips": "bigint", "robots": "boolean", "subject": "string"}
COLUMNS = ["id", "category", "kind", "severity", "score", "title", "description", "evidence", "samples", "successful"]
_EVIDENCE = "struct<key:string,text:string,number:double,flag:boolean>"


def text(key: str, x: Column | str) -> Column:
    x = F.lit(x) if isinstance(x, str) else x
    return F.when(x.isNotNull(), F.struct(F.lit(key).alias("key"), x.cast("string").alias("text"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("boolean").alias("flag")))


def number(key: str, x: Column | float, when: Column | None = None) -> Column:
    x = x if isinstance(x, Column) else F.lit(x)
    good = x.isNotNull() if when is None else when & x.isNotNull()
    return F.when(good, F.struct(F.lit(key).alias("key"), F.lit(None).cast("string").alias("text"), x.cast("double").alias("number"), F.lit(None).cast("boolean").alias("flag")))


def flag(key: str, x: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("number"), x.alias("flag"))


def time(key: str, epoch: Column) -> Column:
    return text(key, S.iso_of(epoch))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def build(
    df: DataFrame, id: Column, category, kind, severity, score, title, description, evidence: list[Column], samples: Column | None = None, successful: Column | None = None, **facts: Column
) -> DataFrame:
    """Incidents from rows of df; evidence keeps its order, nulls in it are left out."""
    shown = F.filter(F.array(*evidence), lambda e: e.isNotNull()).cast(f"array<{_EVIDENCE}>")
    return df.select(
        id.alias("id"), _col(category).alias("category"), _col(kind).alias("kind"), _col(severity).alias("severity"), _col(score).cast("int").alias("score"), _col(title).alias("title"),
        _col(description).alias("description"), shown.alias("evidence"), (F.array().cast("array<string>") if samples is None else F.coalesce(samples, F.array().cast("array<string>"))).alias("samples"),
        (F.lit(False) if successful is None else successful).alias("successful"),
        *[facts.get(k, F.lit(None)).cast(t).alias("_" + k) for k, t in FACTS.items()],
    )
