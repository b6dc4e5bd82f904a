"""Log lines to typed entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S, urls

# Methods that a line may have.
METHODS = ["GET", "POST", "HEAD", "PUT", "DELETE", "PATCH", "OPTIONS", "TRACE", "CONNECT", "PROPFIND"]

_REQUEST = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)]\s+"([^"]*)"\s+(\d{3})\s+(\S+)'
COMBINED = _REQUEST + r'\s+"([^"]*)"\s+"([^"]*)"\s*\z'
COMMON = _REQUEST + r"\s*\z"


_CUT = "\u0001"


@dataclass(frozen=True)
class Format:
    """A regular expression, and for each field the number of its group."""

    id: str
    label: str
    pattern: str
    fields: dict[str, int]

    def groups(self, line: Column) -> Column:
        """array of the fields' texts in the order of `fields`, null if the line does not match.  One replacement gives
        all groups; lines that hold the separator are taken group by group."""
        whole = rf"^[\s\S]*?(?:{self.pattern})[\s\S]*\z" if not self.pattern.startswith("^") else rf"{self.pattern}"
        cut = F.split(F.regexp_replace(line, whole, _CUT.join(f"${n}" for n in self.fields.values())), _CUT)
        slow = F.array(*[F.regexp_extract(line, self.pattern, n) for n in self.fields.values()])
        return F.when(line.rlike(self.pattern), F.when(F.contains(line, F.lit(_CUT)), slow).otherwise(cut))


_COMMON_FIELDS = {"ip": 1, "timestamp": 2, "request": 3, "status": 4, "bytes": 5}
BUILT_IN = [
    Format("apache_combined", "Apache combined", COMBINED, _COMMON_FIELDS | {"referer": 6, "userAgent": 7}),
    Format("nginx_combined", "Nginx combined", COMBINED, _COMMON_FIELDS | {"referer": 6, "userAgent": 7}),
    Format("apache_common", "Apache common", COMMON, _COMMON_FIELDS),
]


def entries(lines: DataFrame, fmt: Format, line: str = "value") -> DataFrame:
    """lines with ok (whether the line is an entry) and its fields; other columns stay.

    The request, the URL parts and the time are each computed once, in a column of their own."""
    # the groups come out of a generator of one row: filters on what follows stay above it, so the pattern runs once a line
    names = list(fmt.fields)
    df = lines.withColumn("_g", fmt.groups(F.col(line)))
    fields = [F.col("_g")[i].alias("_" + name) for i, name in enumerate(names)]
    df = df.select(*lines.columns, F.inline(F.array(F.struct(F.col("_g").isNotNull().alias("_ok"), *fields))))
    field = lambda name: F.col("_" + name) if name in names else F.lit(None).cast("string")
    place = names
    if "request" in place:
        words = F.split(F.regexp_replace(field("request"), rf"^{S.WS}+|{S.WS}+\z", ""), S.WS + "+")
        df = df.select(*[c for c in df.columns if c != "_request"], F.inline(F.array(F.struct(words.alias("_request")))))
    else:
        df = df.withColumn("_request", F.array().cast("array<string>"))
    parts, n = F.col("_request"), F.size("_request")
    middle = F.when(n >= 3, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).when(n == 2, parts[1]).otherwise("")
    df = df.select(
        *lines.columns,
        F.col("_ok").alias("ok"),
        field("ip").alias("ip"),
        field("timestamp").alias("timestamp"),
        F.upper(field("method") if "method" in place else F.try_element_at(parts, F.lit(1))).alias("method"),
        (field("target") if "target" in place else middle).alias("target"),
        (field("protocol") if "protocol" in place else F.try_element_at(parts, F.lit(-1))).alias("protocol"),
        S.leading_int(field("status")).cast("int").alias("status"),
        (F.coalesce(field("bytes"), F.lit("-")) if "bytes" in place else F.lit("-")).alias("_bytes_text"),
        S.nothing_if_dash(field("referer")).alias("referer"),
        S.nothing_if_dash(field("userAgent")).alias("ua"),
    )
    number = S.leading_int(F.col("_bytes_text"))
    good_bytes = (F.col("_bytes_text") == "-") | F.coalesce(number >= 0, F.lit(False))
    ok = F.col("ok") & F.col("method").isin(METHODS) & F.col("protocol").startswith("HTTP/") & F.col("status").between(100, 599) & good_bytes
    return df.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("bytes", F.when(F.col("_bytes_text") != "-", number)).drop("_bytes_text")


def enriched(parsed: DataFrame) -> DataFrame:
    """Entries with epoch, path, full (path and query) and signature."""
    return urls.with_url(parsed.withColumn("epoch", S.epoch_of(F.col("timestamp"))))


def time_filtered(df: DataFrame, since: str | int | None = None, until: str | int | None = None) -> DataFrame:
    """Entries between the two times, both included; entries without a readable time stay."""
    keep = F.lit(True)
    for bound, below in ((since, False), (until, True)):
        if bound is not None:
            at = F.lit(bound) if isinstance(bound, int) else F.unix_seconds(F.to_timestamp(F.lit(bound)))
            keep = keep & ((F.col("epoch") <= at) if below else (F.col("epoch") >= at))
    return df.filter(F.col("epoch").isNull() | keep)


def access_log(df: DataFrame) -> DataFrame:
    """The stored view of entries: secrets redacted, target clipped, 12 columns."""
    return df.select(
        "row", "source", F.col("line").alias("lineNumber"), S.redacted(F.col("value")).alias("raw"), "ip", "timestamp", "method", "path",
        S.clipped(S.redacted(F.col("full"))).alias("target"), "status", "bytes", F.col("ua").alias("userAgent"),
    )


def numbered_by_time(df: DataFrame, key: str = "epoch", tie: str = "k") -> DataFrame:
    """`row`: 0-based place in the order of (key, tie).  Counts by minute are summed up first, so rows are ranked
    minute by minute and never all in one task."""
    from pyspark.sql import Window

    minute = F.floor(F.col(key) / 60)
    df = df.withColumn("_m", minute)
    before = Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("_m").agg(F.count("*").alias("_n")).select("_m", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_m").orderBy(key, tie))
    return df.join(starts, "_m").withColumn("row", F.col("_start") + place - 1).drop("_m", "_start")
