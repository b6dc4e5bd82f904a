"""URL filters: a temporal join of captures with dated lists, in DataFrame functions only.

A list is a table of dated entries (kind, pattern, action, at): at that time the pattern is added to the list or removed
from it.  Entries become validity intervals [from, to) by a window over each pattern.  A capture (url, fetched) is looked
up by its keys - the path prefixes of its host, the host, and the parent domains - and an as-of join gives for each key
the interval that holds at fetch time.  The most specific of them decides: a prefix before a host before a domain, longer
before shorter.

A list of up to BROADCAST_BYTES goes to all executors, so only captures that meet an interval shuffle.  A longer one meets
the captures by a shuffle of the keys that it has.  Captures of one host can be a third of all: hosts with many captures are
spread over salts, and only their intervals are repeated for each salt.

Defined results: a null or unparsable url has no key and passes; a null fetch time meets no interval; entries with a null
pattern, action or time count for nothing; of entries of one pattern at one time a removal counts after an addition;
repeated additions keep the first one's date, repeated captures give repeated rows; empty tables give no match or no
row; other columns of captures are kept aside and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shared

SALTS = 64
#: Intervals of so many bytes at most (patterns, and ROW_BYTES for the rest of a row) go to all executors.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*(/[^?#]*)?", 1)


def keys_of(url: Column, labels_most: int, segments_most: int) -> Column:
    """array of (kind, pattern, rank): prefixes are host and leading path segments, domains at least two labels.  Keys of
    more labels or segments than any entry has are left out."""
    host, nothing = host_of(url), F.array().cast("array<int>")
    labels = F.split(host, "\\.")
    n = F.size(labels)
    domains = F.transform(
        F.when((n > 2) & (F.lit(labels_most) >= 2), F.sequence(F.greatest(F.lit(1), n - labels_most), n - 2)).otherwise(nothing),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i + 1, n), ".").alias("pattern")),
    )
    leading = lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/")
    segments = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    m = F.size(segments)
    prefixes = F.transform(
        F.when((m > 0) & (F.lit(segments_most) >= 1), F.sequence(F.lit(1), F.least(m, F.lit(segments_most)))).otherwise(nothing),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", host, leading(i)).alias("pattern")),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")), F.struct(F.lit("domain").alias("kind"), host.alias("pattern")))
    return F.when(host.isNotNull(), F.concat(prefixes, own, domains))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, since, until from dated entries (kind, pattern, action, at); until is null while it lasts.  Hosts
    and domains count in lower case, and so does the host of a prefix; its path keeps its case."""
    lowered = F.concat(F.lower(F.regexp_extract("pattern", "^[^/]*", 0)), F.regexp_replace("pattern", "^[^/]*", ""))
    e = entries.filter("pattern is not null and at is not null and action in ('add', 'remove')").select("kind", lowered.alias("pattern"), "action", "at")
    # at one time: the last action of the time decides, a removal after an addition
    e = e.groupBy("kind", "pattern", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("kind", "pattern").orderBy("at")
    e = e.withColumn("before", F.lag("action").over(w)).filter("before is null or before <> action")
    e = e.withColumn("until", F.lead("at").over(w)).filter("action = 'add'")
    return e.select("kind", "pattern", F.col("at").alias("since"), "until")


def url_verdicts(
    captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per capture: page_id, fetched, blocked, kind, pattern, since (of the deciding entry)."""
    rows = captures.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(fetched_col).alias("fetched"), F.monotonically_increasing_id().alias("__ls_seq")
    )
    rows = shared.keep(rows, "captures")
    valid = shared.keep(intervals(entries), "intervals")
    parts = lambda kind, mark: F.max(F.when(F.col("kind") == kind, F.size(F.split("pattern", mark))))
    size = F.sum(F.octet_length("pattern") + ROW_BYTES)
    labels, segments, size = valid.agg(parts("domain", "\\."), parts("prefix", "/") - 1, size).first()
    keys = keys_of(F.col("url"), labels or 0, segments or 0)
    keyed = rows.filter("fetched is not null").select("__ls_seq", "fetched", F.explode(keys).alias("k")).select("__ls_seq", "fetched", "k.kind", "k.pattern")
    if (size or 0) <= broadcast_bytes:
        met = keyed.join(F.broadcast(valid), ["kind", "pattern"])
    else:
        met = _met_by_shuffle(keyed, valid, rows.count(), broadcast_bytes)
    met = met.filter("fetched >= since and (until is null or fetched < until)")
    rank = F.when(F.col("kind") == "prefix", 3).when(F.col("kind") == "host", 2).otherwise(1)
    hit = F.struct(rank.alias("rank"), F.length("pattern").alias("size"), "pattern", "kind", "since")
    best = met.groupBy("__ls_seq").agg(F.max(hit).alias("hit"))
    out = rows.join(best, "__ls_seq", "left")
    found = [F.col(f"hit.{c}").alias(c) for c in ("kind", "pattern", "since")]
    return out.select("page_id", "fetched", F.col("hit").isNotNull().alias("blocked"), *found)


def _met_by_shuffle(keyed: DataFrame, valid: DataFrame, total: int, broadcast_bytes: int) -> DataFrame:
    """keyed with the intervals of its keys, for lists that are too long to broadcast: by hash of the key, and keys of many
    captures spread over salts, with their intervals repeated for each salt."""
    key = F.xxhash64("kind", "pattern")
    listed = valid.select(key.alias("key")).distinct()
    if listed.limit(shared.BROADCAST_IDS + 1).count() <= shared.BROADCAST_IDS and 8 * shared.BROADCAST_IDS <= broadcast_bytes:
        keyed = keyed.withColumn("key", key).join(F.broadcast(listed), "key", "left_semi").drop("key")
    counted = keyed.groupBy("kind", "pattern").agg(F.count("*").alias("n"))
    hot = counted.filter(F.col("n") >= shared.hot_limit(total)).join(valid.select("kind", "pattern").distinct(), ["kind", "pattern"], "left_semi")
    # a capture has few keys of which HOT_KEYS times as many at most can be hot
    hot = shared.keep(hot.select("kind", "pattern", F.lit(True).alias("hot")), "hot-keys")
    keyed = keyed.join(F.broadcast(hot), ["kind", "pattern"], "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("__ls_seq"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = valid.join(F.broadcast(hot), ["kind", "pattern"], "left").withColumn("salt", F.explode(salts)).drop("hot")
    return keyed.withColumn("salt", salt).drop("hot").join(spread, ["kind", "pattern", "salt"])
