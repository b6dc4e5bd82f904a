"""Window helpers: runs of consecutive seconds, sums over two buckets, first match, first distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DAY = 86_400


def longest_run(seconds: DataFrame, keys: list[str], second: str = "epoch") -> DataFrame:
    """For rows of qualifying seconds, one per key and second: keys, run_seconds, run_start, run_end of the longest
    run of consecutive seconds; of equal runs the first."""
    day = F.floor(F.col(second) / DAY)
    w = Window.partitionBy(*keys, "_day").orderBy(second)
    runs = seconds.withColumn("_day", day).withColumn("_island", F.col(second) - F.row_number().over(w))
    sums = [F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end")]
    runs = runs.groupBy(*keys, "_day", "_island").agg(F.count("*").alias("run_seconds"), F.min(second).alias("run_start"), F.max(second).alias("run_end"))
    # only runs that touch midnight can go on: two a key and day at most meet in one window
    touches = (F.pmod("run_start", F.lit(DAY)) == 0) | (F.pmod("run_end", F.lit(DAY)) == DAY - 1)
    along = Window.partitionBy(*keys).orderBy("run_start")
    first = F.coalesce(F.col("run_start") != F.lag("run_end").over(along) + 1, F.lit(True)).cast("int")
    edges = runs.filter(touches).withColumn("_first", first).withColumn("_run", F.sum("_first").over(along))
    edges = edges.groupBy(*keys, "_run").agg(F.sum("run_seconds").alias("run_seconds"), *sums).drop("_run")
    runs = runs.filter(~touches).select(edges.columns).unionByName(edges)
    best = F.max_by(F.struct("run_seconds", "run_start", "run_end"), F.struct("run_seconds", -F.col("run_start"))).alias("_best")
    out = runs.groupBy(*keys).agg(best) if keys else runs.agg(best).filter("_best is not null")
    return out.select(*keys, "_best.*")


def two_bucket_max(buckets: DataFrame, key: str, bucket: str, n: str) -> DataFrame:
    """For rows (key, bucket, n): the largest sum of a bucket and the one before it, and the first bucket that ends it."""
    w = Window.partitionBy(key).orderBy(bucket).rangeBetween(-1, Window.currentRow)
    summed = buckets.withColumn("_sum", F.sum(n).over(w))
    return summed.groupBy(key).agg(F.max("_sum").alias("most"), F.max_by(bucket, F.struct("_sum", -F.col(bucket))).alias("bucket"))


def arrival_runs(entries: DataFrame, key: str, least: int) -> DataFrame:
    """For rows (key, epoch, row): the longest run of a key as rows arrive - key, run_seconds, run_start, run_end.  A second
    ends where a row of another second arrives, and counts anew if rows of it come again; a run goes on while the next
    second to arrive is the one after, and has `least` rows.  Unlike longest_run, which is about event time, this looks at all
    rows of a key in order."""
    along = Window.partitionBy(key).orderBy("row")
    fresh = F.coalesce(F.col("epoch") != F.lag("epoch").over(along), F.lit(True)).cast("int")
    parts = entries.filter("epoch is not null").select(key, "epoch", "row").withColumn("_part", fresh)
    parts = parts.withColumn("_part", F.sum("_part").over(along)).groupBy(key, "_part", "epoch").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("_part")
    goes_on = (F.col("n") >= least) & (F.lag("n").over(w) >= least) & (F.col("epoch") == F.lag("epoch").over(w) + 1)
    runs = parts.withColumn("_first", F.coalesce(~goes_on, F.lit(True)).cast("int")).withColumn("_run", F.sum("_first").over(w))
    runs = runs.filter(F.col("n") >= least).groupBy(key, "_run")
    runs = runs.agg(F.count("*").alias("run_seconds"), F.min("epoch").alias("run_start"), F.max("epoch").alias("run_end"), F.min("_part").alias("_at"))
    best = F.max_by(F.struct("run_seconds", "run_start", "run_end"), F.struct("run_seconds", -F.col("_at"))).alias("_best")
    return runs.groupBy(key).agg(best).select(key, "_best.*")


def first_distinct(df: DataFrame, keys: list[str], value: str, order: str, most: int, name: str) -> DataFrame:
    """keys and an array of the first `most` distinct values in the order of their first appearance.  Values are
    pre-aggregated, so a key's rows shuffle once a value."""
    seen = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_at"))
    seen = seen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", value))).filter(F.col("_n") <= most)
    listed = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", value))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x[value]).alias(name))
