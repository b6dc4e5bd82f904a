"""Scratch tables in the shared folder, files written by tasks, and skew helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..stored import exists, keep, release, remove, scratch, shared_folder  # noqa: F401

#: A key with this share of the rows counts as hot; so there are at most HOT_KEYS hot keys.
HOT_KEYS = 1000
HOT_LEAST = 64
#: Broadcasts of ids happen only up to this many rows (8 bytes each), else a shuffled join is used.
BROADCAST_IDS = 2_000_000

def task_fs(uri: str):
    """(filesystem, path) for a shared-folder URI inside a task: local, HDFS, S3 or GCS."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file under a name that no other attempt uses."""
    store, path = task_fs(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def hot_limit(total: int) -> int:
    """Counts from here on are hot: at most HOT_KEYS keys can reach it."""
    return max(HOT_LEAST, -(-total // HOT_KEYS))


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of many-row `left` with one-row-per-key `right`, where right[count] is the number of
    left rows of that key and `total` that of all.  Rows of hot keys meet a broadcast of at most HOT_KEYS
    rows, so that no task gets all of them; the others shuffle."""
    limit = hot_limit(total)
    hot = right.filter(F.col(count) >= limit)
    cold = right.filter(F.col(count) < limit)
    out = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return out.unionByName(rest.join(cold, key))


def by_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join with a column of distinct ids: broadcast behind a check of its size, shuffled beyond."""
    key = ids.columns[0]
    inside = fresh(df, "__ls_id")
    ids = ids.select(F.col(key).alias(inside))
    if ids.limit(limit + 1).count() <= limit:
        ids = F.broadcast(ids)
    return df.join(ids, df[id_col].eqNullSafe(ids[inside]), how)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_hash(*cols: str) -> Column:
    """With the id, what a row is known by where ids repeat: a hash of the columns that decide about it; null counts
    as empty."""
    return F.xxhash64(*[text_of(c) for c in cols])


def _with_keys(df: DataFrame, keys: DataFrame, id_col: str, row: Column, how: str, limit: int) -> DataFrame:
    a, b = fresh(df, "__ls_id"), fresh(df, "__ls_hash")
    keys = keys.select(F.col("doc_id").alias(a), F.col("h").alias(b)).distinct()
    if keys.limit(limit + 1).count() <= limit:
        keys = F.broadcast(keys)
    return df.join(keys, df[id_col].cast("long").eqNullSafe(keys[a]) & (row == keys[b]), how)


def without_rows(df: DataFrame, goes: DataFrame, id_col: str, row: Column, limit: int = BROADCAST_IDS) -> DataFrame:
    """df without the rows whose id and `row` (a row_hash of df) stand in goes (doc_id, h): broadcast behind a check of its
    size, shuffled beyond."""
    return _with_keys(df, goes, id_col, row, "left_anti", limit)


def one_of_twins(df: DataFrame, twins: DataFrame, id_col: str, row: Column, limit: int = BROADCAST_IDS) -> DataFrame:
    """df with one row for each key of twins (doc_id, h), which several rows share: the one whose JSON is least.  Only
    those rows shuffle."""
    if twins.isEmpty():
        return df
    columns = [F.col(f"`{c}`") for c in df.columns]
    same = _with_keys(df, twins, id_col, row, "left_semi", limit).select(F.struct(*columns).alias("r"), F.col(id_col).cast("long").alias("i"), row.alias("h"))
    one = same.groupBy("i", "h").agg(F.min_by("r", F.to_json("r")).alias("r")).select("r.*")
    return without_rows(df, twins, id_col, row, limit).unionByName(one)
