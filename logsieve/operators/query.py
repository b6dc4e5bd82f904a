"""Sorting, paging and lookup over the stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .filterlang import compile_filter

SORT_KEYS = ("timestamp", "ip", "status", "method", "path", "bytes")
MOST_SELECTED = 5000


def order_columns(key: str = "timestamp", descending: bool = False) -> list[Column]:
    """Time means arrival order; numbers sort as numbers (missing bytes as 0); texts by the root collation.  Equal rows
    stand in arrival order, also in descending sorts."""
    if key not in SORT_KEYS:
        raise ValueError(f"sort key: {key}")
    if key == "timestamp":
        return [F.col("row").desc() if descending else F.col("row").asc()]
    x = F.coalesce("bytes", F.lit(0)) if key == "bytes" else F.col(key) if key == "status" else F.collate(F.col(key), "UNICODE")
    return [x.desc() if descending else x.asc(), F.col("row").asc()]


def query_rows(log: DataFrame, query: str = "", key: str = "timestamp", descending: bool = False) -> DataFrame:
    return log.filter(compile_filter(query)).orderBy(*order_columns(key, descending))


def page(log: DataFrame, start: int, size: int, query: str = "", key: str = "timestamp", descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of the page in order, one row with the total)."""
    chosen = log.filter(compile_filter(query))
    rows = chosen.orderBy(*order_columns(key, descending)).offset(max(start, 0)).limit(max(size, 0))
    return rows, chosen.agg(F.count("*").alias("total"))


def _wanted(log: DataFrame, numbers) -> DataFrame:
    """place, row of the numbers, as they were given."""
    if isinstance(numbers, DataFrame):
        return numbers
    return log.sparkSession.createDataFrame(list(enumerate(numbers)), "place long, row long")


def rows_at(log: DataFrame, numbers) -> DataFrame:
    """Rows by number, of any number of numbers (a list, or a frame with place and row); numbers without a row are
    passed over."""
    return log.join(_wanted(log, numbers).select("row").distinct(), "row", "left_semi").select(log.columns)


def selection(numbers: list[int]) -> list[int]:
    """A selection of rows by hand, each once; more than MOST_SELECTED is an error."""
    chosen = list(dict.fromkeys(numbers))
    if len(chosen) > MOST_SELECTED:
        raise ValueError(f"{len(chosen)} rows selected, {MOST_SELECTED} at most")
    return chosen


def chunks_at(log: DataFrame, numbers, size: int = 2000, stop=None):
    """Lists of at most `size` rows in the order of the numbers, repeated ones again.  A number without a row is an error
    before the first chunk; stop() is asked between chunks, and ends the reading with InterruptedError."""
    wanted = _wanted(log, numbers)
    missing = wanted.join(log.select("row"), "row", "left_anti").limit(1).collect()
    if missing:
        raise IndexError(f"no row {missing[0].row}")
    rows, chunk = wanted.join(log, "row").orderBy("place").select(log.columns).toLocalIterator(prefetchPartitions=True), []
    for r in rows:
        chunk.append(r)
        if len(chunk) == size:
            yield chunk
            chunk = []
            if stop and stop():
                raise InterruptedError("reading of rows stopped")
    if chunk:
        yield chunk


def incident_log(log: DataFrame, bridge: DataFrame, incident_id: str, query: str = "", key: str = "timestamp", descending: bool = False, rows=None) -> DataFrame:
    """Rows of an incident, filtered and sorted; rows: of these numbers only (a selection)."""
    chosen = bridge.filter(F.col("id") == incident_id).select("row")
    if rows is not None:
        chosen = chosen.join(_wanted(log, selection(rows)).select("row"), "row", "left_semi")
    return query_rows(log.join(chosen, "row", "left_semi").select(log.columns), query, key, descending)
