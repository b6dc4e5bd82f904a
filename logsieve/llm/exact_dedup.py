"""Exact dedup by two-pass Bloom filtering.

Pass 1 sets, for every text hash, k bits of a filter, and finds the bits that at least two rows set.  Pass 2
probes all rows against those twice-set bits: a row with one bit that only it has set is alone and passes
straight through, without a shuffle.  Only the other rows - all repeated ones and few false positives - shuffle
as (hash, id), never with their text.

The filter has `bits_per_row` bits a row and at most `max_bits` (64 MB), so what is broadcast is bounded.
More rows than such a filter is for are dealt to groups by their hash, and each group has a filter of its own.

Defined results: a null text counts as empty; texts are equal when identical; of equal texts the row with the
largest id stays (null ids are smallest; of rows that share id and text one stays); an empty table gives an empty
result; other columns are not read.  Different texts are told apart by SHA-256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

CHUNK = 1 << 16
_ROWS_AT_ONCE = 1 << 20


def _positions(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """(rows, k) bit numbers from the first 16 bytes of each hash."""
    a, b = hashes[:, 0], hashes[:, 1] | np.uint64(1)
    steps = np.arange(k, dtype=np.uint64)
    return (a[:, None] + steps * b[:, None]) & np.uint64(bits - 1)


def _hash_words(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(len(column), 4)


def repeated_bits(digests: DataFrame, bits: int, k: int) -> np.ndarray:
    """Bytes of the filter of bits that at least two rows set."""

    def emit(batches):
        def flush(rows):
            pos = np.sort(_positions(np.concatenate(rows), bits, k).ravel())
            # each bit at most twice from here: two is all that matters
            again = np.zeros(len(pos), bool)
            again[2:] = pos[2:] == pos[:-2]
            pos = pos[~again]
            chunk = (pos >> np.uint64(16)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else []
            ends = np.r_[starts[1:], len(chunk)] if len(chunk) else []
            low = (pos & np.uint64(CHUNK - 1)).astype("<u2")
            return pa.RecordBatch.from_arrays(
                [pa.array(chunk[starts] if len(chunk) else [], pa.int32()), pa.array([low[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())],
                ["chunk", "bits"],
            )

        rows, n = [], 0
        for batch in batches:
            if batch.num_rows:
                rows.append(_hash_words(batch.column(0)))
                n += batch.num_rows
            if n >= _ROWS_AT_ONCE:
                yield flush(rows)
                rows, n = [], 0
        if rows:
            yield flush(rows)

    def combine(key, pdf):
        import pandas as pd

        count = np.zeros(CHUNK, np.int64)
        for b in pdf["bits"]:
            count += np.bincount(np.frombuffer(b, "<u2"), minlength=CHUNK)
        return pd.DataFrame({"chunk": [key[0]], "twice": [np.packbits(count >= 2, bitorder="little").tobytes()]})

    found = digests.select("sha").mapInArrow(emit, "chunk int, bits binary")
    found = found.groupBy("chunk").applyInPandas(combine, "chunk int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in found.toLocalIterator():  # at most max_bits / 8 bytes in all
        out[row.chunk * (CHUNK // 8) :][: CHUNK // 8] = np.frombuffer(row.twice, np.uint8)
    return out


def flag_repeats(digests: DataFrame, bits: int, k: int, held: list | None = None) -> DataFrame:
    """Adds `maybe`: whether another row may have the same hash.  The filter's broadcast is appended to `held`."""
    filt = digests.sparkSession.sparkContext.broadcast(repeated_bits(digests, bits, k))

    if held is not None:
        held.append(filt)

    def probe(batches):
        table = filt.value
        for batch in batches:
            if batch.num_rows:
                pos = _positions(_hash_words(batch.column("sha")), bits, k)
                hit = (table[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=1))], [*batch.schema.names, "maybe"])

    kinds = ", ".join(f"{n} {t}" for n, t in digests.dtypes)
    return digests.mapInArrow(probe, f"{kinds}, maybe boolean")


def _flagged(digests: DataFrame, bits: int, k: int, groups: int) -> DataFrame:
    """digests with `maybe`.  More rows than one filter holds are dealt to groups by their hash; equal hashes are in one
    group, and each group has a filter of its own, one after the other."""
    if groups <= 1:
        return shared.keep(flag_repeats(digests, bits, k), "flagged")
    spark = digests.sparkSession
    dealt, out = shared.scratch(spark, "digest-groups"), shared.scratch(spark, "flagged-groups")
    # the last bytes of a hash choose the group, the first ones the bits
    group = F.pmod(F.conv(F.hex(F.substring("sha", 25, 7)), 16, 10).cast("long"), F.lit(groups))
    digests.withColumn("__ls_group", group).write.partitionBy("__ls_group").parquet(dealt)
    read = spark.read.schema(digests.schema)
    for n in range(groups):
        path = f"{dealt}/__ls_group={n}"
        if shared.exists(spark, path):
            held: list = []
            flag_repeats(read.parquet(path), bits, k, held).write.mode("append").parquet(out)
            held[0].destroy()
    return spark.read.schema(digests.schema.add("maybe", "boolean")).parquet(out)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, hashes: int = 3, max_bits: int = 1 << 29,
    with_column: str | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and with_column, if given."""
    more = [with_column] if with_column else []
    digests = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(shared.text_of(text_col).cast("binary"), 256)).alias("sha"),
        F.monotonically_increasing_id().alias("seq"), *more,
    )
    digests = shared.keep(digests, "digests")
    total = digests.count()
    bits = CHUNK
    while bits < bits_per_row * total and bits < max_bits:
        bits *= 2
    flagged = _flagged(digests, bits, hashes, -(-bits_per_row * total // bits))
    alone = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", *more
    )
    maybe = flagged.filter("maybe").select("doc_id", "seq", "sha", *more)
    groups = maybe.groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "seq")).alias("stays"))
    groups = shared.keep(groups, "groups")
    joined = shared.join_counted(maybe, groups, "sha", "group_size", total).select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("seq") == F.col("stays.seq")).alias("kept"), "sha", *more
    )
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    return alone.unionByName(joined).select("doc_id", "keep_id", "group_size", "kept", sha, *more)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each text: that with the largest id, with all its columns.  A row is known by id and text; of
    rows that share both the one whose columns as JSON are least stays."""
    row = shared.row_hash(text_col)
    marks = shared.keep(exact_dedup(docs.withColumn(h := shared.fresh(docs, "__ls_h"), row), id_col, text_col, with_column=h, **options), "marks")
    marks = marks.groupBy("doc_id", F.col(h).alias("h")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    marks = shared.keep(marks.filter("n > 1 or not kept"), "repeated-rows")
    left = shared.without_rows(docs, marks.filter("not kept"), id_col, row)
    return shared.one_of_twins(left, marks.filter("kept"), id_col, row)
