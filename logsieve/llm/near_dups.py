"""N-gram Jaccard join by MinHash banding, and near-duplicate classes.

Texts become sets of hashed word 5-grams.  Texts with the same words in the same order are one class from the start, so
exact copies cost nothing more.  Each class has a MinHash signature, cut into bands; the numbers of bands and rows are
the cheapest that find a pair at the threshold with the target recall.  Band hashes shuffle; classes that share one are
candidates, and are compared on their full n-gram sets.  Candidates hang together in components:

* a component of up to BLOCK classes is compared in one cell;
* in a larger one every class is compared with the root first.  Jaccard distance is a metric: two classes within half of
  the threshold's distance of the root are linked, and are only counted.  The other pairs are compared in blocks,
  of the whole component or bucket by bucket, whichever sends fewer rows; every pair of blocks is a cell, and in buckets
  a pair counts in the cell of the first band that it shares.

So a link is a pair of at least the threshold that shares a band or that the root proves, whatever the size of its
component.  A cell holds at most about 2 * BLOCK texts and returns a row per text - its number of links, and one link of a
spanning forest - never its pairs.  Links then give the final components.  Texts of candidates shuffle once, as texts: they
are smaller than their sets.

Defined results: a null text counts as empty; a text without words has no n-grams, links with nothing and is a class
by itself; a text of 1 to 4 words has one n-gram, all its words; copies link with each other, also repeated rows and rows
that share an id; class_id is the least doc_id of the class, null if it has null ids only; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared, words
from .components import components
from .units import forget

BLOCK = 256
#: What the pairs of a cell have in common.
COMPONENT, BUCKET = 0, 1
_BASES = np.array([0x100000001B3, 0xC6A4A7935BD1E995], np.uint64)
_COLUMNS = 4096


def band_shape(threshold: float, recall: float, most_rows: int = 8) -> tuple[int, int]:
    """(bands, rows): of the shapes that find a pair at the threshold with at least the recall, the one with the least
    cost: signature length plus band hashes, plus false candidates among pairs of a quarter of the threshold, which are
    far more than similar ones."""
    best = None
    for rows in range(2, most_rows + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p))
        false = 1 - (1 - (threshold / 4) ** rows) ** bands
        cost = bands * rows + 2 * bands + 1000 * false
        if best is None or cost < best[0]:
            best = (cost, bands, rows)
    return best[1], best[2]


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = words.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return x[:n] | np.uint64(1), x[n:]


def sequence_keys(hashes: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """For each text a 24-byte key of its words in order, None without words."""
    counts = np.diff(at)
    place = np.arange(len(hashes)) - np.repeat(at[:-1], counts)
    full = np.flatnonzero(counts)
    out: list[bytes | None] = [None] * len(counts)
    if not len(full):
        return out
    keys = np.zeros((len(full), 3), np.uint64)
    for k, base in enumerate(_BASES):
        powers = np.full(int(counts.max()), base, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        keys[:, k] = words.mix(np.add.reduceat(words.mix(hashes + base) * powers[place], at[:-1][full]))
    keys[:, 2] = counts[full]
    for i, key in zip(full.tolist(), keys):
        out[i] = key.tobytes()
    return out


def band_keys(grams: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts with n-grams, bands) keys; the band's number is part of the key."""
    full = np.flatnonzero(np.diff(at))
    starts = at[:-1][full]
    a, b = _coefficients(bands * rows)
    out = np.zeros((len(full), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(full), band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = words.mix(key ^ np.minimum.reduceat(grams * a[k] + b[k], starts))
        out[:, band] = key
    return out


def _signatures(docs: DataFrame, ngram: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h, cls, bands of docs (doc_id, text, h)."""

    def sign(batches):
        forget()
        for batch in batches:
            for first, texts in words.parts(batch.column(1)):
                m = len(texts)
                hashes, at = words.word_hashes(words.lowered(texts))
                grams, gram_at = words.gram_hashes(hashes, at, ngram)
                full = np.diff(gram_at) > 0
                keys = np.zeros((m, bands), np.int64)
                if full.any():
                    keys[full] = band_keys(grams, gram_at, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                ids, h = (batch.column(c).slice(first, m) for c in (0, 2))
                cls = pa.array(sequence_keys(hashes, at), pa.binary())
                yield pa.RecordBatch.from_arrays([ids, h, cls, lists], ["doc_id", "h", "cls", "bands"])

    return docs.mapInArrow(sign, "doc_id long, h long, cls binary, bands array<long>")


def gram_sets(texts: pa.Array, ngram: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    out = []
    for _, part in words.parts(texts):
        hashes, at = words.word_hashes(words.lowered(part))
        grams, gram_at = words.gram_hashes(hashes, at, ngram)
        out += [np.unique(grams[a:b]) for a, b in zip(gram_at[:-1], gram_at[1:])]
    return out


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the intersections."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        sizes = [len(s) for s in sets]
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        several = counts > 1
        number = np.cumsum(several) - 1
        inside = several[column]
        row, column = row[inside], number[column[inside]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for first in range(0, int(several.sum()), _COLUMNS):
            a, b = np.searchsorted(column, (first, first + _COLUMNS))
            m = np.zeros((n, _COLUMNS), np.float32)
            m[row[a:b], column[a:b] - first] = 1
            out += m @ m.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """(n, n) whether two different texts have at least the Jaccard similarity."""
    both = shared_counts(sets)
    size = np.diag(both)
    out = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _forest(links: np.ndarray) -> np.ndarray:
    """For each node the least node that it hangs together with."""
    label = np.arange(len(links))
    while True:
        around = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, around)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare(cells: DataFrame, ngram: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """Rows of cells, sorted by cell and class, to (cid, links, other): links counts the members of linked classes."""

    def verify(held, kind, key, i, j):
        ids, sizes, blocks, inner, sets = zip(*held)
        links, inner = linked(list(sets), threshold), np.array(inner)
        links &= ~(inner[:, None] & inner[None, :])
        if i != j:
            block = np.array(blocks)
            links &= block[:, None] != block[None, :]
        found = np.argwhere(np.triu(links))
        if len(found):
            at = np.cumsum([0, *map(len, sets)])
            band = band_keys(np.concatenate(sets), at, bands, rows).view(np.int64)
            same = band[found[:, 0]] == band[found[:, 1]]
            good = same.any(axis=1)
            if kind == BUCKET:
                good &= band[found[:, 0], same.argmax(axis=1)] == key
            wrong = found[~good]
            links[wrong[:, 0], wrong[:, 1]] = links[wrong[:, 1], wrong[:, 0]] = False
        root, n = _forest(links), links @ np.array(sizes)
        return [(ids[x], int(n[x]), ids[root[x]]) for x in np.flatnonzero(n)]

    def run(batches):
        forget()
        at, held, out = None, [], []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["cid", "links", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_pylist() for c in ("kind", "key", "i", "j", "cid", "size", "block", "inner")]
            for *cell, cid, size, block, inner, grams in zip(*columns, gram_sets(batch.column("text"), ngram)):
                if cell != at:
                    if len(held) > 1:
                        out += verify(held, *at)
                    at, held = cell, []
                if not held or held[-1][0] != cid:  # repeated rows of the text that stands for a class count once
                    held.append((cid, size, block, inner, grams))
                if len(out) >= 4096:
                    yield batch_of(out)
                    out = []
        if len(held) > 1:
            out += verify(held, *at)
        if out:
            yield batch_of(out)

    return cells.mapInArrow(run, "cid long, links long, other long")


def _pivot_links(texts: DataFrame, ngram: int, threshold: float, total: int) -> DataFrame:
    """cid, inner of the classes of large components (texts: cid, root, m, text): whether a class is within half of the
    threshold's distance of its component's root.  Jaccard distance is a metric, so two such classes are linked."""
    pivots = texts.filter("cid = root").dropDuplicates(["root"]).select("root", "m", F.col("text").alias("pivot"))
    met = shared.join_counted(texts.drop("m"), shared.keep(pivots, "pivots"), "root", "m", total)

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, text, root, pivot = (batch.column(c) for c in ("cid", "text", "root", "pivot"))
            of, inner = {}, []
            for own, r, p in zip(gram_sets(text, ngram), root.to_pylist(), pivot):
                if r not in of:
                    of = {r: gram_sets(pa.array([p.as_py()], pa.string()), ngram)[0]}
                both = len(np.intersect1d(own, of[r], assume_unique=True))
                either = len(own) + len(of[r]) - both
                inner.append(2 * (either - both) <= (1 - threshold) * either - 1e-9)
            yield pa.RecordBatch.from_arrays([ids, pa.array(inner)], ["cid", "inner"])

    return met.select("cid", "text", "root", "pivot").mapInArrow(near, "cid long, inner boolean").distinct()


def _large_cells(wanted: DataFrame, members: DataFrame, texts: DataFrame, ngram: int, threshold: float, block: int, total: int):
    """(cells, links) for components of more than `block` classes: cells as (cid, kind, key, i, j, block, inner), links as
    (cid, links, other)."""
    large = wanted.filter(F.col("m") > block).select("cid", "size", "root", "m")
    # links that the root proves
    inner = _pivot_links(texts.join(large.drop("size"), "cid"), ngram, threshold, total)
    large = shared.keep(large.join(inner, "cid"), "large")
    proven = large.filter("inner").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("copies"))
    met = shared.join_counted(large.filter("inner").select("cid", "size", "root"), proven, "root", "n", total)
    links = met.filter("n > 1").select("cid", (F.col("copies") - F.col("size")).alias("links"), F.col("root").alias("other"))

    # the other pairs: of the whole component or of its buckets, whichever sends fewer rows
    group = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key")).alias("group")
    dealt = large.select("cid", "inner", "root", group(COMPONENT, "root"))
    dealt = dealt.unionByName(members.join(large, "cid").select("cid", "inner", "root", group(BUCKET, "key")))
    dealt = shared.keep(dealt, "group-members")
    n_in, n_out = F.col("n_in"), F.col("n") - F.col("n_in")
    sizes = dealt.groupBy("root", "group").agg(F.count("*").alias("n"), F.count_if("inner").alias("n_in"))
    sizes = sizes.withColumn("a", F.ceil(n_in / block)).withColumn("b", F.ceil(n_out / block))
    sizes = shared.keep(sizes.withColumn("cost", n_in * F.col("b") + n_out * (F.col("a") + F.col("b"))), "groups")
    costs = [F.sum(F.when(F.col("group.kind") == k, F.col("cost"))).alias(f"cost{k}") for k in (COMPONENT, BUCKET)]
    plan = sizes.groupBy("root").agg(F.count("*").alias("groups"), *costs)
    plan = plan.select("root", "groups", F.when(F.col(f"cost{COMPONENT}") <= F.col(f"cost{BUCKET}"), COMPONENT).otherwise(BUCKET).alias("kind"))
    sizes = shared.join_counted(sizes, shared.keep(plan, "large-plan"), "root", "groups", total).filter("group.kind = kind")
    sizes = shared.keep(sizes.select("group", "n", "a", "b"), "chosen-groups")
    dealt = shared.join_counted(dealt.drop("root"), sizes, "group", "n", total)
    # blocks 0 to a - 1 hold inner classes, a to a + b - 1 the others; pairs of inner classes are known
    spot = F.xxhash64("cid")
    own = F.when(F.col("inner"), F.pmod(spot, F.greatest("a", F.lit(1)))).otherwise(F.col("a") + F.pmod(spot, F.greatest("b", F.lit(1))))
    first, last = F.when(F.col("inner"), F.col("a")).otherwise(F.lit(0)).cast("long"), F.col("a") + F.col("b") - 1
    dealt = dealt.filter(first <= last).withColumn("block", own).withColumn("other", F.explode(F.sequence(first, last)))
    pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "inner"]
    return dealt.select("cid", F.col("group.kind").alias("kind"), F.col("group.key").alias("key"), *pair), links


def _classified(docs: DataFrame, id_col: str, text_col: str, ngram: int, threshold: float, recall: float, block: int):
    """(rows, classes): rows (doc_id, h, cls) of docs, and of each distinct text with words cls, size, root, class_id,
    stays (the key of the row of its class that stays), links."""
    bands, rows = band_shape(threshold, recall)
    text = shared.text_of(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), shared.row_hash(text_col).alias("h"))
    signed = shared.keep(_signatures(docs, ngram, bands, rows), "signatures")
    total = signed.count()
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = signed.filter("cls is not null").groupBy("cls").agg(F.min(first).alias("stays"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    classes = shared.keep(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # candidates: classes that share a band
    banded = classes.select("cid", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("leader")).filter("m > 1")
    buckets = shared.keep(buckets, "buckets")
    members = shared.keep(shared.join_counted(banded, buckets, "key", "m", total * bands), "members")
    roots = components(members.select(F.col("cid").alias("a"), F.col("leader").alias("b")), "candidates")
    roots = roots.unionByName(roots.select("root", F.col("root").alias("node")).distinct())
    sizes = shared.keep(roots.groupBy("root").agg(F.count("*").alias("m")), "component-sizes")
    roots = shared.join_counted(roots, sizes, "root", "m", total).withColumnRenamed("node", "cid")

    # texts of the candidates only; with them each cell makes the full n-gram sets
    wanted = shared.keep(classes.select("cid", "stays", "size").join(roots, "cid"), "wanted")
    keys = wanted.select("cid", "size", "root", "m", F.col("stays.doc_id").alias("i"), F.col("stays.h").alias("g"))
    if wanted.count() <= shared.BROADCAST_IDS:
        keys = F.broadcast(keys)
    texts = docs.join(keys, docs["doc_id"].eqNullSafe(keys["i"]) & (docs["h"] == keys["g"])).select("cid", "size", "root", "m", "text")
    cell = ["kind", "key", "i", "j"]
    one = F.lit(0).cast("long")
    alone = [F.lit(COMPONENT).alias("kind"), F.col("root").alias("key"), one.alias("i"), one.alias("j"), one.alias("block"), F.lit(False).alias("inner")]
    full = texts.filter(F.col("m") <= block).select("cid", "size", *alone, "text")
    large, proven = wanted.filter(F.col("m") > block), None
    if not large.isEmpty():
        chosen = shared.keep(texts.filter(F.col("m") > block).select("cid", "text"), "large-texts")
        cells, proven = _large_cells(wanted, members, chosen, ngram, threshold, block, total)
        full = full.unionByName(cells.join(large.select("cid", "size"), "cid").join(chosen, "cid").select(full.columns))
    full = full.repartition(*cell).sortWithinPartitions(*cell, "cid")
    found = _compare(full, ngram, threshold, bands, rows)
    found = shared.keep(found.unionByName(proven) if proven is not None else found, "links")

    # links a class has, and final components
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    final = components(found.select(F.col("cid").alias("a"), F.col("other").alias("b")), "classes")
    classes = classes.select("cid", "cls", "stays", "size").join(final.withColumnRenamed("node", "cid"), "cid", "left")
    classes = shared.keep(classes.join(links, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "class-roots")
    named = classes.groupBy("root").agg(F.min("stays").alias("first"), F.count("*").alias("n"))
    classes = shared.join_counted(classes.drop("stays"), named, "root", "n", total)
    links = F.coalesce("links", F.lit(0)) + F.col("size") - 1
    return signed, shared.keep(classes.select("cls", "size", F.col("first").alias("stays"), links.alias("n_links")), "class-names"), total


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = BLOCK
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links (other rows with at least the similarity)."""
    signed, classes, total = _classified(docs, id_col, text_col, ngram, threshold, recall, block)
    none = signed.filter("cls is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    met = shared.join_counted(signed.filter("cls is not null").select("doc_id", "cls"), classes, "cls", "size", total)
    return met.select("doc_id", F.col("stays.doc_id").alias("class_id"), "n_links").unionByName(none)


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = BLOCK
) -> DataFrame:
    """docs with one row of each near-duplicate class: that of the least id (null ids come last), of those that share it
    the one with the least text hash, and of rows that share id and text the one whose columns as JSON are least.  Rows
    without words are no copies of anything and stay."""
    signed, classes, total = _classified(docs, id_col, text_col, ngram, threshold, recall, block)
    met = shared.join_counted(signed.filter("cls is not null").select("doc_id", "h", "cls"), classes.select("cls", "size", "stays"), "cls", "size", total)
    own = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("h") == F.col("stays.h"))
    marks = shared.keep(met.filter((F.col("size") > 1) | ~own).select("doc_id", "h", own.alias("own")), "near-marks")
    row = shared.row_hash(text_col)
    left = shared.without_rows(docs, marks.filter("not own"), id_col, row)
    twins = marks.filter("own").groupBy("doc_id", "h").count().filter("count > 1")
    return shared.one_of_twins(left, shared.keep(twins, "near-twins"), id_col, row)
