"""Language ID by Bayesian fusion of evidence.

For every document: the likelihood of its whole text under each language (byte trigrams of the lower-cased text), the
declared markup language, the suffix of its address, and a prior for its host.  The host's prior is smoothed towards
the other hosts of its registered domain, and that towards the corpus; priors and the likelihoods of declared values and
suffixes are counts over all documents, made by grouped aggregation of what the text alone says.

Every label has a trigram table.  It is fitted on about `train_rows` documents of the label (those with the least hashes of
id and text), or on all if it has no more; texts do not leave the executors for it.  A text's likelihood counts as that of at most
`effective` trigrams, as neighbouring trigrams are not independent.

A document is rejected (kept = false) if its text has no letter or if no language gets `least` of the
probability.

Defined results: a null text counts as empty and is rejected, with language null; null or unknown declared values, hosts
and addresses give no evidence; without any label all documents are rejected; repeated rows count as often as they
stand; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import shared, words
from .units import forget

TRAIN_ROWS = 4000
#: Languages whose tables, of 1 MB each, go out in one broadcast; more of them take more broadcasts.
TABLES_AT_ONCE = 64
EFFECTIVE = 40.0
_SMOOTH = 0.5
_CELLS = 1 << 18

# bytes to 6 bits: letters, lead and continuation bytes by their low bits, everything else 0
_CLASS = np.zeros(256, np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128) % 37)


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram cells of all texts, between two spaces, and n + 1 offsets; cells without a letter are left out."""
    data, offs = words.as_bytes(pc.binary_join_element_wise(" ", words.lowered(texts), " ", ""))
    c = _CLASS[data]
    n = np.maximum(np.diff(offs) - 2, 0)
    text = np.repeat(np.arange(len(n)), n)
    begin = offs[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    cells = c[begin] << 12 | c[begin + 1] << 6 | c[begin + 2]
    some = cells != 0
    counts = np.bincount(text[some], minlength=len(n))
    return cells[some], np.concatenate([[0], np.cumsum(counts)])


def train(docs: DataFrame, train_rows: int) -> tuple[list[str], list]:
    """Languages and the broadcasts of their log-likelihood tables, from docs (doc_id, text, label)."""
    spark = docs.sparkSession
    most = 1 << 31
    hashed = docs.filter("label is not null").withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(most)))
    # the least hash is always taken, so that no label is without a document
    labels = shared.keep(hashed.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least")), "labels")
    sample = hashed.join(F.broadcast(labels), "label").filter((F.col("h") * F.col("n") < F.lit(float(train_rows) * most)) | (F.col("h") == F.col("least")))

    def count(batches):
        sums: dict = {}
        for batch in batches:
            for first, texts in words.parts(batch.column(0)):
                cells, at = _trigrams(texts)
                for k, label in enumerate(batch.column(1).slice(first, len(texts)).to_pylist()):
                    if label is not None:
                        s = sums.setdefault(label, [np.zeros(_CELLS, np.int32), 0])
                        np.add.at(s[0], cells[at[k] : at[k + 1]], 1)
                        s[1] += 1
        for label, (s, n) in sums.items():
            where = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"label": [label], "n": pa.array([n], pa.int64()), "cells": [where.astype("<i4").tobytes()], "counts": [s[where].astype("<i4").tobytes()]})

    counted: dict = {}
    for r in sample.select("text", "label").mapInArrow(count, "label string, n long, cells binary, counts binary").toLocalIterator():
        counted.setdefault(r.label, []).append((r.cells, r.counts))
        if len(counted[r.label]) > 16:
            counted[r.label] = [_packed(_summed(counted[r.label]))]
    names = sorted(counted)
    # smoothed with the cells of all languages together, so that a cell one of them lacks is not decisive
    common = np.full(_CELLS, _SMOOTH * len(names))
    for x in names:
        common += _summed(counted[x])
    sent = []
    for a in range(0, len(names), TABLES_AT_ONCE):
        tables = np.stack([_summed(counted.pop(x)) for x in names[a : a + TABLES_AT_ONCE]]) + _SMOOTH
        tables = tables / tables.sum(axis=1, keepdims=True) * 0.98 + 0.02 * common / common.sum()
        sent.append(spark.sparkContext.broadcast(np.log(tables).astype(np.float32)))
    return names, sent


def _summed(parts: list) -> np.ndarray:
    out = np.zeros(_CELLS)
    for cells, counts in parts:
        out[np.frombuffer(cells, "<i4")] += np.frombuffer(counts, "<i4")
    return out


def _packed(sums: np.ndarray) -> tuple[bytes, bytes]:
    where = np.flatnonzero(sums)
    return where.astype("<i4").tobytes(), sums[where].astype("<i4").tobytes()


def text_scores(docs: DataFrame, models: list) -> DataFrame:
    """docs (doc_id, text, ...) to doc_id, ..., n_trigrams, and ll: log-likelihood per trigram of each language."""
    others = [c for c in docs.columns if c != "text"]

    def score(batches):
        forget()
        table = [row for m in models for row in m.value]  # 1 MB a language
        for batch in batches:
            text_at = batch.schema.get_field_index("text")
            for first, texts in words.parts(batch.column(text_at)):
                cells, at = _trigrams(texts)
                n = np.diff(at)
                out = np.zeros((len(n), len(table)), np.float32)
                full = np.flatnonzero(n)
                if len(full):
                    for k, row in enumerate(table):
                        out[full, k] = np.add.reduceat(row[cells], at[:-1][full], dtype=np.float64) / n[full]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(table), pa.int32()), pa.array(out.ravel()))
                kept = [batch.column(batch.schema.get_field_index(c)).slice(first, len(texts)) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), lists], [*others, "n_trigrams", "ll"])

    kinds = ", ".join(f"{n} {t}" for n, t in docs.select(*others).dtypes)
    return docs.mapInArrow(score, f"{kinds}, n_trigrams long, ll array<float>")


def _counts(n: int) -> Column:
    return F.array(*[F.sum(F.when(F.col("top") == k, 1).otherwise(0)).cast("double") for k in range(n)])


def host_priors(scored: DataFrame, n: int, strength: float = 5.0) -> DataFrame:
    """host, rows, prior: the host's counts, smoothed towards those of the other hosts of its registered domain, and these
    towards the corpus.  A host without a domain above it has none but the corpus."""
    hosts = scored.filter("host is not null").groupBy("host").agg(F.count("*").alias("rows"), _counts(n).alias("own"))
    labels = F.split("host", "\\.")
    hosts = hosts.withColumn("domain", F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host")))
    hosts = shared.keep(hosts, "host-counts")
    root = corpus_prior(scored, n)
    sums = F.array(*[F.sum(F.col("own")[k]) for k in range(n)])
    domains = shared.keep(hosts.groupBy("domain").agg(F.count("*").alias("n_hosts"), sums.alias("every")), "domain-counts")
    joined = shared.join_counted(hosts, domains, "domain", "n_hosts", hosts.count())
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    others = F.zip_with("every", "own", lambda x, y: x - y)
    roots = F.array(*[F.lit(float(x)) for x in root])
    above = F.zip_with("others", roots, lambda x, r: (x + strength * r) / (total("others") + strength))
    joined = joined.withColumn("others", others).withColumn("above", above)
    prior = F.zip_with("own", "above", lambda x, u: (x + strength * u) / (total("own") + strength))
    return joined.select("host", "rows", prior.alias("prior"))


def corpus_prior(scored: DataFrame, n: int) -> np.ndarray:
    every = np.array(scored.filter("top is not null").select(_counts(n).alias("c")).first().c)
    return (every + 1) / (every.sum() + n)


def emissions(scored: DataFrame, column: str, n: int) -> DataFrame:
    """value, rows, emission: log of how likely a document of each language is to have it."""
    counted = scored.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    counted = shared.keep(counted.agg(F.count("*").alias("rows"), _counts(n).alias("own")), "values")
    *sums, values = counted.agg(*[F.sum(F.col("own")[k]) for k in range(n)], F.count("*")).first()
    each = [F.log((F.col("own")[k] + 0.1) / (float(sums[k] or 0) + 0.1 * max(1, values))) for k in range(n)]
    return counted.select("value", "rows", F.array(*each).alias("emission"))


def _fuse(rows: DataFrame, names: list[str], least: float, effective: float, carry: list[str]) -> DataFrame:
    def fuse(batches):
        for batch in batches:
            m, k = batch.num_rows, len(names)
            if not m:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            n = column("n_trigrams").to_numpy(zero_copy_only=False)
            total = np.array(column("ll").to_pylist(), np.float64).reshape(m, k) * np.minimum(n, effective)[:, None]
            for c in ("prior", "declared", "suffix"):
                total += np.array([x if x is not None else [0.0] * k for x in column(c).to_pylist()], np.float64).reshape(m, k)
            total -= total.max(axis=1, keepdims=True)
            p = np.exp(total)
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            sure = p[np.arange(m), best]
            has = n > 0
            language = pa.array([names[b] if h else None for b, h in zip(best, has)], pa.string())
            found = [language, pa.array(np.round(np.where(has, sure, 0.0), 6)), pa.array(n, pa.int64()), pa.array(has & (sure >= least))]
            yield pa.RecordBatch.from_arrays(
                [column("doc_id"), *found, *(column(c) for c in carry)], ["doc_id", "language", "probability", "n_trigrams", "kept", *carry]
            )

    kinds = "".join(f", `{n}` {t}" for n, t in rows.select(*carry).dtypes)
    return rows.mapInArrow(fuse, "doc_id long, language string, probability double, n_trigrams long, kept boolean" + kinds)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", declared: Column | None = None, host: Column | None = None,
    suffix: Column | None = None, train_rows: int = TRAIN_ROWS, least: float = 0.5, effective: float = EFFECTIVE, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: doc_id, language, probability, n_trigrams, kept, and the columns in `carry` as they are.
    declared, host and suffix are expressions over docs; where they are not given there is no such evidence."""
    none = F.lit(None).cast("string")
    carried = [f"__ls_carry{k}" for k in range(len(carry))]
    evidence = {"declared": declared, "host": host, "suffix": suffix}
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(label_col).cast("string").alias("label"),
        *[(none if x is None else F.lower(x.cast("string"))).alias(c) for c, x in evidence.items()],
        *[F.col(f"`{c}`").alias(x) for c, x in zip(carry, carried)],
    )
    named = lambda out: out.withColumnsRenamed(dict(zip(carried, carry)))
    names, models = train(rows.select("doc_id", "text", "label"), train_rows)
    n = len(names)
    if not n:
        nothing = [none.alias("language"), F.lit(0.0).alias("probability"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("kept")]
        return named(rows.select("doc_id", *nothing, *carried))
    scored = text_scores(rows.drop("label"), models)
    scored = scored.withColumn("top", F.when(F.col("n_trigrams") > 0, F.array_position("ll", F.array_max("ll")) - 1))
    scored = shared.keep(scored, "language-scores")
    total = scored.count()
    out = scored
    for c in ("declared", "suffix"):
        without = out.withColumn(f"{c}_e", F.lit(None).cast("array<double>"))
        if evidence[c] is None:
            out = without
            continue
        table = shared.keep(emissions(scored, c, n).withColumnRenamed("value", c), f"{c}-emissions")
        met = shared.join_counted(out.filter(F.col(c).isNotNull()), table, c, "rows", total).withColumnRenamed("emission", f"{c}_e")
        out = met.select(without.columns).unionByName(without.filter(F.col(c).isNull()))
    picked = ["doc_id", "n_trigrams", "ll", F.col("declared_e").alias("declared"), F.col("suffix_e").alias("suffix"), *carried]
    root = F.array(*[F.lit(float(np.log(x))) for x in corpus_prior(scored, n)])
    fused = out.filter("host is null").select(*picked, root.alias("prior"))
    if host is not None:
        priors = shared.keep(host_priors(scored, n), "host-priors")
        met = shared.join_counted(out.filter("host is not null"), priors, "host", "rows", total)
        fused = fused.unionByName(met.select(*picked, F.transform("prior", lambda x: F.log(x)).alias("prior")))
    return named(_fuse(fused, names, least, effective, carried))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that are rejected, with all columns.  A row is known by its id and all that decides about it:
    text, declared language, host and suffix."""
    evidence = [F.lower(options[c].cast("string")) for c in ("declared", "host", "suffix") if options.get(c) is not None]
    row = F.xxhash64(shared.text_of(text_col), *[F.coalesce(e, F.lit("")) for e in evidence])
    marked = identify(docs.withColumn(h := shared.fresh(docs, "__ls_h"), row), id_col, text_col, carry=(h,), **options)
    goes = shared.keep(marked.filter(~F.col("kept")).select("doc_id", F.col(h).alias("h")).distinct(), "rejected")
    return shared.without_rows(docs, goes, id_col, row)
