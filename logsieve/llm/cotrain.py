"""Quality classifier by co-training.

Two linear classifiers see two views of a document: its text, and its page metadata.  Both start from the labelled
documents.  In each round each classifier scores all other documents, and those that it is sure of (calibrated probability at
least `sure`, or at most 1 - sure) become pseudo-labels of the other.  The classifiers are fitted from sums and products
of features, which add up, so all sure documents take part, wherever they are and however many; their sums weigh `share` of
the labelled documents', class by class.  Labelled documents set aside calibrate both views after each round, and weigh
their log-odds into one score.

Fitting takes at most `train_rows` labelled documents (those with the least hashes of their ids), whose features go to the
driver; no other rows do.  Features are made once, of whole texts, and stored as 16-bit floats for the rounds.

Defined results: a null text counts as empty and is scored like any other; null metadata have features of their own;
without labels of both kinds every score is null and all documents are kept; labels of unknown documents and null
labels are passed over; of several labels of a document the largest counts; of rows that share a labelled id one is
fitted; repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import shared, words

TRAIN_ROWS = 3000
ROUNDS = 3
#: Probability from which on a view is sure, and weight of what it is sure of.
SURE, SHARE = 0.95, 0.5
PENALTY = 3.0
_WORDS, _META = 192, 48
_SHAPES = 16
TEXT_FEATURES = _SHAPES + _WORDS
META_FEATURES = 19 + 4 * _META
FEATURES = TEXT_FEATURES + META_FEATURES

_KIND = np.full(256, 5, np.int8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 above ASCII, 5 mark
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 10, 13, 32]], _KIND[128:] = 0, 1, 2, 3, 4
_COMMON = np.zeros(256, bool)
_COMMON[[ord(c) for c in ".,;:!?'\"-()"]] = True


def text_features(texts: pa.Array) -> np.ndarray:
    """(n, TEXT_FEATURES) shares of kinds of characters, of repeated words and lines, and hashed words."""
    data, offs = words.as_bytes(texts)
    n, size = len(offs) - 1, np.diff(offs)
    out = np.zeros((n, TEXT_FEATURES), np.float32)
    if not n:
        return out
    size1 = np.maximum(size, 1)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * 6 + _KIND[data], minlength=n * 6).reshape(n, 6)
    out[:, :6] = kinds / size1[:, None]
    odd = (_KIND[data] == 5) & ~_COMMON[data]
    out[:, 6] = np.bincount(doc[odd], minlength=n) / size1
    out[:, 7] = np.bincount(doc[data == 124], minlength=n) / size1
    out[:, 8] = np.bincount(doc[data == 10], minlength=n) / size1
    hashes, at = words.word_hashes(words.lowered(texts))
    count = np.diff(at)
    count1 = np.maximum(count, 1)
    word_doc = np.repeat(np.arange(n), count)
    key = word_doc.astype(np.int64) << 40 | (hashes >> np.uint64(24)).astype(np.int64)
    values, times = np.unique(key, return_counts=True)
    of = values >> 40
    out[:, 9] = np.bincount(of, minlength=n) / count1
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    out[:, 10] = most / count1
    same = (hashes[1:] == hashes[:-1]) & (word_doc[1:] == word_doc[:-1])
    out[:, 11] = np.bincount(word_doc[1:][same], minlength=n) / count1
    out[:, 12] = count / size1 * 5
    out[:, 13] = np.log1p(count) / 10
    out[:, 14] = count == 0
    # words often repeated: share of words that stand more than three times beyond their share
    heavy = times > 3
    out[:, 15] = np.bincount(of[heavy], weights=times[heavy], minlength=n) / count1
    bag = np.bincount(word_doc * _WORDS + (hashes % np.uint64(_WORDS)).astype(np.int64), minlength=n * _WORDS).reshape(n, _WORDS)
    out[:, _SHAPES:] = np.sqrt(bag / count1[:, None])
    return out


def meta_features(meta: dict[str, pa.Array]) -> np.ndarray:
    """(n, META_FEATURES) of lang, source, n_chars, url and html: declared length, hashed language, source, host and suffix of
    the address, shape of the address, and kinds of markup.  What is null or not there has a feature of its own."""
    n = len(meta["lang"])
    out = np.zeros((n, META_FEATURES), np.float32)
    size = pc.fill_null(meta["n_chars"].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    log = np.log1p(np.maximum(np.nan_to_num(size), 0)) / 12
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = np.isnan(size), log, log**2, np.nan_to_num(size) < 200
    url, html = pc.fill_null(meta["url"], ""), pc.fill_null(meta["html"], "")
    bare = pc.replace_substring_regex(url, "[?#].*$", "")
    host = pc.utf8_lower(pc.replace_substring_regex(bare, "^[A-Za-z0-9+.-]*://([^/]*).*$", "\\1"))
    suffix = pc.replace_substring_regex(host, "^.*[.]", "")
    long = np.maximum(pc.binary_length(url).to_numpy(zero_copy_only=False), 1)
    out[:, 4] = np.log1p(long) / 8
    out[:, 5] = pc.count_substring(bare, "/").to_numpy(zero_copy_only=False) / 8
    out[:, 6] = pc.count_substring_regex(url, "[0-9]").to_numpy(zero_copy_only=False) / long
    out[:, 7] = pc.match_substring(url, "?").to_numpy(zero_copy_only=False)
    marks = np.maximum(pc.binary_length(html).to_numpy(zero_copy_only=False), 1)
    out[:, 8] = np.log1p(marks) / 16
    for k, tag in enumerate(("<a ", "<script", "<p", "<li", "<div", "<img")):
        out[:, 9 + k] = 50 * pc.count_substring(html, tag, ignore_case=True).to_numpy(zero_copy_only=False) / marks
    for k, column in enumerate((meta["lang"], meta["source"], host, suffix)):
        given = pc.fill_null(column, "")
        out[:, 15 + k] = pc.equal(given, "").to_numpy(zero_copy_only=False)
        data, offs = words.as_bytes(given)
        h = words.span_hashes(data, offs[:-1], offs[1:]) if len(data) else np.zeros(n, np.uint64)
        out[np.arange(n), 19 + k * _META + (h % np.uint64(_META)).astype(np.int64)] = 1
    return out


class Logistic:
    """Logistic regression with an L2 penalty, by Newton steps."""

    def __init__(self, penalty: float = 1.0, steps: int = 12):
        self.penalty, self.steps = penalty, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        x = x.astype(np.float64)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w = np.ones(len(x)) if weight is None else weight
        b = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.penalty)
        ridge[-1] = 1e-6
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            g = z.T @ (w * (p - y)) + ridge * b
            h = (z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(h, g)
            b -= step
            if np.abs(step).max() < 1e-6:
                break
        self.b = b
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.b[:-1] + self.b[-1]


class Moments:
    """Weighted sums over rows x of a view, for each of two classes: number, sum and product matrix.  They add up, so rows
    of any number can be summed where they are."""

    def __init__(self, width: int):
        self.n, self.s, self.m = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))

    def add(self, x: np.ndarray, y: np.ndarray) -> Moments:
        for c in (0, 1):
            own = x[y == c].astype(np.float64)
            self.n[c] += len(own)
            self.s[c] += own.sum(axis=0)
            self.m[c] += own.T @ own
        return self


class LeastSquares:
    """Linear classifier with an L2 penalty, from the moments of labelled rows and those of pseudo-labelled rows.  The
    latter count as `share` of the labelled ones, class by class, however many they are."""

    def __init__(self, known: Moments, guessed: Moments | None, share: float, penalty: float):
        n, s, m = known.n.copy(), known.s.copy(), known.m.copy()
        for c in (0, 1):
            if guessed is not None and guessed.n[c]:
                w = share * known.n[c] / guessed.n[c]
                n[c], s[c], m[c] = n[c] + w * guessed.n[c], s[c] + w * guessed.s[c], m[c] + w * guessed.m[c]
        total = n.sum()
        self.mean = s.sum(axis=0) / total
        cov = m.sum(axis=0) / total - np.outer(self.mean, self.mean)
        self.scale = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-3
        cov = cov / np.outer(self.scale, self.scale) + penalty / known.n.sum() * np.eye(len(cov))
        gap = (s[1] / max(n[1], 1e-9) - s[0] / max(n[0], 1e-9)) / self.scale
        self.b = np.linalg.solve(cov, gap)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.b


class Model:
    """Both views, their calibration on the labelled rows set aside, and the combination of their log-odds."""

    def __init__(self, views: list, held: list[np.ndarray], y: np.ndarray):
        self.views = views
        self.calibrated = [Logistic(0.1).fit(v.margin(x)[:, None], y) for v, x in zip(views, held)]
        self.both = Logistic(1.0).fit(self.odds(held), y)

    def odds(self, x: list[np.ndarray]) -> np.ndarray:
        return np.stack([c.margin(v.margin(own)[:, None]) for v, c, own in zip(self.views, self.calibrated, x)], axis=1)

    def scores(self, x: list[np.ndarray]):
        """(text probability, metadata probability, combined probability)."""
        odds = self.odds(x)
        return _sigmoid(odds[:, 0]), _sigmoid(odds[:, 1]), _sigmoid(self.both.margin(odds))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _split(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:]]


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return _split(np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(len(column), FEATURES).astype(np.float32))


def features(rows: DataFrame) -> DataFrame:
    """doc_id and x, the features of both views as 16-bit floats."""
    names = ("lang", "source", "n_chars", "url", "html")

    def make(batches):
        for batch in batches:
            for first, texts in words.parts(batch.column(1)):
                m = len(texts)
                meta = {c: batch.column(batch.schema.get_field_index(c)).slice(first, m) for c in names}
                x = np.hstack([text_features(texts), meta_features(meta)]).astype("<f2")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, m), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return rows.select("doc_id", "text", *names).mapInArrow(make, "doc_id long, x binary")


def exchanged(pool: DataFrame, model: Model, sure: float) -> list[Moments]:
    """For each view the moments of all rows of pool (doc_id, x) that the other view is sure of, as it labels them.  Tasks
    send matrix rows, which are added up by a grouped aggregation: the driver gets one matrix a view and class."""
    sent = pool.sparkSession.sparkContext.broadcast(model)
    widths = (TEXT_FEATURES, FEATURES - TEXT_FEATURES)

    def collect(batches):
        model, sums = sent.value, [Moments(w) for w in widths]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unpacked(batch.column("x"))
            for k, p in enumerate(model.scores(x)[:2]):
                rows = np.flatnonzero((p >= sure) | (p <= 1 - sure))
                sums[1 - k].add(x[1 - k][rows], p[rows] > 0.5)
        for view, own in enumerate(sums):
            for c in (0, 1):
                if own.n[c]:
                    whole = np.vstack([np.hstack([own.n[c : c + 1], own.s[c]]), np.hstack([np.zeros((len(own.s[c]), 1)), own.m[c]])])
                    columns = [[view] * len(whole), [c] * len(whole), range(len(whole))]
                    lines = pa.array([line.tobytes() for line in whole], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in columns), lines], ["view", "c", "line", "sums"])

    def add(key, pdf):
        import pandas as pd

        total = sum(np.frombuffer(x, np.float64) for x in pdf["sums"])
        return pd.DataFrame({"view": [key[0]], "c": [key[1]], "line": [key[2]], "sums": [total.tobytes()]})

    kinds = "view int, c int, line int, sums binary"
    found = pool.mapInArrow(collect, kinds).groupBy("view", "c", "line").applyInPandas(add, kinds)
    out = [Moments(w) for w in widths]
    for r in found.toLocalIterator():  # 2 views, 2 classes, a line for each feature
        line = np.frombuffer(r.sums, np.float64)
        if r.line == 0:
            out[r.view].n[r.c], out[r.view].s[r.c] = line[0], line[1:]
        else:
            out[r.view].m[r.c][r.line - 1] = line[1:]
    return out


def fit(every: DataFrame, labels: DataFrame, train_rows: int, rounds: int, sure: float, share: float) -> Model | None:
    """The model from every (doc_id, x), or None without labels of both kinds."""
    ids = every.select("doc_id").distinct()
    known = labels.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    known = shared.keep(known, "labelled-sample")  # at most train_rows rows
    chosen = every.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x"))
    got = sorted(chosen.toLocalIterator(), key=lambda r: r.doc_id)
    y = np.array([r.y for r in got])
    if len(set(y.tolist())) < 2:
        return None
    x = _unpacked(pa.array([bytes(r.x) for r in got], pa.binary()))
    # a quarter of each kind is set aside, if there are enough
    place = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    held = place % 4 == 0
    if len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    aside = held if held.any() else np.ones(len(y), bool)
    start = [Moments(v.shape[1]).add(v[~held], y[~held]) for v in x]
    aside_x = [v[aside] for v in x]
    model = Model([LeastSquares(m, None, share, PENALTY) for m in start], aside_x, y[aside])
    pool = every.join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")
    for _ in range(rounds):
        guessed = exchanged(pool, model, sure)
        model = Model([LeastSquares(m, g, share, PENALTY) for m, g in zip(start, guessed)], aside_x, y[aside])
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5,
    train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, sure: float = SURE, share: float = SHARE,
) -> DataFrame:
    """One row per row of docs: doc_id, text_score, meta_score, score, kept (score at least `least`).  Columns lang, source,
    n_chars, url and html of docs are metadata, those that it has."""
    have = {c.lower() for c in docs.columns}
    pick = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    meta = [pick(c, "string") for c in ("lang", "source", "url", "html")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), pick("n_chars", "double"), *meta)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    marks = marks.groupBy("doc_id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    every = shared.keep(features(rows), "features")
    model = fit(every, marks, train_rows, rounds, sure, share)
    if model is None:
        return every.select("doc_id", *[F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")], F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few FEATURES numbers

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                *views, both = sent.value.scores(_unpacked(batch.column("x")))
                found = [pa.array(np.round(x.astype(np.float64), 6)) for x in (*views, both)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found, pa.array(both >= least)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return every.mapInArrow(score, "doc_id long, text_score double, meta_score double, score double, kept boolean")
