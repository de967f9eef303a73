"""Document quality by regularised quadratic discriminant analysis.

Statistics of the whole text (shares of character kinds, word lengths, repetition) are
transformed to be near normal.  Each class has a mean and a covariance, shrunk towards its
diagonal and the pooled one; the score is the posterior of label 1 from the difference of
Mahalanobis log densities, by Cholesky factors made once and handed to the tasks.

Fitting uses all labelled rows that are not held out, as sums per class, so the driver sees
``FEATURES`` squared numbers.  Labels, language, source and id are never inputs.

Defined results: null and empty texts have the statistics of no words and are scored like any
other; very long texts are read whole; unlabelled rows and null labels are not learned from, nor
are labels of a null id; of several labels of one id the least counts; if one class has no rows
every score is 1 or 0 for the other, and 0.5 if neither has; repeated and tied rows are scored
alike; an empty table gives no rows; extra columns are ignored by ``scores`` and kept by
``accepted``, which decides each row by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import broadcast_if_small
from . import words
from .cluster import bounded_batches, rows_kept, staged

#: Weights of the diagonal and of the pooled covariance, and the least variance.
DIAGONAL, POOLED, FLOOR = 0.1, 0.05, 1e-3

_SPACED = words.byte_class((0x20, 0x20), (0x09, 0x0D))
_KINDS = np.zeros((8, 256), dtype=np.uint8)
_KINDS[0, 65:91] = 1
_KINDS[1, 97:123] = 1
_KINDS[2, 48:58] = 1
_KINDS[3, 128:] = 1
_KINDS[4, [10]] = 1
_KINDS[5, [46, 44, 59, 58, 39, 45, 63]] = 1
_KINDS[6, [*range(33, 39), 40, 41, 42, 43, 47, *range(60, 63), 64, *range(91, 97), 123, 125, 126]] = 1
_KINDS[7, [124]] = 1

FEATURES = 12


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` transformed statistics per text."""
    low, starts, stops, first = words.find(data, offsets, _SPACED)
    size = np.diff(offsets).astype(float)
    kind = np.empty((8, len(size)))
    for k in range(8):
        total = np.concatenate([[0], np.cumsum(_KINDS[k][data], dtype=np.int64)])
        kind[k] = total[offsets[1:]] - total[offsets[:-1]]
    count = np.diff(first).astype(float)
    hashed = words.hashes(low, starts, stops)
    pairs, at = words.shingles(hashed, first, 3)
    distinct, fresh = np.zeros(len(size)), np.zeros(len(size))
    for d in np.flatnonzero(count):
        distinct[d] = len(np.unique(hashed[first[d] : first[d + 1]]))
        fresh[d] = len(np.unique(pairs[at[d] : at[d + 1]]))
    runs = np.diff(at).astype(float)
    long = np.concatenate([[0], np.cumsum(stops - starts > 20)])
    last = np.concatenate([[0], np.cumsum(_KINDS[6][data[stops - 1]] if len(stops) else np.zeros(0), dtype=np.int64)])
    some, word = np.maximum(size, 1), np.maximum(count, 1)
    letters = kind[0] + kind[1] + kind[3]
    root = np.sqrt
    return np.stack(
        [
            np.log1p(count),
            np.log1p(size / word),
            root(kind[0] / np.maximum(letters, 1)),
            root(kind[2] / some),
            root(kind[6] / some),
            root(kind[7] / word),
            root(kind[5] / word),
            root(letters / some),
            np.log1p(kind[4] / word * 20),
            root(1 - distinct / word),
            root(1 - fresh / np.maximum(runs, 1)),
            root((last[first[1:]] - last[first[:-1]]) / word) + root((long[first[1:]] - long[first[:-1]]) / word),
        ],
        axis=1,
    )


def _features(extra: int):
    def of(batches):
        for batch in batches:
            for rows, data, offsets in words.slices(batch, "text"):
                f = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in range(extra)), pa.ListArray.from_arrays(np.arange(0, f.size + 1, FEATURES, dtype=np.int32), pa.array(f.reshape(-1)))], names=[*rows.schema.names[:extra], "f"]
                )

    return of


def _sums(batches):
    for batch in batches:
        label = batch.column(0).to_numpy()
        f = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES)
        for c in (0, 1):
            own = np.column_stack([np.ones(int((label == c).sum())), f[label == c]])
            yield pa.RecordBatch.from_pylist([{"label": c, "s": (own.T @ own).reshape(-1).tolist()}], schema=pa.schema([("label", pa.int32()), ("s", pa.list_(pa.float64()))]))


def _solved(factor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows x of factor x = row, by forward substitution for all rows at once."""
    out = np.empty_like(rows)
    for k in range(len(factor)):
        out[:, k] = (rows[:, k] - out[:, :k] @ factor[k, :k]) / factor[k, k]
    return out


class Discriminant:
    """Means, Cholesky factors and log terms of both classes."""

    def __init__(self, sums: dict[int, np.ndarray]):
        self.n = {c: float(s[0, 0]) for c, s in sums.items() if s[0, 0] > 0}
        self.mean = {c: sums[c][0, 1:] / n for c, n in self.n.items()}
        cov = {c: sums[c][1:, 1:] / n - np.outer(self.mean[c], self.mean[c]) for c, n in self.n.items()}
        total = sum(self.n.values())
        self.factor, self.constant = {}, {}
        for c, own in cov.items():
            pooled = sum(self.n[k] / total * cov[k] for k in cov)
            shrunk = (1 - DIAGONAL - POOLED) * own + DIAGONAL * np.diag(np.diag(own)) + POOLED * pooled
            factor = np.linalg.cholesky(shrunk + FLOOR * np.eye(len(own)))
            self.factor[c] = factor
            self.constant[c] = np.log(self.n[c] / total) - np.log(np.diag(factor)).sum()

    def score(self, f: np.ndarray) -> np.ndarray:
        if len(self.n) < 2:
            return np.full(len(f), 0.5 if not self.n else float(1 in self.n))
        density = {c: self.constant[c] - 0.5 * (_solved(self.factor[c], f - self.mean[c]) ** 2).sum(axis=1) for c in (0, 1)}
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(features: DataFrame, labels: DataFrame, held_out: Column) -> Discriminant:
    """From rows (doc_id, f) and (doc_id, quality), without those held out."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    rows = features.filter(~held_out).join(known, "doc_id").select("label", "f")
    sums = rows.mapInArrow(_sums, "label int, s array<double>").select("label", F.posexplode("s"))
    table = sums.groupBy("label", "pos").agg(F.sum("col").alias("s")).collect()  # 2 * (FEATURES + 1)^2 rows
    out = {c: np.zeros((FEATURES + 1) ** 2) for c in (0, 1)}
    for r in table:
        out[r["label"]][r["pos"]] = r["s"]
    return Discriminant({c: s.reshape(FEATURES + 1, -1) for c, s in out.items()})


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``.

    Only labelled rows are looked at to fit; every row is then decided by its own text where it is
    read, so no text moves and repeated or null ids decide nothing.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    ids = broadcast_if_small(known.select("doc_id").distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    learned = rows.filter(~held()).join(ids, "doc_id", "left_semi").mapInArrow(_features(1), "doc_id long, f array<double>")
    model = fit(learned, known, held())

    def keep(batch, text):
        for some, data, offsets in words.slices(batch, text):
            yield some.filter(pa.array(model.score(statistics(data, offsets)) >= threshold))

    return rows_kept(docs, text_col, keep)


def _scored(model: Discriminant):
    def of(batches):
        for batch in batches:
            f = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(f))], names=[*batch.schema.names[:-1], "score"])

    return of


def held(id_col: str = "doc_id", modulus: int = 5, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = staged(rows.mapInArrow(_features(1), "doc_id long, f array<double>"), "quality-features")
    model = fit(features, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), held())
    scored = features.select("doc_id", held().alias("held_out"), "f").mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
