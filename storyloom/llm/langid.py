"""Language by nearest centroid over TF-IDF vectors of letter n-grams.

Runs of 1 to 4 bytes of the lowered letters (all else is one space) are hashed into
``WIDTH`` places.  Document frequencies come from all training rows.  Each language has up to
``CENTROIDS`` unit centroids, made by spherical k-means from about ``SAMPLE`` of its different
texts, drawn by a hash of the text, and never from more than twice as many: copies of a text are
drawn once, so a text with a third of all rows is one row of the sample.  A text goes to the language of the centroid of greatest
cosine.  What cosine to expect grows with a text's distinct n-grams n as sqrt(n / (n + ``HALF``));
a text is rejected if its cosine, over that, is below ``MARGIN`` times the ``QUANTILE`` of the
language's different sample rows, each half of them held against the centroids of the other half.
A language of one such row takes the least limit of the others.

Defined results: a null text or one without letters is ``und`` with score 0 and rejected; ties
go to the first language by name; very long texts are read whole; rows without a lang are not
learned from; without any training rows every text is ``und`` and rejected; repeated rows have
equal results; an empty table gives no rows; extra columns are ignored by ``languages`` and kept
by ``accepted``, which decides each row by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import broadcast_if_small
from . import words
from .cluster import bounded_batches, rows_kept, staged

WIDTH, CENTROIDS, SAMPLE = 4096, 3, 400
QUANTILE, MARGIN, HALF = 0.01, 0.9, 800
#: Texts whose dense vectors are held at once.
ROWS = 256

_FOLD = words.LOWER.copy()
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[97:123] = _PLAIN[128:] = True


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, one row per text."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, WIDTH))
    low = _FOLD[data]
    # Upper case letters of Latin-1 Supplement, as UTF-8, to lower case.
    second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[second] += 0x20
    low = np.where(_PLAIN[low], low, 32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    keep = (low != 32) | np.concatenate([[True], low[:-1] != 32])
    low, doc = low[keep].astype(np.uint32), doc[keep]
    out = np.zeros(n * WIDTH)
    code = np.zeros(len(low), np.uint32)
    for k in range(4):
        code = code[: len(low) - k] if k else code
        code = code * np.uint32(0x01000193) + low[k:] + np.uint32(1)
        same = doc[: len(low) - k] == doc[k:]
        mixed = code * np.uint32(0x9E3779B1)
        slot = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(20)
        out += np.bincount(doc[k:][same] * WIDTH + slot[same], minlength=n * WIDTH)
    return out.reshape(n, WIDTH)


def unit(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def expected(x: np.ndarray) -> np.ndarray:
    """What the cosine of a clean text goes with, per row of counts."""
    n = (x > 0).sum(axis=1)
    return np.sqrt(n / (n + HALF))


def _vectors(batch: pa.RecordBatch, column: str = "text"):
    for at in range(0, len(batch), ROWS):
        for rows, data, offsets in words.slices(batch.slice(at, ROWS), column):
            yield rows, counts(data, offsets)


def _frequencies(batches):
    total, n = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for rows, x in _vectors(batch):
            total += (x > 0).sum(axis=0)
            n += len(rows)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array(np.append(total, n))], names=["slot", "n"])


def _sampled(batches):
    met: set[tuple] = set()
    for batch in batches:
        fresh = []
        for own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fresh.append(own not in met)
            met.add(own)
        for rows, x in _vectors(batch.filter(pa.array(fresh, pa.bool_()))):
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, WIDTH, dtype=np.int32), pa.array(x.reshape(-1).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), flat], names=["lang", "hash", "x"])


def cluster(x: np.ndarray, k: int, turns: int = 10) -> np.ndarray:
    """Spherical k-means with farthest-first starts; at most ``k`` unit centroids."""
    centre = [x.mean(axis=0)]
    centre[0] /= max(np.linalg.norm(centre[0]), 1e-12)
    while len(centre) < min(k, len(x)):
        centre.append(x[int((x @ np.array(centre).T).max(axis=1).argmin())])
    centre = np.array(centre)
    for _ in range(turns):
        own = (x @ centre.T).argmax(axis=1)
        for c in range(len(centre)):
            if (own == c).any():
                m = x[own == c].mean(axis=0)
                centre[c] = m / max(np.linalg.norm(m), 1e-12)
    return centre


def least(x: np.ndarray, idf: np.ndarray) -> float | None:
    """The limit of a language from its sample's counts."""
    x = np.unique(x, axis=0)
    if len(x) < 2:
        return None
    # In an order of their own, so neighbours in value are not of one half.
    x = x[np.argsort([zlib.crc32(row.tobytes()) for row in x], kind="stable")]
    near, size = unit(x.astype(np.float64), idf), expected(x)
    halves = [(near[k::2] @ cluster(near[1 - k :: 2], CENTROIDS).T).max(axis=1) / size[k::2] for k in (0, 1)]
    return MARGIN * float(np.quantile(np.concatenate(halves), QUANTILE))


class Centroids:
    def __init__(self, idf: np.ndarray, of: dict[str, np.ndarray], limits: dict[str, float]):
        self.idf, self.names = idf, sorted(of)
        self.centre = np.concatenate([of[k] for k in self.names]).T if of else np.zeros((WIDTH, 0))
        self.owner = np.repeat(np.arange(len(self.names)), [len(of[k]) for k in self.names]) if of else np.zeros(0, int)
        self.limit = np.array([limits[k] for k in self.names])

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) per row of counts."""
        if not self.names:
            return ["und"] * len(x), np.zeros(len(x)), np.ones(len(x), bool)
        near = unit(x, self.idf) @ self.centre
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(len(x)), best], 0, 1)
        lang = self.owner[best]
        return [self.names[k] for k in lang], cosine, cosine < self.limit[lang] * expected(x)


def held(modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit(docs: DataFrame) -> Centroids:
    """From all rows of (doc_id, text, lang) that are not held out and have both text and lang."""
    bounded_batches(docs.sparkSession)
    train = docs.filter(~held() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    table = train.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # WIDTH + 1 rows
    df = np.zeros(WIDTH + 1)
    for r in table:
        df[r["slot"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    keyed = train.select("lang", F.xxhash64("text").alias("hash"), "text")
    sizes = keyed.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod("hash", F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = keyed.join(broadcast_if_small(sizes, 100_000), "lang").filter(draw * F.col("n") < SAMPLE)
    # Of equal texts the first that a task meets, then one of all tasks: vectors alone are shuffled.
    drawn = staged(some.select("lang", "hash", "text").mapInArrow(_sampled, "lang string, hash long, x array<float>").dropDuplicates(["lang", "hash"]), "langid-sample")
    of, limits = {}, {}
    for lang in sorted(r["lang"] for r in sizes.collect()):
        x = np.array([r["x"] for r in drawn.filter(F.col("lang") == lang).orderBy("hash").limit(2 * SAMPLE).select("x").collect()], dtype=np.float32).reshape(-1, WIDTH)
        x = x[x.sum(axis=1) > 0]
        if len(x):
            of[lang] = cluster(unit(x.astype(np.float64), idf), CENTROIDS)
            limits[lang] = least(x, idf)
    lowest = min((v for v in limits.values() if v is not None), default=0.0)
    return Centroids(idf, of, {k: lowest if v is None else v for k, v in limits.items()})


def _decided(model: Centroids, batch: pa.RecordBatch, column: str = "text"):
    """(rows, language, score, rejected) for runs of the batch's rows."""
    for rows, x in _vectors(batch, column):
        lang, score, rejected = model.predict(x)
        # Only letters count: a cheap test settles most texts, str.isalpha the others.
        texts = rows.column(rows.schema.get_field_index(column)).to_pylist()
        bare = np.array([t is None or not (x[k].sum() > 1 and any(map(str.isalpha, t[:64]))) and not any(map(str.isalpha, t)) for k, t in enumerate(texts)], bool)
        yield rows, ["und" if b else name for name, b in zip(lang, bare, strict=True)], np.where(bare, 0.0, score), rejected | bare


def _predicted(model: Centroids):
    def of(batches):
        for batch in batches:
            for rows, lang, score, rejected in _decided(model, batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return of


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is near enough to a language; each is decided where it is read."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))

    def keep(batch, text):
        for some, _, _, rejected in _decided(model, batch, text):
            yield some.filter(pa.array(~rejected))

    return rows_kept(docs, "text", keep)


def languages(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held().alias("held_out"), "lang_pred", "score", "rejected")
