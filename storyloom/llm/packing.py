"""Packing documents into fixed sequences by cutting-stock column generation.

A document's ids are cut at multiples of the sequence length; each whole piece is a
sequence by itself and the rest is an item.  Item lengths are rounded up to classes of
``UNIT`` ids, and their histogram (at most capacity / UNIT rows, whatever the corpus) is all
that the driver sees.  A linear program over patterns (how many items of each class share
a sequence) is solved by column generation: a knapsack dynamic program prices new
patterns until no pattern improves the bound.  Patterns are rounded down; the items left
over, fewer than one sequence a pattern, are packed best fit decreasing.

Each class hands its ranks to pattern copies in order, so a document finds its sequence
from its rank alone; ranks are made in sub-partitions and no class meets in one task.

Defined results: a null or empty text is its end id alone; a text of any length is cut into as
many pieces as it needs; pieces of equal length and document take places in any order; an empty
table gives no rows; repeated rows are packed as rows of their own; extra columns are ignored.
Pivots that gain nothing for a long run end the linear program: its plan then still holds every
item, at the best bound so far.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import words
from .cluster import bounded_batches, ranked, staged
from .tokens import encoder
from .trees import Rooms

#: Width of a length class in ids.
UNIT = 8
#: The linear program ends within this share of its lower bound.
GAP = 1e-4

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, drops_space: bool, end_id: int, size: int):
    def of(batches):
        codec = encoder(path, drops_space)
        for batch in batches:
            for rows, ids, bounds in codec.batches(batch, "text"):
                flat = np.insert(ids, bounds[1:], end_id).astype("<u4")
                ends = bounds[1:] + np.arange(1, len(bounds))
                begins = np.concatenate([[0], ends[:-1]])
                count = -(-(ends - begins) // size)
                doc = np.repeat(np.arange(len(count)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size
                length = np.minimum(size, (ends - begins)[doc] - start)
                first = begins[doc] + start
                crc = [zlib.crc32(flat[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array((ends - begins)[doc])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )
        words.release()

    return of


def price(gains: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best sum of ``gains`` (of widths 1, 2, ...) within ``capacity``, and its counts."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        tries = best[c - 1 :: -1][: len(gains)] + gains[: min(c, len(gains))]
        k = int(tries.argmax())
        best[c], last[c] = (tries[k], k + 1) if tries[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(len(gains), dtype=np.int64), capacity
    while c > 0:
        counts[last[c] - 1] += bool(last[c])
        c -= max(int(last[c]), 1)
    return float(best[capacity]), counts


def patterns(demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(copies, counts per class) that hold ``demand`` items of widths 1 to ``capacity`` exactly."""
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    need = demand[used].astype(float)
    columns = np.diag(capacity // (used + 1)).astype(float)
    inverse, amount = np.diag(1.0 / np.diag(columns)), need / np.diag(columns)
    gains = np.zeros(capacity)
    stalled, least = 0, amount.sum()
    while True:
        dual = inverse.sum(axis=0)
        gains[used] = dual
        value, full = price(gains, capacity)
        # Duals over the best pattern's value are feasible: a lower bound of all plans.
        if value <= 1 + GAP or float(dual @ need) / value >= amount.sum() * (1 - GAP):
            break
        counts = full[used].astype(float)
        step = inverse @ counts
        able = np.flatnonzero(step > 1e-9)
        ratio = amount[able] / step[able]
        # Of equal ratios the first row leaves; pivots that gain nothing for so long could go round in a circle.
        leave = able[np.flatnonzero(ratio <= ratio.min() + 1e-12)[0]]
        share = amount[leave] / step[leave]
        stalled = 0 if amount.sum() < least - 1e-9 else stalled + 1
        least = min(least, amount.sum())
        if stalled > 2 * len(used):
            break
        amount = np.maximum(amount - share * step, 0)
        amount[leave] = share
        pivot = inverse[leave] / step[leave]
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
        columns[:, leave] = counts
    left, plan = demand[used].astype(np.int64), []
    for k in np.argsort(-amount, kind="stable"):
        counts = columns[:, k].astype(np.int64)
        has = counts > 0
        copies = min(int(amount[k] + 1e-6), int((left[has] // counts[has]).min()))
        if copies:
            left -= copies * counts
            plan.append((copies, counts))
    plan += _best_fit(left, used + 1, capacity)
    out = []
    for copies, counts in plan:
        full = np.zeros(capacity, dtype=np.int64)
        full[used] = counts
        out.append((copies, full))
    return out


def _best_fit(left: np.ndarray, widths: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Best fit decreasing of what rounding left: fewer sequences than there are classes."""
    bins: list[np.ndarray] = []
    room = Rooms()
    for k in range(len(left) - 1, -1, -1):
        for _ in range(int(left[k])):
            space, b = room.tightest(int(widths[k])) or (capacity, len(bins))
            if b == len(bins):
                bins.append(np.zeros(len(left), dtype=np.int64))
            bins[b][k] += 1
            room.add((space - int(widths[k]), b))
    return [(1, b) for b in bins]


def slots(plan: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
    """Rank ranges of each class: rank lo + k of class ``cls`` goes to sequence ``seq`` + k, as its ``place``-th item."""
    taken: dict[int, int] = {}
    rows, seq = [], 0
    for copies, counts in plan:
        place = 0
        for c in np.flatnonzero(counts)[::-1]:
            for _ in range(int(counts[c])):
                lo = taken.get(int(c), 0)
                rows.append((int(c) + 1, lo, seq, place))
                taken[int(c)] = lo + copies
                place += 1
        seq += copies
    return pd.DataFrame(rows, columns=["cls", "lo", "seq", "place"]).sort_values(["cls", "lo"])


def _placed(table: pd.DataFrame):
    ranges = {int(c): tuple(g[k].to_numpy() for k in ("lo", "seq", "place")) for c, g in table.groupby("cls")}

    def of(batches):
        for batch in batches:
            cls, rank = batch.column(batch.schema.get_field_index("cls")).to_numpy(), batch.column(batch.schema.get_field_index("rank")).to_numpy()
            seq, place = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int32)
            for c in np.unique(cls):
                own = np.flatnonzero(cls == c)
                lo, first, at = ranges[int(c)]
                k = np.searchsorted(lo, rank[own], side="right") - 1
                seq[own], place[own] = first[k] + rank[own] - lo[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(seq), pa.array(place)], names=[*batch.schema.names[:5], "sequence_id", "place"])

    return of


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, drops_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(rows.mapInArrow(_pieces(tokenizer, drops_space, end_id, size), _PIECES), "packing-pieces")
    classed = pieces.withColumn("cls", F.ceil(F.col("length") / UNIT).cast("int"))
    sizes = classed.groupBy("cls").agg(F.count("*").alias("cnt"))
    found = sizes.collect()  # at most size / UNIT rows
    capacity = -(-size // UNIT)
    demand = np.zeros(capacity, dtype=np.int64)
    for r in found:
        demand[r["cls"] - 1] = r["cnt"]
    counts = spark.createDataFrame([(r["cls"], r["cnt"]) for r in found], "cls int, cnt long")
    order = [-F.col("length"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    rank = ranked(classed, "cls", counts, int(demand.sum()), order)
    rank = rank.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank")
    placed = rank.mapInArrow(_placed(slots(patterns(demand, capacity))), f"{_PIECES}, sequence_id long, place int")
    inner = Window.partitionBy("sequence_id").orderBy("place")
    return placed.withColumn("offset", F.sum("length").over(inner) - F.col("length")).drop("place")
