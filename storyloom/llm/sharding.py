"""Sharding by best-fit-decreasing bin packing over a histogram of group sizes.

Documents of equal text form an indivisible group; a group's size is the UTF-8 bytes of its
members plus ``OVERHEAD`` each.  Group sizes are counted in classes: exact up to
``EXACT`` bytes, above that rounded up by less than one part in ``EXACT`` / 16, so the
histogram that the driver packs has a bounded number of rows however many groups there are.

Classes enter the shards in descending order, each item into the tightest shard that still
holds it, found in a balanced tree of the remaining room; a run of equal sizes moves as one step.  The smallest capacity for which all groups fit is found by bisection,
and a group larger than an even share takes a shard of its own before the others are packed.

Within a class, ranks (made in sub-partitions) tell groups apart; slots within a shard are
row numbers of hashed chunks shifted by the chunks before, so no shard meets in one task.

Copies of one text go to one shard but not through one task: the few groups of at least
``HOT`` rows, and at most one in ``HOT`` of all rows can be one, are met by broadcast.

Defined results: null and empty texts are one group of ``OVERHEAD`` bytes a row; repeated
rows get slots of their own; very long texts count with all their bytes; groups of equal size are
told apart by a hash of the text, and rows of equal id and text take slots in any order; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .cluster import ranked, staged, window_target
from .trees import Rooms

OVERHEAD = 8
EXACT = 1 << 14
#: Rows from which a group of copies is joined by broadcast; there are at most total / HOT such groups, and 10,000.
HOT = 1000


def size_class(size: Column) -> Column:
    """Upper bound of the class of a size: exact to ``EXACT``, then steps of 2^k for sizes of under EXACT / 16 * 2^(k+1)."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - F.lit(np.log2(EXACT / 16)))
    wide = (F.ceil(size / step) * step).cast("long")
    return F.when(size <= EXACT, size).otherwise(wide)


def best_fit(sizes: list[tuple[int, int]], shards: int, capacity: int) -> list[tuple[int, int, int]] | None:
    """(size, count, shard) steps that place all (size, count) runs, largest first; None if they do not fit."""
    room = Rooms((capacity, s) for s in range(shards))
    out = []
    for size, count in sizes:
        while count:
            if (found := room.tightest(size)) is None:
                return None
            space, shard = found
            n = min(count, space // size) if size else count
            out.append((size, n, shard))
            room.add((space - n * size, shard))
            count -= n
    return out


def plan(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Steps at the least capacity found; groups above an even share of what is left get shards of their own."""
    sizes = sorted(sizes, reverse=True)
    out, first = [], 0
    while sizes and shards - first > 1 and sizes[0][0] * (shards - first) > sum(s * n for s, n in sizes):
        size, n = sizes[0]
        out.append((size, 1, first))
        sizes = [(size, n - 1), *sizes[1:]] if n > 1 else sizes[1:]
        first += 1
    if not sizes:
        return out
    low = max(sizes[0][0], -(-sum(s * n for s, n in sizes) // (shards - first)))
    high, best = low, best_fit(sizes, shards - first, low)
    while best is None:
        low, high = high + 1, high + max(1, high // 256)
        best = best_fit(sizes, shards - first, high)
    while low < high:
        middle = (low + high) // 2
        if (found := best_fit(sizes, shards - first, middle)) is None:
            low = middle + 1
        else:
            high, best = middle, found
    return out + [(size, n, first + shard) for size, n, shard in best]


def _assigned(steps: list[tuple[int, int, int]]):
    table = pd.DataFrame(steps, columns=["cls", "n", "shard"])
    ranges = {int(c): (np.cumsum(g["n"].to_numpy()), g["shard"].to_numpy().astype(np.int32)) for c, g in table.groupby("cls")}

    def of(batches):
        for batch in batches:
            cls, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cls", "rank"))
            shard = np.zeros(len(cls), np.int32)
            for c in np.unique(cls):
                own = np.flatnonzero(cls == c)
                upto, where = ranges[int(c)]
                shard[own] = where[np.searchsorted(upto, rank[own], side="right")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in ("key", "rows")), pa.array(shard)], names=["key", "rows", "shard"])

    return of


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard; shards are near equal in bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    rows = staged(rows, "sharding-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).withColumn("cls", size_class(F.col("bytes")))
    groups = staged(groups.select("key", "rows", "cls"), "sharding-groups")
    sizes = groups.groupBy("cls").agg(F.count("*").alias("cnt"))
    found = [(r["cls"], r["cnt"]) for r in sizes.collect()]  # bounded: EXACT rows and EXACT / 16 an octave
    counts = spark.createDataFrame(found, "cls long, cnt long")
    place = ranked(groups, "cls", counts, sum(n for _, n in found), [F.col("key")]).select("key", "rows", "cls", "rank")
    place = staged(place.mapInArrow(_assigned(plan(found, shards)), "key binary, rows long, shard int"), "sharding-place")
    total = rows.count()
    hot = F.broadcast(place.filter(F.col("rows") >= max(HOT, total // 10_000)).select("key", "shard"))
    met, others = rows.join(hot, "key"), rows.join(hot, "key", "left_anti").join(place.select("key", "shard"), "key")
    placed = staged(met.unionByName(others).select("doc_id", "size", "text_crc32", "shard"), "sharding-placed")
    per = placed.groupBy("shard").agg(F.count("*").alias("cnt"))
    chunks = per.select("shard", F.ceil(F.col("cnt") / window_target(spark, total)).cast("int").alias("chunks"))
    cut = placed.join(F.broadcast(chunks), "shard").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("chunks"))).drop("chunks")
    before = cut.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = before.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32")) - 1
    return cut.withColumn("local", local).join(before, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("local") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
