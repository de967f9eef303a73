"""Token ids in patched frame-of-reference blocks, in ascending doc_id order.

A segment holds the ids of consecutive documents.  Its blocks of ``BLOCK`` ids keep the
block's least id, the ids above it packed at a width that covers ``PERCENTILE`` of them,
and a list of exceptions (place, full difference) for the rest.  An index gives each
block's width and its start in the packed stream and in the exception list, so a block can
be read alone.  Streams are grouped by width, which lets numpy pack all equal widths at once.

Layout of a segment, all little-endian: 8 bytes magic; u4 number of documents, u8 number
of ids, u4 number of blocks, u4 number of exceptions; i8 doc_id and u4 count per document;
u4 least id, u1 width, u4 start (in 64-bit words), u4 exception start per block; u8 packed
words; u2 places; u4 differences.

Segments travel through Spark's own writer as the binary column of a Parquet table in the
shared folder: a file appears only when its task has committed, on any file system.

``read_range`` reads any stretch of ids by the index: of each segment that it meets only the head
and the blocks it needs are decoded.

Defined results: null or empty texts have the end id alone; very long texts are encoded whole and
never split over segments; repeated doc_ids follow each other, by a hash of the text and then as
they were read; a null doc_id sorts first; an empty table writes no segment; extra columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import words
from .cluster import bounded_batches, partitions, stage_path
from .tokens import encoder

MAGIC = b"SLPFOR1\n"
BLOCK = 512
PERCENTILE = 0.9
#: Ids after which a segment ends (with the run of documents encoded together).
SEGMENT_IDS = 1 << 20

_DOC = np.dtype([("doc", "<i8"), ("null", "u1"), ("n", "<u4")])
_IDX = np.dtype([("low", "<u4"), ("width", "u1"), ("start", "<u4"), ("except", "<u4")])
_HEAD = np.dtype([("docs", "<u4"), ("ids", "<u8"), ("blocks", "<u4"), ("exceptions", "<u4")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values into rows of ``width`` 64-bit words."""
    out = np.zeros((len(values), width), dtype=np.uint64)
    for k in range(64):
        word, bit = divmod(k * width, 64)
        out[:, word] |= values[:, k] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= values[:, k] >> np.uint64(64 - bit)
    return out


def _unpack(rows: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(rows), 64), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, bit = divmod(k * width, 64)
        got = rows[:, word] >> np.uint64(bit)
        if bit + width > 64:
            got |= rows[:, word + 1] << np.uint64(64 - bit)
        out[:, k] = got & mask
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def encode_segment(docs: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment of the format above; ids are unsigned 32-bit."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, dtype=np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    grid = padded.reshape(blocks, BLOCK)
    index = np.zeros(blocks, dtype=_IDX)
    words, where, what = [], np.zeros(0, "<u2"), np.zeros(0, "<u4")
    if blocks:
        low = grid.min(axis=1)
        above = grid - low[:, None]
        at = min(BLOCK - 1, int(BLOCK * PERCENTILE))
        width = _bits(np.partition(above, at, axis=1)[:, at])
        patched = above > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
        row, column = np.nonzero(patched)
        where, what = column.astype("<u2"), above[patched].astype("<u4")
        index["low"], index["width"] = low, width
        index["except"] = np.searchsorted(row, np.arange(blocks))
        at = 0
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            index["start"][own] = at + np.arange(len(own)) * (BLOCK // 64 * int(w))
            at += len(own) * (BLOCK // 64) * int(w)
            if w:
                kept = above[own].astype(np.uint64) & np.uint64((1 << int(w)) - 1)
                words.append(_pack(kept.reshape(-1, 64), int(w)).reshape(-1))
    table = np.zeros(len(docs), dtype=_DOC)
    table["doc"], table["null"], table["n"] = [d or 0 for d in docs], [d is None for d in docs], counts
    head = np.array([(len(docs), len(ids), blocks, len(where))], dtype=_HEAD)
    return b"".join([MAGIC, head.tobytes(), table.tobytes(), index.tobytes(), *(w.astype("<u8").tobytes() for w in words), where.tobytes(), what.tobytes()])


def _parts(raw: bytes):
    """(head, documents, index, packed words, places, differences) of a segment, as views of its bytes."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token segment")
    at = len(MAGIC)

    def take(kind, n):
        nonlocal at
        out = np.frombuffer(raw, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    head = take(_HEAD, 1)[0]
    table, index = take(_DOC, int(head["docs"])), take(_IDX, int(head["blocks"]))
    packed = take("<u8", int((index["width"].astype(np.int64) * (BLOCK // 64)).sum()))
    return head, table, index, packed, take("<u2", int(head["exceptions"])), take("<u4", int(head["exceptions"]))


def decode_blocks(raw: bytes, first: int, last: int) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` alone, by the index; the others are not decoded."""
    head, _, index, packed, where, what = _parts(raw)
    out = []
    for k in range(first, last + 1):
        width, start = int(index["width"][k]), int(index["start"][k])
        grid = np.zeros(BLOCK, dtype=np.uint64)
        if width:
            grid = _unpack(packed[start : start + BLOCK // 64 * width].astype(np.uint64).reshape(-1, width), width).reshape(-1)
        own = slice(int(index["except"][k]), int(index["except"][k + 1]) if k + 1 < len(index) else len(where))
        grid[where[own]] = what[own]
        out.append((grid + index["low"][k])[: int(head["ids"]) - k * BLOCK])
    return np.concatenate(out).astype("<u4")


def decode_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a segment."""
    head, table, index, packed, where, what = _parts(raw)
    packed = packed.astype(np.uint64)
    grid = np.zeros((len(index), BLOCK), dtype=np.uint64)
    for w in np.unique(index["width"]):
        if w:
            own = np.flatnonzero(index["width"] == w)
            first = int(index["start"][own[0]])
            rows = packed[first : first + len(own) * (BLOCK // 64) * int(w)].reshape(-1, int(w))
            grid[own] = _unpack(rows, int(w)).reshape(len(own), BLOCK)
    row = np.repeat(np.arange(len(index)), np.diff(np.append(index["except"].astype(np.int64), len(where))))
    grid[row, where] = what
    ids = (grid + index["low"][:, None]).reshape(-1)[: int(head["ids"])].astype("<u4")
    docs = [None if z else int(d) for d, z in zip(table["doc"], table["null"], strict=True)]
    return docs, table["n"].astype(np.int64), ids


def _write(path: str, drops_space: bool, end_id: int):
    def of(batches):
        codec, part, seg = encoder(path, drops_space), TaskContext.get().partitionId(), 0
        docs, counts, parts, total = [], [], [], 0

        def flush():
            nonlocal docs, counts, parts, total, seg
            payload = encode_segment(docs, np.concatenate(counts), np.concatenate(parts))
            row = pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "n_docs": len(docs), "n_ids": total, "payload": payload}], schema=_SEGMENT)
            docs, counts, parts, total, seg = [], [], [], 0, seg + 1
            return row

        for batch in batches:
            for rows, ids, bounds in codec.batches(batch, "text"):
                docs += rows.column(0).to_pylist()
                parts.append(np.insert(ids, bounds[1:], end_id))
                counts.append(np.diff(bounds) + 1)
                total += len(parts[-1])
                if total >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()
        words.release()

    return of


_TABLE = "part int, seg int, n_docs long, n_ids long, payload binary"
_SEGMENT = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end_id: int = 2, drops_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the segments under ``out``, by ascending doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The rows of one id, if it has many, are cut by text and place as well.
    order = ["doc_id", "hash", "line"]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("line", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    segments = rows.mapInArrow(_write(tokenizer, drops_space, end_id), _TABLE)
    segments.write.option("compression", "uncompressed").parquet(out)


def _bases(table: DataFrame) -> DataFrame:
    """(part, seg, base): the ids before each segment."""
    counts = table.select("part", "seg", "n_ids")
    # Segments are summed within their range partition and range partitions among themselves,
    # so the one-task window sees as many rows as there are partitions.
    whole = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_ids")
    return counts.select("part", "seg", inner.alias("inner")).join(whole, "part").select("part", "seg", (F.col("inner") + F.col("before")).alias("base"))


def read_range(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """(start, ids binary): the ids from ``start`` on, a row per segment that holds some of them."""
    table = spark.read.schema(_TABLE).parquet(path)
    met = _bases(table).join(table.select("part", "seg", "n_ids"), ["part", "seg"]).filter((F.col("base") < start + length) & (F.col("base") + F.col("n_ids") > start))
    chosen = table.select("part", "seg", "payload").join(F.broadcast(met), ["part", "seg"]).select("base", "n_ids", "payload")

    def of(batches):
        for batch in batches:
            for base, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                a, b = max(start - base, 0), min(start + length - base, n)
                ids = decode_blocks(raw, a // BLOCK, (b - 1) // BLOCK)[a % BLOCK :][: b - a]
                yield pa.RecordBatch.from_arrays([pa.array([base + a]), pa.array([ids.tobytes()], pa.binary())], names=["start", "ids"])

    return chosen.mapInArrow(of, "start long, ids binary")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of each document, decoded from the written files."""
    table = spark.read.schema(_TABLE).parquet(path)
    starts = _bases(table)
    decoded = table.select("part", "seg", "payload").mapInArrow(_read, "part int, seg int, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary")
    return decoded.join(starts, ["part", "seg"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")


def _read(batches):
    for batch in batches:
        for row in range(len(batch)):
            docs, counts, ids = decode_segment(batch.column(2)[row].as_py())
            ends = np.cumsum(counts)
            raw = [ids[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0)[row].as_py()] * len(docs), pa.int32()), pa.array([batch.column(1)[row].as_py()] * len(docs), pa.int32()),
                    pa.array(docs, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary()),
                ],
                names=["part", "seg", "doc_id", "local", "n_tokens", "ids_crc32", "ids"],
            )


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, drops_space: bool = False) -> DataFrame:
    """Write ``docs`` into the shared folder and return what the files hold, per document."""
    out = stage_path(docs.sparkSession, "token-files")
    write_tokens(docs, tokenizer, out, end_id, drops_space)
    return read_tokens(docs.sparkSession, out)
