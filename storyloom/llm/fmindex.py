"""Benchmark decontamination by FM-indexes over shards of the training text.

A shard is a run of whole documents inside a task.  Of its words only stretches that could
hold an occurrence are indexed: maximal runs of words that some benchmark item has, at
least as long as the shortest test phrase.  Their suffixes are sorted by doubling, the
Burrows-Wheeler transform goes into a wavelet matrix, and all phrases are searched backwards
at once.  Occurrences are located by walking to the nearest sampled suffix position; their
word spans are merged per document.

The benchmark is cut into pieces of words, each with the words that the next piece needs, and the
pieces go to the tasks in blocks of about ``BLOCK_WORDS`` words.  The driver holds one block at a
time; each block's spans are written to the shared folder before the next block is read.  A
larger benchmark takes several passes.  The spans of all passes are found in the text as it came,
and merged per text, so the size of the benchmark changes no result.

Defined results: null, empty or word-less texts have no words and no hits; very long texts are
read whole; an item without words has no phrase; an item of fewer words than a window is one
phrase; rows of one item_id are one item of several texts; a null item_id is searched, and its
words are hit, but there is no id to list; equal items all count, and of overlapping or touching
occurrences every word counts once; repeated documents are rows of their own; an empty benchmark
or table hits nothing; extra columns are ignored by ``contamination`` and kept by ``decontaminated``.
"""

from __future__ import annotations

from itertools import chain
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import broadcast_if_small
from . import words
from .cluster import bounded_batches, staged

#: Words of the benchmark that one pass carries, on the driver and on every worker: at most 64 bytes
#: each, for a window of 10 words of 4 bytes, its items and its word.
BLOCK_WORDS = 500_000
#: Indexed words after which a shard is searched, and words of its documents.
SHARD_INDEXED, SHARD_WORDS = 400_000, 3_000_000
#: Every so many-th suffix position is kept.
SAMPLE = 8

#: Hit texts whose spans may be broadcast (spans are a few per text; more texts are joined by a shuffle).
BROADCAST_TEXTS = 100_000

ASCII_WORDS = words.byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class Phrases:
    """Test phrases of a block of items: symbols of their words, and the items of each phrase."""

    def __init__(self, items: list[tuple], window: int):
        texts = [(t or "").encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        low, starts, stops, first = words.find(data, offsets, ASCII_WORDS)
        hashed = words.hashes(low, starts, stops)
        self.items = sorted({i for i, _ in items if i is not None}, key=str)
        name = {i: k for k, i in enumerate(self.items)}
        named = np.array([name.get(i, -1) for i, _ in items], dtype=np.int64)
        self.vocabulary = np.unique(hashed)
        symbol = (np.searchsorted(self.vocabulary, hashed) + 1).astype(np.int32)
        # One row per window: where it begins and how many words it has.
        count = np.diff(first)
        size = np.minimum(count, window)
        runs = np.where(count > 0, count - size + 1, 0)
        owner = np.repeat(np.arange(len(items)), runs)
        begin = np.repeat(first[:-1], runs) + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
        rows = np.zeros((len(owner), window), dtype=np.int32)
        for k in range(window):
            has = size[owner] > k
            rows[has, k] = symbol[begin[has] + k]
        order = np.lexsort(rows.T[::-1]) if len(rows) else np.zeros(0, np.int64)
        rows = rows[order]
        fresh = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
        phrase = np.cumsum(fresh) - 1
        self.symbols = rows[fresh]
        self.size = (self.symbols > 0).sum(axis=1).astype(np.int64)
        self.shortest = int(self.size.min()) if len(self.size) else 0
        pairs = np.unique(np.stack([phrase, named[owner[order]]]), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
        pairs = pairs[:, pairs[1] >= 0]
        self.owner_of = pairs[1].astype(np.int32)
        self.owner_at = np.searchsorted(pairs[0], np.arange(len(self.size) + 1))

    def map(self, hashed: np.ndarray) -> np.ndarray:
        """Symbols from 1, or 0 for a word that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashed, at + 1, 0)


class Wavelet:
    """Wavelet matrix with rank: how often a symbol stands before a place."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][at], self.ones[k][begin]
            at = np.where(one, self.zeros[k] + a, at - a)
            begin = np.where(one, self.zeros[k] + b, begin - b)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.levels):
            one = self.ones[k][at + 1] - self.ones[k][at]
            out = (out << 1) | one
            at = np.where(one == 1, self.zeros[k] + self.ones[k][at], at - self.ones[k][at])
        return out


class FMIndex:
    """Index of a symbol sequence in which 0 parts stretches; phrases never hold a 0."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        breaks = text == 0
        # Each break is a symbol of its own, in text order, so all suffixes differ.
        rank = np.where(breaks, np.cumsum(breaks) - 1, text + int(breaks.sum()))
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        width = 1
        while True:
            after = np.full(n, -1, dtype=np.int64)
            after[: n - width] = rank[width:] if width < n else after[:0]
            key = rank * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")
            step = np.empty(n, dtype=np.int64)
            step[0] = 0
            np.cumsum(key[order][1:] != key[order][:-1], out=step[1:])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = step
            if n == 0 or step[-1] == n - 1:
                break
            width *= 2
        before = text[order - 1]
        self.top = int(text.max())
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        self.tree = Wavelet(before, self.top)
        starts = np.concatenate([[True], breaks[:-1]])
        kept = (order % SAMPLE == 0) | starts[order] | breaks[order]
        self.kept = kept
        self.at = np.concatenate([[0], np.cumsum(kept)])
        self.sample = order[kept]

    def search(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of all phrases, searched backwards together."""
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.counts[-1], np.int64)
        for back in range(1, symbols.shape[1] + 1):
            own = np.flatnonzero((size >= back) & (hi > lo))
            if not len(own):
                break
            c = symbols[own, size[own] - back]
            within = c <= self.top
            lo[own[~within]] = hi[own[~within]] = 0
            own, c = own[within], c[within]
            lo[own] = self.counts[c] + self.tree.rank(c, lo[own])
            hi[own] = self.counts[c] + self.tree.rank(c, hi[own])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled one."""
        out, steps, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.kept[rows[todo]]
            out[todo[done]] = self.sample[self.at[rows[todo[done]]]] + steps[todo[done]]
            todo = todo[~done]
            c = self.tree.access(rows[todo])
            rows[todo] = self.counts[c] + self.tree.rank(c, rows[todo])
            steps[todo] += 1
        return out


def occurrences(symbols: np.ndarray, parts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word position, phrase) of every occurrence; ``parts`` are the texts' first words, which no phrase crosses."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not phrases.shortest or not len(symbols):
        return none
    known = symbols > 0
    cut = np.zeros(len(symbols) + 1, dtype=bool)
    cut[parts[parts <= len(symbols)]] = True
    opens = np.flatnonzero(known & (np.concatenate([[True], ~known[:-1]]) | cut[:-1]))
    closes = np.flatnonzero(known & (np.concatenate([~known[1:], [True]]) | cut[1:])) + 1
    long = closes - opens >= phrases.shortest
    opens, sizes = opens[long], (closes - opens)[long]
    if not len(opens):
        return none
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    text, origin = np.zeros(int(at[-1]), np.int64), np.zeros(int(at[-1]), np.int64)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, word = np.repeat(at[:-1], sizes) + inner, np.repeat(opens, sizes) + inner
    text[place], origin[place] = symbols[word], word
    index = FMIndex(text)
    lo, hi = index.search(phrases.symbols, phrases.size)
    count = np.maximum(hi - lo, 0)
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return origin[index.locate(rows)], phrase


def _cut(batches):
    """Texts without the words of their spans; a text all of whose words are hit goes."""
    for batch in batches:
        for rows, data, offsets in words.slices(batch, "text"):
            _, starts, stops, first = words.find(data, offsets, ASCII_WORDS)
            at = rows.schema.get_field_index("spans")
            spans, raw, texts, stays = rows.column(at).to_pylist(), data.tobytes(), [], []
            for d, own in enumerate(spans):
                begin, kept, hit = int(offsets[d]), [], 0
                for s in own or ():
                    kept.append(raw[begin : starts[first[d] + s["first"]]])
                    begin, hit = int(stops[first[d] + s["last"]]), hit + s["last"] - s["first"] + 1
                texts.append(b"".join([*kept, raw[begin : offsets[d + 1]]]))
                stays.append(not own or hit < first[d + 1] - first[d])
            valid = rows.column(rows.schema.get_field_index("text")).is_valid()
            new = pc.if_else(valid, pa.array(texts, pa.binary()).cast(pa.string()), pa.scalar(None, pa.string()))
            keep = [k for k in range(rows.num_columns) if rows.schema.names[k] not in ("text", "n_words", "spans", "items")]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), new], names=[*(rows.schema.names[k] for k in keep), "text"]).filter(pa.array(stays))


def _scan(phrases: Phrases, extra: list[str]):
    """Hit spans and items of each text, with the columns ``extra`` handed on."""

    def search(symbols, first, count):
        at, phrase = occurrences(symbols, first, phrases)
        mark = np.zeros(count + 1, np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + phrases.size[phrase], -1)
        doc = np.searchsorted(first, at, side="right") - 1
        n = phrases.owner_at[phrase + 1] - phrases.owner_at[phrase] if len(phrase) else np.zeros(0, np.int64)
        item = phrases.owner_of[np.repeat(phrases.owner_at[phrase], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] if len(phrase) else n
        pairs = np.unique(np.stack([np.repeat(doc, n), item]), axis=1) if len(phrase) else np.zeros((2, 0), np.int64)
        return np.cumsum(mark[:-1]) > 0, pairs

    def give(held):
        symbols = np.concatenate([h[1] for h in held])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))]).astype(np.int64)
        hit, pairs = search(symbols, first, len(symbols))
        docs, base = 0, 0
        for rows, own, parts in held:
            mine = hit[base : base + len(own)]
            before = np.concatenate([[False], mine[:-1]])
            before[parts[:-1][parts[:-1] < len(mine)]] = False
            after = np.concatenate([mine[1:], [False]])[: len(mine)]
            ends = parts[1:] - 1
            after[ends[ends >= 0]] = False
            a, b = np.flatnonzero(mine & ~before), np.flatnonzero(mine & ~after)
            spans_at = np.searchsorted(a, parts)
            items = [[] for _ in range(len(rows))]
            chosen = pairs[:, (pairs[0] >= docs) & (pairs[0] < docs + len(rows))]
            for d, i in chosen.T:
                items[d - docs].append(str(phrases.items[i]))
            spans = pa.StructArray.from_arrays([pa.array(a - parts[np.searchsorted(parts, a, side="right") - 1]), pa.array(b - parts[np.searchsorted(parts, b, side="right") - 1])], names=["first", "last"])
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in extra), pa.array(np.diff(parts)), pa.ListArray.from_arrays(pa.array(spans_at, pa.int32()), spans), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=[*extra, "n_words", "spans", "items"],
            )
            docs, base = docs + len(rows), base + len(own)

    def of(batches):
        held, indexed, count = [], 0, 0
        for batch in batches:
            for rows, data, offsets in words.slices(batch, "text"):
                low, starts, stops, first = words.find(data, offsets, ASCII_WORDS)
                own = phrases.map(words.hashes(low, starts, stops))
                held.append((rows if "text" in extra else rows.drop_columns(["text"]), own, first))
                indexed, count = indexed + int((own > 0).sum()), count + len(own)
                if indexed >= SHARD_INDEXED or count >= (SHARD_WORDS // 4 if "text" in extra else SHARD_WORDS):
                    yield from give(held)
                    held, indexed, count = [], 0, 0
        if held:
            yield from give(held)
        held = None
        words.release()

    return of


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pieces(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(i, t, block) of the benchmark's pieces, and how many blocks there are.

    A piece begins at most BLOCK_WORDS / 4 windows and has the words of all of them, so no window
    is lost or made at a cut; an item of fewer words than a window is a piece as it is.
    """
    step = max(1, BLOCK_WORDS // 4)
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(_WORD), 0)
    items = benchmark.select(F.col(item_col).alias("i"), found.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - window, F.lit(0)) / step).cast("int"))
    cut = items.select("i", "w", F.posexplode(starts).alias("k", "_"))
    pieces = cut.select("i", "k", F.slice("w", F.col("k") * step + 1, step + window - 1).alias("w"))
    pieces = staged(pieces.select("i", F.array_join("w", " ").alias("t"), F.size("w").alias("n"), F.xxhash64("i", "k", "w").alias("h")).distinct(), "fmindex-pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // BLOCK_WORDS))
    return pieces.select("i", "t", F.pmod("h", F.lit(blocks)).alias("block")), blocks


def _blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str):
    """The phrases of the benchmark, block by block; a block is read when it is asked for."""
    pieces, blocks = _pieces(benchmark, window, item_col, text_col)
    for k in range(blocks):
        own = pieces.filter(F.col("block") == k) if blocks > 1 else pieces
        yield Phrases([(r["i"], r["t"]) for r in own.select("i", "t").collect()], window), blocks


_SPAN = "array<struct<first:long,last:long>>"


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap or touch as one."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(_SPAN),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["first"] <= F.element_at(acc, -1)["last"] + 1),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["first"], F.greatest(F.element_at(acc, -1)["last"], s["last"]))).cast(_SPAN),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def _hits(rows: DataFrame, blocks) -> DataFrame:
    """(key, spans, items) of each different text that any block hits; ``rows`` has (key, text)."""
    each = None
    for phrases, _ in blocks:
        one = rows.mapInArrow(_scan(phrases, ["key"]), f"key binary, n_words long, spans {_SPAN}, items array<string>")
        one = staged(one.filter(F.size("spans") > 0).drop("n_words").dropDuplicates(["key"]), "fmindex-hits")
        each = one if each is None else each.unionByName(one)
    gathered = each.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return staged(gathered.select("key", _merged(F.col("spans")).alias("spans"), "items"), "fmindex-merged")


def _key(text: str) -> Column:
    """Stands for a whole text; a copy has the same, so it is searched for spans once."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _first_of(blocks):
    first, count = next(blocks)
    return (first, None) if count == 1 else (None, chain([(first, count)], blocks))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: doc_id, n_words, spans of hit words (first, last; from 0), items (ids as sorted strings)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    only, blocks = _first_of(_blocks(benchmark, window, item_col, "text"))
    if only is not None:
        return rows.mapInArrow(_scan(only, ["doc_id"]), f"doc_id long, n_words long, spans {_SPAN}, items array<string>")
    keyed = rows.select("doc_id", _key("text").alias("key"), "text")
    hits = _hits(keyed.select("key", "text"), blocks)
    counted = keyed.mapInArrow(_scan(Phrases([], window), ["doc_id", "key"]), f"doc_id long, key binary, n_words long, spans {_SPAN}, items array<string>")
    met = counted.select("doc_id", "key", "n_words").join(broadcast_if_small(hits, BROADCAST_TEXTS), "key", "left")
    return met.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` with every hit span cut from its text; a document all of whose words are hit goes.

    Other columns stay as they are; a text without words has no hits and stays.  Each row is cut by itself.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    own = [f"c{k}" for k in range(len(rest))]
    schema = ", ".join([*(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(own, rest, strict=True)), "text string"])
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(own, rest, strict=True)), F.col(text_col).alias("text"))
    only, blocks = _first_of(_blocks(benchmark, window, item_col, "text"))
    if only is not None:
        # One function for both steps: chained ones would keep two workers a task.
        search = _scan(only, [*own, "text"])
        done = rows.mapInArrow(lambda batches: _cut(search(batches)), schema)
    else:
        keyed = rows.withColumn("key", _key("text"))
        hits = _hits(keyed.select("key", "text"), blocks).select("key", "spans")
        done = keyed.join(broadcast_if_small(hits, BROADCAST_TEXTS), "key", "left").drop("key").mapInArrow(_cut, schema)
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(own[rest.index(c)]).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The counts and item digest of ``contamination``'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
