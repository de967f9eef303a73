"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles.  Equal sets are one class from the
start.  Each class keeps the low ``BITS`` bits of ``PERMUTATIONS`` minima, packed in
longs, and the keys of bands of minima.  The longest bands are taken that miss a pair at the
threshold with a chance of at most ``MISS``.  Classes that share a band key are
candidates; their similarity is estimated from the packed bits (corrected for chance
collisions), and what is not clearly below the threshold is confirmed on full sets.

Buckets need not emit all pairs.  In each of ``TURNS`` turns a bucket's members are
compared with one member, drawn by a hash of band, id and turn; components of the confirmed
links label the members, and only buckets that still hold several labels go on.  At last
those that are left compare members of different labels: small ones pair by pair, large ones
in blocks of bounded size.  A block first holds the packed bits alone; only members with a likely
mate of another label are brought again with their full sets, and a block hands on a forest of
links, not its pairs.  Pairs of one label cannot change a component, so the result equals that of
comparing all candidates.

Defined results: null, empty or word-less texts have no shingles and link with nothing;
a text of fewer words than a shingle is one shingle; very long texts are read whole.  doc_id
names a document: rows that repeat it each return its component, and if their texts differ the
document has the links of all of them.  A null doc_id joins its class but is never its least id.
An empty table gives no rows.  Extra columns are ignored by ``near_duplicates`` and kept by
``one_of_each``, for which every row is a document of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words
from .cluster import bounded_batches, components, scratch, stage_path, staged

PERMUTATIONS, BITS = 144, 4
#: Chance at most that no band of a pair at the threshold is equal.
MISS = 2e-5
#: An estimate this far under the threshold is nearly five standard errors away.
SLACK = 0.15
#: Turns in which each bucket's members are compared with one of them, another in each band and turn.
TURNS = 2
#: Buckets up to this size compare pairs as rows; larger ones in blocks of so many members.
PAIRED, BLOCK_ROWS = 16, 512
#: So many candidate ids may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

SPACE_WORDS = words.byte_class((0x20, 0x20), (0x09, 0x0D))

_rng = np.random.default_rng(7)
_MUL = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_LONGS = PERMUTATIONS * BITS // 64

_SIGNED = "_id long, n_shingles long, fp1 long, fp2 long, sig array<long>, bands array<long>"


def _lists(values: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, len(values) + 1, width, dtype=np.int32), pa.array(values.view(np.int64)))


def banding(percent: int) -> tuple[int, int]:
    """(bands, minima of a band) for a threshold."""
    for rows in range(12, 1, -1):
        if (1 - (percent / 100) ** rows) ** (PERMUTATIONS // rows) <= MISS:
            return PERMUTATIONS // rows, rows
    return PERMUTATIONS, 1


def _signatures(n: int, count_bands: int, band_rows: int):
    def of(batches):
        for batch in batches:
            for rows, data, offsets in words.slices(batch, "text"):
                low, starts, stops, first = words.find(data, offsets, SPACE_WORDS)
                shingle, at = words.shingles(words.hashes(low, starts, stops), first, n)
                size = len(at) - 1
                has = np.flatnonzero(np.diff(at))
                count, fp = np.zeros(size, np.int64), np.zeros((2, size), np.uint64)
                for d in has:
                    own = np.unique(shingle[at[d] : at[d + 1]])
                    count[d] = len(own)
                    fp[0, d] = words.mix(own).sum(dtype=np.uint64)
                    fp[1, d] = words.mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
                minima = np.zeros((PERMUTATIONS, size), np.uint32)
                if len(has):
                    x = (shingle >> np.uint64(32)).astype(np.uint32)
                    for k in range(PERMUTATIONS):
                        minima[k, has] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], at[has])
                wide = words.mix(minima.astype(np.uint64) + (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32))[:, None])
                low_bits = wide & np.uint64((1 << BITS) - 1)
                per = 64 // BITS
                sig = np.zeros((size, _LONGS), np.uint64)
                for k in range(PERMUTATIONS):
                    sig[:, k // per] |= low_bits[k] << np.uint64(BITS * (k % per))
                bands = np.stack([words.combine([wide[b * band_rows + r] for r in range(band_rows)]) for b in range(count_bands)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index("_id")).cast(pa.int64()), pa.array(count), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), _lists(sig.reshape(-1), _LONGS), _lists(bands.reshape(-1), count_bands)],
                    names=["_id", "n_shingles", "fp1", "fp2", "sig", "bands"],
                )

    return of


def _sets(n: int):
    def of(batches):
        for batch in batches:
            for rows, data, offsets in words.slices(batch, "text"):
                low, starts, stops, first = words.find(data, offsets, SPACE_WORDS)
                shingle, at = words.shingles(words.hashes(low, starts, stops), first, n)
                own = [np.unique(shingle[at[d] : at[d + 1]]) for d in range(len(at) - 1)]
                fp = np.array([words.mix(x).sum(dtype=np.uint64) for x in own], np.uint64)
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index("_id")).cast(pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(flat.view(np.int64))), pa.array(fp.view(np.int64))], names=["_id", "own", "fp"]
                )

    return of


def similarity(a: str, b: str) -> Column:
    """Collision-corrected estimate from two packed signatures: equal nibbles by bit counts."""
    low = F.lit(0x1111111111111111)
    differ = None
    for k in range(_LONGS):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        one = F.bit_count(x.bitwiseAND(low))
        differ = one if differ is None else differ + one
    chance = 1.0 / (1 << BITS)
    return ((F.lit(1.0) - differ / F.lit(float(PERMUTATIONS))) - F.lit(chance)) / F.lit(1.0 - chance)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Two documents link when 100 * intersection >= percent * union of their shingle
    sets; component_id is the least doc_id reachable, kept is doc_id = component_id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    signed = staged(source.mapInArrow(_signatures(shingle, *banding(percent)), _SIGNED), "minhash-signed")
    classes = signed.filter("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("_id").alias("rep"))
    classes = staged(classes, "minhash-classes")
    reps = signed.filter("n_shingles > 0").join(classes.select(F.col("rep").alias("_id"), "fp1", "fp2"), ["_id", "fp1", "fp2"]).dropDuplicates(["_id", "fp1", "fp2"])
    reps = staged(reps.select("_id", "n_shingles", "sig", "bands"), "minhash-reps")

    keyed = reps.select(F.explode("bands").alias("band"), "_id")
    met = staged(keyed.groupBy("band").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).filter("lo <> hi").select("band"), "minhash-bands")
    bucketed = staged(keyed.join(met, "band"), "minhash-members")
    light = reps.select("_id", "n_shingles", "sig")
    links, label, left = None, None, bucketed.withColumn("comp", F.col("_id"))
    for turn in range(TURNS):
        # Staged, so that a bucket of any weight meets its one leader by broadcast or in a join that AQE splits.
        lead = staged(left.groupBy("band").agg(F.min(F.struct(F.xxhash64("band", "_id", F.lit(turn)).alias("h"), "_id", "comp")).alias("lead")), "minhash-lead")
        pairs = left.join(lead, "band").filter(F.col("comp") != F.col("lead.comp"))
        pairs = pairs.select(F.least("_id", "lead._id").alias("a"), F.greatest("_id", "lead._id").alias("b")).distinct()
        more = _confirmed(source, _likely(pairs, light, percent), shingle, percent)
        links = staged(more if links is None else links.union(more), "minhash-links")
        label = staged(components(links, "minhash-components"), "minhash-labels").withColumnRenamed("node", "_id")
        named = bucketed.join(label, "_id", "left").withColumn("comp", F.coalesce("comp", "_id"))
        mixed = staged(named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band"), "minhash-mixed-bands")
        bucketed = left = staged(named.join(mixed, "band"), "minhash-mixed")
        if left.isEmpty():
            break
        bucketed = bucketed.drop("comp")
    if not left.isEmpty():
        # Bands often give one and the same set of members: each set is compared once.
        per = left.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("_id").cast("decimal(38,0)")).alias("h"))
        per = staged(per.groupBy("n", "h").agg(F.min("band").alias("band")).drop("h"), "minhash-chosen-bands")
        chosen = staged(left.join(per, "band"), "minhash-chosen")
        more = _confirmed(source, _paired(chosen.filter(F.col("n") <= PAIRED), light, percent), shingle, percent)
        more = staged(more.union(_in_blocks(source, chosen.filter(F.col("n") > PAIRED), light, shingle, percent)), "minhash-links")
        if not more.isEmpty():
            label = staged(components(links.union(more), "minhash-components"), "minhash-labels").withColumnRenamed("node", "_id")

    of_class = classes.join(label.withColumnRenamed("_id", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("comp", "rep").alias("component_id"))
    known = signed.filter("n_shingles > 0").select("_id", "n_shingles", "fp1", "fp2").join(of_class, ["fp1", "fp2"]).select("_id", "n_shingles", "component_id")
    bare = signed.filter("n_shingles = 0").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return known.union(bare).select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one is left of each group of near-duplicates.

    Rows are numbered, so repeated and null ids are documents like any other: of a group the row of
    least id stays, a null id after all others and the first row on a tie.  Texts without words stay.
    """
    spark, names = docs.sparkSession, docs.columns
    numbered = staged(docs.toDF(*(f"c{k}" for k in range(len(names)))).withColumn("line", F.monotonically_increasing_id()), "minhash-numbered")
    key, path = F.col(f"c{names.index(id_col)}").cast("long"), stage_path(spark, "minhash-stays")
    with scratch():
        found = near_duplicates(numbered, shingle, percent, "line", f"c{names.index(text_col)}").select(F.col("doc_id").alias("line"), "component_id")
        first = F.min(F.struct(key.isNull(), key, "line"))
        met = numbered.select("line", key.alias(f"c{names.index(id_col)}")).join(found, "line")
        met.groupBy("component_id").agg(first.alias("least")).select(F.col("least.line").alias("line")).write.parquet(path)
    stays = spark.read.schema("line long").parquet(path)
    # One strategy at every size; lines are unique, so no task gets more than its share.
    return numbered.join(stays.hint("merge"), "line", "left_semi").drop("line").toDF(*names)


def _likely(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs whose sizes and estimated similarity do not rule a link out."""
    a = light.select(F.col("_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    b = light.select(F.col("_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    both = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return staged(both.filter(similarity("sa", "sb") >= percent / 100 - SLACK).select("a", "b"), "minhash-leads")


def _paired(members: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of different labels in buckets of at most ``PAIRED`` members."""
    columns = ("_id", "comp", "n_shingles", "sig")
    rest = members.join(light, "_id")
    x = rest.select("band", *(F.col(c).alias(f"x_{c.strip('_')}") for c in columns))
    y = rest.select("band", *(F.col(c).alias(f"y_{c.strip('_')}") for c in columns))
    near = F.col("x_id") < F.col("y_id")
    near &= F.col("x_comp") != F.col("y_comp")
    near &= F.least("x_n_shingles", "y_n_shingles") * 100 >= F.greatest("x_n_shingles", "y_n_shingles") * percent
    near &= similarity("x_sig", "y_sig") >= percent / 100 - SLACK
    return staged(x.join(y, (x["band"] == y["band"]) & near).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct(), "minhash-more")


def _in_blocks(source: DataFrame, members: DataFrame, light: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links of different labels in large buckets, whose members meet block by block: by packed bits, then those with a likely mate by full sets."""
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    cut = members.withColumn("part", F.pmod(F.xxhash64("_id"), parts).cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), parts - 1)))
    cut = cut.select("band", F.least("part", "mate").alias("x"), F.greatest("part", "mate").alias("y"), "part", "_id", "comp")
    cut = staged(cut, "minhash-blocks")
    likely = cut.join(light, "_id").groupBy("band", "x", "y").applyInArrow(_block_likely(percent), "band long, x int, y int, part int, _id long, comp long")
    likely = staged(likely, "minhash-block-members")
    ids = staged(likely.select("_id").distinct(), "minhash-ids")
    dealt = likely.join(_own_sets(source, ids, shingle).select("_id", "own"), "_id")
    return dealt.groupBy("band", "x", "y").applyInArrow(_block_links(percent), "a long, b long")


def _block_likely(percent: int):
    """Members of a block with a mate of another label whose size and estimate do not rule a link out."""

    def of(table: pa.Table) -> pa.Table:
        comp, part, size = (table.column(c).to_numpy() for c in ("comp", "part", "n_shingles"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _LONGS)
        left, right = np.flatnonzero(part == table.column("x")[0].as_py()), np.flatnonzero(part == table.column("y")[0].as_py())
        low, chance, some = np.uint64(0x1111111111111111), 1.0 / (1 << BITS), np.zeros(len(comp), bool)
        for k in left:
            x = sig[right] ^ sig[k]
            x |= x >> np.uint64(2)
            x |= x >> np.uint64(1)
            alike = (1 - np.bitwise_count(x & low).sum(axis=1) / PERMUTATIONS - chance) / (1 - chance)
            near = (alike >= percent / 100 - SLACK) & (comp[right] != comp[k]) & (np.minimum(size[right], size[k]) * 100 >= np.maximum(size[right], size[k]) * percent)
            some[k] |= near.any()
            some[right[near]] = True
        return table.select(["band", "x", "y", "part", "_id", "comp"]).filter(pa.array(some))

    return of


def _block_links(percent: int):
    def of(table: pa.Table) -> pa.Table:
        ids, comp, part = (table.column(c).to_numpy() for c in ("_id", "comp", "part"))
        own = table.column("own").combine_chunks()
        size = np.diff(own.offsets.to_numpy())
        row = np.repeat(np.arange(len(ids)), size)
        _, token, count = np.unique(own.flatten().to_numpy(), return_inverse=True, return_counts=True)
        # Shingles of one member alone share nothing.
        code = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[token]
        row, code = row[code >= 0], code[code >= 0]
        left, right = np.flatnonzero(part == table.column("x")[0].as_py()), np.flatnonzero(part == table.column("y")[0].as_py())
        both = np.zeros((len(left), len(right)), np.int32)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, 8192):
            a, b = np.searchsorted(code, [at, at + 8192])
            bits = np.zeros((len(ids), 8192), np.uint8)
            bits[row[a:b], code[a:b] - at] = 1
            bits = np.packbits(bits, axis=1).view(np.uint64)
            there = bits[right]
            for k, r in enumerate(left):
                both[k] += np.bitwise_count(bits[r] & there).sum(axis=1, dtype=np.int32)
        union = size[left][:, None] + size[right][None, :] - both
        linked = (both.astype(np.int64) * 100 >= union.astype(np.int64) * percent) & (comp[left][:, None] != comp[right][None, :])
        names, start = np.unique(comp, return_inverse=True)
        root = np.arange(len(names))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            p, q = find(start[left[i]]), find(start[right[j]])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((ids[left[i]], ids[right[j]]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return of


def _own_sets(source: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """Full shingle sets of the documents in ``ids``, made again from their texts alone."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    own = source.join(wanted, "_id", "left_semi").mapInArrow(_sets(shingle), "_id long, own array<long>, fp long")
    return staged(own.filter(F.size("own") > 0).dropDuplicates(["_id", "fp"]), "minhash-sets")


def _confirmed(source: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link by their full shingle sets, which are made again for these documents alone."""
    ids = staged(pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct(), "minhash-ids")
    own = _own_sets(source, ids, shingle)
    joined = pairs.join(own.select(F.col("_id").alias("a"), F.col("own").alias("sa")), "a").join(own.select(F.col("_id").alias("b"), F.col("own").alias("sb")), "b")
    shared = joined.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("s"))
    return shared.filter(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b")
